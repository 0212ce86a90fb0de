"""Text operators against brute force, round trips and held-out accuracy; nulls, ties, repeats, empty tables."""

import base64
import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexspark.llm import bpe, common, decontam, exact_dedup, langid, line_dedup, minhash, ppm, pretoken, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string"
WORDS = {"en": "the of and tion ing er that is was with".split(), "fr": "le la et que eau eux oi dans une les".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.choice((1, 1, 2, 3)))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, with an extra column of a clashing name."""
    rng = random.Random(1)
    rows = [(1, None, None), (2, "", "en"), (None, "Some text here", "fr"), (3, "  \n\t ", "en"), (4, "abc", "fr"), (4, "abc", "fr"), (5, "ABC", "en"), (6, prose(rng, "en", 9000), "en"), (7, "é" * 3000, "fr"), (8, "x", "en")]
    rows += [(i, prose(rng, "en" if i % 2 else "fr", 40), "en" if i % 2 else "fr") for i in range(9, 60)]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("value", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return df.collect()


def test_pretokens_equal_the_pattern():
    import regex

    rng = random.Random(2)
    texts = ["".join(rng.choices(" '\n\tstrevlmdaé5!’漢٣ '", k=rng.randint(0, 40))) for _ in range(3000)]
    pattern = regex.compile(public_tokenizers.PATTERN)
    data, at, counts = pretoken.slices(texts)
    k = 0
    for text, n in zip(texts, counts.tolist()):
        assert [data[a:b].decode() for a, b in zip(at[k : k + n], at[k + 1 : k + n + 1])] == pattern.findall(text)
        k += n


def test_bpe_equals_the_library_and_round_trips(odd, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows_of(odd):
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows_of(bpe.encode_decode(odd, path))) == want
    assert rows_of(bpe.encode_decode(none, path)) == []
    ids, offsets = bpe.Codec(ranks).encode("héllo wörld")
    assert offsets[0] == 0 and len(offsets) == len(ids) and all(np.diff(offsets) > 0)


def test_token_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100, "a<|endoftext|>b <|endoftext|>")], "doc_id long, text string"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in rows_of(docs))
    assert Counter(tuple(r) for r in rows_of(token_counts.count_tokens(docs, path))) == want
    assert rows_of(token_counts.count_tokens(none, path)) == []


def test_exact_dedup_equals_grouping(spark, odd, none):
    long = ("x" * 5000, "x" * 4999 + "y", "x" * 2048, "x" * 4096)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate([*long, *long[:2]])], "doc_id long, text string"))
    low = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = defaultdict(list)
    for r in rows_of(docs):
        groups[low(r["text"])].append(r["doc_id"])
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows_of(exact_dedup.exact_dedup(docs))) == want
    assert rows_of(exact_dedup.exact_dedup(none)) == []


def test_block_names_tell_colliding_cells_apart(spark, monkeypatch):
    """With a hash of two values only, all cells are crowded; ranks alone have to tell texts apart."""
    rng = random.Random(13)
    texts = ["".join(rng.choices("ab", k=n)) for n in (1, 2, 3, 16, 16, 17, 40, 40, 64) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:9], "", None])), "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    monkeypatch.setattr(common, "HOT", 4)
    real = F.xxhash64
    want = sorted(rows_of(exact_dedup.exact_dedup(docs)))
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) % 2)
    assert sorted(rows_of(exact_dedup.exact_dedup(docs))) == want
    by = defaultdict(set)
    for r in want:
        by[r["text_sha256"]].add((r["keep_id"], r["group_size"]))
    assert len({k for x in by.values() for k, _ in x}) == len(by) == len({x for x in texts} | {""})


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(changes):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(1000)
        out.append(" ".join(w))
    return out


def test_near_dedup_equals_all_pairs(spark, odd, none):
    rng = random.Random(3)
    texts = [t for k in range(6) for t in near_copies(rng, prose(rng, "en", 150), 25, k)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()
    sets = {}
    for r in rows_of(docs):
        w = common.words_of(r["text"])
        sets[r["doc_id"]] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    uf, ids = common.UnionFind(), [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                uf.union(a, b)
    got = rows_of(minhash.near_dedup(docs))
    assert len(got) == docs.count()
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), None if i is None else uf.find(i), i is None or uf.find(i) == i)
    assert rows_of(minhash.near_dedup(none)) == []


def test_large_buckets_are_compared_chunk_by_chunk(spark, monkeypatch):
    rng = random.Random(4)
    texts = near_copies(rng, prose(rng, "en", 200), 60, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rows_of(minhash.near_dedup(docs).orderBy("doc_id"))
    monkeypatch.setattr(minhash, "CHUNK", 7)
    assert rows_of(minhash.near_dedup(docs).orderBy("doc_id")) == want and want[59]["component_id"] == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(80):
        h = rng.integers(0, 2**63, 120).astype(np.uint64)
        s = minhash.signatures([np.unique(h[:90]), np.unique(h[30:])], 168)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(0.25 / 168) * 1.1


def brute_groups(docs):
    """Groups of occurrences by edit similarity of all pairs of lines, without any hashing."""
    where = defaultdict(set)
    for i, t in docs:
        for n, line in enumerate(line_dedup.normalised_lines(t)):
            if line:
                where[line].add((i, n))
    lines, uf = list(where), common.UnionFind()
    for i in range(len(lines)):
        uf.find(i)
        for j in range(i):
            if line_dedup.similar(lines[i], lines[j]):
                uf.union(i, j)
    groups = defaultdict(set)
    for i, x in enumerate(lines):
        groups[uf.find(i)] |= where[x]
    return list(groups.values())


def brute_drops(docs):
    return {o for g in brute_groups(docs) for o in sorted(g, key=lambda o: (o[0] is not None, o))[1:]}


def slipped(rng, line, share):
    """The line with some words changed, swapped for others or dropped, or some letters changed."""
    words = line.split()
    kind = rng.randrange(3)
    if kind == 0:
        for _ in range(max(1, round(len(words) * share / 2))):
            words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=4))
    elif kind == 1:
        del words[rng.randrange(len(words))]
    else:
        k = rng.randrange(len(words))
        words[k] = words[k][:-1] + "z"
    return " ".join(words)


def test_line_dedup_equals_all_pairs(spark, odd, none):
    rng = random.Random(6)
    base = [prose(rng, "en", 60) for _ in range(12)]
    texts = ["\n".join(rng.choice(base).replace("tion", rng.choice(("tion", "tion", "tiom")), 1) for _ in range(4)) + "\nshort one\n" for _ in range(40)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()
    drops = brute_drops([tuple(r) for r in rows_of(docs)])
    assert len(drops) > 100
    for r in rows_of(line_dedup.summary(docs)):
        assert r["n_dropped"] == sum(i == r["doc_id"] for i, _ in drops)
    texts = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    for r in rows_of(line_dedup.deduplicate(docs)):
        text = texts[r["doc_id"]]
        want = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r["doc_id"], n) not in drops)
        assert r["text"] == want
    assert rows_of(line_dedup.summary(none)) == [] and rows_of(line_dedup.deduplicate(none)) == []


def test_line_dedup_recall_against_all_pairs_by_edit_similarity(spark):
    """Links by edit similarity alone, over lines of two words and more; every group found is one of these."""
    rng = random.Random(61)
    lines = []
    for n in (2, 3, 4, 5, 8, 12, 20, 30, 60):
        for _ in range(40):
            line = prose(rng, rng.choice(("en", "fr")), n)
            lines += [line, slipped(rng, line, 0.15)]
    rng.shuffle(lines)
    docs = [(k, "\n".join(lines[k : k + 5])) for k in range(0, len(lines), 5)]
    want = {frozenset(g) for g in brute_groups(docs) if len(g) > 1}
    found, grouped = line_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"))
    got = defaultdict(set)
    for r in rows_of(line_dedup.marked(found, grouped)):
        got[r["root"]].add((r["id"], r["line"]))
    whole = {o: g for g in want for o in g}
    assert all(len({whole.get(o) for o in g}) == 1 and whole[next(iter(g))] for g in got.values())  # nothing linked that is not alike
    links = sum(len(g) - 1 for g in want)
    assert links > 250 and sum(len(g) - 1 for g in got.values()) >= 0.97 * links


@pytest.mark.parametrize("chunk", [7, 800])
def test_large_buckets_of_lines_are_compared_whole(spark, monkeypatch, chunk):
    """Chains of lines of which only neighbours are alike, in buckets of many: no link may be lost to chunks."""
    rng = random.Random(64)
    lines, line = [], prose(rng, "en", 40).split()
    for k in range(60):
        line[k % 40] = "".join(rng.choices("mnopqr", k=5))
        lines.append(" ".join(line))
    docs = list(enumerate(lines)) + [(100 + k, "the one line that everyone has") for k in range(300)]
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    monkeypatch.setattr(common, "HOT", 3)
    got = {r["doc_id"]: r["n_dropped"] for r in rows_of(line_dedup.summary(spark.createDataFrame(docs, "doc_id long, text string")))}
    drops = brute_drops(docs)
    assert got == {i: int((i, 0) in drops) for i, _ in docs} and sum(got.values()) > 340


def test_short_lines_and_scripts_without_blanks_are_merged(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃晚饭看电影"
    texts = ["Home\nclick here", "home\n\n" + chinese, "Click  here!\n" + chinese, chinese.replace("公", "花"), "click there", "read this page", "read thus page"]
    got = {r["doc_id"]: r["n_dropped"] for r in rows_of(line_dedup.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1}


def test_rows_that_repeat_an_id_lose_their_own_lines_only(spark):
    a, b = "one line that is here twice", "another line that is nowhere else"
    docs = spark.createDataFrame([(1, a), (2, f"{a}\n{b}"), (2, f"{b} or nearly so it seems\n{a}"), (3, a), (3, a)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in rows_of(line_dedup.deduplicate(docs)))
    assert got == [(1, a), (2, b), (2, f"{b} or nearly so it seems"), (3, ""), (3, "")]


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(7)
    for _ in range(1000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_pairs_compared_together_equal_pairs_compared_alone():
    """Of any script and length, with spare edits from none to more than a byte counts."""
    rng = random.Random(71)
    pairs = []
    for letters in ("ab", "abcdefgh ", "aé一\U0001f600 z", "\xfe\xffab"):
        for size in [*rng.choices(range(1, 80), k=150), *[400] * 12, *[1800] * 9]:
            a = rng.choices(letters, k=size)
            b = list(a)
            for _ in range(rng.randrange(size * 3 // 10 + 3)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
            pairs.append(("".join(a), "".join(b)))
            pairs.append(("".join(a), "".join(rng.choices(letters, k=size))))
    want = [line_dedup.similar(a, b) for a, b in pairs]
    assert line_dedup.alike(pairs).tolist() == want and 300 < sum(want) < len(want) - 300
    assert line_dedup.alike([]).tolist() == []


def test_sets_compared_together_keep_their_own_links():
    """Sets of one group, of one line and of none ask for nothing; no set's links go to another, nor join one group twice."""
    rng = random.Random(72)
    norms = [prose(rng, "en", 30) for _ in range(40)]
    sets = []
    for k in range(12):
        own = [norms[k], *(slipped(rng, norms[k], 0.05) for _ in range(20)), *rng.sample(norms, 9)]
        sets.append((list(range(100 * k, 100 * k + 30)), list(range(30)), own))
    sets += [([], [], []), ([9000], [1], ["x"]), ([9001, 9002], [1, 1], ["same line", "same line"])]
    found = [x for part in line_dedup.links_of(line_dedup.Compared(*s) for s in sets) for x in part]
    assert all(a // 100 == b // 100 for a, b in found)
    for numbers, _, own in sets:
        uf, some = common.UnionFind(), [x for x in found if x[0] in numbers]
        assert all(uf.union(a, b) for a, b in some)
        whole = common.UnionFind()
        for i in range(len(own)):
            for j in range(i):
                if line_dedup.similar(own[i], own[j]) and (9001 not in numbers):
                    whole.union(numbers[i], numbers[j])
        assert [uf.find(n) for n in numbers] == [whole.find(n) for n in numbers]


def test_pairs_of_lines_are_compared_once_and_groups_joined_once(monkeypatch):
    """Near copies in two groups need one link, not all pairs; a pair that meets in several sets is compared in one of them, and no link of any set is lost."""
    rng, asked, alike = random.Random(73), [], line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs: asked.extend(pairs) or alike(pairs))
    line = prose(rng, "en", 40)
    near = [slipped(rng, line, 0.01) for _ in range(40)]
    assert len(line_dedup.links(list(range(40)), [0] * 20 + [1] * 20, near)) == 1
    assert len(asked) <= 3  # 20 before
    asked.clear()
    half = prose(rng, "en", 20)
    norms = [f"{half} {prose(rng, 'en', 20)}" for _ in range(12)] + [slipped(rng, line, 0.05) for _ in range(12)]
    order = rng.sample(range(24), 24)
    norms = [norms[i] for i in order]
    sets = [sorted(rng.sample(range(24), 14)) for _ in range(6)]
    found = [x for part in line_dedup.links_of([line_dedup.Compared(list(range(24)), list(range(24)), norms, sets)]) for x in part]
    assert len(asked) == len(set(asked))
    uf, whole = common.UnionFind(), common.UnionFind()
    assert all(uf.union(a, b) for a, b in found)
    for own in sets:
        for i in own:
            for j in own:
                if i < j and line_dedup.similar(norms[i], norms[j]):
                    whole.union(i, j)
    assert [uf.find(i) for i in range(24)] == [whole.find(i) for i in range(24)] and 1 < len({uf.find(i) for i in range(24)}) < 24


def test_lines_without_links_are_compared_in_few_rounds(monkeypatch):
    """All pairs of lines that share half but are no links are compared, once each, many at a time."""
    rng, rounds, alike = random.Random(74), [], line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs: rounds.append(list(pairs)) or alike(pairs))
    half = prose(rng, "en", 20)
    norms = [f"{half} {prose(rng, 'en', 20)}" for _ in range(60)] + [half.replace("e", "x")]
    assert line_dedup.links(list(range(61)), list(range(61)), norms) == []
    asked = [x for part in rounds for x in part]
    assert len(asked) == len(set(asked)) > 500
    assert len(rounds) <= 8  # 40 before


def test_bands_are_as_wide_as_paths_need():
    """Pairs whose edits are all at the beginning, all at the end or there and back, at the limit and one beyond it."""
    rng = random.Random(75)
    pairs, most, want = [], [], []
    for size in (40, 70, 200, 200, 400, 400, 900):
        for gone, come in ((0, 6), (6, 0), (3, 3), (10, 2), (12, 12), (0, 30), (17, 13)):
            for turn in (False, True):
                a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé一", k=size))
                b = a[gone:] + "".join(rng.choices("ABCDEFG", k=come))
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a, b = (a[::-1], b[::-1]) if turn else (a, b)
                d = line_dedup.edit_distance(a, b)
                for k in (d - 1, d, d + 1, 2 * d):
                    if k >= len(a) - len(b):
                        pairs.append((a, b))
                        most.append(k)
                        want.append(d <= k)
    assert line_dedup._band(pairs, np.array(most)).tolist() == want and 100 < sum(want) < len(want)
    for first in range(0, len(pairs), 9):
        assert line_dedup._band(pairs[first : first + 9], np.array(most[first : first + 9])).tolist() == want[first : first + 9]


def test_counts_of_runs_do_not_mix_lines():
    rng = random.Random(76)
    lines = ["".join(rng.choices("abcé一 ", k=rng.choice((0, 1, 2, 2, 3, 30)))) for _ in range(200)]
    assert (line_dedup.cell_counts(lines) == np.concatenate([line_dedup.cell_counts([x]) for x in lines])).all()
    assert line_dedup.cell_counts(lines).sum(1).tolist() == [max(0, len(x) - 2) for x in lines]


def test_toxicity_on_held_out_rows(spark, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 5 == 0
        words = prose(rng, "en", rng.randint(10, 60)).split()
        if toxic:
            for w in rng.choices(["idiot,", "Clown", "trash."], k=2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic != (rng.random() < 0.02))))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, model).withColumn("held", common.held_out("doc_id", 3, 1)))}
    held = [i for i in range(3000) if got[i]["held"]]
    assert sum((got[i]["score"] >= 0.7) == (i % 5 == 0) for i in held) > 0.97 * len(held)
    assert 0 <= got[None]["score"] == got[5000]["score"] < 0.5
    assert rows_of(toxicity.score(none, model)) == []
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in rows_of(toxicity.score(docs, empty).limit(3)))


def test_language_id_on_held_out_rows(odd, none):
    model = langid.train(odd, ~common.held_out("doc_id", 3, 1))
    got = rows_of(langid.identify(odd, model).join(odd.select("doc_id", "lang", "text").where("doc_id >= 9").distinct(), "doc_id"))
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    by = {r["doc_id"]: r for r in rows_of(langid.identify(odd, model))}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[1]["score"] == 0
    untaught = langid.train(none, F.lit(True))
    assert {r["lang_pred"] for r in rows_of(langid.identify(odd, untaught))} == {"und"}


def test_unfolded_network_equals_the_convolution():
    net = langid.Network(["a", "b", "c"])
    x = np.random.default_rng(9).integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net.forward(x)[3], langid.Unfolded(net).probabilities(x), atol=1e-5)


def naive_ppm(texts):
    """PPM as in the docstring, one symbol at a time, from the learnt texts."""
    trie = defaultdict(Counter)
    for t in texts:
        t = b"\xff" * ppm.ORDER + t + b"\xff"
        for i in range(ppm.ORDER, len(t)):
            for k in range(ppm.ORDER + 1):
                trie[t[i - k : i]][t[i]] += 1

    def probability(context, symbol):
        gone, p = set(), 1.0
        for k in range(len(context) + 1):
            node = trie.get(context[k:])
            escape = len(set(node or ()) - gone)
            if not escape:
                continue
            whole = escape + sum(n for s, n in node.items() if s not in gone)
            if symbol in node and symbol not in gone:
                return p * node[symbol] / whole
            p *= escape / whole
            gone |= set(node)
        return p / (256 - len(gone))

    return probability


def naive_score(probability, text):
    text = b"\xff" * ppm.ORDER + text + b"\xff"
    return sum(math.log10(probability(text[i - ppm.ORDER : i], text[i])) for i in range(ppm.ORDER, len(text)))


def test_ppm_levels_equal_a_naive_walk():
    rng = random.Random(10)
    learnt = [ppm.low(prose(rng, "en", 40)) for _ in range(20)]
    asked = [learnt[0][:80], b"zq\xc3\xa9 the\n\n9", b""]
    p = naive_ppm(learnt)
    assert sum(p(b"n the", s) for s in range(256)) == pytest.approx(1)
    codes, counts = ppm.add_up([ppm.count_grams(learnt), (c := ppm.count_grams(asked)[0], np.zeros(len(c), np.int64))])
    below = ppm.levels(*ppm.add_up([(codes & np.uint64((1 << (8 * ppm.GROUP)) - 1), counts)]), ppm.GROUP - 1, None)
    deal = (codes >> np.uint64(8)) % np.uint64(1 << (8 * ppm.GROUP)) % np.uint64(5)  # any function of the bytes before the symbol
    logs = np.zeros(len(codes))
    for d in range(5):
        logs[deal == d] = ppm.solve([(codes[deal == d], counts[deal == d])], below)[0]
    assert ppm.Table(codes, logs).score(asked) == pytest.approx([naive_score(p, t) for t in asked])


def test_lm_scores_equal_a_naive_walk_over_all_documents(odd):
    learn = ~common.held_out("doc_id", 10, 0)
    rows = [(r["doc_id"], r["text"], r["l"]) for r in rows_of(odd.where("doc_id is null or doc_id <> 6").withColumn("l", learn))]
    p = naive_ppm([ppm.low(t) for _, t, l in rows if l])
    want = sorted((str(i), round(naive_score(p, ppm.low(t)), 4)) for i, t, _ in rows)
    got = rows_of(ppm.score(odd.where("doc_id is null or doc_id <> 6"), learn))
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == want
    nothing = rows_of(ppm.score(odd.where("doc_id = 8"), F.lit(False)))
    assert nothing[0]["score"] == pytest.approx(-2 * math.log10(256)) and nothing[0]["train_tokens"] == 0


def test_lm_scoring_baseline(odd, none):
    learn = ~common.held_out("doc_id", 10, 0)
    texts = [(r["doc_id"], r["text"] or "", r["l"]) for r in rows_of(odd.withColumn("l", learn))]
    counts = Counter(w for _, t, l in texts if l for w in common.words_of(t))
    ends = sum(l for _, _, l in texts)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((str(i), len(w := common.words_of(t)) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(log(counts[x]) for x in w) + log(ends), 6)) for i, t, _ in texts)
    got = rows_of(ppm.score(odd, learn))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert rows_of(ppm.score(none, learn)) == []


def test_items_of_every_length_are_found_in_long_texts(spark):
    rng = random.Random(62)
    items, rows = [], []
    for k, n in enumerate((5, 6, 8, 10, 12, 16, 20, 25, 32, 40, 50, 60) * 5):
        words = prose(rng, "en", n).split()
        items.append((k, " ".join(words)))
        if n >= 10 and k % 2:
            words[n // 3] = words[n // 2] = "other"
        host = prose(rng, "en", 300).split()
        at = rng.randrange(300)
        rows.append((k, " ".join(host[:at] + words + host[at:])))
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in rows_of(found) if r["doc_id"] == r["item_id"]} == set(range(len(items)))


def test_items_cut_off_at_their_end_are_found(spark):
    rng = random.Random(63)
    items = [(k, prose(rng, "en", 40)) for k in range(8)]
    rows = [(k, prose(rng, "fr", 200) + " " + " ".join(t.split()[:30] if k % 2 else t.split()[10:]) + " " + prose(rng, "fr", 100)) for k, t in items]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(decontam.leaks(docs, benchmark))} == {(k, k) for k in range(8)}
    told = benchmark.withColumn("answer", F.expr("array_join(slice(split(text, ' '), -10, 10), ' ')"))
    assert {r["doc_id"] for r in rows_of(decontam.leaks(docs, told, answer_col="answer"))} == {0, 2, 4, 6}


def test_warc_round_trip(spark, tmp_path, none):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "same"), (9, "http://c\r\nX: y", "same"), (5, None, "same"), (6, "u", None), (7, "u", ""), (None, "n", "same"), (8, "u", "x" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    archives = warc.write(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in rows_of(warc.read(spark, archives, with_payload=True))}
    assert len(got) == 8
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: 9, 9: None, 5: 9, 6: 7, 7: None, None: 9, 8: None}
    assert got[2]["record_type"] == "revisit" and got[8]["payload"] == b"x" * 400_000
    paths = [r["path"] for r in rows_of(archives)]
    assert sum(gzip.open(p.removeprefix("file://")).read().count(b"WARC/1.1\r\n") for p in paths) == 8
    assert rows_of(warc.read(spark, warc.write(pages.limit(0), f"file://{tmp_path}/e"))) == []


def test_warc_reader_rejects_damage():
    data = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(data)["_payload"] == b"payload"
    with pytest.raises(warc.Broken, match="digest"):
        warc.parse(data.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))
    with pytest.raises(warc.Broken, match="length"):
        warc.parse(data[:-5])
    with pytest.raises(warc.Broken, match="cut off"):
        list(warc.members(io.BytesIO(warc.member(data)[:-9])))


def test_decontamination_finds_paraphrases_only(spark, odd, none):
    rng = random.Random(11)
    items = [(i, prose(rng, "en", rng.randint(15, 60))) for i in range(12)] + [(98, None), (99, "too short")]
    rows = []
    for i, t in items[:12]:
        w = t.split()
        for k in range(0, len(w) - 8, 9):
            w[k] = "other%d" % k  # a ninth of the words replaced, the answer kept
        rows.append((100 + i, prose(rng, "fr", 300) + " " + " ".join(w).upper() + ". " + prose(rng, "en", 200)))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.leaks(docs, benchmark))
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(100 + i, i) for i in range(12)}
    assert {r[0] for r in rows_of(docs.select("doc_id").subtract(decontam.clean(docs, benchmark).select("doc_id")))} == {100 + i for i in range(12)}
    assert rows_of(decontam.leaks(none, benchmark)) == [] and rows_of(decontam.leaks(docs, benchmark.limit(0))) == []


def test_nystroem_finds_the_spectrum():
    rng = np.random.default_rng(12)
    a = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 80))
    omega = rng.standard_normal((80, 16))
    _, sigma = decontam.nystroem(a.T @ (a @ omega), omega, 6)
    assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False)[:6], rtol=1e-3)
