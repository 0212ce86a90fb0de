"""The corpus pipeline, stage by stage and whole, against brute force; clashing column names in every operator and stage."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import bpe, common, decontam, langid, line_dedup, minhash, ppm, registry, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"en": "the of and tion ing er that is was with".split(), "fr": "le la et que eau eux oi dans une les".split()}
#: Names that operators use for columns of their own.
CLASHES = """_id _h _lines _key _gone _toxicity _text _copies id h key digest node part row learn codes logs cell blocks at rank norm sha copies items words
bands rep comp root first n line gone score y order size f x value data left sim band pair found held_out kept group_size keep_id component_id item cosine name""".split()


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.choice((1, 1, 2, 3)))) for _ in range(n))


def corpus(seed=21):
    """Rows of documents, labels and benchmark: nulls, empty and long texts, repeated rows, toxic, near-equal and leaked ones."""
    rng = random.Random(seed)
    items = [(k, prose(rng, "en", 25 + k)) for k in range(6)] + [(6, None), (7, "quorum vexed zephyr")]
    base = [prose(rng, "en", 50) for _ in range(10)]
    texts = []
    for k in range(260):
        words = prose(rng, "en" if k % 3 else "fr", rng.randint(30, 80)).split()
        if k % 6 == 0:
            for w in rng.choices(["idiot,", "Clown", "trash."], k=4):
                words.insert(rng.randrange(len(words)), w)
        lines = [" ".join(words)]
        if k % 4 == 1:
            lines.insert(rng.randrange(2), rng.choice(base).replace("tion", rng.choice(("tion", "tiom")), 1))
        if k % 9 == 2:
            lines.append("Read more here!")
        if k % 20 == 7:
            lines.append(prose(rng, "fr", 20) + " " + items[k // 20 % 6][1])
        texts.append("\n".join(lines))
    near = prose(rng, "fr", 150).split()
    for k in range(6):  # nearly the same words in lines that break elsewhere, which line dedup leaves alone
        copy = list(near)
        copy[10 + 20 * k] = f"other{k}"
        cuts = [0, *range(7 * k + 5, 150, 42), 150]
        texts.append("\n".join(" ".join(copy[a:b]) for a, b in zip(cuts, cuts[1:])))
    texts += [prose(rng, "en", 8000), "it was quorum  vexed\tZEPHYR as said", "", "  \n\n ", "été"]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, "a text without any number of its own", None, "b", 5), (500, None, "fr", "b", 0), rows[3], rows[3]]
    labels = [(k, 1, int(k % 6 == 0)) for k in range(260)] + [(None, 1, 1), (400, None, None)]
    return rows, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_features(text):
    """Words without signs, neighbours, and words with one between, as the operator hashes them."""
    h = [common.xxhash.xxh64_intdigest(b) for w in common.words_of(text) if (b := w.strip(toxicity.STRIP))]
    u = lambda *x: np.array(x, np.uint64)
    out = {x >> 32 for x in h}
    out |= {int(common.ngrams(u(a, b), 2)[0]) >> 32 for a, b in zip(h, h[1:])}
    out |= {int(common.mix64(common.mix64(u(a) + common.PLACE[5]) * common.PLACE[6] + u(b))[0]) >> 32 for a, b in zip(h, h[2:])}
    return out


def plain_ftrl(rows, y, l1, order):
    """FTRL-proximal a coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)
    share = sum(y) / len(y)
    bias, bias_n = math.log(share / (1 - share)), 1.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for i in order:
        w = {f: weight(f) for f in rows[i]}
        g = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.values()))))) - y[i]
        for f in rows[i]:
            z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
            n[f] += g * g
        bias_n += g * g
        bias -= 0.05 * g / math.sqrt(bias_n)
    return {f: w for f in z if (w := weight(f))}, bias


def plain_fit(texts, y):
    rows = [plain_features(t) for t in texts]
    counts = Counter(f for r in rows for f in r)
    rows = [{f for f in r if counts[f] >= toxicity.MIN_TEXTS} for r in rows]
    draw = lambda seed: [i for rng in [np.random.default_rng(seed)] for _ in range(toxicity.EPOCHS) for i in rng.permutation(len(rows))]
    first, _ = plain_ftrl(rows, y, toxicity.L1 * toxicity.EPOCHS * len(rows), draw(7))
    return plain_ftrl([r & first.keys() for r in rows], y, toxicity.REFIT_L1, draw(8))


def test_toxicity_equals_plain_ftrl():
    rows, labels, _ = corpus()
    texts = [rows[k][1] for k in range(260)]
    y = np.array([label for _, _, label in labels[:260]], np.float64)
    cache = toxicity.WordCache()
    keys, w, bias = toxicity.fit([toxicity.features(t, cache) for t in texts], y)
    want, plain_bias = plain_fit(texts, y.tolist())
    assert set(keys.tolist()) == set(want) and len(want) > 3
    assert w == pytest.approx([want[k] for k in keys.tolist()]) and bias == pytest.approx(plain_bias)
    scorer = toxicity.Scorer((keys, w, bias))
    for t in texts[:30]:
        total = bias + sum(want.get(f, 0.0) for f in plain_features(t))
        assert scorer.score(t) == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(22)
    words = prose(rng, "en", 1000).split()
    for _ in range(150):
        words.insert(rng.randrange(len(words)), rng.choice(("--", "*", "...")))
    text = " ".join(words)
    whole = toxicity.features(text, toxicity.WordCache())
    assert set(whole.tolist()) == plain_features(text)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 10)
    assert toxicity.features(text, toxicity.WordCache()).tolist() == whole.tolist()


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "kind ") * 10 + f"w{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    assert len(whole[0])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    assert not len(toxicity.train(docs, labels)[0])


# The stages, each as a plain function over the rows of its input.


def plain_toxic(model, rows):
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    score = lambda t: 1 / (1 + math.exp(-(model[2] + sum(weights.get(f, 0.0) for f in plain_features(t)))))
    return [r for r in rows if score(r[1]) < corpus_pipeline.TOXIC]


def plain_lines(rows):
    """Lines of each distinct row; the first of every group of lines stays."""
    distinct = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    where = defaultdict(list)
    for k, (_, t) in enumerate(distinct):
        for n, line in enumerate(line_dedup.normalised_lines(t)):
            if line:
                where[line].append((k, n))
    lines, uf = list(where), common.UnionFind()
    for i in range(len(lines)):
        uf.find(i)
        for j in range(i):
            if line_dedup.similar(lines[i], lines[j]):
                uf.union(i, j)
    groups = defaultdict(list)
    for i, x in enumerate(lines):
        groups[uf.find(i)] += where[x]
    drops = {o for g in groups.values() for o in sorted(g)[1:]}
    new = {d: None if d[1] is None else "\n".join(x for n, x in enumerate(d[1].split("\n")) if (k, n) not in drops) for k, d in enumerate(distinct)}
    return [(r[0], new[r[:2]], *r[2:4], None if r[1] is None else len(new[r[:2]])) if r[1] is not None else r for r in rows]


def plain_near(rows, percent=80):
    sets, ids = {}, sorted({r[0] for r in rows if r[0] is not None})
    for r in rows:
        w = common.words_of(r[1])
        sets[r[0]] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    uf = common.UnionFind()
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                uf.union(a, b)
    return [r for r in rows if r[0] is None or uf.find(r[0]) == r[0]]


def common_words(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_leaked(text, items):
    """Whether a window of some item's length holds most of the item's words in order, by trying all windows."""
    words = [w for x in common.words_of(text) if (w := x.strip(toxicity.STRIP))]
    for _, item in items:
        own = [w for x in common.words_of(item) if (w := x.strip(toxicity.STRIP))]
        n = len(own)
        for at in range(len(words) - n + 1):
            part = words[at : at + n]
            if n and (part == own or n >= decontam.MIN_WORDS and len(set(part) & set(own)) >= 0.5 * len(set(own)) and common_words(own, part) >= decontam.LCS_SURE * n):
                return True
    return False


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_each_stage_and_the_whole_equal_brute_force(spark, tables):
    import tiktoken

    rows, _, items = corpus()
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = lambda name, rows: [tuple(r) for r in stages[name](spark, frame(rows), tables).collect()]

    model = toxicity.train(frame(rows), common.table(spark, tables, "labels"))
    one = stage("toxicity", rows)
    assert ordered(one) == ordered(plain_toxic(model, rows))
    gone = {r[0] for r in rows} - {r[0] for r in one}
    assert len(gone - set(range(0, 260, 6))) < 3 and len(gone) > 38
    two = stage("line_dedup", one)
    assert ordered(two) == ordered(plain_lines(one)) and sum(a[1] != b[1] for a, b in zip(ordered(one), ordered(two))) > 20
    three = stage("minhash_near_dedup", two)
    assert ordered(three) == ordered(plain_near(two)) and len(two) - len(three) >= 4
    four = stage("decontamination", three)
    leaked = [r for r in three if plain_leaked(r[1], items)]
    assert ordered(four) == ordered(r for r in three if r not in leaked) and len(leaked) >= 8
    want = Counter()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    for r in four:
        ids = library.encode_ordinary(r[1] or "")
        ends = np.cumsum([0, *[len(library.decode_single_token_bytes(i)) for i in ids]])
        want[r[0], len(ids), hashlib.sha256((r[1] or "").encode()).hexdigest(), np.array(ids, "<u4").tobytes(), ends.astype("<i8").tobytes()] += 1
    key = lambda r: (r["doc_id"], r["n_tokens"], r["decoded_sha256"], bytes(r["ids"]), bytes(r["offsets"]))
    assert Counter(key(r) for r in stages["byte_bpe"](spark, frame(four), tables).collect()) == want
    assert Counter(key(r) for r in corpus_pipeline.run(spark, tables).collect()) == want


def test_stages_with_empty_tables_and_clashing_columns(spark, tables):
    docs = common.table(spark, tables, "documents")
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).collect() == []
        got, plain = stage(spark, more, tables), stage(spark, docs, tables)
        assert ordered(got.select(*plain.columns).collect()) == ordered(plain.collect())
        if name != "byte_bpe":
            assert got.columns == more.columns and plain.columns == docs.columns
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, nothing).count() == docs.count()


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "op8_warc"])
def test_operators_ignore_columns_with_their_own_names(spark, tables, name, monkeypatch):
    docs = common.table(spark, tables, "documents")
    want = ordered(registry.QUERIES[name](spark, tables).collect())
    real = common.table

    def more(spark, folder, table):
        df = real(spark, folder, table)
        return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])

    monkeypatch.setattr(common, "table", more)
    got = registry.QUERIES[name](spark, tables).collect()
    if name in ("op7_lm_scoring",):  # sums of logarithms
        rounded = lambda rows: ordered([*r[:5], round(r[5], 6), round(r[6], 6)] for r in rows)
        assert rounded(got) == rounded(want)
    else:
        assert ordered(got) == want
    if name != "op4_decontamination":
        assert len(want) == docs.count()


def test_decontamination_finds_what_all_windows_find(spark):
    """Paraphrases of 5 to 60 words in long texts against the longest common subsequence of every window: recall at least 0.9."""
    rng = random.Random(23)
    items = [(k, prose(rng, "en", rng.randint(5, 60))) for k in range(40)]
    rows = []
    for k in range(160):
        words = items[k % 40][1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[at] = "other%d" % rng.randrange(99)
            else:
                words.insert(at, "more%d" % rng.randrange(99))
        host = prose(rng, "fr", 900).split()
        at = rng.choice((0, 380, 500, 640, 900, rng.randrange(900)))  # edges of pieces among them
        rows.append((k, " ".join(host[:at] + words + host[at:])))
    want = set()
    for k, text in rows:
        words = common.words_of(text)
        for i, item in items:
            own = common.words_of(item)
            n = len(own)
            for at in range(0, len(words) - n + 1):
                part = words[at : at + n]
                if len(set(part) & set(own)) >= 0.7 * len(set(own)) and common_words(own, part) >= decontam.LCS_SURE * n:
                    want.add((k, i))
                    break
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, benchmark).collect()}
    assert len(want) >= 100 and len(want & got) >= 0.9 * len(want)
    assert sum(i != k % 40 and (k, i) not in want for k, i in got) <= 0.05 * len(got)


def test_short_items_have_to_stand_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "so quorum vexed, zephyr it is"), (2, "quorum zephyr vexed"), (3, "vexed zephyr " * 300 + "quorum vexed zephyr"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quorum vexed zephyr"), (2, "--"), (3, "absent"), (4, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == {(1, 1), (3, 1)}


def test_language_id_equals_a_naive_forward_pass_on_held_out_rows(spark):
    rng = random.Random(24)
    rows = [(k, prose(rng, lang, rng.randint(5, 120)), lang) for k in range(300) for lang in [("en", "fr")[k % 2]]]
    rows += [(1000, "½ ² Ⅷ ① 12", "en"), (1001, "ª", "en"), (1002, None, "fr"), (1003, prose(rng, "fr", 3000), "fr"), (1004, "日本", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = ~common.held_out("doc_id", 3, 1)
    model = langid.train(docs, learn)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).withColumn("held_out", common.held_out("doc_id", 3, 1)).collect()}
    held = [r for r in rows[:300] if got[r[0]]["held_out"]]
    assert len(held) > 60 and sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert {got[i]["lang_pred"] for i in (1000, 1002)} == {"und"} and got[1001]["lang_pred"] != "und"
    net = langid.Network(model.langs)
    net.p = model.p
    for i, text, _ in [*rows[:40], rows[303]]:
        data = text.encode().lower()
        total, weight = 0.0, 0.0
        for at in range(0, len(data), langid.WINDOW):
            window = np.frombuffer(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            own = (window != 0).sum()
            total, weight = total + net.forward(window[None])[3][0] * own, weight + own
        best = int((total / weight).argmax())
        assert got[i]["lang_pred"] == net.langs[best] and got[i]["score"] == pytest.approx(float((total / weight)[best]), abs=1e-4)


def test_large_inputs_take_the_rounds_of_components(spark):
    rng = random.Random(25)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    uf = common.UnionFind()
    for a, b in edges:
        uf.union(a, b)
    numbers = spark.createDataFrame(edges, "a long, b long")
    want = {(x, uf.find(x)) for x in uf.parent if uf.find(x) != x}
    assert {tuple(r) for r in common.components(numbers, few=5).collect()} == want
    digests = numbers.select(*[F.lpad(F.col(c).cast("string"), 4, "0").cast("binary").alias(c) for c in "ab"])
    for few in (5, 200_000):
        assert {(int(a), int(b)) for a, b in common.components(digests, few=few).collect()} == want


def test_near_dedup_is_the_same_for_any_level_of_similarity(spark):
    rows, _, _ = corpus(26)
    rows = [r[:2] for r in rows if r[0] is not None][:-3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in minhash.near_dedup(docs, percent=80, bands=28, height=6).where("kept").collect()}
    assert kept == {r[0] for r in plain_near([(*r, 0, 0, 0) for r in rows])}


def test_ppm_answers_cover_parts_that_are_split(spark, tables, monkeypatch):
    """Small chunks, several parts to a task and read splits within parts give the same scores."""
    docs = common.table(spark, tables, "documents").repartition(7)
    learn = ~common.held_out("doc_id", 10, 0)
    want = ordered((r["doc_id"], round(r["score"], 6)) for r in ppm.score(docs, learn).collect())
    monkeypatch.setattr(ppm, "CHUNK", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert ordered((r["doc_id"], round(r["score"], 6)) for r in ppm.score(docs, learn).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
