"""Benchmark decontamination by latent semantic retrieval (operator 4).

Words are hashed (WORD_BITS for identity, DIMS for features). Over all passages of PASSAGE words of
all documents document frequencies are counted, then the matrix A of their normalised TF-IDF
rows is decomposed by a randomised SVD in one pass: tasks add up their part of A'(A*Omega), whose
sum gives the leading right singular vectors by the Nystroem formula. Documents are then searched: windows
of about an item's length are projected and whitened (divided by singular values, which
takes the weight from what all texts of a language share) and put in order by their cosine with the items that can
be there at all, most alike first; none is left out for a low cosine. As to what can be there: since a match misses at most 1 - LCS_LEAST of an item's words, some of its rarest ones have
to occur in the piece of text, which postings of those words tell without loss. A window is confirmed by the longest common subsequence of words: LCS_SURE of the item's
words, or LCS_LEAST of them along with ANSWER_LEAST of the answer's, so that paraphrases count if they give the answer away. For items
without an answer the last ANSWER_SHARE of the item stands for it, or else RUN of the item's words in an unbroken run, wherever
they are in it: LCS_LEAST alone is met by chance in texts of few different words. In items of fewer than LONG words,
of which three or four in order stand in many texts, only LCS_SURE counts.

Items of fewer than MIN_WORDS words, which are no passages, are found where all their words stand in a row.

Items are taken in blocks of BLOCK_ITEMS, each with its own map pass, so that what is
broadcast is bounded: DIMS x RANK floats, and a block's vectors and words. Items of over PASSAGE words are
searched by their parts. Partial sums, in fixed point so that their order doesn't matter, meet by feature block, not on the driver, which gets
DIMS x (RANK + EXTRA) numbers whatever the input.

Nulls: documents with null or empty text and items without words match
nothing; null ids are returned as they are. Repeated rows are matched each. Very long
texts are searched whole, in pieces that overlap. Empty tables give an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common
from lexspark.llm.toxicity import STRIP

DIMS, RANK, EXTRA, PASSAGE = 8192, 24, 8, 64
BLOCK_ITEMS, MIN_WORDS = 20_000, 5
#: Partial sums are whole numbers of 1 / FIXED.
FIXED = 1 << 24
LCS_SURE, LCS_LEAST, ANSWER_LEAST, ANSWER_SHARE = 0.8, 0.6, 0.6, 0.25
RUN, LONG = 5, 10
#: Words that are searched at a time, blocks of which windows are made, and bits by which words are looked up.
PIECE, STEP, LOOKUP = 512, 8, 20
#: Windows in words and the longest item for each.
WINDOWS = tuple((n, n) for n in range(8, PASSAGE + 1, 8))


def least(n: int) -> float:
    """How many of an item's n words a text has to hold in order at least."""
    return (LCS_LEAST if n >= LONG else LCS_SURE) * n - 1e-9


def word_ids(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, without signs around them."""
    h, count = common.word_hashes(texts, STRIP)
    return np.split((h >> np.uint64(32)).astype(np.uint32), np.cumsum(count)[:-1]) if texts else []


def entries(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (passages, ascending), features and counts of the distinct words in passages of some documents."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    if not size.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    per = -(-size // PASSAGE)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.cumsum(per) - per, size) + within // PASSAGE
    key = row * DIMS + (np.concatenate(docs) % DIMS)
    key, count = np.unique(key.astype(np.int32) if key[-1] < (1 << 31) - DIMS else key, return_counts=True)
    return key // DIMS, key % DIMS, count.astype(np.float32)


def groups_of(docs: list[np.ndarray], most: int = 150_000):
    """Consecutive documents of together at least as many words (fewer at the end)."""
    part, size = [], 0
    for d in docs:
        part.append(d)
        size += len(d)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def partial_product(docs: list[np.ndarray], idf: np.ndarray, omega: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A omega) of the passages of some documents to total."""
    row, col, value = entries(docs)
    if not len(row):
        return
    value = value * idf[col]
    value /= np.maximum(np.sqrt(np.bincount(row, value * value)), 1e-9)[row].astype(np.float32)
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    y = np.add.reduceat(omega[col] * value[:, None], head, axis=0)
    order = np.argsort(col.astype(np.int16), kind="stable")
    place = np.cumsum(np.append(False, row[1:] != row[:-1]))[order]
    col, value = col[order], value[order]
    head = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    total[col[head]] += np.add.reduceat(y[place] * value[:, None], head, axis=0)


def nystroem(product: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors of A'A and singular values of A, from A'A omega."""
    shift = 1e-6 * max(float(np.linalg.norm(product)), 1e-12)
    moved = product + shift * omega
    inner = omega.T @ moved
    inner = (inner + inner.T) / 2
    value, vector = np.linalg.eigh(inner)
    keep = value > value.max() * 1e-10
    root = vector[:, keep] / np.sqrt(value[keep])
    u, s, _ = np.linalg.svd(moved @ root, full_matrices=False)
    sigma = np.sqrt(np.maximum(s**2 - shift, 0))
    keep = np.flatnonzero(sigma > 1e-6 * max(sigma.max(initial=0), 1e-30))[:rank]
    return u[:, keep], sigma[keep]


def latent_model(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """DIMS x RANK projection of words(words: binary of uint32): idf times whitened singular vectors; and idf."""
    spark = words.sparkSession

    def frequencies(batches):
        from lexspark.llm import decontam as own

        df, passages = np.zeros(own.DIMS, np.int64), 0
        for batch in batches:
            row, col, _ = own.entries([np.frombuffer(b, np.uint32) for b in batch.column(0).to_pylist()])
            df += np.bincount(col, minlength=own.DIMS)
            passages += len(np.unique(row))
        used = np.flatnonzero(df)
        yield {"f": [-1, *used.tolist()], "n": [passages, *df[used].tolist()]}

    found = {r["f"]: r["n"] for r in common.arrow_map(words.select("words"), frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator()}
    passages = found.pop(-1, 0)
    idf = np.zeros(DIMS, np.float32)
    for f, n in found.items():
        idf[f] = np.log((passages + 1) / n)
    omega = np.random.default_rng(11).standard_normal((DIMS, RANK + EXTRA)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, omega))
    parts = 64

    def product(batches):
        from lexspark.llm import decontam as own

        idf, omega = shared.value
        total = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for part in own.groups_of([np.frombuffer(b, np.uint32) for b in batch.column(0).to_pylist()]):
                own.partial_product(part, idf, omega, total)
        step = own.DIMS // parts
        total = np.rint(total * own.FIXED).astype(np.int64)
        yield {"part": list(range(parts)), "x": [total[i * step : (i + 1) * step].tobytes() for i in range(parts)]}

    def add(batches):
        sums = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield {"part": list(sums), "x": [v.tobytes() for v in sums.values()]}

    sums = common.arrow_map(common.arrow_map(words.select("words"), product, "part int, x binary").repartition(parts, "part"), add, "part int, x binary")
    total = np.zeros((parts, DIMS // parts, RANK + EXTRA))
    for r in sums.toLocalIterator():
        total[r["part"]] = np.frombuffer(r["x"], np.int64).reshape(total.shape[1:]) / FIXED
    vectors, sigma = nystroem(total.reshape(DIMS, -1), omega.astype(np.float64), RANK)
    return (idf[:, None] * vectors / np.maximum(sigma, 1e-12)).astype(np.float32), idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Longest common subsequence of a sequence given by its bit masks, and words."""
    full = (1 << length) - 1
    v = full
    for m in filter(None, map(masks.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def has_run(masks: dict[int, int], words: list[int], least: int = RUN) -> bool:
    """Whether as many words in a row are in a sequence given by its bit masks too."""
    ends = [0] * least
    for w in words:
        m = masks.get(w, 0)
        ends = [m, *[(e << 1) & m for e in ends[:-1]]]
        if ends[-1]:
            return True
    return False


def bit_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Gate:
    """Postings of some of the words of each part, and how many of those any match has to hold."""

    def __init__(self, words: list[np.ndarray], need: list[int]):
        self.need = np.array(need, np.int64)
        word = np.concatenate(words) if words else np.empty(0, np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        order = np.argsort(word, kind="stable")
        self.owner = owner[order]
        self.words, self.first, self.count = np.unique(word[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << LOOKUP, bool)
        self.known[self.words & ((1 << LOOKUP) - 1)] = True

    def passed(self, words: np.ndarray, piece: np.ndarray, pieces: int) -> np.ndarray:
        """Boolean (piece, part): enough words of the part occur in the piece; piece: the number of each word's piece."""
        keep = self.known[words & ((1 << LOOKUP) - 1)]
        words, piece = words[keep], piece[keep]
        if not len(words):
            return np.zeros((pieces, len(self.need)), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        keep = self.words[at] == words
        key = np.unique(piece[keep] * len(self.words) + at[keep])
        piece, at = key // len(self.words), key % len(self.words)
        count = self.count[at]
        where = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found = np.bincount(np.repeat(piece, count) * len(self.need) + self.owner[where], minlength=pieces * len(self.need))
        return found.reshape(pieces, -1) >= self.need


class Items:
    """Parts of benchmark items, by window size, ready for search."""

    def __init__(self, items: list[tuple], projection: np.ndarray, idf: np.ndarray):
        """items: (item_id, word ids, answer's word ids or None)"""
        self.sets, self.checks = [], {}
        self.short = {}
        for i, w, _ in items:
            if 0 < len(w) < MIN_WORDS:
                self.short.setdefault(int(w[0]), []).append((i, w.tolist()))
        self.first = np.array(sorted(self.short), np.uint32)
        parts = [(i, w[k : k + PASSAGE], a, w) for i, w, a in items if len(w) >= MIN_WORDS for k in range(0, max(1, len(w) - MIN_WORDS), PASSAGE)]
        shortest, ranked, missed = 0, [], []
        for window, longest in WINDOWS:
            own = [p for p in parts if shortest < len(p[1]) <= longest]
            shortest = longest
            for p in own:
                words = np.unique(p[1])
                ranked.append(words[np.argsort(-idf[words % DIMS], kind="stable")])
                missed.append(int(len(p[1]) - least(len(p[1]))))
            vectors = np.array([projection[p[1] % DIMS].sum(0) for p in own], np.float32).reshape(len(own), projection.shape[1])
            self.sets.append((window, unit(vectors), own))
        few = [w[: m + max(2, len(w) // 4)] for w, m in zip(ranked, missed)]
        self.rare = Gate(few, [len(w) - m for w, m in zip(few, missed)])
        self.all = Gate(ranked, [len(w) - m for w, m in zip(ranked, missed)])

    def possible(self, pieces: list[np.ndarray]) -> dict[int, np.ndarray]:
        """By number of piece the parts that it can hold: enough of their rarest words, and of all, occur in it."""
        if not pieces or not len(self.rare.need):
            return {}
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        words, piece = np.concatenate(pieces), np.repeat(np.arange(len(pieces)), size)
        rare = self.rare.passed(words, piece, len(pieces))
        some = rare.any(1)
        number = np.cumsum(some) - 1
        keep = some[piece]
        both = rare[some] & self.all.passed(words[keep], number[piece[keep]], int(some.sum()))
        return {int(i): np.flatnonzero(row) for i, row in zip(np.flatnonzero(some), both) if row.any()}

    def check(self, part: tuple):
        if id(part) not in self.checks:
            _, words, answer, whole = part
            words = words.tolist()
            given = answer is not None and len(answer) > 0
            if not given:
                answer = whole[-max(1, round(len(whole) * ANSWER_SHARE)) :]
            answer = [int(x) for x in answer]
            self.checks[id(part)] = (bit_masks(words), len(words), bit_masks(answer), len(answer), given)
        return self.checks[id(part)]

    def confirm(self, part: tuple, region: list[int], there: set) -> tuple[float, float] | None:
        """Shares of item and answer that the region holds in order, if they are enough; there: the region as a set."""
        masks, n, answer_masks, m, given = self.check(part)
        # Of a subsequence of least(n) words at most n - len(masks) repeat one that is in it.
        if len(masks.keys() & there) < least(n) - (n - len(masks)):
            return None
        found = lcs(masks, n, region)
        if found < least(n):
            return None
        share = found / n
        answer = lcs(answer_masks, m, region) / m
        return (share, answer) if share >= LCS_SURE - 1e-9 or answer >= ANSWER_LEAST or not given and has_run(masks, region) else None

    def phrases(self, words: np.ndarray) -> dict:
        """Items of few words that stand in the words as a whole."""
        out: dict = {}
        if len(self.first):
            for at in np.flatnonzero(np.isin(words, self.first)).tolist():
                for item, own in self.short[int(words[at])]:
                    if item not in out and words[at : at + len(own)].tolist() == own:
                        out[item] = (1.0, 1.0, 1.0)
        return out

    def search(self, docs: list[np.ndarray], projection: np.ndarray) -> list[dict]:
        """For each document, item_id -> (cosine, share of the item, share of the answer) of a confirmed window."""
        out: list[dict] = [self.phrases(words) for words in docs]
        owner, pieces = [], []
        for d, words in enumerate(docs):
            for start in range(0, max(1, len(words) - 2 * PASSAGE), PIECE - 2 * PASSAGE):
                owner.append(d)
                pieces.append(words[start : start + PIECE])
        for i, possible in self.possible(pieces).items():
            piece, found = pieces[i], out[owner[i]]
            # What no window of the piece can hold, as the piece itself doesn't.
            whole, before, held = piece.tolist(), 0, []
            for window, vectors, parts in self.sets:
                some = (possible[(possible >= before) & (possible < before + len(parts))] - before).tolist()
                before += len(parts)
                some = [p for p in some if parts[p][0] not in found and lcs(*self.check(parts[p])[:2], whole) >= least(len(parts[p][1]))]
                if some:
                    held.append((window, vectors[some], [parts[p] for p in some]))
            if not held:
                continue
            heads = np.arange(0, len(piece), STEP)
            sums = np.add.reduceat(projection[piece % DIMS], heads, axis=0)
            total = np.concatenate([np.zeros((1, sums.shape[1]), np.float64), np.cumsum(sums, axis=0, dtype=np.float64)])
            for window, vectors, parts in held:
                span = window // STEP
                first = np.arange(max(1, len(heads) - span + 1))
                z = unit((total[np.minimum(first + span, len(heads))] - total[first]).astype(np.float32))
                cosine = z @ vectors.T
                regions: dict[int, tuple] = {}
                for k, part in enumerate(parts):
                    if part[0] in found:
                        continue
                    for at in np.argsort(-cosine[:, k], kind="stable").tolist():
                        a = int(first[at]) * STEP
                        if a not in regions:
                            region = piece[max(0, a - window // 2) : a + window + window // 2].tolist()
                            regions[a] = (region, set(region))
                        ok = self.confirm(part, *regions[a])
                        if ok:
                            found[part[0]] = (float(cosine[at, k]), *ok)
                            break
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): confirmed leaks of items into documents."""
    spark = docs.sparkSession
    common.prepare(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def tokens(batches):
        from lexspark.llm import decontam as own

        for batch in batches:
            yield {"id": batch.column(0).to_pylist(), "words": [w.tobytes() for w in own.word_ids(batch.column(1).to_pylist())]}

    words = common.materialize(common.arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokens, f"id {kind}, words binary"), "words")
    model = spark.sparkContext.broadcast(latent_model(words))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), answer.alias("answer")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item", "text"), blocks)

    def pass_over(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches):
            from lexspark.llm import decontam as own

            projection, idf = model.value
            index = own.Items(shared.value, projection, idf)
            names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"]
            for batch in batches:
                out = {k: [] for k in names}
                words = [np.frombuffer(w, np.uint32) for w in batch.column(1).to_pylist()]
                found = [x for part in own.groups_of(words) for x in index.search(part, projection)]
                for i, items in zip(batch.column(0).to_pylist(), found):
                    for item, values in items.items():
                        for k, v in zip(names, (i, item, *values)):
                            out[k].append(v)
                yield out

        return common.arrow_map(words, run, f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double")

    out = None
    for b in range(blocks):
        found = items.where(block == b).collect()
        words_of, answers = word_ids([r["text"] for r in found]), word_ids([r["answer"] for r in found])
        rows = [(r["item"], w, None if r["answer"] is None else a) for r, w, a in zip(found, words_of, answers)]
        part = pass_over(rows)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those into which an item leaked; rows with a null id stay only if their text is clean too."""
    found = common.materialize(leaks(docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc_id", F.to_json("doc_id")), benchmark), "leaks")
    key = F.to_json(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")))
    (name,) = common.free_names(docs, "gone")
    gone = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, key == F.col(name), "left_anti")
