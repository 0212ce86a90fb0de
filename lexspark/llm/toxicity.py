"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 1).

Features of a text are the hashes, to 32 bits, of its words, of pairs of neighbours and of
pairs with one word between (present or not). One task fits per-coordinate
FTRL on a bounded sample of labelled rows (those of smallest md5 of their id: SAMPLE_ROWS at most, and
SAMPLE_BYTES of text at most), in EPOCHS passes; L1, stated per example seen, leaves few nonzero weights. All of these are
broadcast, 12 bytes each; the sample bounds them. Scoring is one map over all documents without a shuffle.

Nulls: null or empty texts have no features and get the score of the bias alone; labels that are
null are not used; a null id hashes as ''. If an id is labelled more than once, any toxic
label counts. Repeated documents are scored each. With no usable label of both kinds the score is
the share of toxic labels (0 if there is none). Whole texts of any length are used, in
pieces of a bounded number of words. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import common

SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 256 << 20
#: A feature has to occur in as many texts of the sample.
MIN_TEXTS = 3
#: L1 for each example seen, and at all in the second fit, over the features that the first has kept.
EPOCHS, ALPHA, BETA, L1, REFIT_L1, L2 = 8, 1.0, 1.0, 0.001, 0.1, 0.01
PIECE_WORDS = 200_000
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_~`"


class WordCache(common.HashCache):
    """Hashes words without the signs around them; words of signs alone are 0."""

    def __missing__(self, key):
        bare = key.strip(STRIP)
        value = common.xxhash.xxh64_intdigest(bare) if bare else 0
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def features(text: str | None, cache: WordCache) -> np.ndarray:
    """Distinct 32-bit features of a whole text, ascending. Words of signs alone go before it is cut into pieces."""
    all_ = common.hash_words(common.words_of(text), cache)
    all_ = all_[all_ != 0]
    parts = []
    for i in range(0, len(all_), PIECE_WORDS):
        h = all_[i : i + PIECE_WORDS + 2]
        found = [h[:PIECE_WORDS], common.ngrams(h, 2)]
        if len(h) > 2:
            found.append(common.mix64(common.mix64(h[:-2] + common.PLACE[5]) * common.PLACE[6] + h[2:]))
        parts.append(np.unique((np.concatenate(found) >> np.uint64(32)).astype(np.uint32)))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


def _ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, l1: float, passes: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of FTRL-proximal with per-coordinate rates, and the bias, over shuffled rows of feature numbers."""
    z, n = np.zeros(size), np.zeros(size)
    bias, bias_n = float(np.log(y.mean() / (1 - y.mean()))), 1.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    return weights(z, n), bias


def places(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where in keys (ascending) those of the values are that occur there."""
    if not len(keys):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at[keys[at] == values]


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features with nonzero weights, those weights, and the bias."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.empty(0, np.uint32), np.empty(0, np.float64), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    keys, counts = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[counts >= MIN_TEXTS]
    rows = [places(keys, r) for r in rows]
    w, _ = _ftrl(rows, y, len(keys), L1 * EPOCHS * len(rows), EPOCHS, seed)  # gradients add up over examples
    # L1 also shrinks what it keeps: the features kept are fitted again with little of it.
    kept = np.flatnonzero(w)
    keys, rows = keys[kept], [places(kept, r) for r in rows]
    w, bias = _ftrl(rows, y, len(keys), REFIT_L1, EPOCHS, seed + 1)
    used = np.flatnonzero(w)
    return keys[used], w[used], bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn=None):
    """Fit on the sample, in one task; learn: column over docs that is true for rows that may be learnt from."""
    common.prepare(docs.sparkSession)
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (~common.held_out(id_col, 3, 1) if learn is None else learn))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
        .orderBy(F.md5(F.col("id").cast("string")), "id")
        .limit(SAMPLE_ROWS)
    )

    def sketch(batches):
        from lexspark.llm import toxicity

        cache = common.worker_cache(toxicity.WordCache)
        for batch in batches:
            y, order, texts = (c.to_pylist() for c in batch.columns)
            yield {"y": y, "order": order, "size": [len((t or "").encode()) for t in texts], "f": [toxicity.features(t, cache).tobytes() for t in texts]}

    def learn_all(batches):
        from lexspark.llm import toxicity

        y, rows = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            rows += [np.frombuffer(b, np.uint32) for b in batch.column(1).to_pylist()]
        order = sorted(range(len(y)), key=lambda i: (y[i], rows[i].tobytes()))  # whatever the order of arrival
        keys, w, bias = toxicity.fit([rows[i] for i in order], np.array([y[i] for i in order], np.float64))
        yield {"k": [keys.tobytes()], "w": [w.tobytes()], "b": [bias]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("y", F.md5(F.col("id").cast("string")).alias("order"), "text")
    rows = common.materialize(common.arrow_map(rows, sketch, "y int, order string, size long, f binary"), "sample")
    # Rows in order of their md5 as long as their texts stay under SAMPLE_BYTES: sizes and digests of at most SAMPLE_ROWS ids are summed up.
    upto = rows.groupBy("order").agg(F.sum("size").alias("size")).withColumn("sum", F.sum("size").over(Window.orderBy("order"))).where(F.col("sum") <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(upto.select("order")), "order", "left_semi").select("y", "f")
    found = common.arrow_map(rows.repartition(1), learn_all, "k binary, w binary, b double").first()
    if found is None:  # a sample without any row
        return fit([], np.empty(0))
    return np.frombuffer(found["k"], np.uint32), np.frombuffer(found["w"], np.float64), found["b"]


class Scorer:
    def __init__(self, model):
        self.keys, self.weights, self.bias = model
        self.near = np.zeros(1 << 20, bool)  # whether a feature with these low bits has a weight
        self.near[self.keys & np.uint32(0xFFFFF)] = True
        self.cache = common.worker_cache(WordCache)

    def score(self, text: str | None) -> float:
        f = features(text, self.cache)
        f = f[self.near[f & np.uint32(0xFFFFF)]]
        total = self.bias
        if len(f) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            total += float(self.weights[at[self.keys[at] == f]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(doc_id, score), or the columns `keep` of docs and the score; name: of the score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) if keep is None else docs.select(*keep, F.col(text_col).alias(common.free_names(docs, "text")[0]))
    width = len(rows.columns) - 1

    def run(batches):
        import pyarrow as pa

        from lexspark.llm import toxicity

        scorer = toxicity.Scorer(shared.value)
        for batch in common.sliced(batches):
            scores = pa.array([scorer.score(t) for t in batch.column(width).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], scores], names=[*batch.schema.names[:width], name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:width], StructField(name, DoubleType())]))
