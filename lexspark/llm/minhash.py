"""MinHash near-dedup with SuperMinHash signatures (operator 10).

A document is the set of its distinct five-word shingles (the whole sequence if it has fewer words).
SuperMinHash ranks slots by a permutation of each element's own, so that slots are correlated
and of lower variance; elements are handled step by step, and a document stops as soon as
no later step can lower a slot. Bands of slots give buckets; links are confirmed on full sets
and grouped by union-find.

Equal sets are first merged into classes by their digest (an aggregate with map-side
minima). Only one document of a class is banded. Buckets are then worked off in
rounds of a few bands: a bucket whose members already belong to one component is done; in the
others all pairs of different components are compared exactly through an inverted index,
and only the links that join two components are put out, fewer than a bucket has
members. A bucket of over CHUNK members is dealt out as pairs of chunks, so no task ever
holds more than two chunks and no link is lost. Rounds differ in speed only.

Chance to miss a link, that is, to have no band in common: at similarity 0.85 and 24 bands of
7 about 0.0001, and less above.

Nulls: null or empty texts, or texts without words, have no shingle and link with nothing. A null id takes
no part: its component is null and it counts as kept. Rows that repeat an id are one node. Whole
texts of any length are used. Ties go to the smallest id. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

SHINGLE = 5
CHUNK = 800
#: Shingles that are signed together.
ELEMENTS = 60_000
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW32 = np.uint64(0xFFFFFFFF)


def shingles(text: str | None, cache: common.HashCache) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of a whole text."""
    words = common.words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = common.hash_words(words, cache)
    return np.unique(common.ngrams(h, SHINGLE)) if len(h) >= SHINGLE else common.ngrams(h, len(h))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each (nonempty) set: m slots of (step << 32 | rank)."""
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.ravel()
    places = None
    for j in range(m):
        random = common.mix64(h + np.uint64(int(STEP) * (j + 1) & common.MASK64))
        k = j + ((random & LOW32) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if places is None:
            slot = k
        else:
            rows = np.arange(len(h))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
        np.minimum.at(flat, owner * m + slot, np.uint64(j << 32) | random >> np.uint64(32))
        going = sig.max(1) >= np.uint64((j + 1) << 32)  # a later step could still lower a slot
        if not going.any():
            break
        stay = going[owner]
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
            rows = np.arange(len(places))
            places[rows, k[stay]] = 0
        elif not stay.all():
            places = places[stay]
        if not stay.all():
            h, owner = h[stay], owner[stay]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, different for different bands."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(common.mix64(np.arange(1, bands + 1, dtype=np.uint64) * STEP), (len(sig), bands)).copy()
    for c in range(rows):
        key = common.mix64(key * common.PLACE[1] + parts[:, :, c])
    return key.view(np.int64)


def links(ids: list, comps: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Confirmed links between members of different components; fewer than members."""
    uf, out, n = common.UnionFind(), [], len(ids)
    if n == 2:
        a, b = sets
        if comps[0] != comps[1] and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                out.append((ids[0], ids[1]))
        return out
    size = np.fromiter(map(len, sets), np.int64, n)
    end = np.cumsum(size)
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    posting = np.repeat(np.arange(n), size)[np.argsort(inverse, kind="stable")]
    count = np.bincount(inverse)
    at = np.cumsum(count) - count
    roots = len({uf.find(c) for c in comps})
    for i in range(n - 1):
        if roots == 1:
            break
        u = inverse[end[i] - size[i] : end[i]]
        c = count[u]
        where = np.repeat(at[u] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(posting[where], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)).tolist():
            if j > i and uf.union(comps[i], comps[j]):
                roots -= 1
                out.append((ids[i], ids[j]))
    return out


def _sketch(rows: DataFrame, bands: int, height: int) -> DataFrame:
    def run(batches):
        from lexspark.llm import minhash

        cache = common.worker_cache()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            sets, keys = [], [None] * len(ids)
            todo, size = [], 0

            def sign():
                nonlocal todo, size
                if todo:
                    for i, k in zip(todo, minhash.band_keys(minhash.signatures([sets[i] for i in todo], bands * height), bands, height)):
                        keys[i] = k
                    done, todo, size = todo, [], 0
                    for i in done:
                        sets[i] = (len(sets[i]), xxhash.xxh3_128_digest(sets[i].tobytes()))

            for i, t in enumerate(texts):
                s = minhash.shingles(t, cache)
                if not len(s):
                    sets.append((0, None))
                    continue
                if size + len(s) > minhash.ELEMENTS:
                    sign()
                sets.append(s)
                todo.append(i)
                size += len(s)
            sign()
            yield {"id": ids, "n_shingles": [n for n, _ in sets], "digest": [d for _, d in sets], "bands": keys}

    return common.arrow_map(rows, run, "id long, n_shingles long, digest binary, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches):
        from lexspark.llm import minhash

        cache = common.worker_cache()
        for batch in batches:
            found = [minhash.shingles(t, cache).tobytes() for t in batch.column(1).to_pylist()]
            yield {"id": batch.column(0).to_pylist(), "items": found, "digest": [xxhash.xxh3_128_digest(x) for x in found]}

    return common.arrow_map(rows, run, "id long, items binary, digest binary")


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """rows(key, pair, id, comp, items) sorted by key and pair within partitions -> links (a, b)."""

    def run(batches):
        from lexspark.llm import minhash

        now, ids, comps, sets = None, [], [], []
        for batch in batches:
            out = []
            for key, pair, i, c, items in zip(*(x.to_pylist() for x in batch.columns)):
                if (key, pair) != now:
                    if len(set(comps)) > 1:
                        out += minhash.links(ids, comps, sets, percent)
                    now, ids, comps, sets = (key, pair), [], [], []
                ids.append(i)
                comps.append(c)
                sets.append(np.frombuffer(items, np.uint64))
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}
        out = minhash.links(ids, comps, sets, percent) if len(set(comps)) > 1 else []
        yield {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return common.arrow_map(rows, run, "a long, b long")


def near_dedup(docs: DataFrame, percent: int = 85, bands: int = 24, height: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = common.materialize(_sketch(texts, bands, height), "sketch")
    known = sketch.where("id is not null and digest is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("x")).select("digest", F.col("x.id").alias("rep"), F.col("x.bands").alias("bands"))
    classes = common.materialize(classes, "classes")
    cells = classes.select("rep", "digest", F.posexplode("bands").alias("band", "key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cells = common.materialize(cells.join(shared, "key"), "cells")
    wanted = common.materialize(cells.select(F.col("rep").alias("id"), F.col("digest").alias("_digest")).distinct(), "wanted")
    sets = _sets(texts.join(wanted.select("id").distinct(), "id", "left_semi"))
    sets = sets.join(wanted, (sets["id"] == wanted["id"]) & (sets["digest"] == wanted["_digest"]), "left_semi").dropDuplicates(["id", "digest"])
    sets = common.materialize(sets, "sets")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    edges = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "a long, b long")
    start = 0
    for width in (2, 6, bands):
        part = cells.where((F.col("band") >= start) & (F.col("band") < start + width))
        start += width
        part = part.join(comps.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        part = common.materialize(part.select("key", "n", "rep", "digest", "comp"), "part")
        open_ = part.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
        todo = part.join(open_, "key")
        # Large buckets: a member goes to all pairs of chunks that hold its own.
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
        todo = todo.withColumn("other", F.explode(F.when(chunks <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))))
        todo = todo.withColumn("pair", F.least(own, "other") * 100_000 + F.greatest(own, F.col("other")))
        todo = todo.withColumnRenamed("rep", "id").join(sets, ["id", "digest"]).select("key", "pair", "id", "comp", "items")
        todo = todo.repartition(max(partitions, 24), "key", "pair").sortWithinPartitions("key", "pair", "id")
        found = common.materialize(_compare(todo, percent), "links")
        common.discard(part)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            comps = common.components(edges)
        if start >= bands:
            break
    common.discard(sets)
    of = classes.select("digest", "rep").join(comps.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("digest", F.coalesce("root", "rep").alias("comp"))
    of = common.materialize(of, "of")
    out = sketch.select("id", "n_shingles", "digest").join(of, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("id")).when(F.col("id").isNotNull(), F.col("comp"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
