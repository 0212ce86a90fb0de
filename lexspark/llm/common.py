"""Helpers shared by the text operators: shared storage, hashing, tokens, grouping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def prepare(spark: SparkSession) -> None:
    """Send this package to Python workers once a session."""
    jvm = spark.sparkContext._jvm
    if jvm.System.getProperty("lexspark.shipped") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "lexspark_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lexspark", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    jvm.System.setProperty("lexspark.shipped", spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one, which only a local master may use."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        jvm, name = spark.sparkContext._jvm, "lexspark.folder." + spark.sparkContext.applicationId
        at = jvm.System.getProperty(name)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="lexspark-")
            jvm.System.setProperty(name, at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lexspark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_lexspark_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with at least one in HOT of all rows is broadcast.
HOT = 2000


def split_join(rows: DataFrame, keyed: DataFrame, key: list[str], size: str, total: int, how: str) -> DataFrame:
    """rows joined (inner or left_semi) with keyed(*key, size, ...), a row for each key, of which `size` are in rows.

    Hot keys, never more than HOT, meet their rows by broadcast; the others by a shuffle. total: number of rows.
    """
    hot = F.broadcast(keyed.where(F.col(size) * HOT >= total))
    few = keyed.where(F.col(size) * HOT < total)
    return rows.join(hot, key, how).unionByName(rows.join(hot, key, "left_anti").join(few, key, how))


def held_out(column: str, mod: int, rest: int):
    """crc32 of the id's decimal text, modulo mod, equals rest. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == rest


class HashCache(dict):
    """bytes -> 64-bit hash, remembering at most `limit` keys."""

    def __init__(self, seed: int = 0, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, key):
        value = xxhash.xxh64_intdigest(key, self.seed)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


_caches: dict = {}


def worker_cache(kind=HashCache) -> HashCache:
    """The cache of this kind that a worker process keeps from task to task."""
    if kind not in _caches:
        _caches[kind] = kind()
    return _caches[kind]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words: runs without \\x20 and \\x09-\\x0D (bytes.split and bytes.lower are ASCII-only)."""
    return (text or "").encode("utf-8").lower().split()


def hash_words(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A number for each byte; a run of bytes is the sum of theirs times powers of BASE, so that any run comes from running sums.
BYTES = mix64(np.arange(1001, 1257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
_powers: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and the inverses of these, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        one = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20) - 1, x, np.uint64)]), dtype=np.uint64)
        _powers[:] = [one(np.uint64(BASE)), one(np.uint64(pow(BASE, -1, 1 << 64)))]
    return _powers[0][:n], _powers[1][:n]


def run_hashes(a: np.ndarray):
    """A function from arrays of places (first, stop) to 64-bit hashes of those runs of the bytes a; equal runs have equal hashes."""
    up, down = powers(max(len(a), 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[a] * up[: len(a)], dtype=np.uint64)])
    return lambda first, stop: mix64((sums[stop] - sums[first]) * down[first])


#: Bytes of text that word_hashes() takes at a time.
SPAN = 1 << 19
_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _pieces(texts: list[bytes]):
    """(number of the text, bytes) in order: texts, long ones cut behind white space."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > 2 * SPAN:
            stop = max(t.rfind(b" ", at, at + SPAN), t.rfind(b"\n", at, at + SPAN)) + 1 or next((k + 1 for k in range(at + SPAN, len(t)) if _GAP[t[k]]), len(t))
            yield i, t[at:stop]
            at = stop
        yield i, t[at:] if at else t


def word_hashes(texts: list[str | None], strip: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z lower-cased words of all texts in a row, without the signs `strip` around them, and how many each text has.

    Words of such signs alone are left out. All of a span's words are hashed at once, without a Python object for any of them.
    """
    core = ~(_GAP | np.isin(np.arange(256), list(strip)))
    counts, out = np.zeros(len(texts), np.int64), [np.empty(0, np.uint64)]

    def hashed(part: list[tuple[int, bytes]]):
        a = np.frombuffer(b" ".join([t for _, t in part]), np.uint8)
        end = np.cumsum([len(t) + 1 for _, t in part])
        inside = np.concatenate([[False], ~_GAP[a], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, stop = edge[::2], edge[1::2]
        if strip:
            there = core[a]
            solid, before = np.flatnonzero(there), np.concatenate([[0], np.cumsum(there, dtype=np.int32)])
            lo, hi = before[first], before[stop]
            keep = hi > lo
            first, stop = solid[lo[keep]], solid[hi[keep] - 1] + 1
        out.append(run_hashes(a)(first, stop))
        np.add.at(counts, np.array([i for i, _ in part]), np.diff(np.searchsorted(first, np.concatenate([[0], end]))))

    part, size = [], 0
    for i, t in _pieces([(t or "").encode("utf-8").lower() for t in texts]):
        part.append((i, t))
        size += len(t)
        if size >= SPAN:
            hashed(part)
            part, size = [], 0
    if part:
        hashed(part)
    return np.concatenate(out), counts


#: Odd multipliers that keep the place of a word within an n-gram.
PLACE = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of hashed words, in order."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out += mix64(h[i : i + k] + PLACE[i]) * PLACE[i]
    return mix64(out)


#: Rows that a function over Arrow batches gets at a time, whatever the session's batches.
BATCH_ROWS = 512


def sliced(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over row dicts of lists: fn(iterator of RecordBatch) yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    packed = arrow.serialize().to_pybytes()

    def run(batches):
        target = pa.ipc.read_schema(pa.py_buffer(packed))
        for columns in fn(sliced(batches)):
            arrays = [x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


class UnionFind:
    """Over hashable items; the root of a set is its smallest item."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _forest(batches):
    """Union-find over a task's edges, flushed when it holds many nodes: the same connectivity with fewer edges."""
    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
        if len(uf.parent) > 500_000:
            yield _edges(uf)
            uf = UnionFind()
    yield _edges(uf)


def _edges(uf):
    pairs = [(x, uf.find(x)) for x in list(uf.parent)]
    pairs = [(x, r) for x, r in pairs if x != r]
    return {"a": [x for x, _ in pairs], "b": [r for _, r in pairs]}


def _whole_forest(batches):
    """Union-find over all edges that this one task gets."""
    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
    yield _edges(uf)


#: Up to as many edges (16 bytes each) are grouped by one task.
FEW_EDGES = 200_000


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges(a, b), long or binary: rows (a, b) give each linked node but the smallest its smallest member.

    Union-find shrinks each task's edges to a forest. If no more than `few` are left, one task ends the
    work by union-find. Otherwise alternating large-star and small-star rounds merge across tasks until
    there are only stars. A round pre-aggregates minima before its shuffle and joins edges to
    them (which adaptive execution can split), so that a hub is never gathered in one task.
    """
    schema = "a {0}, b {0}".format(edges.schema["a"].dataType.simpleString())
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(arrow_map(e, _forest, schema), "edges")
    if e.count() <= few:
        out = materialize(arrow_map(e.coalesce(1), _whole_forest, schema), "roots")
        discard(e)
        return out
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        nxt = materialize(nxt.distinct(), "edges")
        discard(e)
        e = nxt
        inner = e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi")
        if inner.isEmpty() and e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return e
