"""Token counts by a map-side two-tier lookup (operator 9).

Tier one is a compact open-addressing hash table, broadcast, of the lengths (numbers of
tokens) of frequent pre-tokens of up to seven bytes: a pre-token's bytes are its key, so that
a hit is exact, and whole batches are looked up in numpy. Misses are encoded once per worker and
remembered in a bounded cache. Nothing is shuffled. The table only saves time: it is filled
from a bounded sample (SAMPLE_ROWS, SAMPLE_BYTES), and counts do not depend on what is in it.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Whole texts of any length are
counted. Repeated rows are counted each. An empty table gives an empty result; other columns
are ignored, whatever their names. Added special tokens inside a text count as one token each.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import bpe, common, pretoken

#: Texts of which frequent pre-tokens are taken and their greatest length, and slots of the table (12 bytes each).
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 1 << 15
SLOTS = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts tokens of pre-tokens by the ordered merges of a tokenizer's JSON file."""

    def __init__(self, source: str, limit: int = 200_000):
        model = json.loads(source)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.cache: dict[bytes, int] = {}
        self.limit = limit

    def length(self, piece: bytes) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self._merge(piece)
            if len(piece) <= 64:
                if len(self.cache) >= self.limit:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def _merge(self, piece: bytes) -> int:
        import heapq

        n, count, ranks = len(piece), len(piece), self.ranks
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        part = lambda i: piece[i : right[i]]
        heap = []

        def offer(i):
            j = right[i]
            if j < n and (r := ranks.get((part(i), part(j)))) is not None:
                heapq.heappush(heap, (r, i, j, right[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or right[i] != j or j >= n or not alive[j] or right[j] != end:
                continue
            alive[j] = False
            right[i] = end
            count -= 1
            if end < n:
                left[end] = i
                offer(i)
            if left[i] >= 0:
                offer(left[i])
        return count

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between added special tokens, and how many of those there are."""
        parts, found = [text], 0
        for token in self.special:
            if token in text:
                parts = [p for x in parts for p in x.split(token)]
        found = len(parts) - 1
        return [p for p in parts if p], found


class FrequentLengths:
    """Open addressing with linear probing over uint64 keys; key 0 marks a free slot."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        bits = SLOTS.bit_length() - 1
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.probes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint16), 1
        for key, value in zip(keys, lengths):
            slot, tries = (int(key) * int(MULTIPLIER) & common.MASK64) >> int(self.shift), 1
            while self.keys[slot]:
                slot, tries = (slot + 1) % SLOTS, tries + 1
            self.keys[slot], self.values[slot] = key, value
            self.probes = max(self.probes, tries)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The length of each key, 0 where it isn't here."""
        slot = ((keys * MULTIPLIER) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.values[slot], 0)
        left = np.flatnonzero((out == 0) & (self.keys[slot] != 0) & (keys != 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            at = (slot[left] + k) % SLOTS
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (self.keys[at] != 0)]
        return out


def short_keys(data: bytes, at: np.ndarray) -> np.ndarray:
    """For slices of 1 to 7 bytes their bytes and length in one integer; 0 for longer ones."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    view = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)
    size = np.diff(at)
    short = np.minimum(size, 7).astype(np.uint64)
    keys = view[at[:-1]] & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)) | short << np.uint64(56)
    keys[size > 7] = 0
    return keys


def count_texts(texts: list[str], merger: Merger, frequent: FrequentLengths | None) -> np.ndarray:
    segments, owner, special = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts, special[i] = merger.segments(t)
        segments += parts
        owner += [i] * len(parts)
    data, at, counts = pretoken.slices(segments)
    if len(at) < 2:
        return special
    if frequent is None:
        sizes = np.zeros(len(at) - 1, np.int64)
    else:
        sizes = frequent.get(short_keys(data, at)).astype(np.int64)
    missing = np.flatnonzero(sizes == 0)
    length, cache = merger.length, merger.cache
    for i, a, b in zip(missing.tolist(), at[missing].tolist(), at[missing + 1].tolist()):
        piece = data[a:b]
        sizes[i] = cache.get(piece) or length(piece)
    of = np.repeat(np.array(owner, np.int64), counts)
    return special + np.bincount(of, sizes, len(texts)).astype(np.int64)


_mergers: dict[str, Merger] = {}


def merger_of(name: str) -> Merger:
    if name not in _mergers:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _mergers[name] = Merger(f.read())
    return _mergers[name]


def frequent_lengths(docs: DataFrame, merger: Merger, text_col: str) -> FrequentLengths:
    """The table from the pre-tokens of at most SAMPLE_ROWS texts of up to SAMPLE_BYTES, most frequent first, half full at most.

    collect() on a limit reads partitions until there are enough rows, not all of them. Which texts they are matters for speed only.
    """
    seen: Counter = Counter()
    for row in docs.select(F.col(text_col).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).limit(SAMPLE_ROWS).collect():
        data, at, _ = pretoken.slices(merger.segments(row["t"])[0])
        seen.update(short_keys(data, at).tolist())
    seen.pop(0, None)
    keys = [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: SLOTS // 2]]
    lengths = [merger.length((k & ((1 << 56) - 1)).to_bytes(8, "little")[: k >> 56]) for k in keys]
    return FrequentLengths(np.array(keys, np.uint64), np.array(lengths, np.uint16))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; tokenizer: path of a JSON file on the driver."""
    spark = docs.sparkSession
    common.prepare(spark)
    name = bpe.ship_file(spark, tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        table = spark.sparkContext.broadcast(frequent_lengths(docs, Merger(f.read()), text_col))

    def run(batches):
        from lexspark.llm import bpe, token_counts

        merger = token_counts.merger_of(name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [c for part in bpe.chunks(texts) for c in token_counts.count_texts(part, merger, table.value).tolist()]
            yield {"doc_id": batch.column(0).to_pylist(), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
