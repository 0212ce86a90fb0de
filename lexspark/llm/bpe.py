"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokens come from pretoken.slices (class arrays and a transition-function scan); each
distinct slice is merged once per worker and remembered as the little-endian bytes of its
ids. The byte offset of every id is retained with the ids, and decoding copies each id's bytes to its
offset, all at once. One pass over the documents, no shuffle.

Nulls: a null text counts as empty (no ids). Very long texts are encoded whole; a text is
one row, so memory is bounded by the longest text plus `limit` cached slices. Repeated rows
and ties have no effect: each row is on its own. An empty table gives an empty result.
Columns other than the id and the text are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common, pretoken

#: Texts are joined up to this many characters for the vectorised scan.
CHUNK_CHARS = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a rank file: base64 of the token's bytes, a blank, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    right = list(range(1, n + 1))  # start of the part after the one that starts here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or right[j] != end:
            continue  # one of the two has been merged meanwhile
        alive[j] = False
        right[i] = end
        if end < n:
            left[end] = i
            r = ranks.get(piece[i : right[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, right[end]))
        if left[i] >= 0:
            r = ranks.get(piece[left[i] : end])
            if r is not None:
                heapq.heappush(heap, (r, left[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class PieceCache(dict):
    """slice -> its ids as little-endian uint32 bytes; at most `limit` slices, none of over 64 bytes, stay."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 200_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge_ranks(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.cache = PieceCache(ranks)
        tokens = {i: b for b, i in ranks.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        #: Bytes of all tokens in a row, where each begins, and its length.
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        data, at, counts = pretoken.slices(texts)
        cache = self.cache
        edges = at.tolist()
        out, k = [], 0
        for n in counts.tolist():
            out.append(b"".join([cache[data[a:b]] for a, b in zip(edges[k : k + n], edges[k + 1 : k + n + 1])]))
            k += n
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte offsets in the UTF-8 text at which ids begin, and its length: one more than there are ids."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offset in the UTF-8 text at which each begins."""
        ids = self.encode_many([text])[0]
        return np.frombuffer(ids, "<u4"), self.offsets(ids)[:-1]

    def decode(self, ids: bytes, offsets: np.ndarray) -> bytes:
        """The bytes of ids, each put at its offset."""
        ids, size = np.frombuffer(ids, "<u4"), np.diff(offsets)
        if len(size) != len(ids) or (size != self.sizes[ids]).any():
            raise ValueError("offsets are not those of the ids")
        return self.bytes[np.repeat(self.starts[ids] - offsets[:-1], size) + np.arange(size.sum())].tobytes()


def ship_file(spark, path: str) -> str:
    """Send a vocabulary file to every executor; the name under which SparkFiles finds it."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def chunks(texts: list[str], most: int = CHUNK_CHARS):
    """Consecutive runs of texts of together at most `most` characters (a longer text alone)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    if name not in _codecs:
        with open(SparkFiles.get(name), "rb") as f:
            _codecs[name] = Codec(read_ranks(f.read()))
    return _codecs[name]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, offsets]): encodes whole texts, then decodes the ids again.

    vocabulary: path of a rank file on the driver. ids: little-endian uint32 as binary; offsets: of each id in
    the UTF-8 text, and its length, little-endian int64 as binary.
    """
    common.prepare(docs.sparkSession)
    name = ship_file(docs.sparkSession, vocabulary)

    def run(batches):
        from lexspark.llm import bpe

        own = bpe.codec(name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x for part in bpe.chunks(texts) for x in own.encode_many(part)]
            offsets = [own.offsets(x) for x in ids]
            out = {
                "doc_id": batch.column(0).to_pylist(),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(x, at)).hexdigest() for x, at in zip(ids, offsets)],
            }
            yield out | ({"ids": ids, "offsets": [at.astype("<i8").tobytes() for at in offsets]} if with_ids else {})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, offsets binary" * with_ids)
