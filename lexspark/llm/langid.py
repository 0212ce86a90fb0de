"""Language ID by a byte convolutional network (operator 6).

Bytes are embedded, filters of widths 2, 3 and 4 slide over them, the maximum of each over a
window of WINDOW bytes is rectified and a softmax layer gives languages. Training (Adam, in numpy, on
the driver) takes windows from a bounded sample: SAMPLE_ROWS labelled rows of smallest md5 of
their id, WINDOWS windows of each. Every text is then cut into consecutive windows over its whole length, and
the probabilities of its windows are averaged by their bytes.

For inference a filter's response is a sum of what pairs of bytes contribute, so the network is
unfolded into two tables of 65,536 byte pairs; results are the same as by convolution.

Nulls: a null text, an empty one or one without any letter gives `und` with score 0; rows with a null
language or id are not learnt from. With no language to learn everything is `und`. Very long texts are
scored whole, PIECE windows at a time. Repeated rows are scored each. Ties between languages
go to the first in order. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

WINDOW, EMBEDDING, FILTERS, WIDTHS = 192, 6, 16, (2, 3, 4)
SAMPLE_ROWS, WINDOWS, STEPS, BATCH, PIECE = 6_000, 4, 500, 96, 32


def has_letter(text: str) -> bool:
    """Whether a character is of a general category L*: numerals and signs that count as word characters are not."""
    return any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    """Consecutive windows, the last filled up with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def sample_windows(data: bytes, seed: int) -> list[bytes]:
    """A few windows at places that a hash picks, filled up with zero bytes."""
    spots = max(1, len(data) - WINDOW // 2)
    starts = sorted({xxhash.xxh64_intdigest(b"%d" % k, seed & common.MASK64) % spots for k in range(WINDOWS)})
    return [data[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts]


class Network:
    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        draw = lambda *s: rng.standard_normal(s).astype(np.float32)
        self.p = {"emb": draw(256, EMBEDDING) * 0.5, "out": draw(FILTERS * len(WIDTHS), len(langs)) * 0.1, "bias": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"] = draw(w, EMBEDDING, FILTERS) * (1 / np.sqrt(w * EMBEDDING))
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def forward(self, x: np.ndarray):
        """Responses of each width at their best place, those places, and probabilities."""
        p, best, place = self.p, [], []
        e = p["emb"][x]
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            r = sum(e[:, j : j + n] @ p[f"k{w}"][j] for j in range(w))
            at = r.argmax(1)
            best.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + p[f"b{w}"])
            place.append(at)
        h = np.maximum(np.concatenate(best, 1), 0)
        z = h @ p["out"] + p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return e, h, place, z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        e, h, place, prob = self.forward(x)
        d = prob.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part, at = dh[:, i * FILTERS : (i + 1) * FILTERS], place[i]
            g[f"b{w}"] = part.sum(0)
            g[f"k{w}"] = np.empty_like(p[f"k{w}"])
            for j in range(w):  # only the best place of each filter has a gradient
                seen = e[rows, at + j]  # windows, filters, embedding
                g[f"k{w}"][j] = np.einsum("bfe,bf->ef", seen, part)
                np.add.at(g["emb"], x[rows, at + j], part[:, :, None] * p[f"k{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for t in range(1, STEPS + 1):
            pick = [by[k][rng.integers(len(by[k]))] for k in rng.integers(len(by), size=BATCH)]
            for k, g in self.gradients(x[pick], y[pick]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.p[k] -= np.float32(0.01 * (1 - t / (STEPS + 50))) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


class Unfolded:
    """The network as tables over pairs of bytes."""

    def __init__(self, net: Network):
        p, e = net.p, net.p["emb"]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        k2, k3, k4 = p["k2"], p["k3"], p["k4"]
        self.head = np.concatenate([pair(e @ k2[0], e @ k2[1]), pair(e @ k3[0], e @ k3[1]), pair(e @ k4[0], e @ k4[1])], 1)
        self.tail = np.concatenate([pair(e @ k3[2], np.zeros_like(e @ k3[2])), pair(e @ k4[2], e @ k4[3])], 1)
        self.p, self.langs = p, net.langs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        codes = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        r = self.head[codes]  # from the pair that starts at each place
        n = x.shape[1]
        best2 = r[:, :, :FILTERS].max(1)
        more = self.tail[codes[:, 2:]]
        last = self.tail[x[:, -1].astype(np.int32) << 8][:, :FILTERS]
        r3 = r[:, : n - 3, FILTERS : 2 * FILTERS] + more[:, :, :FILTERS]
        best3 = np.maximum(r3.max(1), r[:, n - 3, FILTERS : 2 * FILTERS] + last)
        best4 = (r[:, : n - 3, 2 * FILTERS :] + more[:, :, FILTERS:]).max(1)
        h = np.maximum(np.concatenate([best2 + self.p["b2"], best3 + self.p["b3"], best4 + self.p["b4"]], 1), 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list = [("und", 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        parts = [windows_of(texts[i].encode("utf-8").lower()) for i in todo]
        if not todo:
            return out
        x = np.concatenate(parts)
        weight = (x != 0).sum(1) + 1e-6
        prob = np.concatenate([self.probabilities(x[k : k + PIECE]) for k in range(0, len(x), PIECE)]) * weight[:, None]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        head = np.cumsum(size) - size
        total = np.add.reduceat(prob, head, axis=0) / np.add.reduceat(weight, head)[:, None]
        for i, row in zip(todo, total):
            k = int(row.argmax())
            out[i] = (self.langs[k], float(min(max(row[k], 0), 1)))
        return out


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Unfolded:
    """learn: column over docs that is true for rows that may be learnt from."""
    spark = docs.sparkSession
    common.prepare(spark)
    usable = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
    ids = usable.select("id").distinct().orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE_ROWS)
    rows = usable.join(F.broadcast(ids), "id").select("text", "lang")

    def cut(batches):
        from lexspark.llm import langid as own

        for batch in batches:
            out = {"x": [], "lang": []}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if text and own.has_letter(text):
                    data = text.encode("utf-8").lower()
                    found = own.sample_windows(data, xxhash.xxh64_intdigest(data))
                    out["x"] += found
                    out["lang"] += [lang] * len(found)
            yield out

    found = sorted((r["lang"], bytes(r["x"])) for r in common.arrow_map(rows, cut, "x binary, lang string").toLocalIterator())
    langs = sorted({lang for lang, _ in found})
    net = Network(langs)
    if found:
        x = np.frombuffer(b"".join(d for _, d in found), np.uint8).reshape(len(found), WINDOW)
        net.fit(x, np.searchsorted(np.array(langs), [lang for lang, _ in found]))
    return Unfolded(net)


def identify(docs: DataFrame, model: Unfolded, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column(1).to_pylist())
            yield {"doc_id": batch.column(0).to_pylist(), "lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    return common.arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
