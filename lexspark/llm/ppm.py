"""LM scoring by prediction by partial matching (operator 7).

The model is a trie of byte contexts up to ORDER bytes over all training documents; nothing is pruned, so it grows with them.
A symbol (a byte, or 0xFF, which no UTF-8 text holds, for both ends of a text) is predicted
in the longest context known; if it is unknown there, an escape leads to the context without its first
byte, where symbols of the longer context are excluded. Escapes of a node are estimated by its number of distinct symbols.

How a symbol is predicted depends only on the gram of ORDER + 1 bytes that ends with it. So each distinct gram is worked out once:
1. Documents are written with the number of the task that wrote them, its part.
2. For each part its distinct grams and their training counts are dealt out, packed, by the GROUP bytes before the symbol. All symbols
   of a context of GROUP bytes or more, and their suffixes in contexts of GROUP bytes or more, are thereby in one task.
3. That task adds up counts and walks the trie level by level, from the levels below GROUP, which
   are those of a table of grams of GROUP bytes (at most 2^(8 GROUP) entries, 16 bytes each), to the longest context, and sends every part the
   logarithms of its own grams.
4. Parts meet their answers, which come before their documents, and documents are sums of them.
Neither the driver nor a task ever holds more of the trie than the low levels and one deal; a part's answers are bounded by its own text.

The unigram baseline counts words exactly. The FREQUENT most frequent words are broadcast; the
others of each text are joined with the counts.

Nulls: a null text counts as empty: it has just its end. A null id hashes as ''. Repeated rows are
scored each (and learnt from each). Very long texts are scored whole, in chunks of whole texts of at least
CHUNK bytes. Other columns are ignored, whatever their names. With no training text N and V are 0
and every symbol has probability 1/256.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

ORDER, FREQUENT, CHUNK = 5, 1 << 18, 1 << 19
#: Bytes before the symbol by which grams are dealt out; levels of shorter contexts are broadcast.
GROUP = 3
END = 0xFF
#: Distinct words that a task counts before it puts them out.
WORDS = 400_000


def low(text: str | None) -> bytes:
    return (text or "").encode("utf-8").lower()


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ORDER ends before and one behind; positions to predict; how many each text has."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(size + ORDER) - size
    skip = np.repeat(first - (np.cumsum(size) - size), size)
    return data, skip + np.arange(size.sum()), size


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER + 1 = 6 bytes that end at each position, as a number: pairs, of those fours, and sixes."""
    one = data.astype(np.uint64)
    two = one.copy()
    two[1:] |= one[:-1] << np.uint64(8)
    six = two.copy()
    six[2:] |= two[:-2] << np.uint64(16)
    six[4:] |= two[:-4] << np.uint64(32)
    return six[at]


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and their counts."""
    data, at, _ = join_texts(texts)
    return np.unique(grams(data, at), return_counts=True)


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by code, codes ascending."""
    codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[head], np.add.reduceat(counts[order], head)


class Level:
    """All contexts of one length: grams (context and symbol, ascending) with counts, and logarithms of what the trie predicts.

    plain: of the symbol, if no longer context is known; escaped: of the symbol in the context
    without its first byte, after an escape from this one.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, below: Level | None):
        self.order = order
        context = codes >> np.uint64(8)
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(codes)])
        self.codes, self.counts, self.node = codes, counts, np.repeat(np.arange(len(head)), np.diff(np.append(head, len(codes))))
        self.total = np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
        self.kinds = np.add.reduceat((counts > 0).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        if below is None:
            unseen = 256 - (self.kinds[0] if len(head) else 0)
            lower = self.escaped = np.full(len(codes), -np.log10(unseen) if unseen else 0.0)
        else:
            at = np.searchsorted(below.codes, codes & np.uint64((1 << (8 * order)) - 1))
            seen, up = below.counts[at], below.node[at[head]]
            taken = np.add.reduceat(np.where(counts > 0, seen, 0), head) if len(head) else self.total
            escape = below.kinds[up] - self.kinds  # of the symbols left, once those of this context are excluded
            rest, escape = np.where(escape > 0, log(below.total[up] - taken + escape), 0)[self.node], np.where(escape > 0, log(escape), 0)[self.node]
            self.escaped = np.where(seen > 0, log(seen) - rest, escape - rest + below.escaped[at])
            lower = below.plain[at]
        whole, leave = log(self.total + self.kinds)[self.node], log(self.kinds)[self.node]
        known = (self.total > 0)[self.node]
        self.plain = np.where(counts > 0, log(counts) - whole, np.where(known, leave - whole + self.escaped, lower))


def levels(codes: np.ndarray, counts: np.ndarray, top: int, below: Level | None) -> Level:
    """The level of contexts of `top` bytes, and on the way those between it and the one below."""
    first = 0 if below is None else below.order + 1
    stack = [(codes, counts)]
    for order in range(top - 1, first - 1, -1):
        stack.append(add_up([(stack[-1][0] & np.uint64((1 << (8 * (order + 1))) - 1), stack[-1][1])]))
    for order, (c, n) in zip(range(first, top + 1), reversed(stack)):
        below = Level(c, n, order, below)
    return below


class Table:
    """Sorted codes -> values, by open addressing."""

    MULTIPLIER, FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.FREE), np.zeros(1 << bits)
        left, slot = np.arange(len(keys)), ((keys * self.MULTIPLIER) >> self.shift).astype(np.int64)
        while len(left):
            free = self.keys[slot] == self.FREE
            _, one = np.unique(slot, return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = keys[left[one]], values[left[one]]
            stay = np.ones(len(left), bool)
            stay[one] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which have to be there."""
        slot = ((keys * self.MULTIPLIER) >> self.shift).astype(np.int64)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            if (there == self.FREE).any():
                raise KeyError("a gram without an answer")
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text, its end included."""
        data, at, size = join_texts(texts)
        return np.add.reduceat(self.get(grams(data, at)), np.cumsum(size) - size) if len(size) else np.zeros(0)


def chunks(texts: list, most: int = CHUNK, size=len):
    part, total = [], 0
    for t in texts:
        part.append(t)
        total += size(t)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def written(docs: DataFrame, learn, id_col: str, text_col: str) -> DataFrame:
    """(part, row, doc_id, text, learn): all rows, in files of which each holds one part, or the first of several."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return common.materialize(rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*"), "parts")


def _by_part(batches):
    """(part, rows of the other columns) of consecutive rows, never more than a few of a part at once."""
    for batch in batches:
        now, out = None, []
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and out:
                yield now, out
                out = []
            now = part
            out.append(row)
        if out:
            yield now, out


def counted(parts: DataFrame, deals: int) -> DataFrame:
    """(deal, part, codes, counts) of the distinct grams of each part (those of one part may come in several rows)."""

    def run(batches):
        from lexspark.llm import ppm

        now, found, texts, waiting = None, [], {True: [], False: []}, 0

        def count():
            nonlocal found, waiting
            for learn, own in texts.items():
                if own:
                    codes, counts = ppm.count_grams(own)
                    found.append((codes, counts * learn))
                    own.clear()
            waiting = 0
            if len(found) > 24:
                found = [ppm.add_up(found)]

        def out():
            nonlocal found
            count()
            if found:
                codes, counts = ppm.add_up(found)
                found = []
                of = common.mix64((codes >> np.uint64(8)) & np.uint64((1 << (8 * GROUP)) - 1)) % np.uint64(deals)
                order = np.argsort(of.astype(np.int32), kind="stable")
                at = np.searchsorted(of[order], np.arange(deals + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(at)).tolist()
                for some in chunks(used, 1 << 20, lambda d: int(at[d + 1] - at[d])):
                    own = [order[at[d] : at[d + 1]] for d in some]
                    yield {"deal": some, "part": [now] * len(some), "codes": [codes[o].tobytes() for o in own], "counts": [counts[o].astype(np.int64).tobytes() for o in own]}

        for part, rows in ppm._by_part(batches):
            if part != now:
                yield from out()
                now = part
            for text, learn in rows:
                data = ppm.low(text)
                texts[learn].append(data)
                waiting += len(data) + 1
                if waiting >= ppm.CHUNK:
                    count()
        yield from out()

    return common.arrow_map(parts.select("part", "text", "learn"), run, "deal int, part int, codes binary, counts binary")


def low_levels(dealt: DataFrame) -> Level:
    """The level of contexts of GROUP - 1 bytes: grams of GROUP bytes are added up by task, then in a few tasks by their hash."""
    few = 64

    def fold(batches):
        from lexspark.llm import ppm

        found = []
        for batch in batches:
            for codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                found.append((np.frombuffer(codes, np.uint64) & np.uint64((1 << (8 * GROUP)) - 1), np.frombuffer(counts, np.int64)))
                if len(found) > 64:
                    found = [ppm.add_up(found)]
        if found:
            codes, counts = ppm.add_up(found)
            of = common.mix64(codes) % np.uint64(few)
            used = np.unique(of).tolist()
            yield {"f": used, "codes": [codes[of == f].tobytes() for f in used], "counts": [counts[of == f].tobytes() for f in used]}

    def add(batches):
        from lexspark.llm import ppm

        found: dict = {}
        for batch in batches:
            for f, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                part = (np.frombuffer(codes, np.uint64), np.frombuffer(counts, np.int64))
                found[f] = ppm.add_up([found[f], part]) if f in found else part
        yield {"f": list(found), "codes": [c.tobytes() for c, _ in found.values()], "counts": [n.tobytes() for _, n in found.values()]}

    sums = common.arrow_map(dealt.select("codes", "counts"), fold, "f int, codes binary, counts binary").repartition(few, "f")
    got = [(np.frombuffer(r["codes"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in common.arrow_map(sums, add, "f int, codes binary, counts binary").toLocalIterator()]
    return levels(*add_up([(np.empty(0, np.uint64), np.empty(0, np.int64)), *got]), GROUP - 1, None)


def solve(asked: list[tuple[np.ndarray, np.ndarray]], below: Level) -> list[np.ndarray]:
    """log10 of the probability of each gram of each list of grams and counts, which are all there are of their contexts."""
    top = levels(*add_up(asked), ORDER, below)
    return [top.plain[np.searchsorted(top.codes, codes)] for codes, _ in asked]


def answers(dealt: DataFrame, deals: int) -> DataFrame:
    """(part, codes, logs) from counted(): what the trie of all counts predicts."""
    below = dealt.sparkSession.sparkContext.broadcast(low_levels(dealt))

    def run(batches):
        from lexspark.llm import ppm

        parts, asked = [], []
        for batch in batches:
            for part, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(part)
                asked.append((np.frombuffer(codes, np.uint64), np.frombuffer(counts, np.int64)))
        if asked:
            for i, logs in enumerate(ppm.solve(asked, below.value)):
                yield {"part": [parts[i]], "codes": [asked[i][0].tobytes()], "logs": [logs.tobytes()]}

    return common.arrow_map(dealt.repartition(deals, "deal").select("part", "codes", "counts"), run, "part int, codes binary, logs binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over rows(text), without ends; written out."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(low(t).split())
            if len(seen) > WORDS:
                yield {"word": list(seen), "c": list(seen.values())}
                seen = Counter()
        yield {"word": list(seen), "c": list(seen.values())}

    return common.materialize(common.arrow_map(rows, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = written(docs, learn, id_col, text_col)
    bytes_ = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # A deal takes grams of about 64 MB of text, however many parts there are.
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_ >> 26)
    dealt = common.materialize(counted(parts, deals), "dealt")
    solved = common.materialize(answers(dealt, deals), "answers")
    common.discard(dealt)

    counts = word_counts(parts.where("learn").select("text"))
    texts = parts.where("learn").count()
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = size["n"] + texts, size["v"] + (texts > 0)
    frequent = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toLocalIterator()}
    known = spark.sparkContext.broadcast(frequent)
    bottom = float(np.log10(n + 0.1 * (v + 1)))
    end = (float(np.log10(texts + 0.1)) - bottom, int(texts > 0))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from lexspark.llm import ppm

        words_of = {w: float(np.log10(c + 0.1)) - bottom for w, c in known.value.items()}
        now, waiting, table = None, [], None
        for part, rows in ppm._by_part(batches):
            if part != now:
                now, waiting, table = part, [], None
            waiting += [(np.frombuffer(c, np.uint64), np.frombuffer(x, np.float64)) for _, _, _, c, x in rows if c is not None]
            rows = [r for r in rows if r[0] is not None]
            if not rows:
                continue
            if table is None:  # all answers of a part come before its rows
                table, waiting = ppm.Table(np.concatenate([c for c, _ in waiting]), np.concatenate([x for _, x in waiting])), []
            texts = [ppm.low(r[2]) for r in rows]
            tokens, base, hits, missing = [], [], [], []
            for t in texts:
                words = t.split()
                logs = list(map(words_of.get, words))
                gone = [w for w, x in zip(words, logs) if x is None]
                found = [x for x in logs if x is not None] if gone else logs
                tokens.append(len(words) + 1)
                base.append(sum(found) + end[0])
                hits.append(len(found) + end[1])
                missing.append(gone)
            scores = np.concatenate([table.score(p) for p in ppm.chunks(texts)])
            yield {"row": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "n_tokens": tokens, "base": base, "known": hits, "missing": missing, "score": scores}

    nothing = lambda t: F.lit(None).cast(t)
    asked = parts.select("part", "row", "doc_id", "text", nothing("binary").alias("codes"), nothing("binary").alias("logs"))
    told = solved.select("part", nothing("long").alias("row"), nothing(kind).alias("doc_id"), nothing("string").alias("text"), "codes", "logs")
    places = 2 * parts.select("part").distinct().count() + int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that few parts meet
    both = told.unionByName(asked).repartition(places, "part").sortWithinPartitions("part", F.col("row").asc_nulls_first())
    scored = common.arrow_map(both, run, f"row long, doc_id {kind}, n_tokens long, base double, known long, missing array<binary>, score double")
    scored = common.materialize(scored, "scored")
    common.discard(parts)
    common.discard(solved)
    rare = scored.select("row", F.explode("missing").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1) - bottom).alias("more"), F.count("c").alias("more_known"))
    out = scored.select("row", "doc_id", "n_tokens", "base", "known", "score").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
