"""Fuzzy line dedup (operator 2).

Lines are normalised (lower case, ASCII signs and white space to single blanks, digits to 0) and known by a 128-bit
digest. Two distinct lines are linked if their edit similarity, 1 - distance / longer length, is at least
SIMILARITY. Of each connected group the first occurrence, by document id and line number, is kept.

Pairs to compare are those that agree in ROWS minima of their features in one of BANDS bands (MinHash): with a share x of
common features a link is missed with probability (1 - x^ROWS)^BANDS, 0.03 at 0.54 and 0.001 at 0.67. This stands in
for blocks of a SimHash: of pairs with edit similarity 0.85 or more only a quarter to a half lie within 3 of 64 bits, and at the 8
to 10 bits that would be needed pigeonhole blocks have six bits, which select nothing. Features are pairs of
neighbouring words (characters, in scripts without blanks); a line of few words is taken as its runs of three bytes instead.
Links are found by probability, not by proof: a line with a slip in nearly every word shares no pair and is not found.

Band keys travel packed, 12 bytes a line and band; a task holds whole buckets and puts out the sets of over one line that
share a key. Near copies share many keys, so equal sets are merged. The texts
of the lines in them are fetched (a bitmap of bounded size keeps other lines from being sent), and sets
are worked off in two rounds: those of the first bands, then those whose lines are not yet in one group; only
the links that join two groups are put out. In the first round sets of over CHUNK lines are dealt out into chunks, each set in its own
way, which groups near copies without replicating a line; what then still is of several groups
goes out as pairs of chunks, so that no task holds a whole hot set and no pair is left out. Small sets of the second round that have
the same smallest node go together: lines that share several keys are sent and compared once. Of two groups few pairs are compared at a time, as one
link joins them. Copies of a line are one node.
Bounds by lengths and runs of three characters, of which an edit changes at most three, settle most pairs that are not alike.
The others of many sets are compared together, in a band of cells for all pairs at once.

Lines that are empty once normalised (blank, or signs alone) are left alone. Nulls: a null text has
no lines and stays null; a null id counts as smaller than any other. Rows are known by their id and the
hash of their text; those that repeat both are treated alike (each keeps what the first keeps). Lines of
any length and number are handled whole. Other columns pass through deduplicate() unchanged, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

BANDS, ROWS, SIMILARITY, CHUNK = 20, 3, 0.85, 800
#: Lines of fewer words are taken as runs of three bytes, those of fewer than FEW_WORDS by their words as well as by pairs.
MIN_WORDS, FEW_WORDS = 5, 16
#: Cells for counts of runs of three characters.
CELLS = 512
#: Lines that a task gathers before it deals out their band keys, bytes that are hashed at a time, and the most bits of a node by which texts are asked for.
GATHER, SPAN, MOST_BITS = 1 << 16, 1 << 19, 26
#: In the second round sets of at most so many lines that have the same smallest node are worked off as one: BANDS of them at most, about what a pair of chunks holds.
SMALL = 80
#: Sets of the bands before this one make up the first round.
FIRST = 2
#: Signs to blanks, digits to 0; other bytes stay (fixed by ASCII).
PLAIN = bytes(10 if b == 10 else 48 if 48 <= b <= 57 else b if 97 <= b <= 122 or 65 <= b <= 90 or b > 127 else 32 for b in range(256))
#: Odd multipliers, one for each minimum.
MULTIPLIERS = (common.mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Scripts that are written without blanks (from U+0E00 on); each of their characters is a word of its own when lines are hashed.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
HIGH = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef]")


def lines_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The normalised lines of all texts in a row (empty where a line is left alone), and how many each text has."""
    parts = [b"" if t is None else t.lower().encode("utf-8").translate(PLAIN) for t in texts]
    count = np.fromiter((0 if t is None else p.count(b"\n") + 1 for t, p in zip(texts, parts)), np.int64, len(texts))
    a = np.frombuffer(b"\n".join([p for t, p in zip(texts, parts) if t is not None]) + b"\n", np.uint8)
    # Of blanks in a row the first stays, unless it begins or ends a line.
    blank = a == 32
    # (Joined to arrays of bytes, not to lists, these stay bytes.)
    end = np.array([10], np.uint8)
    before = np.concatenate([end, a[:-1]])
    a = a[~(blank & ((before == 32) | (before == 10)))]
    lines = a.tobytes().replace(b" \n", b"\n").split(b"\n")
    return lines[:-1] if count.sum() else [], count


def normalised_lines(text: str | None) -> list[str]:
    """The normalised form of every line, in order; '' for lines that are left alone."""
    return [x.decode("utf-8") for x in lines_of([text])[0]]


def spaced(line: bytes) -> bytes:
    """The line with blanks around characters of scripts that have none."""
    return UNSPACED.sub(r" \g<0> ", line.decode("utf-8")).encode("utf-8") if HIGH.search(line) else line


def signatures(lines: list[bytes]) -> np.ndarray:
    """(line, band): 32-bit keys of (nonempty) normalised lines."""
    if HIGH.search(b"\n".join(lines)):
        lines = list(map(spaced, lines))
    out = [_signed(lines[a:b]) for a, b in _spans(np.fromiter(map(len, lines), np.int64, len(lines)))]
    return np.concatenate([np.empty((0, BANDS), np.uint32), *out])


def _signed(lines: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    run = common.run_hashes(a)
    gap = (a == 32) | (a == 10)
    word = np.diff(np.concatenate([[False], ~gap, [False]]).astype(np.int8))
    first, stop = np.flatnonzero(word == 1), np.flatnonzero(word == -1)
    end = np.flatnonzero(a == 10)
    n = np.diff(np.searchsorted(first, end), prepend=0)
    owner = np.repeat(np.arange(len(lines)), n)
    h = run(first, stop)
    many = (n >= MIN_WORDS)[owner]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & many[1:])
    alone = np.flatnonzero(many & (n < FEW_WORDS)[owner])
    # Lines of few words: all runs of three bytes, or what there is.
    begin = np.concatenate([[0], end[:-1] + 1])
    short = np.flatnonzero(n < MIN_WORDS)
    runs = np.maximum(end[short] - begin[short] - 2, 1)
    at = np.repeat(begin[short] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    small = np.repeat(short, runs)
    grams = np.concatenate([common.mix64(h[both] * common.PLACE[0] + common.mix64(h[both + 1])), common.mix64(h[alone]), run(at, np.minimum(at + 3, end[small]))])
    owner = np.concatenate([owner[both], owner[alone], small])
    order = np.argsort(owner, kind="stable")
    grams, owner = (grams[order] >> np.uint64(32)).astype(np.uint32), owner[order]
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for i, multiplier in enumerate(MULTIPLIERS):
        keys[:, i // ROWS] = common.mix64(keys[:, i // ROWS] + np.minimum.reduceat(grams * multiplier, head))
    return (keys >> np.uint64(32)).astype(np.uint32)


def _spans(size: np.ndarray):
    """Ranges of lines of together at most SPAN bytes (or a single line)."""
    a, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > a and total + n > SPAN:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(size):
        yield a, len(size)


def _same(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _unlike(a: str, b: str) -> tuple[str, str]:
    """What is between equal beginnings and equal ends."""
    i = _same(a, b)
    a, b = a[i:], b[i:]
    j = _same(a[::-1], b[::-1])
    return a[: len(a) - j], b[: len(b) - j]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns in Python integers, after equal ends are cut off.

    Given `most`, any number over it stands for all distances over it.
    """
    a, b = _unlike(a, b)
    if not a or not b:
        return len(a) + len(b)
    most = len(a) + len(b) if most is None else most
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, left = full, 0, len(a), len(b)
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(diagonal | plus) & full), plus & diagonal
        score += bool(up & top) - bool(down & top)
        left -= 1
        if score - left > most:  # it falls by one a column at most
            return score - left
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (~(diagonal | up) & full), up & diagonal
    return score


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity is at least SIMILARITY; bounds settle most pairs."""
    longest = max(len(a), len(b))
    most = int((1 - SIMILARITY) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _unlike(a, b)
    if max(len(a), len(b)) <= most or len(a) == len(b) and sum(map(operator.ne, a, b)) <= most:
        return True
    return edit_distance(a, b, most) <= most


def _columns(texts: list[str], before: int, rows: int, free: int) -> np.ndarray:
    """(place, text): code points from place `before` on, `free` elsewhere."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.uint8 if len(points) == 0 or points.max() < 254 else np.uint16 if points.max() < 1 << 16 else np.uint32
    out = np.full((len(texts), rows), free, kind)
    out[np.repeat(np.arange(len(texts)), size), before + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = points
    return np.ascontiguousarray(out.T)


def _reach(most: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far from the first diagonal, to either side, a path of at most `most` edits can get that ends `more` diagonals to one side (0 to most)."""
    return (most - more) // 2, (most + more) // 2


def _band(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Whether the distance of each pair is at most its `most`: all pairs at once, cell by cell of a diagonal band. First texts are not the shorter ones.

    Counter-diagonals t = i + j follow each other; the cells of one are those with i - j from -low to high, both even, in steps of two: as far as _reach() says,
    and later as far as what a pair has left to spend still lets it go and come back.
    Distances over the largest `most` need not be told apart, so that bytes hold them. On odd ones cells hold a distance less one, which saves additions. A pair ends where all its cells on two neighbouring ones exceed `most`.
    """
    k = int(most.max())
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64)
    order = np.argsort(size.sum(1), kind="stable")
    pairs, size, least = [pairs[i] for i in order.tolist()], size[order], most[order]
    end, at = size.sum(1), size[:, 0] - size[:, 1]
    low, high = (int(x.max()) + 1 & ~1 for x in _reach(least, at))
    longest, before = int(size.max()), max(low, high) + 1
    rows = longest + 2 * before + 2
    kind = np.uint8 if k < 230 else np.uint16 if k < 65000 else np.uint32
    # The second text is read backwards, so that both are slices in the same direction.
    left = _columns([a for a, _ in pairs], before, rows, 254)
    right = np.ascontiguousarray(_columns([b for _, b in pairs], before, rows, 255)[::-1])
    last = rows - 1 - before  # where the second text's first character is
    n = (low + high) // 2 + 1
    even, odd = np.full((n, len(pairs)), k + 1, kind), np.full((n + 1, len(pairs)), k + 1, kind)
    even[low // 2] = 0
    out, name = np.zeros(len(pairs), bool), np.arange(len(pairs))
    done, two, top = int(np.searchsorted(end, 0, "right")), kind(2), kind(k + 1)
    out[:done] = True
    ends = end.tolist()
    soon = ends[done] if done < len(ends) else ends[-1] + 1
    for t in range(1, ends[-1] + 1):
        if t & 1:
            i, j, cells = before + (t - low + 1) // 2 - 1, last - ((t + low - 1) // 2 - 1), odd[1:-1]
            near = np.minimum(even[:-1], even[1:])
        else:
            i, j, cells = before + (t - low) // 2 - 1, last - ((t + low) // 2 - 1), even
            near = np.minimum(odd[:-1], odd[1:])
            near += two
        # Slices past either end hold no cell of a pair that is still open.
        lo, hi = max(0, -i, -j), min(len(cells), rows - i, rows - j)
        if lo < hi:
            own = cells[lo:hi]
            own += (left[i + lo : i + hi] != right[j + lo : j + hi]).view(np.uint8)
        np.minimum(cells, near, out=cells)
        if t >= soon:
            stop = int(np.searchsorted(end, t, "right"))
            own = np.arange(done, stop)
            cell = (at[own] + low - (t & 1)) // 2
            inside = (cell >= 0) & (cell < len(cells))
            out[name[own]] = inside & (cells[np.where(inside, cell, 0), own] + (t & 1) <= least[own]) if len(cells) else False
            done, soon = stop, ends[stop] if stop < len(ends) else ends[-1] + 1
        if t % 32 == 0 and done < len(end):
            np.minimum(even, top, out=even)
            np.minimum(odd, top, out=odd)
            wide = np.int16 if k < 10000 else np.int64
            one, way = np.arange(-low, high + 1, 2).astype(wide)[:, None], at.astype(wide)
            off = np.arange(1 - low, high, 2).astype(wide)[:, None]
            here, there = even.astype(wide), odd[1:-1].astype(wide) + wide(1)
            # What is left costs at least the way back to the last cell's diagonal.
            open_ = np.minimum((here + np.abs(one - way)).min(0), (there + np.abs(off - way)).min(0, initial=wide(32000))) <= least
            open_[:done] = False
            n = int(open_.sum())
            if not n:
                break
            # From a cell a path gets so far to either side that it can still come back.
            spare = least - np.minimum((here - one).min(0), (there - off).min(0, initial=wide(32000)))
            right_most = int((spare + at)[open_].max()) // 2
            spare = least - np.minimum((here + one).min(0), (there + off).min(0, initial=wide(32000)))
            left_most = int((spare - at)[open_].max()) // 2
            less, fewer = (max(0, old - (new + 1 & ~1)) // 2 for old, new in ((low, left_most), (high, right_most)))
            if 8 * (less + fewer) > len(even):
                low, high = low - 2 * less, high - 2 * fewer
                even, odd = even[less : len(even) - fewer].copy(), odd[less : len(odd) - fewer].copy()
                odd[0] = odd[-1] = top
            if n < 0.75 * len(open_):
                keep = np.flatnonzero(open_)
                left, right, even, odd = (np.take(x, keep, 1) for x in (left, right, even, odd))
                name, end, at, least = (x[keep] for x in (name, end, at, least))
                ends, done = end.tolist(), 0
                soon = ends[0]
    back = np.empty(len(out), bool)
    back[order] = out
    return back


#: Cells of a counter-diagonal that are worked out at once at least (if there are pairs) and at most, characters of the pairs, and the fewest pairs for which that pays.
NARROW, WIDE, HELD, FEW_PAIRS = 1 << 15, 1 << 17, 1 << 20, 8


def alike(pairs: list[tuple[str, str]]) -> np.ndarray:
    """similar() of each pair; those whose paths need bands of about the same width go together."""
    out, todo, most = np.zeros(len(pairs), bool), [], []
    for i, (a, b) in enumerate(pairs):
        allowed = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > allowed:
            continue
        a, b = _unlike(a, b)
        if max(len(a), len(b)) <= allowed:
            out[i] = True
        else:
            todo.append((i, a, b) if len(a) >= len(b) else (i, b, a))
            most.append(allowed)
    spare = np.array(most, np.int64)
    size = np.array([(len(a), len(b)) for _, a, b in todo], np.int64).reshape(-1, 2)
    width = _reach(spare, size[:, 0] - size[:, 1])[1]
    order = np.lexsort((size.sum(1), width)).tolist()
    width, longer = width.tolist(), size[:, 0].tolist()
    first = 0
    while first < len(order):
        least, stop, long = width[order[first]], first, 0
        while stop < len(order):
            k, n, count = width[order[stop]], max(long, longer[order[stop]]), stop - first
            if count and (k > least + least // 4 + 2 and (k * count > NARROW or k > 4 * least + 8) or k * (count + 1) > WIDE or (n + 2 * k) * (count + 1) > HELD):
                break
            stop, long = stop + 1, n
        some = order[first:stop]
        if len(some) < FEW_PAIRS:
            for x in some:
                i, a, b = todo[x]
                out[i] = edit_distance(a, b, most[x]) <= most[x]
        else:
            out[[todo[x][0] for x in some]] = _band([todo[x][1:] for x in some], spare[some])
        first = stop
    return out


def cell_counts(lines: list[str]) -> np.ndarray:
    """(line, cell): counts of runs of three characters."""
    p = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(p) < 3:
        return np.zeros((len(lines), CELLS), np.uint16)
    cell = (p[:-2] * np.uint32(2654435761) ^ p[1:-1] * np.uint32(2246822519) ^ p[2:] * np.uint32(3266489917)) >> np.uint32(23)
    # Runs that two lines share count for none.
    stop, end = np.cumsum(size), len(lines) * CELLS
    at = np.repeat(np.arange(0, end, CELLS), size)[:-2] + cell
    for back in (1, 2):
        across = (stop - back)[size >= back]
        at[across[(across >= 0) & (across < len(at))]] = end
    return np.bincount(at, minlength=end)[:end].reshape(-1, CELLS).astype(np.uint16)


def possible(counts: np.ndarray, chars: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the pairs (some, others) that lengths and counts of runs (line, cell) do not tell apart."""
    a, b = chars[some], chars[others]
    most = np.floor((1 - SIMILARITY) * np.maximum(a, b) + 1e-9)
    near = np.flatnonzero(np.abs(a - b) <= most)
    out = []
    for first in range(0, len(near), 2048):
        own = near[first : first + 2048]
        both = np.minimum(counts[others[own]], counts[some[own]]).sum(1, dtype=np.int64)
        out.append(own[np.maximum(a[own], b[own]) - 2 - both <= 3 * most[own]])
    return np.concatenate(out) if out else near


#: Pairs of sets of at most so many lines are looked through at once, where groups are few: a row at a time leaves out more pairs where every line is alone.
AT_ONCE = 24
HALVES = [np.triu_indices(n, 1) for n in range(AT_ONCE + 1)]


#: Of two groups of lines so many times as many pairs are compared as were before.
MORE = 2


class Compared:
    """Lines of several groups on their way to their links: of one set, or of sets that share lines."""

    def __init__(self, digests: list, groups: list, norms: list, sets: list[list[int]] | None = None, counts: list[np.ndarray] | None = None):
        n = len(norms)
        number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
        self.digests, self.norms = digests, norms
        self.group = np.array([number[g] for g in groups], np.int64)
        self.uf, self.left, self.asked = common.UnionFind(), max(len(number) - 1, 0), []
        #: Small sets first; `row` of the first of them comes next.
        self.sets, self.row = sorted((np.array(x, np.int64) for x in sets), key=len, reverse=True) if sets else [np.arange(n)], 0
        self.seen: set | None = set() if len(self.sets) > 1 else None
        self.waiting: list[tuple[int, int]] = []
        self.tried: dict[tuple[int, int], int] = {}
        self.few = 2 * len(number) <= n
        self.share = n / 2  # pairs to ask for next; more each time, so that there are few rounds
        self.now = self.group
        if self.left:
            self.chars = np.fromiter(map(len, norms), np.int64, n)
            self.size = int(self.chars.sum())
            self.counts = cell_counts(norms) if counts is None else np.stack(counts)

    def _next(self) -> list[tuple[int, int]]:
        """Pairs of the next row, or of all rows of a small set, that may be links between groups and were not met in another set."""
        own = self.sets[-1]
        if len(own) <= AT_ONCE and (self.few or self.seen is not None or len(own) < 3):
            self.sets.pop()
            i, j = (own[x] for x in HALVES[len(own)])
        else:
            j = own[self.row + 1 :]
            i = np.full(len(j), own[self.row])
            self.row += 1
            if self.row >= len(own) - 1:
                self.sets.pop()
                self.row = 0
        apart = np.flatnonzero(self.now[i] != self.now[j])
        if not len(apart):
            return []
        i, j = i[apart], j[apart]
        keep = possible(self.counts, self.chars, i, j)
        found = list(zip(i[keep].tolist(), j[keep].tolist()))
        if self.seen is not None:
            found = [x for x in found if x not in self.seen]
            self.seen.update(found)
        return found

    def ask(self) -> list[tuple[str, str]]:
        """The next pairs to compare; of two groups few at once, MORE times as many as before each time: one link joins them."""
        self.asked, waiting, met, n = [], [], {}, len(self.norms)
        todo = self.waiting
        while True:
            for i, j in todo:
                a, b = int(self.now[i]), int(self.now[j])
                if a == b:
                    continue
                two = (a, b) if a < b else (b, a)
                if met.get(two, 0) < max(1, MORE * self.tried.get(two, 0)):
                    met[two] = met.get(two, 0) + 1
                    self.asked.append((i, j))
                else:
                    waiting.append((i, j))
            if not self.sets or len(self.asked) >= self.share or len(waiting) >= 4 * n:
                break
            todo = self._next()
        self.waiting = waiting
        self.share *= 2
        for two, k in met.items():
            self.tried[two] = self.tried.get(two, 0) + k
        return [(self.norms[i], self.norms[j]) for i, j in self.asked]

    def told(self, found: list[bool]) -> list[tuple]:
        """Links among the pairs asked for that join two groups."""
        out = []
        for (i, j), yes in zip(self.asked, found):
            if yes and self.uf.union(int(self.group[i]), int(self.group[j])):
                out.append((self.digests[i], self.digests[j]))
                self.left -= 1
        if out:
            self.now = np.array([self.uf.find(g) for g in range(int(self.group.max()) + 1)], np.int64)[self.group]
        return out

    @property
    def over(self) -> bool:
        return not self.left or not self.waiting and not self.sets


#: Lines, and characters of them, whose sets are compared together.
TOGETHER, MOST_CHARS = 8192, 1 << 23


def links_of(sets):
    """Lists of links of the sets, whose pairs are compared together in rounds; as sets end others come in."""
    sets, now, more = iter(sets), [], True
    while True:
        lines, chars = sum(len(s.norms) for s in now), sum(s.size for s in now)
        while more and lines < TOGETHER and chars < MOST_CHARS:
            s = next(sets, None)
            more = s is not None
            if more and not s.over:
                now.append(s)
                lines, chars = lines + len(s.norms), chars + s.size
        if not now:
            return
        pairs, at = [], [0]
        for s in now:
            pairs += s.ask()
            at.append(len(pairs))
        found = alike(pairs).tolist()
        yield [link for s, a, b in zip(now, at, at[1:]) for link in s.told(found[a:b])]
        now = [s for s in now if not s.over]


def links(digests: list, groups: list, norms: list) -> list[tuple]:
    """Links between lines of different groups; fewer than lines."""
    return [link for found in links_of([Compared(digests, groups, norms)]) for link in found]


def digests_of(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """128-bit digests, and as two integers each. The first of these is a line's node."""
    found = list(map(xxhash.xxh3_128_digest, lines))
    return found, np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def occurrences(rows: DataFrame) -> DataFrame:
    """rows(id, h, text) -> (id, h, line, node, rest, sim) of every line that is not left alone; sim: its band keys."""
    import pyarrow as pa

    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        from lexspark.llm import line_dedup as own

        for batch in batches:
            lines, count = own.lines_of(batch.column(2).to_pylist())
            kept = np.fromiter(map(len, lines), np.int64, len(lines)) > 0
            owner = np.repeat(np.arange(len(count)), count)
            number = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
            lines = [x for x in lines if x]
            digests, pairs = own.digests_of(lines)
            new = dict(zip(digests, lines))
            keys = own.signatures(list(new.values()))
            place = {d: k for k, d in enumerate(new)}
            data = np.ascontiguousarray(keys[[place[d] for d in digests]]) if digests else keys
            width = 4 * own.BANDS
            sim = pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(np.arange(len(digests) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(data)])
            at = pa.array(owner[kept])
            yield {"id": batch.column(0).take(at), "h": batch.column(1).take(at), "line": number[kept].astype(np.int32), "node": pairs[:, 0], "rest": pairs[:, 1], "sim": sim}

    return common.arrow_map(rows, run, f"id {kind}, h long, line int, node long, rest long, sim binary")


#: What is sent of a line for each band.
ROW = np.dtype([("key", np.uint32), ("node", np.int64)])


def _pack(batches, buckets: int):
    """(part, band, data) of the lines under each band."""
    nodes, sims, waiting = [], [], 0

    def out():
        node, first = np.unique(np.concatenate(nodes), return_index=True)
        keys = np.frombuffer(b"".join(sims), np.uint32).reshape(-1, BANDS)[first]
        rows = np.empty(len(node), ROW)
        rows["node"] = node
        for band in range(BANDS):
            rows["key"] = keys[:, band]
            part = (common.mix64(rows["key"].astype(np.uint64) + np.uint64(band << 32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(buckets + 1))
            own = rows[order]
            used = np.flatnonzero(np.diff(at)).tolist()
            yield {"part": used, "band": [band] * len(used), "data": [own[at[p] : at[p + 1]].tobytes() for p in used]}

    for batch in batches:
        nodes.append(batch.column(0).to_numpy(zero_copy_only=False))
        sims += batch.column(1).to_pylist()
        waiting += batch.num_rows
        if waiting >= GATHER:
            yield from out()
            nodes, sims, waiting = [], [], 0
    if waiting:
        yield from out()


def _near(batches):
    """(a, b, n, band, nodes): sets of the n > 1 nodes that share a key, with a number (a, b) that is a set's own."""
    found: dict[int, list] = {}
    for batch in batches:
        for band, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found.setdefault(band, []).append(np.frombuffer(data, ROW))
    for band in sorted(found):
        rows = np.concatenate(found.pop(band))
        key = rows["key"]
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.append(key[1:] == key[:-1], False)
        twin[1:] |= twin[:-1].copy()
        key, node = key[twin], rows["node"][order[twin]]
        if not len(key):
            continue
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        own = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # copies of a line meet here once a task
        key, node = key[own], node[own].view(np.uint64)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        a, b = (np.add.reduceat(common.mix64(node * np.uint64(m) + np.uint64(m)), head).view(np.int64) for m in (common.BASE, 0xD1B54A32D192ED03))
        many = np.flatnonzero(size > 1)
        nodes = [node[h : h + n].tobytes() for h, n in zip(head[many].tolist(), size[many].tolist())]
        yield {"a": a[many], "b": b[many], "n": size[many], "band": np.full(len(many), band), "nodes": nodes}


def _members(batches):
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        node = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
        yield {"key": np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n), "n": np.repeat(n, n), "band": np.repeat(batch.column(2).to_numpy(zero_copy_only=False), n), "node": node}


def bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of each node, packed: 2^bits / 8 bytes. Parts are united by segment."""
    segments = 64

    def mark(batches):
        there = np.zeros(1 << bits, bool)
        for batch in batches:
            there[batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << bits) - 1)] = True
        rows = np.packbits(there).reshape(segments, -1)
        used = np.flatnonzero(rows.any(1)).tolist()
        yield {"segment": used, "bits": [rows[i].tobytes() for i in used]}

    def unite(batches):
        found: dict = {}
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(data, np.uint8)
                found[i] = found[i] | data if i in found else data
        yield {"segment": list(found), "bits": [x.tobytes() for x in found.values()]}

    parts = common.arrow_map(nodes.select("node"), mark, "segment int, bits binary").repartition(segments, "segment")
    out = np.zeros((segments, (1 << (bits - 3)) // segments), np.uint8)
    for r in common.arrow_map(parts, unite, "segment int, bits binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _texts(rows: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """(node, rest, norm): the distinct lines whose node has a bit in `wanted`: those asked for and a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        from lexspark.llm import line_dedup as own

        there, mask, seen = shared.value, (1 << bits) - 1, set()
        for batch in batches:
            lines = list(dict.fromkeys(own.lines_of(batch.column(0).to_pylist())[0]))
            digests, pairs = own.digests_of(lines)
            low = pairs[:, 0] & mask
            hit = [k for k in np.flatnonzero(there[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).tolist() if lines[k] and digests[k] not in seen]
            seen.update([digests[k] for k in hit])
            if len(seen) > 300_000:
                seen = set()
            yield {"node": pairs[hit, 0], "rest": pairs[hit, 1], "norm": [lines[k].decode("utf-8") for k in hit]}

    return common.arrow_map(rows.select("text"), run, "node long, rest long, norm string").dropDuplicates(["node", "rest"])


def _sets(batches):
    """rows(key, pair, digest, root, norm, sets) sorted by key and pair -> the lines of each with their sets."""
    now, part = None, ([], [], [], [], [])

    def whole():
        members: dict = {}
        for k, own in enumerate(part[4]):
            for x in own:
                members.setdefault(x, []).append(k)
        return Compared(*part[:3], [x for x in members.values() if len(x) > 1], part[3])

    for batch in batches:
        key, pair = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        digests, roots, norms, sets = (c.to_pylist() for c in batch.columns[2:])
        counts = [row for a in range(0, len(norms), 64) for row in cell_counts(norms[a : a + 64])]
        columns = (digests, roots, norms, counts, sets)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(key)]
        for first, stop in zip(edges, edges[1:]):
            if first < stop and (key[first], pair[first]) != now:
                yield whole()
                now, part = (key[first], pair[first]), ([], [], [], [], [])
            for column, values in zip(part, columns):
                column += values[first:stop]
    yield whole()


def _verify(batches):
    """rows(key, pair, digest, root, norm, sets) sorted by key and pair -> links (a, b)."""
    for found in links_of(_sets(batches)):
        yield {"a": [a for a, _ in found], "b": [b for _, b in found]}


#: A line's digest as the components know it.
DIGEST = "unhex(concat(lpad(hex(node), 16, '0'), lpad(hex(rest), 16, '0')))"


def _rooted(texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """texts with their digest and their group's smallest one, which is in two integers too."""
    texts = texts.withColumn("digest", F.expr(DIGEST))
    if roots is None:
        return texts.selectExpr("*", "digest as root", "node as root_node", "rest as root_rest")
    half = lambda i: F.conv(F.substring(F.hex("root"), 1 + 16 * i, 16), 16, -10).cast("long")
    texts = texts.join(roots.select(F.col("a").alias("digest"), F.col("b").alias("root")), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    return texts.select("*", half(0).alias("root_node"), half(1).alias("root_rest"))


def _round(cells: DataFrame, texts: DataFrame, roots: DataFrame | None, partitions: int) -> DataFrame:
    """Links (a, b) between groups: of the first bands' sets without roots, else of all that is open."""
    texts = _rooted(texts, roots)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), chunks).cast("int")
    if roots is None:
        todo = cells.where(F.col("band") < FIRST).select("key", own.cast("long").alias("pair"), "node", F.array("key").alias("sets"))
    else:
        texts = common.materialize(texts, "rooted")
        part = cells.where((F.col("band") >= FIRST) | (F.col("n") > CHUNK))
        ends = [F.min("root_node") != F.max("root_node"), F.min("root_rest") != F.max("root_rest")]
        open_ = part.join(texts.select("node", "root_node", "root_rest"), "node").groupBy("key").agg((ends[0] | ends[1]).alias("open"), F.min("node").alias("lead")).where("open").select("key", "lead")
        todo = part.join(common.materialize(open_, "open"), "key")
        small = todo.where(F.col("n") <= SMALL).groupBy(F.col("lead").alias("key"), F.lit(-1).cast("long").alias("pair"), "node").agg(F.collect_list("key").alias("sets"))
        todo = todo.where(F.col("n") > SMALL).withColumn("other", F.explode(F.when(chunks <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))))
        todo = todo.withColumn("pair", F.least(own, "other").cast("long") * (1 << 31) + F.greatest(own, F.col("other")))
        todo = small.unionByName(todo.select("key", "pair", "node", F.array("key").alias("sets")))
    todo = todo.join(texts.select("node", "digest", "root", "norm"), "node").select("key", "pair", "digest", "root", "norm", "sets")
    todo = todo.repartition(partitions, "key", "pair").sortWithinPartitions("key", "pair", "digest")

    def verify(batches):
        from lexspark.llm import line_dedup

        yield from line_dedup._verify(batches)

    return common.materialize(common.arrow_map(todo, verify, "a binary, b binary"), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences (id, h, line, node, rest), and (node, rest, copies, root) of lines that occur or are linked more than once.

    h: the hash of the row's text; node, rest: a line's digest; root: the smallest digest of the group.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    if not rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "h"])
    found = common.materialize(occurrences(rows), "lines")
    partitions = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() * BANDS * ROW.itemsize >> 26)

    def pack(batches):
        from lexspark.llm import line_dedup

        yield from line_dedup._pack(batches, partitions)

    def near(batches):
        from lexspark.llm import line_dedup

        yield from line_dedup._near(batches)

    def members(batches):
        from lexspark.llm import line_dedup

        yield from line_dedup._members(batches)

    packed = common.arrow_map(found.select("node", "sim"), pack, "part int, band int, data binary").repartition(partitions, "part")
    sets = common.arrow_map(packed, near, "a long, b long, n long, band int, nodes binary")
    sets = sets.groupBy("a", "b").agg(F.first("n").alias("n"), F.min("band").alias("band"), F.first("nodes").alias("nodes")).select(F.col("a").alias("key"), "n", "band", "nodes")
    cells = common.materialize(common.arrow_map(sets, members, "key long, n long, band int, node long"), "cells")
    bits = min(MOST_BITS, max(16, int(4 * cells.count()).bit_length()))
    texts = common.materialize(_texts(rows, bitmap(cells, bits), bits), "texts")
    first = _round(cells, texts, None, partitions)
    second = _round(cells, texts, common.components(first), partitions)
    roots = common.components(first.unionByName(second))
    for df in (cells, texts, first, second):
        common.discard(df)
    lines = found.select("id", "h", "line", "node", "rest")
    each = lines.groupBy("node", "rest").agg(F.count("*").alias("copies"))
    digest = [F.conv(F.substring(F.hex("digest"), 1 + 16 * i, 16), 16, -10).cast("long").alias(name) for i, name in enumerate(("node", "rest"))]
    linked = roots.select(F.col("a").alias("digest"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("digest"), F.col("b").alias("root")).distinct()).select(*digest, "root")
    named = each.join(linked, ["node", "rest"], "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", F.expr(DIGEST)))
    return lines, common.materialize(named, "groups")


def marked(lines: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, h, line, root, gone) of the lines in groups; gone: whether the line is dropped, as every one but the first is."""
    total = lines.count()
    own = common.materialize(common.split_join(lines, grouped, ["node", "rest"], "copies", total, "inner").select("id", "h", "line", "root"), "own")
    first = own.groupBy("root").agg(F.min(F.struct("id", "h", "line")).alias("first"), F.count("*").alias("n"))
    out = common.split_join(own, common.materialize(first, "first"), ["root"], "n", total, "inner")
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")) & (F.col("first.line") == F.col("line"))
    return out.select("id", "h", "line", "root", (~is_first).alias("gone"))


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lines): numbers of the lines that each row loses; only rows that lose some."""
    out = marked(*groups(docs, id_col, text_col)).where("gone")
    return common.materialize(out.groupBy("id", "h").agg(F.sort_array(F.collect_list("line")).alias("lines")), "dropped")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns, the text without its dropped lines."""
    i, h, gone, key = common.free_names(docs, "id", "h", "lines", "key")
    lost = dropped(docs, id_col, text_col).select(F.col("id").alias(i), F.col("h").alias(h), F.col("lines").alias(gone))
    joined = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    joined = joined.join(lost, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(key) == F.col(h)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, n: ~F.array_contains(gone, n))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_groups, n_dropped, class_ids), a row for each row of docs.

    n_lines: lines that count; n_groups: those in groups of over one occurrence; class_ids:
    the distinct groups, each by the digest of its smallest line; n_dropped: lines that go.
    """
    lines, grouped = groups(docs, id_col, text_col)
    per = marked(lines, grouped).groupBy("id", "h").agg(F.count("*").alias("n_groups"), F.count_if("gone").alias("n_dropped"), F.sort_array(F.collect_set(F.lower(F.hex("root")))).alias("class_ids"))
    all_ = lines.groupBy("id", "h").agg(F.count("*").alias("n_lines"))
    out = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"))
    for i, part in enumerate((all_, per)):
        part = part.withColumnsRenamed({"id": f"id{i}", "h": f"h{i}"})
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col(f"id{i}")) & (F.col("key") == F.col(f"h{i}")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_lines"), zero("n_groups"), zero("n_dropped"), F.coalesce("class_ids", F.array().cast("array<string>")).alias("class_ids"))
