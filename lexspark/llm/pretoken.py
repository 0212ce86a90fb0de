"""Pre-token boundaries by codepoint classes and an associative scan of transition functions.

A text is an array of codepoints. Each codepoint has a class, each class a transition
function over the states of a small automaton, and functions compose associatively, so the
state before every codepoint comes from a doubling scan over function names. Almost every
class resets the automaton (a constant function), hence the scan ends after a few doublings.
States and classes then say where a pre-token starts. No regular expression is used.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Classes of codepoints.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, RV, ELL, EE = range(10)
N_CLASSES = 10
# States: the kind of what was read last. FRESH: nothing, or white space that joins nothing.
FRESH, AFTER_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, AT_RV, AT_ELL, SUFFIX1, SUFFIX2 = range(10)
N_STATES = 10

#: Unicode White_Space (fixed values).
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each of the 0x110000 codepoints."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            out[cp] = kind
    out[list(WHITE_SPACE)] = WHITE
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        out[ord(c)] = ONE
    for c in "rv":
        out[ord(c)] = RV
    out[ord("l")], out[ord("e")] = ELL, EE
    return out


def _next(state: int, cls: int) -> int:
    if cls == SPACE:
        return AFTER_SPACE
    if cls == WHITE:
        return FRESH
    if cls == NUMBER:
        return IN_NUMBERS
    if cls == QUOTE:  # a quote after a space or other signs is one of them
        return IN_OTHERS if state in (AFTER_SPACE, IN_OTHERS, AT_QUOTE) else AT_QUOTE
    if cls == OTHER:
        return IN_OTHERS
    if state == AT_QUOTE:
        return {ONE: SUFFIX1, RV: AT_RV, ELL: AT_ELL}.get(cls, IN_LETTERS)
    if state == AT_RV and cls == EE or state == AT_ELL and cls == ELL:
        return SUFFIX2
    return IN_LETTERS


def _begins(state: int, cls: int) -> bool:
    """Whether a codepoint that isn't white space starts a pre-token; corrected for two-letter suffixes later."""
    if state == AFTER_SPACE:
        return False  # the space does
    if cls == NUMBER:
        return state != IN_NUMBERS
    if cls in (OTHER, QUOTE):
        return state not in (IN_OTHERS, AT_QUOTE)
    if state == AT_QUOTE:
        return cls != ONE
    return state not in (IN_LETTERS, AT_RV, AT_ELL)


@lru_cache(maxsize=1)
def machine():
    """Names of the functions that arise by composition, their values, and the table of compositions."""
    base = [tuple(_next(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    first = [(f[FRESH],) * N_STATES for f in base]  # at the start of a text
    names: dict[tuple, int] = {}
    todo = [*base, *first]
    while todo:
        f = todo.pop()
        if f in names:
            continue
        names[f] = len(names)
        for g in [*base, *first]:
            todo.append(tuple(g[s] for s in f))
    functions = list(names)
    compose = np.array([[names.get(tuple(g[s] for s in f), 0) for g in functions] for f in functions], np.uint8)
    values = np.array(functions, np.uint8)
    constant = (values == values[:, :1]).all(1)
    symbol = np.array([names[f] for f in base], np.uint8)
    begin = np.array([names[f] for f in first], np.uint8)
    starts = np.array([[_begins(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)])
    return symbol, begin, compose, values, constant, starts


def starts_of(cp: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Boolean starts of pre-tokens in concatenated codepoints; heads: offsets at which (nonempty) texts start."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    symbol, begin, compose, values, constant, table = machine()
    cls = classes[cp]
    scan = symbol[cls]
    scan[heads] = begin[cls[heads]]
    flat, k = compose.ravel(), len(compose)
    step = 1
    open_ = np.flatnonzero(~constant[scan])  # positions whose composed function still depends on what stands before
    while len(open_):
        # All reads precede the writes, as in a doubling scan; a constant on the right absorbs what comes before.
        scan[open_] = flat[scan[open_ - step].astype(np.int64) * k + scan[open_]]
        step *= 2
        open_ = open_[~constant[scan[open_]]]
    after = values[scan, 0]
    before = np.empty_like(after)
    before[0] = FRESH
    before[1:] = after[:-1]
    before[heads] = FRESH
    out = table[before, cls]
    double = np.flatnonzero(after == SUFFIX2)
    out[double] = False
    out[double - 1] = False
    # White space: a run starts a pre-token, and its last codepoint another if the text goes on after it.
    white = cls <= WHITE
    last = np.empty(n, bool)  # the next codepoint exists in this text and isn't white
    last[:-1] = ~white[1:]
    last[-1] = False
    last[heads[1:] - 1] = False
    inside = np.empty(n, bool)  # the one before is white space of the same text
    inside[0] = False
    inside[1:] = white[:-1]
    inside[heads] = False
    out[white] = (~inside | last)[white]
    out[heads] = True
    return out


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts together, byte offsets of pre-token starts with the end appended, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    data = joined.encode("utf-8")
    counts = np.zeros(len(texts), np.int64)
    if not joined:
        return data, np.zeros(1, np.int64), counts
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    heads = (ends - lengths)[lengths > 0]
    start = starts_of(cp, heads, class_table())
    where = np.flatnonzero(start)
    counts = np.searchsorted(where, ends) - np.searchsorted(where, ends - lengths)
    if len(data) != len(cp):
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        where = (np.cumsum(width) - width)[where]
    return data, np.append(where, len(data)), counts
