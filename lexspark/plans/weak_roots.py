"""Synthetic paradigms of all tenses whose weak roots rewrite the patterns of strong ones.

What a weak root does to a pattern depends on its kind, the class and the cell, never on its other letters. So patterns are
rewritten once for each kind, which gives a small dimension (six kinds, seven classes, up to 27 cells); forms are a join of
roots with it on the kind, and a replacement of slots.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import features, text
from lexspark.plans import equations, synth

# Kinds of roots, and stems and endings of the present, future and imperative of the strong root.
KINDS = ["STRONG", "PE_NUN", "PE_YOD", "LAMED_HE", "HOLLOW", "GEMINATE"]
PASSIVE, PREFIXED = ["PUAL", "HUFAL"], ["NIFAL", "HIFIL", "HUFAL"]
PRESENT = {  # masculine, feminine, before plural endings
    "PAAL": ("1וֹ2ֵ3", "1וֹ2ֶ3ֶת", "1וֹ2ְ3"),
    "NIFAL": ("נִ1ְ2ָ3", "נִ1ְ2ֶ3ֶת", "נִ1ְ2ָ3"),
    "PIEL": ("מְ1ַ2ֵּ3", "מְ1ַ2ֶּ3ֶת", "מְ1ַ2ְּ3"),
    "PUAL": ("מְ1ֻ2ָּ3", "מְ1ֻ2ֶּ3ֶת", "מְ1ֻ2ָּ3"),
    "HIFIL": ("מַ1ְ2ִי3", "מַ1ְ2ִי3ָה", "מַ1ְ2ִי3"),
    "HUFAL": ("מֻ1ְ2ָ3", "מֻ1ְ2ֶ3ֶת", "מֻ1ְ2ָ3"),
    "HITPAEL": ("מִתְ1ַ2ֵּ3", "מִתְ1ַ2ֶּ3ֶת", "מִתְ1ַ2ְּ3"),
}
FUTURE = {  # vowel of the prefix, the same in the first person, stems without ending, before a vowel, before na
    "PAAL": ("ִ", "ֶ", "1ְ2ֹ3", "1ְ2ְ3", "1ְ2ֹ3ְ"),
    "NIFAL": ("ִ", "ֵ", "1ָּ2ֵ3", "1ָּ2ְ3", "1ָּ2ַ3ְ"),
    "PIEL": ("ְ", "ֲ", "1ַ2ֵּ3", "1ַ2ְּ3", "1ַ2ֵּ3ְ"),
    "PUAL": ("ְ", "ֲ", "1ֻ2ַּ3", "1ֻ2ְּ3", "1ֻ2ַּ3ְ"),
    "HIFIL": ("ַ", "ַ", "1ְ2ִי3", "1ְ2ִי3", "1ְ2ֵ3ְ"),
    "HUFAL": ("ֻ", "ֻ", "1ְ2ַ3", "1ְ2ְ3", "1ְ2ַ3ְ"),
    "HITPAEL": ("ִ", "ֶ", "תְ1ַ2ֵּ3", "תְ1ַ2ְּ3", "תְ1ַ2ֵּ3ְ"),
}
PREFIXES = {"1SG": "א", "2MSG": "תּ", "2FSG": "תּ", "3MSG": "י", "3FSG": "תּ", "1PL": "נ", "2MPL": "תּ", "2FPL": "תּ", "3MPL": "י", "3FPL": "תּ"}
ENDINGS = {"2FSG": "ִי", "2MPL": "וּ", "3MPL": "וּ", "2FPL": "נָה", "3FPL": "נָה"}
#: Prefix of the imperative, and stems where they are not those of the future. Passive classes have none.
IMPERATIVE = {"PAAL": ("", "1ְ2ֹ3", "1ִ2ְ3", "1ְ2ֹ3ְ"), "NIFAL": ("הִ",), "PIEL": ("",), "HIFIL": ("הַ", "1ְ2ֵ3", "1ְ2ִי3", "1ְ2ֵ3ְ"), "HITPAEL": ("הִ",)}
#: Consonants that no rule touches.
PLAIN = ["ב", "ג", "ד", "ז", "ט", "כ", "ל", "מ", "ס", "פ", "צ", "ק", "ר", "שׁ", "ת"]

VOWELS = text.HIRIQ + text.TSERE + text.SEGOL + text.PATAH + text.QAMATS + text.HOLAM + text.QUBUTS + text.QAMATS_QATAN
REDUCED = text.SHEVA + text.HATAF_SEGOL + text.HATAF_PATAH + text.HATAF_QAMATS
MARK = f"[{VOWELS}{REDUCED}{text.DAGESH}{text.SHIN_DOT}{text.SIN_DOT}]"
#: A pattern: what comes before the first radical, radicals with their marks, waw between the first two, yod between the last two, the rest.
SHAPE = re.compile(f"(?P<head>[^123]*)(?P<r1>1)(?P<m1>{MARK}*)(?P<waw>(?:ו{MARK}*)?)(?P<r2>2)(?P<m2>{MARK}*)(?P<yod>י?)(?P<r3>3)(?P<m3>{MARK}*)(?P<tail>.*)")


def strong_patterns(tenses: tuple[str, ...] = ("PST", "PRS", "FUT", "IMP")) -> dict[tuple[str, str], str]:
    """(class, cell) -> pattern of a strong root."""
    out = {}
    for name in features.CLASSES:
        masculine, feminine, plural = PRESENT[name]
        vowel, first, *stems = FUTURE[name]

        def stem(of: list, ending: str) -> str:
            return of[0] if not ending else of[2] + ending if ending == "נָה" else of[1] + ending

        if "PST" in tenses:
            out |= {(name, cell): p for cell, p in synth.past_patterns(name).items()}
        if "PRS" in tenses:
            out |= {(name, f"PRS.{c}"): p for c, p in {"MSG": masculine, "FSG": feminine, "MPL": plural + "ִים", "FPL": plural + "וֹת"}.items()}
        if "FUT" in tenses:
            out |= {(name, f"FUT.{c}"): p + (first if c == "1SG" else vowel) + stem(stems, ENDINGS.get(c, "")) for c, p in PREFIXES.items()}
        if "IMP" in tenses and name in IMPERATIVE:
            prefix, *own = IMPERATIVE[name]
            out |= {(name, f"IMP.{c}"): prefix + stem(own or stems, ENDINGS.get(c, "")) for c in PREFIXES if c[0] == "2"}
    return {k: unicodedata.normalize("NFC", p) for k, p in out.items()}


def _vowel(marks: str) -> str:
    return "".join(c for c in marks if c in VOWELS)[:1]


def _with(marks: str, vowel: str) -> str:
    """Marks with another vowel."""
    return "".join(c for c in marks if c not in VOWELS + REDUCED) + vowel


def _doubled(marks: str) -> str:
    return text.DAGESH + marks.replace(text.DAGESH, "")


def _first_vanishes(p: dict) -> bool:
    """A first radical without a full vowel, behind a prefix."""
    return p["head"] != "" and _vowel(p["m1"]) == ""


def _pe_nun(p: dict, name: str, cell: str) -> dict:
    return {"r1": "", "m1": "", "m2": _doubled(p["m2"])} if _first_vanishes(p) else {}


def _pe_yod(p: dict, name: str, cell: str) -> dict:
    if not _first_vanishes(p):
        return {}
    if name in PREFIXED and re.fullmatch(f".{MARK}*", p["head"]):
        return {"head": p["head"][0], "r1": "ו", "m1": text.HOLAM}
    return {"head": re.sub(f"{MARK}*$", lambda m: _with(m[0], text.TSERE), p["head"], count=1), "r1": "", "m1": ""}


def _lamed_he(p: dict, name: str, cell: str) -> dict:
    past = cell.startswith("PST")
    if p["tail"] == "":
        return {"yod": "", "r3": "ה", "m3": "", "m2": _with(p["m2"], text.QAMATS if past else text.SEGOL)}
    if not _vowel(p["m3"]) and not re.match(f"ו{MARK}*[{text.DAGESH}{text.HOLAM}]", p["tail"]):
        vowel = text.SEGOL if not past else text.TSERE if name in [*PASSIVE, "NIFAL"] else text.HIRIQ
        soft = re.sub(f"^.{MARK}*", lambda m: m[0].replace(text.DAGESH, ""), p["tail"])
        return {"yod": "", "r3": "י", "m3": "", "m2": _with(p["m2"], vowel), "tail": soft}
    if cell == "PST.3FSG":
        return {"yod": "", "r3": "ת", "m3": _vowel(p["m3"]), "m2": _with(p["m2"], text.SHEVA)}
    return {"yod": "", "r3": "", "m3": "", "m2": _with(p["m2"], _vowel(p["m3"]))}


def _hollow(p: dict, name: str, cell: str) -> dict:
    vowel = text.QAMATS if p["waw"] else _vowel(p["m2"])
    return {"waw": "", "r2": "", "m2": "", "m1": _with(p["m1"], vowel) if vowel else p["m1"]}


def _geminate(p: dict, name: str, cell: str) -> dict:
    return _hollow(p, name, cell) | ({"m3": _doubled(p["m3"])} if p["tail"] else {})


RULES = {"STRONG": lambda p, name, cell: {}, "PE_NUN": _pe_nun, "PE_YOD": _pe_yod, "LAMED_HE": _lamed_he, "HOLLOW": _hollow, "GEMINATE": _geminate}


def rewritten(pattern: str, kind: str, name: str, cell: str) -> str:
    """The pattern of a class and cell for roots of a kind."""
    parts = SHAPE.fullmatch(pattern).groupdict()
    return "".join((parts | RULES[kind](parts, name, cell)).values())


def patterns(spark: SparkSession, tenses: tuple[str, ...] = ("PST", "PRS", "FUT", "IMP")) -> DataFrame:
    """(kind, binyan, cell, pattern): the dimension."""
    rows = [(kind, name, cell, rewritten(p, kind, name, cell)) for (name, cell), p in strong_patterns(tenses).items() for kind in KINDS]
    return spark.createDataFrame(rows, "kind string, binyan string, cell string, pattern string")


def kind_of(r1: Column, r2: Column, r3: Column) -> Column:
    a, b, c = (F.left(r, F.lit(1)) for r in (r1, r2, r3))
    return F.when(b == c, "GEMINATE").when(b.isin("ו", "י"), "HOLLOW").when(c == "ה", "LAMED_HE").when(a == "נ", "PE_NUN").when(a == "י", "PE_YOD").otherwise("STRONG")


def realize(roots: DataFrame, dimension: DataFrame) -> DataFrame:
    """roots(root, r1, r2, r3) with their kind, class, cell and form."""
    form = F.col("pattern")
    for i in (1, 2, 3):
        form = F.replace(form, F.lit(str(i)), F.col(f"r{i}"))
    out = roots.withColumn("kind", kind_of(F.col("r1"), F.col("r2"), F.col("r3"))).join(F.broadcast(dimension), "kind")
    return out.withColumn("form", text.apply_finals(text.nfc(form))).drop("pattern")


def balanced_roots(spark: SparkSession, n: int, weak: float, seed: int, kinds: list[str] = KINDS[1:], letters: list[str] = PLAIN) -> DataFrame:
    """(root, r1, r2, r3, place): n different roots, a share of them weak and evenly of the kinds, in an order drawn by the seed.

    Draws come from one seeded generator, a root is drawn anew if it is there already: sequential, for the small n of such tables.
    """
    rng = np.random.default_rng(seed)
    weak_n = round(weak * n)
    fixed = {"PE_NUN": (0, "נ"), "PE_YOD": (0, "י"), "LAMED_HE": (2, "ה"), "HOLLOW": (1, "ו")}
    found: dict[str, list[str]] = {}
    for kind in ["STRONG"] * (n - weak_n) + [kinds[i % len(kinds)] for i in range(weak_n)]:
        size = len(found)
        while len(found) == size:
            r = [letters[i] for i in rng.choice(len(letters), 3, replace=False).tolist()]
            if kind in fixed:
                r[fixed[kind][0]] = fixed[kind][1]
            elif kind == "GEMINATE":
                r[2] = r[1]
            found.setdefault("".join(r), r)
    names = list(found)
    rows = [(names[i], *found[names[i]], k) for k, i in enumerate(rng.permutation(n).tolist())]
    return spark.createDataFrame(rows, "root string, r1 string, r2 string, r3 string, place int")


def weak_table(spark: SparkSession, n: int, weak: float, seed: int, tenses: tuple[str, ...] = ("PST", "PRS", "FUT", "IMP")) -> DataFrame:
    """The equation table of a balanced set of roots, with the kind of each as an analysis column."""
    forms = realize(balanced_roots(spark, n, weak, seed), patterns(spark, tenses))
    table = equations.equation_table(forms, seed)
    kinds = forms.select(F.col("root").alias("analysis__root"), F.col("kind").alias("analysis__kind")).distinct()
    table = table.join(F.broadcast(kinds), "analysis__root").withColumn("target_unv", text.strip_points(F.col("target_voc")))
    return table.withColumn("analysis__tense", F.substring_index("analysis__cell", ".", 1))
