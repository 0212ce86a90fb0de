"""Structural features of roots, from their radicals alone. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions import text

#: Symbols of a signature, and letters by kind (fixed values).
SYMBOLS = {"נ": "N", "י": "Y", "ו": "W", "ה": "H", "א": "A", "ח": "X", "ע": "E", "ר": "R"}
GUTTURALS = ["א", "ה", "ח", "ע"]


def split_units(root: Column) -> Column:
    """Radicals of a root string: a letter and its dot, if any."""
    return F.regexp_extract_all(root, F.lit("(?s)(?:^[ׁׂ]|.)[ׁׂ]*"), F.lit(0))


def bare(radicals: Column) -> Column:
    """Radicals without dots, finals as regular letters."""
    return F.transform(radicals, lambda r: text.normalize_finals(F.regexp_replace(r, "[ׁׂ]", "")))


def orthographic(root: Column) -> Column:
    return F.array_join(bare(split_units(root)), "")


def bare_key(dotted: Column) -> Column:
    """Letters of dashed radicals; empty or NULL gives NULL."""
    return F.nullif(F.array_join(bare(F.split(dotted, "-")), ""), F.lit(""))


def content_id(prefix: str, key: Column) -> Column:
    """A prefix and the first ten digits of the key's sha1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(key.cast("binary")), 1, 10))


def root_id(root: Column, prefix: str = "RT-") -> Column:
    return content_id(prefix, F.concat(F.lit("root|"), root))


def features(radicals: Column) -> dict[str, Column]:
    """Named columns over an array of radicals (three at least): letters, kinds, signature, class."""
    r = bare(radicals)
    at = lambda i: F.get(r, F.lit(i))
    n = F.size(r)
    r1, r2, r3, tri = at(0), at(1), at(2), F.size(r) == 3
    last = F.element_at(r, -1)
    geminate = tri & (r2 == r3)
    four = (n == 4) & (r1 == r3) & F.coalesce(r2 == at(3), F.lit(False))
    any_guttural = F.exists(r, lambda x: x.isin(GUTTURALS))
    weak = r1.isin("נ", "י", "ו", "א") | r2.isin("ו", "י") | r3.isin("ה", "י", "א") | geminate
    table = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    signature = F.concat(F.array_join(F.transform(r, lambda x: F.coalesce(table[x], F.lit("C"))), "."), F.when(geminate, "+GEM").otherwise(""))
    out = {f"radical_{i + 1}": at(i) for i in range(5)} | {"root_length": n.cast("long")}
    out |= {"r1_is_nun": r1 == "נ", "r1_is_yod": r1 == "י", "r1_is_waw": r1 == "ו", "r1_is_alef": r1 == "א", "r2_is_yod": r2 == "י", "r2_is_waw": r2 == "ו"}
    out |= {"r3_is_he": r3 == "ה", "r3_is_yod": r3 == "י", "r3_is_alef": r3 == "א", "rfinal_is_he": last == "ה"}
    out |= {f"r{i + 1}_is_guttural": x.isin(GUTTURALS) for i, x in enumerate((r1, r2, r3))}
    out |= {"has_resh": F.array_contains(r, "ר"), "is_geminate": geminate, "is_reduplicated_quadriliteral": four, "has_weak_radical": weak, "structural_signature": signature}
    classes = {"quadriliteral": n >= 4, "geminate": geminate, "hollow_candidate": tri & r2.isin("ו", "י"), "final_he": tri & (r3 == "ה"), "initial_nun": r1 == "נ", "initial_yod_waw": r1.isin("י", "ו")}
    out |= {f"sc_{k}": v for k, v in classes.items()} | {"sc_guttural_containing": any_guttural, "sc_strong": tri & ~weak & ~any_guttural}
    order = classes | {"final_alef": tri & (r3 == "א"), "initial_alef": r1 == "א", "guttural_containing": any_guttural}
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in order.items()], F.lit("strong"))
    out["structural_class"] = F.when(n < 3, F.raise_error(F.concat(F.lit("root too short: "), F.array_join(r, "-")))).otherwise(first)
    return out


def stable_radicals(radicals: Column) -> Column:
    """Radicals that show in the written citation form of every class."""
    r = bare(radicals)
    n = F.size(r)
    hidden = lambda x, i: ((i == 0) & x.isin("נ", "י", "ו")) | ((i == 1) & (n == 3) & x.isin("ו", "י")) | ((i == n - 1) & x.isin("ה", "י")) | ((i == 2) & (n == 3) & F.coalesce(F.get(r, F.lit(1)) == F.get(r, F.lit(2)), F.lit(False)))
    return F.filter(r, lambda x, i: ~hidden(x, i))


def is_subsequence(needles: Column, hay: Column) -> Column:
    """Whether letters occur in a string in this order."""
    def step(left, x):
        at = F.position(x, left)
        return F.when(at > 0, F.substr(left, at + 1))

    return F.aggregate(needles, hay, step).isNotNull()


def shin_dots(form: Column) -> Column:
    """Dots that letters shin of a pointed form carry, as a sorted array."""
    marks = F.array_join(F.regexp_extract_all(form, F.lit("ש([^א-ת]*)"), F.lit(1)), "")
    return F.sort_array(F.array_distinct(F.regexp_extract_all(marks, F.lit("([ׁׂ])"), F.lit(1))))


def resolve_shin(root: Column, variants: Column, lemma: Column) -> Column:
    """struct(radicals, method, flags): which dot each shin radical has.

    A source's dot counts first (several: conflict), else the lemma's if all its shins agree. variants: array of
    dashed radicals.
    """
    letters, dots = text.characters(root), shin_dots(F.coalesce(lemma, F.lit("")))
    own = F.when(F.size(dots) == 1, F.get(dots, F.lit(0)))

    def decide(x, i):
        unit = lambda v: F.coalesce(F.get(F.split(v, "-"), i), F.lit(""))
        given = F.array_distinct(F.filter(F.transform(variants, lambda v: F.substring(unit(v), 2, 1)), lambda d: d != ""))
        dot = F.when(F.size(given) == 1, F.get(given, F.lit(0))).when(F.size(given) == 0, own)
        method = F.when(F.size(given) == 1, "SOURCE").when((F.size(given) == 0) & own.isNotNull(), "FORM").otherwise("UNRESOLVED")
        flag = (
            F.when(F.size(given) > 1, "SHIN_SIN_CONFLICT_IN_SOURCES")
            .when((F.size(given) == 1) & (F.size(dots) > 0) & ~F.array_contains(dots, F.coalesce(F.get(given, F.lit(0)), F.lit(""))), "SHIN_SIN_MISMATCH")
            .when((F.size(given) == 0) & own.isNotNull(), "SHIN_SIN_FROM_FORM")
            .when(F.size(given) == 0, "SHIN_SIN_UNRESOLVED")
        )
        shin = x == "ש"
        return F.struct(F.when(shin, F.concat(x, F.coalesce(dot, F.lit("")))).otherwise(x).alias("r"), F.when(shin, method).alias("m"), F.when(shin, flag).alias("f"))

    found = F.transform(letters, decide)
    methods = F.array_distinct(F.array_compact(F.transform(found, lambda s: s["m"])))
    method = F.when(F.size(methods) == 0, "NA").when(F.size(methods) == 1, F.get(methods, F.lit(0))).otherwise("MIXED")
    return F.struct(F.transform(found, lambda s: s["r"]).alias("radicals"), method.alias("method"), F.sort_array(F.array_distinct(F.array_compact(F.transform(found, lambda s: s["f"])))).alias("flags"))
