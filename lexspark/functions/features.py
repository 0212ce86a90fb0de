"""Feature tags of verb forms: parsing, cells, violations, conversions. Built-in expressions only.

"NA" is a value (not expressed) and different from NULL (unknown); it is never mapped to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes, cells and their order.
CLASSES = ["PAAL", "NIFAL", "PIEL", "PUAL", "HIFIL", "HUFAL", "HITPAEL"]
PAST_CELLS = ["PST.1SG", "PST.2MSG", "PST.2FSG", "PST.3MSG", "PST.3FSG", "PST.1PL", "PST.2MPL", "PST.2FPL", "PST.3PL"]
PRESENT_CELLS = ["PRS.MSG", "PRS.FSG", "PRS.MPL", "PRS.FPL"]
FUTURE_CELLS = ["FUT.1SG", "FUT.2MSG", "FUT.2FSG", "FUT.3MSG", "FUT.3FSG", "FUT.1PL", "FUT.2MPL", "FUT.2FPL", "FUT.3MPL", "FUT.3FPL"]
IMPERATIVE_CELLS = ["IMP.2MSG", "IMP.2FSG", "IMP.2MPL", "IMP.2FPL"]
CELL_ORDER = [*PAST_CELLS, *PRESENT_CELLS, *FUTURE_CELLS, *IMPERATIVE_CELLS, "NFIN", "MSDR"]
CITATION_CELL = "PST.3MSG"
NA = "NA"
KNOWN = ["PST", "PRS", "FUT", "IMP", "1", "2", "3", "SG", "PL", "MASC", "FEM", "NFIN"]


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


def cell_rank(cell: Column) -> Column:
    """Place of a cell in the order of a paradigm; 999 for any other."""
    at = F.array_position(_lits(CELL_ORDER), cell)
    return F.when(at > 0, at - 1).otherwise(999).cast("int")


def is_verb_tag(tag: Column) -> Column:
    return (tag == "V.MSDR") | tag.startswith("V;")


def is_gap(form: Column, tag: Column) -> Column:
    """A cell that the source marks as non-existent by a dash."""
    return F.trim(form).isin("-", "–", "—") & tag.startswith("V")


def parse_tag(tag: Column) -> Column:
    """Struct of a tag's features, cell and tag_error; where there is an error the features are NULL."""
    tag = F.regexp_replace(tag, r"^\s+|\s+$", "")
    parts = F.split(tag, ";")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    unknown = F.filter(rest, lambda p: ~p.isin(*KNOWN))
    masdar = tag == "V.MSDR"
    error = (
        F.when(masdar, F.lit(None))
        .when(F.get(parts, F.lit(0)) != "V", F.concat(F.lit("not a verb tag: "), tag))
        .when(F.size(F.array_distinct(rest)) < F.size(rest), F.concat(F.lit("repeated feature in "), tag))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown feature "), F.try_element_at(unknown, F.lit(1)), F.lit(" in "), tag))
    )
    last = lambda names: F.coalesce(F.try_element_at(F.filter(rest, lambda p: p.isin(*names)), F.lit(-1)), F.lit(NA))
    tense, person, number, gender = last(["PST", "PRS", "FUT"]), last(["1", "2", "3"]), last(["SG", "PL"]), last(["MASC", "FEM"])
    na = lambda c: F.when(masdar, F.lit(NA)).otherwise(c)
    mood = F.when(F.array_contains(rest, "IMP"), "IMP").when(tense != NA, "IND").otherwise(NA)
    finite = F.when(masdar | F.array_contains(rest, "NFIN"), "NFIN").otherwise("FIN")
    fields = {"pos": F.when(masdar, "V.MSDR").otherwise("V"), "tense": na(tense), "aspect": F.lit(NA), "mood": na(mood), "person": na(person), "number": na(number), "gender": na(gender), "voice": F.lit(NA), "finiteness": finite}
    fields["canonical_cell"] = cell_of(*(fields[k] for k in ("pos", "tense", "mood", "person", "number", "gender", "finiteness")))
    return F.struct(*[F.when(error.isNull(), v).alias(k) for k, v in fields.items()], error.alias("tag_error"))


def cell_of(pos, tense, mood, person, number, gender, finiteness) -> Column:
    short = F.when(gender == "MASC", "M").when(gender == "FEM", "F").otherwise("")
    blank = lambda c: F.when(c == NA, "").otherwise(c)
    head = F.when(mood == "IMP", "IMP").otherwise(tense)
    return F.when(pos == "V.MSDR", "MSDR").when(finiteness == "NFIN", "NFIN").otherwise(F.concat(head, F.lit("."), blank(person), short, blank(number)))


def violations(f: Column) -> Column:
    """Codes of impossible feature combinations of a parsed tag, in a fixed order."""
    tense, person, number, gender, imp = f["tense"], f["person"], f["number"], f["gender"], f["mood"] == "IMP"
    nonfinite = (f["pos"] == "V.MSDR") | (f["finiteness"] == "NFIN")
    marked = (tense != NA) | (person != NA) | (number != NA) | (gender != NA)
    finite = [
        (imp & (tense != NA), "IMP_WITH_TENSE"),
        (imp & (person != "2"), "IMP_NOT_2ND_PERSON"),
        (~imp & (tense == NA), "FINITE_WITHOUT_TENSE"),
        ((tense == "PRS") & (person != NA), "PRS_WITH_PERSON"),
        (tense.isin("PST", "FUT") & (person == NA), "PERSON_MISSING"),
        (number == NA, "NUMBER_MISSING"),
        ((person == "1") & (gender != NA), "1ST_PERSON_WITH_GENDER"),
        ((tense == "PST") & (person == "3") & (number == "PL") & (gender != NA), "PST_3PL_WITH_GENDER"),
        ((person == "2") & (gender == NA), "2ND_PERSON_WITHOUT_GENDER"),
        ((tense == "PRS") & (gender == NA), "PRS_WITHOUT_GENDER"),
    ]
    codes = F.array(F.when(nonfinite & marked, F.lit("NONFINITE_WITH_AGREEMENT")), *[F.when(~nonfinite & c, F.lit(n)) for c, n in finite])
    return F.filter(codes, lambda c: c.isNotNull())


def feature_string(cell: Column) -> Column:
    """PST.2MSG -> PST,2,SG,MASC; a name without a dot is itself; anything else fails."""
    person, gender, number = (F.regexp_extract(cell, r"^[^.]*\.([123]?)([MF]?)(SG|PL)$", i) for i in (1, 2, 3))
    word = F.when(gender == "M", "MASC").when(gender == "F", "FEM")
    joined = F.concat_ws(",", F.get(F.split(cell, r"\."), F.lit(0)), F.when(person != "", person), number, word)
    return F.when(~cell.contains("."), cell).when(number != "", joined).otherwise(F.raise_error(F.concat(F.lit("not a cell: "), cell)))


def tag_of_cell(cell: Column) -> Column:
    """The tag of a cell, as PST.2MSG -> V;PST;2;SG;MASC."""
    return F.when(cell == "MSDR", "V.MSDR").when(cell == "NFIN", "V;NFIN").otherwise(F.concat(F.lit("V;"), F.regexp_replace(feature_string(cell), ",", ";")))


def cell_of_v4_tag(tag: Column) -> Column:
    """The cell of a tag with nested agreement, as V;PST;NOM(3,SG,MASC); NULL if it has anything unknown."""
    parts = F.split(tag, ";")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    nested = r"^NOM\(([^)]*)\)$"
    bad = F.exists(rest, lambda p: ~(p.rlike(nested) | p.isin("PST", "PRS", "FUT", "IMP", "NFIN")))
    inner = F.flatten(F.transform(F.filter(rest, lambda p: p.rlike(nested)), lambda p: F.split(F.regexp_extract(p, nested, 1), ",")))
    last = lambda a, names: F.try_element_at(F.filter(a, lambda p: p.isin(*names)), F.lit(-1))
    gender = last(inner, ["MASC", "FEM"])
    head = F.when(F.array_contains(rest, "IMP"), "IMP").otherwise(F.coalesce(last(rest, ["PST", "PRS", "FUT"]), F.lit("None")))
    own = F.concat(head, F.lit("."), F.coalesce(last(inner, ["1", "2", "3"]), F.lit("")), F.coalesce(F.substring(gender, 1, 1), F.lit("")), F.coalesce(last(inner, ["SG", "PL"]), F.lit("")))
    return F.when(tag == "V.MSDR", "MSDR").when(~tag.contains("("), parse_tag(tag)["canonical_cell"]).when((F.get(parts, F.lit(0)) != "V") | bad, F.lit(None)).when(F.array_contains(rest, "NFIN"), "NFIN").otherwise(own)


def class_from_shape(prs: Column, inf: Column, pst: Column) -> Column:
    """Class that the vocalized present, infinitive and past suggest, and the rule: struct(binyan, rule).

    Only a check on annotations; never written into a class column. Rules are tried in order.
    """
    first = lambda s: F.substring(s, 1, 1)
    points = lambda s: F.regexp_extract(s, "^.([֑-ׇ]*)", 1)
    after = lambda s: F.regexp_extract(s, "(?s)^.[֑-ׇ]*(.*)$", 1)
    has = lambda s, marks: s.rlike(f"[{marks}]")
    mem, nun, lamed, he, waw = "מ", "נ", "ל", "ה", "ו"
    p1, rest = points(prs), after(prs)
    l2, p2 = first(rest), points(rest)
    is_mem, is_nun, no_inf = first(prs) == mem, first(prs) == nun, inf.isNull()
    sheva = has(p1, "ְֱֲ")
    second = after(inf)
    leh = (first(inf) == lamed) & has(points(inf), "ְ") & second.startswith(he)
    opens_he = inf.startswith(lamed + "ְ" + he)
    nif = is_nun & pst.startswith(nun) & ~F.substring(prs, 2, 2).contains("ֹ") & ~prs.startswith(nun + waw + "ֹ")
    out = lambda b, r: F.struct(F.lit(b).cast("string").alias("binyan"), F.lit(r).alias("rule"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(prs.isNull() | pst.isNull() | (prs == "") | (pst == ""), out(None, "missing_prs_or_pst"))
        .when(is_mem & has(p1, "ִ"), out("HITPAEL", "prs_mi"))
        .when(is_mem & has(p1, "ֵֶַ") & ~pst.startswith(mem), out("HIFIL", "prs_ma_me"))
        .when(is_mem & (has(p1, "ֻ") | rest.startswith(waw + "ּ") | (has(p1, "ָ") & no_inf)), out("HUFAL", "prs_mu"))
        .when(is_mem & sheva & (l2 == waw) & (p2 == "ּ"), out("PUAL", "prs_me_u"))
        .when(is_mem & sheva & has(p2, "ֹֻ") & no_inf, out("PUAL", "prs_me_u_vowel"))
        .when(is_mem & sheva & has(p2, "ֹֻ"), out("PIEL", "prs_me_u_vowel"))
        .when(is_mem & sheva & no_inf, out("PUAL", "prs_me_no_inf"))
        .when(is_mem & sheva, out("PIEL", "prs_me"))
        .when(no(leh & has(points(second), "ַ")), out("HIFIL", "inf_leha"))
        .when(no(leh & is_nun), out("NIFAL", "inf_lehi_prs_n"))
        .when(nif & no(opens_he), out("NIFAL", "prs_n_inf_leh"))
        .when(nif, out(None, "prs_n_ambiguous"))
        .when(no(inf.startswith(lamed + "ְ") & ~opens_he), out(None, "inf_le_without_prs_me"))
        .when((~is_mem | pst.startswith(mem)) & (no_inf | ~no(opens_he)), out("PAAL", "prs_no_prefix"))
        .otherwise(out(None, "no_rule"))
    )
