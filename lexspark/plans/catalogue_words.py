"""Registered queries of the text, tag and root functions, and of readers and writers, each through the library's functions.

Words of the documents are spelled with Hebrew letters and points, so that the functions meet a large, irregular input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features, roots, text
from lexspark.plans.catalogue import query

#: Latin letters and what they are spelled with: letters (two of them final), points, dots, dagesh.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HEBREW = "ָבכדֶפגהִחקלםןֹףירשתֻוֺׁיּ"

WORDS = f"words AS (SELECT w, nfc_normalize(translate(w, '{LATIN}', '{HEBREW}')) AS s FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '')"
STRIP = "regexp_replace({}, '[֑-ׇֽֿׁׂׅׄ]', '', 'g')"
FINALS = f"translate({{}}, '{text.FINALS}', '{text.REGULARS}')"
LETTERS = "regexp_replace({}, '[^א-ת]', '', 'g')"


def words(t) -> DataFrame:
    """(w, s): distinct Latin words of all documents, and how they are spelled."""
    found = t("documents").where("text is not null").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    return found.withColumn("s", text.nfc(F.translate("w", LATIN, HEBREW)))


@query(f"""WITH {WORDS} SELECT w, {STRIP.format('s')} AS stripped, {FINALS.format('s')} AS regular, {FINALS.format(LETTERS.format('s'))} AS skeleton, regexp_replace({FINALS.format(LETTERS.format('s'))}, '[וי]', '', 'g') AS key,
    nfc_normalize({FINALS.format("translate(regexp_replace(s, '[ֽֿ֑-֯]', '', 'g'), 'ׇֺ', 'ָֹ')")}) AS loose, regexp_matches(s, '[{text.VOWELS}]') AS pointed FROM words""")
def points_and_keys(t) -> DataFrame:
    """Points stripped, finals made regular, letters alone, and the two keys by which spellings are compared."""
    s = F.col("s")
    return words(t).select(
        "w", text.strip_points(s).alias("stripped"), text.normalize_finals(s).alias("regular"), text.skeleton(s).alias("skeleton"), text.plene_key(s).alias("key"), text.loose_key(s).alias("loose"), text.has_points(s).alias("pointed")
    )


_LAST = "'(?s)^(.*)([א-ת])([^א-ת]*)$'"


@query(f"""WITH {WORDS}, p AS (SELECT w, {FINALS.format('s')} AS s FROM words)
SELECT w, CASE WHEN regexp_matches(s, '[א-ת]') THEN regexp_extract(s, {_LAST}, 1) || translate(regexp_extract(s, {_LAST}, 2), '{text.REGULARS}', '{text.FINALS}') || regexp_extract(s, {_LAST}, 3) ELSE s END AS form FROM p""")
def final_forms(t) -> DataFrame:
    """The last letter final, all others regular."""
    return words(t).select("w", text.apply_finals(F.col("s")).alias("form"))


@query(f"""WITH {WORDS} SELECT w, CASE WHEN w LIKE '%e%' THEN {STRIP.format('s')} ELSE {STRIP.format('s')} || 'י' END AS plain,
    CASE WHEN length(s) > 0 THEN regexp_replace({FINALS.format(LETTERS.format('s'))}, '[וי]', '', 'g') = regexp_replace({FINALS.format(LETTERS.format("CASE WHEN w LIKE '%b%' THEN s || 'ב' ELSE s || 'י' END"))}, '[וי]', '', 'g') END AS consistent FROM words""")
def plene_consistency(t) -> DataFrame:
    """Whether a full spelling fits a pointed form: it may have more waw and yod, and nothing else."""
    s = F.col("s")
    plain = F.when(F.col("w").contains("e"), text.strip_points(s)).otherwise(F.concat(text.strip_points(s), F.lit("י")))
    other = F.when(F.col("w").contains("b"), F.concat(s, F.lit("ב"))).otherwise(F.concat(s, F.lit("י")))
    return words(t).select("w", plain.alias("plain"), text.plene_consistent(s, other).alias("consistent"))


_RAW = "CASE length(w) % 6 WHEN 0 THEN s WHEN 1 THEN ' ' || s WHEN 2 THEN s || '־א' WHEN 3 THEN 'x' || s || '́' WHEN 4 THEN 'ׁ' || s ELSE 'שׁ' || s END"
_MN = r"\p{Mn}"
_MARK = "[֑-ׇֽֿׁׂׅׄ]"
_PUNCTUATION = "".join(text.PUNCTUATION)


def _after(base: str) -> str:
    return f"(?:^|[^{base}{_MN}]){_MN}*"


@query(f"""WITH {WORDS}, r AS (SELECT w, {_RAW} AS raw FROM words), n AS (SELECT w, raw, nfc_normalize(raw) AS s FROM r),
m AS (SELECT *, list_filter(regexp_extract_all(s, '{_MN}'), lambda c: NOT contains('{text.STANDARD}', c)) AS odd, regexp_extract_all(s, '(?s)[^א-ת {_MN}{_PUNCTUATION}]') AS outside FROM n)
SELECT w, array_to_string(list_filter([CASE WHEN len(odd) > 0 THEN 'NONSTANDARD_COMBINING_MARK' END, CASE WHEN len(outside) > 0 THEN 'NON_HEBREW_CHARACTER' END, CASE WHEN regexp_matches(s, '[{_PUNCTUATION}]') THEN 'HEBREW_PUNCTUATION' END,
    CASE WHEN contains(s, ' ') THEN 'CONTAINS_SPACE' END, CASE WHEN regexp_matches(raw, '[יִ-ﭏ]') THEN 'PRESENTATION_FORM_IN_RAW' END, CASE WHEN raw <> s THEN 'RAW_NOT_NFC' END,
    CASE WHEN regexp_matches(s, '{_after("א-ת")}{_MARK}') THEN 'MALFORMED_ORPHAN_MARK' END,
    CASE WHEN regexp_matches(s, '{_after("ש")}[ׁׂ]') OR regexp_matches(s, '{_after("ו")}ֺ') THEN 'MALFORMED_MARK_ON_INVALID_BASE' END,
    CASE WHEN len(list_filter(list_distinct(regexp_extract_all(s, '{_MARK}')), lambda c: regexp_matches(s, c || '[^א-ת]*' || c))) > 0 THEN 'MALFORMED_REPEATED_MARK' END], lambda x: x IS NOT NULL), '|') AS flags,
    array_to_string(list_transform(odd, lambda c: printf('U+%04X', unicode(c))), ',') AS marks, array_to_string(list_transform(outside, lambda c: printf('U+%04X', unicode(c))), ',') AS foreign_chars FROM m""")
def character_audit(t) -> DataFrame:
    """Faults of raw strings: marks without a letter or on the wrong one, foreign characters, compatibility forms."""
    n = (F.length("w") % 6).cast("int")
    around = lambda *parts: F.get(F.array(*map(F.lit, parts)), n)
    raw = F.concat(around("", " ", "", "x", "ׁ", "שׁ"), F.col("s"), around("", "", "־א", "́", "", ""))
    found = words(t).select("w", text.audit(raw).alias("a"))
    return found.select("w", F.array_join("a.flags", "|").alias("flags"), F.array_join("a.nonstandard_marks", ",").alias("marks"), F.array_join("a.non_hebrew_chars", ",").alias("foreign_chars"))


@query(f"""WITH {WORDS}, u AS (SELECT w, s, regexp_extract_all(s, '(?s)(^{_MARK}|.)({_MARK}*)') AS u FROM words)
SELECT w, array_to_string(list_transform(u, lambda x: x[1:1]), '') AS letters, array_to_string(list_transform(u, lambda x: (length(x) - 1)::VARCHAR), '') AS marks FROM u""")
def unit_split(t) -> DataFrame:
    """Letters with the number of their marks."""
    u = text.units(F.col("s"))
    return words(t).select("w", F.array_join(F.transform(u, lambda x: x["letter"]), "").alias("letters"), F.array_join(F.transform(u, lambda x: F.length(x["marks"]).cast("string")), "").alias("marks"))


_MARKED = "'[[' || p_brand || '|' || p_name || ']] <!-- ' || p_type || ' -->''''''שלום'''''' וֹא<ref name=a>no</ref> [[' || p_type || ']]<br>x <ref/>'"


@query(f"""SELECT p_partkey, p_name || ' שלום וֹא ' || p_type || ' x' AS plain, 'שלום|וֹא' AS hebrew FROM part""")
def markup_stripped(t) -> DataFrame:
    """Plain text of marked-up strings, and the Hebrew words in it."""
    raw = F.concat(F.lit("[["), "p_brand", F.lit("|"), "p_name", F.lit("]] <!-- "), "p_type", F.lit(" -->'''שלום''' וֹא<ref name=a>no</ref> [["), "p_type", F.lit("]]<br>x <ref/>"))
    return t("part").select("p_partkey", text.strip_markup(raw).alias("plain"), F.array_join(text.hebrew_words(raw), "|").alias("hebrew"))


#: Names of root classes as sources write them, and their labels.
_GIZRA = [
    ("גזרת השלמים", "SHLEMIM"), ('גזרת חפ"נ', "PE_NUN"), ("גזרת חסרי פ\"נ", "PE_NUN"), ('גזרת נפי"ו', "PE_YOD_WAW"), ('גזרת נחי פ"י', "PE_YOD_WAW"), ('חפי"צ', "PE_YOD_TSADI"), ('גזרת נל"י/ה', "LAMED_YOD_HE"), ("גזרת הכפולים", "AYIN_AYIN"),
    ('גזרת נע"ו', "AYIN_WAW_YOD"), ('גזרת ע"ו', "AYIN_WAW_YOD"), ('נל"א', "LAMED_ALEF"), ("גזרת המרובעים", "QUADRILITERAL"), ("פ' גרונית", "PE_GUTTURAL"), ('ל"ג', "LAMED_GUTTURAL"), ("משהו אחר", "UNMAPPED"), ('נפ"א', "PE_ALEF"),
]


@query("WITH g(i, raw, label) AS (VALUES " + ", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')" for i, (a, b) in enumerate(_GIZRA)) + ") SELECT p_partkey, raw, label FROM part JOIN g ON i = p_partkey % 16")
def root_class_labels(t) -> DataFrame:
    """Labels of root classes as sources name them, linked or in plain text."""
    names = F.array(*[F.lit(a) for a, _ in _GIZRA])
    rows = t("part").select("p_partkey", F.get(names, (F.col("p_partkey") % 16).cast("int")).alias("raw"))
    stated = F.when(F.col("raw").startswith("גזרת"), F.concat(F.lit("{{x}} [["), "raw", F.lit("|y]]"))).otherwise(F.concat(F.lit("{{x}}, "), "raw"))
    rows = rows.select("p_partkey", F.explode(text.gizra_raw(stated)).alias("raw"))
    return rows.select("p_partkey", "raw", text.gizra_label(F.col("raw")).alias("label"))


# ---------------------------------------------------------------------- tags

_CHOICES = {"tense": ["", "PST", "PRS", "FUT", "IMP", "IMP;PST", "NFIN", "XX", "PST;PST"], "person": ["", "1", "2", "3"], "number": ["", "SG", "PL"], "gender": ["", "MASC", "FEM"]}
_TAG_SQL = "CASE WHEN p_partkey % 29 = 0 THEN 'V.MSDR' WHEN p_partkey % 31 = 0 THEN 'N;SG' ELSE array_to_string(list_filter(['V', ['', 'PST', 'PRS', 'FUT', 'IMP', 'IMP;PST', 'NFIN', 'XX', 'PST;PST'][1 + p_partkey % 9], ['', '1', '2', '3'][1 + p_partkey // 9 % 4], ['', 'SG', 'PL'][1 + p_partkey // 36 % 3], ['', 'MASC', 'FEM'][1 + p_partkey // 108 % 3]], lambda x: x <> ''), ';') END"
_PARSED = f"""t AS (SELECT p_partkey, {_TAG_SQL} AS tag FROM part), p AS (SELECT *, string_split(tag, ';') AS a, string_split(tag, ';')[2:] AS rest, tag = 'V.MSDR' AS masdar FROM t),
q AS (SELECT *, CASE WHEN masdar THEN NULL WHEN a[1] <> 'V' THEN 'not a verb tag: ' || tag WHEN len(list_distinct(rest)) < len(rest) THEN 'repeated feature in ' || tag WHEN list_contains(rest, 'XX') THEN 'unknown feature XX in ' || tag END AS tag_error,
    CASE WHEN masdar THEN 'NA' ELSE coalesce(list_filter(rest, lambda x: x IN ('PST', 'PRS', 'FUT'))[-1], 'NA') END AS tense, CASE WHEN masdar THEN 'NA' ELSE coalesce(list_filter(rest, lambda x: x IN ('1', '2', '3'))[-1], 'NA') END AS person,
    CASE WHEN masdar THEN 'NA' ELSE coalesce(list_filter(rest, lambda x: x IN ('SG', 'PL'))[-1], 'NA') END AS number, CASE WHEN masdar THEN 'NA' ELSE coalesce(list_filter(rest, lambda x: x IN ('MASC', 'FEM'))[-1], 'NA') END AS gender,
    coalesce(list_contains(rest, 'IMP'), false) AS imp, masdar OR coalesce(list_contains(rest, 'NFIN'), false) AS nfin FROM p),
f AS (SELECT *, CASE WHEN masdar THEN 'NA' WHEN imp THEN 'IMP' WHEN tense <> 'NA' THEN 'IND' ELSE 'NA' END AS mood, CASE WHEN masdar THEN 'MSDR' WHEN nfin THEN 'NFIN' ELSE CASE WHEN imp THEN 'IMP' ELSE tense END || '.' || CASE WHEN person = 'NA' THEN '' ELSE person END || CASE gender WHEN 'MASC' THEN 'M' WHEN 'FEM' THEN 'F' ELSE '' END || CASE WHEN number = 'NA' THEN '' ELSE number END END AS cell FROM q)"""


def tags(t) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda name, i: F.get(F.array(*map(F.lit, _CHOICES[name])), i.cast("int"))
    parts = F.array(F.lit("V"), pick("tense", k % 9), pick("person", F.floor(k / 9) % 4), pick("number", F.floor(k / 36) % 3), pick("gender", F.floor(k / 108) % 3))
    tag = F.when(k % 29 == 0, "V.MSDR").when(k % 31 == 0, "N;SG").otherwise(F.array_join(F.filter(parts, lambda x: x != ""), ";"))
    return t("part").select("p_partkey", tag.alias("tag"))


@query(f"""WITH {_PARSED} SELECT p_partkey, tag, tag = 'V.MSDR' OR tag LIKE 'V;%' AS verb, tag_error, CASE WHEN tag_error IS NULL THEN tense END AS tense, CASE WHEN tag_error IS NULL THEN mood END AS mood, CASE WHEN tag_error IS NULL THEN person END AS person,
    CASE WHEN tag_error IS NULL THEN number END AS number, CASE WHEN tag_error IS NULL THEN gender END AS gender, CASE WHEN tag_error IS NULL THEN CASE WHEN nfin THEN 'NFIN' ELSE 'FIN' END END AS finiteness, CASE WHEN tag_error IS NULL THEN cell END AS cell FROM f""")
def tag_features(t) -> DataFrame:
    """Tags parsed into features and the name of their cell, or an error."""
    p = tags(t).withColumn("p", features.parse_tag(F.col("tag")))
    return p.select("p_partkey", "tag", features.is_verb_tag(F.col("tag")).alias("verb"), *[F.col(f"p.{k}").alias(k) for k in ("tag_error", "tense", "mood", "person", "number", "gender", "finiteness")], F.col("p.canonical_cell").alias("cell"))


@query(f"""WITH {_PARSED} SELECT p_partkey, tag, array_to_string(list_filter(CASE WHEN nfin THEN [CASE WHEN tense <> 'NA' OR person <> 'NA' OR number <> 'NA' OR gender <> 'NA' THEN 'NONFINITE_WITH_AGREEMENT' END] ELSE
    [CASE WHEN imp AND tense <> 'NA' THEN 'IMP_WITH_TENSE' END, CASE WHEN imp AND person <> '2' THEN 'IMP_NOT_2ND_PERSON' END, CASE WHEN NOT imp AND tense = 'NA' THEN 'FINITE_WITHOUT_TENSE' END, CASE WHEN tense = 'PRS' AND person <> 'NA' THEN 'PRS_WITH_PERSON' END,
     CASE WHEN tense IN ('PST', 'FUT') AND person = 'NA' THEN 'PERSON_MISSING' END, CASE WHEN number = 'NA' THEN 'NUMBER_MISSING' END, CASE WHEN person = '1' AND gender <> 'NA' THEN '1ST_PERSON_WITH_GENDER' END,
     CASE WHEN tense = 'PST' AND person = '3' AND number = 'PL' AND gender <> 'NA' THEN 'PST_3PL_WITH_GENDER' END, CASE WHEN person = '2' AND gender = 'NA' THEN '2ND_PERSON_WITHOUT_GENDER' END, CASE WHEN tense = 'PRS' AND gender = 'NA' THEN 'PRS_WITHOUT_GENDER' END] END, lambda x: x IS NOT NULL), ',') AS codes FROM f WHERE tag_error IS NULL""")
def impossible_features(t) -> DataFrame:
    """Combinations of features that no form can have."""
    p = tags(t).withColumn("p", features.parse_tag(F.col("tag"))).where("p.tag_error is null")
    return p.select("p_partkey", "tag", F.array_join(features.violations(F.col("p")), ",").alias("codes"))


_CELL_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(features.CELL_ORDER))
_PARTS = "regexp_extract(c, '^[A-Z]+\\.([123]?)([MF]?)(SG|PL)$', {})"


@query(f"""WITH cells(i, c) AS (VALUES {_CELL_ROWS}), s AS (SELECT *, CASE WHEN c NOT LIKE '%.%' THEN c ELSE array_to_string(list_filter([split_part(c, '.', 1), {_PARTS.format(1)}, {_PARTS.format(3)}, CASE {_PARTS.format(2)} WHEN 'M' THEN 'MASC' WHEN 'F' THEN 'FEM' ELSE '' END], lambda x: x <> ''), ',') END AS features FROM cells)
SELECT l_orderkey, l_linenumber, c AS cell, i AS rank, features, CASE WHEN c = 'MSDR' THEN 'V.MSDR' WHEN c = 'NFIN' THEN 'V;NFIN' ELSE 'V;' || replace(features, ',', ';') END AS tag, c AS back FROM lineitem JOIN s ON i = (l_orderkey + l_linenumber) % 29""")
def cell_names(t) -> DataFrame:
    """Cells as feature strings and tags, and back from a tag with nested agreement."""
    c = F.get(F.array(*map(F.lit, features.CELL_ORDER)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 29).cast("int"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", c.alias("cell"))
    parts = F.split("features", ",")
    v4 = F.when(~F.col("cell").contains("."), F.col("tag")).otherwise(F.concat(F.lit("V;"), F.get(parts, F.lit(0)), F.lit(";NOM("), F.array_join(F.slice(parts, 2, 3), ","), F.lit(")")))
    rows = rows.withColumns({"rank": features.cell_rank(F.col("cell")), "features": features.feature_string(F.col("cell")), "tag": features.tag_of_cell(F.col("cell"))})
    return rows.withColumn("back", features.cell_of_v4_tag(v4))


# --------------------------------------------------------------------- roots

_UNITS = f"u AS (SELECT w, {FINALS.format(LETTERS.format('s'))} AS r FROM words WHERE length({LETTERS.format('s')}) BETWEEN 3 AND 5), k AS (SELECT *, string_split(r, '') AS a, length(r) AS n, r[1] AS r1, r[2] AS r2, r[3] AS r3 FROM u)"
_GEM = "(n = 3 AND r2 = r3)"
_WEAK = f"(r1 IN ('נ', 'י', 'ו', 'א') OR r2 IN ('ו', 'י') OR r3 IN ('ה', 'י', 'א') OR {_GEM})"
_GUTTURAL = "len(list_filter(a, lambda x: x IN ('א', 'ה', 'ח', 'ע'))) > 0"


@query(f"""WITH {WORDS}, {_UNITS}
SELECT w, r AS root, n::BIGINT AS root_length, r1 = 'נ' AS r1_is_nun, r[-1] = 'ה' AS rfinal_is_he, r2 IN ('א', 'ה', 'ח', 'ע') AS r2_is_guttural, contains(r, 'ר') AS has_resh, {_GEM} AS is_geminate, n = 4 AND r1 = r3 AND r2 = r[4] AS is_reduplicated_quadriliteral, {_WEAK} AS has_weak_radical,
    array_to_string(list_transform(a, lambda x: CASE x WHEN 'נ' THEN 'N' WHEN 'י' THEN 'Y' WHEN 'ו' THEN 'W' WHEN 'ה' THEN 'H' WHEN 'א' THEN 'A' WHEN 'ח' THEN 'X' WHEN 'ע' THEN 'E' WHEN 'ר' THEN 'R' ELSE 'C' END), '.') || CASE WHEN {_GEM} THEN '+GEM' ELSE '' END AS structural_signature,
    CASE WHEN n >= 4 THEN 'quadriliteral' WHEN {_GEM} THEN 'geminate' WHEN r2 IN ('ו', 'י') THEN 'hollow_candidate' WHEN r3 = 'ה' THEN 'final_he' WHEN r1 = 'נ' THEN 'initial_nun' WHEN r1 IN ('י', 'ו') THEN 'initial_yod_waw' WHEN r3 = 'א' THEN 'final_alef' WHEN r1 = 'א' THEN 'initial_alef' WHEN {_GUTTURAL} THEN 'guttural_containing' ELSE 'strong' END AS structural_class,
    n = 3 AND NOT {_WEAK} AND NOT {_GUTTURAL} AS sc_strong, 'RT-' || left(sha1('root|' || r), 10) AS root_id FROM k""")
def root_features(t) -> DataFrame:
    """Structural features and classes of roots, from their letters alone."""
    r = text.skeleton(F.col("s"))
    rows = words(t).select("w", r.alias("root")).where(F.length("root").between(3, 5))
    f = roots.features(roots.split_units(F.col("root")))
    names = ["root_length", "r1_is_nun", "rfinal_is_he", "r2_is_guttural", "has_resh", "is_geminate", "is_reduplicated_quadriliteral", "has_weak_radical", "structural_signature", "structural_class", "sc_strong"]
    return rows.select("w", "root", *[f[k].alias(k) for k in names], roots.root_id(F.col("root")).alias("root_id"))


_STABLE = "list_filter(list_zip(a, range(len(a))), lambda z: NOT ((z[2] = 0 AND z[1] IN ('נ', 'י', 'ו')) OR (z[2] = 1 AND n = 3 AND z[1] IN ('ו', 'י')) OR (z[2] = n - 1 AND z[1] IN ('ה', 'י')) OR (z[2] = 2 AND n = 3 AND r2 = r3)))"


@query(f"""WITH {WORDS}, {_UNITS}, s AS (SELECT w, r, array_to_string(list_transform({_STABLE}, lambda z: z[1]), '') AS stable FROM k)
SELECT w, stable, regexp_matches('ל' || r || 'ת', array_to_string(list_transform(string_split(stable, ''), lambda x: x), '.*')) AS inside, regexp_matches(reverse(r), array_to_string(string_split(stable, ''), '.*')) AS backwards FROM s""")
def stable_letters(t) -> DataFrame:
    """Radicals that show in every class, and whether they occur in order in a longer word and in the word read backwards."""
    r = text.skeleton(F.col("s"))
    rows = words(t).select("w", r.alias("root")).where(F.length("root").between(3, 5))
    stable = roots.stable_radicals(text.characters(F.col("root")))
    return rows.select("w", F.array_join(stable, "").alias("stable"), roots.is_subsequence(stable, F.concat(F.lit("ל"), "root", F.lit("ת"))).alias("inside"), roots.is_subsequence(stable, F.reverse("root")).alias("backwards"))


_DOTTED = "'ש' || CASE o_orderkey % 3 WHEN 0 THEN 'ׁ' WHEN 1 THEN 'ׂ' ELSE '' END || '-כ-ר'"
_LEMMA = "'ש' || CASE o_custkey % 3 WHEN 0 THEN 'ָׁ' WHEN 1 THEN 'ָׂ' ELSE 'ָ' END || 'כַר'"


@query(f"""WITH d AS (SELECT o_orderkey, o_orderkey % 3 AS g, o_custkey % 3 AS l FROM orders)
SELECT o_orderkey, 'ש' || CASE WHEN g = 0 OR (g = 2 AND l = 0) THEN 'ׁ' WHEN g = 1 OR (g = 2 AND l = 1) THEN 'ׂ' ELSE '' END || 'כר' AS root, CASE WHEN g < 2 THEN 'SOURCE' WHEN l < 2 THEN 'FORM' ELSE 'UNRESOLVED' END AS method,
    CASE WHEN g < 2 AND l < 2 AND g <> l THEN 'SHIN_SIN_MISMATCH' WHEN g < 2 THEN '' WHEN l < 2 THEN 'SHIN_SIN_FROM_FORM' ELSE 'SHIN_SIN_UNRESOLVED' END AS flags, 'שכר' AS bare_key, CASE WHEN g = 2 THEN 'ש' ELSE 'ש' || CASE g WHEN 0 THEN 'ׁ' ELSE 'ׂ' END END AS first_unit FROM d""")
def shin_resolution(t) -> DataFrame:
    """The dot of each shin: the source's, else the lemma's, else none; with flags where they disagree."""
    g, n = F.col("o_orderkey") % 3, F.col("o_custkey") % 3
    dot = lambda c: F.when(c == 0, "ׁ").when(c == 1, "ׂ").otherwise("")
    dashed = F.concat(F.lit("ש"), dot(g), F.lit("-כ-ר"))
    r = roots.resolve_shin(F.lit("שכר"), F.array(dashed), F.concat(F.lit("שָ"), dot(n), F.lit("כַר")))
    rows = t("orders").select("o_orderkey", r.alias("r"), roots.bare_key(dashed).alias("bare_key"), F.get(roots.split_units(F.replace(dashed, F.lit("-"), F.lit(""))), F.lit(0)).alias("first_unit"))
    return rows.select("o_orderkey", F.array_join("r.radicals", "").alias("root"), F.col("r.method").alias("method"), F.array_join("r.flags", "|").alias("flags"), "bare_key", "first_unit")


# ---------------------------------------------------------- readers, writers


def scratch(spark, name: str) -> str:
    """A folder for a query's files: beside the shared checkpoints, or a temporary one where the master is local."""
    import tempfile
    import uuid

    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexspark-")
    return f"{at.rstrip('/')}/lexspark-{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment || '\\t' || c_name || '\\n' AS note FROM customer")
def tsv_round_trip(t) -> DataFrame:
    """A report written as escaped TSV in a fixed order, read back with given types."""
    from lexspark.sources import readers, writers

    df = t("customer")
    path = scratch(df.sparkSession, "tsv")
    noted = df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.concat("c_mktsegment", F.lit("\t"), "c_name", F.lit("\n")).alias("note"))
    writers.report(noted, path, ["c_name"])
    return readers.tsv(df.sparkSession, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, note string")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def view_json_round_trip(t) -> DataFrame:
    """A view written with its analysis columns nested in JSON lines, among lines that are no JSON, read back."""
    from lexspark.sources import readers, writers

    df = t("supplier").withColumnRenamed("s_acctbal", "analysis__acctbal")
    spark, folder = df.sparkSession, scratch(df.sparkSession, "view")
    writers.view(df, folder, "v")
    spark.createDataFrame([("no json {",), ("",)], "value string").write.mode("append").text(f"{folder}/v.jsonl")
    back = readers.json_lines(spark, f"{folder}/v.jsonl", "s_suppkey long, s_name string, s_nationkey long, analysis struct<acctbal:double>").where("s_suppkey is not null")
    return back.select("s_suppkey", "s_name", "s_nationkey", F.col("analysis.acctbal").alias("s_acctbal"))


@query("SELECT 'P' || p_partkey % 7 AS file, p_partkey // 7 + 1 AS k, p_name AS lemma_raw, p_brand AS form_raw, 'V;' || p_type AS tag_raw FROM part")
def triples_round_trip(t) -> DataFrame:
    """Tab-separated triples written as files, read back with line numbers that count blank lines too."""
    from lexspark.sources import readers

    df = t("part")
    spark, folder = df.sparkSession, scratch(df.sparkSession, "triples")
    out = []
    for k in range(7):
        rows = df.where(F.col("p_partkey") % 7 == k).orderBy("p_partkey").coalesce(1)
        rows.select(F.concat("p_name", F.lit("\t"), "p_brand", F.lit("\tV;"), "p_type", F.lit("\n")).alias("value")).write.text(f"{folder}/{k}")
        one = readers.triples(spark, f"{folder}/{k}", f"P{k}")  # every other line is blank
        out.append(one.select("file", F.floor((F.col("line_no") + 1) / 2).alias("k"), "lemma_raw", "form_raw", "tag_raw"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT url AS title, (page_id % 3)::INTEGER AS ns, page_id, page_id + 1 AS rev_id, 't' || page_id AS timestamp, 'size ' || length(html) AS text FROM pages WHERE page_id % 3 <> 1 AND page_id % 2 = 0")
def wiki_dump_pages(t) -> DataFrame:
    """Pages written as a MediaWiki dump, read back, filtered by namespace and a marker in the text."""
    from lexspark.sources import readers

    df = t("pages")
    path = scratch(df.sparkSession, "dump")
    mark = F.when(F.col("page_id") % 2 == 0, "size ").otherwise("other ")
    body = F.concat(mark, F.length("html"))
    escaped = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    page = F.concat(
        F.lit("<page><title>"), escaped, F.lit("</title><ns>"), F.col("page_id") % 3, F.lit("</ns><id>"), "page_id", F.lit("</id><revision><id>"), F.col("page_id") + 1, F.lit("</id><timestamp>t"), "page_id",
        F.lit('</timestamp><text xml:space="preserve">'), body, F.lit("</text></revision></page>"),
    )
    frame = df.sparkSession.createDataFrame([(0, "<mediawiki>"), (2, "</mediawiki>")], "part int, value string")
    df.select(F.lit(1).alias("part"), page.alias("value")).unionByName(frame).orderBy("part").coalesce(1).select("value").write.text(path)
    return readers.relevant_pages(readers.wiki_dump(df.sparkSession, path), ["size "], skip_ns=1)


@query("WITH x AS (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS c FROM nation) SELECT length(c)::BIGINT AS bytes, sha256(c) AS sha256 FROM x")
def file_checksums(t) -> DataFrame:
    """Size and digest of a file."""
    from lexspark.sources import readers

    df = t("nation")
    path = scratch(df.sparkSession, "file")
    df.orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("value")).write.text(path)
    return readers.checksums(df.sparkSession, f"{path}/*.txt").select("bytes", "sha256")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def parquet_pruned(t) -> DataFrame:
    """A table written as Parquet, read back by columns."""
    from lexspark.sources import readers, writers

    df = t("orders")
    stem = scratch(df.sparkSession, "orders")
    writers.table(df, stem, tsv=False)
    return readers.parquet(df.sparkSession, f"{stem}.parquet", ["o_orderkey", "o_orderstatus", "o_totalprice"]).where("o_totalprice > 100000").drop("o_totalprice")
