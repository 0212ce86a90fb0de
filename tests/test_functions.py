"""Scalar functions on literals: text, feature tags, roots."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.functions import features, roots, text

N = lambda s: unicodedata.normalize("NFC", s)


def column(spark, values, fn, kind="string"):
    """fn over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_nfc_orders_marks_and_keeps_null(spark):
    raw = "ש" + "ּ" + "ׁ" + "ָ"
    assert column(spark, [raw, "e\u0301", "é", None, "abc"], text.nfc) == [N(raw), "é", "é", None, "abc"]


def test_points_finals_and_keys(spark):
    words = [N("כָּתַבְתִּי"), N("מֶלֶךְ"), "כתב־תי ab", "", None]
    assert column(spark, words, text.strip_points) == ["כתבתי", "מלך", "כתב־תי ab", "", None]
    assert column(spark, words, text.skeleton) == ["כתבתי", "מלכ", "כתבתי", "", None]
    assert column(spark, words, text.plene_key)[:2] == ["כתבת", "מלכ"]
    assert column(spark, [N("מֶלֶכְ"), "מםמ", "x", ""], text.apply_finals) == [N("מֶלֶךְ"), "מממ"[:2] + "ם", "x", ""]
    assert column(spark, [N("קָֽם"), N("קׇם")], text.loose_key) == [N("קָמ"), N("קָמ")]
    assert column(spark, [N("קָם"), "קם", None], text.has_points) == [True, False, False]


@pytest.mark.parametrize("pointed,plain", [("דִּבֵּר", "דיבר"), ("קֻם", "קום"), ("שָׁמַר", "שמר"), ("הִלְבִּישׁ", "הלביש"), ("עִוֵּר", "עיוור"), ("סִפֵּר", "סיפר")])
def test_predicted_full_spelling(spark, pointed, plain):
    assert column(spark, [N(pointed)], text.predict_plene) == [plain]


def test_plene_consistency_is_three_valued(spark):
    df = spark.createDataFrame([(N("דִּבֵּר"), "דיבר"), (N("דִּבֵּר"), "ספר"), (None, "x"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.plene_consistent(F.col("a"), F.col("b"))).collect()] == [True, False, None, None]


def test_audit_flags(spark):
    cases = {
        N("שָׁמַר"): [], "ָא": ["MALFORMED_ORPHAN_MARK"], "אׁ": ["MALFORMED_MARK_ON_INVALID_BASE"], "אָָ": ["MALFORMED_REPEATED_MARK"], "אֽ": ["NONSTANDARD_COMBINING_MARK"],
        "אa ב־ג": ["NON_HEBREW_CHARACTER", "HEBREW_PUNCTUATION", "CONTAINS_SPACE"], "\ufb2a": ["PRESENTATION_FORM_IN_RAW", "RAW_NOT_NFC"], "א ָב": ["CONTAINS_SPACE", "MALFORMED_ORPHAN_MARK"],
        "וֺ": [], "אֺ": ["MALFORMED_MARK_ON_INVALID_BASE"], "אָבָ": [], "": [], None: None,
    }
    got = column(spark, list(cases), text.audit)
    assert [r and r["flags"] for r in got] == list(cases.values())
    assert (got[5]["non_hebrew_chars"], got[4]["nonstandard_marks"]) == (["U+0061"], ["U+05BD"])


def test_audit_sends_a_column_to_python_few_times(spark):
    df = spark.createDataFrame([("אa",), ("ָא",)], "w string").distinct()
    raw = F.concat("w", text.nfc(F.translate("w", "ab", "אב")))
    plan, wide = df.select("w", text.audit(raw).alias("a"))._jdf.queryExecution().optimizedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        wide.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert max(wide) <= 8  # 147 when each pattern named the raw string


def test_markup_and_words(spark):
    values = ["[[a#b|שלום]] <!-- x -->'''עולם'''<ref>no</ref>", "[[דבר]]"]
    assert column(spark, values, text.strip_markup) == ["שלום עולם", "דבר"]
    assert column(spark, values, text.hebrew_words) == [["שלום", "עולם"], ["דבר"]]
    assert column(spark, ["גזרת השלמים", "גזרת נל\"י", 'חפ"נ', "אחר"], text.gizra_label) == ["SHLEMIM", "LAMED_YOD_HE", "PE_NUN", "UNMAPPED"]


def test_tags(spark):
    tags = ["V;PST;3;SG;MASC", "V;1;SG;FUT", "V.MSDR", "V;NFIN", "N;SG", "V;2;SG;MASC;IMP", "V;PST;PST", "V;XX", "V;PRS;PL;FEM"]
    parsed = column(spark, tags, features.parse_tag)
    assert [r["canonical_cell"] for r in parsed] == ["PST.3MSG", "FUT.1SG", "MSDR", "NFIN", None, "IMP.2MSG", None, None, "PRS.FPL"]
    assert parsed[0]["mood"] == "IND" and parsed[5]["mood"] == "IMP" and parsed[1]["gender"] == "NA" and parsed[2]["finiteness"] == "NFIN"
    assert [bool(r["tag_error"]) for r in parsed] == [False, False, False, False, True, False, True, True, False]
    bad = column(spark, ["V;PST;SG", "V;IMP;PST;3;SG;MASC", "V;NFIN;SG", "V;PRS;1;SG;MASC", "V;PST;2;SG"], lambda c: features.violations(features.parse_tag(c)))
    assert bad == [["PERSON_MISSING"], ["IMP_WITH_TENSE", "IMP_NOT_2ND_PERSON"], ["NONFINITE_WITH_AGREEMENT"], ["PRS_WITH_PERSON", "1ST_PERSON_WITH_GENDER"], ["2ND_PERSON_WITHOUT_GENDER"]]


def test_cells(spark):
    cells = ["PST.2MSG", "PST.1SG", "PST.3PL", "NFIN"]
    assert column(spark, cells, features.feature_string) == ["PST,2,SG,MASC", "PST,1,SG", "PST,3,PL", "NFIN"]
    assert column(spark, cells, features.tag_of_cell) == ["V;PST;2;SG;MASC", "V;PST;1;SG", "V;PST;3;PL", "V;NFIN"]
    assert column(spark, ["PST.1SG", "MSDR", "?"], features.cell_rank) == [0, 28, 999]
    v4 = ["V;PST;NOM(3,SG,MASC)", "V.MSDR", "V;IMP;NOM(2,PL,FEM)", "V;PST;1;SG", "V;Q(1)", "V;NFIN"]
    assert column(spark, v4, features.cell_of_v4_tag) == ["PST.3MSG", "MSDR", "IMP.2FPL", "PST.1SG", None, "NFIN"]
    with pytest.raises(Exception, match="not a cell"):
        column(spark, ["PST.9X"], features.feature_string)


def test_roots(spark):
    f = lambda k: lambda c: roots.features(roots.split_units(c))[k]
    values = ["קומ", "נפל", N("שׂכר"), "בנה", "סבב", "גלגל", "כתב", "ירד", "אכל"]
    assert column(spark, values, f("structural_class")) == ["hollow_candidate", "initial_nun", "strong", "final_he", "geminate", "quadriliteral", "strong", "initial_yod_waw", "initial_alef"]
    assert column(spark, values, f("structural_signature"))[:5] == ["C.W.C", "N.C.C", "C.C.R", "C.N.H", "C.C.C+GEM"]
    stable = column(spark, values, lambda c: roots.stable_radicals(roots.split_units(c)))
    assert stable[:5] == [["ק", "מ"], ["פ", "ל"], ["ש", "כ", "ר"], ["ב", "נ"], ["ס", "ב"]]
    assert column(spark, [["פ", "ל"], ["ל", "פ"], []], lambda c: roots.is_subsequence(c, F.lit("נפל")), "array<string>") == [True, False, True]
    with pytest.raises(Exception, match="too short"):
        column(spark, ["אב"], f("structural_class"))


def test_content_ids(spark):
    import hashlib

    assert column(spark, ["שמר"], roots.root_id) == ["RT-" + hashlib.sha1("root|שמר".encode()).hexdigest()[:10]]


def test_shin_resolution(spark):
    rows = [("שמר", ["ש-מ-ר"], N("שָׁמַר")), ("שמר", [N("שׂ-מ-ר")], N("שָׁמַר")), ("כתב", [], ""), ("שמר", [N("שׂ-מ-ר"), N("שׁ-מ-ר")], ""), ("שמר", [], "שמר")]
    df = spark.createDataFrame(rows, "r string, v array<string>, l string")
    out = [r[0] for r in df.select(roots.resolve_shin(F.col("r"), F.col("v"), F.col("l"))).collect()]
    assert [(r["method"], r["flags"]) for r in out] == [("FORM", ["SHIN_SIN_FROM_FORM"]), ("SOURCE", ["SHIN_SIN_MISMATCH"]), ("NA", []), ("UNRESOLVED", ["SHIN_SIN_CONFLICT_IN_SOURCES"]), ("UNRESOLVED", ["SHIN_SIN_UNRESOLVED"])]
    assert out[0]["radicals"][0] == N("שׁ")


def test_class_from_shape(spark):
    rows = [("מְדַבֵּר", "לְדַבֵּר", "דִּבֵּר"), ("שׁוֹמֵר", "לִשְׁמֹר", "שָׁמַר"), ("מַלְבִּישׁ", "לְהַלְבִּישׁ", "הִלְבִּישׁ"), ("נִכְנָס", "לְהִכָּנֵס", "נִכְנַס"), ("מִתְלַבֵּשׁ", "לְהִתְלַבֵּשׁ", "הִתְלַבֵּשׁ"), ("מְדֻבָּר", None, "דֻּבַּר"), (None, None, "x")]
    df = spark.createDataFrame([tuple(v and N(v) for v in r) for r in rows], "a string, b string, c string")
    got = [r[0]["binyan"] for r in df.select(features.class_from_shape(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["PIEL", "PAAL", "HIFIL", "NIFAL", "HITPAEL", "PUAL", None]
