"""Segmentation, pairing, evidence and the canonical build on miniature sources."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.operators import quality, resolve
from lexspark.plans import build, contract, evidence, pairing
from lexspark.sources import wikitext

N = lambda s: s and unicodedata.normalize("NFC", s)
@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Rows are few and plans large: compiling them would take longer than running them."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


TRIPLE = "file string, line_no long, lemma_raw string, form_raw string, tag_raw string"


def lines(spark, file, rows):
    return pairing.verb_lines(spark.createDataFrame([(file, i + 1, *map(N, r)) for i, r in enumerate(rows)], TRIPLE))


KATAV = [("כָּתַב", "כָּתַב", "V;PST;3;SG;MASC"), ("כָּתַב", "כָּתַבְתִּי", "V;PST;1;SG"), ("כָּתַב", "כּוֹתֵב", "V;PRS;SG;MASC"), ("כָּתַב", "לִכְתֹּב", "V;NFIN")]
SAGAR = [("סָגַר", "סָגַר", "V;PST;3;SG;MASC"), ("סָגַר", "סוֹגֵר", "V;PRS;SG;MASC")]
PLAIN = [("כתב", "כתב", "V;PST;3;SG;MASC"), ("כתב", "כתבתי", "V;PST;1;SG"), ("כתב", "כותב", "V;PRS;SG;MASC"), ("כתב", "לכתוב", "V;NFIN"), ("סגר", "סגר", "V;PST;3;SG;MASC"), ("סגר", "סוגר", "V;PRS;SG;MASC")]


def test_segmentation_breaks_at_other_lines_and_lemmas(spark):
    rows = [("א", "ספר", "N;SG"), *KATAV[:2], ("x", "y", "N;SG"), *KATAV[2:], *SAGAR, ("סָגַר", "סָגַר", "V;PST;3;SG;MASC"), ("סָגַר", "x", "V;BAD")]
    p = {r["paradigm_key"]: r for r in pairing.paradigms(lines(spark, "v", rows)).collect()}
    assert sorted(p) == ["v:2", "v:5", "v:7"]
    assert (p["v:7"]["n_lines"], p["v:7"]["n_cells"], p["v:7"]["n_duplicate_cells"], p["v:7"]["n_tag_errors"]) == (4, 2, 1, 1)


def test_pairing_and_unpaired(spark):
    voc = lines(spark, "v", [*KATAV, *SAGAR, ("רָץ", "רָץ", "V;PST;3;SG;MASC")])
    unv = lines(spark, "u", PLAIN)
    got = {r["voc_key"]: r for r in pairing.pair(voc, unv, pairing.paradigms(unv)).collect()}
    assert (got["v:1"]["unv_key"], got["v:1"]["status"], got["v:1"]["score"]) == ("u:1", "PAIRED", 1.0)
    assert (got["v:5"]["unv_key"], got["v:5"]["status"]) == ("u:5", "PAIRED")
    assert (got["v:7"]["unv_key"], got["v:7"]["status"], got["v:7"]["score"]) == (None, "UNPAIRED", 0.0)


def test_edit_distance_settles_ties(spark):
    voc = lines(spark, "v", [("דִּבֵּר", "דִּבֵּר", "V;PST;3;SG;MASC")])
    unv = lines(spark, "u", [("דבר", "דבר", "V;PST;3;SG;MASC"), ("דיבר", "דיבר", "V;PST;3;SG;MASC")])
    got = pairing.pair(voc, unv, pairing.paradigms(unv)).first()
    assert (got["unv_key"], got["status"], got["edit_distance"], got["tied"]) == ("u:2", "PAIRED", 0, ["u:1", "u:2"])
    same = lines(spark, "u", [("דבר", "דבר", "V;PST;3;SG;MASC"), ("דבר ", "דבר", "V;PST;3;SG;MASC")])
    assert pairing.pair(voc, same, pairing.paradigms(same)).first()["status"] == "PAIRED_TIE_IDENTICAL"


def test_orphans_attach_only_if_unique(spark):
    cells = spark.createDataFrame([("L1", "כתב", "A", "k"), ("L1", "כתב", "B", "m"), ("L2", "ספר", "A", "k")], "lexeme_id string, unv_lemma string, cell string, key string")
    orphans = spark.createDataFrame([("o1", "כתב", "A", "k"), ("o2", "x", "A", "k"), ("o3", "x", "B", "m"), ("o4", "x", "C", "z")], "orphan string, lemma string, cell string, key string")
    got = {r["orphan"]: (r["lexeme_id"], r["n_hits"]) for r in pairing.attach_orphans(orphans, cells).collect()}
    assert got == {"o1": ("L1", 2), "o2": (None, 2), "o3": ("L1", 1), "o4": (None, 0)}


EV = "lexeme_id string, method string, kind string, weight double, record_id string, root string, root_bare string, binyan string"


@pytest.mark.parametrize(
    "claims,want",
    [
        ([("entry_headword_exact", "entry", 0.8, "r1", "כתב", "PAAL"), ("conj_table_past_exact", "conj_table", 0.8, "r2", "כתב", "PAAL")], ("MATCHED", "כתב", "PAAL", 0.96, 0.96, 0.96)),
        ([("entry_headword_exact", "entry", 0.8, "r1", "כתב", "PAAL"), ("conj_table_past_exact", "conj_table", 0.8, "r2", "כתמ", "PAAL")], ("ROOT_AMBIGUOUS", None, "PAAL", 0.0, 0.96, 0.96)),
        ([("entry_headword_exact", "entry", 0.8, "r1", "כתב", "PAAL"), ("conj_table_past_exact", "conj_table", 0.8, "r2", "כתמ", "PIEL")], ("ROOT_AND_BINYAN_AMBIGUOUS", None, None, 0.0, 0.0, 0.0)),
        ([("entry_ktiv_male_unvocalized", "entry", 0.3, "r1", "כתב", "PAAL")], ("MATCHED_UNVOC_ONLY", "כתב", "PAAL", 0.3, 0.3, 0.3)),
        ([("entry_ktiv_male_unvocalized", "entry", 0.3, "r1", "כתב", None)], ("NO_MATCH", None, None, 0.0, 0.0, 0.0)),
        ([("entry_headword_exact", "entry", 0.8, "r1", "כתב", None), ("entry_ktiv_male_unvocalized", "entry", 0.3, "r2", "ספר", "PAAL")], ("MATCHED", "כתב", None, 0.8, 0.0, 0.8)),
    ],
)
def test_decisions_never_guess(spark, claims, want):
    df = spark.createDataFrame([("L", m, k, w, r, root, root, b) for m, k, w, r, root, b in claims], EV)
    r = resolve.decide(df, "lexeme_id", evidence.WEAK).first()
    assert (r["status"], r["root"], r["binyan"], r["conf_root"], r["conf_binyan"], r["match_score"]) == want


ENTRY = "==כָּתַב==\n{{ניתוח דקדוקי לפועל|\n|כתיב מלא=כתב\n|שורש וגזרה={{שרש3|כ|ת|ב}}\n|בניין=קל}}\n"
ONLY = "=={0}==\n{{{{ניתוח דקדוקי לפועל|\n|כתיב מלא={1}\n|שורש וגזרה={2}\n|בניין={3}}}}}\n"
TABLES = "{{נטיות פעלים|שורש=כ־ת־ב\n|קל עבר=כָּתַב\n|קל הווה=כּוֹתֶבֶת\n|קל שם הפועל=לִכְתֹּב\n|פיעל עבר=-אין-}}"
PAGE = "title string, ns int, page_id long, rev_id long, timestamp string, text string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")
    more = (ENTRY + ONLY.format("שָׁבַר", "שבר", "{{שרש3|שׁ|ב|ר}}, [[גזרת השלמים]]", "קל") + ONLY.format("כִּתֵּב", "כיתב", "{{שרש3|כ|ת|ב}}", "") + ONLY.format("כָּתָב", "כתאב", "{{שרש3|כ|ת|ב}}", "קל"))
    pages = spark.createDataFrame([("כתב", 0, 1, 9, "t", N(more)), ("כתב (שורש)", 0, 2, 8, "t", N(TABLES))], PAGE)
    entries = wikitext.verb_entries(pages)
    entries = entries.withColumn("binyan", wikitext.class_label(F.col("binyan_raw"))["binyan"])
    tables = wikitext.conjugation_tables(pages).withColumnRenamed("title", "page_title")
    full = wikitext.full_tables(pages).withColumnRenamed("title", "page_title")
    out = build.build(lines(spark, "v", [*KATAV, *SAGAR]), lines(spark, "u", PLAIN), entries, tables, full)
    return {k: v.coalesce(2).cache() for k, v in out.items()}


def test_canonical_tables(built):
    lex = {r["lemma_vocalized"]: r for r in built["lexemes"].collect()}
    a, b = lex[N("כָּתַב")], lex[N("סָגַר")]
    assert (a["root_bare"], a["binyan"], a["match_status"], a["binyan_shape_heuristic"]) == ("כתב", "PAAL", "MATCHED", "PAAL")
    assert a["confidence_root"] == round(1 - 0.2 * 0.2 * 0.3, 4) and a["match_method"] == "conj_table_infinitive_exact|conj_table_past_exact|entry_headword_exact"
    assert (b["root_bare"], b["match_status"], b["quality_tier"]) == (None, "NO_MATCH", "QUESTIONABLE")
    forms = {(r["form_vocalized"]): r for r in built["forms"].collect()}
    assert forms[N("כָּתַב")]["wiktionary_corroborated"] and forms[N("כָּתַבְתִּי")]["wiktionary_corroborated"] is None
    assert forms[N("כּוֹתֵב")]["wiktionary_corroborated"] is False and forms[N("כּוֹתֵב")]["quality_tier"] == "QUESTIONABLE"
    assert forms[N("לִכְתֹּב")]["form_unvocalized"] == "לכתוב" and forms[N("לִכְתֹּב")]["plene_consistent"]
    flags = {(r["record_id"], r["check_name"]): r["severity"] for r in built["flags"].collect()}
    assert flags[a["lexeme_id"], "WIKT_CELL_CONFLICTS_IN_PARADIGM"] == "WARNING" and flags[b["lexeme_id"], "ROOT_MISSING"] == "ERROR"
    assert a["quality_tier"] == "SILVER"
    rows = {r["root_normalized"]: r for r in built["roots"].collect()}
    assert (rows["כתב"]["structural_class"], rows["כתב"]["n_lexemes"], rows["כתב"]["traditional_class"]) == ("strong", 1, None) and "TRADITIONAL_CLASS_NOT_STATED" in rows["כתב"]["quality_flags"]
    assert (rows[N("שׁבר")]["traditional_class"], rows[N("שׁבר")]["quality_flags"]) == ("SHLEMIM", [])
    assert {r["conflict_type"] for r in built["conflicts"].collect()} >= {"ROOT_MISSING", "WIKT_FORM_MISMATCH"}


def test_source_only_lexemes_duplicates_and_missing(built):
    only = built["lexemes"].where("not has_unimorph_paradigm").collect()
    assert [(r["lemma_vocalized"], r["root_normalized"], r["binyan"], r["match_status"], r["lemma_unvocalized"]) for r in only] == [(N("שָׁבַר"), N("שׁבר"), "PAAL", "WIKTIONARY_ONLY", "שבר")]
    assert "WIKTIONARY_ONLY_LEXEME" in only[0]["quality_flags"] and only[0]["quality_tier"] == "SILVER"
    form = built["forms"].where(F.col("lexeme_id") == only[0]["lexeme_id"]).collect()
    assert [(r["canonical_cell"], r["form_vocalized"], r["form_unvocalized"], r["person"], r["plene_consistent"]) for r in form] == [("PST.3MSG", N("שָׁבַר"), "שבר", "3", True)]
    found = {(r["duplicate_type"], r["lemma"]) for r in built["duplicates"].collect()}
    assert ("WIKT_ENTRY_FOR_EXISTING_ROOT_BINYAN", N("כָּתָב")) in found
    missing = {(r["record_type"], r["missing_fields"]) for r in built["missing"].collect()}
    assert ("wiktionary_entry", "binyan") in missing and ("lexeme", "root_id|binyan") in missing


def test_every_record_has_provenance(built):
    p = built["provenance"].cache()
    ids = [built[t].select(F.col(k).alias("i")) for t, k in (("roots", "root_id"), ("lexemes", "lexeme_id"), ("forms", "form_id"))]
    every = ids[0].unionByName(ids[1]).unionByName(ids[2])
    assert every.join(p, F.col("i") == F.col("canonical_record_id"), "left_anti").isEmpty() and p.join(every, F.col("i") == F.col("canonical_record_id"), "left_anti").isEmpty()
    assert p.select("provenance_id").distinct().count() == p.count() and p.where("source_url is null or raw_source_value is null").isEmpty()
    lines_ = p.where("source_name = 'unimorph'")
    assert lines_.where("source_line_if_available is null or not source_url like '%/blob/unpinned/%#L%'").isEmpty()


def test_conflicts_are_typed(built):
    rows = {(r["conflict_type"], r["record_type"]): r for r in built["conflicts"].collect()}
    wrong = rows["WIKT_FORM_MISMATCH", "form"]
    assert wrong["lemma"] == N("כָּתַב") and "v:" in wrong["sources"] and wrong["details"]
    assert rows["ROOT_MISSING", "lexeme"]["lemma"] == N("סָגַר")


def test_contract(spark, built):
    whole = {t: spark.createDataFrame(built[t].collect(), built[t].schema).coalesce(1) for t in ("roots", "lexemes", "forms", "provenance", "validation")}  # rows alone, without their plan
    for table, df in whole.items():
        contract.enforce(df, table)
    built = whole
    contract.foreign_keys(built["roots"], built["lexemes"], built["forms"], built["provenance"])
    with pytest.raises(quality.SchemaViolation, match="null"):
        contract.enforce(built["forms"].withColumn("canonical_cell", F.lit(None).cast("string")), "forms")
    with pytest.raises(quality.SchemaViolation, match="not unique"):
        contract.enforce(built["roots"].unionByName(built["roots"]), "roots")
    with pytest.raises(quality.SchemaViolation, match="not one of"):
        contract.enforce(built["forms"].withColumn("tense", F.lit("AORIST")), "forms")
    with pytest.raises(quality.SchemaViolation, match="NFC"):
        contract.enforce(built["lexemes"].withColumn("lemma_vocalized", F.lit("\ufb2a")), "lexemes")
    with pytest.raises(quality.SchemaViolation, match="lacks"):
        contract.enforce(built["roots"].drop("root_raw"), "roots")
    with pytest.raises(quality.SchemaViolation, match="provenance"):
        contract.foreign_keys(built["roots"], built["lexemes"], built["forms"], built["provenance"].limit(1))
    assert json.loads(contract.schema_json())["tables"]["forms"]["primary_key"] == "form_id"
