"""What goes with canonical tables: provenance, duplicates, missing metadata, typed conflicts, attributes of roots, lexemes of one source only.

All are joins and aggregates over the build's long tables; nothing is guessed, and what is left out is listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features, roots, text
from lexspark.operators import quality, resolve
from lexspark.plans import evidence, splits


@dataclass(frozen=True)
class Source:
    """A pinned source: where its records are, at which version, when it was fetched and by which parser it was read."""

    name: str
    base_url: str
    version: str
    retrieved: str
    parser: str
    file: str | None = None

    def line_url(self, file: Column, line: Column) -> Column:
        return text.line_url(self.base_url, self.version, file, line)

    def revision_url(self, title: Column, revision: Column) -> Column:
        return text.revision_url(self.base_url, title, revision)


PROVENANCE = ["canonical_record_id", "record_type", "field_supported", "source_name", "source_url", "source_file", "source_version_or_commit", "source_record_identifier", "source_line_if_available", "retrieval_date", "parser_version", "raw_source_value"]


def numbered(df: DataFrame, prefix: str, name: str, width: int = 7) -> DataFrame:
    """df with running ids under `name`, in an order of the rows' own hash, without a window over all rows."""
    rows = df.withColumn("_h", F.md5(F.to_json(F.struct(*df.columns))))
    ranked = splits.global_rank(rows, "_h", [])
    return ranked.select(F.concat(F.lit(prefix), F.lpad(F.col("rank").cast("string"), width, "0")).alias(name), *df.columns)


def from_lines(rows: DataFrame, source: Source, kind: str, field: str) -> DataFrame:
    """Provenance of rows(record_id, file, line_no, raw)."""
    place = F.concat_ws(":", "file", "line_no")
    values = [F.col("record_id"), F.lit(kind), F.lit(field), F.lit(source.name), source.line_url(F.col("file"), F.col("line_no")), F.col("file"), F.lit(source.version), place, F.col("line_no").cast("long"), F.lit(source.retrieved), F.lit(source.parser), F.col("raw")]
    return rows.select(*[v.alias(n) for n, v in zip(PROVENANCE, values)]).distinct()


def from_pages(rows: DataFrame, source: Source, kind: str) -> DataFrame:
    """Provenance of rows(record_id, field, source_record, page_title, rev_id, raw)."""
    values = [F.col("record_id"), F.lit(kind), F.col("field"), F.lit(source.name), source.revision_url(F.col("page_title"), F.col("rev_id")), F.lit(source.file), F.lit(source.version), F.col("source_record"), F.lit(None).cast("long"), F.lit(source.retrieved), F.lit(source.parser), F.coalesce("raw", F.lit(""))]
    return rows.select(*[v.alias(n) for n, v in zip(PROVENANCE, values)]).distinct()


def raw_records(entries: DataFrame, tables: DataFrame, full: DataFrame) -> DataFrame:
    """(record_id, kind, raw, gloss_en, heading, gizra_labels, gizra_raw, registers, homonym, class_raw): what records state besides root and class."""
    none = lambda name: F.lit(None).cast("string").alias(name)
    rest = ["gloss_en", "heading", "gizra_labels", "gizra_raw", "registers", "homonym"]
    first = entries.select(
        evidence.entry_id().alias("record_id"), F.lit("entry").alias("kind"), F.col("root_value_raw").alias("raw"), "gloss_en", F.col("section_heading_raw").alias("heading"), "gizra_labels", "gizra_raw", "registers",
        F.col("root_homonym_index").alias("homonym"), F.trim("binyan_raw").alias("class_raw"),
    )
    cells = [df.select(i.alias("record_id"), F.lit(k).alias("kind"), F.col("value_raw").alias("raw"), *map(none, rest), F.trim("binyan_raw").alias("class_raw")) for df, i, k in ((tables, evidence.table_id(), "conj_table"), (full, evidence.full_id(), "full_table"))]
    return reduce(DataFrame.unionByName, [first, *cells]).dropDuplicates(["record_id"])


def agreeing(ev: DataFrame, decided: DataFrame, weak: list[str] = evidence.WEAK) -> DataFrame:
    """Evidence that counted, with whether it agrees with the decided root (by_root) and class (by_class)."""
    strong = ~F.col("method").isin(*weak)
    any_strong = ev.groupBy("lexeme_id").agg(F.bool_or(strong).alias("any_strong"))
    d = decided.select("lexeme_id", F.col("root").alias("decided_root"), F.col("binyan").alias("decided_class"))
    used = ev.join(any_strong, "lexeme_id").where(strong | ~F.col("any_strong")).drop("any_strong").join(d, "lexeme_id")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return used.withColumns({"by_root": same("root_bare", "decided_root"), "by_class": same("binyan", "decided_class")}).drop("decided_root", "decided_class")


def _joined(value: Column, sep: str = "|") -> Column:
    """Aggregate: distinct values in order, or NULL."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(value)), sep), F.lit(""))


def _parts(value: Column, sep: str) -> Column:
    """Aggregate: distinct parts of joined lists in order."""
    return F.nullif(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split(value, sep))))), sep.replace("\\", "")), F.lit(""))


def lexeme_attributes(used: DataFrame, raw: DataFrame) -> DataFrame:
    """What the agreeing records of a lexeme state: glosses, homonyms, labels, registers, raw class labels, and their ids."""
    one = used.where("by_root or by_class").groupBy("lexeme_id", "record_id").agg(F.bool_or("by_root").alias("by_root"), F.bool_or("by_class").alias("by_class"))
    a = one.join(raw, "record_id", "left")
    return a.groupBy("lexeme_id").agg(
        _joined(F.col("gloss_en"), "; ").alias("gloss_en"), _joined(F.when(F.col("heading").contains("משני"), F.col("heading"))).alias("sense_id"), _parts(F.when(F.col("by_root"), F.col("gizra_labels")), r"\+").alias("gizra_labels"),
        _parts(F.col("registers"), r"\|").alias("wiktionary_registers"), _joined(F.when(F.col("by_class"), F.col("class_raw"))).alias("binyan_raw"), _joined(F.when(F.col("by_root"), F.col("homonym"))).alias("root_homonym_index"),
        _joined(F.col("record_id")).alias("record_ids"), (F.count_distinct(F.when(F.col("by_root") & (F.col("kind") == "entry"), F.coalesce("homonym", F.lit("")))) > 1).alias("several_sections"),
    )


def root_attributes(lexemes: DataFrame, used: DataFrame, raw: DataFrame) -> DataFrame:
    """(root_id, root_raw, traditional_class, traditional_class_raw, source_ids, root_flags): labels that entries state, never inferred."""
    stated = used.where("by_root").select("lexeme_id", "record_id", F.col("root").alias("as_stated")).distinct().join(raw.select("record_id", "kind", "raw", "gizra_labels", "gizra_raw"), "record_id", "left")
    rows = lexemes.where("root_id is not null").select("lexeme_id", "root_id", "root_normalized", F.col("shin_sin_resolution").alias("shin")).join(stated, "lexeme_id", "left")
    labels = F.when(F.col("kind") == "entry", F.col("gizra_labels"))
    g = rows.groupBy("root_id", "root_normalized").agg(
        F.min(F.coalesce(F.nullif("raw", F.lit("")), "as_stated", "root_normalized")).alias("root_raw"), F.flatten(F.collect_set(F.split(labels, r"\+"))).alias("labels"), F.count_distinct(labels).alias("n_sets"),
        _joined(F.when(F.col("kind") == "entry", F.col("gizra_raw")), " ; ").alias("traditional_class_raw"), _joined(F.col("record_id")).alias("source_ids"), F.collect_set("shin").alias("shins"),
    )
    known = F.array_sort(F.array_distinct(F.array_remove("labels", "UNMAPPED")))
    checks = {
        "SHIN_SIN_FROM_FORM": F.arrays_overlap("shins", F.array(F.lit("FORM"), F.lit("MIXED"))), "SHIN_SIN_UNRESOLVED": F.array_contains("shins", "UNRESOLVED"), "TRADITIONAL_CLASS_VARIES_ACROSS_ENTRIES": F.col("n_sets") > 1,
        "TRADITIONAL_CLASS_UNMAPPED_LABEL": F.array_contains("labels", "UNMAPPED"), "TRADITIONAL_CLASS_NOT_STATED": F.size(known) == 0,
        "UNEXPECTED_ROOT_LENGTH": ~F.size(roots.split_units(F.col("root_normalized"))).isin(3, 4),
    }
    flags = F.array_compact(F.array(*[F.when(there, name) for name, there in checks.items()]))
    return g.select("root_id", "root_raw", F.nullif(F.array_join(known, "+"), F.lit("")).alias("traditional_class"), "traditional_class_raw", "source_ids", flags.alias("root_flags"))


#: Conflicts about the root, about the class, and about both (the evidence that counted); others name their own sources.
ROOT_CONFLICTS = ["ROOT_FORM_MISMATCH", "SHIN_SIN_MISMATCH", "SHIN_SIN_CONFLICT_IN_SOURCES"]
CLASS_CONFLICTS = ["BINYAN_SHAPE_DISAGREES"]
OPEN_CONFLICTS = ["ROOT_AMBIGUOUS", "BINYAN_AMBIGUOUS"]


def conflicts(flags: DataFrame, lexemes: DataFrame, forms: DataFrame, used: DataFrame) -> DataFrame:
    """(conflict_type, record_type, record_id, lemma, details, candidates, sources): a typed row for each thing left open.

    candidates: for an open root or class the claims as sorted JSON; sources: the records or lines that disagree.
    """
    errors = flags.where("severity = 'ERROR' or check_name = 'UNVOC_SPELLING_VARIANTS'")
    kind = F.when(F.col("check_name") == "UNVOC_SPELLING_VARIANTS", "CELL_CONFLICT_UNVOCALIZED").otherwise(F.col("check_name"))
    errors = errors.select(kind.alias("conflict_type"), "record_type", "record_id", "details")
    claims = used.groupBy(F.col("lexeme_id").alias("record_id")).agg(
        F.to_json(F.array_sort(F.collect_set(F.struct("method", "record_id", "root", "binyan", "page_title")))).alias("claims"), _joined(F.col("root_bare"), ", ").alias("roots"), _joined(F.col("binyan"), ", ").alias("classes"),
        _joined(F.col("record_id")).alias("all_records"), _joined(F.when(F.col("by_root"), F.col("record_id"))).alias("root_records"), _joined(F.when(F.col("by_class"), F.col("record_id"))).alias("class_records"),
    )
    lemma = lexemes.select(F.col("lexeme_id").alias("record_id"), F.col("lemma_vocalized").alias("lemma"), F.col("citation_past_3ms_vocalized").alias("past"), F.col("root_bare").alias("r"), F.col("binyan").alias("b"), F.col("binyan_shape_heuristic").alias("shape"))
    of_form = forms.select("form_id", F.col("lexeme_id"), "form_vocalized", "form_unvocalized", F.col("source_ids").alias("lines"))
    named = errors.where("record_type = 'form'").join(of_form, F.col("record_id") == F.col("form_id")).join(lemma.select(F.col("record_id").alias("lexeme_id"), "lemma"), "lexeme_id", "left")
    words = F.when(F.col("conflict_type") == "VOC_UNVOC_INCONSISTENT", F.concat_ws(" vs ", "form_vocalized", "form_unvocalized")).otherwise(F.concat_ws(" | ", F.when(F.col("conflict_type") == "CELL_CONFLICT_UNVOCALIZED", F.col("form_unvocalized")).otherwise(F.col("form_vocalized")), F.regexp_replace("details", r"\|", " | ")))
    none = F.lit(None).cast("string")
    from_forms = named.select("conflict_type", "record_type", "record_id", "lemma", words.alias("details"), none.alias("candidates"), F.col("lines").alias("sources"))
    rows = errors.where("record_type = 'lexeme'").join(lemma, "record_id").join(claims, "record_id", "left")
    t = F.col("conflict_type")
    told = (
        F.when(t == "ROOT_AMBIGUOUS", F.concat(F.lit("several roots: "), "roots")).when(t == "BINYAN_AMBIGUOUS", F.concat(F.lit("several classes: "), "classes")).when(t == "LEMMA_CITATION_MISMATCH", F.concat_ws(" is cited as ", "lemma", "past"))
        .when(t == "BINYAN_SHAPE_DISAGREES", F.concat(F.lit("stated "), "b", F.lit(", by its shape "), "shape")).when(t == "ROOT_FORM_MISMATCH", F.concat(F.lit("root "), "r", F.lit(" is not in "), F.coalesce("past", "lemma")))
        .when(t == "WIKT_TABLE_ASSERTS_ROOT_BINYAN_ABSENT", F.concat(F.lit("a table has no "), "r", F.lit(" in "), "b")).otherwise(F.col("details"))
    )
    sources = F.when(t.isin(*OPEN_CONFLICTS), F.col("all_records")).when(t.isin(*ROOT_CONFLICTS), F.col("root_records")).when(t.isin(*CLASS_CONFLICTS), F.col("class_records"))
    from_lexemes = rows.select("conflict_type", "record_type", "record_id", "lemma", told.alias("details"), F.when(t.isin(*OPEN_CONFLICTS), F.col("claims")).alias("candidates"), sources.alias("sources"))
    return from_forms.unionByName(from_lexemes)


DUPLICATE = ["duplicate_type", "record_ids", "lemma", "details"]


def duplicates(lexemes: DataFrame, forms: DataFrame, members: DataFrame) -> DataFrame:
    """(duplicate_type, record_ids, lemma, details): merged paradigms, lexemes of one root and class, forms of several lexemes. Reported, not dropped."""
    merged = members.groupBy("lexeme_id").agg(F.min("lemma").alias("lemma"), F.array_join(F.sort_array(F.collect_set("paradigm_key")), ", ").alias("keys"), F.count_distinct("paradigm_key").alias("n")).where("n > 1")
    merged = merged.select(F.lit("IDENTICAL_SOURCE_PARADIGMS").alias(DUPLICATE[0]), F.col("lexeme_id").alias(DUPLICATE[1]), "lemma", F.concat(F.lit("merged: "), "keys").alias(DUPLICATE[3]))
    pair = lexemes.where("root_id is not null and binyan is not null").groupBy("root_normalized", "binyan").agg(F.sort_array(F.collect_list(F.struct("lexeme_id", "lemma_vocalized"))).alias("x")).where(F.size("x") > 1)
    pair = pair.select(F.lit("DUPLICATE_ROOT_BINYAN"), F.array_join("x.lexeme_id", "|"), F.array_join("x.lemma_vocalized", " / "), F.concat(F.size("x").cast("string"), F.lit(" lexemes of "), "root_normalized", F.lit(" in "), "binyan")).toDF(*DUPLICATE)
    shared = forms.where("form_vocalized is not null").groupBy("form_vocalized").agg(_joined(F.col("lexeme_id")).alias("ids"), F.count_distinct("lexeme_id").alias("n"), _joined(F.col("canonical_cell")).alias("cells")).where("n > 1")
    shared = shared.select(F.lit("SAME_VOCALIZED_FORM_DIFFERENT_LEXEMES"), "ids", "form_vocalized", F.concat(F.lit("cells "), "cells")).toDF(*DUPLICATE)
    return reduce(DataFrame.unionByName, [merged, pair, shared])


def source_only(entries: DataFrame, tables: DataFrame, full: DataFrame, ev: DataFrame, lexemes: DataFrame, source: str = "hewiktionary") -> dict[str, DataFrame]:
    """Lexemes that only entries know: those no lexeme has as evidence, with headword, root and class.

    Returns lexemes(lexeme_id, headword, root_bare, root_normalized, binyan, plain, flags, ...), forms(lexeme_id, cell, forms, records), their evidence,
    and what was not taken: duplicates (root and class are there already) and missing (a field is not stated).
    """
    e = entries.withColumn("record_id", evidence.entry_id()).join(ev.where("kind = 'entry'").select("record_id").distinct(), "record_id", "left_anti")
    e = e.withColumn("root_bare", roots.bare_key(F.col("root_radicals")))
    lacking = F.concat_ws("|", *[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(n)) for c, n in (("headword", "headword"), ("root_bare", "root"), ("binyan", "binyan"))])
    e = e.withColumn("lacking", lacking)
    missing = e.where("lacking <> ''").select("record_id", F.lit("wiktionary_entry").alias("record_type"), F.col("headword").alias("lemma"), F.col("lacking").alias("missing_fields"), F.concat_ws(" ", "binyan_raw", "root_value_raw").alias("details"))
    whole = e.where("lacking = ''").withColumn("shin", roots.resolve_shin(F.col("root_bare"), F.array("root_radicals"), F.col("headword")))
    whole = whole.withColumn("norm", F.array_join("shin.radicals", ""))
    there = lexemes.where("root_normalized is not null and binyan is not null").select(F.col("root_normalized").alias("norm"), "binyan").distinct()
    again = whole.join(there, ["norm", "binyan"], "left_semi")
    again = again.select(F.lit("WIKT_ENTRY_FOR_EXISTING_ROOT_BINYAN"), "record_id", "headword", F.concat("root_bare", F.lit(" in "), "binyan", F.lit(" is there already"))).toDF(*DUPLICATE)
    key = F.concat_ws("|", F.lit(source), "headword", "root_bare", "binyan")
    new = whole.join(there, ["norm", "binyan"], "left_anti").groupBy("headword", "root_bare", "binyan").agg(
        F.sort_array(F.collect_set("root_radicals")).alias("variants"), F.min("ktiv_male").alias("plain"), _joined(F.col("record_id")).alias("entry_ids"), _joined(F.col("binyan_raw")).alias("binyan_raw"), _joined(F.col("gloss_en"), "; ").alias("gloss_en"),
        _parts(F.col("gizra_labels"), r"\+").alias("gizra_labels"), _parts(F.col("registers"), r"\|").alias("wiktionary_registers"), _joined(F.col("root_homonym_index")).alias("root_homonym_index"),
        F.min(F.struct("record_id", "page_title", "rev_id", "section_heading_raw", "template_raw")).alias("first_entry"),
    )
    new = new.withColumns({"lexeme_id": roots.content_id("LX-", key), "shin": roots.resolve_shin(F.col("root_bare"), F.col("variants"), F.col("headword"))})
    probe = new.select("lexeme_id", F.col("headword").alias("lemma"), F.col("headword").alias("past"), F.lit(None).cast("string").alias("infinitive"), F.lit(None).cast("string").alias("plain_lemma"))
    own = evidence.gather(probe, entries, tables, full).join(new.select("lexeme_id", F.col("root_bare").alias("own_root"), F.col("binyan").alias("own_class")), "lexeme_id")
    own = own.where((F.col("root_bare") == F.col("own_root")) | (F.col("binyan") == F.col("own_class"))).drop("own_root", "own_class")
    dec = resolve.decide(own, "lexeme_id", evidence.WEAK).select("lexeme_id", F.col("root").alias("d_root"), F.col("binyan").alias("d_class"), F.col("status").alias("d_status"), "root_kinds", "binyan_kinds", "methods", "conf_root", "conf_binyan", "match_score")
    cells = evidence.corroborating_cells(new.select("lexeme_id", "root_bare", "binyan", F.col("headword").alias("lemma")), tables, full).where("cell <> 'PST.3MSG'").select("lexeme_id", "cell", "form", "record_id")
    cited = new.select("lexeme_id", F.lit("PST.3MSG").alias("cell"), F.col("headword").alias("form"), F.col("first_entry.record_id").alias("record_id"))
    forms = cells.unionByName(cited).groupBy("lexeme_id", "cell").agg(F.sort_array(F.collect_set("form")).alias("forms"), _joined(F.col("record_id")).alias("records"))
    at = lambda cell: F.max(F.when(F.col("cell") == cell, F.get("forms", F.lit(0))))
    shape = forms.groupBy("lexeme_id").agg(at("PRS.MSG").alias("present"), at("NFIN").alias("infinitive"), F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("cell").isin(*features.PAST_CELLS)).alias("past_observed_cells"))
    out = new.join(dec, "lexeme_id", "left").join(shape, "lexeme_id", "left")
    out = out.withColumn("shape", features.class_from_shape(F.col("present"), F.col("infinitive"), F.col("headword")))
    gone = evidence.asserted_absent(tables).withColumn("absent", F.lit(True))
    out = out.join(gone, ["root_bare", "binyan"], "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) < 2
    fits = roots.is_subsequence(roots.stable_radicals(text.characters(F.col("root_bare"))), text.skeleton(text.strip_points(F.col("headword"))))
    checks = {
        "WIKTIONARY_ONLY_LEXEME": F.lit(True), "ROOT_AMBIGUOUS": differs("d_root", "root_bare"), "BINYAN_AMBIGUOUS": ~differs("d_root", "root_bare") & differs("d_class", "binyan"), "SINGLE_EVIDENCE_KIND_ROOT": few("root_kinds"),
        "SINGLE_EVIDENCE_KIND_BINYAN": few("binyan_kinds"), "BINYAN_SHAPE_DISAGREES": F.col("shape.binyan") != F.col("binyan"), "BINYAN_SHAPE_UNDETERMINED": F.col("shape.binyan").isNull(), "ROOT_FORM_MISMATCH": ~F.coalesce(fits, F.lit(False)),
        "WIKT_TABLE_ASSERTS_ROOT_BINYAN_ABSENT": F.col("absent"),
    }
    flags = F.array_sort(F.array_union(F.array_compact(F.array(*[F.when(there, name) for name, there in checks.items()])), "shin.flags"))
    return {"lexemes": out.withColumns({"flags": flags, "root_normalized": F.array_join("shin.radicals", "")}), "forms": forms, "evidence": own, "duplicates": again, "missing": missing}


def missing_metadata(lexemes: DataFrame, forms: DataFrame) -> DataFrame:
    """Records of which a field that should be there is not stated."""
    parts = [quality.missing_fields(lexemes, "lexeme_id", ["root_id", "binyan", "lemma_unvocalized"], "lexeme"), quality.missing_fields(forms, "form_id", ["form_vocalized", "form_unvocalized"], "form")]
    return reduce(DataFrame.unionByName, parts)
