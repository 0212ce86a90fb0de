"""Canonical tables out of paradigms and evidence: flags as one long table, tiers, conflicts.

Every resolver is unanimous or NULL with a conflict; checks never write data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import features, roots, text
from lexspark.operators import ordered, quality
from lexspark.plans import canonical, evidence, pairing, records

# Flags by consequence (fixed values).
LEXEME_HARD = [
    "ROOT_MISSING", "BINYAN_MISSING", "ROOT_AMBIGUOUS", "BINYAN_AMBIGUOUS", "MATCH_UNVOC_ONLY", "BINYAN_SHAPE_DISAGREES", "ROOT_FORM_MISMATCH", "SHIN_SIN_MISMATCH", "DUPLICATE_ROOT_BINYAN",
    "LEMMA_CITATION_MISMATCH", "WIKT_TABLE_ASSERTS_ROOT_BINYAN_ABSENT", "VOC_UNVOC_UNPAIRED", "VOC_UNVOC_PAIRING_AMBIGUOUS", "SAME_LEMMA_DIFFERENT_PARADIGMS", "SHIN_SIN_CONFLICT_IN_SOURCES",
]
FORM_HARD = [
    "CELL_CONFLICT_VOCALIZED", "CELL_CONFLICT_UNVOCALIZED", "VOC_UNVOC_INCONSISTENT", "WIKT_FORM_MISMATCH", "FEATURE_VIOLATION", "TAG_UNPARSEABLE", "MALFORMED_ORPHAN_MARK",
    "NON_HEBREW_CHARACTER", "MISSING_VOCALIZATION", "CONTAINS_SPACE", "MALFORMED_MARK_ON_INVALID_BASE", "MALFORMED_REPEATED_MARK",
]
LEXEME_NO_GOLD = [
    "VOC_UNVOC_PAIRED_PARTIAL", "WIKT_CELL_CONFLICTS_IN_PARADIGM", "BINYAN_SHAPE_UNDETERMINED", "SINGLE_EVIDENCE_KIND_ROOT", "SINGLE_EVIDENCE_KIND_BINYAN", "EVIDENCE_TABLE_ROOT_FROM_TITLE",
    "SHIN_SIN_UNRESOLVED", "WIKTIONARY_ONLY_LEXEME", "UNVOC_SPELLING_VARIANTS_IN_PARADIGM",
]
FORM_NO_GOLD = ["MISSING_UNVOCALIZED", "UNVOC_SPELLING_VARIANTS", "NONSTANDARD_COMBINING_MARK", "VOC_VARIANTS"]
INFO = [
    "RAW_NOT_NFC", "DUPLICATE_SOURCE_PARADIGM_MERGED", "ROOT_HOMONYM_INDEX", "UNVOC_ORPHAN_LINE_ATTACHED", "VOC_UNVOC_PAIRED_TIE_IDENTICAL", "WIKT_CORROBORATED",
    "WIKT_ORTHOGRAPHIC_VARIANT", "MULTIPLE_WIKT_SECTIONS", "SHIN_SIN_FROM_FORM", "ROOT_SHARES_ORTHOGRAPHY_WITH_OTHER_ROOT", "TRADITIONAL_CLASS_NOT_STATED",
]
SEVERITY = dict.fromkeys(INFO, "INFO") | dict.fromkeys([*LEXEME_HARD, *FORM_HARD], "ERROR")


def lexeme_candidates(paradigms: DataFrame) -> DataFrame:
    """(paradigm_key, lexeme_id, lemma, n_members, several): paradigms of one lemma and signature are one lexeme."""
    v = ordered.variants(paradigms, ["lemma_nfc"], "signature", "first_line")
    key = F.concat(F.lit("unimorph|"), "lemma_nfc", F.when(F.col("variant_no") > 1, F.concat(F.lit("|"), F.col("variant_no").cast("string"))).otherwise(""))
    v = v.withColumns({"lexeme_id": roots.content_id("LX-", key), "several": F.max("variant_no").over(Window.partitionBy("lemma_nfc")) > 1}).drop("first_first_line")
    out = paradigms.join(v, ["lemma_nfc", "signature"])
    return out.select("paradigm_key", "lexeme_id", F.col("lemma_nfc").alias("lemma"), F.count(F.lit(1)).over(Window.partitionBy("lexeme_id")).alias("n_members"), "several", F.row_number().over(Window.partitionBy("lexeme_id").orderBy("first_line")).alias("nth"))


def _flag(df: DataFrame, record: str, kind: str, name: str | Column, where: Column | None = None, detail: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df.select(F.col(record).alias("record_id"), F.lit(kind).alias("record_type"), (F.lit(name) if isinstance(name, str) else name).alias("check_name"), (F.lit(None).cast("string") if detail is None else detail).alias("details"))


#: Where lines and pages are taken from if nothing else is said.
LINES = records.Source("unimorph", "https://example.org/lines", "unpinned", "1970-01-01", "pairing 1")
PAGES = records.Source("hewiktionary", "https://example.org/w/index.php", "unpinned", "1970-01-01", "wikitext 1", "dump.xml")


def build(pointed: DataFrame, plain: DataFrame, entries: DataFrame, tables: DataFrame, full: DataFrame, lines: records.Source = LINES, pages: records.Source = PAGES) -> dict[str, DataFrame]:
    """Lexemes, forms, roots, flags and typed conflicts, provenance, duplicates, missing metadata, evidence and pairing.

    pointed, plain: lines as of pairing.verb_lines; entries with a normalised class column binyan; tables and full
    as of the wikitext readers; lines and pages: the pinned sources they come from.
    """
    voc_p, unv_p = pairing.paradigms(pointed), pairing.paradigms(plain)
    # Results that several branches below read: written where a checkpoint folder is set, so that plans stay small.
    written = pointed.sparkSession.sparkContext.getCheckpointDir() is not None
    keep = lambda df: df.checkpoint() if written else df.persist()
    pointed, plain, unv_p = keep(pointed), keep(plain), keep(unv_p)
    cand = lexeme_candidates(voc_p)
    paired = keep(pairing.pair(pointed, plain, unv_p))
    members = cand.join(paired.withColumnRenamed("voc_key", "paradigm_key"), "paradigm_key", "left")
    unv_lemma = unv_p.select(F.col("paradigm_key").alias("unv_key"), F.col("lemma_nfc").alias("unv_lemma"))
    members = keep(members.join(unv_lemma, "unv_key", "left"))

    # Plain paradigms that no pointed one was paired with.
    free = plain.join(paired.select(F.col("unv_key").alias("paradigm_key")).where("paradigm_key is not null").distinct(), "paradigm_key", "left_anti")
    orphans = pairing.cells(free).join(unv_p.select("paradigm_key", F.col("lemma_nfc").alias("lemma")), "paradigm_key").select(F.col("paradigm_key").alias("orphan"), "lemma", "cell", text.skeleton(F.col("form"), drop_matres=True).alias("key"))
    own = members.where("nth = 1").select("paradigm_key", "lexeme_id", "unv_lemma").join(pairing.cells(pointed), "paradigm_key").select("lexeme_id", "unv_lemma", "cell", text.plene_key(F.col("form")).alias("key"))
    attached = keep(pairing.attach_orphans(orphans, own))

    voc = pointed.join(members.select("paradigm_key", "lexeme_id", "nth"), "paradigm_key").withColumn("ord", F.struct("nth", "line_no"))
    links = members.where("unv_key is not null").select("lexeme_id", F.col("unv_key").alias("paradigm_key"), "nth").unionByName(attached.where("lexeme_id is not null").select("lexeme_id", F.col("orphan").alias("paradigm_key"), F.lit(1 << 30).alias("nth")))
    unv = plain.join(links.groupBy("lexeme_id", "paradigm_key").agg(F.min("nth").alias("nth")), "paradigm_key").withColumn("ord", F.struct("nth", "line_no"))

    def side(rows: DataFrame, tag: str) -> DataFrame:
        first = rows.where("canonical_cell is not null").groupBy("lexeme_id", F.col("canonical_cell").alias("cell"), "form_nfc").agg(F.min("ord").alias("ord"), F.min_by(F.struct("tag", "char_flags", "form_raw", "file", "line_no"), "ord").alias("src"))
        distinct = F.sort_array(F.collect_list(F.struct("ord", "form_nfc", "src")))
        g = first.groupBy("lexeme_id", "cell").agg(distinct.alias("all"))
        names = F.transform("all", lambda s: s["form_nfc"])
        return g.select("lexeme_id", "cell", F.get(names, F.lit(0)).alias(f"form_{tag}"), F.nullif(F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), "|"), F.lit("")).alias(f"variants_{tag}"), F.size(names).alias(f"n_{tag}"), F.get("all", F.lit(0))["src"].alias(f"src_{tag}"))

    forms = side(voc, "vocalized").join(side(unv, "unvocalized"), ["lexeme_id", "cell"], "full_outer")
    forms = keep(forms.withColumn("form_id", F.concat_ws(".", "lexeme_id", "cell")))

    cells_of = lambda cell: F.max(F.when(F.col("cell") == cell, F.col("form_vocalized")))
    shape = forms.groupBy("lexeme_id").agg(cells_of("PST.3MSG").alias("past"), cells_of("NFIN").alias("infinitive"), cells_of("PRS.MSG").alias("present"), F.count(F.lit(1)).alias("n_cells"), F.count_distinct(F.when(F.col("cell").isin(*features.PAST_CELLS) & F.col("form_vocalized").isNotNull(), F.col("cell"))).alias("past_observed_cells"))
    lex = members.groupBy("lexeme_id").agg(
        F.min("lemma").alias("lemma"), F.max("n_members").alias("n_members"), F.bool_or("several").alias("several"), F.min_by("unv_lemma", "nth").alias("plain_lemma"), F.min_by("status", "nth").alias("first_status"),
        F.collect_set("status").alias("statuses"), F.min("score").alias("pairing_score"),
    ).join(shape, "lexeme_id", "left")
    lex = keep(lex)
    entries, tables, full = keep(entries), keep(tables), keep(full)
    ev = keep(evidence.gather(lex, entries, tables, full))
    dec = keep(evidence.decisions(ev))
    used, raw = keep(records.agreeing(ev, dec)), keep(records.raw_records(entries, tables, full))
    stated = keep(records.lexeme_attributes(used, raw))
    titled = used.where("by_root").join(tables.where(F.col("flags").contains("TABLE_ROOT_")).select(evidence.table_id().alias("record_id")).distinct(), "record_id", "left_semi")
    lex = lex.join(dec.withColumnRenamed("root", "root_bare"), "lexeme_id", "left").withColumn("match_status", F.coalesce("status", F.lit("NO_MATCH"))).drop("status")
    lex = lex.withColumns({"shape": features.class_from_shape(F.col("present"), F.col("infinitive"), F.col("past")), "shin": F.when(F.col("root_bare").isNotNull(), roots.resolve_shin(F.col("root_bare"), F.coalesce("root_dotted_variants", F.array().cast("array<string>")), F.col("lemma")))})
    gone = evidence.asserted_absent(tables).withColumn("absent", F.lit(True))
    lex = keep(lex.join(gone, ["root_bare", "binyan"], "left"))
    stable = roots.stable_radicals(text.characters(F.col("root_bare")))
    fits = roots.is_subsequence(stable, text.skeleton(text.strip_points(F.coalesce("past", "lemma"))))

    # Corroboration by tables of the same root and class.
    matched = lex.where("match_status = 'MATCHED' and root_bare is not null and binyan is not null")
    wcells = evidence.corroborating_cells(matched, tables, full)
    forms = evidence.corroborate(forms.withColumnRenamed("form_vocalized", "form"), wcells).withColumnRenamed("form", "form_vocalized")
    consistent = text.plene_consistent(F.col("form_vocalized"), F.col("form_unvocalized"))
    prim = F.coalesce("src_vocalized", "src_unvocalized")
    forms = forms.withColumns({"plene_consistent": consistent, "tag": prim["tag"], "char_flags": F.array_union(prim["char_flags"], F.array_remove(F.coalesce("src_unvocalized.char_flags", F.array().cast("array<string>")), "RAW_NOT_NFC"))})

    f = lambda name, where, detail=None: _flag(forms, "form_id", "form", name, where, detail)
    forms = keep(forms)
    each = forms.select("form_id", F.explode("char_flags").alias("flag"))
    form_flags = [
        f("CELL_CONFLICT_VOCALIZED", F.col("n_vocalized") > 1, F.col("variants_vocalized")), f("UNVOC_SPELLING_VARIANTS", F.col("n_unvocalized") > 1, F.col("variants_unvocalized")),
        f("MISSING_VOCALIZATION", F.col("form_vocalized").isNull()), f("MISSING_UNVOCALIZED", F.col("form_unvocalized").isNull()), f("VOC_UNVOC_INCONSISTENT", ~F.col("plene_consistent")),
        f("FEATURE_VIOLATION", F.size(features.violations(F.col("tag"))) > 0, F.array_join(features.violations(F.col("tag")), ",")), f(F.col("corroboration_flag"), F.col("corroboration_flag").isNotNull()),
        _flag(each, "form_id", "form", F.col("flag")),
    ]
    per = forms.groupBy("lexeme_id").agg(F.bool_or(F.col("corroboration_flag") == "WIKT_FORM_MISMATCH").alias("mismatch"), F.bool_or(F.col("n_unvocalized") > 1).alias("spellings"))
    lx = keep(lex.join(per, "lexeme_id", "left"))
    g = lambda name, where, detail=None: _flag(lx, "lexeme_id", "lexeme", name, where, detail)
    status, has = F.col("match_status"), lambda s: F.array_contains("statuses", s)
    no_root, no_class = F.col("root_bare").isNull(), F.col("binyan").isNull()
    none, settled = status == "NO_MATCH", status.isin("MATCHED", "MATCHED_UNVOC_ONLY")
    lexeme_flags = [
        g("DUPLICATE_SOURCE_PARADIGM_MERGED", F.col("n_members") > 1), g("SAME_LEMMA_DIFFERENT_PARADIGMS", F.col("several")),
        g("VOC_UNVOC_UNPAIRED", has("UNPAIRED")), g("VOC_UNVOC_PAIRING_AMBIGUOUS", has("AMBIGUOUS") & ~has("UNPAIRED")), g("VOC_UNVOC_PAIRED_PARTIAL", has("PAIRED_PARTIAL") & ~has("UNPAIRED") & ~has("AMBIGUOUS")),
        g("VOC_UNVOC_PAIRED_TIE_IDENTICAL", has("PAIRED_TIE_IDENTICAL") & ~has("UNPAIRED") & ~has("AMBIGUOUS") & ~has("PAIRED_PARTIAL")),
        g("LEMMA_CITATION_MISMATCH", F.col("past") != F.col("lemma"), F.col("past")), g("ROOT_MISSING", none | (settled & no_root)), g("BINYAN_MISSING", none | (settled & no_class)),
        g("ROOT_AMBIGUOUS", status.isin("ROOT_AMBIGUOUS", "ROOT_AND_BINYAN_AMBIGUOUS")), g("BINYAN_AMBIGUOUS", status.isin("BINYAN_AMBIGUOUS", "ROOT_AND_BINYAN_AMBIGUOUS")), g("MATCH_UNVOC_ONLY", status == "MATCHED_UNVOC_ONLY"),
        g("SINGLE_EVIDENCE_KIND_ROOT", ~no_root & (F.size("root_kinds") < 2)), g("SINGLE_EVIDENCE_KIND_BINYAN", ~no_class & (F.size("binyan_kinds") < 2)),
        g("BINYAN_SHAPE_UNDETERMINED", ~no_class & F.col("shape.binyan").isNull(), F.col("shape.rule")), g("BINYAN_SHAPE_DISAGREES", ~no_class & (F.col("shape.binyan") != F.col("binyan")), F.concat_ws(":", "shape.binyan", "shape.rule")),
        g("ROOT_FORM_MISMATCH", ~no_root & ~F.coalesce(fits, F.lit(False))), _flag(lx.where(~no_root).select("lexeme_id", F.explode("shin.flags").alias("flag")), "lexeme_id", "lexeme", F.col("flag")),
        g("WIKT_TABLE_ASSERTS_ROOT_BINYAN_ABSENT", F.col("absent")), g("WIKT_CELL_CONFLICTS_IN_PARADIGM", F.col("mismatch")), g("UNVOC_SPELLING_VARIANTS_IN_PARADIGM", F.col("spellings")),
        _flag(lx.where(~no_root & ~no_class).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("root_bare", "binyan"))), "lexeme_id", "lexeme", "DUPLICATE_ROOT_BINYAN", F.col("k") > 1),
        _flag(titled.select("lexeme_id").distinct(), "lexeme_id", "lexeme", "EVIDENCE_TABLE_ROOT_FROM_TITLE"), _flag(stated.where("several_sections"), "lexeme_id", "lexeme", "MULTIPLE_WIKT_SECTIONS"),
        _flag(attached.where("lexeme_id is not null").select("lexeme_id").distinct(), "lexeme_id", "lexeme", "UNVOC_ORPHAN_LINE_ATTACHED"),
    ]
    flags = reduce(DataFrame.unionByName, [*form_flags, *lexeme_flags]).dropDuplicates(["record_id", "check_name"])
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    flags = keep(flags.withColumn("severity", F.coalesce(severity[F.col("check_name")], F.lit("WARNING"))))
    sets = flags.groupBy("record_id").agg(F.sort_array(F.collect_set("check_name")).alias("quality_flags"))

    # Tiers and confidences.
    lex = lex.join(sets.withColumnRenamed("record_id", "lexeme_id"), "lexeme_id", "left")
    hit = lambda name: F.coalesce(F.array_contains("quality_flags", name), F.lit(False))
    half = lambda c, when: F.coalesce(F.col(c), F.lit(0.0)) * F.when(when, 0.5).otherwise(1.0)
    whole = F.col("first_status").isin("PAIRED", "PAIRED_TIE_IDENTICAL") & ~has("PAIRED_PARTIAL")
    doubtful = (status != "MATCHED") | ~F.coalesce(whole, F.lit(False)) | ~F.col("binyan").eqNullSafe(F.col("shape.binyan"))
    lex = lex.withColumns({
        "confidence_root": half("conf_root", hit("ROOT_FORM_MISMATCH")), "confidence_binyan": half("conf_binyan", hit("BINYAN_SHAPE_DISAGREES")),
        "quality_tier": quality.tier_of(F.col("quality_flags"), LEXEME_HARD, LEXEME_NO_GOLD, no_root | no_class, doubtful),
    })
    lex = lex.withColumn("confidence_lexeme", F.round(F.least("confidence_root", "confidence_binyan") * F.when(whole, 1.0).otherwise(0.8), 4))
    root_norm = F.array_join("shin.radicals", "")
    keys = members.select("lexeme_id", F.explode(F.array_compact(F.array("paradigm_key", "unv_key"))).alias("k")).unionByName(attached.where("lexeme_id is not null").select("lexeme_id", F.col("orphan").alias("k")))
    keys = keys.groupBy("lexeme_id").agg(F.array_join(F.sort_array(F.collect_set("k")), "|").alias("keys"))
    plain_cells = forms.groupBy("lexeme_id").agg(*[F.max(F.when(F.col("cell") == c, F.col("form_unvocalized"))).alias(n) for c, n in (("PST.3MSG", "citation_past_3ms_unvocalized"), ("NFIN", "infinitive_unvocalized"))])
    lex = lex.join(stated, "lexeme_id", "left").join(keys, "lexeme_id", "left").join(plain_cells, "lexeme_id", "left").join(evidence.evidence_json(ev), "lexeme_id", "left")
    lexemes = lex.select(
        "lexeme_id", F.when(~no_root, roots.root_id(root_norm)).alias("root_id"), root_norm.alias("root_normalized"), "root_bare", "binyan", F.col("lemma").alias("lemma_vocalized"), F.col("plain_lemma").alias("lemma_unvocalized"),
        F.col("past").alias("citation_past_3ms_vocalized"), F.col("infinitive").alias("infinitive_vocalized"), "match_status", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), F.array_join("methods", "|").alias("match_method"),
        F.col("shape.binyan").alias("binyan_shape_heuristic"), F.col("shape.rule").alias("binyan_shape_rule"), F.col("first_status").alias("voc_unvoc_pairing_status"), "pairing_score", "n_cells", "past_observed_cells",
        F.round(F.col("past_observed_cells") / 9, 4).alias("past_completeness"), "confidence_root", "confidence_binyan", "confidence_lexeme", "quality_tier", "quality_flags", F.lit(lines.name).alias("source_primary"),
        F.lit("heb").alias("language"), F.get("root_dotted_variants", F.lit(0)).alias("root_radicals_dotted"), F.col("shin.method").alias("shin_sin_resolution"), "root_homonym_index", "binyan_raw", "infinitive_unvocalized",
        "citation_past_3ms_unvocalized", "gloss_en", "sense_id", "gizra_labels", "wiktionary_registers", F.lit(True).alias("modern_hebrew"), F.lit(True).alias("attested"), F.lit(True).alias("has_unimorph_paradigm"),
        F.concat_ws("|", "keys", "record_ids").alias("source_ids"), "match_evidence", status.endswith("AMBIGUOUS").alias("match_ambiguous"), F.lit(9).cast("long").alias("past_expected_cells"), (F.col("past_observed_cells") == 9).alias("past_complete"),
    )
    alone = records.source_only(entries, tables, full, ev, lexemes, pages.name)
    only = keep(alone["lexemes"])
    flags = flags.unionByName(only.select(F.col("lexeme_id").alias("record_id"), F.lit("lexeme").alias("record_type"), F.explode("flags").alias("check_name"), F.lit(None).cast("string").alias("details")).withColumn("severity", F.coalesce(severity[F.col("check_name")], F.lit("WARNING"))))
    lexemes = keep(lexemes.unionByName(_only_lexemes(only, pages.name), allowMissingColumns=True))
    parent = lexemes.select("lexeme_id", "root_id", "binyan", F.col("quality_tier").alias("_tier"), "confidence_lexeme")
    forms = forms.join(sets.withColumnRenamed("record_id", "form_id"), "form_id", "left").join(parent, "lexeme_id", "left")
    own_tier = quality.tier_of(F.col("quality_flags"), FORM_HARD, FORM_NO_GOLD, None, ~F.coalesce("plene_consistent", F.lit(False)) | ~F.coalesce("corroborated", F.lit(True)))
    hard = F.coalesce(F.arrays_overlap("quality_flags", F.array(*map(F.lit, FORM_HARD))), F.lit(False))
    forms = forms.select(
        "form_id", "lexeme_id", "root_id", "binyan", F.col("cell").alias("canonical_cell"), "form_vocalized", "form_unvocalized", F.col("variants_vocalized").alias("form_vocalized_variants"), F.col("variants_unvocalized").alias("form_unvocalized_variants"),
        text.strip_points(F.col("form_vocalized")).alias("form_stripped"), *[F.col(f"tag.{k}").alias(k) for k in ("pos", "tense", "mood", "person", "number", "gender", "finiteness")], "plene_consistent", F.col("corroborated").alias("wiktionary_corroborated"),
        F.concat_ws("|", F.concat_ws(":", "src_vocalized.file", "src_vocalized.line_no"), F.concat_ws(":", "src_unvocalized.file", "src_unvocalized.line_no")).alias("source_ids"),
        quality.worst_tier(F.col("_tier"), own_tier).alias("quality_tier"), (F.col("confidence_lexeme") * F.when(hard, 0.5).otherwise(1.0)).alias("confidence"), "quality_flags", F.lit(lines.name).alias("source_primary"),
    )
    only_forms, only_flags = _only_forms(only, keep(alone["forms"]), pages.name)
    flags = keep(flags.unionByName(only_flags.withColumn("severity", F.coalesce(severity[F.col("check_name")], F.lit("WARNING")))))
    forms = keep(forms.unionByName(only_forms, allowMissingColumns=True))
    root_table = lexemes.where("root_id is not null").groupBy("root_id", "root_normalized").agg(
        F.count(F.lit(1)).alias("n_lexemes"), F.array_join(F.sort_array(F.collect_set("binyan")), "|").alias("binyanim"), F.max("confidence_root").alias("confidence"), quality.tier_name(F.min(quality.tier_rank(F.col("quality_tier")))).alias("quality_tier")
    )
    units = roots.split_units(F.col("root_normalized"))
    root_table = root_table.select("*", roots.orthographic(F.col("root_normalized")).alias("root_orthographic"), *[c.alias(k) for k, c in roots.features(units).items()])
    root_table = root_table.withColumns({"orthographic_root_group_id": roots.root_id(F.col("root_orthographic"), "RG-"), "shares_orthography": F.count(F.lit(1)).over(Window.partitionBy("root_orthographic")) > 1})
    every = used.select("lexeme_id", "record_id", "root", "by_root", "by_class").unionByName(alone["evidence"].select("lexeme_id", "record_id", "root", F.lit(True).alias("by_root"), F.lit(False).alias("by_class")))
    root_table = root_table.join(records.root_attributes(lexemes, every, raw), "root_id", "left")
    shared = F.when(F.col("shares_orthography"), F.array(F.lit("ROOT_SHARES_ORTHOGRAPHY_WITH_OTHER_ROOT"))).otherwise(F.array().cast("array<string>"))
    root_table = keep(root_table.withColumn("quality_flags", F.array_sort(F.array_union(shared, F.coalesce("root_flags", F.array().cast("array<string>"))))).drop("root_flags"))
    flags = flags.unionByName(root_table.select(F.col("root_id").alias("record_id"), F.lit("root").alias("record_type"), F.explode("quality_flags").alias("check_name"), F.lit(None).cast("string").alias("details")).withColumn("severity", F.coalesce(severity[F.col("check_name")], F.lit("WARNING"))))

    forms = canonical.syncretism(forms)
    lost = attached.where("lexeme_id is null").select(
        F.lit("ORPHAN_UNVOCALIZED_PARADIGM").alias("conflict_type"), F.lit("source").alias("record_type"), F.col("orphan").alias("record_id"), F.lit(None).cast("string").alias("lemma"), F.concat(F.col("n_hits").cast("string"), F.lit(" lexemes fit")).alias("details"),
        F.lit(None).cast("string").alias("candidates"), F.col("orphan").alias("sources"),
    )
    conflicts = records.conflicts(flags, lexemes, forms, used).unionByName(lost)
    duplicates = records.duplicates(lexemes, forms, members).unionByName(alone["duplicates"])

    # Provenance: lines of forms and paradigms, records that agree with a root or class or a form, entries of source-only lexemes.
    line = lambda df, tag, field: records.from_lines(df.where("canonical_cell is not null").select(F.concat_ws(".", "lexeme_id", "canonical_cell").alias("record_id"), "file", "line_no", F.concat_ws("\t", "lemma_raw", "form_raw", "tag_raw").alias("raw")), lines, "form", field)
    paradigm = lambda df, p, key, field: records.from_lines(df.join(p.select(F.col("paradigm_key").alias(key), "file", F.col("first_line").alias("line_no"), F.concat(F.lit("paradigm of "), F.col("n_lines").cast("string"), F.lit(" lines, lemma "), "lemma_nfc").alias("raw")), key).withColumnRenamed("lexeme_id", "record_id"), lines, "lexeme", field)
    page = entries.select(evidence.entry_id().alias("source_record"), "page_title", "rev_id").unionByName(tables.select(evidence.table_id().alias("source_record"), "page_title", "rev_id")).unionByName(full.select(evidence.full_id().alias("source_record"), "page_title", "rev_id")).dropDuplicates(["source_record"])
    told = raw.select(F.col("record_id").alias("source_record"), "raw")
    agreed = every.where("by_root or by_class").groupBy("lexeme_id", F.col("record_id").alias("source_record")).agg(F.concat_ws("+", F.when(F.bool_or("by_root"), F.lit("root")), F.when(F.bool_or("by_class"), F.lit("binyan"))).alias("field"))
    agreed = agreed.unionByName(only.select("lexeme_id", F.explode(F.split("entry_ids", r"\|")).alias("source_record"), F.lit("root+binyan+lemma").alias("field")))
    of_lexemes = agreed.withColumnRenamed("lexeme_id", "record_id")
    of_roots = agreed.where("field like 'root%'").join(lexemes.where("root_id is not null").select("lexeme_id", "root_id"), "lexeme_id").select(F.col("root_id").alias("record_id"), "source_record", F.lit("root").alias("field")).distinct()
    seen = forms.where("wiktionary_corroborated is not null").select("form_id", "lexeme_id", F.col("canonical_cell").alias("cell")).join(wcells.select("lexeme_id", "cell", F.col("record_id").alias("source_record")).distinct(), ["lexeme_id", "cell"])
    of_forms = seen.select(F.col("form_id").alias("record_id"), "source_record", F.lit("form_vocalized_corroboration").alias("field"))
    of_forms = of_forms.unionByName(alone["forms"].select(F.concat_ws(".", "lexeme_id", "cell").alias("record_id"), F.explode(F.split("records", r"\|")).alias("source_record"), F.lit("form_vocalized").alias("field")))
    parts = [line(voc, "v", "form_vocalized"), line(unv, "u", "form_unvocalized"), paradigm(members.select("lexeme_id", "paradigm_key"), voc_p, "paradigm_key", "paradigm_vocalized"), paradigm(links.select("lexeme_id", F.col("paradigm_key").alias("unv_key")).distinct(), unv_p, "unv_key", "paradigm_unvocalized")]
    parts += [records.from_pages(df.join(page, "source_record").join(told, "source_record"), pages, kind) for df, kind in ((of_lexemes, "lexeme"), (of_roots, "root"), (of_forms, "form"))]
    provenance = records.numbered(reduce(DataFrame.unionByName, parts), "PV", "provenance_id")
    validation = records.numbered(flags.select("record_id", "record_type", "check_name", "severity", "details"), "CK", "check_id")
    missing = alone["missing"].select("record_type", "record_id", "missing_fields").unionByName(records.missing_metadata(lexemes, forms))
    return {"lexemes": lexemes, "forms": forms, "roots": root_table, "flags": flags, "conflicts": conflicts, "evidence": ev, "pairing": paired, "provenance": provenance, "validation": validation, "duplicates": duplicates, "missing": missing}


def _only_lexemes(only: DataFrame, source: str) -> DataFrame:
    """Lexemes that one source alone has, with the columns of the others."""
    half = lambda c, name: F.coalesce(F.col(c), F.lit(0.0)) * F.when(F.array_contains("flags", name), 0.5).otherwise(1.0)
    root, klass = half("conf_root", "ROOT_FORM_MISMATCH"), half("conf_binyan", "BINYAN_SHAPE_DISAGREES")
    out = only.select(
        "lexeme_id", roots.root_id(F.col("root_normalized")).alias("root_id"), "root_normalized", "root_bare", "binyan", F.col("headword").alias("lemma_vocalized"), F.col("plain").alias("lemma_unvocalized"), F.col("headword").alias("citation_past_3ms_vocalized"),
        F.col("infinitive").alias("infinitive_vocalized"), F.lit("WIKTIONARY_ONLY").alias("match_status"), F.coalesce("match_score", F.lit(0.0)).alias("match_score"), F.array_join("methods", "|").alias("match_method"), F.col("shape.binyan").alias("binyan_shape_heuristic"),
        F.col("shape.rule").alias("binyan_shape_rule"), "n_cells", "past_observed_cells", F.round(F.col("past_observed_cells") / 9, 4).alias("past_completeness"), root.alias("confidence_root"), klass.alias("confidence_binyan"),
        F.round(F.least(root, klass) * 0.8, 4).alias("confidence_lexeme"), quality.tier_of(F.col("flags"), LEXEME_HARD, LEXEME_NO_GOLD).alias("quality_tier"), F.col("flags").alias("quality_flags"), F.lit(source).alias("source_primary"), F.lit("heb").alias("language"),
        F.get("variants", F.lit(0)).alias("root_radicals_dotted"), F.col("shin.method").alias("shin_sin_resolution"), "root_homonym_index", "binyan_raw", F.col("plain").alias("citation_past_3ms_unvocalized"), "gloss_en", "gizra_labels", "wiktionary_registers",
        F.when(F.col("wiktionary_registers").contains("עברית חדשה"), True).alias("modern_hebrew"), F.lit(True).alias("attested"), F.lit(False).alias("has_unimorph_paradigm"), F.col("entry_ids").alias("source_ids"),
        F.coalesce(F.col("d_status").endswith("AMBIGUOUS"), F.lit(False)).alias("match_ambiguous"), F.lit(9).cast("long").alias("past_expected_cells"), (F.col("past_observed_cells") == 9).alias("past_complete"),
    )
    return out


def _only_forms(only: DataFrame, cells: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Forms of these lexemes with the columns of the others, and their flags."""
    tier = quality.tier_of(F.col("flags"), LEXEME_HARD, LEXEME_NO_GOLD)
    parent = only.select("lexeme_id", roots.root_id(F.col("root_normalized")).alias("root_id"), "binyan", "plain", tier.alias("_tier"), F.round(F.least(F.coalesce("conf_root", F.lit(0.0)), F.coalesce("conf_binyan", F.lit(0.0))) * 0.8, 4).alias("_confidence"))
    rows = cells.join(parent, "lexeme_id").withColumns({"form": F.get("forms", F.lit(0)), "plain": F.when(F.col("cell") == features.CITATION_CELL, F.col("plain")), "tag": features.parse_tag(features.tag_of_cell(F.col("cell")))})
    rows = rows.withColumns({"form_id": F.concat_ws(".", "lexeme_id", "cell"), "consistent": text.plene_consistent(F.col("form"), F.col("plain"))})
    names = F.array(F.when(F.size("forms") > 1, "VOC_VARIANTS"), F.when(F.col("plain").isNull(), "MISSING_UNVOCALIZED"), F.when(~F.col("consistent"), "VOC_UNVOC_INCONSISTENT"))
    rows = rows.withColumn("quality_flags", F.array_sort(F.array_union(F.array_compact(names), text.audit(F.col("form"))["flags"])))
    own = quality.tier_of(F.col("quality_flags"), FORM_HARD, FORM_NO_GOLD, None, ~F.coalesce("consistent", F.lit(False)))
    hard = F.arrays_overlap("quality_flags", F.array(*map(F.lit, FORM_HARD)))
    out = rows.select(
        "form_id", "lexeme_id", "root_id", "binyan", F.col("cell").alias("canonical_cell"), F.col("form").alias("form_vocalized"), F.col("plain").alias("form_unvocalized"), F.nullif(F.array_join(F.slice("forms", 2, 1000), "|"), F.lit("")).alias("form_vocalized_variants"),
        text.strip_points(F.col("form")).alias("form_stripped"), *[F.col(f"tag.{k}").alias(k) for k in ("pos", "tense", "mood", "person", "number", "gender", "finiteness")], F.col("consistent").alias("plene_consistent"), F.col("records").alias("source_ids"),
        quality.worst_tier(F.col("_tier"), own).alias("quality_tier"), (F.col("_confidence") * F.when(hard, 0.5).otherwise(1.0)).alias("confidence"), "quality_flags", F.lit(source).alias("source_primary"),
    )
    return out, rows.select(F.col("form_id").alias("record_id"), F.lit("form").alias("record_type"), F.explode("quality_flags").alias("check_name"), F.lit(None).cast("string").alias("details"))
