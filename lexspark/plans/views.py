"""Pair views of canonical tables: one row per (condition, source cell, target cell), in a single plan.

Identity and model-visible columns come first; every other column is named analysis__*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features
from lexspark.operators import joins, ordered, quality

IDENTITY = ["example_id", "pair_id", "condition", "lexeme_id", "source_cell", "target_cell"]
VISIBLE = ["source_form", "target_features", "target_form"]
A = "analysis__"
ROOT_COLUMNS = ["root_id", "root_normalized", "root_orthographic", "orthographic_root_group_id", "root_length", "structural_class", "structural_signature", "traditional_class", "has_weak_radical", "is_geminate"]


def conditions(forms: DataFrame) -> DataFrame:
    """Past forms unpivoted to (condition, form), without missing ones."""
    keep = ["lexeme_id", "canonical_cell", "form_id", "quality_tier", "source_ids", "is_syncretic", "syncretism_group", "is_syncretic_unvocalized", "syncretism_group_unvocalized"]
    both = F.array(F.struct(F.lit("voc").alias("condition"), F.col("form_vocalized").alias("form")), F.struct(F.lit("unv").alias("condition"), F.col("form_unvocalized").alias("form")))
    past = forms.where(F.col("canonical_cell").isin(*features.PAST_CELLS)).select(*keep, F.explode(both).alias("x")).select(*keep, "x.condition", "x.form").where("form is not null")
    voc = F.col("condition") == "voc"
    past = past.withColumn("syncretic", F.when(voc, F.col("is_syncretic")).otherwise(F.col("is_syncretic_unvocalized"))).withColumn("group", F.when(voc, F.col("syncretism_group")).otherwise(F.col("syncretism_group_unvocalized")))
    return past.drop("is_syncretic", "syncretism_group", "is_syncretic_unvocalized", "syncretism_group_unvocalized")


def build_pairs(roots: DataFrame, lexemes: DataFrame, forms: DataFrame, name: str, mode: str = "citation") -> DataFrame:
    """mode citation: from the citation cell to each other; mode all: every ordered pair of different cells."""
    past = conditions(forms)
    rank = F.array_position(F.array(*map(F.lit, features.PAST_CELLS)), F.col("canonical_cell"))
    same = past.groupBy("condition", "lexeme_id", "form").agg(ordered.ordered_join(F.col("canonical_cell"), rank).alias("same_cells"))
    past = past.join(same, ["condition", "lexeme_id", "form"])
    only = F.col("canonical_cell") == features.CITATION_CELL if mode == "citation" else None
    pairs = joins.ordered_pairs(past, ["lexeme_id", "condition"], "canonical_cell", ["form", "form_id", "quality_tier", "source_ids", "syncretic", "group", "same_cells"], only)
    extra = [c for c in roots.columns if c.startswith("sc_")]
    lex = lexemes.select("lexeme_id", "root_id", "binyan", "lemma_vocalized", F.col("quality_tier").alias("lexeme_tier"), F.col("source_primary").alias("lexeme_source"))
    m = pairs.join(lex, "lexeme_id", "left").join(roots.select(*ROOT_COLUMNS, *extra), "root_id", "left")
    worst = quality.worst_tier(F.col("lexeme_tier"), F.col("s_quality_tier"), F.col("t_quality_tier"))
    both = F.col("root_id").isNotNull() & F.col("binyan").isNotNull()
    pair = F.concat("lexeme_id", F.lit(":"), "s_canonical_cell", F.lit(">"), "t_canonical_cell")
    analysis = {
        "root_id": F.col("root_id"), "root": F.col("root_normalized"), **{c: F.col(c) for c in ["root_orthographic", "orthographic_root_group_id", "root_length", "binyan"]},
        "root_binyan_key": F.when(both, F.concat("root_id", F.lit("|"), "binyan")), **{c: F.col(c) for c in ["structural_class", "structural_signature", "traditional_class", *extra, "lemma_vocalized"]},
        "lexeme_quality_tier": F.col("lexeme_tier"), "source_form_quality_tier": F.col("s_quality_tier"), "target_form_quality_tier": F.col("t_quality_tier"),
        "example_quality_tier": worst, "eligible_default": F.coalesce(worst != "QUESTIONABLE", F.lit(False)) & both,
        "source_form_id": F.col("s_form_id"), "target_form_id": F.col("t_form_id"),
        "source_ids": F.concat(F.coalesce("s_source_ids", F.lit("")), F.lit("|"), F.coalesce("t_source_ids", F.lit(""))), "lexeme_source_primary": F.col("lexeme_source"),
        "target_is_syncretic": F.col("t_syncretic"), "target_syncretism_group": F.col("t_group"), "target_same_form_past_cells": F.col("t_same_cells"),
        "source_equals_target": F.col("s_form") == F.col("t_form"), "target_form_length": F.length("t_form").cast("long"),
    }
    return m.select(
        F.concat(F.lit(f"{name}:"), "condition", F.lit(":"), pair).alias("example_id"), pair.alias("pair_id"), "condition", "lexeme_id", F.col("s_canonical_cell").alias("source_cell"), F.col("t_canonical_cell").alias("target_cell"),
        F.col("s_form").alias("source_form"), features.feature_string(F.col("t_canonical_cell")).alias("target_features"), F.col("t_form").alias("target_form"),
        *[c.alias(A + k) for k, c in analysis.items()],
    )


def past_reinflection(roots, lexemes, forms) -> DataFrame:
    return build_pairs(roots, lexemes, forms, "PR", "citation")


def full_paradigm(roots, lexemes, forms) -> DataFrame:
    return build_pairs(roots, lexemes, forms, "FP", "all")


def traditional_flags(view: DataFrame, labels: list[str]) -> DataFrame:
    """A boolean analysis column for each traditional label; rows without a label are false."""
    parts = F.split(A + "traditional_class", r"\+")
    return view.withColumns({f"{A}trad_{x}": F.coalesce(F.array_contains(parts, x), F.lit(False)) for x in labels})


def load(view: DataFrame, assignment: DataFrame, partition: str, condition: str) -> DataFrame:
    """The visible columns, and nothing else, of a partition's rows."""
    ids = assignment.where(F.col("partition") == partition)
    return view.where(F.col("condition") == condition).join(ids, "pair_id", "left_semi").select(*VISIBLE)


def load_analysis(view: DataFrame, assignment: DataFrame, partition: str, condition: str) -> DataFrame:
    """The same rows with all columns; sort both by pair_id to align them."""
    ids = assignment.where(F.col("partition") == partition)
    return view.where(F.col("condition") == condition).join(ids, "pair_id", "left_semi")
