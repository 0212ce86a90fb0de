"""From triples to paradigms, and pointed paradigms paired with plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import features, text
from lexspark.operators import joins, ordered

LEAST_SCORE, LEAST_MARGIN = 0.75, 0.15


def verb_lines(triples: DataFrame) -> DataFrame:
    """Triples with NFC strings, parsed tags, character flags and their paradigm.

    A paradigm is a maximal run of verb lines with one raw lemma; other lines break it, so they are numbered
    before they go. Its key is file:first line.
    """
    t = triples.withColumns({"lemma_nfc": text.nfc(F.col("lemma_raw")), "form_nfc": text.nfc(F.col("form_raw")), "verb": features.is_verb_tag(F.col("tag_raw"))})
    t = ordered.runs(t, ["file"], ["line_no"], F.col("lemma_raw"), F.col("verb")).where("run is not null")
    t = t.withColumn("paradigm_key", F.concat_ws(":", "file", F.min("line_no").over(Window.partitionBy("file", "run"))))
    t = t.withColumns({"tag": features.parse_tag(F.col("tag_raw")), "audit": text.audit(F.col("form_raw"))})
    cell = Window.partitionBy("paradigm_key", "tag.canonical_cell").orderBy("line_no")
    return t.select(
        "file", "line_no", "paradigm_key", "lemma_raw", "lemma_nfc", "form_raw", "form_nfc", "tag_raw", F.col("tag.canonical_cell").alias("canonical_cell"), F.col("tag.tag_error").alias("tag_error"), "tag",
        F.col("audit.flags").alias("char_flags"), F.row_number().over(cell).alias("nth_in_cell"),
    )


def paradigms(lines: DataFrame) -> DataFrame:
    """One row per paradigm: lemma, sizes, errors and the signature of its cells."""
    first = (F.col("nth_in_cell") == 1) & F.col("canonical_cell").isNotNull()
    return lines.groupBy("paradigm_key", "file").agg(
        F.min_by("lemma_nfc", "line_no").alias("lemma_nfc"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.count_if(first).alias("n_cells"),
        F.count_if((F.col("nth_in_cell") > 1) & F.col("canonical_cell").isNotNull()).alias("n_duplicate_cells"), F.count("tag_error").alias("n_tag_errors"),
        F.to_json(F.array_sort(F.collect_list(F.when(first, F.struct("canonical_cell", "form_nfc"))))).alias("signature"),
    )


def cells(lines: DataFrame) -> DataFrame:
    return lines.where("nth_in_cell = 1 and canonical_cell is not null").select("paradigm_key", F.col("canonical_cell").alias("cell"), F.col("form_nfc").alias("form"))


def pair(pointed: DataFrame, plain: DataFrame, plain_paradigms: DataFrame) -> DataFrame:
    """(voc_key, unv_key, score, runner_up_score, status, tied, edit_distance) for each pointed paradigm.

    Candidates share keys cell by cell (a blocking join); the ten with most votes are scored by
    votes over the larger size. Ties are settled by the edit distance of predicted spellings,
    computed for tied candidates only. An UNPAIRED or AMBIGUOUS paradigm has no partner.
    """
    v = cells(pointed).select(F.col("paradigm_key").alias("voc_key"), "cell", F.col("form").alias("voc_form"), text.plene_key(F.col("form")).alias("key"))
    u = cells(plain).select(F.col("paradigm_key").alias("unv_key"), "cell", F.col("form").alias("unv_form"), text.skeleton(F.col("form"), drop_matres=True).alias("key"))
    votes = joins.votes(v, u, "voc_key", "unv_key", ["cell", "key"])
    number = F.row_number().over(Window.partitionBy("voc_key").orderBy(F.desc("votes"), "line", "unv_key"))
    line = plain_paradigms.select(F.col("paradigm_key").alias("unv_key"), F.col("first_line").alias("line"), "signature")
    sizes_v, sizes_u = v.groupBy("voc_key").agg(F.count(F.lit(1)).alias("nv")), u.groupBy("unv_key").agg(F.count(F.lit(1)).alias("nu"))
    ten = votes.join(line, "unv_key").withColumn("n", number).where("n <= 10").join(sizes_v, "voc_key").join(sizes_u, "unv_key")
    scored = ordered.top_scores(ten.withColumn("score", F.col("votes") / F.greatest("nv", "nu")), ["voc_key"], "score", ["line"])
    top = scored.where((F.abs(F.col("score") - F.col("top_score")) < 1e-9) & (F.col("top_score") >= LEAST_SCORE))
    both = top.select("voc_key", "unv_key").join(v, "voc_key").join(u.drop("key"), ["unv_key", "cell"])
    distance = both.groupBy("voc_key", "unv_key").agg(F.sum(F.levenshtein(text.predict_plene(F.col("voc_form")), F.col("unv_form"))).cast("long").alias("d"))
    best = top.join(distance, ["voc_key", "unv_key"], "left").withColumn("dmin", F.min("d").over(Window.partitionBy("voc_key")))
    near = F.col("d") == F.col("dmin")
    g = best.groupBy("voc_key").agg(
        F.max("top_score").alias("score"), F.max("second_score").alias("second"), F.count(F.lit(1)).alias("n_tied"), F.sort_array(F.collect_list("unv_key")).alias("tied"), F.min("dmin").alias("edit_distance"),
        F.count_if(near).alias("n_best"), (F.min(F.when(near, F.col("signature"))) == F.max(F.when(near, F.col("signature")))).alias("same"), F.min(F.when(near, F.struct("line", "unv_key"))).alias("pick"),
    )
    one = F.col("n_best") == 1
    status = (
        F.when(one & (F.col("score") == 1), "PAIRED")
        .when(one & (F.col("score") - F.col("second") < LEAST_MARGIN), "AMBIGUOUS")
        .when(one, "PAIRED_PARTIAL")
        .when(F.col("same"), "PAIRED_TIE_IDENTICAL")
        .otherwise("AMBIGUOUS")
    )
    settled = g.withColumn("status", status).select(
        "voc_key", F.when(F.col("status") != "AMBIGUOUS", F.col("pick.unv_key")).alias("unv_key"), "score", F.when(F.col("n_tied") == 1, F.col("second")).otherwise(F.col("score")).alias("runner_up_score"), "status", "tied", "edit_distance"
    )
    low = scored.groupBy("voc_key").agg(F.max("top_score").alias("low"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("low_second"))
    every = v.select("voc_key").distinct().join(settled, "voc_key", "left").join(low, "voc_key", "left")
    zero = F.lit(0.0)
    return every.select("voc_key", "unv_key", F.coalesce("score", "low", zero).alias("score"), F.coalesce("runner_up_score", "low_second", zero).alias("runner_up_score"), F.coalesce("status", F.lit("UNPAIRED")).alias("status"), "tied", "edit_distance")


def attach_orphans(orphans: DataFrame, candidates: DataFrame) -> DataFrame:
    """(orphan, lexeme_id, n_hits): plain paradigms attached to the lexeme all of whose cells agree.

    orphans(orphan, lemma, cell, key), candidates(lexeme_id, unv_lemma, cell, key). A unique hit with an
    equal lemma is preferred, then a unique hit; else lexeme_id is NULL, a conflict.
    """
    hits = joins.universal(orphans, candidates, "orphan", "lexeme_id", ["cell", "key"]).select("orphan", "lexeme_id")
    lemmas = orphans.select("orphan", "lemma").distinct()
    named = hits.join(lemmas, "orphan").join(candidates.select("lexeme_id", "unv_lemma").distinct(), "lexeme_id").withColumn("same", F.coalesce(F.col("lemma") == F.col("unv_lemma"), F.lit(False)))
    g = named.groupBy("orphan").agg(F.count_distinct("lexeme_id").alias("n_hits"), F.min("lexeme_id").alias("any"), F.count_distinct(F.when(F.col("same"), F.col("lexeme_id"))).alias("n_same"), F.min(F.when(F.col("same"), F.col("lexeme_id"))).alias("same_id"))
    out = lemmas.join(g, "orphan", "left")
    return out.select("orphan", F.when(F.col("n_same") == 1, F.col("same_id")).when(F.col("n_hits") == 1, F.col("any")).alias("lexeme_id"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def explicit_gaps(triples: DataFrame) -> DataFrame:
    """(lemma_nfc, tag, cell) of cells that a source marks as non-existent."""
    rows = triples.where(features.is_gap(F.col("form_raw"), F.col("tag_raw")))
    return rows.select(text.nfc(F.col("lemma_raw")).alias("lemma_nfc"), F.col("tag_raw").alias("tag"), features.cell_of_v4_tag(F.col("tag_raw")).alias("cell")).distinct()


def summary(paired: DataFrame) -> DataFrame:
    """(status, n, score_min, score_mean, n_tied): how paradigms of two sources were matched."""
    return paired.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 4).alias("score_min"), F.round(F.avg("score"), 4).alias("score_mean"), F.count_if(F.size("tied") > 1).alias("n_tied"))
