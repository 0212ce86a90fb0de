"""Ordered operators: runs, numbering of duplicates and variants, ranked choice, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, partition: list[str], order: list[str], value: Column, counts: Column | None = None, out: str = "run") -> DataFrame:
    """Gaps and islands: numbers maximal runs of rows with the same value.

    counts: rows for which it is false break a run and get no number. They have to be in
    df: filtering them out before would join the runs on both sides.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    df = df.withColumn("_v", value).withColumn("_c", counts)
    fresh = F.col("_c") & (~F.coalesce(F.lag("_c").over(w), F.lit(False)) | ~F.col("_v").eqNullSafe(F.lag("_v").over(w)))
    df = df.withColumn("_n", fresh.cast("long"))
    number = F.when(F.col("_c"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(out, number).drop("_v", "_c", "_n")


def duplicate_groups(df: DataFrame, partition: list[str], value: str, rank: list[str], out: str = "dup_no") -> DataFrame:
    """Numbers values that occur more than once in a partition by their first row in rank order; NULL for others."""
    same = Window.partitionBy(*partition, value)
    first = F.min(F.struct(*rank)).over(same)
    df = df.withColumn("_k", F.when(F.col(value).isNotNull(), F.count(F.lit(1)).over(same))).withColumn("_f", first)
    repeated = F.coalesce(F.col("_k") > 1, F.lit(False))
    number = F.dense_rank().over(Window.partitionBy(*partition, repeated).orderBy("_f"))
    return df.withColumn(out, F.when(repeated, number).cast("long")).drop("_k", "_f")


def variants(df: DataFrame, partition: list[str], value: str, order: str, out: str = "variant_no") -> DataFrame:
    """Numbers the distinct values of a partition by first appearance."""
    first = df.groupBy(*partition, value).agg(F.min(order).alias("_first"))
    number = F.dense_rank().over(Window.partitionBy(*partition).orderBy("_first", value))
    return first.withColumn(out, number.cast("long")).withColumnRenamed("_first", f"first_{order}")


def top_scores(df: DataFrame, partition: list[str], score: str, order: list[str], k: int = 10) -> DataFrame:
    """The k best candidates of each partition with the top score, the next distinct one and the number tied."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(score), *order))).where(F.col("_rn") <= k)
    every = Window.partitionBy(*partition)
    ranked = ranked.withColumn("top_score", F.max(score).over(every))
    tied = F.abs(F.col(score) - F.col("top_score")) < 1e-9
    return ranked.withColumn("n_tied", F.sum(tied.cast("long")).over(every)).withColumn("second_score", F.coalesce(F.max(F.when(~tied, F.col(score))).over(every), F.lit(0.0))).withColumnRenamed("_rn", "rank")


def ordered_join(value: Column, rank: Column, sep: str = "|") -> Column:
    """Aggregate: distinct values joined in rank order."""
    pairs = F.sort_array(F.collect_set(F.struct(rank.alias("r"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda s: s["v"]), sep)


def first_reaching(metric: Column, step: Column, threshold: float) -> Column:
    """Aggregate: the first step at which the metric reaches the threshold."""
    return F.min(F.when(metric >= threshold, step))


def stratified_round_robin(df: DataFrame, strata: list[str], unit: str, n: int, seed: str = "0") -> DataFrame:
    """n rows dealt out over strata in turn; the order of members and strata is a hash of the seed."""
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata], F.col(unit).cast("string")))
    stratum = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(key, unit))
    return df.withColumn("turn", turn.cast("long")).withColumn("_s", stratum).orderBy("turn", "_s", unit).limit(n).drop("_s")


def log_spaced_steps(spark, last: int, n: int) -> DataFrame:
    """Distinct steps between 1 and last, evenly spaced on a log scale."""
    return spark.range(n).select(F.bround(F.pow(F.lit(float(last)), F.col("id") / max(1, n - 1))).cast("long").alias("step")).distinct()
