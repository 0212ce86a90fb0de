"""Information measures of soft assignments, and accuracy tables. Built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def anchors(df: DataFrame, id_col: str, vector: str, n: int) -> DataFrame:
    """(anchor, u): unit vectors of the n smallest ids. n is a small parameter."""
    first = df.select(id_col, vector).orderBy(id_col).limit(n)
    return first.select(F.row_number().over(Window.orderBy(id_col)).alias("anchor"), unit(F.col(vector)).alias("u"))


def assignments(df: DataFrame, anchor: DataFrame, id_col: str, vector: str, label: str, dims: int, n: int) -> DataFrame:
    """(id, label, anchor, p): softmax over anchors of scaled cosines. Anchors travel as one bounded broadcast."""
    scale = math.sqrt(2 * dims * math.log(n))
    table = anchor.agg(F.sort_array(F.collect_list(F.struct("anchor", "u"))).alias("anchors"))
    z = df.select(id_col, label, unit(F.col(vector)).alias("z")).join(F.broadcast(table))
    weights = F.transform("anchors", lambda a: F.exp(dot(F.col("z"), a["u"]) * scale))
    z = z.select(id_col, label, weights.alias("w")).withColumn("s", F.aggregate("w", F.lit(0.0), lambda s, x: s + x))
    return z.select(id_col, label, F.posexplode(F.transform("w", lambda x: x / F.col("s"))).alias("anchor", "p"))


def entropy(p: Column) -> Column:
    """Aggregate: entropy in nats of probabilities."""
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def soft_entropy(df: DataFrame, anchor: DataFrame, id_col: str, vector: str, label: str, dims: int, n: int = 16) -> DataFrame:
    """One row: h_z of the mean assignment, i_example and i_label, and h_z over its maximum."""
    a = assignments(df, anchor, id_col, vector, label, dims, n)
    whole = a.groupBy("anchor").agg(F.avg("p").alias("m")).agg(entropy(F.col("m")).alias("hz"))
    each = a.groupBy(id_col).agg(entropy(F.col("p")).alias("h")).agg(F.avg("h").alias("hx"))
    by = a.groupBy(label, "anchor").agg(F.avg("p").alias("m"), F.count(F.lit(1)).alias("c"))
    by = by.groupBy(label).agg(entropy(F.col("m")).alias("h"), F.max("c").alias("c")).agg((F.sum(F.col("h") * F.col("c")) / F.sum("c")).alias("hl"))
    one = whole.join(F.broadcast(each)).join(F.broadcast(by))
    r = lambda c: F.round(c, 4)
    return one.select(r(F.col("hz")).alias("h_z"), r(F.col("hz") - F.col("hx")).alias("i_example"), r(F.col("hz") - F.col("hl")).alias("i_label"), r(F.col("hz") / math.log(n)).alias("h_z_eff"))


def exact_match(df: DataFrame, right: Column, by: list) -> DataFrame:
    """Share of rows that are right, by group."""
    return df.groupBy(*by).agg(F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def sequence_match(df: DataFrame, predicted: str, target: str) -> Column:
    """Whether all positions of a predicted string are right."""
    return F.col(predicted).eqNullSafe(F.col(target))
