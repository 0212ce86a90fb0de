"""Equation tables: modular arithmetic, and (root, template, cell) -> form with opaque symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.plans import splits


def modular_table(spark: SparkSession, p: int) -> DataFrame:
    """(a, b, added, subtracted, divided) modulo a prime p; division by 0 is NULL. p bounds all dimensions."""
    n = spark.range(p)
    inverse = n.select(F.col("id").alias("x")).crossJoin(F.broadcast(n.select(F.col("id").alias("inverse")))).where((F.col("x") * F.col("inverse")) % p == 1)
    grid = n.select(F.col("id").alias("a")).crossJoin(F.broadcast(n.select(F.col("id").alias("b"))))
    grid = grid.join(F.broadcast(inverse), F.col("b") == F.col("x"), "left")
    a, b = F.col("a"), F.col("b")
    return grid.select("a", "b", ((a + b) % p).alias("added"), ((a - b + p) % p).alias("subtracted"), ((a * F.col("inverse")) % p).alias("divided"))


def symbols(df: DataFrame, column: str, seed: int, prefix: str) -> DataFrame:
    """(column, symbol): opaque numbers for the distinct values of a dimension, by a seeded permutation on the driver."""
    values = sorted(r[0] for r in df.select(column).distinct().collect())
    order = splits.generator(f"symbols_{column}", seed).permutation(len(values)).tolist()
    return df.sparkSession.createDataFrame([(v, f"{prefix}{k}") for v, k in zip(values, order)], f"{column} string, {column}_symbol string")


def equation_table(forms: DataFrame, seed: int) -> DataFrame:
    """Rows of forms(root, binyan, cell, form) with symbols for what a model sees and the rest as analysis columns."""
    out = forms
    for column, prefix in (("root", "R"), ("binyan", "T"), ("cell", "C")):
        out = out.join(F.broadcast(symbols(forms, column, seed, prefix)), column)
    key = F.concat_ws("_", "root_symbol", "binyan_symbol", "cell_symbol")
    return out.select(key.alias("eq_id"), "root_symbol", F.col("binyan_symbol").alias("template_symbol"), "cell_symbol", F.col("form").alias("target_voc"), *[F.col(c).alias(f"analysis__{c}") for c in ("root", "binyan", "cell")])


def fraction_split(table: DataFrame, train: float, seed: int, dev_rest: float = 0.1, dev_whole: float | None = None, key: str = "eq_id") -> DataFrame:
    """(eq_id, partition): a fraction trains, by hash order; dev as of splits.table_fractions."""
    units = table.select(key).distinct()
    dev, test = splits.table_fractions(units.count(), train, dev_rest, dev_whole)
    ranked = splits.global_rank(units.withColumn("_h", splits.hash_key("table", seed, F.col(key))), "_h", [key])
    return ranked.select(key, F.when(F.col("rank") < dev, "train").when(F.col("rank") < test, "dev").otherwise("test").alias("partition"))
