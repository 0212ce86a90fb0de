"""Contracts and quality: schema and key checks, tiers, reports. Checks return violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality tiers, best first (fixed values).
TIERS = ["GOLD", "SILVER", "QUESTIONABLE"]


class SchemaViolation(ValueError):
    """A table that breaks its contract; lists up to five keys."""


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int") - 1


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), (rank + 1).cast("int"))


def worst_tier(*tiers: Column) -> Column:
    """The worst of several tiers in a row."""
    return tier_name(F.greatest(*map(tier_rank, tiers)))


def tier_of(flags: Column, hard: list[str], no_gold: list[str], incomplete: Column | None = None, doubtful: Column | None = None) -> Column:
    """QUESTIONABLE for a hard flag or an incomplete record, SILVER for a lesser one, else GOLD."""
    no = F.lit(False)
    hit = lambda names: F.arrays_overlap(flags, F.array(*map(F.lit, names))) if names else no
    return (
        F.when(F.coalesce(hit(hard), no) | (no if incomplete is None else F.coalesce(incomplete, no)), "QUESTIONABLE")
        .when(F.coalesce(hit(no_gold), no) | (no if doubtful is None else F.coalesce(doubtful, no)), "SILVER")
        .otherwise("GOLD")
    )


def null_counts(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """(table_name, column_name, n_rows, n_nulls, n_key_duplicates) in a single pass over df."""
    whole = F.struct(*key) if len(key) > 1 else F.col(key[0])
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], (F.count(whole) - F.count_distinct(whole)).alias("_dup"))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in df.columns])
    return row.select(F.explode(pairs).alias("p"), "_n", "_dup").select(F.lit(name).alias("table_name"), F.col("p.c").alias("column_name"), F.col("_n").alias("n_rows"), F.col("p.n").alias("n_nulls"), F.col("_dup").alias("n_key_duplicates"))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, label: str) -> DataFrame:
    """(check_name, n_orphans, n_uncovered): child values without a parent, and parents without a child."""
    a, b = child.select(F.col(column).alias("k")).where("k is not null").distinct(), parent.select(F.col(key).alias("k")).distinct()
    orphans = a.join(b, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    bare = b.join(a, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_uncovered"))
    return orphans.withColumn("_", F.lit(1)).join(bare.withColumn("_", F.lit(1)), "_").select(F.lit(label).alias("check_name"), "n_orphans", "n_uncovered")


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def coverage(df: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts and measures overall and by each dimension, in one pass by GROUPING SETS, as (dimension, value, n, ...).

    Integers are the contract's measure type here; nulls of a dimension show as NOT_STATED.
    """
    df = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("NOT_STATED")).alias(d) for d in dimensions], *[m.alias(f"_m{i}") for i, m in enumerate(measures.values())])
    sets = [[]] + [[F.col(d)] for d in dimensions]
    out = df.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), *[F.sum(f"_m{i}").alias(k) for i, k in enumerate(measures)])
    n = len(dimensions)
    name, value = F.lit("ALL"), F.lit("ALL")
    for i, d in enumerate(dimensions):
        own = F.col("_g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.col(d)).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n", *measures)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column with a marginal; missing combinations are 0."""
    counts = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    return df.groupBy(row).agg(*counts, F.count(F.lit(1)).alias("total"))


def completeness(df: DataFrame, key: str, item: str, expected: list[str]) -> DataFrame:
    """How many expected items each key has, and which are missing, in the expected order."""
    want = F.array(*map(F.lit, expected))
    seen = df.groupBy(key).agg(F.collect_set(F.when(F.col(item).isin(*expected), F.col(item))).alias("_seen"))
    missing = F.array_except(want, "_seen")
    return seen.select(key, F.size("_seen").cast("long").alias("n_seen"), F.round(F.size("_seen") / len(expected), 4).alias("ratio"), (F.size(missing) == 0).alias("complete"), F.array_join(missing, "|").alias("missing"))


def missing_fields(df: DataFrame, key: str, columns: list[str], record_type: str) -> DataFrame:
    """Records with null fields and the names of those, joined by |."""
    names = F.concat_ws("|", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return df.select(F.lit(record_type).alias("record_type"), F.col(key).cast("string").alias("record_id"), names.alias("missing_fields")).where("missing_fields != ''")


def flag_summary(df: DataFrame, flags: str, severity: dict[str, str], by: list[str], default: str = "WARNING") -> DataFrame:
    """Explodes flags, looks up their severity and counts."""
    table = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    one = df.select(*by, F.explode(flags).alias("check_name")).withColumn("severity", F.coalesce(table[F.col("check_name")], F.lit(default)))
    return one.groupBy(*by, "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
