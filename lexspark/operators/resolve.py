"""Resolution of claims: unanimous or NULL, and noisy-or confidences. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noisy_or(weight: Column, places: int = 4) -> Column:
    """Aggregate 1 - product(1 - w), rounded; 0 for no weight."""
    return F.round(1 - F.coalesce(F.product(1 - weight), F.lit(1.0)), places)


def noisy_or_distinct(df: DataFrame, keys: list[str], record: list[str], weight: str, out: str = "confidence") -> DataFrame:
    """Noisy-or over distinct records: of a record's weights the largest counts."""
    one = df.groupBy(*keys, *record).agg(F.max(weight).alias("_w"))
    return one.groupBy(*keys).agg(noisy_or(F.col("_w")).alias(out))


def unanimous(value: Column) -> Column:
    """Aggregate: the value if all non-null values are equal, else NULL. Two extremes, no set is gathered."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def decision_status(*fields: tuple[str, Column]) -> Column:
    """Aggregate status of several fields: NO_MATCH, <F>_AMBIGUOUS, <F>_AND_<G>_AMBIGUOUS, or MATCHED."""
    several = [(name, F.min(c) != F.max(c)) for name, c in fields]
    none = F.greatest(*[F.count(c) for _, c in fields]) == 0 if len(fields) > 1 else F.count(fields[0][1]) == 0
    names = F.concat_ws("_AND_", *[F.when(bad, F.lit(name)) for name, bad in several])
    return F.when(none, "NO_MATCH").when(names != "", F.concat(names, F.lit("_AMBIGUOUS"))).otherwise("MATCHED")


def decide(evidence: DataFrame, key: str, weak_methods: list[str]) -> DataFrame:
    """Root and class of each key from its evidence, never guessing.

    evidence: key, method, kind, weight, record_id, root, root_bare, binyan. Claims of weak
    methods count only where no other claim exists, and then only if they settle both
    fields. Returns status, both values, what supports them, and confidences.
    """
    strong = ~F.col("method").isin(*weak_methods)
    ev = evidence.withColumn("_strong", strong)
    pool = ev.groupBy(key).agg(
        F.bool_or("_strong").alias("_any_strong"),
        *[F.min(F.when(c, F.col(v))).alias(f"_{tag}_{v}_min") for tag, c in (("s", F.col("_strong")), ("w", ~F.col("_strong"))) for v in ("root_bare", "binyan")],
        *[F.max(F.when(c, F.col(v))).alias(f"_{tag}_{v}_max") for tag, c in (("s", F.col("_strong")), ("w", ~F.col("_strong"))) for v in ("root_bare", "binyan")],
    )

    def of(v: str, end: str) -> Column:
        return F.when(F.col("_any_strong"), F.col(f"_s_{v}_{end}")).otherwise(F.col(f"_w_{v}_{end}"))

    pool = pool.select(key, "_any_strong", *[of(v, e).alias(f"{v}_{e}") for v in ("root_bare", "binyan") for e in ("min", "max")])
    one = lambda v: F.when(F.col(f"{v}_min") == F.col(f"{v}_max"), F.col(f"{v}_min"))
    both = F.col("_any_strong") | (one("root_bare").isNotNull() & one("binyan").isNotNull())
    pool = pool.withColumn("_root", F.when(both, one("root_bare"))).withColumn("_class", F.when(both, one("binyan")))
    many = lambda v: F.coalesce(F.col(f"{v}_min") != F.col(f"{v}_max"), F.lit(False))
    status = (
        F.when(many("root_bare") & many("binyan"), "ROOT_AND_BINYAN_AMBIGUOUS")
        .when(many("root_bare"), "ROOT_AMBIGUOUS")
        .when(many("binyan"), "BINYAN_AMBIGUOUS")
        .when(~F.col("_any_strong"), F.when(F.col("_root").isNotNull() & F.col("_class").isNotNull(), "MATCHED_UNVOC_ONLY").otherwise("NO_MATCH"))
        .otherwise("MATCHED")
    )
    pool = pool.withColumn("status", status).select(key, "_any_strong", "_root", "_class", "status")
    used = ev.join(pool, key).where(F.col("_strong") | ~F.col("_any_strong"))
    by_root = F.coalesce(F.col("root_bare") == F.col("_root"), F.lit(False))
    by_class = F.coalesce(F.col("binyan") == F.col("_class"), F.lit(False))
    kinds = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("kind"))))
    records = used.where(by_root | by_class).groupBy(key, "record_id").agg(F.max("weight").alias("_w")).groupBy(key).agg(noisy_or(F.col("_w")).alias("match_score"))
    out = used.groupBy(key).agg(
        F.first("_root").alias("root"), F.first("_class").alias("binyan"), F.first("status").alias("status"),
        kinds(by_root).alias("root_kinds"), kinds(by_class).alias("binyan_kinds"),
        F.sort_array(F.collect_set(F.when(by_root, F.col("root")))).alias("root_dotted_variants"),
        F.sort_array(F.collect_set(F.when(by_root | by_class, F.col("method")))).alias("methods"),
        noisy_or(F.when(by_root, F.col("weight"))).alias("conf_root"), noisy_or(F.when(by_class, F.col("weight"))).alias("conf_binyan"),
    )
    return out.join(records, key, "left").withColumn("match_score", F.coalesce("match_score", F.lit(0.0)))
