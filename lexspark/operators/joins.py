"""Joins of the pipeline: pair generation, votes, universal matches, multi-probe evidence, absence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_pairs(df: DataFrame, keys: list[str], cell: str, columns: list[str], sources=None) -> DataFrame:
    """Inner self-join on keys with unequal cells: a row for each ordered pair.

    sources: filter over df that source rows have to meet (pushed below the join).
    """
    src = df if sources is None else df.where(sources)
    src = src.select(*keys, *[F.col(c).alias(f"s_{c}") for c in dict.fromkeys([cell, *columns])])
    tgt = df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"t_{c}") for c in dict.fromkeys([cell, *columns])])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]) & (F.col(f"s_{cell}") != F.col(f"t_{cell}"))
    return src.join(tgt, on).drop(*[f"_{k}" for k in keys])


def nearest(df: DataFrame, keys: list[str], cell: str, name: str) -> DataFrame:
    """(cell, nearest, distance, n_tied): among rows with equal keys and another cell, those whose name is nearest by edit distance.

    nearest: their smallest cell; n_tied: pairs of rows at that distance. Distances are taken between distinct names of equal keys, however
    many rows have them. A null distance (a null name) comes after all others. Cells of several names within their keys are paired cell by cell.
    """
    on = lambda a, b, *safe: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys] + [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in safe])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, cell]])
    cells = df.where(whole).groupBy(*keys, F.col(name).alias("_n"), F.col(cell).alias("_c")).agg(F.count(F.lit(1)).alias("_k"))
    several = cells.groupBy(*keys, "_c").agg((F.count(F.lit(1)) > 1).alias("_several")).where("_several")
    names = cells.groupBy(*keys, "_n").agg(F.sum("_k").alias("_all"), F.min("_c").alias("_low"))
    after = cells.alias("a").join(names.alias("b"), on("a", "b", "_n")).where("a._c > b._low").groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, "_n"]]).agg(F.min("a._c").alias("_next"))
    # What the names beside each one give at best.
    distance = F.levenshtein("a._n", "b._n").cast("long")
    near = names.alias("a").join(names.alias("b"), on("a", "b")).where("not (a._n <=> b._n)").groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, "_n"]], distance.alias("_d"))
    near = near.agg(F.min("b._low").alias("_near"), F.sum("b._all").alias("_tied"))
    near = near.groupBy(*keys, "_n").agg(F.min(F.struct(F.col("_d").isNull(), "_d", "_near", "_tied")).alias("_x")).select(*keys, "_n", "_x._d", "_x._near", "_x._tied")
    plain = cells.join(several, [*keys, "_c"], "left_anti")
    beside = plain.alias("a").join(near.alias("b"), on("a", "b", "_n")).select("a._c", "b._d", "b._near", (F.col("_tied") * F.col("_k")).alias("_tied"))
    own = plain.alias("a").join(names.alias("b"), on("a", "b", "_n")).where("b._all > a._k").join(after.alias("c"), on("a", "c", "_n"), "left")
    own = own.select("a._c", F.levenshtein("a._n", "a._n").cast("long").alias("_d"), F.when(F.col("a._c") > F.col("b._low"), F.col("b._low")).otherwise(F.col("c._next")).alias("_near"), ((F.col("b._all") - F.col("a._k")) * F.col("a._k")).alias("_tied"))
    mixed = cells.join(several, [*keys, "_c"], "left_semi").alias("a").join(cells.alias("b"), on("a", "b")).where("a._c != b._c").select("a._c", distance.alias("_d"), F.col("b._c").alias("_near"), (F.col("a._k") * F.col("b._k")).alias("_tied"))
    found = beside.unionByName(own).unionByName(mixed).groupBy("_c", "_d").agg(F.min("_near").alias("_near"), F.sum("_tied").alias("_tied"))
    best = found.groupBy("_c").agg(F.min(F.struct(F.col("_d").isNull(), "_d", "_near", "_tied")).alias("_x"))
    return best.select(F.col("_c").alias(cell), F.col("_x._near").alias("nearest"), F.col("_x._d").alias("distance"), F.col("_x._tied").alias("n_tied"))


def votes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: list[str]) -> DataFrame:
    """Blocking join: how many keys each pair of left and right shares. Keys are distinct within an id."""
    a = left.select(left_id, *key).distinct()
    b = right.select(right_id, *key).distinct()
    return a.join(b, key).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("votes"))


def universal(needs: DataFrame, has: DataFrame, left_id: str, right_id: str, key: list[str]) -> DataFrame:
    """Pairs in which the right side has every key that the left side needs.

    Candidates have the left side's rarest key; only for these are the other keys looked up.
    """
    need, have = needs.select(left_id, *key).distinct(), has.select(right_id, *key).distinct()
    count = have.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rarest = need.join(count, key, "left").groupBy(left_id).agg(F.count(F.lit(1)).alias("n_needed"), F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), *key)).alias("_r"))
    candidates = rarest.select(left_id, "n_needed", *[F.col(f"_r.{k}").alias(k) for k in key]).join(have, key).select(left_id, right_id, "n_needed")
    met = candidates.join(need, left_id).join(have, [right_id, *key], "left_semi")
    return met.groupBy(left_id, right_id, "n_needed").agg(F.count(F.lit(1)).alias("_m")).where("_m = n_needed").select(left_id, right_id, "n_needed")


def multi_probe(probes: dict[str, DataFrame], key: str, record: str, exact: list[str], loose: list[str]) -> DataFrame:
    """Union of (key, record, method) by each probe; a loose hit goes if the record was hit exactly."""
    hits = reduce(DataFrame.unionByName, [df.select(key, record).distinct().withColumn("method", F.lit(m)) for m, df in probes.items()])
    sure = hits.where(F.col("method").isin(*exact)).select(key, record).distinct()
    kept = hits.where(F.col("method").isin(*loose)).join(sure, [key, record], "left_anti")
    return hits.where(~F.col("method").isin(*loose)).unionByName(kept)


def probe_counts(left: DataFrame, right: DataFrame, key: str, record: str, exact: str, loose: str, links: DataFrame) -> DataFrame:
    """(method, n, n_left, n_right) of multi_probe() over three probes: equal `exact` values, links(key, record), and equal `loose` values,
    where the first two suppress the third. Pairs of equal values are counted by value and never formed; only links are. Keys and records are distinct.
    """
    l = left.select(F.col(key).alias("_k"), F.col(exact).alias("_e"), F.col(loose).alias("_l"))  # noqa: E741
    r = right.select(F.col(record).alias("_k"), F.col(exact).alias("_e"), F.col(loose).alias("_l"))
    pairs = links.select(F.col(key).alias("_a"), F.col(record).alias("_b")).distinct()
    ends = pairs.join(l.select(F.col("_k").alias("_a"), F.col("_e").alias("_ea"), F.col("_l").alias("_la")), "_a", "left").join(r.select(F.col("_k").alias("_b"), F.col("_e").alias("_eb"), F.col("_l").alias("_lb")), "_b", "left")
    # A link takes a loose pair away unless an equal exact value does so already.
    taken = F.count_if((F.col("_la") == F.col("_lb")) & ~F.coalesce(F.col("_ea") == F.col("_eb"), F.lit(False)))

    def side(own, other, end):
        """A row for each of own: how many exact, linked and loose pairs it is in."""
        count = lambda *by: other.groupBy(*by).agg(F.count(F.lit(1)).alias("_".join(["n", *by])))
        linked = ends.groupBy(F.col(end).alias("_k")).agg(F.count(F.lit(1)).alias("_links"), taken.alias("_taken"))
        out = own.join(count("_e"), "_e", "left").join(count("_l"), "_l", "left").join(count("_e", "_l"), ["_e", "_l"], "left").join(linked, "_k", "full")
        n = lambda c: F.coalesce(c, F.lit(0))
        return out.select(n("n__e").alias("exact"), n("_links").alias("linked"), (n("n__l") - n("n__e__l") - n("_taken")).alias("loose"))

    methods = ["exact", "linked", "loose"]
    some = lambda name: [F.count_if(F.col(m) > 0).alias(f"{name}_{m}") for m in methods]
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(f"n_{m}") for m in methods]
    both = side(l, r, "_a").agg(*some("left"), *sums).crossJoin(side(r, l, "_b").agg(*some("right")))
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"n_{m}").alias("n"), F.col(f"left_{m}").alias("n_left"), F.col(f"right_{m}").alias("n_right")) for m in methods])
    return both.select(F.inline(rows)).where("n > 0")


def absent(asserted: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """Keys asserted absent that nothing gives a value for. A null key is never given, so it stays."""
    return asserted.select(*key).distinct().join(given.select(*key).distinct(), key, "left_anti")


def exists_flag(df: DataFrame, found: DataFrame, key: list[str], out: str) -> DataFrame:
    """Existence join: df with a boolean that tells whether its key is found."""
    return df.join(found.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left_only")).unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))
