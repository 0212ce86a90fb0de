"""Seeded train/dev/test assignments, their verification and statistics.

An assignment is a table (pair_id, partition). Groups are ordered in one of two ways:

* hash: by md5 of name, seed and group. Scales: ranks come from counts by hash prefix and a
  row number within a prefix, so no task holds all groups.
* compat: by a seeded numpy permutation of the sorted groups, on the driver. For groups
  up to some millions; results equal those of seeded runs elsewhere.

Greedy holdout and cell exposure in compat mode consume one generator group by group, so they
are sequential by definition and run on the driver over distinct keys, never over examples.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.features import CITATION_CELL, PAST_CELLS

FRACTIONS = (0.8, 0.1, 0.1)
PREFIX = 4  # hex digits of md5 by which ranks are counted: 65,536 counts at most
#: Fewer eligible pairs than this on a side make no split.
LEAST_PAIRS = 20


class LeakageError(AssertionError):
    """An assignment that breaks an invariant of its strategy."""


def generator(name: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.sha256(f"{name}|{seed}".encode()).hexdigest()[:8], 16))


def cut_offs(n: int, fractions=FRACTIONS) -> tuple[int, int]:
    """Ranks at which dev and test begin. Rounds half to even; without a dev share the rest is test."""
    train, test = round(fractions[0] * n), round(fractions[2] * n) if fractions[2] > 0 else 0
    dev = n - train - test
    if dev < 0 or (fractions[1] == 0 and dev > 0):
        dev = max(0, dev)
    return train, train + dev


def hash_key(name: str, seed: int, group: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{name}|{seed}|"), group.cast("string")))


def global_rank(df: DataFrame, key: str, ties: list[str], out: str = "rank") -> DataFrame:
    """Rank from 0 by a hex hash column, without a window over all rows."""
    df = df.withColumn("_p", F.substring(key, 1, PREFIX))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key, *ties)))
    return ranked.join(F.broadcast(counts), "_p").withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def partition_groups(groups: DataFrame, group: str, name: str, seed: int, fractions=FRACTIONS, mode: str = "hash") -> DataFrame:
    """(group, partition) for distinct non-null groups."""
    groups = groups.select(group).where(F.col(group).isNotNull()).distinct()
    if mode == "compat":
        spark = groups.sparkSession
        items = sorted(r[0] for r in groups.collect())
        dev, test = cut_offs(len(items), fractions)
        order = generator(name, seed).permutation(len(items))
        rows = [(items[i], "train" if k < dev else "dev" if k < test else "test") for k, i in enumerate(order.tolist())]
        return spark.createDataFrame(rows, groups.select(group).withColumn("partition", F.lit("")).schema)
    dev, test = cut_offs(groups.count(), fractions)
    ranked = global_rank(groups.withColumn("_h", hash_key(name, seed, F.col(group))), "_h", [group])
    part = F.when(F.col("rank") < dev, "train").when(F.col("rank") < test, "dev").otherwise("test")
    return ranked.select(group, part.alias("partition"))


def by_group(pairs: DataFrame, group: str, name: str, seed: int, mode: str = "hash", unit: str = "pair_id") -> DataFrame:
    """Assignment by whole groups."""
    return pairs.select(unit, group).join(partition_groups(pairs, group, name, seed, mode=mode), group).select(unit, "partition")


def iid(pairs, seed, mode="hash"):
    return partition_groups(pairs, "pair_id", "iid", seed, mode=mode)


def lexeme_holdout(pairs, seed, mode="hash"):
    return by_group(pairs, "analysis__root_binyan_key", "lexeme", seed, mode)


def root_holdout(pairs, seed, mode="hash"):
    return by_group(pairs, "analysis__orthographic_root_group_id", "root", seed, mode)


def class_ood(pairs: DataFrame, flag: str, name: str, seed: int, mode: str = "hash", unknown: Column | None = None, group: str = "analysis__orthographic_root_group_id", unit: str = "pair_id") -> DataFrame:
    """Test: all groups with the property on any row. The others are dealt 90 to 10 into train and dev.

    Groups are drawn over all rows, also those that `unknown` then excludes.
    """
    has = F.bool_or(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    groups = pairs.groupBy(group).agg(has.alias("_test"))
    rest = partition_groups(groups.where("not _test"), group, f"ood_{name}", seed, (0.9, 0.1, 0.0), mode)
    of = groups.join(rest, group, "left").select(group, F.when(F.col("_test"), "test").otherwise(F.col("partition")).alias("partition"))
    known = F.lit(False) if unknown is None else F.coalesce(unknown, F.lit(False))
    return pairs.select(unit, group, known.alias("_unknown")).join(of, group).select(unit, F.when(F.col("_unknown"), "excluded").otherwise(F.col("partition")).alias("partition"))


def root_class_holdout(pairs: DataFrame, seed: int, dev: float = 0.1, test: float = 0.1, key="analysis__root_binyan_key", root="analysis__root_id", klass="analysis__binyan") -> DataFrame:
    """Greedy holdout of (root, class) keys whose root and class both keep another key in train.

    Order-dependent, hence on the driver; its input is one row per distinct key.
    """
    spark = pairs.sparkSession
    info = {r[0]: (r[1], r[2]) for r in pairs.groupBy(key).agg(F.min(root), F.min(klass)).where(F.col(key).isNotNull()).collect()}
    left, classes = Counter(r for r, _ in info.values()), Counter(c for _, c in info.values())
    movable = sorted(k for k, (r, _) in info.items() if left[r] >= 2)
    walk = [movable[i] for i in generator("root_binyan", seed).permutation(len(movable)).tolist()]
    part = dict.fromkeys(info, "train")
    for name, quota in (("test", round(test * len(info))), ("dev", round(dev * len(info)))):
        for k in walk:
            r, c = info[k]
            if quota and part[k] == "train" and left[r] > 1 and classes[c] > 1:
                part[k] = name
                quota -= 1
                left[r] -= 1
                classes[c] -= 1
    table = spark.createDataFrame(list(part.items()), f"{key} string, partition string")
    return pairs.select("pair_id", key).join(table, key).select("pair_id", "partition")


def exposed_cells(lexemes: DataFrame, k: int, seed: int, mode: str = "hash") -> DataFrame:
    """(lexeme_id, cell): the citation cell and k - 1 others of each lexeme."""
    others = [c for c in PAST_CELLS if c != CITATION_CELL]
    if mode == "compat":
        rng = generator(f"cell_k{k}", seed)
        rows = []
        for x in sorted(r[0] for r in lexemes.select("lexeme_id").distinct().collect()):
            rows += [(x, c) for c in [CITATION_CELL, *(others[i] for i in rng.permutation(len(others))[: k - 1])]]
        return lexemes.sparkSession.createDataFrame(rows, "lexeme_id string, cell string")
    pick = F.slice(F.sort_array(F.transform(F.array(*map(F.lit, others)), lambda c: F.struct(F.md5(F.concat(F.lit(f"cell_k{k}|{seed}|"), F.col("lexeme_id"), F.lit("|"), c)).alias("h"), c.alias("c")))), 1, k - 1)
    cells = F.concat(F.array(F.lit(CITATION_CELL)), F.transform(pick, lambda s: s["c"]))
    return lexemes.select("lexeme_id").distinct().select("lexeme_id", F.explode(cells).alias("cell"))


def cell_k(pairs: DataFrame, k: int, seed: int, needed: int, mode: str = "hash", dev: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Paradigm completion: (assignment, exposed cells).

    needed: pairs of a complete lexeme. Hidden sources are excluded, exposed targets are train, the
    rest is dev or test by lexeme.
    """
    if not 2 <= k <= 8:
        raise ValueError(f"k is {k}; it has to be 2 to 8")
    full = pairs.groupBy("lexeme_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == needed).select("lexeme_id")
    exposed = exposed_cells(full, k, seed, mode)
    side = partition_groups(full, "lexeme_id", f"cell_k{k}_devtest", seed, (0.0, dev, 1 - dev), mode)
    shown = exposed.withColumn("_shown", F.lit(True))
    out = pairs.select("pair_id", "lexeme_id", "source_cell", "target_cell").join(side, "lexeme_id")
    out = out.join(shown.select("lexeme_id", F.col("cell").alias("source_cell"), F.col("_shown").alias("_s")), ["lexeme_id", "source_cell"], "left")
    out = out.join(shown.select("lexeme_id", F.col("cell").alias("target_cell"), F.col("_shown").alias("_t")), ["lexeme_id", "target_cell"], "left")
    part = F.when(F.col("_s").isNull(), "excluded").when(F.col("_t"), "train").otherwise(F.col("partition"))
    return out.select("pair_id", part.alias("partition")), exposed


def eligible_pairs(view: DataFrame) -> DataFrame:
    """The vocalized row of each eligible pair."""
    return view.where((F.col("condition") == "voc") & F.col("analysis__eligible_default")).dropDuplicates(["pair_id"])


def _crossings(pairs: DataFrame, checks: list[tuple[str, str, list[str], list[str], bool]]) -> DataFrame:
    """(violation, key) for checks (label, column, a, b, both), all in one pass.

    A value of the column that occurs in partitions of `a` is a violation if it occurs in those of `b` too, or, where `both` is false, if it doesn't.
    """
    of = F.col("partition")
    rows = F.array(*[F.struct(F.lit(label).alias("violation"), F.col(c).cast("string").alias("key"), of.isin(*a).alias("a"), of.isin(*b).alias("b"), F.lit(both).alias("both")) for label, c, a, b, both in checks])
    seen = pairs.select(F.explode(rows).alias("r")).select("r.*").where("key is not null and (a or b)")
    return seen.groupBy("violation", "key", "both").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a and b = both").select("violation", "key")


def violations(strategy: str, assignment: DataFrame, view: DataFrame, flag: str | None = None, exposed: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(violation, key): what breaks the invariants of a strategy. A clean assignment has no row."""
    attributes = view.where("condition = 'voc'").dropDuplicates(["pair_id"])
    pairs = assignment.join(attributes, "pair_id", "left")
    twice = assignment.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = [twice.select(F.lit("pair in two partitions").alias("violation"), F.col("pair_id").alias("key"))]
    bad = pairs.where((F.col("partition") != "excluded") & ~F.coalesce("analysis__eligible_default", F.lit(False)))
    out.append(bad.select(F.lit("ineligible pair assigned").alias("violation"), F.col("pair_id").alias("key")))
    checks: list = []
    group, root, key = "analysis__orthographic_root_group_id", "analysis__root_id", "analysis__root_binyan_key"
    if strategy in ("root_holdout", "class_ood"):
        checks += [(f"{c} shared by train and {p}", c, ["train"], [p], True) for c in (group, root) for p in ("dev", "test")]
    if strategy == "root_holdout":
        checks.append(("root group shared by dev and test", group, ["dev"], ["test"], True))
    if strategy == "class_ood":
        has = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
        wrong = ((F.col("partition") == "test") & ~has) | (F.col("partition").isin("train", "dev") & has)
        out.append(pairs.where(wrong).select(F.lit("property on the wrong side").alias("violation"), F.col("pair_id").alias("key")))
    if strategy == "lexeme_holdout":
        checks += [(f"{c} shared with train", c, ["train"], ["dev", "test"], True) for c in (key, "lexeme_id")]
    if strategy == "root_binyan_holdout":
        checks += [(f"{c} of {p} isn't in train", c, [p], ["train"], False) for c in (root, "analysis__binyan") for p in ("dev", "test")]
        checks += [(f"{c} shared with train", c, ["train"], ["dev", "test"], True) for c in (key, "lexeme_id")]
    if strategy == "cell_k":
        shown = exposed.withColumn("_shown", F.lit(True))
        cells = pairs.join(shown.select("lexeme_id", F.col("cell").alias("source_cell"), F.col("_shown").alias("_s")), ["lexeme_id", "source_cell"], "left")
        cells = cells.join(shown.select("lexeme_id", F.col("cell").alias("target_cell"), F.col("_shown").alias("_t")), ["lexeme_id", "target_cell"], "left")
        s, t = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
        wrong = ((F.col("partition") == "train") & ~(s & t)) | (F.col("partition").isin("dev", "test") & (t | ~s))
        out.append(cells.where(wrong).select(F.lit("cell on the wrong side").alias("violation"), F.col("pair_id").alias("key")))
        out.append(exposed.groupBy("lexeme_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != k).select(F.lit("wrong number of exposed cells").alias("violation"), F.col("lexeme_id").alias("key")))
        checks.append(("lexeme shared by dev and test", "lexeme_id", ["dev"], ["test"], True))
    if checks:
        out.append(_crossings(pairs, checks))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def verify(strategy: str, assignment: DataFrame, view: DataFrame, **kw) -> None:
    """Raises LeakageError if there is a violation."""
    found = violations(strategy, assignment, view, **kw).limit(5).collect()
    if found:
        raise LeakageError(f"{strategy}: " + "; ".join(f"{r['violation']}: {r['key']}" for r in found))


def stats(assignments: DataFrame, view: DataFrame, by: list[str] = ["partition"]) -> DataFrame:  # noqa: B006
    """Counts of each partition at every level, for all splits at once if `by` names a split column too."""
    a = "analysis__"
    rows = assignments.join(view, "pair_id")
    voc, unv = F.col("condition") == "voc", (F.col("condition") == "unv") & F.col(a + "eligible_default")
    distinct = lambda c: F.count_distinct(F.when(voc, F.col(c)))
    return rows.groupBy(*by).agg(
        F.count_if(voc).alias("examples_voc"), F.count_if(unv).alias("examples_unv"), F.count_distinct("pair_id").alias("pair_ids"),
        distinct(a + "target_form_id").alias("forms"), distinct("lexeme_id").alias("lexemes"), distinct(a + "root_id").alias("roots"),
        distinct(a + "orthographic_root_group_id").alias("orthographic_root_groups"), distinct(a + "root_binyan_key").alias("root_binyan_pairs"),
        F.round(F.avg(F.when(voc, F.col(a + "target_form_length"))), 3).alias("target_length_mean"),
        F.round(F.avg(F.when(voc, F.col(a + "target_is_syncretic").cast("double"))), 4).alias("syncretic_fraction"),
    )


def per_root(assignments: DataFrame, view: DataFrame, by: list[str] = ["partition"]) -> DataFrame:  # noqa: B006
    """Mean and largest number of vocalized examples of a root."""
    counts = assignments.join(view.where("condition = 'voc'"), "pair_id").groupBy(*by, "analysis__root_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.round(F.avg("n"), 3).alias("examples_per_root_mean"), F.max("n").alias("examples_per_root_max"))


def copy_leaks(assignments: DataFrame, exposed: DataFrame, view: DataFrame) -> DataFrame:
    """Evaluation targets that equal the form of an exposed cell of their lexeme, by partition and condition."""
    forms = view.select("condition", "lexeme_id", F.col("target_cell").alias("cell"), F.col("target_form").alias("form"))
    forms = forms.unionByName(view.select("condition", "lexeme_id", F.col("source_cell").alias("cell"), F.col("source_form").alias("form"))).dropDuplicates(["condition", "lexeme_id", "cell"])
    shown = forms.join(exposed, ["lexeme_id", "cell"], "left_semi").select("condition", "lexeme_id", F.col("form").alias("target_form")).distinct()
    rows = assignments.where(F.col("partition").isin("dev", "test")).join(view, "pair_id")
    return rows.join(shown, ["condition", "lexeme_id", "target_form"], "left_semi").groupBy("partition", "condition").agg(F.count(F.lit(1)).alias("n"))


def table_fractions(n: int, train: float, dev_rest: float = 0.1, dev_whole: float | None = None) -> tuple[int, int]:
    """Ranks at which dev and test begin when a fraction of a table trains.

    dev is a share of the rest, and at most dev_whole of the table if that is given.
    """
    rest = n - round(train * n)
    dev = round(dev_rest * rest) if dev_whole is None else min(round(dev_rest * rest), round(dev_whole * n))
    return n - rest, n - rest + dev


def block_holdout(blocks: DataFrame, unit: list[str], cover: list[list[str]], train: float, seed: int, tries: int = 1000) -> DataFrame:
    """(unit..., partition) that holds out whole blocks, drawn anew until train covers every value in `cover`.

    blocks: a row per (unit, covered columns). Only distinct units and covered values reach the driver.
    """
    spark = blocks.sparkSession
    columns = list(dict.fromkeys([*unit, *(c for cs in cover for c in cs)]))
    rows = [tuple(r) for r in blocks.select(*columns).distinct().collect()]
    at = {c: i for i, c in enumerate(columns)}
    of = defaultdict(list)
    for r in rows:
        of[tuple(r[at[c]] for c in unit)].append(r)
    units = sorted(of)
    want = [{tuple(r[at[c]] for c in cs) for r in rows} for cs in cover]
    rng = generator("block", seed)
    n, dev = round(train * len(units)), (len(units) - round(train * len(units))) // 2
    for _ in range(tries):
        order = rng.permutation(len(units)).tolist()
        inside = [r for i in order[:n] for r in of[units[i]]]
        if all({tuple(r[at[c]] for c in cs) for r in inside} == w for cs, w in zip(cover, want)):
            part = [(*units[i], "train" if k < n else "dev" if k < n + dev else "test") for k, i in enumerate(order)]
            return spark.createDataFrame(part, blocks.select(*unit).withColumn("partition", F.lit("")).schema)
    raise ValueError(f"no draw of {tries} covers all values in train")


def manifest(spark: SparkSession, name: str, strategy: str, seed: int, assignment: DataFrame, view: DataFrame) -> dict:
    """The nested JSON form of an assignment, for sinks. Lists ids, so meant for small datasets only."""
    pairs = assignment.join(view.where("condition = 'voc'").dropDuplicates(["pair_id"]), "pair_id", "left")
    columns = {"pair_ids": "pair_id", "lexeme_ids": "lexeme_id", "root_ids": "analysis__root_id", "orthographic_root_group_ids": "analysis__orthographic_root_group_id", "root_binyan_keys": "analysis__root_binyan_key"}
    rows = pairs.groupBy("partition").agg(*[F.sort_array(F.collect_set(c)).alias(n) for n, c in columns.items()]).collect()
    return {"split_name": name, "strategy": strategy, "seed": seed, "partitions": {r["partition"]: {n: list(r[n]) for n in columns} for r in rows}}
