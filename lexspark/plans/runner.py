"""All splits of the views of one dataset: assigned, verified, written, summed up. Splits with too few examples on a side are skipped and listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.plans import splits, views

#: Properties of roots and traditional labels that have a split of their own (fixed values).
PROPERTIES = ["sc_strong", "sc_final_he", "sc_hollow_candidate", "sc_initial_nun", "sc_geminate", "sc_guttural_containing", "sc_initial_yod_waw", "sc_quadriliteral"]
LABELS = ["SHLEMIM", "PE_NUN", "PE_YOD_WAW", "PE_ALEF", "AYIN_WAW_YOD", "AYIN_AYIN", "LAMED_YOD_HE", "LAMED_ALEF", "QUADRILITERAL"]


def enough(pairs: DataFrame, flags: list[str], both: bool = True, least: int = splits.LEAST_PAIRS) -> DataFrame:
    """(flag, positive, negative, kept): whether a property has enough pairs on both sides (or on the positive one) for a split, in one pass."""
    there = [f for f in flags if f in pairs.columns]
    has = lambda f: F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    if not there:
        return pairs.sparkSession.createDataFrame([(f, 0, 0, False) for f in flags], "flag string, positive long, negative long, kept boolean")
    counts = pairs.agg(F.array(*[F.struct(F.lit(f).alias("flag"), F.count_if(has(f)).alias("positive"), F.count_if(~has(f)).alias("negative")) for f in there]).alias("x"))
    kept = (F.col("positive") >= least) & ((F.col("negative") >= least) if both else F.lit(True))
    out = counts.select(F.explode("x").alias("r")).select("r.*").withColumn("kept", kept)
    lacking = [(f, 0, 0, False) for f in flags if f not in there]
    return out.unionByName(pairs.sparkSession.createDataFrame(lacking, out.schema)) if lacking else out


def planned(view: DataFrame, seeds: list[int], ks: list[int], needed: int, mode: str = "hash", everything: bool = True) -> tuple[list[tuple], DataFrame]:
    """((split, strategy, seed, assignment, arguments of the verifier), ...) and the (flag, positive, negative, kept) of properties.

    everything: all strategies; else only paradigm completion. Property splits take the first three seeds.
    """
    pairs = splits.eligible_pairs(view)
    out = []
    for seed in seeds:
        if everything:
            out += [(f"{s}_seed{seed}", s, seed, getattr(splits, s)(pairs, seed, mode), {}) for s in ("iid", "lexeme_holdout", "root_holdout")]
            out.append((f"root_binyan_holdout_seed{seed}", "root_binyan_holdout", seed, splits.root_class_holdout(pairs, seed), {}))
        for k in ks:
            assignment, exposed = splits.cell_k(pairs, k, seed, needed, mode)
            out.append((f"cell_k{k}_seed{seed}", "cell_k", seed, assignment, {"exposed": exposed, "k": k}))
    sides = enough(pairs, [views.A + p for p in PROPERTIES]).unionByName(enough(views.traditional_flags(pairs, LABELS), [f"{views.A}trad_{x}" for x in LABELS], both=False))
    if everything:
        labelled, unknown = views.traditional_flags(pairs, LABELS), F.col(views.A + "traditional_class").isNull()
        for flag in [r["flag"] for r in sides.where("kept").orderBy("flag").collect()]:
            name = flag.removeprefix(views.A)
            trad = name.startswith("trad_")
            label = f"tradclass_{name[5:]}" if trad else f"rootclass_{name[3:]}"
            for seed in seeds[:3]:
                out.append((f"{label}_seed{seed}", "class_ood", seed, splits.class_ood(labelled, flag, label, seed, mode, unknown=unknown if trad else None), {"flag": flag}))
    return out, sides


def run(view: DataFrame, name: str, folder: str, seeds: list[int], ks: list[int], needed: int, mode: str = "hash", everything: bool = True) -> tuple[DataFrame, DataFrame]:
    """Writes every verified assignment under folder/view=name/split=...; returns the summary by split and partition, and what was skipped."""
    plans, sides = planned(view, seeds, ks, needed, mode, everything)
    flagged = views.traditional_flags(view, LABELS)
    for split, strategy, seed, assignment, arguments in plans:
        path = f"{folder}/view={name}/split={split}"
        assignment.withColumns({"strategy": F.lit(strategy), "seed": F.lit(seed)}).write.mode("overwrite").parquet(path)
        splits.verify(strategy, view.sparkSession.read.parquet(path).select("pair_id", "partition"), flagged, **arguments)
    written = view.sparkSession.read.parquet(folder).where(F.col("view") == name).drop("view")
    return splits.stats(written, view, ["split", "strategy", "seed", "partition"]), sides.where("not kept").drop("kept")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Named report tables as one long table (section, row): what a report document shows."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in parts.items()])
