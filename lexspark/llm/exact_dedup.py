"""Exact dedup by deterministic block naming (operator 3): DataFrame functions only.

A normalised text (A-Z lower-cased) is cut into blocks of BLOCK bytes. Sorting blocks
gives each an integer name; then adjacent names are paired and the pairs sorted and named in the
same way, until one name is left. Two texts have the same number of blocks and the
same last name exactly when they are equal.

Sorting is spread over cells: a block's cell is its 64-bit hash, and its name is the cell and
the block's rank among the distinct blocks of that cell, sorted. Names are hence a pure
function of the data (a lost executor recomputes the same ones), nothing needs a global
order, and no two different blocks can share a name. Cells are counted first: a cell with a single row holds
a single value. Only blocks of the other cells are compared, by the smallest and the largest of each cell, which are
aggregated before the shuffle, so that a block held by a third of all rows costs a row per
task. Where these differ, rows get their rank by a join on the value. Pairs are four integers, so
their extremes are taken by column and need no second pass.

What joins by a key that many rows may share is split: hot keys are broadcast, the others are joined by a shuffle
(common.split_join).

Rows are told apart by their id and the digest of their text, so repeated rows and null ids
are no problem: null ids are kept, equal to each other and smaller than any other id; of
rows that repeat the largest id each is kept. A null text counts as empty (no block). Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import common

BLOCK = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIR = ["lc", "lr", "rc", "rr"]


def normalised(text_col: str):
    """A-Z lower-cased. lower() does the same for ASCII, and faster."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def cut(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    """keep, blocks, at and value (binary): a row for each block; for an empty text one of 0 blocks."""
    rows = docs.select(*keep, normalised(text_col).alias("norm")).select("*", F.col("norm").cast("binary").alias("data"))
    size = F.octet_length("data")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / BLOCK)).cast("int")), lambda i: F.substr("data", i * BLOCK + 1, F.lit(BLOCK)))
    return rows.select("*", F.ceil(size / BLOCK).cast("int").alias("blocks"), F.posexplode(pieces).alias("at", "value"))


def crowded_blocks(docs: DataFrame, level: DataFrame, text_col: str) -> DataFrame:
    """(cell, value, rank) of the blocks in cells that hold several values, from level(cell, ...)."""
    counts = level.where("blocks > 0").groupBy("cell").agg(F.count("*").alias("n"))
    shared = common.materialize(counts.where("n > 1"), "shared")
    values = cut(docs, text_col).where("blocks > 0").select("value", F.xxhash64("value").alias("cell"))
    same = common.split_join(values, shared, ["cell"], "n", level.count(), "left_semi")
    uneven = same.groupBy("cell").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo != hi").select("cell")
    uneven = common.materialize(uneven, "uneven")
    common.discard(shared)
    if uneven.isEmpty():
        return None
    several = values.join(uneven, "cell", "left_semi").distinct().groupBy("cell").agg(F.sort_array(F.collect_set("value")).alias("sorted"))
    return common.materialize(several.select("cell", F.posexplode("sorted").alias("rank", "value")), "ranks")


def crowded_pairs(pairs: DataFrame) -> DataFrame:
    """(cell, lc, lr, rc, rr, rank) of the pairs in cells that hold several."""
    spread = [F.min(c) != F.max(c) for c in PAIR]
    uneven = pairs.groupBy("cell").agg((spread[0] | spread[1] | spread[2] | spread[3]).alias("several")).where("several").select("cell")
    uneven = common.materialize(uneven, "uneven")
    if uneven.isEmpty():
        return None
    several = pairs.join(uneven, "cell", "left_semi").groupBy("cell").agg(F.sort_array(F.collect_set(F.struct(*PAIR))).alias("sorted"))
    return common.materialize(several.select("cell", F.posexplode("sorted").alias("rank", "p")).select("cell", "rank", "p.*"), "ranks")


def ranked(rows: DataFrame, ranks: DataFrame | None, on: list[str]) -> DataFrame:
    """rows with the rank of what they hold (the columns `on`) in their cell; 0 where it is alone there."""
    if ranks is None:
        return rows.withColumn("rank", F.lit(0))
    found = rows.join(ranks.select("cell", *on, F.col("rank").alias("found")), ["cell", *on], "left")
    return found.withColumn("rank", F.coalesce("found", F.lit(0))).drop("found")


def identities(docs: DataFrame, text_col: str) -> DataFrame:
    """docs(id, text) -> (id, sha, copies, blocks, cell, rank): a row for each distinct id and text."""
    key, used = ["id", "sha", "copies", "blocks"], []

    def written(df: DataFrame, tag: str) -> DataFrame:
        used.append(common.materialize(df, tag))
        return used[-1]

    level = cut(docs, text_col, "id").select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), "blocks", "at", F.xxhash64("value").alias("cell"))
    level = written(level, "blocks")
    ranks = crowded_blocks(docs, level, text_col)
    if ranks is not None:
        values = cut(docs, text_col, "id").select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), "blocks", "at", "value", F.xxhash64("value").alias("cell"))
        level = written(ranked(values, ranks, ["value"]).drop("value"), "blocks")
    else:
        level = level.withColumn("rank", F.lit(0))
    # Rows of one id are almost always one; only where some repeat it in full are they merged.
    if level.where("at = 0").groupBy("id", "sha").count().where("count > 1").isEmpty():
        level = level.withColumn("copies", F.lit(1).cast("long"))
    else:
        level = written(level.groupBy("id", "sha", "blocks", "at", "cell", "rank").agg(F.count("*").alias("copies")), "blocks")
    level = level.withColumn("left", F.col("blocks"))
    out = level.where("left <= 1").select(*key, F.when(F.col("blocks") > 0, F.col("cell")).otherwise(F.lit(0)).alias("cell"), "rank")
    while not (longer := level.where("left > 1")).isEmpty():
        side = lambda c, odd: F.max(F.when(F.col("at") % 2 == odd, F.col(c)))
        pairs = longer.groupBy(*key, "left", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            side("cell", 0).alias("lc"), side("rank", 0).alias("lr"), F.coalesce(side("cell", 1), F.lit(0)).alias("rc"), F.coalesce(side("rank", 1), F.lit(-1)).alias("rr")
        )
        pairs = pairs.withColumn("left", F.ceil(F.col("left") / 2).cast("int")).withColumn("cell", F.xxhash64("left", *PAIR))
        pairs = written(pairs, "pairs")
        level = ranked(pairs, crowded_pairs(pairs), PAIR)
        out = out.unionByName(level.where("left = 1").select(*key, "cell", "rank"))
    out = common.materialize(out, "identities")
    for df in used:
        common.discard(df)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    names = identities(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    key = ["blocks", "cell", "rank"]
    groups = names.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("n"))
    groups = common.materialize(groups, "groups")
    out = common.split_join(names, groups, key, "n", names.count(), "inner")
    if not names.where("copies > 1").isEmpty():
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
