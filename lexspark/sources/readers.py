"""Readers: triples, wiki dumps, tables, tolerant JSON lines. All lazy, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def triples(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(file, line_no, lemma_raw, form_raw, tag_raw) of lines with three tab-separated fields; blank ones are skipped.

    Line numbers count from 1 and include blank lines; a line with another number of fields fails. A line's number is its
    place in its partition and how many lines the partitions before have, which is a row for each partition.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    lines = lines.withColumns({"part": F.shiftright("n", 33), "at": F.col("n").bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = lines.groupBy("part").agg(F.count("*").alias("lines")).select("part", before.alias("before"))
    df = lines.join(F.broadcast(offsets), "part").select((F.col("at") + F.col("before") + 1).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))
    df = df.where(~F.col("value").rlike(r"(?U)^\s*$")).withColumn("p", F.split("value", "\t", -1))
    message = F.concat(F.lit(f"{label}:"), F.col("line_no").cast("string"), F.lit(": expected 3 tab-separated fields, got "), F.size("p").cast("string"))
    part = lambda i: F.when(F.size("p") == 3, F.get("p", F.lit(i))).otherwise(F.raise_error(message))
    return df.select(F.lit(label).alias("file"), "line_no", part(0).alias("lemma_raw"), part(1).alias("form_raw"), part(2).alias("tag_raw"))


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
])


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, page_id, rev_id, timestamp, text) of a MediaWiki XML dump, plain or .bz2; a missing text is ''."""
    pages = spark.read.format("xml").option("rowTag", "page").option("valueTag", "_VALUE").schema(PAGE).load(path)
    return pages.select("title", "ns", F.col("id").alias("page_id"), F.col("revision.id").alias("rev_id"), F.col("revision.timestamp").alias("timestamp"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def relevant_pages(pages: DataFrame, markers: list[str], skip_ns: int = 10) -> DataFrame:
    """Pages outside a namespace whose text has a marker: a cheap filter before any parsing."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("text").contains(m)
    return pages.where((F.col("ns") != skip_ns) & hit)


def page_cache(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Verbatim pages from which a row was extracted."""
    return pages.join(extracted.select("page_id").distinct(), "page_id", "left_semi")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; types are given, never inferred."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", escape="")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that can't be parsed."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class ChecksumError(ValueError):
    """A fetched file that isn't the pinned one."""


def verified(spark: SparkSession, path: str, pinned: dict[str, str]) -> DataFrame:
    """checksums() of files that were put there, all of which have to have the pinned digest by name; fetching itself is left to the deployment."""
    found = checksums(spark, path).withColumn("name", F.substring_index("path", "/", -1))
    got = {r["name"]: r["sha256"] for r in found.select("name", "sha256").collect()}
    wrong = [name for name, digest in pinned.items() if got.get(name) != digest]
    if wrong:
        raise ChecksumError(f"not as pinned: {', '.join(sorted(wrong))}")
    return found
