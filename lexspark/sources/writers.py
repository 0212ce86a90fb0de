"""Writers: tables, views, assignments, reports, frozen manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FrozenError(RuntimeError):
    """A frozen version whose content would change."""


def escaped(df: DataFrame) -> DataFrame:
    """Tabs and newlines in strings made visible, as a TSV needs."""
    fix = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "\t", r"\\t"), "\n", r"\\n").alias(c)
    return df.select(*[fix(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def table(df: DataFrame, stem: str, tsv: bool = True) -> None:
    """Parquet, and an escaped TSV beside it."""
    df.write.mode("overwrite").parquet(f"{stem}.parquet")
    if tsv:
        escaped(df).write.mode("overwrite").csv(f"{stem}.tsv", sep="\t", header=True, quote="", escape="", nullValue="")


def view(df: DataFrame, folder: str, name: str, prefix: str = "analysis__") -> None:
    """Parquet, TSV, and JSON lines with the analysis columns nested."""
    table(df, f"{folder}/{name}")
    inner = [c for c in df.columns if c.startswith(prefix)]
    nested = F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in inner]).alias("analysis")
    df.select(*[c for c in df.columns if c not in inner], nested).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}.jsonl")


def assignments(df: DataFrame, folder: str) -> None:
    """assignments(view, split, pair_id, partition), a folder for each view and split."""
    df.repartition("view", "split").write.mode("overwrite").partitionBy("view", "split").parquet(folder)


def report(df: DataFrame, path: str, order: list) -> None:
    """A small sorted TSV in one file."""
    escaped(df.orderBy(*order)).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    out = df.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *part), 256)).first()
    return out[0]


def manifest(tables: dict[str, DataFrame], path: str, version: str, frozen: bool = False) -> dict:
    """Digests of tables under a version. A frozen version with other digests is not overwritten."""
    spark = next(iter(tables.values())).sparkSession
    new = {"version": version, "frozen": frozen, "tables": {k: {"rows": v.count(), "digest": table_digest(v)} for k, v in tables.items()}}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
        if old["frozen"] and old["version"] == version and old["tables"] != new["tables"]:
            raise FrozenError(f"{version} is frozen and its tables have changed")
    spark.createDataFrame([(json.dumps(new, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return new


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table as Markdown. For aggregates; at most `limit` rows are shown."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows), ""])


def document(spark, title: str, sections: dict[str, DataFrame], path: str) -> str:
    """A report of several tables as one Markdown file; returns its text. For aggregates, see markdown()."""
    text = "\n".join([f"# {title}", "", *(markdown(df, name) for name, df in sections.items())])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
