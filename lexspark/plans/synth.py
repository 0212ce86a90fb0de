"""Synthetic paradigms: templates, root sampling, realisation, and the canonical tables of a generated corpus."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import features, roots, text


def all_roots(letters: DataFrame, n: int) -> DataFrame:
    """(root, r1, ..., rn): all orders of n different letters of letters(c). A small dimension by design."""
    out = letters.select(F.col("c").alias("r1"))
    for i in range(2, n + 1):
        nxt = letters.select(F.col("c").alias(f"r{i}"))
        different = F.lit(True)
        for j in range(1, i):
            different = different & (F.col(f"r{i}") != F.col(f"r{j}"))
        out = out.crossJoin(F.broadcast(nxt)).where(different)
    return out.withColumn("root", F.concat(*[f"r{i}" for i in range(1, n + 1)]))


def sample_roots(spark: SparkSession, consonants: list[str], n: int, seed: int, repeat: bool = False, length: int = 3) -> DataFrame:
    """n roots without replacement by a seeded generator, sorted. The consonants bound the population."""
    every = list(product(consonants, repeat=length)) if repeat else list(permutations(consonants, length))
    picked = sorted(every[i] for i in np.random.default_rng(seed).choice(len(every), size=n, replace=False).tolist())
    names = [f"r{i + 1}" for i in range(length)]
    return spark.createDataFrame([("".join(r), *r) for r in picked], ", ".join(f"{c} string" for c in ["root", *names]))


def realize(roots_: DataFrame, cells: DataFrame, finals: bool = True) -> DataFrame:
    """roots(root, r1..) times cells(binyan, cell, pattern): the digits of a pattern replaced by radicals."""
    form = F.col("pattern")
    for i in (1, 2, 3):
        form = F.replace(form, F.lit(str(i)), F.col(f"r{i}"))
    form = text.nfc(form)
    return roots_.crossJoin(F.broadcast(cells)).withColumn("form", text.apply_finals(form) if finals else form)


#: Past tense endings by cell, and stems of the seven classes before them (fixed values of pointed Hebrew).
CONSONANT_ENDINGS = {"PST.1SG": "תִּי", "PST.2MSG": "תָּ", "PST.2FSG": "תְּ", "PST.1PL": "נוּ", "PST.2MPL": "תֶּם", "PST.2FPL": "תֶּן"}
VOWEL_ENDINGS = {"PST.3FSG": "ָה", "PST.3PL": "וּ"}
STEMS = {
    # class: (third person masculine, before consonant endings, before tem/ten, before vowel endings)
    "PAAL": ("1ָ2ַ3", "1ָ2ַ3ְ", "1ְ2ַ3ְ", "1ָ2ְ3"),
    "NIFAL": ("נִ1ְ2ַ3", "נִ1ְ2ַ3ְ", "נִ1ְ2ַ3ְ", "נִ1ְ2ְ3"),
    "PIEL": ("1ִ2ֵּ3", "1ִ2ַּ3ְ", "1ִ2ַּ3ְ", "1ִ2ְּ3"),
    "PUAL": ("1ֻ2ַּ3", "1ֻ2ַּ3ְ", "1ֻ2ַּ3ְ", "1ֻ2ְּ3"),
    "HIFIL": ("הִ1ְ2ִי3", "הִ1ְ2ַ3ְ", "הִ1ְ2ַ3ְ", "הִ1ְ2ִי3"),
    "HUFAL": ("הֻ1ְ2ַ3", "הֻ1ְ2ַ3ְ", "הֻ1ְ2ַ3ְ", "הֻ1ְ2ְ3"),
    "HITPAEL": ("הִתְ1ַ2ֵּ3", "הִתְ1ַ2ַּ3ְ", "הִתְ1ַ2ַּ3ְ", "הִתְ1ַ2ְּ3"),
}


def past_patterns(name: str) -> dict[str, str]:
    """Cell -> pattern of a class's past."""
    third, plain, heavy, vowel = STEMS[name]
    of = {features.CITATION_CELL: third} | {cell: vowel + ending for cell, ending in VOWEL_ENDINGS.items()}
    return of | {cell: (heavy if cell in ("PST.2MPL", "PST.2FPL") else plain) + ending for cell, ending in CONSONANT_ENDINGS.items()}


def past_templates(spark: SparkSession, classes: list[str] | None = None, custom: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(binyan, cell, pattern): nine past cells of each class; custom adds patterns of own classes."""
    every = {name: past_patterns(name) for name in classes or features.CLASSES} | (custom or {})
    return spark.createDataFrame([(name, cell, p) for name, cells in every.items() for cell, p in cells.items()], "binyan string, cell string, pattern string")


def generate(spark: SparkSession, consonants: list[str], n_roots: int, seed: int, classes: list[str] | None = None, gap_rate: float = 0.0, custom: dict | None = None, version: str = "v1", repeat: bool = False) -> dict[str, DataFrame]:
    """The canonical tables of a synthetic corpus: roots, lexemes, forms, provenance, validation.

    gap_rate: share of (lexeme, cell) that have no form, by hash of the form id; the citation cell always has one.
    """
    base = sample_roots(spark, consonants, n_roots, seed, repeat)
    named = base.withColumn("root_id", roots.content_id("SYN-RT-", F.concat(F.lit(f"{version}|"), "root"))).withColumn("units", F.array("r1", "r2", "r3"))
    cells = past_templates(spark, classes, custom)
    forms = realize(named, cells).withColumn("lexeme_id", roots.content_id("SYN-LX-", F.concat(F.lit(f"{version}|"), "root", F.lit("|"), "binyan")))
    forms = forms.withColumn("form_id", F.concat("lexeme_id", F.lit("."), "cell"))
    if gap_rate:
        gone = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "form_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)) < gap_rate
        forms = forms.where((F.col("cell") == features.CITATION_CELL) | ~gone)
    f = roots.features(F.col("units"))
    root_table = named.select("root_id", F.col("root").alias("root_normalized"), roots.orthographic(F.col("root")).alias("root_orthographic"), roots.root_id(roots.orthographic(F.col("root")), "SYN-RG-").alias("orthographic_root_group_id"), *[c.alias(k) for k, c in f.items()])
    root_table = root_table.withColumn("traditional_class", F.lit(None).cast("string"))
    form_table = forms.select(
        "form_id", "lexeme_id", "root_id", "binyan", F.col("cell").alias("canonical_cell"), F.col("form").alias("form_vocalized"), text.strip_points(F.col("form")).alias("form_unvocalized"),
        features.tag_of_cell(F.col("cell")).alias("source_tag"), F.lit("GOLD").alias("quality_tier"), F.lit("synthetic").alias("source_ids"),
    )
    from lexspark.plans import canonical

    form_table = canonical.syncretism(form_table)
    lexemes = form_table.groupBy("lexeme_id", "root_id", "binyan").agg(
        F.max(F.when(F.col("canonical_cell") == features.CITATION_CELL, F.col("form_vocalized"))).alias("lemma_vocalized"), F.count_distinct("canonical_cell").alias("n_past_cells"),
    ).withColumns({"paradigm_completeness": F.round(F.col("n_past_cells") / 9, 4), "paradigm_complete": F.col("n_past_cells") == 9, "quality_tier": F.lit("GOLD"), "source_primary": F.lit("synthetic")})
    rolled = lexemes.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_lexemes"), F.array_join(F.sort_array(F.collect_set("binyan")), "|").alias("binyanim"))
    root_table = root_table.join(rolled, "root_id")
    ids = root_table.select(F.col("root_id").alias("id")).unionByName(lexemes.select(F.col("lexeme_id").alias("id"))).unionByName(form_table.select(F.col("form_id").alias("id")))
    provenance = ids.select(F.concat(F.lit("SPV-"), "id").alias("provenance_id"), F.col("id").alias("canonical_record_id"), F.lit("synthetic").alias("source_name"))
    validation = spark.createDataFrame([], "check_id string, record_type string, record_id string, check_name string, severity string, details string")
    return {"roots": root_table, "lexemes": lexemes, "forms": form_table, "provenance": provenance, "validation": validation}
