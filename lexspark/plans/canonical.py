"""Steps that turn resolved records into canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features
from lexspark.operators import ordered


def syncretism(forms: DataFrame) -> DataFrame:
    """Groups of cells of a lexeme that share a form, for pointed and plain forms: flag and group id."""
    out = forms.withColumn("_rank", features.cell_rank(F.col("canonical_cell")))
    for column, flag, group, letter in (("form_vocalized", "is_syncretic", "syncretism_group", "V"), ("form_unvocalized", "is_syncretic_unvocalized", "syncretism_group_unvocalized", "U")):
        out = ordered.duplicate_groups(out, ["lexeme_id"], column, ["_rank"], "_no")
        out = out.withColumn(flag, F.col("_no").isNotNull()).withColumn(group, F.concat("lexeme_id", F.lit(f":{letter}"), F.col("_no").cast("string"))).drop("_no")
    return out.drop("_rank")
