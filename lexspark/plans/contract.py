"""The contract of the canonical tables: columns, types, keys, values. A table that breaks it raises SchemaViolation.

Checks are one aggregate over a table and one over its key; keys of bad rows are looked up only where there are any.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features, text
from lexspark.operators import quality
from lexspark.operators.quality import SchemaViolation

VERSION = "1"

#: Columns by table: name, type (with ! if it is never NULL), description.
COLUMNS = {
    "roots": """
root_id string! stable id: a prefix and digits of a digest of the normalised root
root_raw string! the root as a source first states it
root_normalized string! radicals in a row, finals as regular letters, shin with its dot if that is settled
root_orthographic string! the same without dots
orthographic_root_group_id string! shared by roots that look alike without points
radical_1 string! first radical without dots
radical_2 string! second radical
radical_3 string! third radical
radical_4 string fourth radical
radical_5 string fifth radical
root_length bigint! number of radicals
structural_class string! one class by a fixed order of rules
structural_signature string! a symbol for each radical
is_geminate boolean! the last two of three radicals are equal
has_weak_radical boolean! a radical that may vanish
traditional_class string labels that entries state, never inferred
traditional_class_raw string these as the sources write them
n_lexemes bigint! lexemes of the root
binyanim string! their classes
source_ids string records that state the root
confidence double! the best of its lexemes
quality_tier string! the best of its lexemes
quality_flags array<string>! names of checks""",
    "lexemes": """
lexeme_id string! stable id
language string! language code
root_id string the root; NULL if it is missing or open
root_normalized string the root's letters
root_radicals_dotted string radicals as a source states them
shin_sin_resolution string where the dot of a shin comes from
root_homonym_index string number among homonymous roots
binyan string the class; NULL if it is missing or open
binyan_raw string class labels as the sources write them
lemma_vocalized string! pointed lemma
lemma_unvocalized string full spelling of the lemma
infinitive_vocalized string pointed infinitive
infinitive_unvocalized string full spelling of the infinitive
citation_past_3ms_vocalized string pointed citation form
citation_past_3ms_unvocalized string full spelling of the citation form
gloss_en string English glosses of the agreeing entries
sense_id string headings of homonyms
gizra_labels string labels of the root's class that entries state
wiktionary_registers string register tags
modern_hebrew boolean whether it is known to be modern
attested boolean! whether a source has it
has_unimorph_paradigm boolean! whether it has lines of a paradigm
source_primary string! the source it was first found in
source_ids string! records and paradigms behind it
match_status string! how root and class were settled
match_method string methods whose evidence agrees
match_score double! noisy-or of agreeing records
match_evidence string all evidence as JSON
match_ambiguous boolean! whether several roots or classes are claimed
binyan_shape_heuristic string the class that the forms suggest, for checks only
binyan_shape_rule string the rule that says so
voc_unvoc_pairing_status string how the pointed paradigm was paired
pairing_score double share of cells that agree
n_cells bigint! cells of the paradigm
past_expected_cells bigint! past cells that there can be
past_observed_cells bigint! past cells with a pointed form
past_completeness double! their share
past_complete boolean! whether it is all
confidence_root double! noisy-or for the root
confidence_binyan double! noisy-or for the class
confidence_lexeme double! the lesser of both, less if unpaired
quality_tier string! tier
quality_flags array<string> names of checks""",
    "forms": """
form_id string! the lexeme's id and the cell
lexeme_id string! the lexeme
root_id string its root
binyan string its class
canonical_cell string! name of the cell
form_vocalized string pointed form
form_unvocalized string full spelling, from a source
form_stripped string pointed form without points
form_vocalized_variants string other pointed forms
form_unvocalized_variants string other spellings
pos string part of speech
finiteness string finite or not
tense string tense
mood string mood
person string person
number string number
gender string gender
plene_consistent boolean whether both spellings agree
wiktionary_corroborated boolean whether a table has the same form
is_syncretic boolean! whether another cell has the pointed form
syncretism_group string number of such a group
is_syncretic_unvocalized boolean! whether another cell has the spelling
syncretism_group_unvocalized string number of such a group
source_primary string! the source it was first found in
source_ids string! lines or records behind it
confidence double! the lexeme's, less for a failed check
quality_tier string! tier, never better than the lexeme's
quality_flags array<string> names of checks""",
    "provenance": """
provenance_id string! running id
canonical_record_id string! root, lexeme or form
record_type string! which of these
field_supported string! what the source record supports
source_name string! the source
source_url string! address at the pinned version
source_file string file within the source
source_version_or_commit string! the version
source_record_identifier string! the record
source_line_if_available bigint line number from 1
retrieval_date string! when the source was fetched
parser_version string! what read it
raw_source_value string! the text as it is there""",
    "validation": """
check_id string! running id
record_id string! the record
record_type string! its kind
check_name string! the check
severity string! ERROR, WARNING or INFO
details string what it found""",
}
KEYS = {"roots": "root_id", "lexemes": "lexeme_id", "forms": "form_id", "provenance": "provenance_id", "validation": "check_id"}
VALUES = {
    ("lexemes", "binyan"): features.CLASSES, ("forms", "binyan"): features.CLASSES, ("forms", "tense"): ["PST", "PRS", "FUT", "NA"], ("forms", "mood"): ["IND", "IMP", "NA"], ("forms", "person"): ["1", "2", "3", "NA"],
    ("forms", "number"): ["SG", "PL", "NA"], ("forms", "gender"): ["MASC", "FEM", "NA"], ("provenance", "record_type"): ["root", "lexeme", "form"], ("validation", "severity"): ["ERROR", "WARNING", "INFO"],
} | {(t, "quality_tier"): quality.TIERS for t in ("roots", "lexemes", "forms")}


def columns(table: str) -> list[tuple[str, str, bool, str]]:
    """(name, type, nullable, description) of a table's columns."""
    rows = (line.split(" ", 2) for line in COLUMNS[table].strip().split("\n"))
    return [(name, kind.rstrip("!"), not kind.endswith("!"), about) for name, kind, about in rows]


def declared(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in their order and types; raises if one is lacking."""
    lacking = [name for name, *_ in columns(table) if name not in df.columns]
    if lacking:
        raise SchemaViolation(f"{table} lacks {', '.join(lacking)}")
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind, *_ in columns(table)])


def rules(table: str, relaxed: tuple[str, ...] = ()) -> list[tuple[str, str, object]]:
    """(column, violation, condition that holds for bad rows); * for any string column."""
    out = [(name, "is null", F.col(name).isNull()) for name, _, nullable, _ in columns(table) if not nullable]
    out += [(c, f"is not one of {', '.join(values)}", ~F.col(c).isin(*values)) for (t, c), values in VALUES.items() if t == table and c not in relaxed]
    raw = lambda name: name.endswith("_raw") or name == "raw_source_value"
    # Strings with a line break between them are NFC if each of them is, so one check does for all.
    strings = F.concat_ws("\n", *[name for name, kind, *_ in columns(table) if kind == "string" and not raw(name)])
    return [*out, ("*", "is not NFC", ~text.is_nfc(strings))]


def violations(df: DataFrame, table: str, relaxed: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, column_name, violation, n): rules that a table breaks; none if it keeps all."""
    df, checks = declared(df, table), rules(table, relaxed)
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("violation"), F.col(f"c{i}").alias("n")) for i, (c, v, _) in enumerate(checks)])
    found = counts.select(F.explode(rows).alias("r")).select("r.*")
    twice = df.groupBy(KEYS[table]).agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(twice.select(F.lit(KEYS[table]).alias("column_name"), F.lit("is not unique").alias("violation"), "n"))
    return found.where("n > 0").select(F.lit(table).alias("table_name"), "column_name", "violation", "n")


def enforce(df: DataFrame, table: str, relaxed: tuple[str, ...] = ()) -> DataFrame:
    """The table with its declared columns; raises SchemaViolation with up to five keys of the first rule that is broken."""
    found = violations(df, table, relaxed).orderBy("column_name", "violation").collect()
    if found:
        first, key = found[0], KEYS[table]
        bad = [c for name, v, c in rules(table, relaxed) if (name, v) == (first["column_name"], first["violation"])]
        rows = declared(df, table)
        rows = rows.where(bad[0]).select(key) if bad else rows.groupBy(key).count().where("count > 1").select(key)
        keys = [str(r[0]) for r in rows.orderBy(key).limit(5).collect()]
        raise SchemaViolation(f"{table}: " + "; ".join(f"{r['column_name']} {r['violation']} ({r['n']})" for r in found) + f"; first keys {', '.join(keys)}")
    return declared(df, table)


def key_violations(roots: DataFrame, lexemes: DataFrame, forms: DataFrame, provenance: DataFrame) -> DataFrame:
    """(violation, key): foreign keys without a parent, records without provenance, provenance of no record."""
    ids = reduce(DataFrame.unionByName, [df.select(F.col(k).alias("key")) for df, k in ((roots, "root_id"), (lexemes, "lexeme_id"), (forms, "form_id"))])
    told = provenance.select(F.col("canonical_record_id").alias("key")).distinct()
    of = lambda df, c: df.select(F.col(c).alias("key")).where("key is not null").distinct()
    differ = forms.select("form_id", "lexeme_id", F.col("root_id").alias("r")).join(lexemes.select("lexeme_id", "root_id"), "lexeme_id").where("not (r <=> root_id)")
    parts = {
        "lexeme's root is not there": of(lexemes, "root_id").join(of(roots, "root_id"), "key", "left_anti"), "form's lexeme is not there": of(forms, "lexeme_id").join(of(lexemes, "lexeme_id"), "key", "left_anti"),
        "form's root is not its lexeme's": differ.select(F.col("form_id").alias("key")), "record without provenance": ids.join(told, "key", "left_anti"), "provenance of no record": told.join(ids, "key", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("violation"), "key") for name, df in parts.items()])


def foreign_keys(roots: DataFrame, lexemes: DataFrame, forms: DataFrame, provenance: DataFrame) -> None:
    """Raises SchemaViolation with up to five keys."""
    found = key_violations(roots, lexemes, forms, provenance).limit(5).collect()
    if found:
        raise SchemaViolation("; ".join(f"{r['violation']}: {r['key']}" for r in found))


def schema_json() -> str:
    """The contract as a JSON document."""
    tables = {t: {"primary_key": KEYS[t], "columns": [dict(zip(("name", "type", "nullable", "description"), c)) for c in columns(t)]} for t in COLUMNS}
    return json.dumps({"version": VERSION, "tables": tables, "values": {f"{t}.{c}": v for (t, c), v in VALUES.items()}}, ensure_ascii=False, indent=1)
