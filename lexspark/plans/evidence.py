"""Evidence for a lexeme's root and class, and what other tables say about its forms.

Evidence is one long table (lexeme_id, method, kind, weight, record_id, matched, root, root_bare, binyan, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import roots, text
from lexspark.operators import joins, resolve

#: method -> (kind, weight) (fixed values).
METHODS = {
    "entry_headword_exact": ("entry", 0.8), "entry_headword_loose": ("entry", 0.6), "entry_headword_alternate": ("entry", 0.5),
    "conj_table_past_exact": ("conj_table", 0.8), "conj_table_past_loose": ("conj_table", 0.6), "conj_table_infinitive_exact": ("conj_table", 0.7),
    "full_table_past_exact": ("full_table", 0.8), "entry_ktiv_male_unvocalized": ("entry", 0.3),
}
WEAK = ["entry_ktiv_male_unvocalized"]
LOOSE = ["entry_headword_loose", "conj_table_past_loose"]
EXACT = ["entry_headword_exact", "entry_headword_alternate", "conj_table_past_exact", "full_table_past_exact"]


def entry_id() -> Column:
    return F.concat(F.lit("wikt:entry:p"), "page_id", F.lit(":r"), "rev_id", F.lit(":o"), "section_offset", F.lit(":t"), "template_index")


def table_id() -> Column:
    return F.concat(F.lit("wikt:conj:p"), "page_id", F.lit(":r"), "rev_id", F.lit(":t"), "table_index", F.lit(":"), "binyan_raw", F.lit(" "), "slot_raw")


def full_id() -> Column:
    return F.concat(F.lit("wikt:full:p"), "page_id", F.lit(":r"), "rev_id", F.lit(":t"), "table_index", F.lit(":"), "param")


def records(entries: DataFrame, tables: DataFrame, full: DataFrame) -> DataFrame:
    """Records of all three kinds with an id and what they state; entries' class labels are normalised by the caller (binyan)."""
    parts = [df.select(i.alias("record_id"), F.col("root_radicals").alias("root"), roots.bare_key(F.col("root_radicals")).alias("root_bare"), "binyan", "page_title", "page_id", "rev_id") for df, i in ((entries, entry_id()), (tables, table_id()), (full, full_id()))]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["record_id"])


def gather(lexemes: DataFrame, entries: DataFrame, tables: DataFrame, full: DataFrame) -> DataFrame:
    """Evidence by every method; a record hit exactly is not counted as a loose hit too.

    lexemes: lexeme_id, lemma, past, infinitive, plain_lemma. Each method is an equi-join on a probe string.
    """
    cites = lexemes.select("lexeme_id", F.explode(F.array_distinct(F.array_compact(F.array("lemma", "past")))).alias("s"))
    loose = cites.withColumn("k", text.loose_key(F.col("s")))
    words = lambda df, c: df.select("*", F.explode(F.split(c, r"\|")).alias("w")).where("w != ''")
    past, nfin = words(tables.where("cell = 'PST.3MSG'"), "forms"), words(tables.where("cell = 'NFIN'"), "forms")

    def hit(probe, key, df, column, rid):
        return probe.join(df.select(column.alias("_k"), rid.alias("record_id")), F.col(key) == F.col("_k")).select("lexeme_id", "record_id")

    probes = {
        "entry_headword_exact": hit(cites, "s", entries, F.col("headword"), entry_id()),
        "entry_headword_alternate": hit(cites, "s", words(entries, "headword_alternates"), F.col("w"), entry_id()),
        "conj_table_past_exact": hit(cites, "s", past, F.col("w"), table_id()),
        "full_table_past_exact": hit(cites, "s", words(full.where("cell = 'PST.3MSG'"), "forms"), F.col("w"), full_id()),
        "entry_headword_loose": hit(loose, "k", entries, text.loose_key(F.col("headword")), entry_id()),
        "conj_table_past_loose": hit(loose, "k", past, text.loose_key(F.col("w")), table_id()),
        "conj_table_infinitive_exact": hit(lexemes.where("infinitive is not null"), "infinitive", nfin, F.col("w"), table_id()),
        "entry_ktiv_male_unvocalized": hit(lexemes.where("plain_lemma is not null"), "plain_lemma", entries, F.col("ktiv_male"), entry_id()),
    }
    found = joins.multi_probe(probes, "lexeme_id", "record_id", EXACT, LOOSE)
    table = F.create_map(*[x for m, (k, w) in METHODS.items() for x in (F.lit(m), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight")))])
    found = found.withColumn("m", table[F.col("method")]).select("lexeme_id", "record_id", "method", "m.kind", "m.weight")
    return found.join(records(entries, tables, full), "record_id")


def decisions(evidence: DataFrame) -> DataFrame:
    return resolve.decide(evidence, "lexeme_id", WEAK)


def evidence_json(evidence: DataFrame) -> DataFrame:
    """(lexeme_id, match_evidence): all evidence of a lexeme as sorted JSON without empty fields."""
    return evidence.groupBy("lexeme_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("method", "record_id", "kind", "weight", "root", "binyan", "page_title", "page_id", "rev_id")))).alias("match_evidence"))


def asserted_absent(tables: DataFrame) -> DataFrame:
    """(root_bare, binyan) marked as non-existent by a table while none gives a real past form."""
    past = tables.where("cell = 'PST.3MSG'").withColumn("root_bare", roots.bare_key(F.col("root_radicals")))
    return joins.absent(past.where(F.col("flags").contains("TABLE_ASSERTS_ABSENT")), past.where("forms is not null"), ["root_bare", "binyan"])


def ortho_key(c: Column) -> Column:
    """Loose key without full or defective spelling of o and u."""
    return F.regexp_replace(text.loose_key(c), "ו[ֹּ]|[ֹֻ]", "")


def corroborating_cells(lexemes: DataFrame, tables: DataFrame, full: DataFrame) -> DataFrame:
    """(lexeme_id, cell, form, record_id): cells of tables of the lexeme's root and class whose past form is its lemma."""
    one = lambda df, kind, rid: df.select(F.lit(kind).alias("kind"), "page_id", "table_index", roots.bare_key(F.col("root_radicals")).alias("root_bare"), "binyan", "cell", rid.alias("record_id"), F.explode(F.split("forms", r"\|")).alias("form"))
    rows = one(tables, "conj", table_id()).unionByName(one(full, "full", full_id())).withColumn("loose", text.loose_key(F.col("form")))
    want = lexemes.select("lexeme_id", "root_bare", "binyan", text.loose_key(F.col("lemma")).alias("loose"))
    group = ["kind", "page_id", "table_index", "root_bare", "binyan"]
    fits = rows.where("cell = 'PST.3MSG'").join(want, ["root_bare", "binyan", "loose"]).select("lexeme_id", *group).distinct()
    return rows.join(fits, group).select("lexeme_id", "cell", "form", "loose", "record_id").distinct()


def corroborate(forms: DataFrame, cells: DataFrame) -> DataFrame:
    """forms(lexeme_id, cell, form) with corroborated (three-valued) and a flag: equal, a spelling variant, or a mismatch."""
    f = forms.select("lexeme_id", "cell", "form", text.loose_key(F.col("form")).alias("_l"), ortho_key(F.col("form")).alias("_o"))
    c = cells.select("lexeme_id", "cell", F.col("form").alias("_f"), "loose", ortho_key(F.col("form")).alias("ortho"))
    level = f.join(c, ["lexeme_id", "cell"]).groupBy("lexeme_id", "cell").agg(F.bool_or((F.col("form") == F.col("_f")) | (F.col("_l") == F.col("loose"))).alias("equal"), F.bool_or(F.col("_o") == F.col("ortho")).alias("variant"))
    out = forms.join(level, ["lexeme_id", "cell"], "left")
    there = F.col("form").isNotNull() & F.col("equal").isNotNull()
    flag = F.when(F.col("equal"), "WIKT_CORROBORATED").when(F.col("variant"), "WIKT_ORTHOGRAPHIC_VARIANT").otherwise("WIKT_FORM_MISMATCH")
    return out.withColumns({"corroborated": F.when(there, F.col("equal") | F.col("variant")), "corroboration_flag": F.when(there, flag)}).drop("equal", "variant")
