"""Registered queries of the pair views, splits, decisions and their reports, each through the library's functions.

Canonical tables are stood in for by the fixture tables: an order is a lexeme, a customer a root, and an order's lines
are the cells of its paradigm (the smallest part and supplier of a line number give its two forms).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features, text
from lexspark.operators import ordered, quality, resolve
from lexspark.plans import canonical, contract, encoding, evidence, runner, splits, views, weak_roots
from lexspark.plans.catalogue import query

CELLS = ", ".join(f"'{c}'" for c in features.PAST_CELLS)
TIERS = ["GOLD", "SILVER", "QUESTIONABLE"]

#: The three tables in SQL.
TABLES = f"""
roots AS (SELECT 'R' || c_custkey AS root_id, c_name AS root_normalized, c_mktsegment AS root_orthographic, 'G' || (c_custkey // 3) AS grp, 3::BIGINT AS root_length, c_mktsegment AS structural_class,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'PE_NUN' ELSE 'PE_NUN+SHLEMIM' END AS traditional_class, c_custkey // 3 % 4 = 0 AS sc_rich FROM customer),
lexemes AS (SELECT 'L' || o_orderkey AS lexeme_id, 'R' || o_custkey AS root_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS binyan, CASE o_orderkey % 7 WHEN 0 THEN 'QUESTIONABLE' WHEN 1 THEN 'SILVER' ELSE 'GOLD' END AS lt FROM orders),
forms AS (SELECT 'L' || l_orderkey AS lexeme_id, list_extract([{CELLS}], l_linenumber) AS cell, l_linenumber AS n, min(l_partkey)::VARCHAR AS voc, CASE WHEN min(l_suppkey) % 9 = 0 THEN NULL ELSE (min(l_suppkey) % 50)::VARCHAR END AS unv,
    CASE WHEN min(l_quantity) < 3 THEN 'QUESTIONABLE' ELSE 'GOLD' END AS tier FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

#: The citation view: the fourth cell is the source.
VIEW = f"""{TABLES},
past AS (SELECT lexeme_id, cell, n, tier, 'voc' AS condition, voc AS form FROM forms UNION ALL SELECT lexeme_id, cell, n, tier, 'unv', unv FROM forms WHERE unv IS NOT NULL),
pairs AS (SELECT s.condition, s.lexeme_id, s.cell AS source_cell, t.cell AS target_cell, t.n AS target_no, s.form AS source_form, t.form AS target_form, s.tier AS st, t.tier AS tt, s.lexeme_id || ':' || s.cell || '>' || t.cell AS pair_id
    FROM past s JOIN past t ON s.lexeme_id = t.lexeme_id AND s.condition = t.condition AND s.cell <> t.cell WHERE {{source}}),
v AS (SELECT p.*, l.root_id, l.binyan, r.grp, r.structural_class, r.traditional_class, coalesce(r.sc_rich, false) AS sc_rich, CASE WHEN l.root_id IS NOT NULL AND l.binyan IS NOT NULL THEN l.root_id || '|' || l.binyan END AS rkey,
    CASE WHEN lt = 'QUESTIONABLE' OR st = 'QUESTIONABLE' OR tt = 'QUESTIONABLE' THEN 'QUESTIONABLE' WHEN lt = 'SILVER' OR st = 'SILVER' OR tt = 'SILVER' THEN 'SILVER' ELSE 'GOLD' END AS worst
    FROM pairs p LEFT JOIN lexemes l USING (lexeme_id) LEFT JOIN roots r USING (root_id)),
eligible AS (SELECT * FROM v WHERE condition = 'voc' AND worst <> 'QUESTIONABLE' AND root_id IS NOT NULL AND binyan IS NOT NULL)"""
CITATION = VIEW.format(source="s.n = 4")


def frames(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, lexemes, forms) as the views take them."""
    c = t("customer")
    traditional = F.when(F.col("c_custkey") % 4 == 1, "PE_NUN").when(F.col("c_custkey") % 4 > 1, "PE_NUN+SHLEMIM")
    roots = c.select(
        F.concat(F.lit("R"), "c_custkey").alias("root_id"), F.col("c_name").alias("root_normalized"), F.col("c_mktsegment").alias("root_orthographic"),
        F.concat(F.lit("G"), F.floor(F.col("c_custkey") / 3)).alias("orthographic_root_group_id"), F.lit(3).cast("long").alias("root_length"), F.col("c_mktsegment").alias("structural_class"),
        F.lit("C.C.C").alias("structural_signature"), traditional.alias("traditional_class"), F.lit(False).alias("has_weak_radical"), F.lit(False).alias("is_geminate"), (F.floor(F.col("c_custkey") / 3) % 4 == 0).alias("sc_rich"),
    )
    o = t("orders")
    seventh = F.col("o_orderkey") % 7
    lexemes = o.select(
        F.concat(F.lit("L"), "o_orderkey").alias("lexeme_id"), F.concat(F.lit("R"), "o_custkey").alias("root_id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("binyan"),
        F.col("o_orderstatus").alias("lemma_vocalized"), F.when(seventh == 0, "QUESTIONABLE").when(seventh == 1, "SILVER").otherwise("GOLD").alias("quality_tier"), F.lit("orders").alias("source_primary"),
    )
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"), F.min("l_quantity").alias("quantity"))
    cell = F.get(F.array(*map(F.lit, features.PAST_CELLS)), F.col("l_linenumber") - 1)
    forms = lines.select(
        F.concat(F.lit("L"), "l_orderkey").alias("lexeme_id"), cell.alias("canonical_cell"), F.concat(F.lit("L"), "l_orderkey", F.lit("."), cell).alias("form_id"),
        F.col("part").cast("string").alias("form_vocalized"), F.when(F.col("supplier") % 9 != 0, (F.col("supplier") % 50).cast("string")).alias("form_unvocalized"),
        F.when(F.col("quantity") < 3, "QUESTIONABLE").otherwise("GOLD").alias("quality_tier"), F.lit("lineitem").alias("source_ids"),
    )
    return roots, lexemes, canonical.syncretism(forms)


def citation(t) -> DataFrame:
    return views.past_reinflection(*frames(t))


def eligible(t) -> DataFrame:
    return splits.eligible_pairs(citation(t))


def _ranked(group: str, name: str, seed: int, source: str = "eligible") -> str:
    """CTE `part`: groups dealt 80, 10, 10 in the order of their hash."""
    return f"""g AS (SELECT DISTINCT {group} AS g FROM {source} WHERE {group} IS NOT NULL),
ranked AS (SELECT g, row_number() OVER (ORDER BY md5('{name}|{seed}|' || g), g) - 1 AS k, count(*) OVER () AS n FROM g),
part AS (SELECT g, CASE WHEN k < round_even(0.8 * n, 0) THEN 'train' WHEN k < n - round_even(0.1 * n, 0) THEN 'dev' ELSE 'test' END AS partition FROM ranked)"""


_FEATURES = "replace(split_part(target_cell, '.', 1) || ',' || substr(split_part(target_cell, '.', 2), 1, 1) || ',' || right(target_cell, 2) || CASE WHEN target_cell LIKE '%M_G' OR target_cell LIKE '%MSG' OR target_cell LIKE '%MPL' THEN ',MASC' WHEN target_cell LIKE '%FSG' OR target_cell LIKE '%FPL' THEN ',FEM' ELSE '' END, ',,', ',')"
_PAIRS = """ SELECT '{tag}:' || condition || ':' || pair_id AS example_id, condition, source_cell, target_cell, source_form, target_form, {features} AS target_features, worst AS tier, worst <> 'QUESTIONABLE' AND root_id IS NOT NULL AND binyan IS NOT NULL AS eligible,
    rkey, structural_class, source_form = target_form AS same, length(target_form)::BIGINT AS size FROM v"""


def _pair_columns(view: DataFrame) -> DataFrame:
    a = views.A
    return view.select(
        "example_id", "condition", "source_cell", "target_cell", "source_form", "target_form", "target_features", F.col(a + "example_quality_tier").alias("tier"), F.col(a + "eligible_default").alias("eligible"),
        F.col(a + "root_binyan_key").alias("rkey"), F.col(a + "structural_class").alias("structural_class"), F.col(a + "source_equals_target").alias("same"), F.col(a + "target_form_length").alias("size"),
    )


@query("WITH " + CITATION + _PAIRS.format(tag="PR", features=_FEATURES))
def view_citation(t) -> DataFrame:
    """Pairs from the citation cell to every other, with worst tier and eligibility."""
    return _pair_columns(citation(t))


@query("WITH " + VIEW.format(source="true") + _PAIRS.format(tag="FP", features=_FEATURES))
def view_full_paradigm(t) -> DataFrame:
    """All ordered pairs of different cells of a paradigm."""
    return _pair_columns(views.full_paradigm(*frames(t)))


@query(f"""WITH {TABLES}, past AS (SELECT lexeme_id, cell, n, 'voc' AS condition, voc AS form FROM forms UNION ALL SELECT lexeme_id, cell, n, 'unv', unv FROM forms WHERE unv IS NOT NULL)
SELECT lexeme_id, cell AS canonical_cell, condition, form, count(*) OVER (PARTITION BY lexeme_id, condition, form) > 1 AS syncretic FROM past""")
def condition_unpivot(t) -> DataFrame:
    """Past forms as (condition, form) rows, with the flag of cells that share a form."""
    return views.conditions(frames(t)[2]).select("lexeme_id", "canonical_cell", "condition", "form", "syncretic")


@query(f"""WITH {TABLES}, c AS (SELECT *, count(*) OVER (PARTITION BY lexeme_id, voc) AS kv, CASE WHEN unv IS NOT NULL THEN count(*) OVER (PARTITION BY lexeme_id, unv) ELSE 0 END AS ku,
    min(n) OVER (PARTITION BY lexeme_id, voc) AS fv, min(n) OVER (PARTITION BY lexeme_id, unv) AS fu FROM forms)
SELECT lexeme_id, cell AS canonical_cell, kv > 1 AS is_syncretic, CASE WHEN kv > 1 THEN lexeme_id || ':V' || dense_rank() OVER (PARTITION BY lexeme_id, kv > 1 ORDER BY fv) END AS syncretism_group,
    ku > 1 AS is_syncretic_unvocalized, CASE WHEN ku > 1 THEN lexeme_id || ':U' || dense_rank() OVER (PARTITION BY lexeme_id, ku > 1 ORDER BY fu) END AS syncretism_group_unvocalized FROM c""")
def syncretism_groups(t) -> DataFrame:
    """Cells of a paradigm that share a form, numbered by their first cell, for both kinds of form."""
    return frames(t)[2].select("lexeme_id", "canonical_cell", "is_syncretic", "syncretism_group", "is_syncretic_unvocalized", "syncretism_group_unvocalized")


@query("WITH " + CITATION + " SELECT pair_id, coalesce(list_contains(string_split(traditional_class, '+'), 'PE_NUN'), false) AS nun, coalesce(list_contains(string_split(traditional_class, '+'), 'SHLEMIM'), false) AS whole FROM v WHERE condition = 'voc'")
def traditional_membership(t) -> DataFrame:
    """A boolean for each label of a joined label list."""
    v = views.traditional_flags(citation(t).where("condition = 'voc'"), ["PE_NUN", "SHLEMIM"])
    return v.select("pair_id", F.col(views.A + "trad_PE_NUN").alias("nun"), F.col(views.A + "trad_SHLEMIM").alias("whole"))


@query("WITH " + CITATION + ", " + _ranked("pair_id", "iid", 0) + " SELECT g AS pair_id, partition FROM part")
def view_iid(t) -> DataFrame:
    return splits.iid(eligible(t), 0)


@query("WITH " + CITATION + ", " + _ranked("rkey", "lexeme", 0) + " SELECT pair_id, partition FROM eligible JOIN part ON rkey = g")
def view_lexeme_holdout(t) -> DataFrame:
    return splits.lexeme_holdout(eligible(t), 0)


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + " SELECT pair_id, partition FROM eligible JOIN part ON grp = g")
def view_root_holdout(t) -> DataFrame:
    return splits.root_holdout(eligible(t), 0)


@query("WITH " + CITATION + """, g AS (SELECT grp AS g, bool_or(sc_rich) AS t FROM eligible GROUP BY grp),
r AS (SELECT g, row_number() OVER (ORDER BY md5('ood_rich|0|' || g), g) - 1 AS k, count(*) OVER () AS n FROM g WHERE NOT t),
a AS (SELECT g, CASE WHEN t THEN 'test' WHEN k < round_even(0.9 * n, 0) THEN 'train' ELSE 'dev' END AS partition FROM g LEFT JOIN r USING (g))
SELECT pair_id, partition FROM eligible JOIN a ON grp = g""")
def view_class_ood(t) -> DataFrame:
    """Root groups with the property on any pair are test as a whole."""
    return splits.class_ood(eligible(t), views.A + "sc_rich", "rich", 0)


_OTHERS = ", ".join(f"'{c}'" for c in features.PAST_CELLS if c != features.CITATION_CELL)
_CELL_K = f"""full_ AS (SELECT lexeme_id AS x FROM eligible GROUP BY lexeme_id HAVING count(*) = 5),
shown AS (SELECT x, 'PST.3MSG' AS c FROM full_ UNION ALL SELECT x, c FROM (SELECT x, c, row_number() OVER (PARTITION BY x ORDER BY md5('cell_k4|0|' || x || '|' || c)) AS k FROM full_, (SELECT unnest([{_OTHERS}]) AS c)) WHERE k <= 3),
side AS (SELECT x, CASE WHEN row_number() OVER (ORDER BY md5('cell_k4_devtest|0|' || x), x) - 1 < (SELECT count(*) FROM full_) - round_even(0.9 * (SELECT count(*) FROM full_), 0) THEN 'dev' ELSE 'test' END AS p FROM full_),
assigned AS (SELECT pair_id, lexeme_id, CASE WHEN (lexeme_id, source_cell) NOT IN (SELECT (x, c) FROM shown) THEN 'excluded' WHEN (lexeme_id, target_cell) IN (SELECT (x, c) FROM shown) THEN 'train' ELSE p END AS partition FROM eligible JOIN side ON x = lexeme_id)"""


def _cell_k(t):
    pairs = eligible(t)
    return splits.cell_k(pairs, 4, 0, 5)


@query("WITH " + CITATION + ", " + _CELL_K + " SELECT pair_id, partition FROM assigned")
def view_cell_k(t) -> DataFrame:
    """Lexemes with five eligible pairs show four of nine cells; pairs of a hidden target are dev or test."""
    return _cell_k(t)[0]


@query("WITH " + CITATION + ", " + _CELL_K + """ , f AS (SELECT DISTINCT condition, lexeme_id, target_cell AS cell, target_form AS form FROM v UNION SELECT DISTINCT condition, lexeme_id, source_cell, source_form FROM v),
s AS (SELECT DISTINCT condition, lexeme_id, form FROM f WHERE (lexeme_id, cell) IN (SELECT (x, c) FROM shown))
SELECT partition, v.condition, count(*)::BIGINT AS n FROM assigned a JOIN v USING (pair_id) JOIN s ON s.condition = v.condition AND s.lexeme_id = v.lexeme_id AND s.form = v.target_form WHERE partition IN ('dev', 'test') GROUP BY ALL""")
def view_copy_leaks(t) -> DataFrame:
    """Evaluation targets that equal the form of a shown cell."""
    assignment, exposed = _cell_k(t)
    return splits.copy_leaks(assignment, exposed, citation(t))


def _mutated(t) -> DataFrame:
    """A holdout by root of which pairs to the first cell are all test."""
    out = splits.root_holdout(eligible(t), 0)
    return out.withColumn("partition", F.when(F.col("pair_id").endswith("PST.1SG"), "test").otherwise(F.col("partition")))


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + """, a AS (SELECT pair_id, grp, root_id, CASE WHEN pair_id LIKE '%PST.1SG' THEN 'test' ELSE partition END AS p FROM eligible JOIN part ON grp = g),
kinds(c) AS (VALUES ('grp'), ('root')), keyed AS (SELECT 'analysis__orthographic_root_group_id' AS c, grp AS key, p FROM a UNION SELECT 'analysis__root_id', root_id, p FROM a)
SELECT violation, key FROM (
    SELECT DISTINCT x.c || ' shared by train and ' || y.p AS violation, x.key FROM keyed x JOIN keyed y ON x.c = y.c AND x.key = y.key AND x.p = 'train' AND y.p IN ('dev', 'test')
    UNION ALL SELECT DISTINCT 'root group shared by dev and test', x.key FROM keyed x JOIN keyed y ON x.c = y.c AND x.key = y.key AND x.p = 'dev' AND y.p = 'test' WHERE x.c LIKE '%group_id')""")
def view_violations(t) -> DataFrame:
    """What the verifier finds in an assignment that was tampered with."""
    return splits.violations("root_holdout", _mutated(t), citation(t))


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + """, a AS (SELECT pair_id, partition FROM eligible JOIN part ON grp = g), r AS (SELECT a.partition, v.* FROM a JOIN v USING (pair_id))
SELECT partition, count_if(condition = 'voc')::BIGINT AS examples_voc, count_if(condition = 'unv' AND worst <> 'QUESTIONABLE' AND root_id IS NOT NULL AND binyan IS NOT NULL)::BIGINT AS examples_unv, count(DISTINCT pair_id)::BIGINT AS pair_ids,
    count(DISTINCT CASE WHEN condition = 'voc' THEN lexeme_id || '.' || target_cell END)::BIGINT AS forms, count(DISTINCT CASE WHEN condition = 'voc' THEN lexeme_id END)::BIGINT AS lexemes, count(DISTINCT CASE WHEN condition = 'voc' THEN root_id END)::BIGINT AS roots,
    count(DISTINCT CASE WHEN condition = 'voc' THEN grp END)::BIGINT AS orthographic_root_groups, count(DISTINCT CASE WHEN condition = 'voc' THEN rkey END)::BIGINT AS root_binyan_pairs, round(avg(CASE WHEN condition = 'voc' THEN length(target_form) END), 3) AS target_length_mean
FROM r GROUP BY partition""")
def view_split_stats(t) -> DataFrame:
    """Counts of each partition at every level."""
    v = citation(t)
    return splits.stats(splits.root_holdout(splits.eligible_pairs(v), 0), v).drop("syncretic_fraction")


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + """, c AS (SELECT partition, root_id, count(*) AS n FROM eligible JOIN part ON grp = g GROUP BY ALL)
SELECT partition, round(avg(n), 3) AS examples_per_root_mean, max(n)::BIGINT AS examples_per_root_max FROM c GROUP BY partition""")
def view_per_root(t) -> DataFrame:
    v = citation(t)
    return splits.per_root(splits.root_holdout(splits.eligible_pairs(v), 0), v)


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + f" SELECT v.source_form, {_FEATURES.replace('target_cell', 'v.target_cell')} AS target_features, v.target_form FROM v JOIN eligible e USING (pair_id) JOIN part ON e.grp = g WHERE v.condition = 'unv' AND partition = 'dev'")
def view_loader(t) -> DataFrame:
    """What a model may see of a partition: three columns."""
    v = citation(t)
    return views.load(v, splits.root_holdout(splits.eligible_pairs(v), 0), "dev", "unv")


@query("WITH " + CITATION + ", " + _ranked("grp", "root", 0) + " SELECT v.pair_id, v.root_id, v.worst AS tier FROM v JOIN eligible e USING (pair_id) JOIN part ON e.grp = g WHERE v.condition = 'unv' AND partition = 'dev'")
def view_analysis_loader(t) -> DataFrame:
    v = citation(t)
    out = views.load_analysis(v, splits.root_holdout(splits.eligible_pairs(v), 0), "dev", "unv")
    return out.select("pair_id", F.col(views.A + "root_id").alias("root_id"), F.col(views.A + "example_quality_tier").alias("tier"))


# ------------------------------------------------------------------ evidence

#: An order line is a claim about its part: four lines of seven are strong.
_CLAIMS = """claims AS (SELECT 'P' || l_partkey AS lexeme_id, CASE WHEN l_linenumber <= 1 THEN 'weak' ELSE 'm' || l_linenumber END AS method, 'k' || (l_linenumber % 3) AS kind, l_discount + 0.0137 AS weight, 'rec' || l_orderkey AS record_id,
    CASE WHEN l_quantity < 20 THEN NULL WHEN l_partkey % 3 = 0 THEN 'x-' || l_returnflag ELSE 'x-y' END AS root, CASE WHEN l_quantity < 20 THEN NULL WHEN l_partkey % 3 = 0 THEN 'x' || l_returnflag ELSE 'xy' END AS root_bare, CASE WHEN l_partkey % 5 = 0 THEN l_linestatus ELSE 'O' END AS binyan FROM lineitem WHERE l_linenumber <= 1 OR l_partkey % 11 <> 0)"""


def claims(t) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    third = lambda sep, other: F.when(F.col("l_quantity") >= 20, F.when(part % 3 == 0, F.concat(F.lit("x" + sep), "l_returnflag")).otherwise(other))
    return t("lineitem").where((n <= 1) | (part % 11 != 0)).select(
        F.concat(F.lit("P"), part).alias("lexeme_id"), F.when(n <= 1, "weak").otherwise(F.concat(F.lit("m"), n)).alias("method"), F.concat(F.lit("k"), n % 3).alias("kind"), (F.col("l_discount") + 0.0137).alias("weight"),
        F.concat(F.lit("rec"), "l_orderkey").alias("record_id"), third("-", "x-y").alias("root"), third("", "xy").alias("root_bare"), F.when(part % 5 == 0, F.col("l_linestatus")).otherwise("O").alias("binyan"),
    )


_DECIDE = f"""WITH {_CLAIMS}, pool AS (SELECT lexeme_id, bool_or(method <> 'weak') AS strong, min(CASE WHEN method <> 'weak' THEN root_bare END) AS sr1, max(CASE WHEN method <> 'weak' THEN root_bare END) AS sr2, min(CASE WHEN method <> 'weak' THEN binyan END) AS sb1, max(CASE WHEN method <> 'weak' THEN binyan END) AS sb2,
    min(CASE WHEN method = 'weak' THEN root_bare END) AS wr1, max(CASE WHEN method = 'weak' THEN root_bare END) AS wr2, min(CASE WHEN method = 'weak' THEN binyan END) AS wb1, max(CASE WHEN method = 'weak' THEN binyan END) AS wb2 FROM claims GROUP BY lexeme_id),
ends AS (SELECT lexeme_id, strong, CASE WHEN strong THEN sr1 ELSE wr1 END AS r1, CASE WHEN strong THEN sr2 ELSE wr2 END AS r2, CASE WHEN strong THEN sb1 ELSE wb1 END AS b1, CASE WHEN strong THEN sb2 ELSE wb2 END AS b2 FROM pool),
settled AS (SELECT *, CASE WHEN r1 = r2 AND (strong OR b1 = b2) THEN r1 END AS root_, CASE WHEN b1 = b2 AND (strong OR coalesce(r1 = r2, false)) THEN b1 END AS class_ FROM ends),
used AS (SELECT c.*, coalesce(root_bare = root_, false) AS by_root, coalesce(c.binyan = class_, false) AS by_class FROM claims c JOIN settled s USING (lexeme_id) WHERE method <> 'weak' OR NOT strong),
rec AS (SELECT lexeme_id, record_id, max(weight) AS w FROM used WHERE by_root OR by_class GROUP BY ALL),
score AS (SELECT lexeme_id, round(1 - product(1 - w), 4) AS match_score FROM rec GROUP BY ALL)
SELECT s.lexeme_id, s.root_ AS root, s.class_ AS binyan,
    CASE WHEN coalesce(r1 <> r2, false) AND coalesce(b1 <> b2, false) THEN 'ROOT_AND_BINYAN_AMBIGUOUS' WHEN r1 <> r2 THEN 'ROOT_AMBIGUOUS' WHEN b1 <> b2 THEN 'BINYAN_AMBIGUOUS' WHEN NOT strong THEN CASE WHEN root_ IS NOT NULL AND class_ IS NOT NULL THEN 'MATCHED_UNVOC_ONLY' ELSE 'NO_MATCH' END ELSE 'MATCHED' END AS status,
    round(1 - coalesce(product(CASE WHEN by_root THEN 1 - weight END), 1), 4) AS conf_root, round(1 - coalesce(product(CASE WHEN by_class THEN 1 - weight END), 1), 4) AS conf_binyan, coalesce(any_value(match_score), 0) AS match_score,
    coalesce(string_agg(DISTINCT CASE WHEN by_root THEN kind END, '|' ORDER BY CASE WHEN by_root THEN kind END), '') AS root_kinds, coalesce(string_agg(DISTINCT CASE WHEN by_root OR by_class THEN method END, '|' ORDER BY CASE WHEN by_root OR by_class THEN method END), '') AS methods
FROM settled s JOIN used u USING (lexeme_id) LEFT JOIN score USING (lexeme_id) GROUP BY s.lexeme_id, s.root_, s.class_, r1, r2, b1, b2, strong"""


@query(_DECIDE)
def decide_status(t) -> DataFrame:
    """Six statuses, values only where claims agree, and noisy-or confidences."""
    d = resolve.decide(claims(t), "lexeme_id", ["weak"])
    return d.select("lexeme_id", "root", "binyan", "status", "conf_root", "conf_binyan", "match_score", F.array_join("root_kinds", "|").alias("root_kinds"), F.array_join("methods", "|").alias("methods"))


@query(f"""WITH {TABLES}, w AS (SELECT 'L' || l_orderkey AS lexeme_id, list_extract([{CELLS}], l_linenumber) AS cell, max(l_partkey)::VARCHAR AS f FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey, l_linenumber)
SELECT lexeme_id, cell, voc AS form, CASE WHEN f IS NOT NULL THEN voc = f END AS corroborated, CASE WHEN f = voc THEN 'WIKT_CORROBORATED' WHEN f IS NOT NULL THEN 'WIKT_FORM_MISMATCH' END AS corroboration_flag FROM forms LEFT JOIN w USING (lexeme_id, cell)""")
def corroboration(t) -> DataFrame:
    """Whether another table gives the same form in a cell: yes, no, or not stated."""
    forms = frames(t)[2].select("lexeme_id", F.col("canonical_cell").alias("cell"), F.col("form_vocalized").alias("form"))
    cell = F.get(F.array(*map(F.lit, features.PAST_CELLS)), F.col("l_linenumber") - 1)
    other = t("lineitem").where("l_quantity > 25").groupBy(F.concat(F.lit("L"), "l_orderkey").alias("lexeme_id"), cell.alias("cell")).agg(F.max("l_partkey").cast("string").alias("form"))
    return evidence.corroborate(forms, other.withColumn("loose", text.loose_key(F.col("form"))))


@query(f"""WITH {TABLES}, f AS (SELECT lexeme_id, cell, CASE WHEN n % 2 = 0 THEN 'HARD' WHEN n % 3 = 0 THEN 'LESSER' END AS flag, tier FROM forms)
SELECT lexeme_id, cell, CASE WHEN lt = 'QUESTIONABLE' OR own = 'QUESTIONABLE' THEN 'QUESTIONABLE' WHEN lt = 'SILVER' OR own = 'SILVER' THEN 'SILVER' ELSE 'GOLD' END AS tier
FROM (SELECT *, CASE WHEN flag = 'HARD' OR tier = 'QUESTIONABLE' THEN 'QUESTIONABLE' WHEN flag = 'LESSER' THEN 'SILVER' ELSE 'GOLD' END AS own FROM f) JOIN lexemes USING (lexeme_id)""")
def form_tiers(t) -> DataFrame:
    """A form's tier from its flags, never better than its lexeme's."""
    _, lexemes, forms = frames(t)
    n = F.array_position(F.array(*map(F.lit, features.PAST_CELLS)), F.col("canonical_cell"))
    flags = F.array_compact(F.array(F.when(n % 2 == 0, "HARD").when(n % 3 == 0, "LESSER")))
    own = quality.tier_of(flags, ["HARD"], ["LESSER"], F.col("quality_tier") == "QUESTIONABLE")
    rows = forms.select("lexeme_id", F.col("canonical_cell").alias("cell"), own.alias("own")).join(lexemes.select("lexeme_id", F.col("quality_tier").alias("parent")), "lexeme_id")
    return rows.select("lexeme_id", "cell", quality.worst_tier(F.col("parent"), F.col("own")).alias("tier"))


@query(f"""WITH {TABLES}, s AS (SELECT lexeme_id, string_agg(cell, '|' ORDER BY n) AS cells, min(voc) AS first FROM forms GROUP BY lexeme_id, voc) SELECT lexeme_id, cells, first AS form FROM s""")
def cells_in_order(t) -> DataFrame:
    """The cells that share a form, joined in paradigm order."""
    forms = frames(t)[2]
    rank = features.cell_rank(F.col("canonical_cell"))
    return forms.groupBy("lexeme_id", F.col("form_vocalized").alias("form")).agg(ordered.ordered_join(F.col("canonical_cell"), rank).alias("cells"))


# ------------------------------------------------- contracts, encoding, runner


@query("WITH " + CITATION + """, f(flag, has) AS (SELECT 'analysis__sc_rich', sc_rich FROM eligible UNION ALL SELECT 'analysis__trad_PE_NUN', coalesce(list_contains(string_split(traditional_class, '+'), 'PE_NUN'), false) FROM eligible
    UNION ALL SELECT 'analysis__trad_PE_ALEF', false FROM eligible)
SELECT flag, count_if(has)::BIGINT AS positive, count_if(NOT has)::BIGINT AS negative, count_if(has) >= 20 AND (flag NOT LIKE '%sc_%' OR count_if(NOT has) >= 20) AS kept FROM f GROUP BY flag UNION ALL SELECT 'analysis__sc_absent', 0, 0, false""")
def split_skip_rule(t) -> DataFrame:
    """Properties with enough pairs on the sides that a split needs; others are skipped."""
    pairs = eligible(t)
    labelled = views.traditional_flags(pairs, ["PE_NUN", "PE_ALEF"])
    return runner.enough(pairs, [views.A + "sc_rich", views.A + "sc_absent"]).unionByName(runner.enough(labelled, [views.A + "trad_PE_NUN", views.A + "trad_PE_ALEF"], both=False))


_CHECKED = "SELECT 'CK' || (p_partkey // 2 * 2) AS check_id, CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS record_id, 'part' AS record_type, p_type AS check_name, CASE WHEN p_size % 5 = 0 THEN 'FATAL' ELSE 'INFO' END AS severity, p_name AS details FROM part"


@query(f"""WITH v AS ({_CHECKED}) SELECT 'validation' AS table_name, * FROM (SELECT 'record_id' AS column_name, 'is null' AS violation, count_if(record_id IS NULL)::BIGINT AS n FROM v
UNION ALL SELECT 'severity', 'is not one of ERROR, WARNING, INFO', count_if(severity = 'FATAL') FROM v UNION ALL SELECT 'check_id', 'is not unique', (SELECT count(*) FROM (SELECT check_id FROM v GROUP BY 1 HAVING count(*) > 1))) WHERE n > 0""")
def contract_violations(t) -> DataFrame:
    """Rules of a table's contract that rows break: nulls, values, keys."""
    p = t("part")
    rows = p.select(
        F.concat(F.lit("CK"), F.floor(F.col("p_partkey") / 2) * 2).alias("check_id"), F.when(F.col("p_size") != 7, F.col("p_brand")).alias("record_id"), F.lit("part").alias("record_type"), F.col("p_type").alias("check_name"),
        F.when(F.col("p_size") % 5 == 0, "FATAL").otherwise("INFO").alias("severity"), F.col("p_name").alias("details"),
    )
    return contract.violations(rows, "validation")


@query("SELECT DISTINCT 'form without lexeme' AS violation, NULL::VARCHAR AS key WHERE false UNION ALL SELECT 'record without provenance', 'L' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'provenance of no record', 'nothing' FROM region WHERE r_regionkey = 0")
def contract_keys(t) -> DataFrame:
    """Records without provenance, and provenance of no record."""
    roots, lexemes, forms = frames(t)
    spark = roots.sparkSession
    every = reduce(DataFrame.unionByName, [df.select(F.col(k).alias("canonical_record_id")) for df, k in ((roots, "root_id"), (lexemes, "lexeme_id"), (forms, "form_id"))])
    tenth = F.col("canonical_record_id").rlike("^L[0-9]*0$")
    own = forms.join(lexemes.select("lexeme_id", F.col("root_id").alias("r")), "lexeme_id", "left").withColumn("root_id", F.col("r"))
    return contract.key_violations(roots, lexemes, own, every.where(~tenth).unionByName(spark.createDataFrame([("nothing",)], "canonical_record_id string")))


_SYMBOLS = "sym AS (SELECT DISTINCT unnest(string_split(p_name, '')) AS s FROM part WHERE p_size > 3 UNION SELECT DISTINCT unnest(string_split(p_name, '')) FROM part WHERE p_size > 3 UNION SELECT DISTINCT 'F:' || unnest([p_brand, p_type]) FROM part WHERE p_size > 3), ids AS (SELECT s, row_number() OVER (ORDER BY length(s) > 1, s) + 4 AS id FROM sym WHERE s <> '')"


@query(f"""WITH {_SYMBOLS}, c AS (SELECT p_partkey, 1 AS part, generate_subscripts(string_split(p_name, ''), 1) AS i, unnest(string_split(p_name, '')) AS s FROM part UNION ALL SELECT p_partkey, 3, 1, 'F:' || p_brand FROM part UNION ALL SELECT p_partkey, 3, 2, 'F:' || p_type FROM part
    UNION ALL SELECT p_partkey, 5, generate_subscripts(string_split(reverse(p_name), ''), 1), unnest(string_split(reverse(p_name), '')) FROM part),
n AS (SELECT p_partkey, part, i, coalesce(id, 4) AS id FROM c LEFT JOIN ids USING (s) WHERE s <> '' UNION ALL SELECT p_partkey, k, 0, v FROM part, (VALUES (0, 1), (2, 2), (4, 2), (6, 3)) x(k, v))
SELECT p_partkey, string_agg(id::VARCHAR, ' ' ORDER BY part, i) AS tokens, count_if(part <= 4)::INTEGER AS prompt_length, count_if(id = 4)::INTEGER AS unknown, count_if(part > 4)::INTEGER AS predicted FROM n GROUP BY p_partkey""")
def encoded_examples(t) -> DataFrame:
    """Examples as symbol numbers by a vocabulary that part of them made, with the places to predict and unknown symbols."""
    rows = t("part").select("p_partkey", F.col("p_name").alias("source"), F.concat_ws(",", "p_brand", "p_type").alias("features"), F.reverse("p_name").alias("target"), "p_size")
    vocab = encoding.vocabulary(rows.where("p_size > 3"), ["source", "target"], "features")
    out = encoding.encode(rows, vocab, [("source", False), ("features", True)], "target", 80)
    seen = F.array_join(F.transform(F.filter("tokens", lambda x: x != encoding.PAD), lambda x: x.cast("string")), " ")
    return out.select("p_partkey", seen.alias("tokens"), "prompt_length", "unknown", F.size(F.filter("loss_mask", lambda x: x)).alias("predicted"))


_WEAK = [
    ("נצל", "PE_NUN", "HIFIL", "PST.3MSG", "הִצִּיל"), ("ירד", "PE_YOD", "HIFIL", "PST.3MSG", "הוֹרִיד"), ("ירד", "PE_YOD", "PAAL", "FUT.3MSG", "יֵרֹד"), ("קנה", "LAMED_HE", "PAAL", "PST.3FSG", "קָנְתָה"), ("קנה", "LAMED_HE", "PAAL", "PST.1SG", "קָנִיתִי"),
    ("קנה", "LAMED_HE", "PAAL", "FUT.3MSG", "יִקְנֶה"), ("צוד", "HOLLOW", "PAAL", "PRS.MPL", "צָדִים"), ("סבב", "GEMINATE", "PAAL", "PST.3FSG", "סָבָּה"), ("רכב", "STRONG", "HIFIL", "IMP.2FSG", "הַרְכִיבִי"),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(r[:4])[:-1] + f", nfc_normalize('{r[4]}'))" for r in _WEAK) + ") v(root, kind, binyan, cell, form)")
def weak_root_forms(t) -> DataFrame:
    """Forms of weak roots, whose patterns are rewritten; held against forms written out."""
    spark = t("region").sparkSession
    names = sorted({r[0] for r in _WEAK})
    forms = weak_roots.realize(spark.createDataFrame([(r, *r) for r in names], "root string, r1 string, r2 string, r3 string"), weak_roots.patterns(spark))
    asked = spark.createDataFrame([(r[0], r[2], r[3]) for r in _WEAK], "root string, binyan string, cell string")
    return forms.join(F.broadcast(asked), ["root", "binyan", "cell"], "left_semi").select("root", "kind", "binyan", "cell", "form")
