"""A generated corpus end to end: tables, views, splits, sequences; against known counts."""

import json
import unicodedata
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import features
from lexspark.plans import encoding, equations, runner, splits, synth, views

CONSONANTS = ["ב", "ג", "ד", "ז", "ט", "כ", "ל", "מ"]


@pytest.fixture(scope="module")
def corpus(spark):
    return {k: v.cache() for k, v in synth.generate(spark, CONSONANTS, 30, 7).items()}


@pytest.fixture(scope="module")
def view(corpus):
    return views.past_reinflection(corpus["roots"], corpus["lexemes"], corpus["forms"]).cache()


def test_tables(corpus):
    assert {k: v.count() for k, v in corpus.items()} == {"roots": 30, "lexemes": 210, "forms": 1890, "provenance": 2130, "validation": 0}
    assert corpus["lexemes"].where("not paradigm_complete").count() == 0
    assert corpus["forms"].groupBy("form_id").count().where("count > 1").count() == 0


def test_generation_is_deterministic(spark, corpus):
    again = synth.generate(spark, CONSONANTS, 30, 7)["forms"].select("form_id", "form_vocalized")
    assert again.exceptAll(corpus["forms"].select("form_id", "form_vocalized")).isEmpty()


def test_gaps_keep_citation_cells(spark):
    forms = synth.generate(spark, CONSONANTS, 10, 7, gap_rate=0.5)["forms"]
    assert forms.where(F.col("canonical_cell") == features.CITATION_CELL).count() == 70
    assert 250 < forms.count() < 450


def test_view_shape(view):
    assert view.count() == 210 * 8 * 2
    assert view.columns[:9] == views.IDENTITY + views.VISIBLE and all(c.startswith(views.A) for c in view.columns[9:])
    assert view.where("source_cell = target_cell").count() == 0
    row = view.where("condition = 'voc' and target_cell = 'PST.1SG'").first()
    assert row["target_features"] == "PST,1,SG" and row["analysis__eligible_default"]


@pytest.mark.parametrize("mode", ["hash", "compat"])
@pytest.mark.parametrize("strategy", ["iid", "lexeme_holdout", "root_holdout"])
def test_group_splits_are_clean(view, strategy, mode):
    a = getattr(splits, strategy)(splits.eligible_pairs(view), 0, mode)
    assert a.count() == 1680
    splits.verify(strategy, a, view)


@pytest.mark.parametrize("mode", ["hash", "compat"])
def test_cell_and_class_splits_are_clean(view, mode):
    pairs = splits.eligible_pairs(view)
    a, exposed = splits.cell_k(pairs, 4, 0, 8, mode)
    splits.verify("cell_k", a, view, exposed=exposed, k=4)
    assert {r["partition"] for r in a.select("partition").distinct().collect()} == {"train", "dev", "test"}
    b = splits.class_ood(pairs, "analysis__sc_strong", "rootclass_strong", 0, mode)
    splits.verify("class_ood", b, view, flag="analysis__sc_strong")
    c = splits.root_class_holdout(pairs, 0)
    splits.verify("root_binyan_holdout", c, view)


def test_verifier_finds_injected_leaks(view):
    a = splits.root_holdout(splits.eligible_pairs(view), 0)
    one = a.where("partition = 'train'").orderBy("pair_id").limit(1)
    moved = a.join(one.select("pair_id"), "pair_id", "left_anti").unionByName(one.withColumn("partition", F.lit("test")))
    with pytest.raises(splits.LeakageError, match="shared"):
        splits.verify("root_holdout", moved, view)
    with pytest.raises(splits.LeakageError, match="two partitions"):
        splits.verify("root_holdout", a.unionByName(one.withColumn("partition", F.lit("test"))), view)


def test_loader_shows_whitelist_only(view):
    a = splits.iid(splits.eligible_pairs(view), 0)
    rows = views.load(view, a, "test", "voc")
    assert rows.columns == views.VISIBLE and rows.count() == 168
    assert views.load_analysis(view, a, "test", "voc").count() == 168


def test_manifest_lists_ids(spark, view):
    a = splits.iid(splits.eligible_pairs(view), 0)
    m = splits.manifest(spark, "iid_seed0", "iid", 0, a, view)
    assert len(m["partitions"]["train"]["pair_ids"]) == 1344 and json.dumps(m)


def test_equations(spark, corpus):
    forms = corpus["forms"].join(corpus["roots"].select("root_id", F.col("root_normalized").alias("root")), "root_id").select("root", "binyan", F.col("canonical_cell").alias("cell"), F.col("form_vocalized").alias("form"))
    table = equations.equation_table(forms, 0)
    assert table.count() == 1890 and table.select("eq_id").distinct().count() == 1890
    parts = {r["partition"]: r["n"] for r in equations.fraction_split(table, 0.5, 0, 0.2, 0.1).groupBy("partition").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 945, "dev": 189, "test": 756}
    blocks = splits.block_holdout(forms.withColumn("tense", F.substring("cell", 1, 3)), ["root", "binyan", "tense"], [["root"], ["binyan"], ["binyan", "cell"]], 0.8, 0)
    assert blocks.count() == 210 and blocks.where("partition = 'train'").count() == 168


#: A generated corpus and how many pair ids, lexemes and roots its seeded splits have in each partition (fixed values).
SIXTEEN = ["ב", "ג", "ד", "ז", "ט", "כ", "ל", "מ", "נ", "ס", "פ", "צ", "ק", "ר", "שׁ", "ת"]
COUNTS = {
    "iid": {"train": (44800, 7000, 1000), "dev": (5600, 4009, 996), "test": (5600, 3987, 997)},
    "lexeme_holdout": {"train": (44800, 5600, 1000), "dev": (5600, 700, 512), "test": (5600, 700, 521)},
    "root_holdout": {"train": (44800, 5600, 800), "dev": (5600, 700, 100), "test": (5600, 700, 100)},
    "root_binyan_holdout": {"train": (44800, 5600, 1000), "dev": (5600, 700, 527), "test": (5600, 700, 531)},
    "cell_k4": {"train": (21000, 7000, 1000), "dev": (3500, 700, 519), "test": (31500, 6300, 1000)},
    "rootclass_strong": {"train": (3136, 392, 56), "dev": (336, 42, 6), "test": (52528, 6566, 938)},
    "rootclass_initial_nun": {"train": (47264, 5908, 844), "dev": (5264, 658, 94), "test": (3472, 434, 62)},
}


def test_seeded_splits_have_the_known_counts(spark):
    t = synth.generate(spark, [unicodedata.normalize("NFC", c) for c in SIXTEEN], 1000, 12345, version="v1")
    v = views.past_reinflection(t["roots"], t["lexemes"], t["forms"]).cache()
    pairs = splits.eligible_pairs(v).cache()
    made = {s: getattr(splits, s)(pairs, 0, "compat") for s in ("iid", "lexeme_holdout", "root_holdout")}
    made["root_binyan_holdout"] = splits.root_class_holdout(pairs, 0)
    made["cell_k4"] = splits.cell_k(pairs, 4, 0, 8, "compat")[0]
    made |= {f"rootclass_{p}": splits.class_ood(pairs, f"analysis__sc_{p}", f"rootclass_{p}", 0, "compat") for p in ("strong", "initial_nun")}
    whole = reduce(DataFrame.unionByName, [a.withColumn("split", F.lit(name)) for name, a in made.items()])
    got: dict = {}
    for r in splits.stats(whole, v, ["split", "partition"]).collect():
        got.setdefault(r["split"], {})[r["partition"]] = (r["pair_ids"], r["lexemes"], r["roots"])
        assert r["examples_voc"] == r["examples_unv"] == r["forms"] == r["pair_ids"]
    assert got == COUNTS


def test_all_splits_are_written_verified_and_summed_up(spark, tmp_path):
    t = synth.generate(spark, ["ב", "ג", "ד", "ז", "נ"], 20, 3)
    view = views.past_reinflection(t["roots"], t["lexemes"], t["forms"]).cache()
    summary, skipped = runner.run(view, "past_reinflection", str(tmp_path / "splits"), [0], [4], 8)
    rows = {(r["split"], r["partition"]): r for r in summary.collect()}
    assert rows["iid_seed0", "train"]["pair_ids"] == 896 and {s.rsplit("_seed", 1)[0] for s, _ in rows} >= {"iid", "lexeme_holdout", "root_holdout", "root_binyan_holdout", "cell_k4", "rootclass_strong"}
    gone = {r["flag"] for r in skipped.collect()}
    assert "analysis__sc_quadriliteral" in gone and "analysis__trad_PE_NUN" in gone and "analysis__sc_strong" not in gone


def test_sequences_round_trip(spark):
    rows = spark.createDataFrame([("ab", "F1,F2", "ba"), ("c", "F1", "")], "source string, features string, target string")
    vocab = encoding.vocabulary(rows.limit(1), ["source", "target"], "features")
    assert [r["symbol"] for r in vocab.orderBy("symbol_id").collect()] == [*encoding.SPECIALS, "a", "b", "F:F1", "F:F2"]
    out = {r["source"]: r for r in encoding.encode(rows, vocab, [("source", False), ("features", True)], "target", 10).withColumn("text", encoding.decode(F.slice("tokens", F.col("prompt_length") + 1, 10), vocab)).collect()}
    assert out["ab"]["tokens"] == [1, 5, 6, 2, 7, 8, 2, 6, 5, 3] and [i for i, x in enumerate(out["ab"]["loss_mask"]) if x] == [6, 7, 8] and out["ab"]["text"] == "ba"
    assert out["c"]["unknown"] == 1 and out["c"]["tokens"] == [1, 4, 2, 7, 2, 3, 0, 0, 0, 0] and out["c"]["text"] == ""
    with pytest.raises(Exception, match="is over 5"):
        encoding.encode(rows, vocab, [("source", False)], "target", 5).collect()
