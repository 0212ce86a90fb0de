"""The second generator: patterns that weak roots rewrite, the balanced sampler, its tables."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.functions import features
from lexspark.plans import weak_roots

N = lambda s: unicodedata.normalize("NFC", s)
FORMS = [
    ("נצל", "HIFIL", "PST.3MSG", "הִצִּיל"), ("נצל", "NIFAL", "PST.3MSG", "נִצַּל"), ("נקט", "PAAL", "PST.3MSG", "נָקַט"), ("נקט", "PAAL", "FUT.3MSG", "יִקֹּט"),
    ("ירד", "HIFIL", "PST.3MSG", "הוֹרִיד"), ("ילד", "NIFAL", "PST.3MSG", "נוֹלַד"), ("ירד", "PAAL", "PST.1SG", "יָרַדְתִּי"), ("ירד", "PAAL", "FUT.3MSG", "יֵרֹד"),
    ("קנה", "PAAL", "PST.3FSG", "קָנְתָה"), ("קנה", "PAAL", "PST.3PL", "קָנוּ"), ("קנה", "PAAL", "PST.1SG", "קָנִיתִי"), ("קנה", "PAAL", "FUT.3MSG", "יִקְנֶה"), ("קנה", "PAAL", "PST.3MSG", "קָנָה"), ("קנה", "NIFAL", "PST.1SG", "נִקְנֵיתִי"), ("קנה", "HIFIL", "PST.3PL", "הִקְנוּ"),
    ("צוד", "PAAL", "PST.1SG", "צַדְתִּי"), ("צוד", "PAAL", "PRS.MPL", "צָדִים"), ("סבב", "PAAL", "PST.3FSG", "סָבָּה"), ("רכב", "PAAL", "PST.1SG", "רָכַבְתִּי"), ("רכב", "HIFIL", "IMP.2FSG", "הַרְכִיבִי"), ("למד", "PIEL", "FUT.2FPL", "תְּלַמֵּדְנָה"),
]


@pytest.fixture(scope="module")
def dimension(spark):
    return weak_roots.patterns(spark).cache()


def test_weak_forms(spark, dimension):
    roots = sorted({r for r, *_ in FORMS})
    df = spark.createDataFrame([(r, *r) for r in roots], "root string, r1 string, r2 string, r3 string")
    got = {(r["root"], r["binyan"], r["cell"]): r["form"] for r in weak_roots.realize(df, dimension).collect()}
    assert [(r, b, c, got[r, b, c]) for r, b, c, _ in FORMS] == [(r, b, c, N(f)) for r, b, c, f in FORMS]


def test_dimension(dimension):
    by = {r["binyan"]: r["n"] for r in dimension.where("kind = 'STRONG'").groupBy("binyan").agg(F.count("*").alias("n")).collect()}
    assert by == {b: 23 if b in weak_roots.PASSIVE else 27 for b in features.CLASSES}
    assert dimension.groupBy("kind").count().select(F.countDistinct("count")).first()[0] == 1


def test_balanced_sample_and_table(spark):
    roots = weak_roots.balanced_roots(spark, 30, 0.5, 3)
    kinds = {r["k"]: r["n"] for r in roots.groupBy(weak_roots.kind_of(F.col("r1"), F.col("r2"), F.col("r3")).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert kinds == dict.fromkeys(weak_roots.KINDS, 3) | {"STRONG": 15}
    assert roots.exceptAll(weak_roots.balanced_roots(spark, 30, 0.5, 3)).isEmpty() and roots.select("root").distinct().count() == 30
    table = weak_roots.weak_table(spark, 6, 0.5, 1)
    assert table.count() == 6 * (5 * 27 + 2 * 23) == table.select("eq_id").distinct().count()
