"""Shared helpers of the text operators."""

import random

import pytest

from lexspark.llm import common


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_by_both_ways(spark, few):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(5000, 6000 + i) for i in range(100)] + [(9, 9)]  # a hub, a loop
    uf = common.UnionFind()
    for a, b in edges:
        uf.union(a, b)
    want = {x: uf.find(x) for x in uf.parent if uf.find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["a"]: r["b"] for r in common.components(df, few).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_nothing(spark, few):
    assert common.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_words_split_at_ascii_blanks_only():
    assert common.words_of("Ab C\x0bÉ\x1cx d") == ["ab c".encode(), "É\x1cx".encode(), b"d"]
    assert common.words_of(None) == []
