import random

import pytest

from tessera.llm.components import components, union_find

from .helpers import components as plain


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components_equal_plain_union_find(spark, kind):
    rng = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(300)], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
             "star": [(500, i) for i in range(400)] + [(7, 7)], "none": []}[kind]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(spark, df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain(nodes, [(a, b) for a, b in links])


def test_union_find_keeps_smallest():
    assert union_find([(5, 3), (3, 9), (9, 1), (7, 8)]) == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7}
