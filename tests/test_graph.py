"""Components against a union of sets, over graphs of one, of few and of many pieces."""

from __future__ import annotations

import random

import pytest

from loomfield.functions.common import Tables, names_in, shared_dir
from loomfield.functions.graph import components


def by_union(links):
    of = {}
    find = lambda x: x if of.setdefault(x, x) == x else find(of[x])
    for a, b in links:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            of[q] = p
    return {x: find(x) for x in of}


@pytest.mark.parametrize("links", [
    [],
    [(1, 1), (None, 2), (3, None)],
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 80)] + [(79, 100)],
    [(random.Random(i).randint(0, 150), random.Random(-i - 1).randint(0, 150)) for i in range(90)],
])
def test_components_are_those_of_a_union(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    with Tables(spark, "graph") as tables:
        rows = components(df.unionByName(df.select(df["b"].alias("a"), df["a"].alias("b"))), tables).collect()
    assert {r.node: r.component for r in rows} == by_union(links) and len(rows) == len(by_union(links))
    assert not [n for n in names_in(spark, shared_dir(spark)) if n.startswith("graph-")]


def test_nodes_may_be_structs(spark):
    rows = [(1, 5, 7), (1, 7, 9), (2, 5, 9)]
    df = spark.createDataFrame(rows, "i long, p long, q long").selectExpr("struct(i, p) AS a", "struct(i, q) AS b")
    with Tables(spark, "graph") as tables:
        got = {(tuple(r.node), tuple(r.component)) for r in components(df, tables).collect()}
    assert got == {((1, 5), (1, 5)), ((1, 7), (1, 5)), ((1, 9), (1, 5)), ((2, 5), (2, 5)), ((2, 9), (2, 5))}
