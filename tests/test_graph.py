import random

import pytest

from quillgraph.operators import graph, pages, suggest, vector

LINKS = "source_doc_id string, target_doc_id string, type string"


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(x, f"title {x}", "design") for x in "ABCDE"], "id string, title string, doc_type string")
    links = spark.createDataFrame([("A", "B", "references"), ("B", "C", "depends_on"), ("A", "D", "implements"), ("E", "A", "references"), ("C", None, "references")], LINKS)
    return docs, links


def reach(spark, links, seed, depth, types=None, forward=True):
    seeds = spark.createDataFrame([(seed,)], "seed string")
    return {r.node for r in graph.traverse(links, seeds, depth, types, forward).collect()}


def test_five_node_graph(spark, small):
    docs, links = small
    assert reach(spark, links, "A", 1) == {"B", "D"}
    assert reach(spark, links, "A", 2) == {"B", "C", "D"}
    assert reach(spark, links, "A", 0) == {"B", "D"}
    assert reach(spark, links, "A", 1, ["implements"]) == {"D"}
    assert reach(spark, links, "C", 1) == set()
    assert reach(spark, links, "A", 1, forward=False) == {"E"}
    assert reach(spark, links, "C", 2, forward=False) == {"A", "B"}
    assert reach(spark, links, "E", 1, forward=False) == set()


def test_both_ways_and_structure(spark, small):
    docs, links = small
    both = graph.traverse_both(links, spark.createDataFrame([("A",)], "seed string"), 1)
    assert {(r.node, r.direction) for r in both.collect()} == {("B", "outgoing"), ("D", "outgoing"), ("E", "incoming")}
    nodes, edges = graph.full_structure(docs, links)
    assert nodes.count() == 5 and edges.count() == 4
    nodes, edges = graph.centered_structure(docs, links, "A", 1)
    got = {r.node: (r.out_degree, r.in_degree) for r in nodes.collect()}
    assert len(got) == 4 and got["A"] == (2, 1)


def test_random_graphs_match_breadth_first_search(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(20), rng.randrange(20)) for _ in range(45)}
    links = spark.createDataFrame([(str(a), str(b), "references") for a, b in edges], LINKS)
    seeds = spark.createDataFrame([(str(i),) for i in range(20)], "seed string")
    got = {(r.seed, r.node): r.depth for r in graph.traverse(links, seeds, 3).collect()}
    want = {}
    for s in range(20):
        level, seen = {s}, {s}
        for depth in (1, 2, 3):
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            want |= {(str(s), str(x)): depth for x in level}
    assert got == want


def test_proximity(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("z", 1), ("c", 0)], "node string, depth int")
    assert {r.node: round(r.proximity, 2) for r in graph.proximity_scores(rows).collect()} == {"x": 1.0, "y": 0.5, "z": 1.0, "c": 0.0}


def test_budget_skips_what_does_not_fit_and_goes_on(spark):
    budget = lambda most: pages.contexts(docs, sections, links, spark.createDataFrame([("A",)], "seed string"), 1, most).first()
    docs = spark.createDataFrame([(x, f"t{x}", "guide", f"{x}.md") for x in "ABCDE"], "id string, title string, doc_type string, filepath string")
    links = spark.createDataFrame([("A", x, "references") for x in "BCDE"], LINKS)
    sections = spark.createDataFrame([(1, "A", 0, None, "a" * 10), (2, "B", 0, None, "b" * 50), (3, "C", 0, None, "c" * 95), (4, "D", 0, None, "d" * 30), (5, "E", 0, "", "e" * 2000)], "section_id long, doc_id string, section_order int, heading string, content string")
    row = budget(100)
    assert (row.total_size, row.truncated, [r.node for r in row.related]) == (90, 2, ["B", "D"])
    # A long page counts with its summary of 500 characters.
    row = budget(700)
    assert (row.total_size, row.truncated, [r.node for r in row.related]) == (685, 0, ["B", "C", "D", "E"])
    assert pages.get_page(docs, sections, links.selectExpr("*", "null as context"), "E.md").first().content == "e" * 2000
    shown = pages.get_context(docs, sections, links, "A.md", 1, 100).collect()
    assert {r.node for r in shown} == {"B", "D"} and shown[0].center_content == "a" * 10
    assert {len(r.summary) for r in pages.get_context(docs, sections, links, "A.md", 1, 700).collect()} == {50, 95, 30, 500}


def test_neighbours_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, i // 2, [float(v) for v in row]) for i, row in enumerate(x)], "section_id long, doc_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.section_id for r in vector.neighbours(df, 3, block=16).collect()}
    for i in range(60):
        order = sorted(range(60), key=lambda j: (-round(float(x[i] @ x[j]), 12), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == order


def test_suggestions_leave_out_linked_pairs(spark):
    docs = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "id string, title string")
    sections = spark.createDataFrame([(1, 0, None, "one"), (2, 0, "two", "x"), (3, 0, None, "three")], "section_id long, section_order int, heading string, content string")
    vectors = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "B", [0.99, 0.1]), (3, "C", [0.98, 0.2])], "section_id long, doc_id string, embedding array<double>")
    links = spark.createDataFrame([("B", "A", "references")], LINKS)
    got = [(r.source_doc_id, r.target_doc_id, r.source_label) for r in suggest.suggest_links(docs, sections, vectors, links, 0.7, 5).collect()]
    assert sorted(got) == [("A", "C", "one"), ("B", "C", "two")]
