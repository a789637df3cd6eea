from conftest import rows
from pyspark.sql import functions as F

from enrichspark.operators import dag, matching


def depths(closed, node):
    return {r["anc"]: r["depth"] for r in closed.filter(F.col("src") == node).collect()}


def test_closure_takes_the_shortest_path(closed):
    assert depths(closed, 12) == {12: 0, 6: 1, 4: 1, 3: 2, 2: 2, 1: 2}
    assert depths(closed, 24) == {24: 0, 12: 1, 8: 1, 6: 2, 4: 2, 2: 2, 3: 3, 1: 3}
    assert depths(closed, 7) == {7: 0, 3: 1, 2: 1, 1: 2}
    assert closed.count() == 362 and closed.agg(F.sum("depth")).first()[0] == 621


def test_closure_is_the_same_for_any_round_length(graph, closed):
    want = rows(closed, "src", "anc", "depth")
    assert rows(dag.closure(graph, hops=1), "src", "anc", "depth") == want
    assert rows(dag.closure(graph, hops=2, max_depth=9), "src", "anc", "depth") == want


def test_depth_limit_and_relations(graph):
    isa3 = dag.closure(graph, ("is_a",), 3)
    assert depths(isa3, 50) == {50: 0, 25: 1, 12: 2, 6: 3}


def test_asked_nodes_beyond_the_first_hops(spark, graph, closed):
    nodes = spark.createDataFrame([(50,), (24,), (99,)], "node int")
    want = sorted([r for r in rows(closed, "src", "anc", "depth") if r[0] in (50, 24)] + [(99, 99, 0)])
    assert rows(dag.closure(graph, nodes=nodes, hops=1), "src", "anc", "depth") == want


def long_graph(spark):
    """A chain of 40 nodes with some shortcuts."""
    e = [(k, k - 1, "is_a") for k in range(2, 41)] + [(30, 12, "part_of"), (12, 3, "is_a"), (40, 31, "is_a")]
    return spark.createDataFrame(e, "child int, parent int, rel string")


def shortest(edges, limit=99):
    """Distances by breadth first search."""
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = []
    for s in {x for e in edges for x in e}:
        seen, ring, d = {s: 0}, {s}, 0
        while ring and d < limit:
            d += 1
            ring = {p for n in ring for p in up.get(n, ())} - set(seen)
            seen.update(dict.fromkeys(ring, d))
        out += [(s, a, n) for a, n in seen.items()]
    return sorted(out)


def test_long_paths_double(spark):
    g = long_graph(spark)
    want = shortest(rows(g, "child", "parent"))
    for hops in (1, 3, 4):
        assert rows(dag.closure(g, hops=hops), "src", "anc", "depth") == want
    assert rows(dag.closure(g, hops=2, max_depth=7), "src", "anc", "depth") == shortest(rows(g, "child", "parent"), 7)


def test_added_edges_give_the_closure_of_the_whole_graph(spark, graph):
    long = long_graph(spark)
    for g, part, limit in ((graph, "child % 3 = 0", None), (graph, "parent <= 2", 6), (long, "child % 2 = 0", None), (long, "true", None),
                           (long, "child in (12, 30)", 6)):
        added = g.filter(part)
        again = added.union(g.filter("child = 5"))  # repeated edges, and one that is there already
        got = dag.extend_closure(dag.closure(g.filter(f"NOT ({part})"), max_depth=limit), again, max_depth=limit)
        assert rows(got, "src", "anc", "depth") == shortest(rows(g, "child", "parent"), limit or 99), (part, limit)
    same = dag.extend_closure(dag.closure(graph), graph.limit(0))
    assert rows(same, "src", "anc", "depth") == shortest(rows(graph, "child", "parent"))


def test_resnik_and_propagation(spark, closed):
    truths = spark.createDataFrame([("g1", 4), ("g2", 6), ("g3", 12)], "gene string, term int")
    from enrichspark.operators.scoring import information_content
    ic = information_content(dag.propagate(truths, closed, ["gene"]))
    a = spark.createDataFrame([("x", 4), ("y", 12)], "key string, term int")
    b = spark.createDataFrame([("x", 6), ("y", 6)], "key string, term int")
    got = dict(rows(dag.resnik(a, b, closed, ic), "key", "resnik"))
    assert got["x"] == 0 and abs(got["y"] - 0.405465) < 1e-6


def test_classify(spark, closed):
    truths = spark.createDataFrame([("g", 12), ("g", 8)], "gene string, term int")
    preds = spark.createDataFrame([("g", t) for t in (12, 4, 24, 7)], "gene string, term int")
    got = {r["term"]: (r["kind"], r["distance"], r["matched_term"]) for r in matching.classify(preds, truths, closed).collect()}
    assert got == {12: ("exact", 0, None), 4: ("upward", 1, 8), 24: ("downward", 1, 8), 7: ("no_match", None, None)}


def test_upward_goes_before_a_nearer_downward(spark, closed):
    truths = spark.createDataFrame([("g", 48), ("g", 6)], "gene string, term int")
    preds = spark.createDataFrame([("g", 12)], "gene string, term int")
    r = matching.classify(preds, truths, closed).first()
    assert (r["kind"], r["distance"], r["matched_term"], r["also_down"]) == ("upward", 2, 48, True)
    s = matching.relation_split(preds, truths, closed, ["gene"]).first()
    assert (s["split"], s["d_up"], s["d_down"]) == ("both_down_closer", 2, 1)


def test_status_of_unknown_terms(spark):
    terms = spark.createDataFrame([(1, "a", "d", "OK"), (2, None, None, "OK"), (3, "c", None, "OBSOLETE")],
                                  "id int, label string, definition string, status string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    assert rows(dag.resolve_terms(ids, terms), "id", "status", "resolved") == [
        (1, "OK", True), (2, "OK", False), (3, "OBSOLETE", False), (4, "NOT_FOUND", False)]


def test_closure_in_many_tasks(spark, graph, closed, monkeypatch):
    """Rows set the number of tasks, whatever the session's number of partitions, and change no result."""
    from enrichspark import session
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    assert session.wide(graph, 400, "child").rdd.getNumPartitions() == 20 and session.wide(graph, 20, "child") is graph
    key = lambda df: sorted(map(tuple, df.select("src", "anc", "depth").collect()))
    assert key(dag.closure(graph)) == key(closed)
    assert key(dag.closure(graph, hops=1)) == key(closed)


def moved(spark, build):
    """Result rows of build(), and the rows that its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}
    before = stages()
    n = build().count()
    return n, sum(r for k, r in stages().items() if k not in before)


def test_closures_move_few_rows(spark, monkeypatch):
    """Ancestors travel as one row per node and edge: rows moved stay below the closure's pairs."""
    monkeypatch.setattr(dag, "FEW_EDGES", 100, raising=False)
    nodes = spark.range(1, 4001).withColumnRenamed("id", "child")
    up = lambda by, rel: nodes.filter(F.col("child") >= by).select(
        "child", F.floor(F.col("child") / by).alias("parent"), F.lit(rel).alias("rel"))
    g = up(2, "is_a").unionByName(up(3, "part_of"))
    n, rows_moved = moved(spark, lambda: dag.closure(g))
    assert n > 100_000 and rows_moved < n
    closed = dag.closure(g.filter("child % 10 <> 0"))
    m, rows_moved = moved(spark, lambda: dag.extend_closure(closed, g.filter("child % 10 = 0")))
    assert m == n and rows_moved < n


def test_deep_graphs_are_closed_by_doubling(spark, graph):
    """More levels than allowed, and nodes that hang on no root, go another way to the same pairs."""
    for g, levels in ((graph, 9), (long_graph(spark), 3)):
        want = shortest(rows(g, "child", "parent"))
        part = dag.closure(g.filter("child % 4 <> 0"), levels=levels)
        got = dag.extend_closure(part, g.filter("child % 4 = 0"), levels=levels)
        assert rows(got, "src", "anc", "depth") == want
    limited = dag.extend_closure(dag.closure(graph.filter("child % 4 <> 0"), max_depth=2, hops=1, levels=9), graph.filter("child % 4 = 0"),
                                 max_depth=2, levels=9)
    assert rows(limited, "src", "anc", "depth") == shortest(rows(graph, "child", "parent"), 2)
    ring = spark.createDataFrame([(1, 2, "is_a"), (2, 1, "is_a"), (3, 1, "is_a"), (5, 4, "is_a")],
                                 "child int, parent int, rel string")
    assert rows(dag.closure(ring, levels=3), "src", "anc", "depth") == shortest(rows(ring, "child", "parent"))
