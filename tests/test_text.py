from pyspark.sql import functions as F

from enrichspark.operators import names, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def cleaned(spark, value):
    r = text.clean_definition(spark.createDataFrame([(value,)], "t string"), "t").first()
    return r.cleaned, r.removed


def test_clean_definition(spark):
    noisy = "A cell [GO] that eats. It is CD4-positive and CD8-negative. Examples: none. Keeps one CD4-positive mark."
    assert cleaned(spark, noisy)[0] == "A cell that eats. Keeps one CD4-positive mark."
    only = "CD4-positive, CD8-low."
    assert cleaned(spark, only)[0] == only
    assert cleaned(spark, only)[1] == 0


def test_blinding_is_by_whole_word(spark):
    texts = spark.createDataFrame([(1, "different currents"), (2, "the REN gene (ren)"), (3, "a.b matches a+b")], "k int, text string")
    bad = spark.createDataFrame([(1, "ren"), (2, "ren"), (3, "a.b"), (3, "a?b")], "k int, term string")
    got = {r["k"]: (r["ok"], r["hits"]) for r in text.blinding_scan(texts, bad, ["k"]).collect()}
    assert got == {1: (True, []), 2: (False, ["ren"]), 3: (False, ["a.b"])}


def test_parse_responses(spark):
    df = spark.createDataFrame([(1, 'x ```json\n{"a": 1, "b": null}\n```'), (2, '{"a": 1}'), (3, "[1]"), (4, '{"a": 1, "b": '), (5, '{"a":1,"b":2}')],
                               "i int, text string")
    got = {r["i"]: r["status"] for r in text.parse_responses(df, ["a", "b"]).collect()}
    assert got == {1: "OK", 2: "FAILED_PARSE", 3: "FAILED_PARSE", 4: "FAILED_PARSE", 5: "OK"}


def test_last_verdict_wins(spark):
    df = spark.createDataFrame([(1, '{"judgments": [{"index": 0, "verdict": "applies"}, {"index": 1}, {"index": 0, "verdict": "partial"}]}')],
                               "r int, payload string")
    assert [tuple(r) for r in text.parse_verdicts(df, ["r"]).collect()] == [(1, 0, "partial")]


def test_names_resolve_only_if_unambiguous(spark):
    terms = spark.createDataFrame([("1", "cell motility", "biological_process"), ("2", "Cell-motility", "biological_process"),
                                   ("3", "phagocytosis", "biological_process"), ("4", "x binding", "molecular_function")],
                                  "id string, label string, namespace string")
    syn = spark.createDataFrame([("3", "engulfment", "EXACT"), ("3", "eating", "BROAD")], "id string, text string, scope string")
    index = {r["name"]: r["id"] for r in names.name_index(terms, syn).collect()}
    assert index == {"phagocytosis": "3", "engulfment": "3"}
    asked = spark.createDataFrame([("Cell motility",), ("X-binding",), ("eating",), ("y activity",), ("nothing",)], "text string")
    got = {r["text"]: r["class"] for r in names.classify_invalid(asked, terms, syn).collect()}
    assert got == {"Cell motility": "ambiguous", "X-binding": "molecular function", "eating": "loose synonym",
                   "y activity": "function wording", "nothing": "not a name"}


def test_predictions_close_ranks(spark):
    a = spark.createDataFrame([(1, 0, "bad", 0.1), (1, 1, "One", 0.2), (1, 2, "ONE", 0.3), (1, 3, "GO:0000002", 0.4)],
                              "k int, position int, written string, confidence double")
    index = spark.createDataFrame([("one", "t1"), ("GO:0000002", "t2")], "name string, id string")
    cands = spark.createDataFrame([("t2",)], "id string")
    got = sorted((r["rank"], r["id"], r["in_table"]) for r in names.resolve_predictions(a, index, cands, "k").collect() if r["rank"])
    assert got == [(1, "t1", False), (2, "t2", True)]
    d = names.resolution_diagnostics(names.resolve_predictions(a, index, cands, "k"), "k").first()
    assert (d["n_raw"], d["n_valid"], d["n_invalid"], d["n_duplicate"], d["frac_in_table"]) == (4, 2, 1, 1, 0.5)


def test_table_hash_counts_repeated_rows(spark):
    from enrichspark.sources.tables import table_hash
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    twice = [rows.union(rows.filter(f"x = {k}")) for k in (1, 2)]
    hashes = [table_hash(d).first() for d in (rows, *twice)]
    assert len({h.hash for h in hashes}) == 3 and [h.n for h in hashes] == [2, 3, 3]
    assert table_hash(rows.repartition(4)).first() == hashes[0]


def test_answers_beyond_the_limit_are_counted(spark):
    answers = spark.createDataFrame([(1, i, f"GO:000000{i}", 0.5) for i in range(4)], "key int, position int, written string, confidence double")
    cands = spark.createDataFrame([(f"GO:000000{i}",) for i in range(4)], "id string")
    index = cands.selectExpr("id name", "id")
    for limit, valid, beyond in ((None, 4, 0), (3, 3, 1)):
        out = names.resolve_predictions(answers, index, cands, "key", "constrained", max_predictions=limit)
        d = names.resolution_diagnostics(out, "key").first()
        assert (d.n_raw, d.n_valid, d.n_invalid, d.n_beyond) == (4, valid, 0, beyond)


def test_table_hash_tells_fields_apart(spark):
    from enrichspark.sources.tables import table_hash
    one = lambda *r: table_hash(spark.createDataFrame([r], "a string, b string")).first().hash
    hashes = [one("a|b", "c"), one("a", "b|c"), one(None, "x"), one("-", "x"), one("\\N", "x"), one("", "x"), one("1:a", ""), one("1:", "a")]
    assert len(set(hashes)) == len(hashes)


def test_wide_matrix_over_several_files(spark, tmp_path):
    """5,000 columns, the header in the first file only, blank last cells and an empty file."""
    from enrichspark.operators import matrix
    from enrichspark.sources import tables
    genes = [f"g{i}" for i in range(5000)]
    cell = lambda r, i: ("1", "0", "")[(r * 7 + i) % 3]
    lines = [f"x{r}\t" + "\t".join(cell(r, i) for i in range(5000)) for r in range(12)]
    (tmp_path / "part-0").write_text("")
    (tmp_path / "part-1").write_text("index\t" + "\t".join(genes) + "\n" + "\n".join(lines[:5]) + "\n")
    (tmp_path / "part-2").write_text("\n".join(lines[5:]) + "\n")
    head = tables.matrix_header(spark, str(tmp_path))
    assert [r.gene for r in head.orderBy("position").collect()] == genes
    long = matrix.unpivot_matrix(tables.read_matrix(spark, str(tmp_path)), head)
    got = {(r.item, r.gene): r.value for r in long.filter("item IN ('x0', 'x3', 'x11')").collect()}
    assert len(got) == 15000 and all(got[f"x{r}", f"g{i}"] == {"1": 1, "0": 0, "": None}[cell(r, i)] for r in (0, 3, 11) for i in range(0, 5000, 37))
    assert long.count() == 60000


def test_blinding_against_every_pair(spark):
    import random
    import re
    rng = random.Random(3)
    words = ["Alpha", "beta-2", "IL 6", "don't", "ñandú", "¿?!", "a.b.c.d e", "gene", "Gene", "x(y", "2"]
    texts = [(i % 4, i // 4, "".join(rng.choice([*words, " ", "-", "x", ", "]) + rng.choice([" ", "", "."]) for _ in range(rng.randrange(9)))) for i in range(48)]
    forbidden = [(k, rng.choice(words), rng.randrange(12)) for k in range(4) for _ in range(9)]
    got = text.blinding_scan(spark.createDataFrame(texts, "k int, turn int, text string"), spark.createDataFrame(forbidden, "k int, term string, turn int"), ["k", "turn"], 2, "turn").collect()
    assert len(got) == len(texts)
    for r in got:
        first = {}
        for k, t, at in forbidden:
            if k == r.k and len(t) >= 2:
                first[t] = min(at, first.get(t, at))
        want = sorted(t for t, at in first.items() if at < r.turn and re.search(f"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])", r.text, re.I | re.A))
        assert (r.hits, r.ok) == (want, not want), (r, want)


def test_no_reworded_name_is_lost(spark):
    """The nearest name of every asked one against all pairs, with common words that meet by twos."""
    import random
    rng = random.Random(5)
    words = ["of", "cell", "binding"] + [f"w{i}" for i in range(12)]
    name = lambda: " ".join(rng.choices(words, [8, 6, 4] + [1] * 12, k=rng.randint(1, 7)))
    named = [(str(i), i, name()) for i in range(300)]
    asked = sorted({name() for _ in range(300)} | {"", "of", "unheard", "of cell"})
    a = spark.createDataFrame([(x, x) for x in asked], "key string, name string")
    b = spark.createDataFrame(named, "key string, id int, name string")
    for least in (0.75, 0.5, 1.0):
        want = {}
        for x in asked:
            s = set(x.split(" "))
            best = min(((-len(s & t) / len(s | t), i) for _, i, t in ((k, i, set(n.split(" "))) for k, i, n in named)), default=None)
            if -best[0] >= least:
                want[x] = best[1]
        for split in (2, 256):
            got = {r["name"]: r["_near"]["id"] for r in names.near_names(a, b, least, split).collect()}
            assert got == want, (least, split)


def test_mismatches_are_of_other_groups(spark):
    from enrichspark.operators.design import mismatched
    pairs = spark.createDataFrame([(c, t, f"a{c}{t}", f"b{c}{t}") for c in range(4) for t in range(3)], "c int, t int, x string, y string")
    got = [(r["x"], r["y"]) for r in mismatched(pairs, ["t", "c"], "c", "x", "y", 4).collect()]
    assert len(got) == 12 * 3 and len(set(got)) == 36 and all(x[1] != y[1] for x, y in got)


def test_entries_of_answers(spark):
    said = [(1, '{"predictions": ["a", {"name": "b", "confidence": 0.25}, {"name": "", "term": "c", "confidence": "high"}, {"x": 1}, null, 7, {"id": 12, "confidence": 1}, ""]}'),
            (2, '{"predictions": []}'), (3, "no json"), (4, None), (5, '{"predictions": [{"go_id": "g", "name": "n"}]}'), (6, '{"other": ["a"]}')]
    df = spark.createDataFrame(said, "key int, payload string")
    got = sorted((tuple(r) for r in names.answer_entries(df, "key", "payload").collect()), key=str)
    assert got == [(1, 0, "a", None), (1, 1, "b", 0.25), (1, 2, "c", None), (1, 3, "12", 1.0), (5, 0, "n", None)]
    assert [r["written"] for r in names.answer_entries(df.filter("key = 5"), "key", "payload", "go_id").collect()] == ["g"]


def test_shuffled_rates(spark):
    from enrichspark.operators.donors import shuffled_rates
    rows = [(1, 1, 1, "no_match"), (1, 1, 4, "exact"), (1, 2, 1, "upward"), (1, 2, 4, "no_match"), (2, 1, 1, "no_match")]
    df = spark.createDataFrame(rows, "target int, place int, rank int, kind string")
    got = {r["target"]: tuple(r)[1:] for r in shuffled_rates(df, spark.createDataFrame([(1,), (2,), (3,)], "gene int")).collect()}
    assert got == {1: (0.5, 0.5, 0.0, 1.0, 1.0, 0.5, 0.5), 2: (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), 3: (None,) * 7}


def test_unresolved_pairs(spark):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 1, "b"), (1, 9, None)], "gene int, ct int, tissue string")
    terms = spark.createDataFrame([(1, "x", True), (2, "y", False)], "id int, label string, resolved boolean")
    tissues = spark.createDataFrame([("a", "A", True)], "id string, label string, resolved boolean")
    got = sorted((tuple(r) for r in text.unresolved_pairs(items, terms, tissues).collect()), key=str)
    assert got == [(1, 1, "b", True, False), (1, 2, "a", False, True), (1, 9, None, False, False)]


def test_mismatches_go_round_in_blocks(spark, monkeypatch):
    from enrichspark.operators import design

    monkeypatch.setattr(design, "MISMATCH_BLOCK", 7)
    for size, n in ((40, 10), (14, 3), (3, 10), (1, 4)):
        made = [(i // 3, i % 3, f"l{i}", f"r{i}") for i in range(size)]
        pairs = spark.createDataFrame(made, "g long, turn int, a string, b string")
        want = sorted((x[2], y[2 + 1]) for i, x in enumerate(made) for s in range(1, n + 1) for y in [made[(i + s) % size]] if x[0] != y[0])
        got = design.mismatched(pairs, ["g", "turn"], "g", "a", "b", n)
        assert sorted(map(tuple, got.collect())) == want
