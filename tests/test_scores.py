import hashlib
import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from enrichspark.operators import compare, dag, donors, ranking, sampling, scoring, transfer


@pytest.fixture(scope="module")
def world(spark, closed):
    rng = random.Random(11)
    pairs = sorted({(g, rng.randint(2, 50)) for g in range(60) for _ in range(rng.randint(1, 5))})
    truths = spark.createDataFrame(pairs, "gene int, term int")
    prop = dag.propagate(truths, closed, ["gene"]).cache()
    anc = {}
    for s, a in rows(closed, "src", "anc"):
        anc.setdefault(s, set()).add(a)
    sets = {}
    for g, t in pairs:
        sets.setdefault(g, set()).update(anc[t])
    n = len(sets)
    ic = {t: -math.log(sum(t in s for s in sets.values()) / n) for t in set().union(*sets.values())}
    return {"truths": truths, "prop": prop, "ic": scoring.information_content(prop).cache(), "sets": sets, "anc": anc, "icd": ic}


def f1(world, gene, terms):
    pred = set().union(*(world["anc"][t] for t in terms)) if terms else set()
    m = lambda s: sum(world["icd"].get(t, 0.0) for t in s)
    o, p, t = m(pred & world["sets"][gene]), m(pred & set(world["icd"])), m(world["sets"][gene])
    return 2 * o / (p + t) if o > 0 else 0.0


def test_information_content_micro(spark, closed):
    truths = spark.createDataFrame([("g1", 4), ("g2", 6), ("g3", 12)], "gene string, term int")
    prop = dag.propagate(truths, closed, ["gene"])
    ic = dict(rows(scoring.information_content(prop), "term", "ic"))
    assert ic[1] == 0 and ic[2] == 0 and ic[12] == pytest.approx(1.098612, abs=1e-6)
    assert ic[3] == ic[4] == ic[6] == pytest.approx(0.405465, abs=1e-6)
    preds = spark.createDataFrame([("g3", "a", 1, 4), ("g3", "b", 1, 6), ("g3", "c", 1, 12), ("g3", "d", 1, 4), ("g3", "d", 2, 4), ("g3", "d", 3, 6)],
                                  "gene string, c string, rank int, term int")
    ks = scoring.score_rankings(preds, prop, closed, scoring.information_content(prop), ["gene", "c"], (1, 2, 3))
    got = {r["c"]: r for r in ks.collect()}
    assert [round(got[c]["f1_at_1"], 6) for c in "abc"] == [0.298084, 0.51884, 1.0]
    assert got["d"]["f1_at_2"] == pytest.approx(0.688902, abs=1e-6) and got["d"]["n_predictions"] == 2


def test_ceilings_match_greedy_search(spark, closed, world):
    vocab = [4, 6, 9, 10, 12, 15, 20]
    v = spark.createDataFrame([(t,) for t in vocab], "term int")
    got = {r["gene"]: r for r in scoring.ceilings(world["prop"], v, closed, world["ic"]).collect()}
    assert len(got) == len(world["sets"])
    for g in world["sets"]:
        single = [f1(world, g, [t]) for t in vocab]
        assert got[g]["f1_top1"] == pytest.approx(max(single)) and got[g]["f1_top1_random"] == pytest.approx(sum(single) / len(vocab))
        best, chosen = 0.0, []
        for _ in range(3):
            score, _, t = min((-round(f1(world, g, chosen + [t]), 10), t, t) for t in vocab)
            if f1(world, g, chosen + [t]) <= best + 1e-12:
                break
            best, chosen = f1(world, g, chosen + [t]), chosen + [t]
        assert got[g]["f1_top3"] == pytest.approx(best)


def test_floor_is_the_mean_over_drawn_sets(spark, closed, world):
    v = spark.createDataFrame([(t,) for t in (4, 6, 9, 10, 12)], "term int")
    drawn = {}
    for d, t in rows(scoring.random_term_sets(v, 3, 40, 1), "draw", "term"):
        drawn.setdefault(d, []).append(t)
    assert all(len(set(x)) == 3 for x in drawn.values()) and len(drawn) == 40
    got = dict(rows(scoring.floor_at_k(world["prop"], v, closed, world["ic"], 3, 40, 1), "gene", "floor"))
    for g in world["sets"]:
        assert got[g] == pytest.approx(sum(f1(world, g, t) for t in drawn.values()) / 40)


def test_floor_is_the_same_in_several_blocks(spark, closed, world, monkeypatch):
    v = spark.createDataFrame([(t,) for t in (4, 6, 9, 10, 12)], "term int")
    whole = dict(rows(scoring.floor_at_k(world["prop"], v, closed, world["ic"], 3, 40, 1), "gene", "floor"))
    monkeypatch.setattr(scoring, "FLOOR_ROWS", 50)
    assert world["prop"].count() > 100
    assert dict(rows(scoring.floor_at_k(world["prop"], v, closed, world["ic"], 3, 40, 1), "gene", "floor")) == pytest.approx(whole)
    none = scoring.floor_at_k(world["prop"], v.limit(0), closed, world["ic"], 3, 40, 1)
    assert {r.floor for r in none.collect()} == {None}


def test_ceilings_of_several_vocabularies(spark, closed, world):
    vocab = {1: [4, 6, 9], 2: [10, 12, 15, 20]}
    v = spark.createDataFrame([(d, t) for d, ts in vocab.items() for t in ts], "draw int, term int")
    got = {(r["draw"], r["gene"]): r["f1_top1"] for r in scoring.ceilings(world["prop"], v, closed, world["ic"], ["draw"]).collect()}
    assert got == pytest.approx({(d, g): max(f1(world, g, [t]) for t in ts) for d, ts in vocab.items() for g in world["sets"]})


def test_constant_prior_is_the_best_first_term(spark, closed, world):
    vocab = [4, 6, 9, 10, 12, 15, 20]
    v = spark.createDataFrame([(t,) for t in vocab], "term int")
    dev = spark.createDataFrame([(g,) for g in range(0, 60, 2)], "gene int")
    got = rows(scoring.constant_prior(world["prop"], dev, v, closed, world["ic"], 2), "rank", "term")
    mean = lambda ts: sum(f1(world, g, ts) for g in range(0, 60, 2) if g in world["sets"])
    first = min(vocab, key=lambda t: (-round(mean([t]), 8), t))
    assert got[0] == (1, first)
    if len(got) > 1:
        assert got[1][1] == min(vocab, key=lambda t: (-round(mean([first, t]), 8), t))


def test_constant_prior_is_the_greedy_list(spark, closed, world):
    """Every step against brute force, with a term that no gene carries and a repeated vocabulary row."""
    vocab = [4, 6, 9, 10, 12, 15, 20, 24, 30, 36, 48, 50]
    v = spark.createDataFrame([(t,) for t in vocab + [4]], "term int")
    for start in (0, 1):
        held = [g for g in range(start, 60, 2) if g in world["sets"]]
        dev = spark.createDataFrame([(g,) for g in range(start, 60, 2)], "gene int")
        got = rows(scoring.constant_prior(world["prop"], dev, v, closed, world["ic"], 5), "rank", "term")
        chosen, best = [], -1.0
        for _ in range(5):
            score = {t: sum(f1(world, g, chosen + [t]) for g in held) / len(held) for t in vocab if t not in chosen}
            t = min(score, key=lambda t: (-round(score[t], 10), t))
            if score[t] <= best + 1e-12:
                break
            best, chosen = score[t], chosen + [t]
        assert got == list(enumerate(chosen, 1)) and len(chosen) > 1
    assert scoring.constant_prior(world["prop"], dev, v.limit(0), closed, world["ic"], 2).count() == 0
    assert scoring.constant_prior(world["prop"], dev.limit(0), v, closed, world["ic"], 2).count() == 1


def test_transfer_leaves_the_gene_out(spark, closed, world):
    """Scores equal those from a table built without the gene."""
    cands = spark.createDataFrame([(4,), (6,), (12,)], "term int")
    w = spark.createDataFrame([(g, c, 1.0 + c / 10) for g in (0, 1, 2) for c in (4, 6, 12)], "gene int, c int, w double")
    full = transfer.associations(world["prop"], world["ic"], cands, 1, 3)
    got = {(g, t): s for g, t, s in rows(transfer.transfer_rank(w, full, world["prop"], ["gene"]), "gene", "term", "score")}
    for g in (0, 1, 2):
        rest = world["prop"].filter(F.col("gene") != g)
        own = transfer.associations(rest, world["ic"], cands, 1, 2)
        ranked = transfer.transfer_rank(w.filter(F.col("gene") == g), own, rest, ["gene"], leave_out=False)
        want = {t: s for t, s in rows(ranked, "term", "score")}
        mine = {t: s for (h, t), s in got.items() if h == g}
        for t in mine:
            assert mine[t] == pytest.approx(want[t], rel=1e-9)


def test_ring_donors_match_all_pairs_under_skew(spark):
    """A third of the genes share one rate."""
    import hashlib
    rng = random.Random(4)
    rates = {g: 0.3 if g % 3 == 0 else round(rng.random(), 3) for g in range(240)}
    df = spark.createDataFrame(list(rates.items()), "gene int, rate double")
    got = {}
    for g, d, p in rows(donors.ring_donors(df, 0.05, 3, 42), "gene", "donor", "place"):
        got.setdefault(g, {})[p] = d
    pos = {g: int(hashlib.md5(f"42|{g}".encode()).hexdigest()[:15], 16) for g in rates}
    for g in rates:
        near = sorted(((pos[d] - pos[g]) % (1 << 60), d) for d in rates if d != g and abs(round(rates[d] * 1e6) - round(rates[g] * 1e6)) <= 50000)
        assert [got.get(g, {}).get(i) for i in range(1, min(3, len(near)) + 1)] == [d for _, d in near[:3]]
        assert g not in got.get(g, {}).values()


def test_rankings_cover_every_candidate(spark):
    stats = spark.createDataFrame([(1, 1, True, 0.2, 0.01), (1, 2, True, 0.3, 0.01), (1, 3, True, -0.1, 0.001), (1, 4, False, None, 1.0), (1, 5, True, 0.0, 0.5)],
                                  "gene int, term int, tested boolean, excess double, p double")
    got = rows(ranking.rank_corrected(stats, "p", ["gene"]), "rank", "term", "score")
    assert [t for _, t, _ in got] == [2, 1, 5, 3, 4] and [round(s, 6) for _, _, s in got] == [2.0, 2.0, 0.0, 0.0, 0.0]
    assert [t for _, t, _ in rows(ranking.rank_corrected(stats, "effect", ["gene"]), "rank", "term", "score")] == [2, 1, 5, 3, 4]


def test_paired_bootstrap(spark):
    rng = random.Random(9)
    rows_ = [("a", g, 0.5 + rng.gauss(0, .1)) for g in range(80)] + [("b", g, 0.3 + rng.gauss(0, .1)) for g in range(80)]
    s = spark.createDataFrame(rows_, "condition string, gene int, score double")
    c = spark.createDataFrame([("x", "a", "b"), ("y", "a", "none")], "contrast string, a string, b string")
    r = compare.paired_bootstrap(s, c, 500).collect()
    assert len(r) == 1 and r[0]["n"] == 80 and 0.1 < r[0]["ci_lo"] < r[0]["mean_diff"] < r[0]["ci_hi"] < 0.3
    assert r[0]["p"] == pytest.approx(1 / 501)


def test_split_sizes(spark):
    g = spark.range(500).select(F.col("id").alias("gene"), F.when(F.col("id") % 5 == 0, "not_carrying").otherwise("carrying").alias("stratum"))
    n = {(r["stratum"], r["split"]): r["count"] for r in sampling.split_by_hash(g, "s").groupBy("stratum", "split").count().collect()}
    assert n == {("carrying", "dev"): 40, ("carrying", "test"): 120, ("carrying", "held"): 240, ("not_carrying", "test"): 30, ("not_carrying", "held"): 70}


def test_matched_vocabularies_do_not_reuse_terms(spark):
    v = spark.createDataFrame([(i, 1.0) for i in range(5)], "term int, ic double")
    pool = spark.createDataFrame([(i, 1.0 + i / 100) for i in range(10, 17)], "term int, ic double")
    got = rows(scoring.matched_random_vocabularies(v, pool, 8, 3), "draw", "term")
    for d, group in itertools.groupby(got, key=lambda r: r[0]):
        terms = [t for _, t in group]
        assert len(terms) == len(set(terms)) == 5


def test_explanations_leave_out_only_annotated_genes(spark, closed, world):
    """A gene without annotations is in no count, so its associations are those of the whole table."""
    cands = spark.createDataFrame([(4,), (6,)], "term int")
    assoc = transfer.associations(world["prop"], world["ic"], cands, 1, 3)
    w = spark.createDataFrame([(g, c, 2.0) for g in (0, 999) for c in (4, 6)], "gene int, c int, w double")
    got = transfer.transfer_explain(w, assoc, world["prop"], ["gene"], 5, 50).filter("gene = 999")
    want = [r for r in rows(assoc, "c", "term", "s") if r[2] > 0]
    assert rows(got, "c", "term", "assoc") == want


def test_distractors_walk_the_ring_in_blocks(spark):
    """Blocks of any size give the ring walked gene by gene, also where it closes and where it is shorter than the reach."""
    for n_genes in (1, 2, 9, 100):
        genes = spark.createDataFrame([(g,) for g in range(n_genes)] * 2, "gene long")
        annotated = spark.createDataFrame([(g,) for g in range(0, n_genes + 5, 3)], "gene long")
        order = [g for _, g in sorted((int(hashlib.md5(f"42|ring|{g}".encode()).hexdigest()[:8], 16), g) for g in range(n_genes))]
        want = []
        for i, g in enumerate(order):
            place = bad = 0
            for step in range(1, min(15, n_genes)):
                d = order[(i + step) % n_genes]
                place, bad = place + (d % 3 == 0), bad + (d % 3 != 0)
                if d % 3 == 0 and place <= 3 and bad <= 10:
                    want.append((g, d, place, bad))
        for block in (16, 1 << 14):
            got = sampling.distractor_genes(genes, annotated, block_rows=block)
            assert rows(got, "gene", "donor", "place", "redraws") == sorted(want)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "_at" not in "".join(line for line in plan.splitlines() if "Join" in line and "_pid" not in line)
