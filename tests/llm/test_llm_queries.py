"""The registered queries against SQL, brute force, exact round trips and held-out accuracy."""

import collections
import glob
import hashlib
import os
import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from enrichspark.llm import decontaminate, langid, near, pieces, quality, queries, repeats, toxicity
from enrichspark.llm.lines import PerfectHash
from enrichspark.llm.packing import CAPACITY, class_sizes, cuts, solve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(cur.fetchall())


# -- decontamination
def least_distance(pattern, text):
    """Edit distance of pattern to the best substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_matcher_against_full_table():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.integers(3, 22)))) for i in range(12)]
    found = 0
    for _ in range(60):
        i = int(rng.integers(len(items)))
        t = list(items[i][1])
        for _ in range(rng.integers(0, max(2, len(t) // 7))):
            at = int(rng.integers(len(t)))
            t[at:at + 1] = [] if rng.random() < 0.3 else [str(rng.choice(list("abcde ")))] * int(rng.integers(1, 3))
        doc = " ".join(word() for _ in range(5)) + " " + "".join(t) + " " + " ".join(word() for _ in range(5))
        n = decontaminate.normal(doc)
        want = []
        for k, text in items:
            p = decontaminate.normal(text)
            e = decontaminate.budget(p)
            d = least_distance(p.strip() if e else p, n)
            if d <= e:
                want.append((k, d))
        found += len(want)
        assert [(k, d) for k, d, *_ in decontaminate.Matcher(items).find(doc)] == want
    assert found > 20


# -- packing
def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op2_packing(spark, SF).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    total = 0
    for d, parts in docs.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert total / CAPACITY / len(seqs) > 0.95


def test_cutting_stock_covers_demand_exactly():
    sizes, rng = class_sizes(), np.random.default_rng(2)
    for lengths in (np.full(5000, 700), rng.integers(1, 5000, 3000), np.full(9, 1)):
        demand = np.bincount(np.searchsorted(sizes, [n for k in lengths for _, n in cuts(int(k))]), minlength=len(sizes))
        patterns = solve(sizes, demand)
        assert (sum(c * n for c, n in patterns) == demand).all()
        assert all((c * sizes).sum() <= CAPACITY for c, _ in patterns)
        assert sum(n for _, n in patterns) <= 1.02 * (demand * sizes).sum() / CAPACITY + 2


# -- repeats
@pytest.mark.parametrize("hot", [1, 400])
def test_repeats_against_all_windows(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats.repeat_ranges, "__defaults__", (repeats.LENGTH, repeats.K, hot))
    n = repeats.LENGTH
    data = {d: (t or "").encode() for d, t in texts.items()}
    seen = collections.Counter(t[i:i + n] for t in data.values() for i in range(len(t) - n + 1))
    rows = queries.op4_repeats(spark, SF).collect()
    assert len(rows) == len(data)
    for r in rows:
        t = data[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_interval_expansion_against_counts():
    rng = np.random.default_rng(0)
    for length in (3, 8, 20):
        for _ in range(25):
            t = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(length, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
            c = collections.Counter(x[i:i + length] for x in t for i in range(len(x) - length + 1))
            for x, mask in zip(t, repeats.repeated_starts(t, length)):
                assert mask.tolist() == [c[x[i:i + length]] > 1 for i in range(len(x) - length + 1)]


# -- near-duplicates
def bags(texts):
    out = {}
    for d, t in texts.items():
        data = np.frombuffer((t or "").encode(), np.uint8)
        out[d] = collections.Counter(near.shingles(data, np.array([0, len(data)]))[0].tolist())
    return out


def groups(texts):
    bag = bags(texts)
    where = collections.defaultdict(list)
    for d, c in bag.items():
        for h in c:
            where[h].append(d)
    both = collections.Counter()
    for h, ds in where.items():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                both[a, b] += min(bag[a][h], bag[b][h])
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for (a, b), n in both.items():
        if n / (sum(bag[a].values()) + sum(bag[b].values()) - n) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_near_duplicates_against_all_pairs(spark, texts):
    assert {r.doc_id: r.group_id for r in queries.op9_minhash(spark, SF).collect()} == groups(texts)


def test_near_links_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near, "TILE", 4)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {}
    for d in range(40):  # a chain: each differs a little more from the first
        t = list(base)
        for k in range(d // 4):
            t[(7 * k) % 120] = f"x{k}"
        texts[d] = " ".join(t) + f" end{d}"
    got = {r.doc_id: r.group_id for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == groups(texts)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = [f"w{i}" for i in rng.integers(0, 40, 400)]
    b = a[:300] + [f"w{i}" for i in rng.integers(0, 40, 80)]

    def sig(words):
        d = np.frombuffer(" ".join(words).encode(), np.uint8)
        return near.signatures(*near.shingles(d, np.array([0, len(d)]), 1), m=4000)
    ca, cb = collections.Counter(a), collections.Counter(b)
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((sig(a) == sig(b)).mean() - want) < 0.03


# -- language
def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    m = langid.BiGru.new(["a", "b", "c"], hidden=3)
    x, y = rng.integers(97, 103, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = m.gradient(x, y)
    for name in m.p:
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in m.p[name].shape)
            if name[0] == "E":
                at = (int(x[0, 0]), at[1])
            old, loss = m.p[name][at], []
            for step in (1e-5, -1e-5):
                m.p[name][at] = old + step
                loss.append(m.gradient(x, y)[0])
            m.p[name][at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[name][at]) < 1e-6


def test_windows_label_like_the_whole_text():
    rng = np.random.default_rng(1)
    m = langid.BiGru.new(["a", "b"])
    data, offsets = rng.integers(97, 123, 300).astype(np.uint8), np.array([0, 0, 120, 300])
    got = m.pool(data, offsets)
    for i in (1, 2):
        x = data[offsets[i]:offsets[i + 1]][None]
        both = np.concatenate([m._scan(x, "f")[0], m._scan(x, "b")[0]], axis=2)[:, 0]
        q = both @ m.p["W"] + m.p["c"]
        q -= np.log(np.exp(q).sum(axis=1, keepdims=True))
        p = np.exp(q.sum(axis=0) / langid.EVIDENCE)
        assert np.allclose(got[i], p / p.sum(), atol=1e-3)


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96


# -- classifiers
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    ok = np.mean([r.predicted == r.quality for r in rows])
    assert ok > np.mean([r.quality for r in rows]) + 0.05


def test_co_training_uses_both_views():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 900)
    views = tuple(np.c_[y[:, None] * 1.5 + rng.normal(size=(900, 1)), rng.normal(size=(900, 3))] for _ in range(2))
    m = quality.co_train(tuple(v[:80] for v in views), y[:80].astype(float), tuple(v[80:500] for v in views), 0.5, handed=40)
    p = m.probability(views[0][500:], views[1][500:])
    alone = [((f.odds(v[500:]) > 0) == y[500:]).mean() for f, v in zip(m.views, views)]
    assert ((p > 0.5) == y[500:]).mean() > max(alone)


def naive_kernel(s, t, n, decay):
    """Sum over pairs of index tuples of equal letters, by the definition."""
    from itertools import combinations
    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel_against_definition():
    words = [b"idiot", b"idxiot", b"banana", b"ban", b"toidi", b"bandana"]
    for s in words:
        for t in words:
            got = toxicity.raw_kernel(toxicity.pieces([s])[0], np.frombuffer(t.ljust(9, b"\xff"), np.uint8)[None], 3, 0.6)[0]
            assert abs(got - naive_kernel(s, t, 3, 0.6)) < 1e-5


def test_toxicity_finds_gapped_words():
    rng = np.random.default_rng(6)
    syllables = ["the", "er", "in", "on", "at", "es", "ing", "or", "ha", "ti"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bad = ["idiot", "stupid", "worthless", "pathetic", "clown"]
    def doc(toxic):
        w = [word() for _ in range(80)]
        for k in rng.choice(80, 4 if toxic else 0, replace=False):
            w[k] = str(rng.choice(bad))
        return " ".join(w) + "."
    y = [i % 4 == 0 for i in range(400)]
    m = toxicity.learn([(doc(t), int(t)) for t in y], 0.25)

    def probability(text):
        import pyarrow as pa
        b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
        return next(iter(toxicity._score(m)(iter([b])))).column("score")[0].as_py()
    clean = [probability(doc(False)) for _ in range(40)]
    assert max(clean) < 0.5
    for insult in ("you idiot and clown", "i d i o t and p-a-t-h-e-t-i-c", "wort*hless st.upid"):
        assert probability(doc(False) + " " + insult) > 0.7, insult
    # letters put into a word lower its score, but leave it above all clean texts
    for insult in ("you idxiot and stuupid", "clowxn idioot"):
        assert probability(doc(False) + " " + insult) > max(clean), insult


# -- perfect hash and pipeline
def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000)).astype(np.uint64)
    h = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert h.index(keys[:0]).tolist() == [] and PerfectHash.build(keys[:0]).index(keys).tolist() == [-1] * len(keys)


def test_pipeline_against_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], SF).cache())
    one, two, three, four = ({r.doc_id: r.text for r in t.collect()} for t in tables[1:])
    assert all(any(c.isalpha() for c in t) for t in one.values())
    assert len(one) >= 0.98 * sum(any(c.isalpha() for c in t or "") for t in texts.values())
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower()
    held = collections.Counter(k for t in one.values() for k in {key(x) for x in t.split("\n")})
    assert two == {d: "\n".join(x for x in t.split("\n") if not key(x) or held[key(x)] < 10) for d, t in one.items()}
    assert set(three) == set(groups(two).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, t in three.items() if any(decontaminate.normal(i).strip() in decontaminate.normal(t) for _, i in items)}
    assert exact and not exact & set(four)
    m = decontaminate.Matcher(items)
    assert set(four) == {d for d, t in three.items() if not m.find(t)}
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(four)


# -- SentencePiece
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_against_library(library):
    model, rng = pieces.load(), random.Random(5)
    vocabulary = [p.replace(pieces.SPACE, " ") for p in model.ids]
    kinds = ["ab ", "aaaa  ", "the in er", " \n\tx", "▁ a", "éñ漢字 ", "abcdefghijklmnopqrstuvwxyz     ", "ααβ 😀\u0000", "0123 .,-=()[]{}<>_/'\""]
    for k in range(6000):
        alphabet = rng.choice([*kinds, "".join(kinds)])
        text = "".join(rng.choice(vocabulary if k % 4 == 0 else alphabet) for _ in range(rng.randrange(40)))
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(270) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == library.decode(ids)
    for text in ("", " ", "x" * 30_000, " " * 5000, "ab" * 20_000, "\n" * 3000, "<s></s><0x41>"):
        assert model.encode(text) == library.encode(text)


def test_pair_rule_against_merging():
    model, rng = pieces.load(), random.Random(7)
    known = list(model.rank)
    for _ in range(4000):
        u, v = rng.choice(known[:3000]), rng.choice(known[:3000])
        want = model._merge(model.pieces[u] + model.pieces[v])[0] == [model.pieces[u], model.pieces[v]]
        alone = all(model._merge(model.pieces[i])[0] == [model.pieces[i]] for i in (u, v))
        assert not alone or model.may_follow(u, v) == want


def test_sentencepiece_against_library(spark, texts, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op11_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_sentencepiece_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x  y\n", "b"), (3, "▁a b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.round_trip(docs, ("doc_id", "ids")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.same) for r in out) == [("1", 0, True), ("1", 0, True), ("2", 0, True), ("3", 3, False), ("None", 4, True)]
    back = pieces.decode(pieces.encode(docs.filter("doc_id is null or doc_id = 2"))).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == [("2", ""), ("None", "x  y\n")]
    assert pieces.round_trip(docs.limit(0)).count() == 0
