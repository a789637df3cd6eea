"""Lexical search and tokenizer alignment against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from enrichspark.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    split = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    size, length = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = collections.Counter(t for _, ts in split for t in set(ts))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, ts in split:
            n, tf = len(ts), collections.Counter(ts)
            m = 25 + (75 * n * size) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(LOW)) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda r: r[:3])
        out += [(item_id, k + 1, r[3], -r[0]) for k, r in enumerate(scored[:top])]
    return out


def test_varints():
    rng = np.random.default_rng(0)
    v = np.r_[0, 1, 127, 128, 16383, 16384, 2**31, 2**40, rng.integers(0, 1 << 20, 500)]
    raw, off = search.pack(v)
    assert (search.unpack(raw) == v).all() and off[-1] == len(raw)
    assert (search.unpack(raw[off[3]:off[6]]) == v[3:6]).all()


@pytest.mark.parametrize("setting", [{}, {"shard_terms": 60}, {"shard_terms": 300, "query_bytes": 200}, {"vocabulary_bytes": 0, "shard_terms": 900}])
def test_search_against_brute_force(spark, setting):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["Ünder", "ünder", "é", "漢字", "A1", "a1"]
    text = lambda k: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(k)))
    docs = [(rng.randrange(200), text(40)) for _ in range(220)] + [(None, text(30)), (None, "w1 w2 w3"), (7, None), (8, ""), (9, "... --"), (1, "x " * 3000)]
    docs += [docs[3]] * 4 + [(i, "same words here w1 w2") for i in range(300, 330)]
    items = [(i, text(25)) for i in range(40)] + [(50, None), (51, ""), (52, "unheard"), (None, "w1 w1 w2"), (53, "w1 W2 same"), (53, "w1 W2 same"), (54, "x")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, shard int").repartition(3)
    got = search.rank(frame, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int"), **setting)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_search_prunes_without_unpacking(spark):
    """A common word next to a rare one: most of its blocks stay packed."""
    n = np.full(20_000, 10, np.int64)
    terms = np.r_[np.zeros(20_000, np.int64), np.full(40, 1)]
    docs = np.r_[np.arange(20_000), np.arange(40) * 7]
    rows = search._lists(0, [b"common", b"rare"], terms, docs, n).to_pylist()
    m_of = lambda x: 25 + (75 * x) // 10
    common, rare = (search._List(r, m_of, m_of(n)) for r in rows)
    got = search.best([(1, common), (9000, rare)], len(n), np.arange(len(n)), 10)
    assert [d for d, _ in got] == [7 * i for i in range(10)] and len(common.open) < 10


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.rank(docs.limit(0), items).count() == 0
    assert search.rank(docs, items.limit(0)).count() == 0
    assert search.rank(docs.withColumn("text", docs.text.substr(9, 1)), items).count() == 0
    assert [tuple(r) for r in search.rank(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])


# -- tokenizer alignment
def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, by the libraries alone."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    spell = {}  # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        spell[chr(b) if b in shown else chr(256 + sum(c not in shown for c in range(b)))] = b
    raw_a = lambda i: bytes(spell[c] for c in tok.id_to_token(i))
    raw_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], collections.Counter()
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(raw_a, a)) != whole or b"".join(map(raw_b, b)) != whole:
            a, b = [], []
        ends_a, ends_b = (dict(zip(np.cumsum([len(f(i)) for i in x]).tolist(), range(len(x)))) for f, x in ((raw_a, a), (raw_b, b)))
        groups, links, x, y = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
            links.append((b[j], a[i]))
            x, y = i + 1, j + 1
        counts.update(links)
        out.append((len(a), len(b), links, ";".join(groups)))
    top = collections.Counter()
    for (b, _), n in counts.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(k), len(k), sum(counts[p] == top[p[0]] for p in k), sum(counts[p] for p in k), g) for n_a, n_b, k, g in out]


@pytest.mark.parametrize("setting", [{}, {"run_links": 40, "part_bytes": 500, "split_records": 30}])
def test_alignment_against_libraries(spark, setting):
    from enrichspark.llm import align
    rng = random.Random(9)
    alphabets = ["the of in and er ", "ab  \n", "éñ漢字 .,x", "0123 -+", "<|endoftext|> <s> "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["<|endoftext|> and <s>", None, "", "▁ here", " ", "x" * 3000, "Hello, world! " * 40, "a\x00b", "😀 é"] + ["same text here"] * 5
    frame = spark.createDataFrame([(i // 2, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, run string").repartition(3)
    rows = align.align(frame, **setting)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = [(i // 2, *w) for i, w in enumerate(brute_alignment(texts))]
    got = rows.collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == sorted(want)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got)


def test_alignment_query(spark):
    from enrichspark.llm import queries
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: w for (d, _), w in zip(texts, brute_alignment([t for _, t in texts]))}
    rows = queries.op12_alignment(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *numbers, groups = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_of_nothing(spark):
    from enrichspark.llm import align
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = align.align(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_a, r.count_sum, r.groups_sha256) for r in only) == [("1", 0, 0, ""), ("None", 0, 0, "")]
