"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import math
import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from enrichspark.llm import decontaminate, embeddings, langid, lines, near, packing, quality, repeats, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, score double, hits string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, long_text), (5, "One two three four five six seven."), (5, "One two three four five six seven."),
        (None, "No id here, but some words for it."), (None, None), (6, "?!.. 123 --"), (7, "one two three four five six seven"), (8, "short"),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None if t is None else len(t), 3, 0.5, "h", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(docs, result, *cols):
    return sorted((tuple(r[c] for c in cols) for r in result.collect()), key=str)


def test_lines(odd, none):
    got = lines.drop_lines(odd, min_docs=3).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_lines == 1 and by[1][0].n_dropped == 0 and by[3][0].n_lines == 3 and by[3][0].n_dropped == 0
    assert len(by[5]) == 2 and all(r.n_dropped == 0 for r in by[5])  # two rows, and another key in row 7
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    assert [r.n_dropped for r in lines.drop_lines(odd, min_docs=2).filter("doc_id = 5").collect()] == [1, 1]
    assert lines.drop_lines(none).count() == 0


def test_lines_that_end_in_a_unicode_line_break(spark):
    ends = (" \u2028", "\u2028", " \u0085", " \u2029", " ")
    shared = [f"a line that many share{e}" for e in ends]
    docs = spark.createDataFrame([(i, f"own line number {i}\n{shared[i % 5]}") for i in range(18)], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in lines.drop_lines(docs, min_docs=4).collect()}
    # ends 0 to 2 are in four documents each, 3 and 4 in three
    assert got == {i: (1, f"own line number {i}") if i % 5 < 3 else (0, f"own line number {i}\n{shared[i % 5]}") for i in range(18)}


def test_near(odd, none):
    got = near.near_duplicates(odd)
    rows = sorted((r.doc_id, r.group_id, r.kept) for r in got.collect() if r.doc_id is not None)
    assert [r for r in rows if r[0] in (5, 7)] == [(5, 5, True), (5, 5, True), (7, 5, False)]
    assert all(g == d and k for d, g, k in rows if d not in (5, 7))
    assert [r.kept for r in got.collect() if r.doc_id is None] == [True, True]
    assert near.near_duplicates(none).count() == 0


def test_repeats(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == 11
    assert {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.n_removed == 0 for r in got if r.doc_id not in (4,))
    assert repeats.remove_repeats(none).count() == 0


def test_packing(odd, none):
    got = packing.pack(odd).collect()
    whole = {}
    for r in got:
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert (None, 1) in whole and (1, 1) in whole and (2, 1) in whole
    assert len(whole[4, max(n for d, n in whole if d == 4)]) > 10
    assert sum(r.length for r in got if r.doc_id == 5) == sum({n for d, n in whole if d == 5}) * 2
    assert packing.pack(none).count() == 0


def test_leaks(spark, odd, none):
    items = spark.createDataFrame([(1, "ONE two, three four five six seven"), (2, None), (3, ""), (None, "some words for it"), (1, "ONE two, three four five six seven")],
                                  "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(odd, items).collect()]
    assert sorted(got, key=str) == sorted([(5, 1, 0)] * 4 + [(7, 1, 0)] * 2 + [(None, None, 0)], key=str)
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(odd, items).columns == [c for c in odd.columns if c != "hits"] + ["hits"]


def test_language(spark, odd, none):
    model = langid.BiGru.new(["de", "en"])
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1, None] == ("und", 0.0) and got[2, ""] == ("und", 0.0) and got[6, "?!.. 123 --"] == ("und", 0.0)
    assert got[8, "short"][0] in ("de", "en") and 0 <= got[8, "short"][1] <= 1
    assert langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(none).count() == 0 and langid.identify(odd).count() == 11


def test_short_clean_texts_stay(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = {"en": ["A.", "The.", "This.", "In. The."], "fr": ["De.", "Avec.", "Pour la."], "de": ["Von.", "Die.", "Die tz."], "es": ["Los.", "Para.", "Para la."]}
    rows = [(10**9 + i, t, k, "s", len(t)) for i, (k, t) in enumerate((k, t) for k, ts in short.items() for t in ts)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    more = more.select(*(more[c].cast(t) for c, t in docs.dtypes))
    model = langid.train(docs)
    monkeypatch.setattr(langid, "train", lambda d: model)
    stay = {r.text for r in corpus_pipeline.identify_language(spark, more, "").collect()}
    assert stay == {r[1] for r in rows}
    assert any(r.score < corpus_pipeline.MIN_LANGUAGE_SCORE for r in langid.predict(more, model).collect())

    made = spark.createDataFrame([(1, "en", 0.4, 1.2), (2, "en", 0.4, 0.9), (3, "en", 0.9, 0.5), (4, "und", 0.0, 0.0)], "doc_id long, lang_pred string, score double, lang_lift double")
    monkeypatch.setattr(langid, "predict", lambda d, m, lift: d.join(made, "doc_id"))
    some = spark.createDataFrame([(i, "en") for i in range(1, 5)], "doc_id long, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, some, "").collect()) == [1, 3]


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (8, 0, 0), (None, 1, 1), (7, None, 2), (4, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        got = f(odd, labels)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = got.collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert f(none, labels).count() == 0 and f(odd, labels.limit(0)).count() == 11
        assert f(odd.select("doc_id", "text"), labels).count() == 11


def test_warc(spark):
    big = "x" * 1200
    rows = [(1, "http://a/", big), (3, "http://b/", big), (3, "http://b/", big), (2, None, None), (None, "u\r\nv", big), (4, "http://c", "small"), (5, "http://c", "small"),
            (6, "http://d", "a\r\n\r\nWARC/1.1\r\nb" + big), (None, None, "")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, copy int, kind string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = h == big and p != 3
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_and_nesting(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\n</p>"), (2, "http://b/", "")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    a = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert sorted(bytes(r.response.payload).decode() for r in a) == ["", "<p>é\r\n\r\n</p>"]
    assert all(r.request is not None and r.metadata.fields["pageId"] in ("1", "2") for r in a)


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1),
            (9, [nan, 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [0.0, 1.0], 1), (12, [1e30, 1e28], 1)]
    v = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.dedup(v).collect()}
    assert len(got) == 13
    for i in (1, 2, 3, 12):
        assert got[i] == (3, 1, i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert embeddings.dedup(v.limit(0)).count() == 0
    assert embeddings.dedup(v.filter("embedding is null")).count() == 1


def test_embedding_tiles_count_each_link_once(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=16)
    x = np.vstack([base + 0.1 * g.normal(size=(150, 16)), g.normal(size=(100, 16))]).astype(np.float32)
    v = spark.createDataFrame([(i, [float(e) for e in r], i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    got = {r.vec_id: r.n_links for r in embeddings.dedup(v, tile=32).collect()}
    assert [got[i] for i in range(len(x))] == link.sum(axis=1).tolist()


def brute_components(x, ids, labels, cosine=0.93):
    """{id: (n_links, component_id, kept)} over all pairs."""
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= cosine) & ~np.eye(len(u), dtype=bool) & (np.array(labels)[:, None] == np.array(labels))
    comp = np.array(ids)
    while (new := np.minimum(comp, np.where(link, comp, comp.max()).min(axis=1))).tolist() != comp.tolist():
        comp = new
    return {i: (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp)}


def arc(degrees):
    return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]


def test_embedding_chains(spark):
    # neighbours 15 degrees apart link, others don't; each chain has a direction and a label of its own
    chains = [(1, 5, 2), (11, 15, 16, 12), (29, 21, 28, 22, 27, 23), tuple(range(40, 60, 2)) + tuple(range(41, 60, 2))]
    ids, x, labels = [], [], []
    for k, chain in enumerate(chains):
        ids += chain
        x += arc(15 * i for i in range(len(chain)))
        labels += [k] * len(chain)
    v = spark.createDataFrame(list(zip(ids, x, labels)), "vec_id long, embedding array<float>, label int")
    want = brute_components(x, ids, labels)
    assert want[2] == (1, 1, False) and want[12] == (1, 11, False)
    for tile in (512, *range(2, 9)):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.dedup(v, tile=tile).collect()} == want


def test_smallest_of_components():
    g = np.random.default_rng(3)
    for n in (2, 17, 300):
        ids = g.permutation(10 * n)[:n]
        for links in (1, n // 2, 2 * n):
            i, j = g.integers(0, n, links), g.integers(0, n, links)
            want = ids.copy()
            for _ in range(n):
                for a, b in zip(i, j):
                    want[a] = want[b] = min(want[a], want[b])
            assert embeddings._smallest(ids, i, j).tolist() == want.tolist()
    path = np.r_[np.arange(0, 1000, 2), np.arange(999, 0, -2)]
    assert (embeddings._smallest(path, np.arange(999), np.arange(1, 1000)) == 0).all()


def test_stages_keep_columns(spark, odd, none, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "nothing of this is in any of the documents at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        kept.append(out.count())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert kept[1:] == [11, 10, 11] and kept[0] <= 7  # five rows have no letters
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_held_out_matches_crc(odd):
    for r in toxicity.score(odd, None).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)


def test_embedding_classes_keep_labels_apart(spark):
    """An id under two labels brings only its own vector into a label; widths have links of their own."""
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(1, at(0), 0), (1, at(15), 1), (2, at(30), 0), (3, at(200), 0)]
    schema = "vec_id long, embedding array<double>, label int"
    got = embeddings.dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    wide = [(i, [*at(40 * (i % 5)), 0.0], i % 2) for i in range(10, 40)] + [(90, [5.0, 5.0, 5.0], 0), (91, [5.0, 5.0, 5.0], 0), (92, [0.0, 0.0, 0.0], 0)]
    narrow = [(i, at(25 * i), i % 2) for i in range(40, 60)]
    rows = [*wide, *narrow]
    want = {}
    for i, x, k in rows:
        near = [j for j, y, m in rows if j != i and m == k and len(x) == len(y) and any(x) and any(y)
                and np.dot(x, y) >= 0.93 * np.linalg.norm(x) * np.linalg.norm(y)]
        want[i] = len(near)
    for tile in (4, 512):
        assert {r.vec_id: r.n_links for r in embeddings.dedup(spark.createDataFrame(rows, schema), tile=tile).collect()} == want
