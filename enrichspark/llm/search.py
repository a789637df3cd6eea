"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max MaxScore.

A task numbers its documents within a shard and writes one row per shard and term: postings in blocks, packed as
gaps and frequencies, and for every block what bounds its scores without unpacking it. Corpus statistics are sums over
these rows. A query takes its lists of a shard in the order of their greatest scores. Lists that together stay below
the score to beat name no candidates (they aren't essential); a candidate of the others looks them up only where its score, the
bound of its block there and the bounds of the lists still to come reach that score, so that most blocks stay packed. Every shard
keeps a heap of the best per query, and the heaps are merged.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from enrichspark.llm.common import pack, partitions_for, unpack
from enrichspark.session import materialize

TOP = 10
BLOCK = 128
#: A shard closes after so many term occurrences or documents.
SHARD_TERMS, SHARD_DOCS = 4_000_000, 1 << 16
#: Query sets are searched in blocks of this size; one up to VOCABULARY_BYTES has its terms alone indexed.
QUERY_BYTES, VOCABULARY_BYTES = 4 << 20, 16 << 20
#: Widths of the first and the largest window of documents that a query scores at once.
WINDOW, WIDEST = 128, 8192
#: Bytes of a term in lower case; any other byte is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
POSTINGS = "shard long, term string, df long, last binary, caps binary, at binary, data binary"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


class _Names(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _lists(shard: int, names: list[bytes], terms: np.ndarray, docs: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard: terms and docs are the numbers of term and document of every occurrence."""
    key, tf = np.unique(terms.astype(np.int64) << 32 | docs, return_counts=True)
    term, doc = key >> 32, key & 0xFFFFFFFF
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(key) else np.zeros(0, np.int64)
    df = np.diff(np.r_[first, len(key)])
    within = np.arange(len(key)) - np.repeat(first, df)
    head = np.flatnonzero(within % BLOCK == 0)  # first posting of each block
    gap = np.diff(doc, prepend=0)
    gap[head] = doc[head]
    data, off = pack(np.c_[gap, tf].ravel())
    begin = off[2 * head]
    # what bounds a block: the shortest document with the term once, the highest frequency else and the shortest document of those
    n, many = lens[doc], tf > 1
    far = np.iinfo(np.int64).max
    low1 = np.minimum.reduceat(np.where(many, far, n), head) if len(head) else np.zeros(0, np.int64)
    low2 = np.minimum.reduceat(np.where(many, n, far), head) if len(head) else np.zeros(0, np.int64)
    high = np.maximum.reduceat(tf, head) if len(head) else np.zeros(0, np.int64)
    last = doc[np.r_[head[1:], len(key)] - 1] if len(head) else np.zeros(0, np.int64)
    blocks = np.r_[0, np.cumsum(-(-df // BLOCK))]  # first block of each list
    ends = np.r_[begin, off[-1]]
    local = begin - np.repeat(begin[blocks[:-1]], np.diff(blocks)) if len(head) else begin  # from the start of its list
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), shard, np.int64)), pa.array([names[t].decode() for t in term[first]], pa.string()), pa.array(df, pa.int64()),
         _binary(last.astype("<i4"), 4 * blocks), _binary(np.c_[low1, high, low2].astype("<i8"), 24 * blocks),
         _binary(local.astype("<i4"), 4 * blocks), _binary(data, ends[blocks])],
        names=["shard", "term", "df", "last", "caps", "at", "data"])


def _build(vocabulary: list[bytes] | None, shard_terms: int):
    known = None if vocabulary is None else {t: i for i, t in enumerate(vocabulary)}

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        names = _Names() if known is None else known
        terms, lens, ids = [], [], []
        total = 0

        def flush():
            shard = task << 24 | seq
            flat = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            docs = np.repeat(np.arange(len(lens)), [len(t) for t in terms])
            n = np.array(lens, np.int64)
            lists = _lists(shard, list(names), flat, docs, n)
            none = [pa.nulls(lists.num_rows, t) for t in (pa.binary(), pa.list_(id_type))]
            yield pa.RecordBatch.from_arrays([*lists.columns, *none], names=[*lists.schema.names, "lens", "ids"])
            row = [pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), pa.array([int((n > 0).sum())], pa.int64()), *[pa.nulls(1, pa.binary())] * 4,
                   pa.array([n.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), pa.concat_arrays(ids))]
            yield pa.RecordBatch.from_arrays(row, names=[*lists.schema.names, "lens", "ids"])

        for b in batches:
            id_type, start = b.column(0).type, 0
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if known is None:
                    found = np.fromiter(map(names.__getitem__, words), np.int32, len(words))
                else:
                    found = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                    found = found[found >= 0]
                terms.append(found)
                lens.append(len(words))
                total += len(found)
                if total >= shard_terms or len(lens) >= SHARD_DOCS:
                    ids.append(b.column(0).slice(start, i + 1 - start))
                    yield from flush()
                    terms, lens, ids, total, start, seq = [], [], [], 0, i + 1, seq + 1
                    names = _Names() if known is None else known
            ids.append(b.column(0).slice(start))
        if lens:
            yield from flush()
    return run


def index(docs: DataFrame, vocabulary: list[bytes] | None = None, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of docs(doc_id, text): a row per shard and term, and one per shard with term null, lengths and ids.

    vocabulary, if given, names the only terms that get lists; lengths count all terms. Written once, in the shared folder.
    """
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return materialize(src.mapInArrow(_build(vocabulary, shard_terms), f"{POSTINGS}, lens binary, ids array<{kind}>"), "index")


class _List:
    """One postings list of a shard under the corpus statistics."""

    def __init__(self, row: dict, m_of, m: np.ndarray):
        self.last = np.frombuffer(row["last"], "<i4")
        self.at = np.r_[np.frombuffer(row["at"], "<i4"), len(row["data"])]
        self.data, self.m = np.frombuffer(row["data"], np.uint8), m
        once, high, many = np.frombuffer(row["caps"], "<i8").reshape(-1, 3).T
        far = np.iinfo(np.int64).max
        self.caps = np.maximum(np.where(once < far, gain(1, m_of(np.where(once < far, once, 0))), 0),
                               np.where(many < far, gain(high, m_of(np.where(many < far, many, 0))), 0))
        self.cap = int(self.caps.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, gains) of a block, unpacked on first use."""
        got = self.open.get(b)
        if got is None:
            gap, tf = unpack(self.data[self.at[b]:self.at[b + 1]]).reshape(-1, 2).T
            doc = np.cumsum(gap)
            got = self.open[b] = doc, gain(tf, self.m[doc])
        return got

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents from lo up to hi."""
        a, b = int(np.searchsorted(self.last, lo)), int(np.searchsorted(self.last, hi - 1))
        parts = [self.block(k) for k in range(a, min(b + 1, len(self.last)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, g = (np.concatenate(p) for p in zip(*parts))
        x, y = np.searchsorted(doc, (lo, hi))
        return doc[x:y], g[x:y]

    def look_up(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Gains of docs, each in its block, 0 where it isn't in the list."""
        doc, g = (np.concatenate(p) for p in zip(*(self.block(int(b)) for b in np.unique(block))))
        x = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
        return np.where(doc[x] == docs, g[x], 0)


def gain(tf, m):
    """What a term adds to a score per unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best(lists: list[tuple[int, _List]], n: int, order: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(document, score) of the top highest scores above 0 among n documents; ties by order. lists holds (weight, list)."""
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda p: p[0] * p[1].cap)
    bound = np.cumsum([w * x.cap for w, x in lists])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lo, width = 0, WINDOW
    while lo < n and lists:
        hi = min(n, lo + width)
        width = min(WIDEST, 2 * width)
        rest = int(np.searchsorted(bound, least))  # lists 0 .. rest - 1 together stay below the score to beat
        if rest == len(lists):
            break
        total = np.zeros(hi - lo, np.int64)
        for w, x in lists[rest:]:
            d, g = x.between(lo, hi)
            total[d - lo] += w * g
        cand = np.flatnonzero(total)
        score, cand = total[cand], cand + lo
        for i in range(rest - 1, -1, -1):
            w, x = lists[i]
            stay = score + bound[i] >= least
            score, cand = score[stay], cand[stay]
            if not len(cand):
                break
            block = np.searchsorted(x.last, cand)
            cap = np.where(block < len(x.last), w * x.caps[np.minimum(block, len(x.last) - 1)], 0)
            stay = score + cap + (bound[i - 1] if i else 0) >= least
            score, cand, block = score[stay], cand[stay], block[stay]
            inside = np.flatnonzero(block < len(x.last))
            if len(inside):
                score[inside] += w * x.look_up(cand[inside], block[inside])
        stay = (score >= least) & (score > 0)
        docs, scores = np.r_[docs, cand[stay]], np.r_[scores, score[stay]]
        first = np.lexsort((order[docs], -scores))[:top]
        docs, scores = docs[first], scores[first]
        if len(docs) == top:
            least = int(scores[-1])
        lo = hi
    return list(zip(docs.tolist(), scores.tolist()))


def _search(queries: list[tuple[int, list[tuple[str, int]]]], size: int, length: int, top: int):
    def run(shard: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        heads = [r for r in rows if r["term"] is None]
        n = np.frombuffer(heads[0]["lens"], np.int64)
        m_of = lambda x: 25 + (75 * x * size) // length
        m = m_of(n)
        lists = {r["term"]: _List(r, m_of, m) for r in rows if r["term"] is not None}
        ids = shard.filter(pc.is_null(shard["term"]))["ids"].combine_chunks().flatten()
        order = np.empty(len(n), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(n))  # nulls come last
        q, d, s = [], [], []
        for number, terms in queries:
            for doc, score in best([(w, lists[t]) for t, w in terms if t in lists], len(n), order, top):
                q.append(number)
                d.append(doc)
                s.append(score)
        return pa.table({"query": pa.array(q, pa.int64()), "doc_id": ids.take(pa.array(d, pa.int64())), "score": pa.array(s, pa.int64())})
    return run


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary_bytes: int = VOCABULARY_BYTES, query_bytes: int = QUERY_BYTES,
         shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of items(item_id, text) its top highest-scoring rows of docs(doc_id, text).

    Scores are sums of integers over an item's terms, repeats included; equal scores rank by ascending doc_id, null ids last. Only
    scores above 0 count, so an item without terms, or whose terms are in no document, gives no row. Null texts have no
    terms and don't count as documents. Repeated rows of either table each stand for themselves; extra columns are ignored. Either
    table empty: no row. items is the stated query set, taken in blocks of query_bytes, each a pass over the lists of its terms.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    items = items.select("item_id", text.alias("text"))
    count, blocks = partitions_for(items, target=query_bytes)
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.select("doc_id").schema, *items.schema]}
    none = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    if not count:
        return none
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    small = blocks * query_bytes <= max(vocabulary_bytes, query_bytes) and vocabulary_bytes > 0
    vocabulary = sorted({t for r in items.select("text").collect() for t in terms_of(r.text)}) if small else None  # of up to vocabulary_bytes
    built = index(docs, vocabulary, shard_terms)
    # lengths are below 2^31 terms a shard's document; sums over all of them are made on the executors
    heads = built.filter("term is null")
    totals = heads.mapInArrow(_totals, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    size, length = int(totals[0] or 0), int(totals[1] or 0)
    if not length:
        return none
    counts = built.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    out = []
    for b in range(blocks):
        block = sorted(((r.item_id, r.text) for r in items.filter(part == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        asked = sorted({t.decode() for _, x in block for t in terms_of(x)})
        if not asked:
            continue
        names = spark.createDataFrame([(t,) for t in asked], "term string")
        df = {r.term: r.df for r in counts.join(names, "term", "left_semi").collect()}  # the terms of one block
        weight = {t: int(np.floor(1000 * np.log((2.0 * size + 2) / (2.0 * n + 1)))) for t, n in df.items()}
        queries = []
        for number, (_, x) in enumerate(block):
            found: dict[str, int] = {}
            for t in terms_of(x):
                if (name := t.decode()) in weight:
                    found[name] = found.get(name, 0) + weight[name]
            queries.append((number, sorted(found.items())))
        lists = built.join(names, "term", "left_semi").unionByName(heads.select(*built.columns))
        heaps = lists.groupBy("shard").applyInArrow(_search(queries, size, length, top), f"query long, doc_id {kinds['doc_id']}, score long")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        named = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"query long, item_id {kinds['item_id']}")
        out.append(heaps.withColumn("rank", place).filter(F.col("rank") <= top).join(named, "query").select("item_id", "rank", "doc_id", "score"))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0] if out else none


def _totals(batches):
    """(documents with terms, terms) of each shard."""
    for b in batches:
        n = [np.frombuffer(x, np.int64) for x in b.column(b.schema.get_field_index("lens")).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())],
                                         names=["n", "size"])
