"""MinHash near-dedup of texts as multisets of word shingles, with BagMinHash signatures.

Every shingle with its count drives Poisson processes over the levels of its weight: one process for level 0 and one
for each doubling of the level above it, whose points are thinned by their level, so that a count of w sees exactly
the points below w. A point has a time and a slot, and a signature keeps the earliest time per slot. Two texts agree in
a slot with a probability that equals their weighted Jaccard similarity. Points are made only as far as a text needs
to fill its slots, about m log m of them.

Equal multisets are one class. Class representatives that agree in a band of slots are candidates and their
multiset overlap is verified. Members of a bucket are first compared with its smallest member; connected components follow,
and only buckets that still hold several components compare the members of different components: small
buckets as pairs made distinct over the bands, large ones in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import byte_view, chunks, components
from enrichspark.session import materialize

WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 25, 5
CHUNK = 1 << 20
SMALL_BUCKET = 32
TILE = 256

U64 = np.uint64
_rng = np.random.default_rng(77)
VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(U64) | U64(1)
COEF = _rng.integers(1, 2**63, WORDS, dtype=np.int64).view(U64) | U64(1)
BASE = 0x9E3779B97F4A7C15
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    IS_WORD[ord(_a):ord(_b) + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BYTE_VALUE = VALUE[LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of every word: a run of letters and digits of ASCII and of all other bytes from 128."""
    n = len(data)
    w = IS_WORD[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop] with ASCII in lower case, by prefix sums."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word."""
    starts, stops, doc = word_spans(data, offsets)
    return span_hashes(data, starts, stops), doc


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each text, offsets): the multiset of k-word shingles; a text of fewer words has one."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(docs + 1, np.int64)
    h, doc = word_hashes(data, offsets)
    words = np.bincount(doc, minlength=docs)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    off = np.r_[0, np.cumsum(count)]
    out = np.empty(off[-1], U64)
    long_ones = np.repeat(words >= k, count)
    if len(h) >= k:
        at = np.flatnonzero(doc[:len(h) - k + 1] == doc[k - 1:])
        out[long_ones] = sum(h[at + j] * COEF[j] for j in range(k))
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.r_[0, np.cumsum(words)][short]
        out[~long_ones] = sum(np.where(words[short] > j, h[np.minimum(first + j, len(h) - 1)] * COEF[j], U64(0)) for j in range(k)) + U64(1)
    out = mix(out)
    for a, b in zip(off[:-1][count > 1], off[1:][count > 1]):
        out[a:b].sort()
    return out, off


def occurrences(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For sorted multisets the number of equal values before each value."""
    at = np.arange(len(s))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[off[:-1][off[:-1] < len(s)]] = True
    return at - np.maximum.accumulate(np.where(new, at, 0))


def signatures(s: np.ndarray, off: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: texts x m earliest times; inf throughout for an empty multiset."""
    docs = len(off) - 1
    sig = np.full((docs, m), np.inf)
    total = np.diff(off)
    if not len(s):
        return sig
    occ = occurrences(s, off)
    doc = np.repeat(np.arange(docs), total)
    last = np.ones(len(s), bool)
    last[:-1] = occ[1:] == 0
    x, weight, d = s[last], occ[last] + 1, doc[last]
    streams = [(np.arange(len(x)), 0, 0, 1)]
    layer = 1
    while 2 ** (layer - 1) < weight.max():
        streams.append((np.flatnonzero(weight > 2 ** (layer - 1)), layer, 2 ** (layer - 1), 2 ** (layer - 1)))
        layer += 1
    el = np.concatenate([a for a, *_ in streams])
    low = np.repeat([a for _, _, a, _ in streams], [len(a) for a, *_ in streams])
    span = np.repeat([a for *_, a in streams], [len(a) for a, *_ in streams])
    seed = mix(x[el] + np.repeat(np.array([j for _, j, *_ in streams], U64), [len(a) for a, *_ in streams]) * U64(0xD1342543DE82EF95))
    d, weight = d[el], weight[el]

    def draw(seed):
        return -np.log(((seed >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)

    t = draw(seed) / span
    limit = np.where(total > 0, m * (math.log(m) + 0.6) / np.maximum(total, 1), 0.0)
    flat = sig.reshape(-1)
    live = np.arange(len(seed))
    while True:
        go = live[t[live] < limit[d[live]]]
        while len(go):
            r = mix(seed[go] ^ U64(0x5851F42D4C957F2D))
            slot = ((r >> U64(32)) * U64(m)) >> U64(32)
            level = low[go] + (((r & U64(0xFFFFFFFF)) * span[go].astype(U64)) >> U64(32)).astype(np.int64)
            ok = level < weight[go]
            np.minimum.at(flat, d[go[ok]] * m + slot[ok].astype(np.int64), t[go[ok]])
            seed[go] = mix(seed[go] + U64(0x9E3779B97F4A7C15))
            t[go] += draw(seed[go]) / span[go]
            go = go[t[go] < limit[d[go]]]
        lacking = np.isinf(sig).any(axis=1) & (total > 0)
        if not lacking.any():
            return sig
        limit[lacking] *= 1.4
        live = live[lacking[d[live]]]


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """texts x bands 64-bit hashes of rows slots each."""
    v = np.ascontiguousarray(sig).view(U64).reshape(len(sig), -1, rows)
    h = np.zeros(v.shape[:2], U64)
    for j in range(rows):
        h = mix(h * U64(31) + v[:, :, j])
    return h.view(np.int64)


def _sketch(batches):
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for a, b in chunks(offsets):
            s, off = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            full = np.flatnonzero(np.diff(off) > 0)
            if not len(full):
                continue
            sig = bands(signatures(s, off)[full])
            h = [xxhash.xxh3_128_intdigest(s[off[i]:off[i + 1]].tobytes()) for i in full]
            half = lambda v: pa.array(np.array([(x >> v) & (2**64 - 1) for x in h], U64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(full)), half(64), half(0), pa.array([r.tobytes() for r in sig.astype(">i8")], pa.binary())],
                names=["doc_id", "c1", "c2", "bands"])


def _bags(batches):
    """(doc_id, bag): the sorted 32-bit hashes of (shingle, occurrence), a set with the overlaps of the multiset."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for a, b in chunks(offsets):
            s, off = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            v = (mix(s + occurrences(s, off).astype(U64) * U64(0xD1342543DE82EF95)) >> U64(32)).astype(np.uint32) if len(s) else s.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([np.sort(v[i:j]).tobytes() for i, j in zip(off, off[1:])], pa.binary())], names=["doc_id", "bag"])


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    if min(len(x), len(y)) < MIN_OVERLAP_FLOOR * max(len(x), len(y)):
        return min(len(x), len(y)) / max(len(x), len(y))  # an upper bound, already too low
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return both / (len(x) + len(y) - both)


MIN_OVERLAP_FLOOR = 0.5


def _verify(least: float):
    def run(batches):
        for pdf in batches:
            ok = [overlap(x, y) >= least for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[ok, ["a", "b"]]
    return run


def _cross(least: float):
    """Links between different components in one tile; a pair already joined by links of the tile is skipped."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, comp, side, bag = (pdf[c].to_list() for c in ("rep", "component", "side", "bag"))
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        diagonal, out = not any(side), []
        order = sorted(range(len(ids)), key=lambda i: (comp[i], ids[i]))
        rows = [i for i in order if side[i] == 0]
        cols = rows if diagonal else [i for i in order if side[i] == 1]
        for i in rows:
            for j in cols:
                if comp[i] != comp[j] and not (diagonal and i >= j) and root(comp[i]) != root(comp[j]) and overlap(bag[i], bag[j]) >= least:
                    parent[root(comp[i])] = root(comp[j])
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def near_duplicates(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, group_id, kept) for every row of docs(doc_id, text); group_id is the smallest doc_id of its group.

    Texts link if the weighted Jaccard similarity of their five-word shingles is at least least; groups are connected
    components over all links found. Words ignore ASCII case and punctuation. A text of one to four words is one
    shingle. A null text or one without words links with nothing. A row without id has no group and is kept. Rows that
    repeat an id are one document and link through any of their texts; all of them are kept or none. Extra columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = src.filter("doc_id is not null")
    sketch = materialize(known.mapInArrow(_sketch, "doc_id long, c1 long, c2 long, bands binary"), "bagminhash")
    classes = sketch.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"))
    member = materialize(sketch.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "rep").distinct(), "classes")

    reps = sketch.join(classes.withColumnRenamed("rep", "doc_id"), ["c1", "c2", "doc_id"]).select("doc_id", "bands").distinct()
    entry = (reps.select("doc_id", "bands", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
             .select(F.xxhash64("band", F.expr("substring(bands, band * 8 + 1, 8)")).alias("bucket"), F.col("doc_id").alias("rep")))
    size = entry.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    entry = materialize(entry.join(size, "bucket"), "buckets")

    def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
        left, right = bags.selectExpr("doc_id a", "bag x"), bags.selectExpr("doc_id b", "bag y")
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                           .mapInPandas(_verify(least), "a long, b long"), "links")

    # the bags of all documents that share a bucket with another; their ids grow with the corpus, so they are never broadcast
    wanted = entry.select(F.col("rep").alias("doc_id")).distinct()
    bags = materialize(known.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, bag binary").dropDuplicates(["doc_id", "bag"]), "bags")
    pairs = materialize(entry.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    first = verified(pairs, bags)
    comp = components(first).withColumnRenamed("node", "rep")

    at = entry.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialize(at.join(split, "bucket").select("bucket", "rep", "component", "n"), "open")
    small = open_.filter(F.col("n") <= SMALL_BUCKET)
    more = (small.selectExpr("bucket", "rep a", "component ca").join(small.selectExpr("bucket", "rep b", "component cb"), "bucket")
            .filter("a < b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    second = verified(more, bags)

    large = open_.filter(F.col("n") > SMALL_BUCKET).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    large = large.withColumn("u", F.pmod(F.xxhash64("rep", "bucket"), F.col("tiles")).cast("int"))
    tiles = large.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "bucket", "rep", "component", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), F.when(F.col("u") > F.col("v"), 1).otherwise(0).alias("side"))
    third = (tiles.join(bags.withColumnRenamed("doc_id", "rep"), "rep").groupBy("bucket", "i", "j")
             .applyInPandas(_cross(least), "a long, b long"))

    edges = first.unionByName(second).unionByName(third.distinct()).unionByName(member.filter("doc_id <> rep").selectExpr("doc_id a", "rep b"))
    group = components(edges).withColumnsRenamed({"node": "doc_id", "component": "group_id"})
    out = src.select("doc_id").join(group, "doc_id", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    return out.select("doc_id", "group_id", F.coalesce(F.col("group_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
