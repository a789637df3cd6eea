"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine verification, connected components.

Each vector gets a signature of a few bits in each of several tables, and vectors of one label that agree in a
table meet in a bucket. A bucket is compared as blocks of cosines in double precision. A pair that meets in several
tables is counted in the first of them only, which the rows' signatures tell, so that counts of links need no list of
pairs; per bucket and vector one row leaves the task. Large buckets are split into tiles of bounded size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import components
from enrichspark.session import materialize

MIN_COSINE = 0.93
#: Chance, per pair at the threshold, to meet in no table.
MISS = 1e-4
#: Mean bucket size the number of bits aims at, for vectors without near-duplicates.
BUCKET = 16
TILE = 512
#: Mean rows of a task's share of buckets.
GROUP = 8_000
SEED = 20240229


def plan(largest: int, cosine: float = MIN_COSINE, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) for the largest label: bits follow its row count, tables follow from the miss rate."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest) / bucket))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def _matrix(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim, usable) of vectors of length dim: one with null or non-finite components, or of length zero, isn't usable."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i] = np.array([math.nan if e is None else e for e in v], np.float64) if v.dtype == object else v
    return out, np.isfinite(out).all(axis=1) & out.any(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sign(bits: int, tables: int, kind: str):
    weights = 1 << np.arange(bits)
    def run(batches):
        drawn = lru_cache(maxsize=4)(planes)  # a width has planes of its own
        for pdf in batches:
            for dim, rows in pdf.groupby("dim"):
                x, ok = _matrix(rows["embedding"], int(dim))
                rows = rows[ok]
                if not len(rows):
                    continue
                s = ((_unit(x[ok]) @ drawn(int(dim), bits, tables) > 0).reshape(len(rows), tables, bits) @ weights).astype(np.int32)
                yield pd.DataFrame({"label": rows["label"], "dim": rows["dim"], "vec_id": rows["vec_id"],
                                    "embedding": [(v + 0.0).astype(kind).tobytes() for v in x[ok]], "sigs": [r.tobytes() for r in s]})
    return run


def _smallest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component under the links i-j: roots hook onto smaller ones and paths halve until nothing moves."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    i, j = np.r_[rank[i], rank[j]], np.r_[rank[j], rank[i]]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, root[i], root[j])
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            return ids[order][root[rank]]
        root = new


def _tile_links(x, sigs, ids, side, weight, t, cosine):
    """(n, to) per row of one tile: the links first met in table t, and the smallest id these connect the row with."""
    diagonal = not side.any()
    rows = np.flatnonzero(side <= 1)
    cols = rows if diagonal else np.flatnonzero(side == 2)
    n, pairs = np.zeros(len(x), np.int64), []
    for at in range(0, len(rows), 256):
        r = rows[at:at + 256]
        hit = x[r] @ x[cols].T >= cosine
        if diagonal:
            hit &= r[:, None] != cols[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        old = (sigs[r[i], :t] == sigs[cols[j], :t]).any(axis=1) if t else np.zeros(len(i), bool)
        i, j = i[~old], j[~old]
        np.add.at(n, r[i], weight[cols[j]])
        if not diagonal:
            np.add.at(n, cols[j], weight[r[i]])
        once = r[i] < cols[j] if diagonal else slice(None)
        pairs.append((r[i][once], cols[j][once]))
    if not pairs:
        return n, ids
    return n, _smallest(ids, *(np.concatenate(p) for p in zip(*pairs)))


def _links(cosine: float, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable")
        bucket, t = pdf["bucket"].to_numpy(), pdf["t"].to_numpy()
        vectors = pdf["embedding"].to_numpy()
        sigs = np.stack([np.frombuffer(b, np.int32) for b in pdf["sigs"]])
        ids, side, weight = pdf["vec_id"].to_numpy(np.int64), pdf["side"].to_numpy(), pdf["copies"].to_numpy(np.int64)
        n, to = np.zeros(len(ids), np.int64), ids.copy()
        cut = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for a, b in zip(cut, cut[1:]):
            if b - a > 1:
                x = _unit(np.stack([np.frombuffer(v, kind) for v in vectors[a:b]]).astype(np.float64))  # a bucket has one width
                n[a:b], to[a:b] = _tile_links(x, sigs[a:b], ids[a:b], side[a:b], weight[a:b], int(t[a]), cosine)
        keep = n > 0
        return pd.DataFrame({"cid": pdf["cid"].to_numpy()[keep], "vec_id": ids[keep], "n": n[keep], "to": to[keep]})
    return run


def dedup(vectors: DataFrame, cosine: float = MIN_COSINE, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine in double precision is at least cosine; vectors of
    different lengths don't. A vector that is null or zero, or that holds a null or non-finite component, links with nothing; so does a
    row without id, whose component_id is null and which is kept. Rows that repeat an id with the same vector and label count as one
    vector; an id with several vectors, or with one under several labels, is linked through each of them. Equal vectors are compared once and counted as
    often as they occur. Extra columns are ignored; an empty table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    sized = (rows.filter("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
             .withColumn("dim", F.size("embedding")))
    largest = sized.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = plan(largest, cosine, miss)

    # equal vectors of a label are a class with an id of its own; the smallest vec_id stands for it, with their number
    sketch = materialize(sized.mapInPandas(_sign(bits, tables, kind), "label string, dim int, vec_id long, embedding binary, sigs binary"), "vectors")
    same = ["label", "dim", "e1", "e2"]
    key = ["label", "dim", F.xxhash64("embedding").alias("e1"), F.xxhash64(F.lit(1), "embedding").alias("e2")]
    named = sketch.select(*key, "vec_id").distinct()
    classes = materialize(named.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("cid", F.monotonically_increasing_id()), "classes")
    member = named.join(classes, same).select("vec_id", "rep", "cid", "copies")
    reps = (sketch.select(*key, F.col("vec_id").alias("rep"), "embedding", "sigs").join(classes, [*same, "rep"]).dropDuplicates(["cid"])
            .select("label", "dim", "cid", F.col("rep").alias("vec_id"), "embedding", "sigs", "copies"))
    reps = materialize(reps, "reps")

    # one entry per vector and table; buckets larger than a tile become pairs of tiles
    bucket = ["label", "dim", "t", "sig"]
    entries = (reps.select("label", "dim", "cid", F.expr(f"explode(sequence(0, {tables - 1}))").alias("t"), "sigs")
               .withColumn("sig", F.xxhash64(F.expr("substring(sigs, t * 4 + 1, 4)"))).drop("sigs"))
    size = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    placed = entries.join(size, bucket).withColumn("a", F.pmod(F.xxhash64("cid", "t"), F.col("tiles")).cast("int"))
    meet = placed.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64(*bucket, F.least("a", "b"), F.greatest("a", "b")).alias("bucket"), "t", "cid",
        F.when(F.col("a") == F.col("b"), 0).when(F.col("a") < F.col("b"), 1).otherwise(2).alias("side"))  # a pair with an empty tile isn't a tile alone
    meet = materialize(meet, "meet")
    groups = max(64, -(-meet.count() // GROUP))
    links = materialize(meet.join(reps.drop("label", "dim"), "cid").groupBy(F.pmod("bucket", F.lit(groups)).alias("g"))
                        .applyInPandas(_links(cosine, kind), "cid long, vec_id long, n long, to long"), "links")
    degree = links.groupBy("cid").agg(F.sum("n").alias("n"))
    per_id = (member.join(degree, "cid", "left")
              .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")).groupBy("vec_id").agg(F.sum("n").alias("n_links")))
    edges = links.selectExpr("vec_id a", "to b").unionByName(member.selectExpr("vec_id a", "rep b")).filter("a <> b")
    comp = components(edges).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    out = rows.select("vec_id").join(per_id, "vec_id", "left").join(comp, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
