"""Shared helpers: tables, sizes, numpy views of Arrow columns, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs th1, th2. A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("th1"), F.xxhash64(F.lit(1), t).alias("th2")]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying row by row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n, kind = len(column), np.int64 if wide else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20):
    """Row ranges of about size bytes each; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest reachable node.

    Alternates large-star and small-star steps. Each is a join with a grouped minimum, never a collected
    neighbourhood, so a hub's edges combine before the shuffle. Every step is written to the shared folder.
    Components come out after O(log n) rounds; running out of rounds is an error.
    """
    spark = edges.sparkSession
    cur = materialize(edges.selectExpr("greatest(a, b) u", "least(a, b) v").filter("u <> v").distinct(), "cc")
    for _ in range(rounds):
        both = cur.unionByName(cur.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.filter("v > u").join(least, "u").selectExpr("v u", "m v").filter("u <> v").distinct())
        large = materialize(large, "cc")
        # small star: a node and its smaller neighbours join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").selectExpr("v u", "m v").filter("u <> v")
                 .unionByName(low.selectExpr("u", "m v")).distinct())
        small = materialize(small, "cc")
        # done when every node has one edge and no root is itself attached
        state = small.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("k")).first()
        if state.n == state.k:
            tied = small.join(small.selectExpr("u v").distinct(), "v", "left_semi").limit(1).count()
            if not tied:
                return small.selectExpr("u node", "v component").unionByName(small.selectExpr("v node", "v component").distinct())
        cur = small
    raise RuntimeError("connected components did not settle")


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of non-negative numbers, seven bits a byte, the last byte of each below 128."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= 1 << 7 * k if k < 9 else 0
    off = np.r_[0, np.cumsum(size)]
    out = np.empty(off[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[off[:-1][has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, off


def unpack(raw: np.ndarray) -> np.ndarray:
    """The numbers that pack wrote."""
    if not len(raw):
        return np.zeros(0, np.int64)
    end = np.flatnonzero(raw < 128)
    start = np.r_[0, end[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, start)


def partitions_for(df: DataFrame, column: str = "text", target: int = 4 << 20) -> tuple[int, int]:
    """(rows, blocks) of about target bytes of a string column: one counting pass over the table."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce(F.col(column), F.lit("")))).alias("b")).first()
    return int(r.n), max(1, -(-int(r.b or 0) // target))


__all__ = ["Column", "byte_view", "chunks", "components", "held_out", "materialize", "pack", "partitions_for", "table", "text_key", "unpack"]
