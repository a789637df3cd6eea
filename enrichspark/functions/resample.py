"""Exact bootstrap resamples: n rows drawn n times with replacement, without a row per draw.

The rows of a key are numbered, and draw j of a resample takes the row whose number is a hash of resample and j, modulo n. Blocks bound the memory
only: a block of rows goes through all draws of a resample and adds up those that hit it, so the resamples are the same for any block size.
Resamples are dealt over several tasks, which repeats a block's rows for each; a task returns its sums as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.draws import hash32
from enrichspark.functions.ordering import global_rank

BLOCK = 1 << 21
#: Draws made at once.
BATCH = 1 << 18
#: Draws that one task should make, and the most tasks that share the resamples of a block.
TASK_DRAWS = 1 << 28
MAX_CHUNKS = 64
MODULUS = 2147483647


def _reduced(x: np.ndarray) -> np.ndarray:
    """x % MODULUS for 0 <= x < 2**61, by folding the bits above 31."""
    x = (x & MODULUS) + (x >> 31)
    return x - MODULUS * (x >= MODULUS)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """functions.draws.mix on arrays."""
    x = a ^ b
    x = _reduced(x * 48271 + 11)
    x ^= x >> 13
    x = _reduced(x * 69621 + b)
    return x ^ (x >> 16)


def drawn(n: int, stream: int, boots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Row numbers drawn by the resamples, a batch of resamples x draws at a time, with the resamples' places in boots."""
    own = mixed(np.int64(stream), boots * 1664525 % MODULUS)  # a stream of numbers for each resample
    wide = max(1, BATCH // max(1, n))
    for lo in range(0, n, BATCH):
        slot = np.arange(lo, min(n, lo + BATCH)) * 22695477 % MODULUS
        for at in range(0, len(boots), wide):
            x = mixed(own[at:at + wide, None], slot[None, :])
            yield slice(at, at + wide), x - x // n * n


def share_of_block(n: int, block: int, block_rows: int, stream: int, boots: np.ndarray) -> np.ndarray:
    """Draws of each resample that fall into a block, when n draws go to n rows."""
    out = np.zeros(len(boots), np.int64)
    for at, pick in drawn(n, stream, boots):
        out[at] += (pick // block_rows == block).sum(axis=1)
    return out


def _sums(n_boot: int, block_rows: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        x = group["x"].to_numpy()
        own = {c: int(group[c][0].as_py()) for c in ("n", "block", "stream", "chunk", "chunks") if c in group.column_names}
        n, first = own["n"], own["block"] * block_rows
        boots = np.arange(1, n_boot + 1)[own.get("chunk", 0)::own.get("chunks", 1)]
        sums = np.zeros(len(boots))
        whole = len(x) == n
        padded = x if whole else np.append(x, 0.0)  # rows of other blocks count 0
        for at, pick in drawn(n, own["stream"], boots):
            if not whole:
                pick = np.minimum((pick - first).astype(np.uint64), len(x)).astype(np.int64)
            sums[at] += padded[pick].sum(axis=1)
        keys = [c for c in group.column_names if c not in ("x", "pos", "block", *own)]
        back = {c: pa.array([own[c]], pa.int64()) for c in ("n", "chunk", "chunks") if c in own}
        return pa.table({**{k: group[k][:1] for k in keys}, **back, "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})
    return run


def boot_means(values: DataFrame, keys: list[str], value: str, unit: str, n_boot: int, seed: int, block_rows: int = BLOCK) -> DataFrame:
    """(*keys, boot, mean): the mean of value in each bootstrap resample of a key's rows, boot from 1.

    unit orders the rows of a key and must tell them apart; null values are left out. Keys draw independently. The shuffle carries a key's rows
    once per task that shares its resamples, at most MAX_CHUNKS times, and keys x blocks x n_boot sums.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(unit).alias("_u"), F.col(value).cast("double").alias("x"))
    ranked = global_rank(rows, [*keys, "_u"], "_r")
    per_key = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_r").alias("_first"))
    stream = hash32(seed, *[F.col(k) for k in keys]) % MODULUS
    chunks = F.least(F.ceil(F.col("n") * F.lit(float(n_boot)) / TASK_DRAWS), F.lit(min(MAX_CHUNKS, n_boot))).cast("int")
    placed = (ranked.join(per_key, keys).withColumn("pos", F.col("_r") - F.col("_first")).withColumn("block", F.expr(f"pos div {block_rows}"))
              .withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select(*keys, "x", "pos", "n", "block", "chunk", "chunks", stream.alias("stream")))
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in keys)
    n_parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = (placed.repartition(n_parts, *keys, "block", "chunk").groupBy(*keys, "block", "chunk")
            .applyInArrow(_sums(n_boot, block_rows), f"{kinds}, n long, chunk long, chunks long, sums array<double>"))
    return (sums.select(*keys, "n", "chunk", "chunks", F.posexplode("sums").alias("_i", "s"))
            .withColumn("boot", (F.col("_i") * F.col("chunks") + F.col("chunk") + 1).cast("int")).groupBy(*keys, "boot")
            .agg((F.sum("s") / F.max("n")).alias("mean")))
