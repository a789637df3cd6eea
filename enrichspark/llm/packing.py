"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenized and cut at the capacity; what is left over is cut at half and a quarter of it, so that no
piece is so long that nothing fits beside it. The pieces are counted in a histogram of length classes. A
linear program over patterns (how many pieces of each class share a sequence) is solved on that histogram, whose
size is fixed by the capacity: a knapsack dynamic program prices new patterns until none improves. Patterns are
rounded down, the rest is filled greedily, and the pieces, ranked within their class by counts per task, are dealt
to the pattern slots.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from enrichspark.session import materialize

CAPACITY = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k"
#: Lengths up to EXACT have a class each, longer ones share one with STEP - 1 others.
EXACT, STEP = 32, 8
GAP = 1e-3
#: Where both libraries are known to split text alike; other texts go to the slower one.
PLAIN = re.compile("[^\x00-\x7e -ɏ‐-‟…€]")
LONG_TEXT, LONG_WORD = 20_000, 1_000


def encoder(name: str = TOKENIZER):
    """text -> uint32 ids, as tokenizers' encode(add_special_tokens=False) gives them for <name>.json.

    The same vocabulary as ranks is several times faster, so texts of Latin letters and common punctuation go that
    way. Texts with other characters or with very long words, on which the merges by rank take quadratic time, do not.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if PLAIN.search(text) or (len(text) > LONG_TEXT and (max(map(len, text.split()), default=LONG_WORD) >= LONG_WORD
                                                             or re.search(r"\s{1000}", text))):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
    return encode


def class_sizes(capacity: int = CAPACITY) -> np.ndarray:
    """The largest length of each class, in ascending order: exact, then in steps up to a quarter, half and whole capacity."""
    q = max(1, capacity // 4)
    steps = np.minimum(np.r_[np.arange(1, EXACT + 1), np.arange(EXACT + STEP, q + STEP, STEP)], q)
    return np.unique(np.r_[steps, max(1, capacity // 2), capacity])


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, then a half, then a quarter, then the rest."""
    out, at = [(i, capacity) for i in range(0, n - capacity + 1, capacity)], n - n % capacity
    for size in (capacity // 2, capacity // 4):
        if size and n - at >= size:
            out.append((at, size))
            at += size
    return [*out, (at, n - at)] if n > at else out


def _tokenize(capacity: int, name: str):
    def run(batches):
        encode = encoder(name)
        sizes = class_sizes(capacity)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(len(sizes), np.int64)
        for batch in batches:
            rows, start, length, crc, total, cls, rank = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n = len(ids)
                for at, size in cuts(n, capacity):
                    piece = ids[at:at + size]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            c = np.searchsorted(sizes, np.array(length, np.int64))
            # rank in its class among the pieces of this task
            order = np.argsort(c, kind="stable")
            s = c[order]
            begin = np.r_[0, np.flatnonzero(np.diff(s)) + 1] if len(s) else np.zeros(0, int)
            within = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
            rank = np.empty(len(s), np.int64)
            rank[order] = within + ranks[s]
            ranks += np.bincount(c, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                 pa.array(c, pa.int32()), pa.array(np.full(len(c), part), pa.int32()), pa.array(rank, pa.int64())],
                names=["row", "start", "length", "ids_crc32", "doc_tokens", "cls", "part", "rank"])
    return run


def pieces(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """Every document tokenized, closed by END_ID and cut at the capacity, with class and rank within (part, cls)."""
    row = F.struct(*[F.col(c) for c in columns]).alias("row")
    src = docs.select(row, "text")
    return src.mapInArrow(_tokenize(capacity, name), f"row {src.schema['row'].dataType.simpleString()}, start long, length long, "
                          "ids_crc32 long, doc_tokens long, cls int, part int, rank long")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the value and the counts of the best pattern."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        k = np.searchsorted(sizes, c, side="right")
        v = best[c - sizes[:k]] + values[:k]
        j = int(v.argmax())
        best[c], take[c] = (v[j], j) if v[j] > best[c - 1] else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every class is covered exactly: LP by column generation, then rounding.

    Columns are added until the dual bound is within gap of the LP value.
    """
    used = np.flatnonzero(demand)
    s, d = sizes[used].astype(np.int64), demand[used].astype(np.int64)
    m = len(s)
    if not m:
        return []
    basis = [np.eye(1, m, i, dtype=np.int64)[0] * (capacity // s[i]) for i in range(m)]
    inv = np.diag(1.0 / (capacity // s))
    x = inv @ d
    for step in range(20 * m + 100):
        price = inv.sum(axis=0)
        z, col = best_pattern(np.maximum(price, 0), s, capacity)
        if z <= 1 + 1e-9 or x.sum() * (1 - 1 / z) <= gap * max(1.0, x.sum()):
            break
        u = inv @ col
        ratio = np.where(u > 1e-11, x / np.where(u > 1e-11, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        basis[r] = col
        row = inv[r] / u[r]
        inv -= np.outer(u, row)
        inv[r] = row
        x = np.maximum(inv @ d, 0)
        if step % 200 == 199:
            inv = np.linalg.inv(np.array(basis, float).T)
            x = np.maximum(inv @ d, 0)
    left, out = d.copy(), []
    for col, n in sorted(zip(basis, x), key=lambda p: -p[1]):
        n = int(min(np.floor(n + 1e-7), *(left[col > 0] // col[col > 0])))
        if n > 0:
            out.append((col, n))
            left -= col * n
    while left.any():
        room, col = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            col[i] = min(left[i], room // s[i])
            room -= col[i] * s[i]
        n = int((left[col > 0] // col[col > 0]).min())
        out.append((col, n))
        left -= col * n
    full = []
    for col, n in out:
        wide = np.zeros(len(sizes), np.int64)
        wide[used] = col
        full.append((wide, n))
    return full


def slots(patterns: list[tuple[np.ndarray, int]], classes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first rank, first sequence, sequences and pieces per sequence of each pattern that holds the class."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(classes)]
    at, first = np.zeros(classes, np.int64), 0
    for col, n in patterns:
        for c in np.flatnonzero(col):
            rows[c].append((int(at[c]), first, n, int(col[c])))
            at[c] += col[c] * n
        first += n
    return [np.array(r, np.int64).reshape(-1, 4).T for r in rows]


def _deal(table):
    def run(batches):
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("place").to_numpy()
            seq = np.empty(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                start, first, n, _ = table[c]
                j = np.searchsorted(start, rank[at], side="right") - 1
                seq[at] = first[j] + (rank[at] - start[j]) % n[j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq)], names=[*b.schema.names, "sequence_id"])
    return run


def pack(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """One row per piece: columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Every row of docs(text and columns) is a document of its own, also where ids repeat or are null; a null text
    is empty and gives one piece that holds END_ID alone. Extra columns are ignored unless named. An empty table
    gives no row. A piece has at most capacity tokens; a sequence's pieces lie in it without gap from offset 0.
    """
    cut = materialize(pieces(docs, columns, capacity, name), "pieces")
    sizes = class_sizes(capacity)
    per_task = cut.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("cls").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = per_task.select("part", "cls", F.coalesce(before, F.lit(0)).alias("base"))
    demand = np.zeros(len(sizes), np.int64)
    for r in per_task.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # one row per class, a number fixed by the capacity
        demand[r.cls] = r.n
    table = slots(solve(sizes, demand, capacity), len(sizes))
    placed = cut.join(base, ["part", "cls"]).withColumn("place", F.col("rank") + F.col("base")).drop("part", "rank", "base")
    schema = placed.schema
    dealt = placed.mapInArrow(_deal(table), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", sequence_id long")
    w = W.partitionBy("sequence_id")
    order = w.orderBy(F.col("cls").desc(), "place").rowsBetween(W.unboundedPreceding, -1)
    return dealt.select("row.*", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"),
                        F.sum("length").over(w).cast("long").alias("sequence_tokens"))
