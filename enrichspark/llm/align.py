"""Cross-tokenizer alignment: which tokens of two vocabularies end together, counted over the corpus by external spills.

Every text is encoded by tokenizer A and by tokenizer B, and the byte offsets where tokens of both end cut it into groups;
the two tokens that end a group are linked. A task gathers its (B id, A id, document) records up to a bound, sorts
them with B as the major side, parts them by the radix of the B id and spills each part as a run of zstd frames: a directory of
pairs with their counts, and the documents behind them. A heap merges the directories of a radix part in order and adds up
each pair; parts that a frequent id makes large are merged in splits whose sums are added. With B as the major side the counts of
an id stand together, so the highest follows at once. The counts then stream back through the runs to their documents.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from enrichspark.llm import pieces
from enrichspark.llm.common import pack, partitions_for, unpack
from enrichspark.llm.packing import LONG_TEXT, LONG_WORD, PLAIN
from enrichspark.session import materialize

MODEL_A, MODEL_B = "byte_bpe_50k", "piece_bpe_32k"
#: A run closes after so many links or documents.
RUN_LINKS, RUN_DOCS = 2_000_000, 1 << 16
#: Pairs of a frame, and records that one task merges on the mean.
FRAME, SPLIT_RECORDS = 4096, 16_000_000
#: Radix parts: one for so many bytes of text, up to a number.
PART_BYTES, PARTS = 64 << 20, 1024
DIGEST = ["n_a", "n_b", "n_groups", "groups_sha256"]


class Aligner:
    """Encodes texts both ways and links the tokens that end together."""

    def __init__(self, name_a: str = MODEL_A, name_b: str = MODEL_B):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name_a}.json"))
        self.slow.encode_special_tokens = True  # their strings are plain text
        with open(public_tokenizers.path(f"{name_a}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name_a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_a[i] = b
        self.b = pieces.load(name_b)
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.b.bytes])
        # each token's decimal id with what follows it: inside a group, at the end of its side
        self.names = [f"{i}{end}" for n, ends in ((len(self.len_a), ",|"), (len(self.len_b), ",;")) for end in ends for i in range(n)]

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of A; both libraries split plain texts alike, the faster one isn't used for others or for very long words."""
        if PLAIN.search(text) or (len(text) > LONG_TEXT and (max(map(len, text.split()), default=LONG_WORD) >= LONG_WORD
                                                             or re.search(r"\s{1000}", text))):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)

    def align(self, text: str | None) -> tuple[int, int, str, np.ndarray, np.ndarray]:
        """(tokens of A, tokens of B, groups, A ids and B ids that are linked); nothing if the tokens don't spell the text."""
        none = 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        raw, ids = f" {text}".encode(), self.b.encode(text)
        table = self.b.bytes
        if b"".join([table[i] for i in ids]) != raw:
            return none
        b, a = np.array(ids, np.int64), self.encode_a(f" {text}")
        table = self.bytes_a
        if b"".join([table[i] for i in a.tolist()]) != raw:
            return none
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.zeros(len(raw) + 1, np.int8)
        at[end_a] = 1
        last_b = at[end_b] == 1
        at[end_b] += 2
        last_a = at[end_a] == 3
        # interleaved: the tokens of A of a group, then those of B
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.r_[0, np.flatnonzero(last_b) + 1]  # tokens of B before each group
        upto_a = np.flatnonzero(last_a) + 1  # tokens of A up to the end of each group
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = a + len(self.len_a) * last_a
        order[np.arange(len(b)) + upto_a[group_b]] = b + len(self.len_b) * last_b + 2 * len(self.len_a)
        names = self.names
        return len(a), len(b), "".join([names[i] for i in order.tolist()])[:-1], a[last_a], b[last_b]


def _frames(columns: np.ndarray, cuts: np.ndarray, zip_) -> list[bytes]:
    return [zip_(pack(columns[x:y].ravel())[0].tobytes()) for x, y in zip(cuts, cuts[1:])]


def spill(run: int, a: list[np.ndarray], b: list[np.ndarray], parts: int):
    """Runs (run, part, n, heads, tails) of one batch of documents, whose links are a[i] and b[i]."""
    n = [len(x) for x in a]
    if not sum(n):
        return
    doc = np.repeat(np.arange(len(n)), n)
    records, times = np.unique(np.concatenate(b) << 33 | np.concatenate(a) << 16 | doc, return_counts=True)
    part = (records >> 33) % parts
    order = np.argsort(part, kind="stable")
    records, times, part = records[order], times[order], part[order]
    zip_ = zstandard.ZstdCompressor(level=1).compress
    edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    for x, y in zip(edges, edges[1:]):
        key, docs, mult = records[x:y] >> 16, records[x:y] & 0xFFFF, times[x:y]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        cuts = np.r_[np.arange(0, len(first), FRAME), len(first)]
        gap = np.diff(key[first], prepend=0)
        gap[cuts[:-1]] = key[first[cuts[:-1]]]  # a frame stands alone
        heads = _frames(np.c_[gap, np.add.reduceat(mult, first), size], cuts, zip_)
        tails = _frames(np.c_[docs, mult], np.r_[first, len(key)][cuts], zip_)
        yield run, int(part[x]), y - x, heads, tails


def read_heads(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, documents) of a frame."""
    gap, count, size = unpack(np.frombuffer(zstandard.decompress(frame), np.uint8)).reshape(-1, 3).T
    return np.cumsum(gap), count, size


def read_tails(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, times = unpack(np.frombuffer(zstandard.decompress(frame), np.uint8)).reshape(-1, 2).T
    return doc, times


def _cursor(frames: list[bytes]):
    for f in frames:
        pair, count, _ = read_heads(f)
        yield from zip(pair.tolist(), count.tolist())


def merge(runs: list[list[bytes]]):
    """(pair, count) in ascending order over all runs: a heap holds the next pair of each, frames open one at a time."""
    cursors = [_cursor(r) for r in runs]
    heap = [(*first, i) for i, c in enumerate(cursors) if (first := next(c, None))]
    heapq.heapify(heap)
    while heap:
        pair, total = heap[0][0], 0
        while heap and heap[0][0] == pair:
            _, count, i = heap[0]
            total += count
            following = next(cursors[i], None)
            if following:
                heapq.heapreplace(heap, (*following, i))
            else:
                heapq.heappop(heap)
        yield pair, total


def _spill_task(parts: int, run_links: int, texts: bool, name_a: str, name_b: str):
    def run(batches):
        aligner = Aligner(name_a, name_b)
        task, seq = TaskContext.get().partitionId(), 0
        links_a, links_b, total, idx = [], [], 0, 0
        names = ["row", "run", "idx", *DIGEST, "groups", "part", "n", "heads", "tails"]

        def flush():
            for run_id, part, n, heads, tails in spill(task << 24 | seq, links_a, links_b, parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, kind), pa.array([run_id], pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 3, *[pa.nulls(1, pa.string())] * 2,
                     pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([heads], pa.list_(pa.binary())),
                     pa.array([tails], pa.list_(pa.binary()))], names=names)

        for b in batches:
            kind, rows = b.column(0).type, []
            for text in b.column(1).to_pylist():
                n_a, n_b, groups, x, y = aligner.align(text)
                rows.append((task << 24 | seq, idx, n_a, n_b, len(x), hashlib.sha256(groups.encode()).hexdigest() if n_a else "", groups if texts else None))
                links_a.append(x)
                links_b.append(y)
                total, idx = total + len(x), idx + 1
                if total >= run_links or idx >= RUN_DOCS:
                    yield from flush()
                    links_a, links_b, total, idx, seq = [], [], 0, 0, seq + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            nulls = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)), *nulls], names=names)
        yield from flush()
    return run


def spills(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), texts: bool = False, name_a: str = MODEL_A, name_b: str = MODEL_B,
           run_links: int = RUN_LINKS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The digests of all documents (part null) and the runs of their links, written once in the shared folder."""
    src = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), "text")
    _, parts = partitions_for(src, target=part_bytes)
    schema = (f"row {src.schema['row'].dataType.simpleString()}, run long, idx int, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, "
              "part int, n long, heads array<binary>, tails array<binary>")
    return materialize(src.mapInArrow(_spill_task(min(PARTS, parts), run_links, texts, name_a, name_b), schema), "spills")


def _split(spilled: DataFrame, split_records: int) -> DataFrame:
    """The runs with a split number, so that no split of a part has many more than split_records records."""
    runs = spilled.filter("part is not null").select("run", "part", "n", "heads", "tails")
    size = runs.groupBy("part").agg(F.ceil(F.sum("n") / split_records).alias("splits"))
    return runs.join(size, "part").withColumn("split", F.pmod(F.xxhash64("run"), F.col("splits")))


def count_pairs(spilled: DataFrame, split_records: int = SPLIT_RECORDS) -> DataFrame:
    """(part, b, a, pair, n, highest): how many links hold the pair, and the most that a pair with this b has."""
    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        merged = list(merge(group["heads"].to_pylist()))
        return pa.table({"part": pa.array([part] * len(merged), pa.int32()), "pair": pa.array([p for p, _ in merged], pa.int64()),
                         "n": pa.array([n for _, n in merged], pa.int64())})
    sums = _split(spilled, split_records).select("part", "split", "heads").groupBy("part", "split").applyInArrow(run, "part int, pair long, n long")
    total = sums.groupBy("part", "pair").agg(F.sum("n").alias("n"))
    b = F.shiftright("pair", 17).cast("int")
    return (total.withColumn("b", b).withColumn("a", F.col("pair").bitwiseAND((1 << 17) - 1).cast("int"))
            .withColumn("highest", F.max("n").over(W.partitionBy("b"))).select("part", "b", "a", "pair", "n", "highest"))


def _stream_back(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """(run, docs): what a split adds to n_best and count_sum of each document of its runs, packed."""
    order = np.argsort(totals["pair"].to_numpy())
    pair, n, highest = (totals[c].to_numpy()[order] for c in ("pair", "n", "highest"))
    out = []
    for heads, tails in zip(runs["heads"].to_pylist(), runs["tails"].to_pylist()):
        best, sums = np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
        for head, tail in zip(heads, tails):
            key, _, size = read_heads(head)
            doc, times = read_tails(tail)
            at = np.repeat(np.searchsorted(pair, key), size)
            np.add.at(best, doc, times * (n[at] == highest[at]))
            np.add.at(sums, doc, times * n[at])
        doc = np.flatnonzero(sums)
        out.append(zstandard.compress(pack(np.c_[doc, best[doc], sums[doc]].ravel())[0].tobytes(), 1))
    return pa.table({"run": runs["run"].cast(pa.int64()), "docs": pa.array(out, pa.binary())})


def _finish(digests: pa.Table, given: pa.Table) -> pa.Table:
    best, sums = np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
    for docs in given["docs"].to_pylist():
        doc, x, y = unpack(np.frombuffer(zstandard.decompress(docs), np.uint8)).reshape(-1, 3).T
        best[doc] += x
        sums[doc] += y
    idx = digests["idx"].to_numpy()
    return digests.drop_columns(["run", "idx"]).append_column("n_best", pa.array(best[idx])).append_column("count_sum", pa.array(sums[idx]))


def align(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), texts: bool = True, name_a: str = MODEL_A, name_b: str = MODEL_B,
          run_links: int = RUN_LINKS, part_bytes: int = PART_BYTES, split_records: int = SPLIT_RECORDS) -> DataFrame:
    """One row per row of docs(text and columns): columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A reads a space and the text, B the text, to which it adds the space itself; special tokens' strings are plain text. A text that is null
    or empty, or whose tokens don't spell it (as one that holds the space sign of B), has zeros and an empty hash. A pair's
    count is over all rows, repeated ones included; n_best counts the links whose pair has the highest count of its B id, ties included.
    Extra columns are ignored unless named; an empty table gives no row. texts=False leaves groups out.
    """
    spilled = spills(docs, columns, texts, name_a, name_b, run_links, part_bytes)
    pairs = materialize(count_pairs(spilled, split_records), "pairs")
    runs = _split(spilled, split_records)
    places = runs.select("part", "split").distinct()
    totals = pairs.join(places, "part").select("part", "split", "pair", "n", "highest").toDF("part", "split", "pair", "n", "highest")
    given = (runs.select("part", "split", "run", "heads", "tails").groupBy("part", "split")
             .cogroup(totals.groupBy("part", "split")).applyInArrow(_stream_back, "run long, docs binary"))
    own = spilled.filter("part is null").select("row", "run", "idx", *DIGEST, *(["groups"] if texts else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name not in ("run", "idx"))
    out = own.groupBy("run").cogroup(given.groupBy("run")).applyInArrow(_finish, f"{schema}, n_best long, count_sum long")
    return out.select("row.*", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256",
                      *(["groups"] if texts else []))
