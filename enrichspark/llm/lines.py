"""Line dedup with a sharded minimal perfect hash.

The document counts of all distinct lines are spread over shards by hash. Each shard builds a minimal perfect hash
over its line hashes and, in its order, an array of fingerprints and one of counts. Documents are grouped into
blocks; a block sends each shard the distinct hashes of its lines once, so that the commonest line costs one entry
per block, and the shard answers by probing its arrays. Lines themselves are never joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import partitions_for
from enrichspark.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
KEYS_PER_SHARD = 40_000
BLOCK_BYTES = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"
SEED1 = 42
#: Spark's xxhash64(lit(1), x) hashes x with the hash of the integer 1 as its seed.
SEED2 = xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAMMA = 2.0


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: a cascade of bit arrays holding keys alone in their slot.

    A key's index is its rank among all set bits. Keys outside the set get any index or -1; a fingerprint tells.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ranks, before = [], 0
        for bits in levels:
            ranks.append(before + np.cumsum(bits, dtype=np.int64) - 1)
            before += int(bits.sum())
        self.ranks, self.size = ranks, before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            slots = max(8, int(GAMMA * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(slots)).astype(np.int64)
            bits = np.bincount(at, minlength=slots) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, parts) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(p, np.uint8, offset=8), count=int.from_bytes(p[:8], "little")).astype(bool)
                    for p in parts])


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z in lower case; other bytes as they are."""
    return line.strip(SPACE).lower()


def _keys(text):
    """JVM side of line_key: the array of distinct (h1, h2) of the lines of a text whose key isn't too short."""
    key = lambda x: F.translate(F.regexp_replace(x, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z", ""), UPPER, LOWER)
    return F.transform(F.split(text, "\n", -1), key)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(block, h1, h2) once per block and (h1, h2, docs) over all documents: see drop_lines."""
    lines = docs.select("block", F.explode(F.array_distinct(_keys(F.col("text")))).alias("k")).filter(F.char_length("k") >= min_chars)
    return lines.groupBy("block", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")).agg(F.count(F.lit(1)).alias("docs"))


def build_shards(counts: DataFrame) -> DataFrame:
    """(shard, n, levels, prints, docs): the perfect hash and its fingerprint and count arrays, a row per shard."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1 = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        # equal h1 with unequal h2 share a slot key; both fingerprints stay in the overflow lists
        order = np.lexsort((pdf["h2"].to_numpy(), h1))
        h1, h2, n = h1[order], pdf["h2"].to_numpy(np.int64)[order], pdf["docs"].to_numpy(np.int64)[order]
        first = np.r_[True, h1[1:] != h1[:-1]]
        mph = PerfectHash.build(h1[first])
        prints, docs = np.zeros(mph.size, np.int64), np.zeros(mph.size, np.int64)
        at = mph.index(h1[first])
        prints[at], docs[at] = h2[first], n[first]
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), len(h1), mph.dump(), prints.tobytes(), docs.tobytes(),
                              np.c_[h1.view(np.int64), h2, n][~first].tobytes())],
                            columns=["shard", "n", "levels", "prints", "docs", "more"])
    return counts.groupBy("shard").applyInPandas(build, "shard long, n long, levels array<binary>, prints binary, docs binary, more binary")


def probe(messages: DataFrame, shards: DataFrame, min_docs: int) -> DataFrame:
    """(block, hits) for messages(shard, block, h1s, h2s packed): the hashes whose count is min_docs or more."""
    def look(msgs: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(msgs) or not len(arrays):
            return pd.DataFrame({"block": [], "hits": []})
        a = arrays.iloc[0]
        mph = PerfectHash.load(a["levels"])
        prints, docs = np.frombuffer(a["prints"], np.int64), np.frombuffer(a["docs"], np.int64)
        more = np.frombuffer(a["more"], np.int64).reshape(-1, 3)
        blocks, hits = [], []
        for block, packed in zip(msgs["block"], msgs["hashes"]):
            h = np.frombuffer(packed, ">i8").astype(np.int64).reshape(-1, 2)
            at = mph.index(np.ascontiguousarray(h[:, 0]).view(np.uint64))
            ok = (at >= 0) & (prints[at] == h[:, 1]) & (docs[at] >= min_docs)
            for x1, x2, n in more:
                if n >= min_docs:
                    ok |= (h[:, 0] == x1) & (h[:, 1] == x2)
            if ok.any():
                blocks.append(block)
                hits.append(h[ok].astype(np.int64).tobytes())
        return pd.DataFrame({"block": np.array(blocks, np.int64), "hits": hits})
    return messages.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(look, "block long, hits binary")


def _drop(min_chars: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = {tuple(x) for h in right.column("hits").to_pylist() for x in np.frombuffer(h, np.int64).view(np.uint64).reshape(-1, 2).tolist()}
        ids, n_lines, n_dropped, kept_text = left.column("row"), [], [], []
        xx = xxhash.xxh64_intdigest
        first = {h for h, _ in hot}
        for text in left.column("text").to_pylist():
            lines = text.encode().split(b"\n")
            if hot:
                kept = []
                for line in lines:
                    key = line.strip(SPACE).lower()
                    h = xx(key, SEED1)
                    if h in first and (h, xx(key, SEED2)) in hot and len(key.decode()) >= min_chars:
                        continue
                    kept.append(line)
            else:
                kept = lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            kept_text.append(b"\n".join(kept) if len(kept) < len(lines) else text.encode())
        return pa.table({"row": ids, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()),
                         "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept_text], pa.string())})
    return run


def drop_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
               texts: bool = True) -> DataFrame:
    """Drop every line whose key occurs in min_docs or more documents: columns, n_lines, n_dropped, kept_sha256 and kept_text.

    Each row of docs(text and columns) is one document, repeated rows and rows without id included. A null or empty
    text is one empty line, kept. A key shorter than min_chars code points stays; a key is 128 bits of hash. Extra
    columns are ignored unless named in columns. An empty table gives an empty result. texts=False leaves kept_text out.
    """
    row = F.struct(*[F.col(c) for c in columns])
    src = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    n, blocks = partitions_for(src, target=BLOCK_BYTES)
    src = src.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(blocks)))

    seen = materialize(line_counts(src, min_chars), "lines")
    counts = seen.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
    width = max(64, -(-seen.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("h1"), F.lit(width)).alias("shard")
    shards = build_shards(counts.select(shard, "h1", "h2", "docs"))
    # 16 bytes per hash, big-endian as unhex gives them
    pair = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    messages = (seen.select("block", shard, pair.alias("p")).groupBy("block", "shard")
                .agg(F.concat_ws("", F.collect_list(F.hex("p"))).alias("x")).select("block", "shard", F.unhex("x").alias("hashes")))
    hits = probe(messages, shards, min_docs)

    run = _drop(min_chars)
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    out = (src.groupBy("block").cogroup(hits.groupBy("block"))
           .applyInArrow(run, f"row {kind}, n_lines long, n_dropped long, kept_text string, kept_sha256 string"))
    return out.select("row.*", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if texts else []))
