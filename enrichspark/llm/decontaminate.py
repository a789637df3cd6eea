"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is split into e + 1 pieces: any passage within e edits holds one piece
unchanged. An automaton over all pieces finds exact hits in one pass over a document, hits of an item on nearby
diagonals are merged, and each such window is verified with Myers' bit-parallel edit distance. The pieces are the
leaves of a binary tree; a node over j leaves has j - 1 edits, one less than its children have together and one, so
that of a true match a child is again within its budget. A hit must pass its parent, grandparent and so on, short
patterns first, before the whole item is verified; this loses nothing and ends nearly all chance hits early.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import partitions_for

ERROR_RATE = 0.1
#: Shorter items match only exactly and at word bounds.
SHORT = 24
BLOCK_BYTES = 1 << 20
GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, runs of anything but letters and digits as one space, a space at both ends."""
    t = GAPS.sub(" ", (text or "").lower()).strip()
    return f" {t} " if t else ""


def budget(item: str, rate: float = ERROR_RATE) -> int:
    """Edits allowed for a normal item: rate of its length without the outer spaces, 0 if short."""
    n = len(item) - 2
    return int(n * rate) if n >= SHORT else 0


def ancestors(leaves: int) -> list[list[tuple[int, int]]]:
    """For each leaf the leaf ranges of its ancestors below the root, the smallest first."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(leaves)]
    todo = [(0, leaves)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        if b - a < leaves:
            for i in range(a, b):
                out[i].insert(0, (a, b))
        todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def split(item: str, e: int) -> list[tuple[int, str]]:
    """e + 1 pieces of nearly equal length, with their offsets."""
    n, k = len(item), e + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance between a pattern and any substring of a text (bit-parallel, one word of any length)."""

    def __init__(self, pattern: str):
        self.m, self.eq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best match; the first end on ties."""
        full, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.eq.get
        pv, mv, score, best, end = full, 0, self.m, self.m, 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best, end


class Matcher:
    """All items of a block against one text at a time."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick
        self.items, found = [], {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            e = budget(t, rate)
            t = t.strip() if e else t
            k = len(self.items)
            self.items.append((item_id, t, e, Myers(t)))
            cuts = split(t, e)
            begins = [at for at, _ in cuts] + [len(t)]
            nodes: dict[tuple[int, int], tuple[int, int, int, Myers]] = {}
            for (at, piece), above in zip(cuts, ancestors(len(cuts))):
                for a, b in above:
                    if (a, b) not in nodes:
                        nodes[a, b] = (begins[a], begins[b], b - a - 1, Myers(t[begins[a]:begins[b]]))
                found.setdefault(piece, []).append((k, at, [nodes[x] for x in above]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): where an item may lie; windows of one item that overlap are merged."""
        hits: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for k, at, above in where:
                d = end + 1 - n - at
                if d in hits.get(k, ()):
                    continue
                for a, b, e, myers in above:
                    if myers.search(text[max(0, d + a - e):max(0, d + b + e)])[0] > e:
                        break
                else:
                    hits.setdefault(k, set()).add(d)
        for k, diagonals in hits.items():
            _, t, e, _ = self.items[k]
            lo = hi = None
            for d in sorted(diagonals):
                a, b = d - e, d + len(t) + e
                if hi is not None and a <= hi:
                    hi = b
                    continue
                if hi is not None:
                    yield k, max(0, lo), hi
                lo, hi = a, b
            yield k, max(0, lo), hi

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, length, end) of the items within their budget, at the best place in the normal text."""
        t = normal(text)
        if not t or not self.any:
            return []
        best: dict[int, tuple[int, int]] = {}
        for k, lo, hi in self.windows(t):
            _, pattern, e, myers = self.items[k]
            d, end = myers.search(t[lo:hi])
            if d <= e and (k not in best or (d, lo + end) < best[k]):
                best[k] = (d, lo + end)
        return [(self.items[k][0], d, len(self.items[k][1]), end) for k, (d, end) in sorted(best.items())]


HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("length", pa.int32()), ("end", pa.int64())])


def _scan(items: list[tuple[int, str]], rate: float):
    def run(batches):
        m = Matcher(items, rate)
        for b in batches:
            old = b.column("hits").to_pylist()
            new = [h + [dict(zip(("item_id", "distance", "length", "end"), x)) for x in m.find(t)]
                   for h, t in zip(old, b.column("text").to_pylist())]
            i = b.schema.get_field_index("hits")
            cols = list(b.columns)
            cols[i] = pa.array(new, pa.list_(HIT))
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs with its columns and hits: array of (item_id, distance, length, end).

    docs(text, ...) against items(item_id, text), the stated query set, in blocks of about block_bytes: each block is
    one pass over the documents, one after the other inside the same tasks. Texts are compared in normal form. A null,
    empty or wordless text hits nothing, and neither does such an item. Repeated rows and items each give their own
    hits; a null item_id is kept. A column of docs named hits is replaced.
    """
    own = [c for c in docs.columns if c.lower() != "hits"]
    kind = "array<struct<item_id:bigint,distance:int,length:int,end:bigint>>"
    out = docs.select(*own).withColumn("hits", F.expr(f"cast(array() as {kind})"))
    it = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, blocks = partitions_for(it, target=block_bytes)
    if not n:
        return out
    schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in out.columns)
    for b in range(blocks):
        part = [(r.item_id, r.text) for r in it.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
                .orderBy("item_id", "text").collect()]  # one block, about block_bytes
        if part:
            out = out.mapInArrow(_scan(part, rate), schema)
    return out


def leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, similarity, end): one row per document and item it holds. See find_leaks."""
    h = find_leaks(docs.select("doc_id", "text"), items, rate).select("doc_id", F.inline("hits"))
    return h.select("doc_id", "item_id", "distance", (1 - F.col("distance") / F.col("length")).alias("similarity"), "end")
