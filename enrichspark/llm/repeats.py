"""Removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Strings of LENGTH bytes that start more than once are found in three steps.

1. Every LENGTH-byte window is represented by its minimizer, the K-byte string of smallest hash in it. Equal windows
   have equal minimizers, so a repeat can only lie where a minimizer occurs twice. A run of windows with one minimizer
   occurrence is a stretch of text; equal stretches are one class, whose number is counted before the shuffle.
2. Stretches that occur twice are repeated throughout. A minimizer with several classes can hold repeats that
   cover a part of them: its class texts, once each, go to shards by minimizer. A shard leaves out what can't share LENGTH
   bytes with another text round the minimizer, sorts the suffixes of the rest, takes their
   Burrows-Wheeler transform, and derives common prefixes breadth first: the boundaries of prefix length l yield those of
   l + 1 by backward extension, in increasing order, and the expansion stops at LENGTH. What has no boundary by then repeats.
3. Minimizers with very many classes would make a shard grow. Their windows are counted by 128-bit hashes instead:
   blocks of stretches send packed hashes to hash shards and get back which of them occur twice.

The removed ranges of each text are merged and applied to the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import byte_view, chunks, text_key
from enrichspark.session import materialize

LENGTH = 400
K = 64
#: A minimizer with more classes than this is split by window hashes.
HOT = 400
SHARD_BYTES = 400_000
U64 = np.uint64
_rng = np.random.default_rng(4)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.int64).view(U64) | U64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of every k-byte string of data, k a power of two, by doubling."""
    h, n = BYTE_HASH[data], 1
    while n < k:
        h = h[:-n] * U64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
        h ^= h >> U64(29)
        n *= 2
    return (h * U64(0xBF58476D1CE4E5B9)) >> U64(32)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the place of its smallest, the first of equal ones."""
    v = (h << U64(32)) | np.arange(len(h), dtype=U64)
    n = 1
    while 2 * n <= w:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    if n < w:
        v = np.minimum(v[:len(v) - (w - n)], v[w - n:])
    return (v & U64(0xFFFFFFFF)).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """(doc, core, lo, hi): runs of windows lo..hi that share the minimizer at core; places in data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    core = sliding_argmin(gram_hashes(data, k), length - k + 1)
    start = np.arange(len(core))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(core)]
    ok = start + length <= offsets[1:][doc]
    first = ok.copy()
    first[1:] &= (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= first[1:] | ~ok[1:]
    hi = np.flatnonzero(last)
    return doc[lo], core[lo], lo, hi


def _scan(length: int, k: int):
    """(doc_id, th1, th2, h, w1, w2, lo, hi, core): every stretch, h its minimizer's hash and w its text's hash; core is relative to lo."""
    def run(batches):
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            for x, y in chunks(offsets):
                base = offsets[x]
                part, off = data[base:offsets[y]], offsets[x:y + 1] - base
                doc, core, lo, hi = stretches(part, off, length, k)
                if not len(doc):
                    continue
                raw, h128, h64 = part.tobytes(), xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
                h = np.array([h64(raw[c:c + k]) for c in core.tolist()], U64).view(np.int64)
                w = [h128(raw[i:j + length]) for i, j in zip(lo.tolist(), hi.tolist())]
                row, at = pa.array(doc + x), off[:-1][doc]
                half = lambda s: pa.array(np.array([(v >> s) & (2**64 - 1) for v in w], U64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(row) for c in ("doc_id", "th1", "th2")), pa.array(h), half(64), half(0), pa.array((lo - at).astype(np.int32)),
                     pa.array((hi - at).astype(np.int32)), pa.array((core - lo).astype(np.int32))], names=["doc_id", "th1", "th2", "h", "w1", "w2", "lo", "hi", "core"])
    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; text is int, its separators are unique and so end every comparison."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        sk = key[order]
        new = np.r_[0, np.cumsum(sk[1:] != sk[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text a mask over its windows of length bytes: does the window occur elsewhere in texts?

    A boundary of level l lies between two neighbours in suffix order that differ after l bytes. Levels follow in
    increasing order, breadth first: of two suffixes that one byte c precedes, with none such between them, backward
    extension gives neighbours in suffix order, and a boundary of level l between the former makes one of level l + 1
    between the latter, unless these have a lower one. Nothing extends over a separator. What is without boundary
    when level length is reached shares length bytes with its neighbour.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
    s[ends - 1] = np.arange(len(texts))  # separators, all different and below every byte
    n = len(s)
    sa = suffix_array(s)
    before = s[sa - 1]  # the transform
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    longer = place[sa - 1]  # backward extension
    by = np.argsort(before, kind="stable")
    same = before[by[1:]] == before[by[:-1]]
    last = np.full(n, -1, np.int32)
    last[by[1:][same]] = by[:-1][same]  # the suffix before with the same preceding byte
    known = np.zeros(n, bool)
    head = s[sa]
    now = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    known[now] = True
    wait = np.flatnonzero((before >= len(texts)) & ~known[longer]).astype(np.int32)
    since, target = last[wait], longer[wait]
    for _ in range(length - 1):
        if not len(now) or not len(wait):
            break
        mark = np.zeros(n, np.int8)
        mark[now] = 1
        count = np.cumsum(mark, dtype=np.int32)
        go = count[wait] != count[since]
        now = target[go]
        known[now] = True
        stay = ~go
        wait, since, target = wait[stay], since[stay], target[stay]
    rep = np.zeros(n, bool)
    pair = np.flatnonzero(~known)
    rep[sa[pair]] = True
    rep[sa[pair - 1]] = True
    return [rep[b:b + size - length + 1] for b, size in zip(begin, sizes)]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def shared_parts(pieces: list[bytes], cores: list[int], k: int = K) -> list[tuple[int, int]]:
    """For stretches with one minimizer: the largest part (from, to) round its core that others can share on either side.

    The longest common prefix of a text with any other is that with a neighbour in sorted order.
    """
    n = len(pieces)
    out = []
    for side in ([p[:c][::-1] for p, c in zip(pieces, cores)], [p[c + k:] for p, c in zip(pieces, cores)]):
        order = sorted(range(n), key=side.__getitem__)
        best = [0] * n
        for x, y in zip(order, order[1:]):
            v = common(side[x], side[y])
            best[x], best[y] = max(best[x], v), max(best[y], v)
        out.append(best)
    return [(c - left, c + k + right) for c, left, right in zip(cores, *out)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    m = np.r_[False, mask, False].astype(np.int8)
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


def _cut(length: int):
    """The texts of wanted stretches: (h, th1, th2, lo, core, hot, two, piece)."""
    def run(batches):
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            raw, rows = data.tobytes(), []
            for i, want in enumerate(b.column("want").to_pylist()):
                for w in want:
                    at = int(offsets[i])
                    rows.append((w["h"], i, w["lo"], w["core"], w["hot"], w["two"], raw[at + w["lo"]:at + w["hi"] + length]))
            row = pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), b.column("th1").take(row), b.column("th2").take(row), pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.bool_()), pa.array([r[5] for r in rows], pa.bool_()),
                 pa.array([r[6] for r in rows], pa.binary())], names=["h", "th1", "th2", "lo", "core", "hot", "two", "piece"])
    return run


RANGE = "th1 long, th2 long, lo int, hi int"


def _ranges(pdf: pd.DataFrame, masks) -> pd.DataFrame:
    rows = []
    for th1, th2, lo, mask in zip(pdf["th1"], pdf["th2"], pdf["lo"], masks):
        a, z = _runs(mask)
        rows += [(th1, th2, lo + i, lo + j) for i, j in zip(a.tolist(), z.tolist())]
    out = pd.DataFrame(rows, columns=["th1", "th2", "lo", "hi"])
    return out.astype({"th1": "int64", "th2": "int64", "lo": "int32", "hi": "int32"})


def _expand(length: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        texts, h = [bytes(p) for p in pdf["piece"]], pdf["h"].to_numpy()
        core, cut = pdf["core"].to_numpy(), np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
        parts = [x for a, b in zip(cut, cut[1:]) for x in shared_parts(texts[a:b], core[a:b].tolist(), k)]
        # what shares less than length bytes round its core with all others can't repeat
        keep = [i for i, (a, b) in enumerate(parts) if b - a >= length]
        if not keep:
            return _ranges(pdf[:0], [])
        masks = repeated_starts([texts[i][parts[i][0]:parts[i][1]] for i in keep], length)
        single = [j for j, i in enumerate(keep) if not pdf["two"].iat[i]]
        some = pdf.iloc[[keep[j] for j in single]]
        some = some.assign(lo=some["lo"].to_numpy() + np.array([parts[keep[j]][0] for j in single], np.int64))
        return _ranges(some, [masks[j] for j in single])
    return run


def _window_hashes(piece: bytes, length: int) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(piece[i:i + length]) for i in range(len(piece) - length + 1)]), "V16")


def _hot_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of the stretches of hot minimizers: window hashes counted over shards, asked for by block."""
    size = pieces.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece") - length + 1).alias("w")).first()
    if not size.n:
        return pieces.select("th1", "th2", "lo", F.col("lo").alias("hi"))
    blocks, shards = max(16, -(-size.n // 500)), max(16, -(-size.w // 100_000))
    pieces = materialize(pieces.withColumn("block", F.pmod(F.xxhash64("th1", "th2", "lo", "h"), F.lit(blocks))), "hot")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_window_hashes(bytes(p), length) for p in pdf["piece"]])
        n = np.concatenate([np.full(len(p) - length + 1, 2 if t else 1) for p, t in zip(pdf["piece"], pdf["two"])])
        u, inv = np.unique(h, return_inverse=True)
        n = np.minimum(np.bincount(inv, n), 2).astype(np.uint8)
        shard = (u.view(np.uint64).reshape(-1, 2)[:, 0] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        return pd.DataFrame([(int(shard[g[0]]), int(pdf["block"].iloc[0]), u[g].tobytes(), n[g].tobytes()) for g in np.split(order, cut)],
                            columns=["shard", "block", "hashes", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "V16") for x in pdf["hashes"]]
        u, inv = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(inv, np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]]))
        many, at, out = (n >= 2)[inv], 0, []
        for block, p in zip(pdf["block"], parts):
            out.append((block, p[many[at:at + len(p)]].tobytes()))
            at += len(p)
        return pd.DataFrame(out, columns=["block", "repeated"])

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {r[i:i + 16] for r in right["repeated"] for i in range(0, len(r), 16)}
        left = left[~left["two"].to_numpy(bool)]
        masks = [np.array([bytes(x) in known for x in _window_hashes(bytes(p), length)], bool) for p in left["piece"]]
        return _ranges(left, masks)

    sent = pieces.groupBy("block").applyInPandas(send, "shard long, block long, hashes binary, counts binary")
    answers = sent.groupBy("shard").applyInPandas(answer, "block long, repeated binary")
    return pieces.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(mark, RANGE)


def _apply(length: int):
    def run(batches):
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            raw, out = data.tobytes(), []
            for i, ranges in enumerate(b.column("ranges").to_pylist()):
                text = raw[offsets[i]:offsets[i + 1]]
                kept, spans, at = [], 0, 0
                end = -1
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if lo > end:
                        kept.append(text[at:lo])
                        spans += 1
                    end = at = max(end, hi + length)
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                                             names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeat_ranges(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(th1, th2, lo, hi): by text key, the starts lo..hi of windows of length bytes that occur more than once in docs(doc_id, text, th1, th2)."""
    runs = materialize(docs.mapInArrow(_scan(length, k), "doc_id long, th1 long, th2 long, h long, w1 long, w2 long, lo int, hi int, core int"), "runs")
    cls = ["h", "w1", "w2"]
    classes = runs.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"))
    per_h = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"), F.min("n").alias("least")).filter("total > 1")
    tagged = (classes.join(per_h, "h").select(*cls, (F.col("n") > 1).alias("two"), (F.expr("classes > 1 and least = 1")).alias("mixed"),
                                              (F.col("classes") > hot).alias("hot")).filter("two or mixed"))
    found = materialize(runs.join(tagged, cls), "found")
    whole = found.filter("two").select("th1", "th2", "lo", "hi").distinct()

    # one example of each class of a mixed minimizer, and its text
    example = (found.filter("mixed").groupBy(*cls).agg(F.min(F.struct("doc_id", "th1", "th2", "lo", "hi", "core", "hot", "two")).alias("e"))
               .select("h", "e.*").groupBy("doc_id", "th1", "th2").agg(F.collect_list(F.struct("h", "lo", "hi", "core", "hot", "two")).alias("want")))
    same = [docs[c].eqNullSafe(example[c]) for c in ("doc_id", "th1", "th2")]
    texts = docs.join(example, same).select(docs["th1"], docs["th2"], docs["text"], "want")
    pieces = materialize(texts.mapInArrow(_cut(length), "h long, th1 long, th2 long, lo int, core int, hot boolean, two boolean, piece binary"), "pieces")
    cold = pieces.filter(~F.col("hot"))
    size = int(cold.agg(F.sum(F.length("piece"))).first()[0] or 0)
    shards = max(16, -(-size // SHARD_BYTES))
    partial = cold.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInPandas(_expand(length, k), RANGE)
    return whole.unionByName(partial).unionByName(_hot_ranges(pieces.filter("hot"), length)).distinct()


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Remove every byte covered by a string of length bytes that also starts elsewhere: columns, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are UTF-8 bytes and strings never cross documents; overlapping occurrences in one document count. All
    occurrences go, the first as well. Every row of docs(doc_id, text) is a document, so rows that repeat a text lose it;
    a null text is empty, a null doc_id is allowed, and an empty table gives no row. kept is binary, since a cut
    may split a character; texts=False leaves it out. Extra columns are ignored unless named in columns.
    """
    row = F.struct(*[F.col(c) for c in columns]).alias("row")
    src = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *text_key(F.col("text")))
    ranges = (repeat_ranges(src.drop("row"), length).groupBy("th1", "th2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    kind = src.schema["row"].dataType.simpleString()
    out = (src.join(ranges, ["th1", "th2"], "left").select("row", "text", "ranges")
           .mapInArrow(_apply(length), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return out.select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))
