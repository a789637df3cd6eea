"""Quality classifier by co-training of two views.

The content view sees which kinds of characters and words a text is made of; the metadata view sees what its page
record tells: its length, lines, language and source. Each view has a logistic classifier. Over some rounds either one
labels a pool of unlabelled documents and hands its surest labels, in the proportion of the classes, to the other's
training set. In the end both are calibrated on labelled rows kept aside, and their log odds are added, less the
prior that both contain, and calibrated once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import byte_view, chunks, held_out
from enrichspark.llm.near import word_hashes

#: Bounds of the fit: labelled documents per label, and unlabelled documents of the pool.
SAMPLE_DOCS, POOL_DOCS = 1500, 4000
ROUNDS, HANDED = 5, 200
THRESHOLD = 0.5
RIDGE = 1e-2

# kinds of bytes: lower, upper, digit, other bytes of text, blank, line end, and each common sign
KIND = np.full(256, 3, np.int64)
for _lo, _hi, _k in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
    KIND[ord(_lo):ord(_hi) + 1] = _k
KIND[:32] = 4
KIND[32], KIND[10] = 4, 5
SIGNS = ".,;:!?|#$%&*+-=_/\\<>()[]{}@'\"~^`"
for _i, _c in enumerate(SIGNS):
    KIND[ord(_c)] = 6 + _i
KINDS = 6 + len(SIGNS)
COARSE = np.minimum(KIND, 6)
HASHED = 16
META = 10 + 2 * HASHED


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: shares of kinds of bytes and of neighbouring kinds, and of words that repeat one of the two before; square roots."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)[:, None]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    one = np.bincount(doc * KINDS + KIND[data], minlength=n * KINDS).reshape(n, KINDS) / size
    same = doc[1:] == doc[:-1]
    c = COARSE[data]
    two = np.bincount((doc[1:] * 49 + c[:-1] * 7 + c[1:])[same], minlength=n * 49).reshape(n, 49) / size
    rep = np.zeros((n, 2))
    if len(data):
        h, d = word_hashes(data, offsets)
        words = np.maximum(np.bincount(d, minlength=n), 1)
        for k in (1, 2):
            hit = (h[k:] == h[:-k]) & (d[k:] == d[:-k])
            rep[:, k - 1] = np.bincount(d[k:][hit], minlength=n) / words
    return np.sqrt(np.c_[one, two, rep])


def meta_view(data: np.ndarray, offsets: np.ndarray, stated: list, lang: list, source: list) -> np.ndarray:
    """Per text: its stated and real length, number and lengths of lines, and hashed language and source."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, META))
    ends = np.flatnonzero(data == 10)
    doc = np.searchsorted(offsets, ends, side="right") - 1
    lines = np.bincount(doc, minlength=n) + 1
    mean = size / lines
    # every line starts at its text's start or behind a line end, and stops before the next or at its text's end
    of, start = np.r_[np.arange(n), doc], np.r_[offsets[:-1], ends + 1]
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    stop = offsets[1:][of]
    inner = np.flatnonzero(of[1:] == of[:-1])
    stop[inner] = start[inner + 1] - 1
    length, longest = stop - start, np.zeros(n)
    np.maximum.at(longest, of, length)
    short = np.bincount(of, length < 20, minlength=n)
    told = np.array([0 if s is None else s for s in stated], float)
    for i, v in enumerate((np.log1p(size), np.log1p(np.maximum(told, 0)), np.array([s is None for s in stated], float), np.log1p(lines), np.log1p(mean),
                           np.log1p(longest), longest / np.maximum(size, 1), short / lines, lines == 1, size == 0)):
        out[:, i] = v
    for at, column in ((10, lang), (10 + HASHED, source)):
        for i, v in enumerate(column):
            out[i, at + xxhash.xxh32_intdigest("" if v is None else str(v)) % HASHED] = 1
    return out


def _views(batches):
    for b in batches:
        data, offsets = byte_view(b.column("text"))
        side = [b.column(c).to_pylist() for c in ("n_chars", "lang", "source")]
        for x, y in chunks(offsets):
            part, off = data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]
            yield b.slice(x, y - x), content_view(part, off), meta_view(part, off, *(s[x:y] for s in side))


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        weight = (np.ones(len(x)) if weight is None else weight) / len(x)
        self.a = np.zeros(z.shape[1])
        r = ridge * np.eye(len(self.a))
        r[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.a, -30, 30)))
            g = z.T @ (weight * (p - y)) + r @ self.a
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + r
            step = np.linalg.solve(h, g)
            self.a -= step * min(1.0, 5 / np.abs(step).max(initial=1e-9))
            if np.abs(step).max(initial=0) < 1e-6:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.a[:-1] + self.a[-1]


class CoTrained:
    """Two view classifiers with their calibrations and that of their sum."""

    def __init__(self, views: list[Logistic], scale: list[Logistic], prior: float, both: Logistic | None = None):
        self.views, self.scale, self.prior, self.both = views, scale, prior, both

    def sum(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b = (s.odds(v.odds(x)[:, None]) for v, s, x in zip(self.views, self.scale, (content, meta)))
        return a + b - self.prior

    def probability(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.both.odds(self.sum(content, meta)[:, None]), -30, 30)))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], share: float,
             rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained | None:
    """Fit on labelled views and an unlabelled pool; share is that of label 1 outside the balanced sample. None if one label is missing."""
    aside = np.arange(len(y)) % 4 == 3
    if any(len(set(y[k].tolist())) < 2 for k in (aside, ~aside)):
        return None
    prior_weight = np.where(y == 1, share / max(1e-9, (y == 1).mean()), (1 - share) / max(1e-9, (y == 0).mean()))
    train = [(v[~aside], y[~aside], prior_weight[~aside]) for v in views]
    left = np.ones(len(pool[0]), bool)
    fitted = [Logistic().fit(*t) for t in train]
    for _ in range(rounds):
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for view in (0, 1):
            at = np.flatnonzero(left)
            if not len(at):
                break
            order = at[np.argsort(fitted[view].odds(pool[view][at]), kind="stable")]
            low, high = round(handed * (1 - share)), round(handed * share)
            low, high = min(low, len(order) // 2), min(high, len(order) // 2)
            chosen = np.r_[order[:low], order[len(order) - high:]]
            new.append((chosen, np.r_[np.zeros(low), np.ones(high)]))
            left[chosen] = False
        for view, (chosen, labels) in zip((1, 0), new):  # each to the other
            x, t, w = train[view]
            train[view] = (np.r_[x, pool[view][chosen]], np.r_[t, labels], np.r_[w, np.full(len(chosen), 0.5)])
        fitted = [Logistic().fit(*t) for t in train]
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    w = prior_weight[aside]
    scale = [Logistic().fit(f.odds(v[aside])[:, None], y[aside], w) for f, v in zip(fitted, views)]
    out = CoTrained(fitted, scale, prior)
    out.both = Logistic().fit(out.sum(views[0][aside], views[1][aside])[:, None], y[aside], w)
    return out


def _features(batches):
    for b, content, meta in _views(batches):
        yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("h"), pa.array([r.tobytes() for r in content.astype(np.float32)], pa.binary()),
                                          pa.array([r.tobytes() for r in meta.astype(np.float32)], pa.binary())], names=["quality", "h", "content", "meta"])


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata of docs, null where a column is absent."""
    has = set(docs.columns)
    col = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select("doc_id", "text", col("n_chars", "long"), col("lang", "string"), col("source", "string"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, pool: int = POOL_DOCS) -> CoTrained | None:
    """Fit on at most sample documents per label and a pool of about pool others, none of the held-out third.

    labels(doc_id, quality) other than 0 and 1 are left out, and so is an id labelled both ways.
    """
    known = (labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("quality"))
             .filter("lo = quality").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality"))
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    few = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    few = few[0].unionByName(few[1])
    d = _columns(docs).filter("text is not null").withColumn("h", F.xxhash64("doc_id"))
    total = docs.count()
    unlabelled = (d.filter(~held_out(F.col("doc_id"))).filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.5 * pool / max(1, total))))
                  .join(known.select("doc_id"), "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("int")))
    rows = (d.join(few, "doc_id").select(*unlabelled.columns).unionByName(unlabelled)
            .mapInArrow(_features, "quality int, h long, content binary, meta binary").collect())  # bounded by sample and pool
    rows.sort(key=lambda r: (r.h, bytes(r.content)))
    stack = lambda rs: tuple(np.array([np.frombuffer(r[c], np.float32) for r in rs], float).reshape(len(rs), -1) for c in ("content", "meta"))
    told, rest = [r for r in rows if r.quality is not None], [r for r in rows if r.quality is None][:pool]
    if not told:
        return None
    views, free = stack(told), stack(rest)
    if not rest:
        free = tuple(v[:0] for v in views)
    return co_train(views, np.array([r.quality for r in told], float), free, n[1] / (n[0] + n[1]))


def _score(model: CoTrained | None):
    def run(batches):
        for b, content, meta in _views(batches):
            p = model.probability(content, meta) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, pool: int = POOL_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, and n_chars, lang, source where present).

    score is the probability of quality 1. A null text is scored as an empty one; null metadata is a value of its own.
    Without usable labels every score is 0.5. Repeated rows get the same score; other columns are ignored.
    """
    model = train(docs, labels, sample, pool)
    out = _columns(docs).mapInArrow(_score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
