"""Language ID with a bidirectional gated recurrent network over bytes, trained in numpy.

Bytes index three input tables (reset, update, candidate gate); two recurrent layers read them in either direction and
a linear layer labels every position from both states. Training is backpropagation through time on windows of
labelled texts; inference cuts whole texts into windows with some bytes of context on either side, runs thousands of
windows in step, and pools the positions' log probabilities over the document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import byte_view, chunks, held_out

HIDDEN = 8
#: Bound of the training sample: documents taken per language, and the length and number of windows of each.
SAMPLE_DOCS = 400
WINDOW, WINDOWS = 96, 3
EPOCHS, BATCH, RATE = 4, 128, 0.02
SEED = 5
#: Inference: bytes labelled per window, and bytes of context on either side of them.
SPAN, CONTEXT = 384, 24
LANES = 4096
EVIDENCE = 16
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _pooled(total: np.ndarray) -> np.ndarray:
    """Neighbouring positions say much the same, so EVIDENCE bytes count as one independent opinion."""
    q = np.exp((total - total.max(axis=1, keepdims=True)) / EVIDENCE)
    return q / q.sum(axis=1, keepdims=True)


class BiGru:
    """Parameters by name: for d in f, b the tables Ed (256 x 3H) and weights Ud (H x 3H); W (2H x K), c (K)."""

    def __init__(self, params: dict[str, np.ndarray], labels: list[str]):
        self.p, self.labels, self.h = params, labels, params["Uf"].shape[0]

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> BiGru:
        g = np.random.default_rng(seed)
        p = {"W": g.normal(0, 0.3, (2 * hidden, len(labels))), "c": np.zeros(len(labels))}
        for d in "fb":
            p["E" + d], p["U" + d] = g.normal(0, 0.5, (256, 3 * hidden)), g.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden))
        return cls(p, labels)

    def _scan(self, x: np.ndarray, d: str):
        """States (T, B, H) of byte windows x (B, T) read in direction d, with what the backward pass needs."""
        h, e, u = self.h, self.p["E" + d], self.p["U" + d]
        b, t = x.shape
        state, out, keep = np.zeros((b, h)), np.zeros((t, b, h)), {}
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, s = e[x[:, i]], state @ u
            r, z = _sigmoid(a[:, :h] + s[:, :h]), _sigmoid(a[:, h:2 * h] + s[:, h:2 * h])
            n = np.tanh(a[:, 2 * h:] + r * s[:, 2 * h:])
            keep[i] = (state, r, z, n, s[:, 2 * h:])
            state = out[i] = (1 - z) * n + z * state
        return out, keep

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient by backpropagation through time."""
        p, h = self.p, self.h
        b, t = x.shape
        of, kf = self._scan(x, "f")
        ob, kb = self._scan(x, "b")
        both = np.concatenate([of, ob], axis=2)
        q = both @ p["W"] + p["c"]
        q = np.exp(q - q.max(axis=2, keepdims=True))
        q /= q.sum(axis=2, keepdims=True)
        loss = -np.log(q[:, np.arange(b), y] + 1e-12).mean()
        q[:, np.arange(b), y] -= 1
        q /= b * t
        g = {"W": np.einsum("tbh,tbk->hk", both, q), "c": q.sum(axis=(0, 1))}
        back = q @ p["W"].T
        for d, keep, err in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            u, ge, gu, ds = p["U" + d], np.zeros_like(p["E" + d]), np.zeros_like(p["U" + d]), np.zeros((b, h))
            for i in range(t - 1, -1, -1) if d == "f" else range(t):
                old, r, z, n, sn = keep[i]
                ds = ds + err[i]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (old - n) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                da = np.concatenate([dr, dz, dn], axis=1)
                dsum = np.concatenate([dr, dz, dn * r], axis=1)
                np.add.at(ge, x[:, i], da)
                gu += old.T @ dsum
                ds = ds * z + dsum @ u.T
            g["E" + d], g["U" + d] = ge, gu
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> BiGru:
        """Adam over shuffled batches."""
        rng, m, v, k = np.random.default_rng(seed), {}, {}, 0
        steps = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a:a + batch]
                _, g = self.gradient(x[at], y[at])
                k += 1
                lr = rate * (1 - 0.9 * k / steps)
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * grad * grad
                    self.p[name] -= lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)
        return self

    def _tables(self):
        """Single precision, with the halves of the sigmoids folded into the weights."""
        h, out = self.h, {}
        for d in "fb":
            e, u = self.p["E" + d], self.p["U" + d]
            out[d] = [np.ascontiguousarray(a, np.float32) for a in (
                e[:, :h] / 2, e[:, h:2 * h] / 2, e[:, 2 * h:], u[:, :h] / 2, u[:, h:2 * h] / 2, u[:, 2 * h:] / 2)]
        return out

    def label_windows(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sum per window of the log probabilities of positions first..last-1 of x (T x B), windows in falling order of size."""
        t, b = x.shape
        k, tables = len(self.labels), self._tables()
        w, c = self.p["W"].astype(np.float32), self.p["c"].astype(np.float32)
        live = np.searchsorted(-size, -np.arange(t), side="left")  # windows longer than i
        x = x.astype(np.intp)
        at = np.arange(t)[:, None]
        on = ((at >= first) & (at < last)).astype(np.float32)
        logits, out, ones = np.empty((t, b, k), np.float32), np.zeros((b, k), np.float32), np.ones(k, np.float32)
        buf = [np.empty((b, self.h), np.float32) for _ in range(4)]
        for d, wd in (("f", w[:self.h]), ("b", w[self.h:])):
            er, ez, en, ur, uz, un = tables[d]
            h = np.zeros((b, self.h), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                m = int(live[i])
                s, xi = h[:m], x[i, :m]
                r, z, n, g = (a[:m] for a in buf)
                np.dot(s, ur, out=r)
                r += np.take(er, xi, 0, g, "clip")
                np.tanh(r, out=r)
                np.dot(s, uz, out=z)
                z += np.take(ez, xi, 0, g, "clip")
                np.tanh(z, out=z)
                np.dot(s, un, out=n)
                r += 1
                n *= r
                n += np.take(en, xi, 0, g, "clip")
                np.tanh(n, out=n)
                # h = n + (1 + z) / 2 * (h - n)
                np.subtract(s, n, out=g)
                z += 1
                g *= z
                g *= 0.5
                np.add(n, g, out=s)
                if d == "f":
                    np.dot(s, wd, out=logits[i, :m])
                else:
                    q = s @ wd
                    q += logits[i, :m]
                    q += c
                    np.clip(q, -60, 60, out=q)
                    q -= np.log(np.exp(q) @ ones)[:, None]
                    q *= on[i, :m, None]
                    out[:m] += q
        return out

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """texts x labels: the log probabilities of a text's positions, summed."""
        n = np.diff(offsets)
        parts = -(-n // SPAN)
        doc = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end = offsets[:-1][doc] + nth * SPAN, np.minimum(offsets[:-1][doc] + (nth + 1) * SPAN, offsets[1:][doc])
        lo, hi = np.maximum(begin - CONTEXT, offsets[:-1][doc]), np.minimum(end + CONTEXT, offsets[1:][doc])
        total = np.zeros((len(n), len(self.labels)))
        order = np.argsort(lo - hi, kind="stable")
        for a in range(0, len(order), LANES):
            at = order[a:a + LANES]
            size = hi[at] - lo[at]
            grid = np.minimum(lo[at][None, :] + np.arange(size[0])[:, None], len(data) - 1)
            np.add.at(total, doc[at], self.label_windows(data[grid], size, begin[at] - lo[at], end[at] - lo[at]))
        return total

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """texts x labels: probabilities from the mean log probability of a text's positions, sharpened by its length."""
        return _pooled(self.totals(data, offsets))


def _draw(batches):
    """(lang, h, windows): WINDOWS byte windows from places of the whole text that its hash decides; short texts are padded with spaces."""
    for pdf in batches:
        out = []
        for text, h in zip(pdf["text"], pdf["h"]):
            data = text.encode()
            rng = np.random.default_rng(h & (2**63 - 1))
            at = rng.integers(0, max(1, len(data) - WINDOW + 1), min(WINDOWS, -(-len(data) // WINDOW)))
            out.append(b"".join(data[i:i + WINDOW].ljust(WINDOW) for i in at))
        yield pdf[["lang", "h"]].assign(windows=out)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> BiGru | None:
    """Fit on at most sample documents per language, those of the smallest hash, outside the held-out third.

    Rows without text or language teach nothing; None if no row is left.
    """
    known = docs.filter("lang is not null and text is not null and length(text) > 0").filter(~held_out(F.col("doc_id")))
    known = known.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    # twice the share asked for passes the hash, the smallest are kept
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample / n)))])
    near = known.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rows = near.mapInPandas(_draw, "lang string, h long, windows binary").collect()
    labels, x, y, used = sorted(counts), [], [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r.h, bytes(r.windows))):
        if used[r.lang] < sample:
            used[r.lang] += 1
            w = np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW)
            x.append(w)
            y += [labels.index(r.lang)] * len(w)
    if not x:
        return None
    return BiGru.new(labels).fit(np.concatenate(x), np.array(y))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.r_[0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))]
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(model: BiGru | None, lift: str | None):
    new = {"lang_pred": pa.string(), "score": pa.float64()} | ({lift: pa.float64()} if lift else {})

    def run(batches):
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            n = len(offsets) - 1
            lang, score, over = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if model and n:
                for a, z in chunks(offsets):
                    at = np.flatnonzero(has_letter(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])) + a
                    if len(at):
                        total = model.totals(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])[at - a]
                        best, q = total.argmax(axis=1), _pooled(total)
                        lang[at], score[at] = np.array(model.labels, object)[best], q[np.arange(len(at)), best]
                        over[at] = np.exp(total.max(axis=1) / np.diff(offsets)[at]) * len(model.labels)
            keep = [i for i, c in enumerate(b.schema.names) if c not in new]
            made = [pa.array(v.tolist(), t) for v, t in zip((lang, score, over), new.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *made], names=[*(b.schema.names[i] for i in keep), *new])
    return run


def predict(docs: DataFrame, model: BiGru | None, lift: str | None = None) -> DataFrame:
    """Every row of docs with lang_pred and score (the pooled probability of that language, 0 to 1).

    A null text, one without letters, or any text if there is no model is `und` with score 0. Columns lang_pred and
    score of docs are replaced; others are kept and not looked at. Repeated rows get the same answer.
    The column named by lift, if any, gets the geometric mean, over the text's bytes, of that language's probability as a multiple of
    an even share among the known ones. Other than score it doesn't sink with the length; `und` has 0.
    """
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", lift)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own).mapInArrow(_predict(model, lift), f"{schema}, lang_pred string, score double" + (f", {lift} double" if lift else ""))


def identify(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row: train on two thirds, predict all."""
    model = train(docs, sample)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
