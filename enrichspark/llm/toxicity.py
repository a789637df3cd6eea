"""Toxicity: a support vector machine on a gapped string kernel, with Nyström landmarks.

The kernel counts common subsequences of ORDER bytes of two words, each weighted by DECAY to the power of the bytes it
spans in both, so that characters put between or left out cost little. Landmarks are words of labelled texts that tell the
labels apart, chosen to differ from one another; a word is described by its kernel values with them. Training is by
multiple instances: a sentence of label 0 is represented by its most suspicious word, another by the words that
label counts find telling and by its highest word in the machine's own eyes. A document is scored from its two highest words, against its usual ones, through a logistic fit.

Words are what is left between white space when all but letters is taken out; letters standing alone one after the
other are put together. Long words are looked at in overlapping pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.llm.common import byte_view, chunks, held_out
from enrichspark.llm.near import LOWER, span_hashes

#: Bound of the training sample: documents per label.
SAMPLE_DOCS = 1500
LANDMARKS, APART, ALIKE = 40, 0.6, 0.3
ORDER, DECAY = 4, 0.75
WIDTH = 24
ROUNDS = 3
THRESHOLD = 0.7
CACHE = 400_000
IS_LETTER = np.zeros(256, bool)
IS_LETTER[128:] = True
IS_LETTER[ord("A"):ord("Z") + 1] = IS_LETTER[ord("a"):ord("z") + 1] = True
IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
SENTENCE = re.compile(r"[.!?\n]+")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, stop, text): the words of every text in a cleaned buffer, single letters in a row joined."""
    keep = IS_LETTER[data] | IS_SPACE[data]
    at = np.r_[0, np.cumsum(keep)][offsets]
    d = LOWER[data[keep]]

    def spans(d, at):
        n, w = len(d), IS_LETTER[d]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[at[:-1][at[:-1] < n]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        a, z = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return a, z, np.searchsorted(at, a, side="right") - 1

    a, z, doc = spans(d, at)
    if len(a) > 1:
        alone = z - a == 1
        join = np.flatnonzero(alone[:-1] & alone[1:] & (doc[:-1] == doc[1:]))
        if len(join):
            gone = np.zeros(len(d) + 1, np.int64)
            np.add.at(gone, z[join], 1)
            np.add.at(gone, a[join + 1], -1)
            stay = np.cumsum(gone)[:-1] == 0
            at = np.r_[0, np.cumsum(stay)][at]
            d = d[stay]
            a, z, doc = spans(d, at)
    return d, a, z, doc


def pieces(words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with 0 to WIDTH, word): each word, or overlapping pieces of one that is longer."""
    out, of = [], []
    for i, w in enumerate(words_):
        for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
            out.append(w[at:at + WIDTH].ljust(WIDTH, b"\0"))
            of.append(i)
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, WIDTH), np.array(of, int)


def raw_kernel(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of word x[i] with word y[i], both padded (with different bytes).

    reach[k] holds, for every place of y, the weight of the common subsequences of k + 1 bytes that end there or
    before, decayed to the current byte of x.
    """
    n, q = y.shape
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    reach = [np.zeros((q, n), np.float32) for _ in range(order - 1)]
    total, d = np.zeros(n, np.float32), np.float32(decay)
    for p in range(int((x != 0).any(axis=1).sum())):
        same = ((y == x[p]) & (x[p] != 0)).astype(np.float32)
        same *= d * d
        ends = [same]
        for k in range(order - 1):
            m = np.zeros((q, n), np.float32)
            np.multiply(same[1:], reach[k][:-1], out=m[1:])
            ends.append(m)
        total += ends[order - 1].sum(axis=0)
        for k in range(order - 1):
            m = ends[k]
            for j in range(1, q):
                m[j] += d * m[j - 1]
            reach[k] *= d
            reach[k] += m
    return total


class Kernel:
    """Kernel values with the landmarks, scaled so that a word has 1 with itself."""

    def __init__(self, landmarks: list[bytes]):
        self.names = [w[:WIDTH] for w in landmarks]
        self.size = np.array([len(w) for w in self.names])
        self.marks = np.frombuffer(b"".join(w.ljust(int(self.size.max()), b"\xff") for w in self.names), np.uint8).reshape(len(self.names), -1)
        self.bits = np.zeros((256, len(self.names)), np.uint32)
        for j, w in enumerate(self.names):
            for i, c in enumerate(w):
                self.bits[c, j] |= np.uint32(1 << i)
        self.norm = np.sqrt(raw_kernel(pieces(self.names)[0], self.marks) + 1e-12)

    def common(self, x: np.ndarray) -> np.ndarray:
        """Longest common subsequence of every word with every landmark, bit-parallel over both."""
        v = np.full((len(x), len(self.names)), 0xFFFFFFFF, np.uint32)
        for p in range(int((x != 0).any(axis=0).sum())):
            m = self.bits[x[:, p]]
            v = (v + (v & m)) | (v & ~m)
        full = ((np.uint64(1) << self.size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        return np.bitwise_count(~v & full)

    def __call__(self, words_: list[bytes]) -> np.ndarray:
        """words x landmarks. Pairs without a common subsequence of ORDER bytes are 0; the others are computed."""
        out = np.zeros((len(words_), len(self.names)), np.float32)
        x, of = pieces(words_)
        size = (x != 0).sum(axis=1)
        order = np.argsort(size, kind="stable")
        order = order[size[order] >= ORDER]
        for a in range(0, len(order), 8192):
            at = order[a:a + 8192]
            i, j = np.nonzero(self.common(x[at]) >= ORDER)
            if not len(i):
                continue
            some, back = np.unique(i, return_inverse=True)
            w = x[at[some]]
            own = raw_kernel(w, np.where(w == 0, 255, w)[:, :size[at].max()])
            for b in range(0, len(i), 4096):
                r, c = i[b:b + 4096], j[b:b + 4096]
                k = raw_kernel(x[at[r]], self.marks[c]) / (np.sqrt(own[back[b:b + 4096]] + 1e-12) * self.norm[c])
                np.maximum.at(out, (of[at[r]], c), k)
        return out


class Machine:
    """Linear support vector machine on the Nyström map of a kernel, with a logistic link from word scores to documents."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        gram = kernel(kernel.names).astype(np.float64)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        value = np.maximum(value, 1e-3)
        self.map = vector / np.sqrt(value)
        self.w, self.b, self.link = np.zeros(gram.shape[0]), -1.0, np.zeros(5)

    def scores(self, k: np.ndarray) -> np.ndarray:
        return k @ (self.map @ self.w) + self.b

    def fit(self, k: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> None:
        """Squared hinge loss with labels of equal total weight, by Newton steps on the points inside the margin."""
        x, s = np.c_[k @ self.map, np.ones(len(k))], np.where(y == 1, 1.0, -1.0)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        penalty = ridge * np.eye(x.shape[1])
        penalty[-1, -1] = 1e-9
        w = np.zeros(x.shape[1])
        loss = lambda v: float(weight @ np.maximum(0, 1 - s * (x @ v)) ** 2 + v @ penalty @ v)
        now = loss(w)
        for _ in range(60):
            at = s * (x @ w) < 1
            xa, wa = x[at], weight[at]
            g = xa.T @ (wa * (xa @ w - s[at])) + penalty @ w
            step = np.linalg.solve((xa * wa[:, None]).T @ xa + penalty, g)
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > now - 1e-12:
                size /= 2
            if size <= 1e-4:
                break
            w = w - size * step
            now = loss(w)
        self.w, self.b = w[:-1], w[-1]

    def features(self, best: np.ndarray, second: np.ndarray, usual: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(best)), np.clip(second, -3, 3), np.clip(best, -3, 3), -usual, -np.log1p(count) / 5]

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression by damped Newton steps, weighted to the share that label 1 has outside the sample."""
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        use = np.ones(x.shape[1], bool)
        while True:
            self.link = np.zeros(x.shape[1])
            self.link[use] = self._newton(x[:, use], y, weight)
            wrong = use & (self.link < 0)
            wrong[0] = False
            if not wrong.any():
                return
            use &= ~wrong  # the highest words never lower a score; other words and length never raise it

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        a = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            g = x.T @ (weight * (p - y)) + 0.02 * a
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(a))
            step = np.linalg.solve(h, g)
            a -= step * min(1, 2 / np.abs(step).max(initial=1e-9))
        return a

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-x @ self.link))


def _top_two(score: np.ndarray, doc: np.ndarray, docs: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    best, second = np.full(docs, floor), np.full(docs, floor)
    order = np.lexsort((-score, doc))
    s, d = score[order], doc[order]
    first = np.r_[True, d[1:] != d[:-1]] if len(d) else np.zeros(0, bool)
    best[d[first]] = s[first]
    nxt = np.r_[False, first[:-1]] & ~first if len(d) else first
    second[d[nxt]] = s[nxt]
    return np.maximum(best, floor), np.maximum(second, floor)


def _word_list(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    d, a, z, _ = words(data, np.array([0, len(data)]))
    raw = d.tobytes()
    return [raw[i:j] for i, j in zip(a.tolist(), z.tolist())]


def learn(rows: list[tuple[str, int]], share: float | None = None) -> Machine | None:
    """Fit on (text, label) rows, share of which in all have label 1; None unless both labels and telling words occur."""
    y = np.array([label for _, label in rows], int)
    if len(set(y.tolist())) < 2:
        return None
    vocabulary: dict[bytes, int] = {}
    sentences = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int32)
                  for ws in map(_word_list, SENTENCE.split(text or "")) if ws] for text, _ in rows]
    seen = np.zeros((2, len(vocabulary)))
    for label, doc in zip(y, sentences):
        if doc:
            seen[label, np.unique(np.concatenate(doc))] += 1
    if not vocabulary:
        return None
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    # signed root of the likelihood ratio of a word's documents
    usual = seen.sum(axis=0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nansum(np.where(seen > 0, seen * np.log(seen / (n[:, None] * usual)), 0), axis=0)
    tell = np.sqrt(2 * np.maximum(g, 0)) * np.where(seen[1] / n[1] > seen[0] / n[0], 1, -1)
    names = np.array(list(vocabulary), object)
    length = np.array([len(w) for w in names])
    ranked = np.array([i for i in np.argsort(-tell, kind="stable")[:60 * LANDMARKS] if seen[1, i] >= 2 and tell[i] > 1 and length[i] >= ORDER], int)
    if not len(ranked):
        return None
    # landmarks: the word that speaks for most label-1 documents not yet spoken for by a landmark like their words
    column = {int(w): j for j, w in enumerate(ranked)}
    holds = np.zeros((int(n[1]), len(ranked)), bool)
    for i, doc in enumerate(d for label, d in zip(y, sentences) if label == 1):
        holds[i, [column[v] for v in (np.unique(np.concatenate(doc)).tolist() if doc else ()) if v in column]] = True
    against = seen[0, ranked] * n[1] / n[0]
    open_, free, chosen = np.ones(len(holds)), np.ones(len(ranked), bool), []
    while len(chosen) < LANDMARKS and free.any():
        gain = np.where(free, open_ @ holds - against, -1)
        j = int(gain.argmax())
        if gain[j] < 1 and chosen:
            break
        chosen.append(ranked[j])
        like = Kernel([names[ranked[j]]])(list(names[ranked]))[:, 0]
        free[(like >= APART) | (np.arange(len(ranked)) == j)] = False
        open_[holds[:, (like >= ALIKE) | (np.arange(len(ranked)) == j)].any(axis=1)] *= 0.5
    machine = Machine(Kernel([names[i] for i in chosen]))
    k = machine.kernel(list(names))
    score, bar = tell, float(np.sqrt(2 * np.log(len(tell))))  # what the largest of so many words reaches by chance
    bags = [(s, label) for label, doc in zip(y, sentences) for s in doc]
    good, ill = [b for b, label in bags if label == 0], [b for b, label in bags if label == 1]
    telling = [b[tell[b] > bar] for b in ill]
    for step in range(ROUNDS):
        # of sentences with label 0 the highest word; of the others all words that tell and a highest word above 0
        worst = [b[score[b].argmax()] for b in ill] if step else []
        pos = np.concatenate([*telling, np.array([w for w in worst if score[w] > 0], int)]).astype(int)
        neg = np.array([b[score[b].argmax()] for b in good], int)
        if not len(pos) or not len(neg):
            break
        machine.fit(k[np.r_[pos, neg]], np.r_[np.ones(len(pos), int), np.zeros(len(neg), int)])
        score = machine.scores(k)
    x = [np.sort(np.concatenate([score[s] for s in doc] or [np.zeros(0)]))[::-1] for doc in sentences]
    floor = machine.b
    top = np.array([[max(s[0], floor) if len(s) else floor, max(s[1], floor) if len(s) > 1 else floor,
                     s[s > floor].mean() if (s > floor).any() else floor, len(s)] for s in x])
    machine.calibrate(machine.features(*top.T), y, float(y.mean()) if share is None else share)
    return machine


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Machine | None:
    """Fit on at most sample documents per label, those of the smallest hash of doc_id, outside the held-out third.

    labels(doc_id, toxic) other than 0 and 1 are left out, and so is an id labelled both ways.
    """
    known = (labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("toxic"))
             .filter("lo = toxic").filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("toxic") == t).orderBy("h", "doc_id").limit(sample).select("doc_id", "toxic", "h") for t in n]
    if len(parts) < 2:
        return None
    few = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(few, "doc_id").orderBy("h", "doc_id", "text").select("text", "toxic").collect()  # at most 2 x sample documents
    return learn([(r.text or "", r.toxic) for r in rows], n.get(1, 0) / sum(n.values()))


def _score(machine: Machine | None):
    def run(batches):
        cache: dict[int, float] = {}
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            out = np.zeros(len(offsets) - 1)
            for x, y in chunks(offsets):
                part, off = data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]
                if machine is None:
                    continue
                best = second = usual = np.full(y - x, machine.b)
                count = np.zeros(y - x)
                d, a, z, doc = words(part, off) if len(part) else (part, *(np.zeros(0, int),) * 3)
                if len(a):
                    u, first, back = np.unique(span_hashes(d, a, z), return_index=True, return_inverse=True)
                    ids = u.tolist()
                    if len(cache) > CACHE:
                        cache.clear()
                    new = [i for i, h in enumerate(ids) if h not in cache]
                    if new:
                        raw = d.tobytes()
                        got = machine.scores(machine.kernel([raw[a[first[i]]:z[first[i]]] for i in new]))
                        cache.update(zip((ids[i] for i in new), got.tolist()))
                    s = np.array([cache[h] for h in ids])[back]
                    on = s > machine.b
                    count, n = np.bincount(doc, minlength=y - x), np.bincount(doc[on], minlength=y - x)
                    usual = np.where(n > 0, np.bincount(doc[on], s[on], minlength=y - x) / np.maximum(n, 1), machine.b)
                    best, second = _top_two(s[on], doc[on], y - x, machine.b)
                out[x:y] = machine.probability(machine.features(best, second, usual, count))
            keep = [i for i, c in enumerate(b.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(out, pa.float64())], names=[*(b.schema.names[i] for i in keep), "score"])
    return run


def score(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    A null, empty or letterless text gets the score of a text without suspicious words; without a model all scores are 0.
    Repeated rows get the same score; extra columns are ignored.
    """
    out = docs.select("doc_id", "text").mapInArrow(_score(machine), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Train on two thirds of the labelled rows and score every document: see train and score."""
    return score(docs, train(docs, labels, sample))


__all__ = ["Kernel", "Machine", "learn", "raw_kernel", "score", "toxicity", "train", "words"]
