"""SentencePiece byte-pair encoding by a table of last tokens, and decoding.

The tokens of a prefix do not depend on what follows it, so every prefix of a text has one last token. An automaton over
all pieces names the pieces that end at a position; of these exactly one may follow the last token of the
prefix before it, where two tokens may stand side by side if merging their joined characters gives the two again. One
pass fills the table and one walk backwards reads the ids, so the time grows with the length whatever the text holds.
Texts are cut where no piece crosses, before runs of spaces, and the ids of short segments are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k"
SPACE = "▁"
#: Segments of up to so many characters are remembered, two generations of so many each.
REMEMBER_CHARS, REMEMBER = 32, 250_000
PAIRS = 1_000_000
#: What the library shows for the unknown id and for bytes that are no UTF-8: fixed values.
UNKNOWN_TEXT, BAD_BYTE = " ⁇ ", "�"


class PieceModel:
    """Encoder and decoder of a byte-pair model with byte fallback and no normalization but the leading space."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)  # reads the vocabulary
        if lib.normalize("  ﬁ Ａ  ") != f"{SPACE * 3}ﬁ{SPACE}Ａ{SPACE * 2}":
            raise ValueError("the model normalizes texts or sets no leading space")
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if lib.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        plain = [i for i in range(n) if i not in self.byte_of and i not in self.silent and i != self.unknown]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = [lib.get_score(i) for i in range(n)]
        #: What a token gives in UTF-8, spaces as spaces; bytes of the fallback as they are.
        self.bytes = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else
                      UNKNOWN_TEXT.encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

        # pieces that merging can reach, with the pair of their last merge
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            tokens, last = self._merge(self.pieces[i])
            if tokens == [self.pieces[i]]:
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
                if last:
                    self.halves[i] = last
        self.automaton.make_automaton()
        # a merge comes after those of its halves; pieces that share their score, or break that order, need the merges themselves
        shared: dict[float, int] = {}
        for i in plain:
            if len(self.pieces[i]) > 1:
                shared[self.score[i]] = shared.get(self.score[i], 0) + 1
        self.rank = {i: -self.score[i] if i in self.halves else float("-inf") for i in plain}
        self.odd = {i for i, (a, b) in self.halves.items() if shared[self.score[i]] > 1 or max(self.rank[a], self.rank[b]) >= self.rank[i]}
        for i in sorted(self.halves, key=lambda i: len(self.pieces[i])):
            if self.odd.intersection(self.halves[i]):
                self.odd.add(i)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.segments = self._cuts()

    def _cuts(self) -> re.Pattern | None:
        """A pattern whose matches make up any text, no piece crossing from one into the next; None if spaces may stand inside pieces."""
        left: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                left.setdefault(b, set()).add(a)
        if left.get(SPACE, set()) - {SPACE}:
            return None
        line = "" if left.get("\n", set()) - {"\n"} or any("\n" in v for c, v in left.items() if c != "\n") else "\n"
        return re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n+" if line else ""))

    def _merge(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """The symbols left after merging neighbours, highest score first and leftmost on ties, and the last merge."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []
        last = None

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                whole = parts[a] + parts[b]
                i = self.ids.get(whole)
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, b, whole))
        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if parts[a] is None or b >= len(parts) or parts[b] is None or after[a] != b or parts[a] + parts[b] != whole:
                continue
            last = self.ids[parts[a]], self.ids[parts[b]]
            parts[a], parts[b] = whole, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None], last

    def may_follow(self, u: int, v: int) -> bool:
        """Whether token v may stand right after token u: no merge across their border comes before one of their own."""
        key = u << 20 | v
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._may_follow(u, v)
        return ok

    def _may_follow(self, u: int, v: int) -> bool:
        if u in self.odd or v in self.odd:
            return self._merge(self.pieces[u] + self.pieces[v])[0] == [self.pieces[u], self.pieces[v]]
        # a: the symbol left of the border, until it goes into its parent at rank until_a; b likewise right of it
        a, until_a, b, until_b = u, float("inf"), v, float("inf")
        while True:
            c = self.ids.get(self.pieces[a] + self.pieces[b])
            if c is not None:
                if c in self.odd:
                    return self._merge(self.pieces[u] + self.pieces[v])[0] == [self.pieces[u], self.pieces[v]]
                if -self.score[c] < until_a and -self.score[c] <= until_b:
                    return False
            # back in time: undo the later of the two merges
            ra, rb = self.rank[a], self.rank[b]
            if a not in self.halves and b not in self.halves:
                return True
            if b not in self.halves or (a in self.halves and ra > rb):
                a, until_a = self.halves[a][1], ra
            else:
                b, until_b = self.halves[b][0], rb

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a text that already has its spaces as the piece model writes them."""
        table = [-1] * len(text)
        get, pairs = self.pairs.get, self._may_follow
        for end, (t, size) in self.automaton.iter(text):
            if table[end] >= 0:
                continue
            at = end - size
            if at >= 0:
                u = table[at]
                if u >= 0:  # else a character without piece, which merges with nothing
                    ok = get(u << 20 | t)
                    if ok is None:
                        ok = self.may_follow(u, t)
                    if not ok:
                        continue
            table[end] = t
        out, at = [], len(text) - 1
        while at >= 0:
            t = table[at]
            if t >= 0:
                out.append(t)
                at -= len(self.pieces[t])
            else:
                out.extend(self.byte_id[b] for b in reversed(text[at].encode()))
                at -= 1
        out.reverse()
        return tuple(out)

    def _look(self, s: str) -> tuple[int, ...]:
        ids = self.old.get(s)
        if ids is None:
            ids = self.segment(s)
        if len(s) <= REMEMBER_CHARS:
            if len(self.young) >= REMEMBER:
                self.young, self.old = {}, self.young
            self.young[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (" " + text).replace(" ", SPACE)
        if self.segments is None:
            return list(self.segment(text))
        out: list[int] = []
        put, look = out.extend, self._look
        for s in self.segments.findall(text):
            put(self.young.get(s) or look(s))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space goes, runs of byte ids are read as UTF-8, each bad byte as U+FFFD."""
        table = self.bytes
        first = next((i for i in ids if i not in self.silent), None)
        spaced = first is not None and self.pieces[first].startswith(SPACE)
        if self.silent.isdisjoint(ids):  # a control id ends a run of bytes
            try:
                return b"".join([table[i] for i in ids]).decode()[spaced:]
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                out.append(_lenient(bytes(run)))
                run.clear()
                out.append(table[i].decode())
        return "".join([*out, _lenient(bytes(run))])[spaced:]


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BAD_BYTE)
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(name: str = MODEL) -> PieceModel:
    """The model <name>.model, built once in a Python worker."""
    import public_tokenizers
    return PieceModel(public_tokenizers.path(f"{name}.model"))


def _row(docs: DataFrame, columns: tuple[str, ...], value: str) -> tuple[DataFrame, str]:
    src = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), value)
    return src, src.schema["row"].dataType.simpleString()


def encode(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), name: str = MODEL) -> DataFrame:
    """(columns, ids array<int>) for every row of docs(text and columns); a null or empty text has no ids."""
    def run(batches):
        model = load(name)
        for b in batches:
            ids = [model.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])
    src, kind = _row(docs, columns, "text")
    return src.mapInArrow(run, f"row {kind}, ids array<int>").select("row.*", "ids")


def decode(rows: DataFrame, columns: tuple[str, ...] = ("doc_id",), name: str = MODEL) -> DataFrame:
    """(columns, text) for every row of rows(ids and columns); null ids and null elements are left out of the text."""
    def run(batches):
        model = load(name)
        for b in batches:
            texts = [model.decode([i for i in ids or () if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])
    src, kind = _row(rows, columns, "ids")
    return src.mapInArrow(run, f"row {kind}, text string").select("row.*", "text")


def round_trip(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), name: str = MODEL) -> DataFrame:
    """(columns, n_tokens, ids_sha256, decoded_sha256, same): every text encoded, decoded again, and hashed.

    Each row of docs is a document, repeated rows and rows without id included. A null text is empty: no ids, and the
    hashes are those of nothing. ids_sha256 is over decimal ids joined by commas, decoded_sha256 over UTF-8; same tells
    whether the text came back. Extra columns are ignored unless named; an empty table gives no row. Whole texts are
    taken, one pass without shuffle, in memory that follows the longest text.
    """
    def run(batches):
        model = load(name)
        digits = [str(i) for i in range(len(model.pieces))]
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha, same = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = model.encode(t or "")
                back = model.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(",".join([digits[i] for i in ids]).encode()).hexdigest())
                text_sha.append(sha(back.encode()).hexdigest())
                same.append(back == (t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())],
                                             names=["row", "n_tokens", "ids_sha256", "decoded_sha256", "same"])
    src, kind = _row(docs, columns, "text")
    return (src.mapInArrow(run, f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
            .select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "same"))
