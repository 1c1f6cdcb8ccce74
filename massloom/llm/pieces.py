"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For BPE every prefix of a text has one last token. ``encode_segment`` walks the
matches of an Aho-Corasick automaton over all pieces and, for each end position, keeps
the one match whose token may follow the last token stored at the match's start; the
ids are read backwards from the end. Whether two tokens may stand side by side is
decided by undoing their merges from the seam outwards (``PieceModel.compatible``).

Texts are cut before a word mark that follows another character and around line
feeds, where no piece of the vocabulary reaches across (checked at load), so a segment's ids do not depend
on its neighbours. Those of frequent segments are kept in a cache bounded by bytes: a young and an old
half, of which the old one goes when the young one is full, so what is still in use stays.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from massloom.llm.arrow import add_columns, column

MARK = "▁"
#: Bytes of each half of a worker's cache of segments, and entries of each half of its cache of pairs.
CACHE_BYTES = 24 << 20
PAIR_ENTRIES = 120_000
#: Longer segments are not kept.
CACHE_LENGTH = 48
#: What a cache entry takes besides its key's and value's content: two object heads and a slot of the table.
ENTRY_BYTES = 190
PAIR_STEP = 1 << 22  # above every token, symbols without a piece included


class PieceModel:
    """Vocabulary of one model file with the tables that encoding needs."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.eos = lib.eos_id()
        self.size = size
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(size) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i in range(size) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id_of = {self.piece[i]: i for i in normal}
        order = {s: r for r, s in enumerate(sorted({-lib.get_score(i) for i in normal}))}
        self.rank = [-1] * size
        for i in normal:
            if len(self.piece[i]) > 1:
                self.rank[i] = order[-lib.get_score(i)]
        multi = [self.piece[i] for i in normal if len(self.piece[i]) > 1]
        self.cut_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in multi)
        self.cut_lines = not any("\n" in p for p in multi)
        if self.cut_marks and self.cut_lines:
            self.segment = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        elif self.cut_marks:
            self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.segment = re.compile(r"[\s\S]+")
        marks = set(string.punctuation)
        joined = {x for p in multi for x, c in zip(p, p[1:], strict=False) if c in marks and x.isalnum()}
        #: an alphanumeric character before a mark, a pair that no piece holds
        self.closing = re.compile(rf"[^\W_{re.escape(''.join(sorted(joined)))}](?=[{re.escape(string.punctuation)}])")
        #: identity normaliser only: the tables below know nothing of a character map
        if lib.normalize("ﬁ Å") != f"{MARK}ﬁ{MARK}Å":
            raise ValueError("the model normalises characters; only identity normalisation is supported")
        #: the two symbols whose merge makes a token
        self.left, self.right = array("i", bytes(4 * size)), array("i", bytes(4 * size))
        automaton = ahocorasick.Automaton()
        for i in normal:
            p = self.piece[i]
            if len(p) == 1:
                automaton.add_word(p, (0, i))
            else:
                split = self._last_merge(p)
                if split:  # else no run of merges ends in this piece, so it is never output
                    self.left[i], self.right[i] = split
                    automaton.add_word(p, (1 - len(p), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.length = [len(p) for p in self.piece]
        self.single = {p for p in self.id_of if len(p) == 1}
        self._pairs: dict[int, bool] = {}
        self._old_pairs: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._bytes = 0

    def _symbol(self, text: str) -> int:
        return self.id_of.get(text, self.size + ord(text[0]))

    def _text(self, token: int) -> str:
        return self.piece[token] if token < self.size else chr(token - self.size)

    def _rank(self, token: int) -> int:
        return self.rank[token] if token < self.size else -1

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two symbols whose merge makes the whole of ``text``, or None."""
        parts = list(text)
        while len(parts) > 2:
            best = min(((self.rank[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id_of), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self._symbol(parts[0]), self._symbol(parts[1])) if len(parts) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """True if the text of ``a`` then ``b`` encodes to just these two tokens.

        Merges are undone latest first. Whenever the two symbols then at the seam
        could merge with a rank that beats the merge just undone, BPE would have
        joined them instead. Equal ranks go to the left.
        """
        key = a * PAIR_STEP + b
        known = self._pairs.get(key)
        if known is None:
            known = self._old_pairs.get(key)
            if known is None:
                known = self._stand(a, b)
            if len(self._pairs) >= PAIR_ENTRIES:
                self._old_pairs, self._pairs = self._pairs, {}
            self._pairs[key] = known
        return known

    def _stand(self, a: int, b: int) -> bool:
        bound, x, y = 1 << 60, a, b
        while True:
            joined = self.id_of.get(self._text(x) + self._text(y))
            if joined is not None and self.rank[joined] < bound:
                return False
            rx, ry = self._rank(x), self._rank(y)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                bound, x = rx, self.right[x]
            else:
                bound, y = ry + 1, self.left[y]

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a segment that needs no context; characters without a piece become byte ids."""
        n = len(text)
        last = [-1] * (n + 1)
        compatible, known, length, size = self.compatible, self._pairs.get, self.length, self.size
        if not self.single.issuperset(text):  # such a character is a symbol of its own
            for i, c in enumerate(text):
                if c not in self.single:
                    last[i + 1] = -2 - ord(c)
        for end, (back, token) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            start = end + back
            if start == 0:
                last[end + 1] = token
            else:
                before = last[start]
                if before < -1:
                    before = size - 2 - before
                if before >= 0:
                    fits = known(before * PAIR_STEP + token)
                    if fits or (fits is None and compatible(before, token)):
                        last[end + 1] = token
        ids: list[int] = []
        at = n
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= length[token]
            else:
                raw = chr(-2 - token).encode("utf-8", "surrogatepass")
                ids.extend(self.byte_id.get(b, self.unknown) for b in reversed(raw)) if self.byte_id else ids.append(self.unknown)
                at -= 1
        ids.reverse()
        return ids

    def _missed(self, segment: str) -> bytes:
        """Encode a segment that the young half of the cache does not hold, a run of closing marks apart."""
        found = self._old.get(segment)
        if found is not None:
            self._keep(segment, found)
            return found
        if segment[1:].isalnum():  # a plain word, the most frequent case
            found = array("i", self.encode_segment(segment)).tobytes()
            self._keep(segment, found)
            return found
        parts, at = [], 0
        for cut in self.closing.finditer(segment):
            end = cut.end()
            parts.append(segment[at:end])
            at = end
        parts.append(segment[at:])
        out = []
        for part in parts:
            found = self._cache.get(part)
            if found is None:
                found = self._old.get(part)
                if found is None:
                    found = array("i", self.encode_segment(part)).tobytes()
                self._keep(part, found)
            out.append(found)
        return out[0] if len(out) == 1 else b"".join(out)

    def _keep(self, segment: str, ids: bytes) -> None:
        if len(segment) <= CACHE_LENGTH:
            self._bytes += ENTRY_BYTES + 2 * len(segment) + len(ids)
            if self._bytes > CACHE_BYTES:
                self._old, self._cache, self._bytes = self._cache, {}, 0
            self._cache[segment] = ids

    def encode(self, text: str, add_eos: bool = True) -> np.ndarray:
        """Ids of a whole text, as int32."""
        out: list[bytes] = []
        if text:
            segments = self.segment.findall(MARK + text.replace(" ", MARK))
            out = list(map(self._cache.get, segments))
            if None in out:
                out = [self._missed(s) if ids is None else ids for s, ids in zip(segments, out, strict=True)]
        if add_eos:
            out.append(np.int32(self.eos).tobytes())
        return np.frombuffer(b"".join(out), dtype=np.int32)


def decoding_table(path: str) -> pa.Array:
    """What each id of a model adds to the decoded bytes; control ids add nothing."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(lib.get_piece_size()):
        p = lib.id_to_piece(i)
        if lib.is_byte(i):
            out.append(bytes([int(p[3:5], 16)]))
        elif lib.is_control(i):
            out.append(b"")
        elif lib.is_unknown(i):
            out.append(" ⁇ ".encode())
        else:
            out.append(p.replace(MARK, " ").encode())
    return pa.array(out, pa.binary())


def decode_lists(lists: pa.Array, table: pa.Array) -> list[str]:
    """The text of each list of ids: the pieces' bytes joined, without the blank in front; a null list is an empty text."""
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, table.take(lists.values)), b"").to_pylist()
    valid = lists.is_valid().to_pylist()
    return [raw[raw[:1] == b" " :].decode("utf-8", "replace") if ok else "" for raw, ok in zip(joined, valid, strict=True)]


_loaded: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of a file, kept with its bounded caches for the next task of this worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows."""

    def make():
        model, table = load(model_path), decoding_table(model_path)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            lists = encoded(model, column(batch, text), True)
            return {ids: lists, decoded: pa.array(decode_lists(lists, table), type=pa.string())}

        return step

    return add_columns(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])


def encoded(model: PieceModel, texts: pa.Array, add_eos: bool) -> pa.Array:
    rows = [model.encode(t or "", add_eos) for t in texts.to_pylist()]
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", add_eos: bool = True) -> DataFrame:
    """Append the token ids of every whole text.

    Null and empty texts give the end id only (no ids where ``add_eos`` is false).
    Repeated rows are encoded alike; an input column named like ``ids`` is replaced.
    """

    def make():
        model = load(model_path)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {ids: encoded(model, column(batch, text), add_eos)}

        return step

    return add_columns(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text that the ids stand for; a null list gives an empty text."""

    def make():
        table = decoding_table(model_path)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {text: pa.array(decode_lists(column(batch, ids).cast(pa.list_(pa.int32())), table), type=pa.string())}

        return step

    return add_columns(df, make, [T.StructField(text, T.StringType())])
