"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is a run of documents of one task. Its words become numbers: words that occur
in no benchmark item cannot be part of a match and end a run, so only runs of benchmark
words enter the index. Each shard's index is a suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet tree with rank counts, and sampled suffix positions. All
windows are searched backwards at once, occurrences are located by stepping to the next
sample, and the hit words of a document are merged to spans.

A document lies in one shard, and the windows go to every task, so a benchmark of one block shuffles nothing.
Items are cut into segments of bounded length, distinct ones are dealt to blocks of bounded size by hash, and each block is one pass over the
documents' texts that writes hits alone: row numbers, spans and items. These are joined to the documents at the end. The driver and
the tasks hold one block at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import column, release, without
from massloom.session import written

#: Bytes of benchmark segments that one pass takes, on average over the passes, and the windows that begin in a segment at most.
BLOCK_BYTES = 16 << 20
SEGMENT_WINDOWS = 8192
#: Indexed words after which a shard is closed.
SHARD_WORDS = 1 << 19
SAMPLE = 8

#: bytes.translate table: A-Z to lower case, ASCII other than letters and digits to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(FOLD).split() if text else []


def ranks_by_doubling(seq: np.ndarray) -> np.ndarray:
    """Suffix array of ``seq``; suffixes are told apart by doubling the compared length."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    changed = np.ones(n, dtype=np.int64)
    changed[1:] = seq[order[1:]] != seq[order[:-1]]
    rank[order] = np.cumsum(changed) - 1
    step = 1
    while changed.sum() < n and step < n:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        changed = np.ones(n, dtype=np.int64)
        changed[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(changed) - 1
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of small non-negative integers."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        """``seq`` ends with its only 0, the smallest symbol."""
        self.n = n = len(seq)
        self.sample = sample
        order = ranks_by_doubling(seq)
        self.bits = max(1, int(seq.max()).bit_length())
        bwt = seq[order - 1]
        counts = np.bincount(seq, minlength=(1 << self.bits) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[n]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.marked = marked
        self.samples = order[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``at`` places of the transform."""
        start = np.zeros_like(at)
        end = at
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ranks[k]
            bit = (symbol >> b) & 1 == 1
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, self.zeros[k] + s1, start - s1)
            end = np.where(bit, self.zeros[k] + e1, end - e1)
        return (end - start).astype(np.int64)

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform's symbol at each place and its rank there."""
        symbol = np.zeros_like(at)
        start = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ranks[k]
            bit = ones[at + 1] - ones[at] == 1
            s1, e1 = ones[start], ones[at]
            start = np.where(bit, self.zeros[k] + s1, start - s1)
            at = np.where(bit, self.zeros[k] + e1, at - e1)
            symbol = symbol * 2 + bit
        return symbol, at - start

    def search(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern ``symbols[start : start + length]``."""
        lo = np.zeros(len(starts), dtype=np.int64)
        hi = np.full(len(starts), self.n, dtype=np.int64)
        live = np.arange(len(starts))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            symbol = symbols[starts[live] + lengths[live] - back].astype(np.int64)
            lo[live] = self.before[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.rank(symbol, hi[live])
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each suffix, by walking back to a sampled one."""
        out = np.zeros(len(at), dtype=np.int64)
        todo = np.arange(len(at))
        steps = 0
        while len(todo):
            done = self.marked[at]
            out[todo[done]] = self.samples[self.marks[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, rank = self.symbol_and_rank(at)
                at = self.before[symbol] + rank
                steps += 1
        return out


def segments(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct (i, s): items cut to segments of words with a space between, which hold all windows of the item and few twice."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null")

    def run(batches):
        for batch in batches:
            made: list[tuple[str, bytes]] = []
            for i, t in zip(column(batch, "i").to_pylist(), column(batch, "t").cast(pa.binary()).to_pylist(), strict=True):
                found = words_of(t)
                made += [(i, b" ".join(found[k : k + SEGMENT_WINDOWS + size - 1])) for k in range(0, max(1, len(found) - size + 1), SEGMENT_WINDOWS) if found]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["i", "s"])

    return items.mapInArrow(run, "i string, s binary").distinct()


@dataclass
class Windows:
    """Distinct windows of a block as stretches of one sequence of word numbers (from 1; 0 ends a segment), and the items that hold each."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_start: np.ndarray
    item_of: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], size: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        tokens, starts, lengths, owner = [], [], [], []
        at = 0
        for item, segment in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in segment.split()] + [0], dtype=np.int32)
            n = len(ids) - 1
            if not n:
                continue
            begins = np.arange(max(1, n - size + 1), dtype=np.int32)
            tokens.append(ids)
            starts.append(begins + np.int32(at))
            lengths.append(np.full(len(begins), min(n, size), dtype=np.int16))
            owner.append(np.full(len(begins), number.setdefault(item, len(number)), dtype=np.int32))
            at += len(ids)
        none = np.zeros(0, dtype=np.int32)
        if not tokens:
            return cls({}, none, none, none, np.zeros(1, dtype=np.int32), none, [])
        text, begin, length, own = (np.concatenate(x) for x in (tokens, starts, lengths, owner))
        window = _same_windows(text, begin, length)
        _, first = np.unique(window, return_index=True)
        pairs = np.unique(window.astype(np.int64) * len(number) + own)
        held = np.searchsorted(pairs // len(number), np.arange(len(first) + 1)).astype(np.int32)
        return cls(vocabulary, text, begin[first], length[first], held, (pairs % len(number)).astype(np.int32), list(number))


def _same_windows(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each window, equal for equal words: by ranks of the stretches of 1, 2, 4, ... words, two of which cover a window."""
    out = np.empty(len(begin), dtype=np.int64)
    rank, width, known = text.astype(np.int64), 1, 0
    while True:
        for n in np.unique(length[(length >= width) & (length < 2 * width)]).tolist():
            mine = np.flatnonzero(length == n)
            _, same = np.unique(rank[begin[mine]] * (len(text) + 1) + rank[begin[mine] + n - width], return_inverse=True)
            out[mine] = known + same
            known += int(same.max()) + 1
        if 2 * width > int(length.max()):
            return out
        second = np.zeros(len(text), dtype=np.int64)
        second[: len(text) - width] = rank[width:]
        _, rank = np.unique(rank * (len(text) + 1) + second, return_inverse=True)
        width *= 2


class Shard:
    """Collects documents until the index is worth building, then finds all windows in them."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.shortest = int(windows.lengths.min()) if len(windows.lengths) else 0
        self.words = 0
        self.docs = 0
        self.runs: list[np.ndarray] = []
        self.run_doc: list[np.ndarray] = []
        self.run_at: list[np.ndarray] = []
        self.n_words: list[int] = []

    def add(self, text: bytes | None) -> None:
        found = words_of(text)
        self.n_words.append(len(found))
        if self.shortest and len(found) >= self.shortest:
            get = self.w.vocabulary.get
            ids = np.fromiter((get(x, 0) for x in found), dtype=np.int32, count=len(found))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            start, end = edge[::2], edge[1::2]
            keep = end - start >= self.shortest
            start, end = start[keep], end[keep]
            if len(start):
                length = end - start + 1  # and a separator
                first = np.cumsum(length) - length
                at = np.repeat(start - first, length) + np.arange(length.sum())
                seq = np.zeros(len(at), dtype=np.int64)
                body = np.ones(len(at), dtype=bool)
                body[first + length - 1] = False
                seq[body] = ids[at[body]] + 1
                seq[~body] = 1
                self.runs.append(seq)
                self.run_doc.append(np.full(len(at), self.docs, dtype=np.int64))
                self.run_at.append(at)
                self.words += len(at)
        self.docs += 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence."""
        empty = np.zeros(0, dtype=np.int64)
        if not self.runs:
            return empty, empty, empty
        w = self.w
        seq = np.concatenate([*self.runs, [0]])
        present = np.unique(seq)  # 0, 1 for separators, then the words of this shard
        symbol = np.zeros(len(w.vocabulary) + 2, dtype=np.int32)
        symbol[present] = np.arange(len(present))
        # windows with a word that the shard lacks are not searched
        lacking = np.concatenate([[0], np.cumsum(symbol[w.tokens + 1] < 2)])
        tried = np.flatnonzero(lacking[w.starts] == lacking[w.starts + w.lengths])
        doc, at = np.concatenate(self.run_doc), np.concatenate(self.run_at)
        index = FMIndex(symbol[seq].astype(np.int64))
        lo, hi = index.search(symbol[w.tokens + 1], w.starts[tried], w.lengths[tried].astype(np.int64))
        count = hi - lo
        window = np.repeat(tried, count)
        place = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        where = index.locate(place)
        return doc[where], at[where], window

    def results(self) -> list[tuple[int, list[list[int]], list[str]]]:
        """Per document: number of words, merged spans of hit words [from, to), items found."""
        doc, first, window = self.hits()
        order = np.lexsort((first, doc))
        doc, first, window = doc[order], first[order], window[order]
        bounds = np.searchsorted(doc, np.arange(self.docs + 1))
        out = []
        for d in range(self.docs):
            a, b = bounds[d], bounds[d + 1]
            spans: list[list[int]] = []
            items: list[str] = []
            if b > a:
                start, end = first[a:b], first[a:b] + self.w.lengths[window[a:b]]
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                spans = np.stack([start[new], reach[np.append(new[1:], len(start)) - 1]], axis=1).tolist()
                kinds = np.unique(window[a:b])
                items = [self.w.items[i] for i in np.unique(np.concatenate([self.w.item_of[self.w.item_start[k] : self.w.item_start[k + 1]] for k in kinds]))]
            out.append((self.n_words[d], spans, items))
        return out


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append ``n_words``, ``hit_spans`` (word ranges [from, to)) and ``hit_items`` to each document.

    A window is ``size`` consecutive words of an item; a shorter item is one window and an
    item without words is none. Null texts have no words. Repeated rows are
    judged alike; input columns with the new names are replaced. An empty benchmark or
    an empty table is fine: nothing is hit.
    """
    spark = docs.sparkSession
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    docs = without(docs, [f.name for f in fields])
    cut = written(segments(benchmark, item, item_text, size), "benchmark")
    passes = max(1, -(-(cut.agg(F.sum(F.octet_length("s"))).first()[0] or 0) // block_bytes))

    def block(k: int):
        rows = cut.where(F.pmod(F.xxhash64("i", "s"), F.lit(passes)) == k) if passes > 1 else cut
        return spark.sparkContext.broadcast(Windows.of([(r.i, bytes(r.s)) for r in rows.collect()], size))  # about block_bytes

    if passes == 1:
        return docs.mapInArrow(_pass(block(0), text, docs.columns), T.StructType([*docs.schema.fields, *fields]))
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    narrow, hits = rows.select("__row", text), None
    for k in range(passes):
        shared = block(k)
        found = narrow.mapInArrow(_pass(shared, text, ["__row"], hits_only=k > 0), T.StructType([rows.schema["__row"], *fields]))
        found = written(found, "hits")
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    gathered = hits.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items"))

    def merge(batches):
        for batch in batches:
            spans = pa.array([_merge(s) for s in column(batch, "hit_spans").to_pylist()], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([column(batch, "__row"), column(batch, "n_words"), spans, column(batch, "hit_items")], names=["__row", *(f.name for f in fields)])

    return rows.join(gathered.mapInArrow(merge, T.StructType([rows.schema["__row"], *fields])), "__row").drop("__row")


def _pass(shared, text: str, names: list[str], hits_only: bool = False):
    """Search one block of windows; gives the columns ``names`` and what is found, of rows with hits or of all."""

    def finish(batches: list[pa.RecordBatch], shard: Shard) -> pa.RecordBatch:
        rows = shard.results()
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
        out = pa.RecordBatch.from_arrays([*(column(whole, c) for c in names), *made], names=[*names, "n_words", "hit_spans", "hit_items"])
        return out.filter(pa.array([bool(r[1]) for r in rows])) if hits_only else out

    def run(batches):
        held: list[pa.RecordBatch] = []
        shard = Shard(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.select(names))
            for t in column(batch, text).cast(pa.binary()).to_pylist():
                shard.add(t)
            if shard.words >= SHARD_WORDS or sum(b.nbytes for b in held) > 48 << 20:
                yield finish(held, shard)
                held, shard = [], Shard(shared.value)
        if held:
            yield finish(held, shard)
        del held, shard
        release()

    return run


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Cut the hit words out of ``text``: from a span's first word to the last byte of its last.

    What stands between spans is kept as it was; a null text stays null.
    """
    names = docs.columns
    found = find_contamination(docs, benchmark, text, **options)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            rows = column(batch, text).cast(pa.binary()).to_pylist()
            out = [cut(t, s) if s else t for t, s in zip(rows, column(batch, "hit_spans").to_pylist(), strict=True)]
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if n == text else column(batch, n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return found.mapInArrow(run, schema)


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the bytes of the words in ``spans``."""
    folded = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded != 32, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : start[a]])
        at = int(end[b - 1])
    return b"".join([*out, text[at:]])
