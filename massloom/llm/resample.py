"""Importance resampling towards a target text: hashed n-grams, Gumbel noise, and an exact draw by merging sorted runs.

Features are runs of one to three words, hashed to a fixed number of buckets. Bucket counts of
the documents and of the target give each bucket's gain, an array that every task gets; a document's weight is the sum of its features' gains, looked up
in that array. Each partition of the scored table sorts its eligible rows and packs them to blocks. The order
of scores is cut into ranges; a range's blocks come to one task sorted by their first entry, and a tournament tree over the runs
takes a block up only when its first entry is due, so that a task holds one block of each run at most. Counts by range
give the ranks before it; ranges past the draw are not read and the last one stops at the exact count.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import column, release, without
from massloom.llm.bytehash import slices, words
from massloom.session import bounded_batches, written

BUCKETS = 10_000
LONGEST = 3
#: Bytes of a text whose words are hashed at a time; the next piece begins two words before.
PIECE = 1 << 20
#: Entries of a block, and ranges of scores that are merged on their own.
BLOCK = 4096
RANGES = 1000

_IS_WORD = np.array([b > 127 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words of more bytes are hashed one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[n, byte of the checksum, its value]: the checksum's share after ``n`` more zero bytes."""
    out = np.zeros((_SHORT + 2, 4, 256), dtype=np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(1, _SHORT + 2):
        out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()


def _power_shift(crc: int, n: int) -> int:
    """``crc`` after ``n`` more zero bytes, by squaring the shift; for words of any length."""
    matrix = [int(_CRC[(1 << k) & 255]) ^ ((1 << k) >> 8) for k in range(32)]  # one zero byte
    apply = lambda m, v: _xor(m[k] for k in range(32) if v >> k & 1)
    while n:
        if n & 1:
            crc = apply(matrix, crc)
        matrix = [apply(matrix, v) for v in matrix]
        n >>= 1
    return crc


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _append(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of texts joined: those of their first parts, those of the second parts and these parts' lengths."""
    n = np.minimum(length, _SHORT + 1)
    out = more.copy()
    for byte in range(4):
        out ^= _SHIFT[n, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    for k in np.flatnonzero(length > _SHORT + 1):
        out[k] = int(more[k]) ^ _power_shift(int(crc[k]), int(length[k]))
    return out


def _word_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: bytes = b"") -> np.ndarray:
    """crc32 of ``before`` and each word."""
    length = end - start
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    s, n = start[order], length[order]
    crc = np.full(len(s), zlib.crc32(before) ^ 0xFFFFFFFF, dtype=np.uint32)
    short = int(np.searchsorted(-n, -_SHORT, side="left"))  # words before are longer
    alive = np.searchsorted(-n, -np.arange(0, _SHORT), side="left")  # words with more than k bytes
    for k in range(int(n[short]) if short < len(n) else 0):
        part = slice(short, int(alive[k]))
        crc[part] = _CRC[(crc[part] ^ buf[s[part] + k]) & 255] ^ (crc[part] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(short):
        crc[k] = zlib.crc32(buf[s[k] : s[k] + n[k]].tobytes(), zlib.crc32(before))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _features(buf: np.ndarray, offsets: np.ndarray, known: int, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of words that ends after the first ``known`` words, and the words' rows."""
    low = _LOWER[buf]
    start, end, row = words(low, offsets, _IS_WORD)
    crc, spaced = _word_crcs(low, start, end), _word_crcs(low, start, end, b" ")
    rows, found = [row[known:]], [crc[known:] % np.uint32(buckets)]
    run = crc
    for size in range(2, longest + 1):
        if len(run) < 2:
            break
        run = _append(run[:-1], spaced[size - 1 :], (end - start)[size - 1 :] + 1)
        good = row[size - 1 :] == row[: len(row) - size + 1]
        good[: max(0, known - size + 1)] = False
        rows.append(row[size - 1 :][good])
        found.append(run[good] % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found), row[known:]


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of every feature and the row of every word, in pieces of bounded size; rows count from the batch's first.

    Nulls have no words. A text over ``PIECE`` bytes is cut between words.
    """
    for first, n, buf, offsets in slices(texts, PIECE):
        if len(buf) <= PIECE:
            row, bucket, word = _features(buf, offsets, 0, buckets, longest)
            yield row + first, bucket, word + first
            continue
        at, known = 0, 0
        while at < len(buf):
            stop, begins = _piece(buf, at, longest)
            piece = buf[at:stop]
            row, bucket, word = _features(piece, np.array([0, len(piece)]), known, buckets, longest)
            yield row + first, bucket, word + first
            known = min(longest - 1, len(begins))
            at = at + int(begins[-known]) if known and stop < len(buf) else stop


def _piece(buf: np.ndarray, at: int, longest: int) -> tuple[int, np.ndarray]:
    """Where a piece of about ``PIECE`` bytes from ``at`` on ends, and the beginnings of its words; the words to carry never fill it."""
    reach = PIECE
    while True:
        stop = min(len(buf), at + reach)
        while stop < len(buf) and _IS_WORD[buf[stop - 1]]:
            space = np.flatnonzero(~_IS_WORD[buf[stop : stop + PIECE]])
            stop = stop + int(space[0]) + 1 if len(space) else min(len(buf), stop + PIECE)
        begins = words(buf[at:stop], np.array([0, stop - at]), _IS_WORD)[0]
        if stop == len(buf) or not len(begins) or begins[-min(longest - 1, len(begins))] > 0:
            return stop, begins
        reach = 2 * (stop - at)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends one row a bucket, the driver gets ``buckets`` sums."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in feature_buckets(column(batch, text), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])
        release()

    sums = texts.select(f"`{text}`").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares in thousandths, rounded down."""
    s, t = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(float((b + 1) * s) / float((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the id (a null is an empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())]


def score(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = 42, longest: int = LONGEST) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_features``, ``weight`` and ``score``; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, [f.name for f in SCORES])
    others = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for row, bucket, word in feature_buckets(column(batch, text), len(gain), longest):
                n_words += np.bincount(word, minlength=n)
                n_features += np.bincount(row, minlength=n)
                # sums of whole numbers below 2**53 are exact in doubles
                weight += np.bincount(row, weights=gain[bucket], minlength=n).astype(np.int64)
            drawn = np.array([noise(i, seed) for i in column(batch, doc_id).to_pylist()], dtype=np.int64)
            made = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight, weight + drawn)]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in others), *made], names=[*(f.name for f in others), *(f.name for f in SCORES)])
        release()

    return docs.mapInArrow(run, T.StructType([*others, *SCORES]))


class Tournament:
    """Winner tree over the heads of sorted runs; each node holds the leaf that wins below it, so a changed leaf costs one path."""

    def __init__(self):
        self.size = 1
        self.heads: list[tuple | None] = [None]
        self.best = [0, 0]
        self.free = [0]

    @property
    def least(self) -> tuple | None:
        return self.heads[self.best[1]]

    def _winner(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def enter(self, head: tuple) -> int:
        """A new run; gives its leaf."""
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))
            self.heads += [None] * self.size
            self.size *= 2
            self.best = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.best[node] = self._winner(self.best[2 * node], self.best[2 * node + 1])
        leaf = self.free.pop()
        self.play(leaf, head)
        return leaf

    def play(self, leaf: int, head: tuple | None) -> None:
        """The run at ``leaf`` goes on with ``head``; None ends it."""
        self.heads[leaf] = head
        node = (leaf + self.size) // 2
        while node:
            self.best[node] = self._winner(self.best[2 * node], self.best[2 * node + 1])
            node //= 2
        if head is None:
            self.free.append(leaf)


def merged(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Entries (-score, id, row) of sorted runs in order, from their blocks (scores, ids, rows), which come ordered by their first entries.

    A block stays in the stream until no entry held is before its first one. By then the earlier block of its run
    has ended, so no more blocks are held than there are runs.
    """
    tree = Tournament()
    entries: dict[int, Iterator[tuple]] = {}

    def taken(block) -> Iterator[tuple]:
        scores, ids, rows = block
        return zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)

    ahead = next(blocks, None)
    while ahead is not None or entries:
        while ahead is not None and (not entries or (-int(ahead[0][0]), int(ahead[1][0]), int(ahead[2][0])) < tree.least):
            mine = taken(ahead)
            entries[tree.enter(next(mine))] = mine
            ahead = next(blocks, None)
        leaf = tree.best[1]
        yield tree.least
        head = next(entries[leaf], None)
        tree.play(leaf, head)
        if head is None:
            del entries[leaf]


def _pack(cuts: np.ndarray):
    """A partition's sorted rows to blocks; a block lies in one range of scores."""

    def block(at, s, i, r):
        arrays = [pa.array([at], pa.int32()), pa.array([-int(s[0])], pa.int64()), pa.array([int(i[0])], pa.int64()), pa.array([int(r[0])], pa.int64())]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (s, i, r)]
        return pa.RecordBatch.from_arrays([*arrays, *lists], names=["range", "h1", "h2", "h3", "scores", "ids", "rows"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, ids, rows = (column(batch, c).to_numpy() for c in ("score", "id", "row"))
            where = np.searchsorted(cuts, -scores, side="left")
            edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, np.arange(0, len(scores), BLOCK), [len(scores)]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield block(int(where[a]), scores[a:b], ids[a:b], rows[a:b])

    return run


def draw(scored: DataFrame, count: int | None = None, per_cent: int = 5, doc_id: str = "doc_id", eligible: str = "eligible") -> DataFrame:
    """Append ``rank`` to the ``count`` (or ``floor(per_cent * N / 100)``) best of the N rows for which ``eligible`` holds.

    Order: higher ``score``, smaller id, null ids last, repeated ids in the order of the written rows. Others get a null rank.
    ``scored`` is written once; ranks are joined back by a number that the written row carries.
    """
    table = written(without(scored, ["rank"]).withColumn("__row", F.monotonically_increasing_id()), "scored")
    rows = table.where(F.col(eligible)).select("score", F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col("__row").alias("row"))
    at = [k / RANGES for k in range(1, RANGES)]
    seen = rows.agg(F.count("row").alias("n"), F.percentile_approx(-F.col("score"), F.array(*map(F.lit, at)), 10_000).alias("q")).first()
    wanted = per_cent * seen.n // 100 if count is None else min(count, seen.n)
    cuts = np.unique(np.array(seen.q or [], dtype=np.int64))
    blocks = rows.sortWithinPartitions(F.desc("score"), "id", "row").mapInArrow(_pack(cuts), "range int, h1 long, h2 long, h3 long, scores array<long>, ids array<long>, rows array<long>")
    blocks = written(blocks, "runs")
    counts = {r.range: r.n for r in blocks.groupBy("range").agg(F.sum(F.size("rows")).cast("long").alias("n")).collect()}  # RANGES rows at most
    before, total = {}, 0
    for k in sorted(counts):
        if total < wanted:
            before[k] = total
        total += counts[k]
    needed = blocks.where(F.col("range") <= max(before, default=-1))
    sorted_blocks = needed.repartitionById(max(before, default=0) + 1, F.col("range")).sortWithinPartitions("range", "h1", "h2", "h3")

    def run(batches):
        def one_by_one():
            for batch in batches:
                cols = [column(batch, c) for c in ("range", "scores", "ids", "rows")]
                for k in range(batch.num_rows):
                    yield cols[0][k].as_py(), tuple(c[k].values.to_numpy() for c in cols[1:])

        stream = one_by_one()
        item = next(stream, None)
        while item is not None:
            here, rest = item[0], []

            def of_range(first=item, here=here, rest=rest):
                yield first[1]
                for nxt in stream:
                    if nxt[0] != here:
                        rest.append(nxt)
                        return
                    yield nxt[1]

            source, rank, left, out = of_range(), before[here], wanted - before[here], []
            for entry in merged(source):
                if not left:
                    break
                rank, left = rank + 1, left - 1
                out.append((entry[2], rank))
                if len(out) == 1 << 16:
                    yield _ranks(out)
                    out = []
            yield _ranks(out)
            for _ in source:  # what the draw no longer needs
                pass
            item = rest[0] if rest else None
        release()

    ranks = sorted_blocks.mapInArrow(run, "__row long, rank long")
    return table.join(ranks, "__row", "left").drop("__row")


def _ranks(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["__row", "rank"])


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", per_cent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_features``, ``weight``, ``score``, ``eligible`` and ``rank`` (null where not drawn).

    Null and empty texts have no features and weigh 0; rows under ``min_words`` words are scored and never drawn. An empty table gives no rows,
    an empty target is fine (all its counts are 0). Repeated rows are each drawn on their own. Input columns of these names are replaced, others stay.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = score(docs, gain, doc_id, text, seed)
    scored = without(scored, ["eligible"]).withColumn("eligible", F.col("n_words") >= min_words)
    return draw(scored, per_cent=per_cent, doc_id=doc_id)
