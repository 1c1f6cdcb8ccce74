"""Context-triggered piecewise hashes of whole texts, and their likeness by edit distance.

A rolling hash over seven characters ends a chunk wherever its low bits are all ones; how many
bits is the block level, taken from the text's length so that about 32 to 64 chunks are expected. Each
chunk becomes two signs of its content, so an edit changes the signs of the chunks that it
touches and no others. A fingerprint is ``level:signs:signs one level up``. Two fingerprints of the same level are
compared by both strings, those of neighbouring levels by the string they share, others not at all.

``compare_with_next`` sets every text beside its successor by id. Ids and hashes are
sampled for cuts, rows go to ranges of ids once, and the first row of each range goes to the range before it as well,
so that a task reads one sorted stream and keeps one row of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import column, release, without
from massloom.llm.bytehash import U, mix, powers
from massloom.session import bounded_batches, written

WINDOW = 7
#: Chunks that a text is cut into at most, as its length lets expect; twice as many may come, the last takes the rest.
CHUNKS = 64
#: Characters hashed at a time; a chunk may reach over any number of them.
PIECE = 1 << 18
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = (1 << 64) - 1

#: Bytes of text for which a range of ids is meant, and the most ranges.
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16


class _Chunks:
    """Signs of the chunks of one level; the open chunk is kept as its hash and length."""

    def __init__(self, level: int):
        self.mask = U((1 << level) - 1)
        self.signs: list[np.ndarray] = []
        self.left = 2 * CHUNKS - 1  # chunks that may still end before the last
        self.hash, self.length = 0, 0

    def feed(self, rolled: np.ndarray, sums: np.ndarray, first: int) -> None:
        """``rolled`` belongs to the characters from ``first`` on; ``sums`` to all of them."""
        inverse = powers(_INVERSE, len(sums))
        ends = first + 1 + np.flatnonzero(rolled & self.mask == self.mask)[: self.left]
        starts = np.concatenate([[first], ends])
        spans = (sums[np.append(ends, len(sums) - 1)] - sums[starts]) * inverse[starts]
        lengths = np.append(ends, len(sums) - 1) - starts
        # the first span continues the open chunk, the last stays open
        self.hash = (self.hash + pow(_BASE, self.length, 1 << 64) * int(spans[0])) & _WORD
        self.length += int(lengths[0])
        if len(ends):
            spans[0], lengths[0] = self.hash, self.length
            self.signs.append(mix(spans[:-1] + lengths[:-1].astype(U)) >> U(52))
            self.hash, self.length = int(spans[-1]), int(lengths[-1])
            self.left -= len(ends)

    def text(self) -> str:
        signs = self.signs
        if self.length:
            signs = [*signs, mix(np.array([(self.hash + self.length) & _WORD], dtype=U)) >> U(52)]
        return "".join(SIGNS[s >> 6] + SIGNS[s & 63] for s in np.concatenate(signs).tolist()) if signs else ""


def fingerprint(text: str | None) -> str:
    """``level:signs:signs`` of a whole text; a null is an empty text, equal texts have equal fingerprints."""
    text = text or ""
    level = max(0, (len(text) - 1).bit_length() - CHUNKS.bit_length() + 1)
    both = [_Chunks(level), _Chunks(level + 1)]
    for start in range(0, len(text), PIECE):
        before = min(start, WINDOW - 1)
        codes = np.frombuffer(text[start - before : start + PIECE].encode("utf-32-le"), dtype=np.uint32)
        sums = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum((codes + U(1)) * powers(_BASE, len(codes)), out=sums[1:])
        end = np.arange(before + 1, len(codes) + 1)
        begin = np.maximum(end - WINDOW, 0)
        rolled = mix((sums[end] - sums[begin]) * powers(_INVERSE, len(sums))[begin])
        for chunks in both:
            chunks.feed(rolled, sums, before)
    return f"{level}:{both[0].text()}:{both[1].text()}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one bit for each sign of ``a``."""
    places: dict[str, int] = {}
    for k, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for sign in b:
        met = row & places.get(sign, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 minus the edit distance (a sign added or gone counts 1, one replaced 2) over both lengths."""
    if a == b:
        return 1.0
    x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a, b))
    return 2 * _common(x, y) / (len(x) + len(y))


def likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two fingerprints from 0 to 1; 0 where their levels are over one apart, null where one is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (la, a1, a2), (lb, b1, b2) = a.split(":"), b.split(":")
    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a2, b1)], -1: [(a1, b2)]}.get(int(lb) - int(la), [])
    return max((_alike(x, y) for x, y in pairs), default=0.0)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of each row's text; a column named ``out`` is replaced, other columns stay."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return without(docs, [out]).withColumn(out, made(F.col(text)))


def likeness_of(a: Column, b: Column) -> Column:
    """Column expression of ``likeness``."""

    @F.pandas_udf(T.DoubleType())
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return made(a, b)


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``other``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


FIELDS = [
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Append each text's fingerprint, that of its edited text, and the likeness to that and to the next document's.

    The next document has the next smaller id; null ids come last, rows of one id go by a hash of the
    text and then the text, and the last row's next is the first. Null texts count as empty; a single row is its own next.
    Columns of clashing names are replaced, others stay; an empty table gives no rows. Rows that are equal in id and text
    cannot be told apart and share a range.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, [f.name for f in FIELDS])
    names = docs.columns
    # falls with the id and rises with the hash; equal places always share a range
    share = F.xxhash64(F.coalesce(text, F.lit(""))) / F.lit(2.0**64) + F.lit(0.5)
    place = F.when(F.col(doc_id).isNotNull(), share - F.col(doc_id).cast("double")).otherwise(F.lit(1e19) + share * F.lit(1e18))
    keys = written(docs.select(place.alias("p"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "next-keys")
    size = keys.agg(F.count("p").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = int(min(MOST_RANGES, size.n, 1 + (size.bytes or 0) // range_bytes)) or 1
    cuts = _cuts(keys, size.n, ranges)

    @F.pandas_udf(T.IntegerType())
    def range_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, p.to_numpy(), side="right").astype(np.int32))

    # a row for each range: its first place, and the range before (the last for the first)
    heads = keys.groupBy(range_of("p").alias("__range")).agg(F.min("p").alias("__p"))
    order = Window.orderBy("__range")  # at most MOST_RANGES rows
    heads = heads.withColumn("__prior", F.coalesce(F.lag("__range").over(order), F.max("__range").over(Window.partitionBy())))
    placed = docs.withColumn("__p", place).withColumn("__range", range_of("__p"))
    marked = placed.join(F.broadcast(heads), ["__range", "__p"], "left")
    own, halo = F.struct(F.col("__range").alias("to"), F.lit(False).alias("halo")), F.struct(F.col("__prior").alias("to"), F.lit(True).alias("halo"))
    sent = marked.withColumn("__sent", F.explode(F.when(F.col("__prior").isNull(), F.array(own)).otherwise(F.array(own, halo))))
    sent = sent.select(*(f"`{c}`" for c in names), F.col("__sent.to").alias("__to"), F.col("__sent.halo").alias("__halo"))
    by = [F.col("__to"), F.col("__halo"), F.col(f"`{doc_id}`").desc_nulls_last(), F.xxhash64(F.coalesce(text, F.lit(""))), F.col(f"`{text}`")]
    ordered = sent.repartitionById(ranges, F.col("__to")).sortWithinPartitions(*by)
    return ordered.mapInArrow(_beside(text, names), T.StructType([*docs.schema.fields, *FIELDS]))


def _cuts(keys: DataFrame, n: int, ranges: int) -> np.ndarray:
    """``ranges - 1`` places that part the rows about evenly, from some 20 keys a range; they change no result."""
    if ranges < 2:
        return np.zeros(0)
    share = min(1.0, 20 * ranges / n)
    seen = keys.select("p") if share == 1 else keys.select("p").sample(share, seed=7)
    found = np.sort(seen.toArrow().column("p").to_numpy())
    return np.unique(found[(len(found) * np.arange(1, ranges)) // ranges]) if len(found) else np.zeros(0)


def _beside(text: str, names: list[str]):
    """Reads ranges one after another in order; a range's last row waits for the copy of the next range's first row."""

    def run(batches):
        waiting: pa.RecordBatch | None = None  # one row, without its successor so far
        before: tuple[str, str] | None = None  # its text and fingerprint
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, halos = column(batch, text).to_pylist(), column(batch, "__halo").to_pylist()
            rows, kept = [], []
            carried = waiting
            for k, (t, halo) in enumerate(zip(texts, halos, strict=True)):
                if halo and before is None:
                    continue  # a repeated first row of the next range
                now = (t or "", fingerprint(t))
                if before is not None:
                    rows.append(_row(*before, *now))
                before = None if halo else now
                if not halo:
                    kept.append(k)
            own = batch.take(pa.array(kept, pa.int64())).select(names)
            if carried is not None:
                own = pa.Table.from_batches([carried, own]).combine_chunks().to_batches()[0]
            waiting = own.slice(own.num_rows - 1) if before is not None else None
            if rows:
                done = own.slice(0, len(rows))
                made = [pa.array([r[i] for r in rows], pa.int64() if not i else pa.string() if i < 4 else pa.float64()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*done.columns, *made], names=[*names, *(f.name for f in FIELDS)])
        release()

    return run


def _row(text: str, mark: str, other: str, other_mark: str) -> tuple:
    changed = edited(text, other)
    changed_mark = mark if changed == text else fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, other_mark)
