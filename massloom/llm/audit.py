"""How filters that are applied in turn share their removals, from packed bitmaps.

A task packs its rows to bitsets of 64-bit words, one for each filter and label, in which the rows of a
part fill words of their own. For each subset of filters one AND-NOT and a popcount, summed over the words of a part, count the rows
that the subset keeps. Tasks send a row for each part and subset, these counts are summed, and every order and step of the
filters is a difference of two of them. The rows of a part are never brought together.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import column, release
from massloom.session import bounded_batches, written

MIN_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))  # bytes that go on with a character
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Bytes of a text that are split to words at a time, up to the end of a word.
PIECE = 1 << 20
#: Rows that are packed at a time.
ROWS = 1 << 16
#: Shares by which the rows of one text are dealt.
SALTS = 64


def text_failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Under ``MIN_WORDS`` words; under half of the words distinct; over 2 % capitals A-Z; any of ``SYMBOLS``."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        end = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = end.start() if end else len(text)
        found = text[at:stop].split()  # bytes are split at \x09 to \x0D and \x20
        n += len(found)
        distinct.update(found)
        at = stop
    capitals = len(text) - len(text.translate(None, CAPITALS))
    chars = len(text.translate(None, _CONTINUED))
    return n < MIN_WORDS, 100 * len(distinct) < 50 * n, 100 * capitals > 2 * chars, len(text.translate(None, SYMBOLS)) < len(text)


def text_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row: what the filters fail it for, and whether its labels say 1.

    A to D are ``text_failures``; E is a text that a row with a smaller id has. Null texts are empty, a null part is the empty string; a row
    without an id is never smaller or larger than another and has no labels. An id that is labelled more than once counts
    by its largest labels. Texts are equal by their SHA-256. The rows of one text are dealt over ``SALTS`` shares, so that copies
    are neither grouped nor joined in one task.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in column(batch, "text").cast(pa.binary()).to_pylist()]
            fails = list(zip(*map(text_failures, texts), strict=True)) or [()] * 4
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            salt = pa.array(np.arange(len(texts)) % SALTS, pa.int32())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "part"), *(pa.array(f, pa.bool_()) for f in fails), digest, salt], names=["id", "part", *"ABCD", "digest", "salt"])
        release()

    marked = T.StructType([rows.schema["id"], rows.schema["part"], *(T.StructField(f, T.BooleanType()) for f in "ABCD"), T.StructField("digest", T.BinaryType()), T.StructField("salt", T.IntegerType())])
    rows = written(rows.mapInArrow(run, marked), "filter-marks")
    shares = rows.groupBy("digest", "salt").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    repeated = shares.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("last > first").drop("last")
    firsts = shares.select("digest", "salt").join(repeated, "digest")
    told = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(good).alias("good"), F.max(bad).alias("bad"))
    out = rows.join(firsts, ["digest", "salt"], "left").join(told, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select("part", *"ABCD", yes(F.col("id") > F.col("first")).alias("E"), yes(F.col("good") == 1).alias("good"), yes(F.col("bad") == 1).alias("toxic"))


def packed(flags: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """Bitset of ``words`` 64-bit words with ``flags`` at the bits ``place``."""
    bits = np.zeros(words * 64, dtype=bool)
    bits[place] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def subset_counts(parts: np.ndarray, filters: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """[part, subset, 1 + label]: rows (and those with a label) that no filter of the subset fails; ``parts`` are numbers from 0 without gaps."""
    order = np.argsort(parts, kind="stable")
    size = np.bincount(parts)
    words = -(-size // 64)
    first = np.cumsum(words) - words  # a part's rows begin at a word
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.repeat(first * 64 - (np.cumsum(size) - size), size) + np.arange(len(parts))
    total = int(words.sum())
    there = packed(np.ones(len(parts), dtype=bool), place, total)
    fails = [packed(f, place, total) for f in filters]
    masks = [there, *(packed(x, place, total) for x in labels)]
    out = np.zeros((len(size), 1 << len(filters), len(masks)), dtype=np.int64)
    for subset in range(1 << len(filters)):
        failed = np.zeros(total, dtype=np.uint64)
        for k, f in enumerate(fails):
            if subset >> k & 1:
                failed |= f
        for m, mask in enumerate(masks):
            out[:, subset, m] = np.add.reduceat(np.bitwise_count(mask & ~failed).astype(np.int64), first)
    return out


def audit(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """One row for each part, order of all ``filters`` and step: what the step's filter removes and what that costs.

    ``filters`` and ``labels`` are boolean columns (null: false); ``part`` is a string, a null one the empty string. Columns: ``part``, ``filter_order`` (the
    filters' names joined), ``step`` from 1, ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, were removed before),
    ``unique_fails`` (fail its filter alone), ``<label>_lost`` (removed here with that label), ``shapley`` (what its filter removes, summed over all orders). An empty
    table gives no rows. The number of orders is the factorial of the number of filters.
    """
    bounded_batches(rows.sparkSession)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"f{k}") for k, c in enumerate([*filters, *labels])]
    n, names = len(filters), [f"n{k}" for k in range(1 + len(labels))]

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        code = whole.column("part").combine_chunks().dictionary_encode()
        marks = [whole.column(f"f{k}").to_numpy() for k in range(n + len(labels))]
        found = subset_counts(code.indices.to_numpy().astype(np.int64), marks[:n], marks[n:])
        part_of = pa.array(np.repeat(np.arange(len(found)), 1 << n))
        columns = [code.dictionary.take(part_of), pa.array(np.tile(np.arange(1 << n), len(found)), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, :, k].ravel()) for k in range(len(names)))], names=["part", "subset", *names])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield counted(held)
                held = []
        if held:
            yield counted(held)
        release()

    per_task = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), *flags).mapInArrow(run, f"part string, subset int, {', '.join(f'{c} long' for c in names)}")
    summed = per_task.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names))
    whole = summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *names))).alias("counts"))  # one entry for each subset
    columns = [f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in labels), "shapley")]

    def steps(batches):
        for batch in batches:
            for name, counts in zip(column(batch, "part").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                yield _steps(name, np.array([[c[k] for k in names] for c in counts], dtype=np.int64), filters, labels)

    return whole.mapInArrow(steps, f"part string, filter_order string, step int, {', '.join(columns)}")


def _steps(part: str, kept: np.ndarray, filters: list[str], labels: list[str]) -> pa.RecordBatch:
    """All orders and steps of one part from its counts [subset, 1 + label]."""
    n = len(filters)
    every = (1 << n) - 1
    fails = [int(kept[0, 0] - kept[1 << k, 0]) for k in range(n)]
    alone = [int(kept[every ^ (1 << k), 0] - kept[every, 0]) for k in range(n)]
    out, share = [], [0] * n
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            lost = kept[before] - kept[after]
            share[k] += int(lost[0])
            out.append(("".join(filters[i] for i in order), step, k, int(kept[after, 0]), int(lost[0]), fails[k] - int(lost[0]), alone[k], *lost[1:].tolist()))
            before = after
    rows = list(zip(*((part, *o[:2], *o[3:], share[o[2]]) for o in out), strict=True))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in labels), "shapley"]
    return pa.RecordBatch.from_arrays([pa.array(r, pa.string() if i < 2 else pa.int32() if i == 2 else pa.int64()) for i, r in enumerate(rows)], names=names)
