"""Removal of repeated 200-byte substrings by prefix-free parsing of the corpus.

*Parsing.* A rolling hash of 32 bytes is taken at every place of a text. Places whose hash is 0 modulo ``MODULUS`` are
triggers. A 200-byte window belongs to its leftmost trigger; one that holds none takes the place of its smallest hash. Either depends on the
window's bytes alone, so equal windows belong to equal triggers at equal distances, wherever they stand. Windows of one
trigger form a phrase: what leads up to the trigger, the trigger, and what the parse goes on with, as far as these windows reach.
Windows never leave their text.

*Dictionary.* Phrases are counted by (trigger, phrase hash). A trigger that occurs once has no repeated
window. A phrase that occurs twice repeats all its windows; it is kept in the dictionary once, however many copies
the corpus holds, which is what makes highly repetitive text cheap.

*Order.* Only phrases of one trigger can share a window. Two orders with their common prefixes are made for the phrases of a trigger:
of the dictionary's suffixes that end in the trigger (read backwards from it), and of the parse's suffixes that follow it. A window is a dictionary suffix of some length
and the rest of 200 bytes of a parse suffix, so both orders combined give the corpus order: windows are neighbours
with a common prefix of 200 bytes where they agree in both. Different phrases are compared by their bytes; equal phrases are known by two 64-bit
hashes, equal texts by 128 bits. The orders stop at 200 bytes and at a trigger's phrases, no suffix array of the whole corpus is made.

A long text is parsed in pieces that overlap by a window; a phrase that a piece's end cuts is two phrases of one trigger.
Triggers with more than ``CROWDED`` phrases are not ordered in one task; their windows are counted by 128-bit
fingerprints, combined before the shuffle, so that every window of every trigger is looked at either way.
Joins deal the rows of frequent keys over several partitions (``_join_dealt``).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrow import column, without
from massloom.llm.bytehash import U, mix, prefix, rolling, slices, span_hash
from massloom.session import written

LENGTH = 200
GRAM = 32
#: One place in so many is a trigger.
MODULUS = 128
CROWDED = 3000
#: Window starts of a long text that are parsed at once.
PIECE = 1 << 20
#: Bytes of phrases that are ordered at once.
ORDERED_BYTES = 1 << 20
#: Keys with over one row in ``HOT`` are dealt over ``SALTS`` partitions; there are fewer than ``HOT`` of them.
HOT = 1000
SALTS = 64


def _slide_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(a) - width + 1
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[width - have : width - have + n])


def parse(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, trigger, phrase hash, start within the row, windows, bytes before the trigger) of every phrase."""
    empty = np.zeros(0, dtype=np.int64)
    sums = prefix(buf)
    hashes = rolling(sums, gram)
    width = length - gram + 1
    if len(hashes) < width:
        return empty, empty.view(U), empty.view(U), empty, empty, empty
    # without a trigger: the upper half of the hash decides, then the leftmost place
    low = _slide_min((hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U), width)
    place = (low & U(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    hits = np.append(np.flatnonzero(hashes % U(MODULUS) == 0), len(buf))
    ahead = hits[np.searchsorted(hits, start)]
    place = np.where(ahead < start + width, ahead, place)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    fits = start + length <= offsets[row + 1]
    change = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = fits.copy()
    first[1:] &= change | ~fits[:-1]
    last = fits.copy()
    last[:-1] &= change | ~fits[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return row[a], hashes[place[a]], span_hash(sums, a, b + length), a - offsets[row[a]], b - a + 1, place[a] - a


def _parsed(texts: pa.Array):
    """First row and phrases of bounded runs of rows or pieces of a row."""
    for first, n, buf, offsets in slices(texts, 1 << 19):
        if n > 1 or len(buf) < PIECE + LENGTH:
            yield first, *parse(buf, offsets)
            continue
        for at in range(0, len(buf) - LENGTH + 1, PIECE):
            part = buf[at : at + PIECE + LENGTH - 1]
            row, trigger, phrase, start, windows, lead = parse(part, np.array([0, len(part)]))
            yield first, row, trigger, phrase, start + at, windows, lead


def _phrases(docs: DataFrame) -> DataFrame:
    """(trigger, phrase, node, start, windows, lead) of every phrase of (text, node)."""

    def run(batches):
        for batch in batches:
            node = column(batch, "node")
            for first, row, trigger, phrase, start, windows, lead in _parsed(column(batch, "text")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), node.take(pa.array(first + row)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int16)), pa.array(lead.astype(np.int16))],
                    names=["trigger", "phrase", "node", "start", "windows", "lead"],
                )

    return docs.select("text", "node").mapInArrow(run, "trigger long, phrase long, node binary, start int, windows short, lead short")


def suffix_order(parts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order of ``parts`` within their groups, and how many bytes each has in common with the one before it, -1 at a group's start."""
    order = np.array(sorted(range(len(parts)), key=lambda k: (group[k], parts[k])), dtype=np.int64)
    size = np.array([len(p) for p in parts])
    wide = int(size.max(initial=0))
    # bytes as 1..256, 0 after the end
    cells = np.zeros((len(parts), wide + 1), dtype=np.uint16)
    cells[np.arange(wide + 1) < size[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint16) + 1
    cells = cells[order]
    differs = cells[1:] != cells[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), size[order][1:])
    common[np.asarray(group)[order][1:] != np.asarray(group)[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def repeated_windows(pieces: list[bytes], lead: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each phrase, which of its windows equal a window of another phrase of its group.

    ``lead`` bytes stand before a phrase's trigger. Windows that start d bytes before the trigger are equal where the
    dictionary suffixes share d bytes and the parse suffixes, trigger included, the rest.
    """
    size = np.array([len(p) for p in pieces])
    lead = np.asarray(lead, dtype=np.int64)
    windows = size - length + 1
    n = len(pieces)
    back, back_common = suffix_order([p[:k][::-1] for p, k in zip(pieces, lead, strict=True)], group)
    ahead, ahead_common = suffix_order([p[k:] for p, k in zip(pieces, lead, strict=True)], group)

    def most(order, common):
        out = np.empty(n, dtype=np.int64)
        out[order] = np.maximum(common, np.append(common[1:], -1))
        return out

    upper = np.minimum(lead, most(back, back_common))
    lower = np.maximum(lead - windows + 1, length - most(ahead, ahead_common))
    flags = [np.zeros(w, dtype=bool) for w in windows]
    left, right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(length - gram + 1):
        some = np.flatnonzero((lower <= d) & (d <= upper))
        if len(some) < 2:
            continue
        left[back] = np.cumsum(back_common < d)
        right[ahead] = np.cumsum(ahead_common < length - d)
        _, same, times = np.unique(left[some] * (n + 1) + right[some], return_inverse=True, return_counts=True)
        for k in some[times[same] > 1].tolist():
            flags[k][lead[k] - d] = True
    return flags


def _order_buckets(batches):
    """Stream rows sorted by trigger; order the phrases of whole triggers together."""
    held: list[tuple] = []
    size, now = 0, None

    def flush():
        flags = repeated_windows([h[2] for h in held], np.array([h[6] for h in held]), np.array([h[0] for h in held]))
        # a phrase that occurs twice is repeated anyway
        rows = [(h[3], h[4], f) for h, f in zip(held, flags, strict=True) if h[5] == 1 and f.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([np.packbits(r[2]).tobytes() for r in rows], pa.binary()), pa.array([len(r[2]) for r in rows], pa.int32())], names=["node", "start", "flags", "windows"])

    last = None
    for batch in batches:
        cols = [column(batch, n).to_pylist() for n in ("trigger", "phrase", "bytes", "node", "start", "n", "lead")]
        for row in zip(*cols, strict=True):
            if row[:2] == last:
                continue
            last = row[:2]
            if row[0] != now and size >= ORDERED_BYTES:
                yield flush()
                held, size = [], 0
            now = row[0]
            held.append(row)
            size += len(row[2])
    if held:
        yield flush()


def _fingerprints(batches):
    """Every window of crowded phrases with two hashes."""
    for batch in batches:
        for trigger, piece, node, start, n in zip(*(column(batch, c).to_pylist() for c in ("trigger", "bytes", "node", "start", "n")), strict=True):
            one = rolling(prefix(np.frombuffer(piece, dtype=np.uint8)), LENGTH)
            two = rolling(prefix(np.frombuffer(piece[::-1], dtype=np.uint8)), LENGTH)[::-1]
            m = len(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(mix(two ^ U(trigger & ((1 << 64) - 1))).view(np.int64)), pa.repeat(pa.scalar(node, pa.binary()), m), pa.array((start + np.arange(m)).astype(np.int32)), pa.array(np.full(m, n, dtype=np.int64))],
                names=["f", "g", "node", "start", "n"],
            )


def spread(starts: list[tuple[int, int, bytes | None]], size: int, length: int = LENGTH) -> list[list[int]]:
    """Maximal runs of bytes that the repeated windows cover, from (start, windows, flags or None for all)."""
    edges = np.zeros(size + 1, dtype=np.int32)
    for start, windows, flags in starts:
        if flags is None:
            edges[start] += 1
            edges[min(size, start + windows + length - 1)] -= 1
        else:
            at = start + np.flatnonzero(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=windows))
            np.add.at(edges, at, 1)
            np.add.at(edges, at + length, -1)
    inside = np.cumsum(edges[:-1], dtype=np.int32) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return turn.reshape(-1, 2).tolist()


def _join_dealt(rows: DataFrame, keys: DataFrame, on: list[str], times: str) -> DataFrame:
    """``rows`` (of ``node`` and ``start``) joined with ``keys``, a written table of one row per key.

    ``times`` says how many rows a key has. Keys with over one row in ``HOT`` are fewer than ``HOT``, so their list is broadcast;
    their rows are dealt over ``SALTS`` partitions.
    """
    total = keys.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(keys.where(F.col(times) > total / HOT).select(*on, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node", "start"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, on, "left").withColumn("salt", salt).drop("hot")
    right = keys.join(hot, on, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*on, "salt"]).drop("salt")


def text_node(text: str = "text") -> F.Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, marks) for every distinct text with repeated windows; ``node`` is ``text_node`` of the text.

    A mark is (start, windows, flags): that many windows from ``start`` on, all of them
    or those whose bit is set.
    """
    keyed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", text_node().alias("node"))
    phrases = _phrases(keyed.where(F.octet_length("text") >= LENGTH))
    # triggers that occur more than once; the parse is made again rather than stored
    shared = written(phrases.groupBy("trigger").agg(F.count("*").alias("times")).where("times > 1"), "triggers")
    parsed = written(_join_dealt(phrases, shared, ["trigger"], "times").drop("times"), "parse")
    words = parsed.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("node", "start", "windows", "lead")).alias("at"))
    dictionary = written(words.select("trigger", "phrase", "n", "at.*"), "dictionary")
    rivals = written(dictionary.groupBy("trigger").agg(F.count("*").alias("rivals")).where("rivals > 1"), "rivals")
    wanted = _join_dealt(dictionary, rivals, ["trigger"], "rivals")
    lists = wanted.groupBy("node").agg(F.collect_list(F.struct("trigger", "phrase", "n", "start", "windows", "lead", "rivals")).alias("asked"))  # a text's own phrases
    pieces = written(_cut(keyed, written(lists, "asked")), "phrases")
    ordered = pieces.where(F.col("rivals") <= CROWDED).select("trigger", "phrase", "bytes", "node", "start", "n", "lead").repartition("trigger").sortWithinPartitions("trigger", "phrase").mapInArrow(_order_buckets, "node binary, start int, flags binary, windows int")
    crowded = pieces.where(F.col("rivals") > CROWDED).dropDuplicates(["trigger", "phrase"]).mapInArrow(_fingerprints, "f long, g long, node binary, start int, n long")
    often = crowded.groupBy("f", "g").agg(F.count("*").alias("c")).where("c > 1")
    single = crowded.where("n = 1").join(often, ["f", "g"], "left_semi").select("node", "start", F.lit(None).cast("binary").alias("flags"), F.lit(1).alias("windows"))
    copied = dictionary.where("n > 1").select("trigger", "phrase", "n")
    whole = _join_dealt(parsed, copied, ["trigger", "phrase"], "n").select("node", "start", F.lit(None).cast("binary").alias("flags"), F.col("windows").cast("int").alias("windows"))
    marks = whole.unionByName(ordered).unionByName(single)
    return marks.distinct().groupBy("node").agg(F.collect_list(F.struct("start", "windows", "flags")).alias("marks"))


def _packed(docs: DataFrame) -> DataFrame:
    """Compress texts before they are shuffled."""

    def run(batches):
        for batch in batches:
            raw = column(batch, "text").cast(pa.binary()).to_pylist()
            arrays = [pa.array([zlib.compress(t, 1) for t in raw], pa.binary()) if n == "text" else column(batch, n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields)


def _cut(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    """The bytes of the phrases asked for, from one copy of each text."""

    def run(batches):
        seen = None
        for batch in batches:
            out = []
            for node, text, asked in zip(*(column(batch, n).to_pylist() for n in ("node", "text", "asked")), strict=True):
                if node == seen:
                    continue
                seen, raw = node, zlib.decompress(text)
                out += [(a["trigger"], a["phrase"], a["n"], a["rivals"], node, a["start"], a["lead"], raw[a["start"] : a["start"] + a["windows"] + LENGTH - 1]) for a in asked]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int16(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["trigger", "phrase", "n", "rivals", "node", "start", "lead", "bytes"])

    return _packed(keyed).join(lists, "node").mapInArrow(run, "trigger long, phrase long, n long, rivals long, node binary, start int, lead short, bytes binary")


def remove_repeats(docs: DataFrame, text: str = "text", kept: str = "kept", spans: str = "removed_spans") -> DataFrame:
    """Append ``kept`` (binary, the bytes that stay) and ``removed_spans`` ([from, to) bytes) to every row.

    A byte goes if a 200-byte string that covers it also starts anywhere else in the
    column, the same text included. Null counts as empty; equal texts give equal results,
    and repeated rows repeat each other. Columns of clashing names are replaced.
    """
    docs = without(docs, [kept, spans, "__node", "__marks"])
    others = [c for c in docs.columns if c != text]
    marks = written(repeated_spans(docs, text), "marks").select(F.col("node").alias("__node"), F.col("marks").alias("__marks"))
    source = docs.select(*(F.col(f"`{c}`") for c in others), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("__node", text_node())
    joined = _packed(source).join(marks, "__node", "left")

    def run(batches):
        for batch in batches:
            rows, cuts = [], []
            for packed, found in zip(column(batch, "text").to_pylist(), column(batch, "__marks").to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                runs = spread([(m["start"], m["windows"], m["flags"]) for m in found], len(raw)) if found else []
                out, at = [], 0
                for a, b in runs:
                    out.append(raw[at:a])
                    at = b
                rows.append(b"".join([*out, raw[at:]]))
                cuts.append(runs)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in others), pa.array(rows, pa.binary()), pa.array(cuts, pa.list_(pa.list_(pa.int64())))], names=[*others, kept, spans])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{kept}` binary", f"`{spans}` array<array<long>>"])
    return joined.mapInArrow(run, fields)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of the kept bytes) of every text, by counting all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        runs = spread([(k, 1, None) for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1], len(t), length)
        kept = b"".join(t[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
