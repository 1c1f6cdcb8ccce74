"""Near-duplicate classes by weighted minwise hashing with darts, banding and exact checks.

Every shingle of five words owns a region as wide as its weight, its count in the text. Darts
fall on all regions at unit rate over time; a dart's place, time and coordinate are
hashes, so texts that share a shingle share its darts. Each coordinate keeps its
earliest dart. About ``k ln k`` darts fill a signature however long the text is, and two signatures agree
on a coordinate with the weighted Jaccard similarity of the texts.

Equal texts form one node. Bands of the signature propose pairs of nodes, each pair
is checked on its whole texts, and the links are joined to classes. A bucket of more than ``ALL_PAIRS`` nodes is not
paired with itself: its nodes are first checked against a few leaders, which the bands share. The nodes of
large buckets that hold several classes then go through an exact join: a text's shingles are put in one
order, rare ones first, and two similar texts share one that stands early in both. No pair of different classes in a large
bucket is left out unless its sizes and the place of its first common shingle rule the similarity out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import add_columns, column, release, without
from massloom.llm.bytehash import U, mix, prefix, slices, space_table, span_hash, words
from massloom.session import written

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Buckets of more nodes go through leaders and the exact join instead of their pairs; both ways find the same links.
ALL_PAIRS = 12
#: Leaders of a large bucket for all of its nodes.
FIRST_LEADERS = 2
#: Counters that put shingles in order. Shingles may share one: that changes the order, not the pairs found.
SLOTS = 1 << 22
#: Words of 64 parity bits that tell texts apart before they are compared.
PARITIES = 4
#: Tokens before each one that are kept with it.
BEFORE = 8
_WORD = space_table()


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a text of fewer words, but some, is one shingle."""
    start, end, row = words(buf, offsets, _WORD)
    n = len(start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    key = span_hash(prefix(buf), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    count = np.diff(first)
    out = np.zeros(n, dtype=U)
    for j in range(width):  # words beyond a short text's end add nothing
        out[: n - j] += key[j:] * U(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) * (row[j:] == row[: n - j])
    left = first[row + 1] - np.arange(n)
    whole = (left >= width) | ((count[row] < width) & (left == count[row]))
    return row[whole], mix(out[whole])


def weighted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) and how often each occurs."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_minhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Times of the earliest dart on each of ``k`` coordinates, for each of ``rows`` weighted sets.

    An element's region is cut into cells of unit width. Darts reach a cell at the times
    of a Poisson process; one that lands beyond the weight within the last cell misses. Sets
    without elements keep infinite times.
    """
    out = np.full((rows, k), np.inf)
    total = np.bincount(row, weights=weight, minlength=rows)
    cells = np.ceil(weight).astype(np.int64)
    cell_of = np.repeat(np.arange(len(row)), cells)
    layer = np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell_row = row[cell_of]
    cell_key = mix(key[cell_of] + layer.astype(U) * U(0xA24BAED4963EE407))
    inside = weight[cell_of] - layer
    todo = total > 0
    reach = (k * math.log(k) + 3 * k) / np.maximum(total, 1e-300)
    while todo.any():
        live = np.flatnonzero(todo[cell_row])
        out[todo] = np.inf
        r, h, room = cell_row[live], cell_key[live], inside[live]
        time = np.zeros(len(live))
        n = 0
        while len(r):
            n += 1
            one = mix(h + U(n * 0x9FB21C651E98DF25 & (1 << 64) - 1))
            time = time - np.log(_uniform(one))
            keep = time < reach[r]
            r, h, room, time, one = r[keep], h[keep], room[keep], time[keep], one[keep]
            spot = mix(one ^ U(0x5851F42D4C957F2D))
            hit = _uniform(mix(spot + U(1))) <= room
            at = r[hit] * k + (spot[hit] % U(k)).astype(np.int64)
            np.minimum.at(out.reshape(-1), at, time[hit])
        todo &= np.isinf(out).any(axis=1)
        reach = np.where(todo, reach * 2, reach)  # some coordinate is still without a dart
    return out


def band_hashes(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature."""
    bits = np.ascontiguousarray(times).view(U).reshape(len(times), bands, rows)
    out = np.zeros((len(times), bands), dtype=U)
    for j in range(rows):
        out = mix(out ^ bits[:, :, j])
    return out


def with_bands(docs: DataFrame, text: str = "text", out: str = "bands") -> DataFrame:
    """Append the band hashes of every whole text; null for texts without words."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            parts, some = [], []
            for _, n, buf, offsets in slices(column(batch, text), 1 << 19):
                row, key, weight = weighted(*shingles(buf, offsets))
                times = dart_minhash(row, key, weight.astype(np.float64), n)
                some.append(~np.isinf(times[:, 0]))
                parts.append(band_hashes(times))
            ok = np.concatenate(some) if some else np.zeros(0, dtype=bool)
            flat = np.concatenate(parts)[ok].ravel().view(np.int64) if parts else np.zeros(0, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(ok * BANDS)]).astype(np.int32)
            return {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~ok))}

        return step

    return add_columns(docs, make, [T.StructField(out, T.ArrayType(T.LongType()))])


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts."""
    found = []
    both = pa.chunked_array([left, right]).combine_chunks()
    n = len(left)
    order = np.arange(2 * n).reshape(2, n).T.ravel()  # the two texts of a pair side by side
    both = both.take(pa.array(order))
    for first, count, buf, offsets in slices(both, 1 << 20):
        row, key, weight = weighted(*shingles(buf, offsets))
        found.append((row + first, key, weight))
    row, key, weight = (np.concatenate([f[k] for f in found]) for k in range(3))
    pair, order = row // 2, np.lexsort((key, row // 2))
    pair, key, weight = pair[order], key[order], weight[order].astype(np.float64)
    total = np.bincount(pair, weights=weight, minlength=n)
    twice = np.flatnonzero((pair[1:] == pair[:-1]) & (key[1:] == key[:-1]))
    common = np.bincount(pair[twice], weights=np.minimum(weight[twice], weight[twice + 1]), minlength=n)
    return common / np.maximum(total - common, 1e-9)


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node each node is linked with, by alternating large and small stars.

    Every round is a minimum per node and a join back; the edges are written each time. It ends when all edges form stars: every
    child has one parent, and no parent is a child.
    """
    edges = links.select("u", "v").where("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, name)
        sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        if sides.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c + p > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _draw(node: Column, k: int) -> Column:
    """The place of a node in the ``k``-th order by hash."""
    return F.xxhash64(node, F.lit(k))


def _leaders(count: int) -> Column:
    """``count`` nodes of a bucket, the first of ``count`` orders by hash, as an array of (h, node).

    The orders are the same in all bands, so the buckets of one group mostly share their leaders and a node meets each but once.
    """
    draws = (F.min(F.struct(_draw(F.col("node"), k).alias("h"), "node")) for k in range(count))
    return F.array(*draws).alias("leaders")


def _check(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole texts are similar enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = similarities(column(batch, "a"), column(batch, "b")) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays([column(batch, "u").filter(pa.array(ok)), column(batch, "v").filter(pa.array(ok))], names=["u", "v"])
        release()

    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return two.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _tokens(texts: pa.Array):
    """(first row, rows, row, token) of runs of texts: a shingle that occurs n times gives n different tokens."""
    for first, n, buf, offsets in slices(texts, 1 << 19):
        row, key, weight = weighted(*shingles(buf, offsets))
        at = np.repeat(np.arange(len(row)), weight)
        layer = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
        yield first, n, row[at], mix(key[at] + layer.astype(U) * U(0xA24BAED4963EE407))


def _levels(texts: DataFrame) -> np.ndarray:
    """How often the tokens of each of ``SLOTS`` counters occur, on a scale of logarithms."""

    def run(batches):
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, _, _, token in _tokens(column(batch, "text")):
                np.add.at(counts, (token % U(SLOTS)).astype(np.int64), 1)
        slot = np.flatnonzero(counts)
        for k in range(0, len(slot), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(slot[k : k + (1 << 16)]), pa.array(counts[slot[k : k + (1 << 16)]])], names=["slot", "c"])

    total = texts.select("text").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    # one byte for each slot that is met more than once: 16 a doubling
    found = total.where("c > 1").select(F.col("slot").cast("int"), F.least(F.lit(255), F.ceil(F.log2("c") * 16)).cast("short").alias("level")).toArrow()
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return out


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (u, v) of different ``root`` in ``nodes`` (node, root, text) that may be similar enough; no similar pair is missing.

    Two texts of x and y tokens are similar only if they share ``similarity / (1 + similarity) * (x + y)`` of them.
    With all tokens in one order, their first common token has the others behind it in both, so it stands early enough in both.
    The longer text offers the tokens that may be first with a text of ``similarity`` times its size, the shorter
    one those that may be first with a text of its own size. A text's parities, one bit for the number of its tokens in each
    of ``64 * PARITIES`` bins, differ from another's in no more bits than there are tokens in one of the two alone.
    A pair that has met by an earlier token need not meet again, so a token brings along the few before it.
    """
    spark = nodes.sparkSession
    levels = spark.sparkContext.broadcast(_levels(nodes))
    part = similarity / (1 + similarity)
    bits = [f"odd{k}" for k in range(PARITIES)]

    def run(batches):
        for batch in batches:
            node, root = (column(batch, c).to_numpy() for c in ("node", "root"))
            for first, n, row, token in _tokens(column(batch, "text")):
                order = np.lexsort((token, levels.value[(token % U(SLOTS)).astype(np.int64)], row))
                row, token = row[order], token[order]
                size = np.bincount(row, minlength=n)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                odd = np.zeros((n, 64 * PARITIES), dtype=np.uint8)
                np.bitwise_xor.at(odd, (row, (mix(token) % U(64 * PARITIES)).astype(np.int64)), 1)
                odd = np.packbits(odd, axis=1).view(np.int64)
                keep = np.flatnonzero(size[row] - place >= similarity * size[row] - 1e-6)
                before = np.minimum(place[keep], BEFORE)
                ends = np.concatenate([[0], np.cumsum(before)])
                earlier = token[np.repeat(keep - before - ends[:-1], before) + np.arange(ends[-1])]
                earlier = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(earlier.view(np.int64)))
                row, token, place = row[keep], token[keep], place[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(node[first + row]), pa.array(root[first + row]), pa.array(size[row].astype(np.int32)), pa.array((size[row] - place).astype(np.int32)), earlier, *(pa.array(odd[row, k]) for k in range(PARITIES))],
                    names=["token", "node", "root", "size", "rest", "earlier", *bits],
                )

    early = written(nodes.select("node", "root", "text").mapInArrow(run, "token long, node long, root long, size int, rest int, earlier array<long>, " + ", ".join(f"{b} long" for b in bits)), "early")
    # tokens of one class make no pair, nor do two nodes of a token's largest class
    classes = early.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("c")).where("c > 1")
    step = F.floor(F.log("size") / -math.log(similarity)).cast("int")
    tagged = early.join(classes.select("token", F.col("m.root").alias("main")), "token").withColumn("main", F.col("root") == F.col("main")).withColumn("step", step)
    # side 0: both outside; 1: the shorter one inside; 2: the longer one inside
    x = tagged.withColumn("side", F.explode(F.when(F.col("main"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    x = x.withColumn("step", F.explode(F.sequence(F.col("step") - 2, F.col("step"))))
    y = tagged.where(F.col("rest") >= 2 * part * F.col("size") - 1e-6)
    y = y.withColumn("side", F.explode(F.when(F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))))
    x, y = (d.select("token", "side", "step", *(F.col(c).alias(a + c) for c in ("node", "root", "size", "rest", "earlier", *bits))) for d, a in ((x, "x"), (y, "y")))
    fits = (F.col("xroot") != F.col("yroot")) & (F.col("xsize") >= F.col("ysize")) & (F.least("xrest", "yrest") >= part * (F.col("xsize") + F.col("ysize")) - 1e-6)
    apart = sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in bits), F.lit(0))
    fits &= apart <= (1 - 2 * part) * (F.col("xsize") + F.col("ysize")) + 1e-6
    fits &= ~F.arrays_overlap("xearlier", "yearlier")
    found = x.join(y, ["token", "side", "step"]).where(fits)
    return found.select(F.least("xnode", "ynode").alias("u"), F.greatest("xnode", "ynode").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, out: str = "class_id") -> DataFrame:
    """(``doc_id``, ``class_id``) for every row: the smallest id of its class of near duplicates.

    Classes join all texts linked by a similarity of ``similarity`` or more. Texts without words are a
    class of their own each; equal texts share one. A row without an id has no class.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = base.select("id", "text", F.xxhash64("text").alias("node"))
    signed = written(with_bands(keyed).select("id", "node", "bands"), "signatures")
    nodes = signed.where("bands is not null").groupBy("node").agg(F.min(F.struct("id", "bands")).alias("r")).select("node", "r.bands")
    cells = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    lead = cells.groupBy("band", "hash").agg(F.count("*").alias("n"), _leaders(FIRST_LEADERS)).where("n > 1")
    members = written(cells.join(lead, ["band", "hash"]), "buckets")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()

    small = members.where(F.col("n") <= ALL_PAIRS).groupBy("band", "hash").agg(F.sort_array(F.collect_list("node")).alias("all"))
    paired = small.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: y > F.col("x"))).alias("y"))
    led = members.where(F.col("n") > ALL_PAIRS).select(F.explode("leaders").alias("l"), F.col("node").alias("y")).select(F.col("l.node").alias("x"), "y")
    needed = members.select("node").distinct()
    texts = written(keyed.select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")
    links = written(_check(ordered(paired.unionByName(led)), texts, similarity), "links")
    # what is still apart in large buckets, first contracted by two steps: nodes linked with one leader are of one class
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy(F.col("u").alias("node")).agg(F.min(F.struct(_draw(F.col("v"), 0).alias("h"), "v")).alias("m"))
    part = near.select("node", F.when(F.col("m.h") < _draw(F.col("node"), 0), F.col("m.v")).otherwise(F.col("node")).alias("root"))
    seen = both.join(part.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min(F.struct(_draw(F.col("root"), 0).alias("h"), "root")).alias("m"))
    part = seen.select("node", F.col("m.root").alias("root"))
    placed = members.where(F.col("n") > ALL_PAIRS).select("band", "hash", "node").join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("band", "hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "hash")
    apart = written(placed.join(mixed, ["band", "hash"], "left_semi").select("node", "root").distinct().join(texts, "node"), "apart")
    more = written(_check(candidates(apart, similarity), texts, similarity), "links")
    roots = connected(links.unionByName(more), "roots")
    placed = signed.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"), F.col("bands").isNull().alias("bare"))
    # written, so that Spark may split a very large class in the join
    first = written(placed.where("not bare").groupBy("root").agg(F.min("id").alias("first")), "first")
    named = placed.where("not bare and id is not null").join(first, "root").select(F.col("id").alias(doc_id), F.col("first").alias(out))
    alone = placed.where("bare or id is null").select(F.col("id").alias(doc_id), F.col("id").alias(out))
    return named.unionByName(alone)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id names their class; rows without an id stay.

    Repeated rows (equal id and equal text) are reduced to one.
    """
    classes = near_duplicates(docs, doc_id, text, similarity).where(F.col(doc_id) == F.col("class_id")).select(F.col(doc_id).alias("__first")).distinct()
    names = docs.columns
    docs = without(docs, ["__first", "__text"]).withColumn("__text", F.xxhash64(text))
    kept = docs.join(written(classes, "kept"), docs[doc_id] == F.col("__first"), "left_semi").dropDuplicates([doc_id, "__text"])
    return kept.unionByName(docs.where(F.col(doc_id).isNull())).select(*(f"`{c}`" for c in names if c not in ("__first", "__text")))
