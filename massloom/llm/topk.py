"""Exact top-k search by inner product with the three-phase uniform threshold.

A vector's score is the sum of its scores over ``nodes`` segments of the
dimensions; each segment is a node with a score list of its own for every query.

1. Every node gives its local top list. The candidates on these lists are scored in full; the k-th
   best of a query is a cutoff that its true k-th best cannot miss.
2. The cutoff goes back to the nodes. An entry below cutoff/nodes on every node
   has a sum below the cutoff, and so has one that the other nodes' best entries cannot lift to it; each node sends the rest.
3. Candidates that were sent are scored in full, and those that reach the cutoff go on.

All nodes of a block of candidates work in one task, so that no list of a node is shuffled.

Equal vectors form one class that is searched once, as a candidate and as a query, and
gives its smallest ids at the end, so a common vector multiplies nothing. Classes are dealt to blocks by
hash; a task multiplies a block of candidates with blocks of queries.

Blocks of queries meet every block of candidates, and vectors compress well, so their sizes as files say
little about their rows: joins that carry vectors are merged, never broadcast through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import written

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
#: Queries whose best scores a task of phase 1 keeps before it gives them back.
STATE_QUERIES = 200_000
#: Below any score.
LEAST = -(1 << 62)


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 1024) -> DataFrame:
    """(``vec_id``, ``v``) with v = floor(scale * x); vectors null or holding null or non-finite components are left out, an empty one has no component and stays."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = vectors.where(F.col(vec_id).isNotNull() & fine)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def _narrow(matrix: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest integer type that holds it, and that type."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, matrix.astype(kind).tobytes()


def _blocks(df: DataFrame, size: int, count: int, dim: int, width: int, partitions: int) -> DataFrame:
    """Pack rows (``rep``, ``v``[, ``limits``]) into ``count`` blocks by hash: block, ids, kind, matrix, limits."""

    def pack(batches):
        held: list[tuple[int, int, list, list]] = []

        def flush():
            matrix = np.zeros((len(held), dim), dtype=np.int64)
            for r, h in enumerate(held):
                matrix[r, : len(h[2])] = h[2]
            ids, limit = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 3))
            row = (held[0][0], ids.tobytes(), *_narrow(matrix), limit.tobytes())
            kinds = (pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "ids", "kind", "matrix", "limits"])

        for batch in batches:
            cols = batch.to_pydict()
            for k in range(batch.num_rows):
                if held and (held[0][0] != cols["block"][k] or len(held) >= 2 * size):
                    yield flush()
                    held = []
                held.append((cols["block"][k], cols["rep"][k], cols["v"][k], cols["limits"][k]))
        if held:
            yield flush()

    limits = F.col("limits") if "limits" in df.columns else F.array_repeat(F.lit(0).cast("long"), width).alias("limits")
    ready = df.select(F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int").alias("block"), "rep", "v", limits)
    return ready.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(pack, "block int, ids binary, kind string, matrix binary, limits binary")


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer product; in floating point where every sum stays below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _nodes(row: dict, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a pair of blocks: ids of the candidates and of the queries, the queries' limits, and each node's part of every score."""
    ids, qids = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["q_ids"], dtype=np.int64)
    c, q = (np.frombuffer(row[f"{side}matrix"], dtype=row[f"{side}kind"]).astype(np.int64).reshape(len(n), -1) for side, n in (("", ids), ("q_", qids)))
    cuts = [c.shape[1] * k // nodes for k in range(nodes + 1)]
    return ids, qids, np.frombuffer(row["q_limits"], dtype=np.int64).reshape(len(qids), -1), [_product(q[:, cuts[k] : cuts[k + 1]], c[:, cuts[k] : cuts[k + 1]]) for k in range(nodes)]


def _listed(pairs: DataFrame, keep: int, nodes: int) -> DataFrame:
    """Phase 1: for each query and task the ``keep`` best full scores of candidates on some node's local list, and each node's best part.

    A candidate stands in one block, so none of its scores comes twice.
    """

    def run(batches):
        state: dict[bytes, list[np.ndarray]] = {}

        def flush():
            for raw, tables in state.items():
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in tables]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, dtype=np.int64)), *lists], names=["query", "scores", "peaks"])
            state.clear()

        for batch in batches:
            for row in batch.to_pylist():
                ids, qids, _, parts = _nodes(row, nodes)
                n = min(keep, len(ids))
                on_list = np.zeros(parts[0].shape, dtype=bool)
                for part in parts:
                    np.put_along_axis(on_list, np.argpartition(part, len(ids) - n, axis=1)[:, len(ids) - n :], True, axis=1)
                found = np.where(on_list, sum(parts), LEAST)
                peaks = np.stack([part.max(axis=1) for part in parts], axis=1)
                if found.shape[1] > keep:
                    found = np.partition(found, -keep, axis=1)[:, -keep:]
                if row["q_ids"] in state:
                    best, most = state[row["q_ids"]]
                    found, peaks = np.concatenate([best, found], axis=1), np.maximum(most, peaks)
                if found.shape[1] > keep:
                    found = np.partition(found, -keep, axis=1)[:, -keep:]
                state[row["q_ids"]] = [found, peaks]
                if len(state) * QUERY_BLOCK > STATE_QUERIES:
                    yield from flush()
        yield from flush()

    return pairs.mapInArrow(run, "query long, scores array<long>, peaks array<long>")


def _reaching(pairs: DataFrame, keep: int, nodes: int) -> DataFrame:
    """Phases 2 and 3: entries (query, rep, score) that some node's limit lets pass and whose full score reaches the cutoff, of each pair of blocks the ``keep`` best."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids, limits, parts = _nodes(row, nodes)
                sent = np.zeros(parts[0].shape, dtype=bool)
                for k, part in enumerate(parts):
                    sent |= part >= limits[:, k, None]
                r, at = np.nonzero(sent)
                score = sum(part[r, at] for part in parts)
                good = score >= limits[r, nodes]
                r, at, score = r[good], at[good], score[good]
                order = np.lexsort((ids[at], -score, r))
                r, at, score = r[order], at[order], score[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < keep
                yield pa.RecordBatch.from_arrays([pa.array(qids[r[first]]), pa.array(ids[at[first]]), pa.array(score[first])], names=["query", "rep", "score"])

    return pairs.mapInArrow(run, "query long, rep long, score long")


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, nodes: int = 2, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every row where ``is_query`` holds, its own id excluded.

    Ties go to the smaller vec_id; a query with fewer candidates has fewer rows. Rows that
    repeat an id with an equal vector count once. A vector shorter than the longest counts
    as padded with zeros. Scores are 64-bit integers and must not exceed them.
    """
    keep = k + 1
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = quantised(vectors, vec_id, embedding, scale)
    first = Window.partitionBy("v").orderBy("vec_id")
    best = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    classes = written(best.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("rep"), "members", "v"), "vector-classes")
    by_vector = classes.select("rep", "v").hint("merge")
    asked = written(quantised(vectors.where(is_query), vec_id, embedding, scale).distinct().join(by_vector, "v").select("vec_id", F.col("rep").alias("query"), "v"), "queries")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    # small tables still make a block for each task
    n_blocks = max(1, math.ceil(size.n / CANDIDATE_BLOCK), min(partitions, math.ceil(size.n / 1024)))
    dim = max(size.d or 0, nodes)
    wanted = asked.select(F.col("query").alias("rep"), "v").dropDuplicates(["rep"])
    n_wanted = max(1, math.ceil(wanted.count() / QUERY_BLOCK))
    candidates = _blocks(classes, CANDIDATE_BLOCK, n_blocks, dim, nodes + 1, partitions)

    def against(queries: DataFrame) -> DataFrame:
        """Each block of queries beside each block of candidates."""
        q = _blocks(queries, QUERY_BLOCK, n_wanted, dim, nodes + 1, min(partitions, n_wanted))
        q = q.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "kind", "matrix", "limits")), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        return candidates.drop("limits").join(q.hint("merge"), "block")

    # phase 1
    local = written(_listed(against(wanted), keep, nodes), "node-lists")
    scores = local.select("query", F.explode("scores").alias("score")).where(F.col("score") > LEAST)
    kth = scores.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") == keep).select("query", F.col("score").alias("cutoff"))
    peaks = local.groupBy("query").agg(*(F.max(F.col("peaks")[j]).alias(f"p{j}") for j in range(nodes)))
    # fewer classes than are asked for: everything has to be sent, so the cutoff is low enough for any part
    cutoff = F.coalesce("cutoff", F.lit(LEAST))
    share = F.expr(f"-((-coalesce(cutoff, {LEAST})) div {nodes})") + F.when((cutoff > 0) & (cutoff % nodes != 0), 1).otherwise(0)  # rounded up
    others = [sum((F.col(f"p{i}") for i in range(nodes) if i != j), F.lit(0).cast("long")) for j in range(nodes)]
    limits = F.array(*(F.greatest(share, cutoff - rest) for rest in others), cutoff)
    bounds = wanted.select(F.col("rep").alias("query"), "v").join(kth, "query", "left").join(peaks, "query", "left")
    cutoffs = written(bounds.select(F.col("query").alias("rep"), "v", limits.alias("limits")), "cutoffs")
    # phases 2 and 3
    reached = _reaching(against(cutoffs), keep, nodes)
    ranked = reached.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= keep).drop("n")
    members = ranked.join(classes.select("rep", "members").hint("merge"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    top = members.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= keep)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    own = asked.select(F.col("vec_id").alias("query_id"), "query").join(lists, "query")
    cut = own.select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    out = cut.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).cast("long").alias("score"))
