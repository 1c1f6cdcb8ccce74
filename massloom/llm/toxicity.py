"""Toxicity scores from a small convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of its bytes and of its first four bytes (so
inflected forms share evidence). Filters of widths 1, 2 and 3 slide over the words, the
strongest response of each is pooled over the whole text, and a logistic unit scores
the pooled responses. Training begins at random weights, but for one component of the embeddings of words that
stand in toxic or in other texts clearly more often than by chance; Spark counts them over all labelled rows. (From random weights alone
the averaged moves of small shards do not leave the start.) Training drops words at random, so that a text's second strongest
word is learnt too.

All labelled rows are learnt from. They are packed into shards of bounded size, each with the same mixture of labels; in a round every
shard trains from the shared weights over its own rows, and what the shards moved is added up in fixed point and averaged, so that the result
depends neither on partitions nor on their order. A quarter of the rows is kept out of each model; rounds end when it is ordered no
better. Scores are calibrated on all rows as the model that had not seen them scored them. Two models score together.

A model carries only the embeddings that training has moved: others are drawn from the seed where a shard trains them and count as zero where
a text is scored. So neither a task nor the driver holds a table of all buckets, and a shard trains on a table of its own words.

Scoring is one pass over whole texts in which filter responses are table look-ups.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.arrow import add_columns, column, release
from massloom.llm.bytehash import mix, prefix, slices, span_hash, words
from massloom.llm.contamination import FOLD
from massloom.session import written

#: Bounds of a shard of the labelled rows, in rows and in bytes of text; a longer text makes its shard longer.
SHARD_ROWS = 2000
SHARD_BYTES = 8 << 20
#: Rounds of training at most, rounds without progress after which it ends, what more pairs in order count as progress, and the share of words dropped.
ROUNDS, PATIENCE, PROGRESS, DROPPED = 28, 3, 0.001, 0.4
#: Deviations from chance from which on a word's counts are in its first embedding, and their weight there.
CLEAR, COUNTED = 1.5, 0.1
#: Share of ordered pairs at which training ends at once.
ENOUGH = 0.9995
#: Models, each of which learns from the rows outside its part, and how many of them score together; two have learnt from every row.
FOLDS, MODELS = 4, 2
#: Steps of the fixed point in which moves are added up, and of the logits that are counted.
FIXED, GRID = 1 << 24, 100
BUCKETS = 1 << 18
WIDTHS = (1, 2, 3)
_FOLD = np.frombuffer(FOLD, dtype=np.uint8)
_WORD = np.arange(256) != 32


def word_ids(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its first four bytes, words before each row)."""
    folded = _FOLD[buf]
    start, end, row = words(folded, offsets, _WORD)
    sums = prefix(folded)
    whole = (span_hash(sums, start, end) >> np.uint64(20)).astype(np.int64) % BUCKETS
    stem = (span_hash(sums, start, np.minimum(end, start + 4)) >> np.uint64(21)).astype(np.int64) % BUCKETS
    return whole.astype(np.int32), stem.astype(np.int32), np.searchsorted(row, np.arange(len(offsets)))


def drawn(seed: int, at: np.ndarray, dim: int) -> np.ndarray:
    """Random embeddings that a seed gives to places, uniform with a deviation of 0.05."""
    bits = mix((at.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)) ^ mix(np.array([seed], dtype=np.uint64)))
    return (((bits >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) * (0.05 * 12**0.5)).astype(np.float32)


@dataclass
class ConvModel:
    """Filters, output weights and the embeddings ``moved`` to ``values``, by place: a word's bucket, or ``BUCKETS`` and that of its first bytes.

    ``emb`` holds embeddings for training: those of all buckets after ``start``, those of a vocabulary in the models that ``over`` makes.
    ``tables`` holds what scoring looks up, ``index`` where in it a bucket stands.
    """

    dim: int = 8
    filters: int = 4
    seed: int = 7
    scale: float = 1.0
    shift: float = 0.0
    emb = tables = index = None

    def begin(self, rng: np.random.Generator | None = None) -> None:
        """Random filters, and no embedding moved yet."""
        rng = rng or np.random.default_rng(self.seed)
        self.filt = [rng.normal(0, 0.3, (w, self.dim, self.filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * self.filters, dtype=np.float32)
        self.out = rng.normal(0, 0.2, len(WIDTHS) * self.filters).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.moved, self.values = np.zeros(0, dtype=np.int32), np.zeros((0, self.dim), dtype=np.float32)

    def start(self) -> None:
        """Random weights, with embeddings for all buckets."""
        rng = np.random.default_rng(self.seed)
        self.emb = rng.normal(0, 0.05, (2, BUCKETS, self.dim)).astype(np.float32)
        self.begin(rng)

    def counted(self, at: np.ndarray, strength: np.ndarray) -> None:
        """Begin with the evidence of places, which stand in order, in the first component; every filter and output looks for it."""
        self.begin()
        self.moved, self.values = at.astype(np.int32), drawn(self.seed, at, self.dim)
        self.values[:, 0] += (COUNTED * strength).astype(np.float32)
        for f in self.filt:
            f[:, 0] = np.abs(f[:, 0])
        self.out = np.abs(self.out)

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings of places, zero where not moved; which ones are not moved)."""
        out = np.zeros((len(at), self.dim), dtype=np.float32)
        place = np.searchsorted(self.moved, at)
        known = np.zeros(len(at), dtype=bool)
        if len(self.moved):
            known = self.moved[np.minimum(place, len(self.moved) - 1)] == at
            out[known] = self.values[place[known]]
        return out, ~known

    def over(self, at: np.ndarray, whole: int) -> tuple[ConvModel, np.ndarray]:
        """A copy whose embeddings are those of a vocabulary, ``whole`` words and then first bytes, and which of them have not moved."""
        model, (rows, fresh) = replace(self), self.rows(at)
        model.emb = [rows[:whole], rows[whole:]]
        model.filt, model.bias, model.out, model.out_bias = [f.copy() for f in self.filt], self.bias.copy(), self.out.copy(), self.out_bias
        return model, fresh

    def responses(self) -> np.ndarray:
        """The filters side by side: for each width, what its first, second ... word adds."""
        return np.concatenate([x for f in self.filt for x in f], axis=1)

    def fold(self) -> None:
        """Filter responses of single words, so that a convolution is a sum of look-ups."""
        side = self.responses()
        if self.emb is not None:
            self.tables = [e @ side for e in self.emb]
            return
        self.tables, self.index = [], []
        for k in (0, 1):
            lo, hi = np.searchsorted(self.moved, [k * BUCKETS, (k + 1) * BUCKETS])
            index = np.zeros(BUCKETS, dtype=np.int32)  # 0: not moved
            index[self.moved[lo:hi] - k * BUCKETS] = np.arange(1, hi - lo + 1)
            self.index.append(index)
            self.tables.append(np.concatenate([np.zeros((1, side.shape[1]), np.float32), self.values[lo:hi] @ side]))

    def weights(self) -> np.ndarray:
        """All weights but the embeddings, in a row."""
        return np.concatenate([*(f.ravel() for f in self.filt), self.bias, self.out, [self.out_bias]]).astype(np.float64)

    def take(self, flat: np.ndarray) -> None:
        """The reverse of ``weights``."""
        parts = np.split(flat.astype(np.float32), np.cumsum([*(f.size for f in self.filt), self.bias.size, self.out.size]))
        self.filt = [x.reshape(f.shape) for x, f in zip(parts, self.filt)]
        self.bias, self.out, self.out_bias = parts[-3], parts[-2], np.float32(parts[-1][0])

    def move(self, at: np.ndarray, moves: np.ndarray) -> None:
        """Add ``moves`` to the embeddings of the places ``at``, which stand in order."""
        rows, fresh = self.rows(at)
        rows[fresh] = drawn(self.seed, at[fresh], self.dim)
        rows += moves.astype(np.float32)
        keep = ~np.isin(self.moved, at)
        places = np.concatenate([self.moved[keep], at])
        order = np.argsort(places)
        self.moved, self.values = places[order].astype(np.int32), np.concatenate([self.values[keep], rows])[order]

    def pooled(self, whole: np.ndarray, stem: np.ndarray, bounds: np.ndarray, places: bool = False):
        """Strongest response of each filter in each row (0 where no window fits), and where it stands."""
        n = len(bounds) - 1
        length = np.diff(bounds)
        best = np.zeros((n, len(WIDTHS) * self.filters), dtype=np.float32)
        where = np.full(best.shape, -1, dtype=np.int64) if places else None
        # a row for each filter's share of a word, so that windows and maxima run along memory
        if self.tables is None:  # the embeddings still move: responses of the words at hand
            single = self.responses().T @ (self.emb[0][whole] + self.emb[1][stem]).T
        else:
            a, b = (whole, stem) if self.index is None else (self.index[0][whole], self.index[1][stem])
            single = np.ascontiguousarray((self.tables[0][a] + self.tables[1][b]).T)
        first = np.cumsum([0, *WIDTHS]) * self.filters
        for g, w in enumerate(WIDTHS):
            m = len(whole) - w + 1
            rows = np.flatnonzero(length >= w)
            if m <= 0 or not len(rows):
                continue
            shares = [single[first[g] + j * self.filters : first[g] + (j + 1) * self.filters, j : j + m] for j in range(w)]
            conv = shares[0] + shares[1] if w > 1 else shares[0]
            for x in shares[2:]:
                conv += x
            for j in range(1, w):  # windows that cross into the next row
                over = bounds[1:] - j
                conv[:, over[(over >= 0) & (over < m)]] = -1e9
            start = bounds[:-1][rows]
            top = np.maximum.reduceat(conv, start, axis=1)
            cols = slice(g * self.filters, (g + 1) * self.filters)
            best[rows, cols] = top.T
            if places:
                k, at = np.nonzero(conv[:, start[0] :] == np.repeat(top, np.diff(np.append(start, m)), axis=1))
                r = np.searchsorted(start, at + start[0], side="right") - 1
                earliest = np.flatnonzero(np.diff(k * len(rows) + r, prepend=-1))
                where[rows[r[earliest]], g * self.filters + k[earliest]] = at[earliest] + start[0]
        return (best, where) if places else best

    def logits(self, whole: np.ndarray, stem: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(whole, stem, bounds) + self.bias, 0)
        return hidden @ self.out + self.out_bias

    def scores(self, whole: np.ndarray, stem: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(whole, stem, bounds).astype(np.float64) * self.scale + self.shift)

    def train(self, whole: list[np.ndarray], stem: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int = 1, batch: int = 64, rate: float = 0.4) -> None:
        """Adagrad on the log loss; the gradient of a filter flows through its strongest window."""
        squares = {"emb": [np.full(e.shape, 1e-2, np.float32) for e in self.emb], "out": np.full(self.out.shape, 1e-2), "bias": np.full(self.bias.shape, 1e-2), "ob": 1e-2, "filt": [np.full(f.shape, 1e-2) for f in self.filt]}
        for _ in range(epochs):
            order, self.tables = rng.permutation(len(y)), None
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                lens = [len(whole[i]) for i in pick]
                bounds = np.concatenate([[0], np.cumsum(lens)])
                a = np.concatenate([whole[i] for i in pick])
                b = np.concatenate([stem[i] for i in pick])
                best, where = self.pooled(a, b, bounds, places=True)
                pre = best + self.bias
                hidden = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))
                grad = (p - y[pick]) / len(pick)
                g_out = hidden.T @ grad
                g_hidden = np.outer(grad, self.out) * (pre > 0)
                touched, pushes = [], []
                for g, w in enumerate(WIDTHS if len(a) else ()):
                    cols = slice(g * self.filters, (g + 1) * self.filters)
                    at, gh = where[:, cols], g_hidden[:, cols] * (where[:, cols] >= 0)
                    g_f = np.zeros(self.filt[g].shape)
                    for j in range(w):
                        pos = np.clip(at + j, 0, max(0, len(a) - 1))
                        e = self.emb[0][a[pos]] + self.emb[1][b[pos]]
                        g_f[j] = np.einsum("nf,nfd->df", gh, e)
                        push = gh[:, :, None] * self.filt[g][j].T[None]
                        some = gh.ravel() != 0
                        touched.append(pos.ravel()[some])
                        pushes.append(push.reshape(-1, self.dim)[some])
                    squares["filt"][g] += g_f**2
                    self.filt[g] -= (rate * g_f / np.sqrt(squares["filt"][g])).astype(np.float32)
                for k, words_at in enumerate((a, b) if len(a) else ()):  # no words: output weights alone
                    at = words_at[np.concatenate(touched)]
                    if not len(at):
                        continue
                    order_at = np.argsort(at, kind="stable")
                    u, begin = np.unique(at[order_at], return_index=True)
                    ge = np.add.reduceat(np.concatenate(pushes).astype(np.float32)[order_at], begin, axis=0)
                    squares["emb"][k][u] += ge**2
                    self.emb[k][u] -= rate * ge / np.sqrt(squares["emb"][k][u])
                squares["out"] += g_out**2
                self.out -= (rate * g_out / np.sqrt(squares["out"])).astype(np.float32)
                g_b = g_hidden.sum(0)
                squares["bias"] += g_b**2
                self.bias -= (rate * g_b / np.sqrt(squares["bias"])).astype(np.float32)
                squares["ob"] += grad.sum() ** 2
                self.out_bias -= np.float32(rate * grad.sum() / np.sqrt(squares["ob"]))


@dataclass
class Ensemble:
    """Models whose calibrated logits are averaged, thresholds by language, or a constant where there was nothing to learn."""

    models: list[ConvModel]
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    packed: list[bytes] | None = None

    def folded(self) -> Ensemble:
        """A copy with look-ups and without embeddings, for one task: its worker keeps neither when the task is done."""
        models = []
        for raw in self.packed or []:
            m = pickle.loads(raw)
            m.fold()
            models.append(m)
        return Ensemble(models, constant=self.constant)

    def __getstate__(self) -> dict:
        return {"models": [], "thresholds": self.thresholds, "constant": self.constant, "packed": [pickle.dumps(m) for m in self.models]}

    def scores(self, whole: np.ndarray, stem: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return sigmoid(sum(m.logits(whole, stem, bounds).astype(np.float64) * m.scale + m.shift for m in self.models) / len(self.models))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn logits into chances, each weighted by the rows that it stands for."""
    scale, shift = 1.0, 0.0
    toxic, clean = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6) * weight
        hess = np.array([[np.sum(h * z * z) + 1e-3, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-3]])
        step = np.linalg.solve(hess, [np.sum(weight * (p - target) * z) + 1e-3 * (scale - 1), np.sum(weight * (p - target))])
        step = np.clip(step, -0.5, 0.5)
        scale, shift = max(0.05, scale - step[0]), shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(scale), float(shift)


def language_thresholds(kept: DataFrame, models: list[ConvModel], precision: float = 0.9) -> dict[str, float]:
    """Each language's lowest score, in thousandths and 0.3 at least, from which on all labelled rows reach the precision; none for a language of under 10 positive rows.

    ``kept`` has every labelled row's logit by the model that it was kept out of.
    """
    scale, shift = (F.element_at(F.array(*(F.lit(float(getattr(m, name))) for m in models)), F.col("part") + 1) for name in ("scale", "shift"))
    logit = F.least(F.greatest(scale * F.col("z") + shift, F.lit(-30.0)), F.lit(30.0))
    counts = kept.select("language", "y", F.floor(1000 / (1 + F.exp(-logit))).alias("at")).groupBy("language", "at").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    # a thousand rows a language at most
    above = Window.partitionBy("language").orderBy(F.desc("at"))
    summed = counts.withColumns({"n_above": F.sum("n").over(above), "toxic_above": F.sum("toxic").over(above), "total": F.sum("toxic").over(Window.partitionBy("language"))})
    good = summed.where((F.col("total") >= 10) & (F.col("toxic") > 0) & (F.col("at") >= 300) & (F.col("toxic_above") >= F.lit(precision) * F.col("n_above")))
    return {r.language: r.at / 1000 for r in good.groupBy("language").agg(F.min("at").alias("at")).orderBy("language").collect()}


def ordered_share(z: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a row of either label in which the positive one has the higher ``z``, ties half; 0 without such pairs."""
    values, place, count = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    pos = float((y > 0).sum())
    pairs = pos * (len(y) - pos)
    return float((rank[y > 0].sum() - pos * (pos + 1) / 2) / pairs) if pairs else 0.0


def crc_mod(doc_id: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang", max_rows: int = SHARD_ROWS, max_bytes: int = SHARD_BYTES) -> Ensemble:
    """Train on the whole texts of all labelled rows, in shards of about ``max_rows`` rows and ``max_bytes`` of text.

    Rows without a label or an id are left out, an id that is labelled more than once takes its
    largest label, one that several texts have takes the least of them, and texts that are null count as empty. Without labels of both kinds the model
    scores every text with the labels' mean (0 without any).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    language = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang and lang in docs.columns else F.lit("")
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), language.alias("language"))
    found = texts.join(known, "id").groupBy("id", "y").agg(F.min(F.struct("text", "language")).alias("t")).select(F.col("id").cast("string").alias("id"), "y", "t.*", F.octet_length("t.text").alias("size"))
    found = written(with_word_ids(found).select("id", "y", "language", "size", "whole", "stem"), "labelled")
    kinds = found.agg(F.count("*").alias("n"), F.sum("y").alias("toxic"), F.sum("size").alias("size")).first()
    if (kinds.n or 0) < 20 or kinds.toxic in (0, kinds.n):
        return Ensemble([], constant=kinds.toxic / kinds.n if kinds.n else 0.0)
    shards = _shards(found, max(1, round(kinds.n / max_rows), round(kinds.size / max_bytes)))
    models = _trained(shards)
    kept = written(_kept_out(shards, models), "kept-out")
    for k, m in enumerate(models):
        # a few thousand rows, whatever the size of the tables
        counts = kept.where(F.col("part") == k).groupBy("y", F.floor(F.col("z") * GRID + 0.5).alias("z")).agg(F.count("*").alias("n")).orderBy("y", "z").collect()
        m.scale, m.shift = platt(np.array([c.z for c in counts]) / GRID, np.array([float(c.y) for c in counts]), np.array([float(c.n) for c in counts]))
    return Ensemble(models[:MODELS], language_thresholds(kept, models))


def _shards(found: DataFrame, count: int) -> DataFrame:
    """A row for each shard: its rows' labels, languages, parts, numbers of words, words, and the places that its words stand for, as bytes; the same for the same rows.

    Rows of a shard stand in the order of a hash of their ids; either label is dealt to the parts in turn.
    """

    def pack(batches):
        held: list[tuple] = []

        def flush():
            y = np.array([h[1] for h in held], dtype=np.int32)
            part = np.zeros(len(y), dtype=np.int32)
            for label in (0, 1):
                part[y == label] = (np.arange((y == label).sum()) + held[0][0]) % FOLDS
            length = np.array([len(h[3]) // 4 for h in held], dtype=np.int64)
            own = [np.unique(np.frombuffer(b"".join(h[k] for h in held), dtype=np.int32), return_inverse=True) for k in (3, 4)]
            places = np.concatenate([own[0][0], own[1][0] + BUCKETS]).astype(np.int32)
            row = [held[0][0], y.tobytes(), [h[2] for h in held], part.tobytes(), length.tobytes(), places.tobytes(), len(own[0][0]), *(x.astype(np.int32).tobytes() for _, x in own)]
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["shard", "y", "languages", "part", "length", "places", "words", "whole", "stem"])

        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("shard", "y", "language", "whole", "stem")), strict=True):
                if held and held[0][0] != row[0]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()
        held = []
        release()

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(count)).cast("int")).select("shard", "id", "y", "language", "whole", "stem")
    ordered = dealt.repartition(max(1, min(count, 1000)), "shard").sortWithinPartitions("shard", F.xxhash64("id"), "id")
    return written(ordered.mapInArrow(pack, "shard int, y binary, languages array<string>, part binary, length binary, places binary, words int, whole binary, stem binary"), "shards")


@dataclass
class Shard:
    """Labels and parts of some rows, the bounds of their words, the words as numbers in ``places``, and how many of those are whole words."""

    number: int
    y: np.ndarray
    part: np.ndarray
    bounds: np.ndarray
    places: np.ndarray
    words: int
    whole: np.ndarray
    stem: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        y, part, places, whole, stem = (np.frombuffer(row[c], dtype=np.int32) for c in ("y", "part", "places", "whole", "stem"))
        return cls(row["shard"], y, part, np.concatenate([[0], np.cumsum(np.frombuffer(row["length"], dtype=np.int64))]), places, row["words"], whole, stem)

    def only(self, rows: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and bounds of a mask's rows, without the words that ``keep`` leaves out."""
        mask = np.repeat(rows, np.diff(self.bounds))
        if keep is not None:
            mask &= keep
        sums = np.concatenate([[0], np.cumsum(mask)])
        return self.whole[mask], self.stem[mask], np.concatenate([[0], np.cumsum((sums[self.bounds[1:]] - sums[self.bounds[:-1]])[rows])])


def _summed(made: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Moves of several shards added up; whole numbers, so that their order does not matter."""
    out = {"at": np.unique(np.concatenate([m["at"] for m in made]))}
    out["moves"], out["times"] = np.zeros((len(out["at"]), made[0]["moves"].shape[1]), np.int64), np.zeros(len(out["at"]), np.int64)
    for m in made:
        here = np.searchsorted(out["at"], m["at"])
        out["moves"][here] += m["moves"]
        out["times"][here] += m["times"]
    return out | {k: sum(m[k] for m in made) for k in ("rest", "shards", "counts")}


def _begun(shards: DataFrame) -> list[ConvModel]:
    """Models that know which places stand in toxic rows more, or less, often than by chance; each counts the rows that are not kept out of it."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard.of(row)
                n, kind = len(s.places), 2 * s.part + s.y  # no places: no words
                text = np.repeat(np.arange(len(s.y), dtype=np.int64), np.diff(s.bounds)) * n
                seen = [np.unique(text + ids) for ids in (s.whole, s.stem.astype(np.int64) + s.words)]
                found = sum(np.bincount(x % n * 2 * FOLDS + kind[x // n], minlength=n * 2 * FOLDS) for x in seen).reshape(n, 2 * FOLDS)
                # place -1 stands in every row
                found = np.concatenate([found, np.bincount(kind, minlength=2 * FOLDS)[None]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(s.places, np.int32(-1))), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=names)
        release()

    names = ["place", *(f"c{c}" for c in range(2 * FOLDS))]
    each = shards.drop("languages").mapInArrow(count, ", ".join(f"{c} int" for c in names))
    counts = written(each.groupBy("place").agg(*(F.sum(c).alias(c) for c in names[1:])), "word-counts")
    total, strength = counts.where("place = -1").first(), []
    for k in range(FOLDS):
        toxic, clean = ([f"c{2 * p + y}" for p in range(FOLDS) if p != k] for y in (1, 0))
        share = sum(total[c] for c in toxic) / max(1, sum(total[c] for c in toxic + clean))
        chance = sum(F.col(c) for c in toxic + clean) * F.lit(share)
        z = (sum(F.col(c) for c in toxic) - chance) / F.sqrt(chance * F.lit(1 - share) + 1)
        strength.append(F.when(F.abs(z) >= CLEAR, F.signum(z) * F.log1p(F.abs(z))).cast("float").alias(f"s{k}"))
    # two places a bucket at most
    clear = counts.where("place >= 0").select("place", *strength).where(F.coalesce(*(F.col(f"s{k}") for k in range(FOLDS))).isNotNull()).toArrow().sort_by("place")
    models = [ConvModel(seed=7 + k) for k in range(FOLDS)]
    for k, m in enumerate(models):
        own = clear.filter(clear[f"s{k}"].is_valid())
        m.counted(own["place"].to_numpy(), own[f"s{k}"].to_numpy())
    return models


def _trained(shards: DataFrame) -> list[ConvModel]:
    """Rounds in which every shard trains from the shared weights. Moves are added up and made in tasks; the driver passes models on, as bytes of a size bounded by their shape."""
    spark = shards.sparkSession
    packed = {k: pickle.dumps(m) for k, m in enumerate(_begun(shards))}
    best, marks = [(-1.0, b"")] * FOLDS, [(-1.0, 0)] * FOLDS  # the best model; the last progress and the rounds since
    for turn in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast(packed)

        def run(batches, shared=shared, turn=turn):
            models = {k: pickle.loads(raw) for k, raw in shared.value.items()}
            made: dict[int, list[dict]] = {k: [] for k in models}
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard.of(row)
                    for k, m in models.items():
                        made[k].append(_moves(shard, m, k, turn))
                        if len(made[k]) > 3:
                            made[k] = [_summed(made[k])]
            some = [k for k in made if made[k]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pickle.dumps(_summed(made[k])) for k in some], pa.binary())], names=["model", "sums"])
            del made, models
            release()

        def moved(batches, shared=shared):
            found: dict[int, dict] = {}
            for batch in batches:
                for k, raw in zip(*(column(batch, c).to_pylist() for c in ("model", "sums")), strict=True):
                    found[k] = _summed([*([found[k]] if k in found else []), pickle.loads(raw)])
            for k, sums in found.items():
                # a word's move is the mean of the shards that moved it, all other weights' that of all shards
                m = pickle.loads(shared.value[k])
                m.move(sums["at"], sums["moves"] / FIXED / sums["times"][:, None])
                m.take(m.weights() + sums["rest"] / FIXED / sums["shards"])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counted_share(sums["counts"])]), pa.array([pickle.dumps(m)], pa.binary())], names=["model", "share", "packed"])
            found = {}
            release()

        sums = shards.drop("languages").mapInArrow(run, "model int, sums binary").repartition(FOLDS, "model")
        got = sums.mapInArrow(moved, "model int, share double, packed binary").collect()
        shared.destroy()
        for r in got:
            k, (mark, since) = r.model, marks[r.model]
            marks[k] = (r.share, 0) if r.share >= mark + PROGRESS else (mark, since + 1)
            if r.share > best[k][0]:
                best[k] = (r.share, packed[k])
            packed[k] = bytes(r.packed)
            if marks[k][1] >= PATIENCE or r.share >= ENOUGH:
                del packed[k]
        del got
        if not packed:
            break
    return [pickle.loads(raw) for _, raw in best]


def _moves(shard: Shard, given: ConvModel, k: int, turn: int) -> dict[str, np.ndarray]:
    """What training over a shard's rows moves in a model, and how often each logit and label stands among the rows kept out of it."""
    model, fresh = given.over(shard.places, shard.words)
    held = shard.part == k
    z = model.logits(*shard.only(held))
    counts = np.zeros((2, 60 * GRID + 1), dtype=np.int64)
    np.add.at(counts, (shard.y[held], np.floor((np.clip(z, -30, 30) + 30) * GRID + 0.5).astype(np.int64)), 1)
    drawn_rows = drawn(given.seed, shard.places[fresh], given.dim)
    for e, new, rows in zip(model.emb, np.split(fresh, [shard.words]), np.split(drawn_rows, [fresh[: shard.words].sum()]), strict=True):
        e[new] = rows
    start = np.concatenate(model.emb)
    rng = np.random.default_rng([model.seed, turn, shard.number])
    if not held.all():
        w, s, b = shard.only(~held, rng.random(len(shard.whole), dtype=np.float32) >= DROPPED)
        cut = lambda x: [x[i:j] for i, j in zip(b[:-1], b[1:])]
        model.train(cut(w), cut(s), shard.y[~held].astype(np.float64), rng, rate=0.4 / (1 + 0.1 * turn))
    end = np.concatenate(model.emb)
    at = np.flatnonzero((end != start).any(axis=1))
    fixed = lambda x: np.round(np.asarray(x, dtype=np.float64) * FIXED).astype(np.int64)
    return {"at": shard.places[at], "moves": fixed(end[at] - start[at]), "times": np.ones(len(at), np.int64), "rest": fixed(model.weights() - given.weights()), "shards": 1, "counts": counts}


def _kept_out(shards: DataFrame, models: list[ConvModel]) -> DataFrame:
    """(part, y, language, z): the logit of every labelled row by the model that it was kept out of."""
    shared = shards.sparkSession.sparkContext.broadcast([pickle.dumps(m) for m in models])

    def run(batches):
        models = [pickle.loads(x) for x in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row)
                z = np.zeros(len(shard.y))
                for k, m in enumerate(models):
                    z[shard.part == k] = m.over(shard.places, shard.words)[0].logits(*shard.only(shard.part == k))
                yield pa.RecordBatch.from_arrays([pa.array(shard.part), pa.array(shard.y), pa.array(row["languages"], pa.string()), pa.array(np.clip(z, -30, 30))], names=["part", "y", "language", "z"])
        del models
        release()

    return shards.mapInArrow(run, "part int, y int, language string, z double")


def counted_share(counts: np.ndarray) -> float:
    """``ordered_share`` of logits that are counted by label."""
    neg, pos = counts.astype(float)
    pairs = neg.sum() * pos.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else 0.0


def with_word_ids(df: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            a: list[bytes] = []
            b: list[bytes] = []
            for _, n, buf, offsets in slices(column(batch, "text")):
                whole, stem, bounds = word_ids(buf, offsets)
                for k in range(n):
                    a.append(whole[bounds[k] : bounds[k + 1]].tobytes())
                    b.append(stem[bounds[k] : bounds[k + 1]].tobytes())
            return {"whole": pa.array(a, pa.binary()), "stem": pa.array(b, pa.binary())}

        return step

    return add_columns(df, make, [T.StructField("whole", T.BinaryType()), T.StructField("stem", T.BinaryType())])


def score(docs: DataFrame, model: Ensemble, text: str = "text", lang: str | None = "lang", out: str = "score", flag: str = "flagged") -> DataFrame:
    """Append a score from 0 to 1 for every whole text, and whether it reaches its language's threshold.

    Empty and null texts are scored too, from the bias alone. Texts equal in words score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights without look-up tables, of a size fixed by the models' shape

    def make():
        model = shared.value.folded()

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            parts = [model.scores(*word_ids(buf, offsets)) for _, _, buf, offsets in slices(column(batch, text), 1 << 18)]
            return {out: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())}

        return step

    scored = add_columns(docs, make, [T.StructField(out, T.DoubleType())])
    limit = F.lit(0.7)
    if lang and lang in docs.columns:
        for one, t in model.thresholds.items():
            limit = F.when(F.col(lang) == one, F.lit(t)).otherwise(limit)
    return scored.withColumn(flag, F.col(out) >= limit)
