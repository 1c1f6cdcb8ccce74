"""Fingerprints, importance resampling and the filter audit against plain loops."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.llm import audit, fingerprints, resample, topk, toxicity

ODD = [None, "", " ", "\n\n", "a", "one two three four", "é字☃ ▁x", "x " * 4000, "tie tie", "tie tie", "A1!b2_C3", "日本語 テキスト " * 50]


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# fingerprints


def slow_fingerprint(text):
    """Chunk by chunk: a rolling sum over seven characters, signs from each chunk's own sum."""
    word, base = (1 << 64) - 1, fingerprints._BASE

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 31

    def total(part):
        return sum((ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(part)) & word

    level = 0
    while len(text) > 64 << level:
        level += 1
    out = []
    for bits in (level, level + 1):
        parts, begin = [], 0
        for k in range(len(text)):
            low = (1 << bits) - 1
            if len(parts) < 127 and mix(total(text[max(0, k - 6) : k + 1])) & low == low:
                parts.append(text[begin : k + 1])
                begin = k + 1
        if begin < len(text):
            parts.append(text[begin:])
        signs = [mix((total(p) + len(p)) & word) >> 52 for p in parts]
        out.append("".join(fingerprints.SIGNS[s >> 6] + fingerprints.SIGNS[s & 63] for s in signs))
    return f"{level}:{out[0]}:{out[1]}"


def slow_alike(a, b):
    if a == b:
        return 1.0
    x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a, b))
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        old, row = row, [i]
        for j, q in enumerate(y, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (0 if p == q else 2)))
    return 1 - row[-1] / (len(x) + len(y))


def slow_likeness(a, b):
    if a == b:
        return 1.0
    (la, *x), (lb, *y) = a.split(":"), b.split(":")
    d = int(lb) - int(la)
    pairs = [(x[0], y[0]), (x[1], y[1])] if d == 0 else [(x[1], y[0])] if d == 1 else [(x[0], y[1])] if d == -1 else []
    return max((slow_alike(*p) for p in pairs), default=0.0)


@pytest.mark.parametrize("piece", [1 << 18, 50])
def test_fingerprint_equals_the_slow_one_however_it_is_cut(monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    rng = random.Random(3)
    for text in [*ODD, *(prose(rng, n) for n in (10, 12, 60, 300)), "ab" * 700, "a" * 5000]:
        assert fingerprints.fingerprint(text) == slow_fingerprint(text or "")


def test_likeness_is_the_edit_distance_and_finds_kinship():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (5, 50, 400, 400, 900)]
    marks = [fingerprints.fingerprint(t) for t in texts]
    for a, b in itertools.product(marks, marks):
        assert abs(fingerprints.likeness(a, b) - slow_likeness(a, b)) < 1e-12
    assert fingerprints.likeness(None, marks[0]) is None
    for t, other in zip(texts, texts[1:]):
        changed = fingerprints.edited(t, other)
        assert fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(changed)) > 0.3
    assert fingerprints.likeness(marks[2], marks[3]) < 0.15
    assert len(fingerprints.fingerprint("xy" * 3_000_000)) < 600


@pytest.mark.parametrize("range_bytes", [1 << 23, 2000])
def test_every_text_meets_its_successor(spark, range_bytes):
    rng = random.Random(5)
    rows = [(i * 3, prose(rng, rng.randrange(1, 200)), i) for i in range(120)]
    rows += [(7, t, k) for k, t in enumerate(ODD)] + [(None, t, k) for k, t in enumerate(["n one", None, "n two"])]
    rows += [(11, "same", 1), (11, "same", 1), (2**62, "far", 0), (-5, "z" * 30000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    from pyspark.sql import functions as F

    h = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h[r], r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = slow_fingerprint(t) if len(t) < 2000 else fingerprints.fingerprint(t), fingerprints.fingerprint(e), fingerprints.fingerprint(n)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(slow_likeness(a, b), 9), round(slow_likeness(a, c), 9)))
    got = fingerprints.compare_with_next(df, range_bytes=range_bytes).collect()
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_fingerprints_of_empty_tables_and_single_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, Fingerprint int")
    assert fingerprints.compare_with_next(df).count() == 0 and fingerprints.fingerprints(df).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "hello")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"helhe").hexdigest()
    two = spark.createDataFrame([("a b c",), (None,)], "text string")
    made = fingerprints.fingerprints(two).withColumn("l", fingerprints.likeness_of(fingerprints.F.col("fingerprint"), fingerprints.F.lit(slow_fingerprint("a b c")))).collect()
    assert [r.l for r in made] == [1.0, 0.0]


# resampling


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_features_equal_the_slow_ones_however_they_are_cut(monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    rng = random.Random(6)
    texts = [*ODD, prose(rng, 500), "w" * 300 + " b " + "é" * 200, "..." * 100 + "a b", "a" + " " * 300 + "b" + " " * 300 + "c d", "X" * 65 + " " + "Y" * 64 + " z"]
    rows, found, n_words = [], [], np.zeros(len(texts), dtype=int)
    for row, bucket, word in resample.feature_buckets(pa.array(texts)):
        rows += row.tolist()
        found += bucket.tolist()
        n_words += np.bincount(word, minlength=len(texts))
    for k, t in enumerate(texts):
        n, want = slow_features(t)
        assert n_words[k] == n and sorted(b for r, b in zip(rows, found) if r == k) == sorted(want), (k, piece)


def slow_draw(docs, target, per_cent=5):
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in slow_features(text)[1]:
            s[b] += 1
    for text in target:
        for b in slow_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for i, text in docs:
        n, f = slow_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= 20])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: per_cent * len(best) // 100], 1):
        r[4] = k
    return sorted(repr(r[:5]) for r in out)


@pytest.mark.parametrize(("block", "ranges", "per_cent"), [(4096, 1000, 5), (3, 4, 40), (1, 1000, 100)])
def test_draw_equals_sorting_all(spark, monkeypatch, block, ranges, per_cent):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "RANGES", ranges)
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.randrange(1, 80))) for i in range(300)] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs += [(2000, "tie " * 30), (2000, "tie " * 30), (None, prose(rng, 40))]
    target = [prose(rng, 100, 30), None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, Rank int").repartition(7)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), per_cent=per_cent)
    assert sorted(repr([r.doc_id, r.n_features, r.weight, r.score, r.rank]) for r in got.collect()) == slow_draw(docs, target, per_cent)


def test_draw_of_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, prose(random.Random(1), 30))], "doc_id long, text string")
    got = {r.doc_id: r for r in resample.resample(some, target, per_cent=50).collect()}
    assert [got[k].rank for k in (1, 2)] == [None, None] and resample.resample(some, target, per_cent=100).where("rank = 1").count() == 1


def test_tournament_merges_any_runs():
    rng = random.Random(8)
    for runs in (1, 2, 5, 33):
        entries = [(rng.randrange(50), rng.randrange(9), k) for k in range(400)]
        blocks = []
        for r in range(runs):
            mine = sorted((-s, i, k) for s, i, k in entries[r::runs])
            while mine:
                n = rng.randrange(1, 20)
                blocks.append(mine[:n])
                mine = mine[n:]
        stream = ((-np.array([e[0] for e in b]), np.array([e[1] for e in b]), np.array([e[2] for e in b])) for b in sorted(blocks))
        assert list(resample.merged(stream)) == sorted((-s, i, k) for s, i, k in entries)


# audit


def slow_flags(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        mine = [x for x in labels if i is not None and x[0] == i]
        out.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return out


def slow_audit(rows):
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                share[f] += len(gone)
                fail = [r for r in mine if r[1][k]]
                found.append([part, "".join(order), step, len(left), len(gone), len(fail) - len(gone), sum(sum(r[1]) == 1 for r in fail), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [repr([*x[:9], share[x[9]]]) for x in found]
    return sorted(out)


@pytest.mark.parametrize("rows_at_once", [1 << 16, 5])
def test_audit_equals_filtering_in_every_order(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(audit, "ROWS", rows_at_once)
    monkeypatch.setattr(audit, "PIECE", 100)
    rng = random.Random(10)
    texts = [*ODD, *(prose(rng, n, v) for n, v in [(250, 1000), (250, 20), (199, 1000), (200, 1000), (400, 4000)]), "A" * 900 + prose(rng, 300, 5000), prose(rng, 300, 9000) + " #", "\x1c".join(["q"] * 300), "Qé" * 40]
    docs = [(rng.randrange(60) if k % 9 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for k in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, part int")
    got = audit.audit(audit.text_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), list("ABCDE"), ["good", "toxic"])
    have = sorted(repr(list(r)) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert have == slow_audit(slow_flags(docs, labels))


def test_audit_of_empty_tables_and_other_filters(spark):
    none = audit.text_filters(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(none, list("ABCDE"), ["good", "toxic"]).count() == 0
    rows = spark.createDataFrame([("p", True, None, True), ("p", True, True, False), (None, False, False, True)], "part string, x boolean, y boolean, l boolean")
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(rows, ["x", "y"], ["l"]).collect()}
    assert len(got) == 8 and got["p", "xy", 1].removed == 2 and got["p", "xy", 2].redundant == 1 and got["p", "yx", 1].l_lost == 0 and got["", "xy", 2].kept == 1 and got["p", "yx", 2].shapley == 3


# quality


def slow_statistics(text):
    b = (text or "").encode()
    w = b.split()
    n, many = max(1, len(b)), max(1, len(w))
    up = [c for k, c in enumerate(b) if 65 <= c <= 90 or (c in range(0x80, 0x9F) and k and b[k - 1] == 0xC3)]
    is_up = [65 <= c <= 90 or (k > 0 and b[k - 1] == 0xC3 and 0x80 <= c < 0x9F) for k, c in enumerate(b)]
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    times = {}
    for x in w:
        times[x] = times.get(x, 0) + 1
    caps, at = 0, 0
    for x in w:
        at = b.index(x, at)
        caps += sum(is_up[at : at + len(x)]) >= 2 and sum(map(letter, x)) > 1
        at += len(x)
    of = lambda s: sum(c in s for c in b) / n
    return [
        math.log1p(len(b)), math.log1p(len(w)), min(sum(map(len, w)) / many, 40), sum(len(x) > 16 for x in w) / many, len(up) / n, of(b"0123456789"), of(b".,;:?'\"()-"), of(b"#$%&*+/<=>@[\\]^_`{}~"),
        of(b"!"), of(b"|"), sum(c > 127 for c in b) / n, b.count(10) / many, len(times) / many**0.9, sum(x == y for x, y in zip(w, w[1:])) / many, max(times.values(), default=0) / many, caps / many, sum(x[-1:] in (b".", b",") for x in w) / many,
    ]


def test_statistics_equal_the_slow_ones():
    from massloom.llm import quality
    from massloom.llm.bytehash import slices

    rng = random.Random(13)
    texts = [*ODD, *(prose(rng, n, 30) for n in (1, 20, 200)), "ÄÖ AB ÀÞ xY, Zz. 12\n\n#!| ", "a a A A b b.", "averyverylongwordindeed! OK OK"]
    got = np.concatenate([quality.statistics(buf, offsets) for _, _, buf, offsets in slices(pa.array(texts))])
    assert np.allclose(got, [slow_statistics(t) for t in texts])


def test_quality_scores_equal_a_direct_ridge(spark):
    """Features, normal equations, halves and calibration by plain numpy over one small table, with the model's random directions."""
    from pyspark.sql import functions as F

    from massloom.llm import quality

    rng = random.Random(14)
    texts = [(i, prose(rng, rng.randrange(5, 60)) if i % 3 else prose(rng, 8, 2).upper() + " |!") for i in range(240)] + [(900 + k, t) for k, t in enumerate(ODD)]
    labels = [(i, int(i % 3 > 0 and i % 11 > 0)) for i in range(0, 240, 2)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, statistics string, score int").repartition(5)
    known = spark.createDataFrame(labels + [(4, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, known, F.col("doc_id") % 10 != 0).collect()}
    fold = {r.doc_id: r.f for r in spark.createDataFrame(labels, "doc_id long, y int").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    learnt = [(i, y) for i, y in labels if i % 10]
    x = {i: np.array(slow_statistics(t)) for i, t in texts}
    train = np.array([x[i] for i, _ in learnt])
    y = np.array([float(v) for _, v in learnt])
    f = np.array([fold[i] for i, _ in learnt])
    r = np.random.default_rng(11)
    omega, phase = r.normal(0, 1 / np.sqrt(17 / 2), (17, quality.FEATURES)), r.uniform(0, 2 * np.pi, quality.FEATURES)
    spread = train.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)

    def features(rows):
        z = np.clip((rows - train.mean(axis=0)) / spread, -4, 4)
        return np.hstack([np.ones((len(rows), 1)), np.cos(z @ omega + phase) * np.sqrt(2 / quality.FEATURES)])

    def ridge(rows, want):
        z = features(rows)
        return np.linalg.lstsq(np.vstack([z, np.sqrt(0.1) * np.eye(z.shape[1])]), np.append(want, np.zeros(z.shape[1])), rcond=None)[0]

    half = [ridge(train[f == k], y[f == k]) for k in (0, 1)]
    raw = np.where(f == 0, features(train) @ half[1], features(train) @ half[0])
    place = np.clip(np.floor((raw + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    bins = np.unique(place)
    weight = np.array([(place == b).sum() for b in bins], dtype=float)
    level = [np.array([y[place == b].mean() for b in bins])]
    # isotonic regression as the largest of the least means
    sums, counts = np.concatenate([[0], np.cumsum(level[0] * weight)]), np.concatenate([[0], np.cumsum(weight)])
    iso = [max(min((sums[b] - sums[a]) / (counts[b] - counts[a]) for b in range(k + 1, len(bins) + 1)) for a in range(k + 1)) for k in range(len(bins))]
    whole = ridge(train, y)
    for i, _ in texts:
        s = float(features(x[i][None])[0] @ whole)
        want = np.clip(0.99 * np.interp(s, (bins + 0.5) * 2 / quality.BINS - 0.5, iso) + 0.01 * np.clip(s, 0, 1), 0, 1)
        assert abs(got[i] - want) < 1e-5, i


def test_quality_of_an_empty_table_and_a_long_text(spark):
    from pyspark.sql import functions as F

    from massloom.llm import quality

    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels, F.lit(True)).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "|"), (3, None)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.classify(long, labels, F.lit(True)).collect())


def test_search_broadcasts_no_vectors(spark):
    rows = [(i, [float((i * k) % 7) for k in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[block", plan) and not re.search(r"BroadcastHashJoin \[(block|rep|v)#", plan)
    v = {i: [int(1024 * x) for x in e] for i, e in rows}
    want = [(q, n + 1, i, -s) for q in (0, 100, 200) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:10])]
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + (" vile" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    counted, platt = [], toxicity.platt
    monkeypatch.setattr(toxicity, "platt", lambda z, y, weight: counted.append((weight.sum(), (weight * y).sum())) or platt(z, y, weight))
    monkeypatch.setattr(toxicity, "ROUNDS", 3, raising=False)
    made = [toxicity.fit(docs.repartition(n), labels, max_rows=100, max_bytes=1000) for n in (1, 7)]
    # each row is kept out once, whatever the bounds of a shard
    assert [sum(x) for x in zip(*counted[:4])] == [300, 75] and counted[:4] == counted[4:]
    assert [(m.scale, m.shift, m.out.tolist()) for m in made[0].models] == [(m.scale, m.shift, m.out.tolist()) for m in made[1].models]


def test_toxicity_models_hold_their_words_alone_and_leave_the_start(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    rows = [(i, " ".join([*rng.choices(vocab, k=60), *(["vile"] if i % 8 == 0 else []), *rng.choices(vocab, k=60)]), "en", int(i % 8 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 400], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_rows=50)
    # words and beginnings of words, and no table of all buckets on the driver
    assert all(getattr(m, "emb", None) is None and len(m.moved) <= 1002 for m in model.models)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    z, y = (np.array(x) for x in zip(*((got[r[0]], r[3]) for r in rows if r[0] >= 400)))
    assert toxicity.ordered_share(z, y) >= 0.95


def test_toxicity_trains_on_batches_without_words(spark):
    model = toxicity.ConvModel()
    model.start()
    before = model.out_bias
    none = [np.zeros(0, dtype=np.int32)] * 3
    model.train(none, none, np.array([0.0, 1.0, 1.0]), np.random.default_rng(0))
    assert model.out_bias > before
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(40)], "doc_id long, text string")
    fitted = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    scores = [r.score for r in toxicity.score(docs, fitted).collect()]
    assert len(scores) == 40 and len(set(scores)) == 1 and abs(scores[0] - 0.25) < 0.05


def test_language_thresholds_count_every_row(spark):
    rng = random.Random(9)
    rows = [(i % 4, int(rng.random() < 0.3), rng.choice(["de", "en"])) for i in range(2000)] + [(0, 1, "fr")] * 9
    rows = [(part, y, lang, rng.gauss(2 * y - 1, 1)) for part, y, lang in rows]
    models = [toxicity.ConvModel(scale=1 + 0.1 * k, shift=-0.2 * k) for k in range(4)]
    want = {}
    for lang in ("de", "en"):
        at = sorted((math.floor(1000 / (1 + math.exp(-(models[p].scale * z + models[p].shift)))), y) for p, y, l, z in rows if l == lang)
        good = [c for c, y in at if y and c >= 300 and sum(y for b, y in at if b >= c) >= 0.9 * sum(b >= c for b, _ in at)]
        want |= {lang: good[0] / 1000} if good else {}
    assert want and toxicity.language_thresholds(spark.createDataFrame(rows, "part int, y int, language string, z double").repartition(5), models) == want
