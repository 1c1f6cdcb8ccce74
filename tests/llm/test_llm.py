"""Operators of the llm subpackage against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from massloom.llm import chat, contamination, lines, neardup, pieces, quality, substrings, topk, toxicity, warc
from massloom.llm.bytehash import prefix, rolling, slices, span_hash, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "one two three four", "é字☃ ▁x", "x " * 40, "tie tie", "tie tie"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_span_hashes_depend_on_bytes_alone():
    buf = np.frombuffer(b"abcab cabcx", dtype=np.uint8)
    s = prefix(buf)
    assert span_hash(s, np.array([0]), np.array([3]))[0] == span_hash(s, np.array([7]), np.array([10]))[0]
    r = rolling(s, 3)
    assert r[0] == r[7] and r[0] != r[1]
    parts = list(slices(pa.array(["ab c", None, "d"]), 2))
    assert sum(p[1] for p in parts) == 3 and b"".join(bytes(p[2]) for p in parts) == b"ab cd"
    _, _, b, o = next(slices(pa.array(["ab c", "d e"]), 100))
    start, end, row = words(b, o, np.arange(256) != 32)
    assert [bytes(b[x:y]) for x, y in zip(start, end)] == [b"ab", b"c", b"d", b"e"] and row.tolist() == [0, 0, 1, 1]


# top-k


def _topk(rows, k=10):
    good = [(i, [math.floor(np.float32(x).astype(float) * 1024) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in set((i, tuple(w)) for i, w in good) if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(set(out))


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(330)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a common vector
    rows += [(2000, None), (2001, []), (2002, [None] + [0.0] * 5), (2003, [math.nan] + [0.0] * 5), (2100, [math.inf] + [0.0] * 5), (5, rows[5][1])]
    df = frame(spark, rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == _topk(rows)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, nodes=3, k=3)
    assert sorted(tuple(r) for r in got.collect()) == _topk(rows, 3)


def test_topk_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [-3.0, 1.0])]
    got = topk.top_k(frame(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == _topk(rows)
    assert topk.top_k(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


# lines


def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu", "big") for i in range(30)] + [(200, "foot\ny", "tiny"), (201, "foot\nz", "tiny"), (202, "w" * 3_000_000, "tiny"), (100, "menu\nx", "small"), (101, None, "big"), (102, "menu", None), (103, "", "big")]
    df = frame(spark, rows, "doc_id long, text string, source string").withColumn("N_LINES", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(df).collect()}
    assert got[3] == ("own 3\n", 4, 2) and got[100] == ("menu\nx", 2, 0) and got[102] == ("menu", 1, 0)
    assert got[200] == ("y", 2, 1) and got[201] == ("z", 2, 1) and got[202] == ("w" * 3_000_000, 1, 0)  # a host of few pages
    assert got[101] == (None, 0, 0) and got[103] == ("", 1, 0) and len(got) == len(rows)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_is_native(spark):
    df = frame(spark, [(1, "a\nb", "s")], "doc_id long, text string, source string")
    plan = lines.drop_boilerplate(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SentencePiece


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.PieceModel(MODEL)
    table = pieces.decoding_table(MODEL)
    random.seed(2)
    texts = [t for t in ODD if t is not None] + ["".join(random.choice("ab e\nthinrés▁.,1 -=_字\t<s>") for _ in range(random.randint(1, 90))) for _ in range(800)]
    texts += ["aaaa" * 500, "</s>[INST] <0x0A>", "word" * 3000]
    for t in texts:
        ids = lib.encode(t, add_eos=True)
        assert model.encode(t).tolist() == ids, t
        assert pieces.decode_lists(pa.array([ids], pa.list_(pa.int32())), table) == [lib.decode(ids)], t


def test_pieces_with_full_caches_and_a_long_text(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2000)
    monkeypatch.setattr(pieces, "PAIR_ENTRIES", 20)
    lib, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(MODEL)
    rng = random.Random(4)
    for t in ["".join(rng.choice("abcdefghi  ") for _ in range(300)) for _ in range(60)] + ["lorem ipsum dolor " * 60_000]:
        assert model.encode(t).tolist() == lib.encode(t, add_eos=True)
    assert len(model._pairs) <= 20 and len(model._old_pairs) <= 20


def test_piece_columns(spark):
    df = frame(spark, [(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("IDS", F.lit(3))
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    for r in got:
        ids = lib.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids)
    assert pieces.encode(df.limit(0), MODEL).count() == 0


# chat


def test_chat_round_trip(spark):
    ctl = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "<<be\\ kind>>"), (1, 1, "user", ctl), (1, 2, "assistant", ctl + " \\"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail <s>")]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", " </s>"), (None, 0, None, "x"), (4, None, "user", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.format_examples(df)
    found = examples.where("conv_id = 1").orderBy("n_turns").collect()
    assert [r.target_turn for r in found] == [2, 4, None]
    assert found[0].example[found[0].loss_start : found[0].loss_end] != "" and chat.unescape(found[0].example[found[0].loss_start : found[0].loss_end]) == ctl + " \\"
    assert chat.read_back(found[2].example) == [(r[2], r[3] or "") for r in rows[:6]]
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    by = collections.defaultdict(list)
    for c, _, role, t in rows:
        by[c].append((role or "", t or ""))  # one row has no id
    for c, turns in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_examples(df.limit(0))).count() == 0


def _written(turns):
    """Format turns in plain Python, the template's rules written out again."""
    esc = lambda t: re.sub(r"([\\<>\[])", r"\\\1", t)
    form = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
    return "".join(a + esc(t) + b for r, t in turns for a, b in [form.get(r, (f"<<{esc(r)}>> ", " <</>>"))])


def test_chat_escape_is_reversible():
    rng = random.Random(12)
    parts = ["<s>", "[INST]", " ", "[/INST]", "</s>", "<<", ">>", ">", "<", "[", "]", "/", "\\", "<</>>", "ok", "\n", "é", ""]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
    for _ in range(100_000):
        turns = [(rng.choice(["user", "assistant", "system", text()]), text()) for _ in range(rng.randint(1, 3))]
        assert chat.read_back(_written(turns)) == turns


def test_chat_ends_with_signs(spark):
    rows = [(k, n, role, t) for k, t in enumerate([">>>", "a >>>", "<", "[", "\\", " ", "[/INST", " </s>", "<</>>"]) for n, role in enumerate(["system", "user", "assistant"])]
    rows += [(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, 1, "user", ">>>")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_examples(df)
    for r in examples.where("conv_id is not null").collect():
        turns = [(role, t) for c, _, role, t in rows if c == r.conv_id]
        assert r.example == _written(turns) and chat.read_back(r.example) == turns
    assert [r.n_turns for r in chat.digests(examples).where("conv_id is null").collect()] == [1, 1, 1]


# classifiers


def _toxic_rows(n, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "rotten", "scumx" + rng.choice("abc")]))
        out.append((i, " ".join(w), "en", int(bad)))
    return out


def test_toxicity_learns_and_takes_odd_texts(spark):
    rows = _toxic_rows(900)
    docs = frame(spark, [r[:3] for r in rows] + [(-1 - k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, lang string").withColumn("SCORE", F.lit("clash"))
    labels = frame(spark, [(r[0], r[3]) for r in rows if r[0] < 600] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if r[0] >= 600]
    assert sum((got[r[0]].score >= 0.7) == bool(r[3]) for r in held) >= 0.95 * len(held)
    assert got[-9].score == got[-10].score  # repeated rows
    alone = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, alone).agg(F.max("score")).first()[0] == 0


def test_convolution_and_gradient_match_loops():
    rng = np.random.default_rng(4)
    model = toxicity.ConvModel()
    model.start()
    model.bias += np.float32(0.1)  # off the corner of the hinge
    whole = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 7, 12)]
    stem = [rng.integers(0, 50, len(w)).astype(np.int32) for w in whole]
    y = np.array([0.0, 1, 0, 1, 1])

    def logit(i):
        top = []
        for w, f in zip(toxicity.WIDTHS, model.filt):
            for k in range(model.filters):
                at = [sum(float((model.emb[0][whole[i][p + j]] + model.emb[1][stem[i][p + j]]) @ f[j, :, k]) for j in range(w)) for p in range(len(whole[i]) - w + 1)]
                top.append(max(at, default=0.0))
        return float(np.maximum(np.array(top) + model.bias, 0) @ model.out + model.out_bias)

    def loss():
        p = [1 / (1 + math.exp(-logit(i))) for i in range(len(y))]
        return -sum(math.log(q if t else 1 - q) for q, t in zip(p, y)) / len(y)

    model.fold()
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
    assert np.allclose(model.logits(np.concatenate(whole), np.concatenate(stem), bounds), [logit(i) for i in range(len(y))], atol=1e-5)
    slots = [(model.out, (1,)), (model.bias, (2,)), (model.filt[1], (1, 3, 2)), (model.emb, (0, int(whole[4][3]), 2)), (model.emb, (1, int(stem[3][2]), 5))]
    slopes, before = [], [float(a[k]) for a, k in slots]
    for a, k in slots:
        old = a[k]
        a[k] = old + 1e-3
        up = loss()
        a[k] = old - 1e-3
        slopes.append((up - loss()) / 2e-3)
        a[k] = old
    model.train(whole, stem, y, rng, batch=len(y), rate=0.4)
    moved = np.array([float(a[k]) - b for (a, k), b in zip(slots, before)])
    g = np.array(slopes)
    assert np.allclose(moved, -0.4 * g / np.sqrt(1e-2 + g**2), atol=4e-3)


def test_ordered_share():
    z, y = np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])
    assert toxicity.ordered_share(z, y) == 3.5 / 4 and toxicity.ordered_share(z, y * 0) == 0


def test_toxicity_sample_is_bounded(spark):
    rows = _toxic_rows(200, seed=5)
    docs = frame(spark, [r[:3] for r in rows] + [(3, "another text", "en"), (4, "long " * 400_000, "en"), (5, None, None)], "doc_id long, text string, lang string")
    labels = frame(spark, [(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_rows=150, max_bytes=60_000)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.score(docs, model).count() == docs.count()


def test_quality_learns_and_takes_odd_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 80))]
        good = i % 3 != 0
        rows.append((i, " ".join(w).capitalize() + "." if good else rng.choice([" | ".join(w), " ".join(w[:1] * 40), "!! ".join(w).upper()]), int(good)))
    docs = frame(spark, [r[:2] for r in rows] + [(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    labels = frame(spark, [(r[0], r[2]) for r in rows] + [(7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, F.col("doc_id") < 400).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [r for r in rows if r[0] >= 400]
    assert sum((got[r[0]] >= 0.3) == bool(r[2]) for r in held) >= 0.95 * len(held)
    assert quality.classify(docs, labels.limit(0), F.lit(True)).agg(F.max("score")).first()[0] == 0


def test_isotonic_regression():
    assert quality.pool_adjacent(np.array([0.0, 2, 1, 3]), np.ones(4)).tolist() == [0, 1.5, 1.5, 3]


# WARC


def test_warc_round_trip(spark, tmp_path):
    same, large = "<p>\r\n\r\nWARC/1.1\r\n</p>", "é" * 1_500_000
    rows = [(1, "http://a/", same), (2, "b\r\nx: y", same), (3, None, same), (4, "d", None), (5, "e", ""), (6, "f", "é"), (6, "f", "é"), (None, "g", "z"), (None, "g", "z"), (None, "h", same), (7, "i", large), (6, "j", "zz")]
    df = frame(spark, rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.archive(df, str(tmp_path / "a"))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = [(r.key, r.n_bytes, r.digest, r.kind, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "b")).collect()]
    text = {1: same, 2: same, 3: same, 4: "", 5: "", 6: "é"}
    dig = {k: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for k, t in text.items()}
    last = {same: 3, "": 5, "é": 6}
    want = [(k, len(text[k].encode()), dig[k], "response" if last[text[k]] == k else "revisit", None if last[text[k]] == k else last[text[k]]) for k in (1, 2, 3, 4, 5, 6, 6)]
    z = base64.b32encode(hashlib.sha1(b"z").digest()).decode()
    want += [(None, 1, z, "response", None), (None, 1, z, "response", None), (None, len(same), dig[1], "revisit", 3), (7, 3_000_000, base64.b32encode(hashlib.sha1(large.encode()).digest()).decode(), "response", None), (6, 2, base64.b32encode(hashlib.sha1(b"zz").digest()).decode(), "response", None)]
    assert sorted(tuple(map(str, g)) for g in got) == sorted(tuple(map(str, w)) for w in want)
    assert len({r.record for r in warc.read_archive(spark, str(tmp_path / "b")).collect()}) == len(rows)
    warc.archive(df.limit(0), str(tmp_path / "c"))
    warc.deduplicate(spark, str(tmp_path / "c"), str(tmp_path / "d"))
    assert warc.read_archive(spark, str(tmp_path / "d")).count() == 0
    payload = {r.key: r.payload for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert bytes(payload[1]) == same.encode() and bytes(payload[4]) == b""


# repeated substrings


def _strings(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    out = [text(rng.randint(0, 120)) for _ in range(40)]
    for _ in range(40):
        out.append(text(rng.randint(0, 30)) + rng.choice(shared)[rng.randint(0, 60) :] + text(rng.randint(0, 30)))
    out += [out[5], out[50], "a" * 700, "ab" * 150, "x" + "a" * 230, "", shared[0][:199], shared[0][:200], (text(50) + "|") * 2]
    return out


@pytest.mark.parametrize("piece", [1 << 20, 37])
def test_substrings_match_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    texts = [*_strings(), None]
    want = dict(enumerate(substrings.brute_force([(t or "").encode() for t in texts])))
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").withColumn("marks", F.lit(1)).withColumn("KEPT", F.lit("clash"))
    for r in substrings.remove_repeats(df).collect():
        gone = sum(b - a for a, b in r.removed_spans)
        assert (len(r.kept) + gone, gone, len(r.removed_spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], r.doc_id
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_crowded_triggers_take_the_other_way(spark, monkeypatch):
    texts = _strings(9)
    want = dict(enumerate(substrings.brute_force([t.encode() for t in texts])))
    monkeypatch.setattr(substrings, "CROWDED", 1)
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    for r in substrings.remove_repeats(df).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == want[r.doc_id][3]


def test_parse_gives_every_window_to_its_leftmost_trigger():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 150, 199, 200, 3000, 900)] + [b"a" * 500]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    hashes = rolling(prefix(buf), 32)
    row, trigger, _, start, windows, lead = substrings.parse(buf, offsets)
    seen = collections.defaultdict(set)
    for r, t, s, w, k in zip(row, trigger, start, windows, lead):
        for j in range(w):
            here = hashes[offsets[r] + s + j : offsets[r] + s + j + 169]
            hits = np.flatnonzero(here % np.uint64(substrings.MODULUS) == 0)
            if len(hits):
                assert hits[0] == k - j
            assert here[k - j] == t
            assert s + j not in seen[r]
            seen[r].add(s + j)
    assert all(seen[r] == set(range(max(0, len(t) - 199))) for r, t in enumerate(texts))


def test_both_orders_tell_equal_windows():
    rng = np.random.default_rng(0)
    gram = bytes(rng.integers(0, 256, 32).astype(np.uint8))
    pieces, lead, group = [], [], []
    for _ in range(300):
        k, windows = int(rng.integers(0, 169)), int(rng.integers(1, 60))
        windows = min(windows, k + 1)
        size = windows + 199
        # long equal stretches on either side, of bytes 0 and 1
        left = np.where(np.arange(168) < rng.choice([0, 40, 168]), 0, rng.integers(0, 2, 168)).astype(np.uint8).tobytes()[:k][::-1]
        right = np.where(np.arange(400) < rng.choice([0, 100, 400]), 1, rng.integers(0, 2, 400)).astype(np.uint8).tobytes()
        pieces.append((left + gram + right)[:size])
        lead.append(k)
        group.append(int(rng.integers(0, 2)))
    flags = substrings.repeated_windows(pieces, np.array(lead), np.array(group))
    seen = collections.Counter((g, k - j, p[j : j + 200]) for p, k, g in zip(pieces, lead, group) for j in range(len(p) - 199))
    assert any(f.any() for f in flags) and not all(f.all() for f in flags)
    for p, k, g, f in zip(pieces, lead, group, flags):
        assert f.tolist() == [seen[g, k - j, p[j : j + 200]] > 1 for j in range(len(p) - 199)]


def test_frequent_passage_between_different_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) + passage + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(300)]
    want = substrings.brute_force([t.encode() for t in texts])
    for r in substrings.remove_repeats(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == want[r.doc_id][3]


# near duplicates


def _similarity(a, b):
    def grams(t):
        w = (t or "").split()
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()

    x, y = grams(a), grams(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_similarity_is_exact():
    rng = random.Random(5)
    w = [f"w{rng.randint(0, 30)}" for _ in range(80)]
    a = [" ".join(w), " ".join(w), "x y", "", "p q r s t p q r s t"]
    b = [" ".join(w[:60] + ["z"] + w[60:]), " ".join(w[5:]), "x y", "x", "p q r s t"]
    assert np.allclose(neardup.similarities(pa.array(a), pa.array(b)), [_similarity(x, y) for x, y in zip(a, b)])


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    x, y = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    times = neardup.dart_minhash(np.repeat([0, 1], 300), np.concatenate([key, key]), np.concatenate([x, y]), 2, k=4000)
    assert abs((times[0] == times[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    assert np.isinf(neardup.dart_minhash(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 1)).all()


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(40, 200))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.choice([1, 3, 25])):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += ODD
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "").split() and _similarity(texts[i], texts[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    kept = sorted(r.doc_id for r in neardup.keep_first(df).collect())
    assert kept == sorted({root(i) for i in range(len(texts))})
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    extra = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in neardup.near_duplicates(extra).collect()))) == ["(1, 1)", "(1, 1)", "(None, None)"]


def test_large_buckets_of_many_classes_are_whole(spark):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(5000)]
    form = [rng.choice(vocab) for _ in range(176)]  # letters of one form: a little below 0.8 to each other
    texts, want = [], []
    for k in range(1500):
        own = [f"o{k}x{i}" for i in range(22)]
        texts.append(" ".join(form + own))
        want.append(k)
        if k % 300 == 0:  # a near pair inside
            texts.append(" ".join(form + own[:-19] + [f"p{k}x{i}" for i in range(19)]))
            want.append(k)
    assert 0.75 < _similarity(texts[0], texts[2]) < 0.8 <= _similarity(texts[0], texts[1])
    order = rng.sample(range(len(texts)), len(texts))
    df = frame(spark, [(i, texts[j]) for i, j in enumerate(order)], "doc_id long, text string")
    first = {}
    for i, j in enumerate(order):
        first.setdefault(want[j], i)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: first[want[j]] for i, j in enumerate(order)}


def test_candidates_miss_no_similar_pair(spark):
    rng = random.Random(10)
    words = [f"c{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 150))] for _ in range(12)]
    texts = []
    for k in range(300):
        w = list(base[k % 12]) * rng.choice([1, 1, 2])  # repeated shingles weigh more than one
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w[rng.randint(0, 3) :] if len(w) > 8 else w))
    texts = sorted(set(texts))
    nodes = frame(spark, [(i, i % 150, t) for i, t in enumerate(texts)], "node long, root long, text string")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i % 150 != j % 150 and _similarity(texts[i], texts[j]) >= 0.8}
    got = {(r.u, r.v) for r in neardup.candidates(nodes).collect()}
    assert len(want) > 100 and want <= got


def test_components(spark):
    edges = frame(spark, [(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (8, 10), (2, 1)], "u long, v long")
    assert {r.node: r.root for r in neardup.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8}
    chain = frame(spark, [(k, k + 1) for k in range(60)], "u long, v long")
    assert {r.root for r in neardup.connected(chain).collect()} == {0}


# decontamination


def test_fm_index_finds_all():
    rng = np.random.default_rng(2)
    seq = np.append(rng.integers(1, 5, 600), 0)
    index = contamination.FMIndex(seq)
    for length in (1, 3, 6):
        starts = np.arange(0, 500, 37)
        lo, hi = index.search(seq, starts, np.full(len(starts), length))
        for p, a, b in zip((seq[k : k + length] for k in starts), lo, hi):
            want = [k for k in range(len(seq) - length) if (seq[k : k + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"W{i}é" for i in range(40)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(8, 25))) for i in range(12)] + [(100, "Short one"), (101, ""), (102, None), (103, "!!"), (3, text(12))]
    docs = [text(rng.randint(0, 60)) for _ in range(60)] + [text(5) + " " + (items[k][1] or "").upper().lower() + " " + text(5) for k in range(13)] + ["a short-ONE b", *ODD]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    df = frame(spark, list(enumerate(docs)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    bench = frame(spark, items, "item_id long, text string")
    for limit in (1 << 20, 200):  # one block, and several
        for r in contamination.find_contamination(df, bench, block_bytes=limit).collect():
            w = split(docs[r.doc_id])
            hit, found = set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            assert r.n_words == len(w) and {x for a, b in r.hit_spans for x in range(a, b)} == hit and set(r.hit_items) == found
    clean = {r.doc_id: r.text for r in contamination.remove_contamination(df.drop("n_words"), bench).collect()}
    assert clean[73] == "a  b" and clean[74] is None and len(clean) == len(docs)
    assert contamination.find_contamination(df, bench.limit(0)).where("size(hit_spans) > 0").count() == 0
    assert contamination.find_contamination(df.limit(0), bench).count() == 0


def test_blocks_of_windows_are_bounded_and_exact(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SEGMENT_WINDOWS", 7)
    rng = random.Random(12)
    long = " ".join(f"v{rng.randrange(30)}" for _ in range(400))
    rows = [("same", long)] * 200 + [("other", long), ("short", "one two")]
    cut = contamination.segments(frame(spark, rows, "item_id string, text string"), "item_id", "text", 10).collect()
    assert len(cut) == len(set(cut)) <= 2 * -(-391 // 7) + 1 and max(len(r.s.split()) for r in cut) == 16
    w = contamination.Windows.of([(r.i, bytes(r.s)) for r in cut], 10)
    have = {}
    for k, (a, n) in enumerate(zip(w.starts, w.lengths)):
        have[tuple(w.tokens[a : a + n].tolist())] = sorted(w.items[i] for i in w.item_of[w.item_start[k] : w.item_start[k + 1]])
    number = w.vocabulary
    words_ = long.split()
    want = {tuple(number[x.encode()] for x in words_[k : k + 10]): ["other", "same"] for k in range(391)} | {(number[b"one"], number[b"two"]): ["short"]}
    assert have == want and len(w.starts) == len(want)
    docs = frame(spark, [(1, "x " + " ".join(words_[20:60]) + " y"), (2, None), (3, "one two one two"), (3, "one two one two")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, str(r.hit_spans), str(sorted(r.hit_items))) for r in contamination.find_contamination(docs, frame(spark, rows, "item_id string, text string"), block_bytes=300).collect()}
    assert got == {(1, 42, "[[1, 41]]", "['other', 'same']"), (2, 0, "[]", "[]"), (3, 4, "[[0, 4]]", "['short']")}


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = _toxic_rows(300, seed=1)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = {r[0]: r[1] for r in rows}
    texts[1001] = texts[1] + " extra"
    texts[1002] = "start " + item + " stop"
    texts[1003] = None
    long = " ".join(f"q{k}" for k in range(100))
    texts[1004], texts[1005] = long, long + " z"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    toxic = [r[0] for r in rows if r[3]]
    assert sum(i in got for i in toxic) <= 0.2 * len(toxic)
    assert sum(r[0] in got for r in rows if not r[3]) >= 0.95 * sum(not r[3] for r in rows)
    assert got[1002].ids == lib.encode("start  stop", add_eos=True) and got[1003].ids == [2]
    assert 1004 in got and 1005 not in got and all(r.round_trip for r in got.values())
