"""Periodic runs, chat formatting and hard negatives against brute-force versions and hostile rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tallygrid.llm import chat, negatives, periodic, registry
from tallygrid.llm.textblock import text_bytes

# Periodic runs


def brute_runs(words, exponent=4, shortest=6):
    """All runs by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, exponent * q):
                part = words[i : i + size]
                if not any(all(part[k] == part[k + p] for k in range(size - p)) for p in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(texts, **more):
    word, found = periodic.runs_of_block(*text_bytes(pa.array(texts)), **more)
    sizes = np.bincount(word[2], minlength=len(texts))
    heads = np.cumsum(sizes) - sizes
    out = [[] for _ in texts]
    for start, size, period in zip(*(x.tolist() for x in found)):
        owner = int(word[2][start])
        out[owner].append((start - int(heads[owner]), size, period))
    return out


def test_runs_equal_brute_force():
    rng, texts = random.Random(5), []
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(90):
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            words += (unit * rng.randrange(1, 7))[: rng.randrange(1, 60)]
            words += [rng.choice("abcdxyz") for _ in range(rng.randrange(3))]
        texts.append(" ".join(words))
    texts += ["", " \n", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3 + "a", "b " + "a b " * 30 + "b"]
    got = found_runs(texts)
    assert got == [brute_runs(t.split()) for t in texts] and sum(map(len, got)) > 300
    assert found_runs(texts, exponent=3, shortest=9) == [brute_runs(t.split(), 3, 9) for t in texts]


def test_runs_of_hostile_texts():
    signs, parity = ["a"], {"0": "a", "1": "b"}
    while len(signs) < 1 << 14:  # Fibonacci words are full of runs below an exponent of 4
        signs = signs + (["b"] + signs if len(signs) == 1 else signs[: int(len(signs) / 1.618)])
    thue = [parity[str(bin(i).count("1") % 2)] for i in range(1 << 15)]  # no run at all
    long = (["w%d" % i for i in range(40_000)] * 5)[:180_000]
    nested = ("a a a a a a b " * 6 + "c ") * 5_000
    got = found_runs([" ".join(thue), " ".join(signs), " ".join(long), nested, "x" * 1_000_000, "a " * 500_000])
    assert got[0] == [] and got[1] == brute_runs(signs[:3_000]) == []
    assert got[2] == [(0, 180_000, 40_000)] and got[4] == [] and got[5] == [(0, 500_000, 1)]
    assert (0, 43 * 5_000, 43) in got[3] and len(got[3]) == 1 + 5_000 * (6 + 1)


def test_periodic_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in registry.op12_periodic_runs(spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(documents)
    sha, planted = (lambda s: hashlib.sha256(s.encode()).hexdigest()), 0
    for d in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 3_000:  # the brute force is quadratic
            continue
        runs = brute_runs(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert rows[d["doc_id"]].asDict() == {
            "doc_id": d["doc_id"], "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[1] and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join("%d,%d,%d\n" % r for r in runs)),
            "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        }
    assert planted > 5


def test_periodic_messy_rows(spark):
    rows = [(1, "a b " * 5, "x"), (1, "a b " * 5, "x"), (None, "c " * 7, None), (2, None, "y"), (3, "", "z"), (4, " \n", "z")]
    df = spark.createDataFrame([(a, b, c, [1]) for a, b, c in rows], "doc_id long, text string, id string, runs array<int>")
    got = sorted(periodic.periodic_runs(df.repartition(3)).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [
        (None, 7, [(0, 7, 1)], "c"), (1, 10, [(0, 10, 2)], "a b"), (1, 10, [(0, 10, 2)], "a b"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
    ]
    assert periodic.run_digests(periodic.periodic_runs(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, exponent=2)


# Chat formatting

HOSTILE = [
    "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST] \\<s>", "[[INST]]<<s>>", "<s", "<|endoftext|>", "▁ � \u0000 é \U0001f600\r\n\t", "", " ", "</S>", "x" * 250_001, "a b " * 60_000,
]


def test_escape_round_trip():
    rng = random.Random(3)
    texts = HOSTILE + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "s", ">"]) for _ in range(12)) for _ in range(3_000)]
    for text in texts:
        held = chat.escape(text)
        assert chat.unescape(held) == text and not any(c in held for c in chat.CONTROL)


def chat_rows(spark, rows):
    schema = "conv_id long, turn long, role string, text string, ids binary, conv string, text_key string"
    return spark.createDataFrame([(*r, b"x", "y", "z") for r in rows], schema)


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for conv, turns in groups.items():
        turns = sorted(turns)
        said = "".join(f"{role}\n{text}\n" for _, role, _, text in turns)
        loss = "".join(text for _, role, _, text in turns if role == "assistant")
        size = sum(len(chat.escape(role)) + len(chat.escape(text)) + 20 for _, role, _, text in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def test_chat_round_trip_of_hostile_and_messy_rows(spark):
    rows = [(k % 3, i, ("user", "assistant", "[INST]")[i % 3], text) for k in range(6) for i, text in enumerate(HOSTILE) if (i + k) % 2]
    rows += [(7, None, None, None), (7, 1, "assistant", None), (7, 1, "assistant", "twice"), (7, 1, "assistant", "twice"), (7, 0, "assistant", "")]
    rows += [(None, 1, "user", "no conversation"), (None, None, "assistant", "b"), (None, None, "assistant", "a")]
    turns = chat.read_turns(chat.format_turns(chat_rows(spark, rows).repartition(5)))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.conversation_digests(turns).collect()}
    assert got == expected(rows)
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(chat_rows(spark, [])))).collect() == []


def test_chat_ids_and_mask():
    roles, texts = [[5, 6], [7], []], [[1, 2, 3], [], [4]]
    ids, mask, at = chat.assemble(roles, texts, np.array([True, True, False]))
    o, r, t, c = range(chat.FIRST_RESERVED, chat.FIRST_RESERVED + 4)
    assert ids.tolist() == [o, r, 5, 6, t, 1, 2, 3, c, o, r, 7, t, c, o, r, t, 4, c] and at.tolist() == [0, 9, 14, 19]
    assert np.flatnonzero(mask).tolist() == [5, 6, 7]


def test_chat_ids_are_those_of_apart_segments(spark):
    row = chat.format_turns(chat_rows(spark, [(1, 0, "assistant", "It's </s> here.")])).first()
    ids = np.frombuffer(row["ids"], "<u4")
    encoding = chat._encoding(chat.vocabulary_path("byte_bpe_50k.tiktoken"))
    role, text = encoding.encode_ordinary("assistant"), encoding.encode_ordinary("It's <\\/s> here.")
    assert ids.tolist() == [chat.OPEN, chat.ROLE, *role, chat.TEXT, *text, chat.CLOSE]
    assert list(row["mask"]) == [0] * (3 + len(role)) + [1] * len(text) + [0]


# Hard negatives


def brute_negatives(rows, anchors, positives=5, take=10):
    q = [(i, label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(q):
        if not anchors(i):
            continue
        scored = sorted((-dot(v, w), j, m) for n, (j, m, w) in enumerate(q) if n != k)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:take]
            out += [(i, p, n, j, -ps, -s) for n, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, q string, id string, row long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "q", "i", 1) for i, label, v in rows], VECTORS)


def mined(spark, rows, **more):
    return sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows).repartition(4), F.col("id") % 10 == 0, **more).collect()))


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 37))
    some = [(i, int(c), (centres[c] + 0.7 * rng.normal(size=37)).astype(np.float32).tolist()) for i, c in enumerate(rng.integers(0, 6, 260))]
    some += [(300 + i, i % 3, [0.25] * 37) for i in range(60)]  # ties
    some += [(400 + i, i % 2, []) for i in range(3)] + [(410, 1, [1.0]), (420, 2, [-0.1] * 37)]
    some += [(None, 1, [1.0] * 37), (501, None, [1.0] * 37), (502, 1, None), (503, 1, [1.0, None]), (504, 1, [float("nan")]), (510, 1, [float("inf")])]
    want = brute_negatives(some, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(spark, some) == want
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 6_000)  # several rounds
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 4)
    monkeypatch.setattr(negatives, "TILE_ROWS", 16)
    assert mined(spark, some) == want


def test_negatives_of_repeated_far_and_missing_rows(spark):
    far = [(i, i % 2, [float(2**20 + i), -3.5]) for i in range(30)]  # scores beyond 2^53
    assert mined(spark, far) == brute_negatives(far, lambda i: i % 10 == 0)
    again = [(10, 1, [1.0, 0.0])] * 3 + [(11, 2, [0.5, 0.1])] * 2 + [(12, 1, [0.9, 0.0])]
    assert mined(spark, again) == brute_negatives(again, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(10, 1, [3e38])]) == []


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(4)
    a, r = rng.integers(-300, 300, (40, 53)), rng.integers(-300, 300, (70, 53))
    r[:20] = a[:20] + rng.integers(-2, 3, (20, 53))
    one, two = negatives.Summed(a), negatives.Summed(r)
    exact, width = a @ r.T, []
    for (am, ad), (rm, rd) in zip(one.levels, two.levels):
        middle, around = am @ rm.T, ad @ rd.T + 1e-6
        assert (middle - around <= exact).all() and (exact <= middle + around).all()
        width.append(around.mean())
    assert width[0] > width[1] > width[2]
    mean, spread, sizes = negatives.summarise(a.astype(float), 16)
    for segments in (1, 4):
        got, want = negatives.pool(mean, spread, sizes, segments), negatives.summarise(a.astype(float), segments)
        assert all(np.allclose(x, y) for x, y in zip(got, want))
    least, most = np.full(40, 200_000), np.full(40, 900_000)
    i, j, score = negatives.candidate_scores(one, two, np.ones((40, 70), bool), least, most, np.float64)
    assert {(x, y) for x, y, s in zip(i, j, score) if 200_000 <= s <= 900_000} == set(zip(*np.nonzero((exact >= 200_000) & (exact <= 900_000))))
    assert (exact[i, j] == score).all()
