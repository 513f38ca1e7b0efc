import hashlib
import random

import pytest

from pyspark.sql import functions as F

from bandloom.llm import suffix_dedup
from bandloom.llm.common import keyed


def brute(texts, depth=200):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for p in range(len(r) - depth + 1):
            seen.setdefault(r[p : p + depth], []).append((i, p))
    marks = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p : p + depth] = b"\1" * depth
    out = []
    for r, m in zip(raws, marks, strict=True):
        runs = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        out.append((len(r), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(r, m, strict=True) if not x)).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)] + [prose(36), prose(200)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a : a + rng.randint(150, 500)], prose(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    edited = texts[3][:300] + "Q" + texts[3][301:]
    return [*texts, texts[0], texts[0], edited, "a" * 199, "a" * 200, "b" * 200, "b" * 201, "ab" * 400, "c" * 900, "", None, "é" * 130, "x" + "é" * 130]


@pytest.mark.parametrize("hot,buffer", [(20_000, 1 << 17), (3, 700)])
def test_matches_brute_force(spark, monkeypatch, hot, buffer):
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, first int")
    rows = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "key")
    spans = {}
    for r in suffix_dedup.repeated_spans(rows, hot).collect():
        spans.setdefault(r["key"], []).append((r["first"], r["last"]))
    want = brute(texts)
    for i, t in enumerate(texts):
        runs = suffix_dedup.merged(spans.get(i, []))
        assert (sum(b - a for a, b in runs), len(runs)) == want[i][1:3], (i, runs)
    found = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert found == [(i, *w) for i, w in enumerate(want)]


def test_repeated_and_missing_ids(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(400))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "short"), (None, None)], "doc_id long, text string")
    found = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert found == [(0, 0), (5, 0), (400, 400), (400, 400)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.kept_bytes(spark.createDataFrame([(5, t + "tail"), (6, t)], "doc_id long, text string")).collect()}
    assert kept == {5: b"tail", 6: b""}
