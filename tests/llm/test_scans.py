import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import decontaminate, licenses, personal_data
from bandloom.llm.personal_data import KINDS

SF = "/root/testdata/sf0.01"


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


ODD = [
    "a@b.c+d@e.f é\U0001f600 x@y.zz", "é 1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 0.0.0.00000256", "4111 1111 1111 1111 and 4111-1111-1111-1111 12345678901234567890 4111 1111 1111 11112",
    "+1 (017) 555-7713+44 20 7946 0958 +1", "mail me: john (at) site (dot) com or call 415-555-1234 now", "", "a@@b.com %@x.y", "..@a.b", "+123456789012345678", "tel +12345678 9", None, "9" * 5000, "a." * 4000 + "@", "1." * 3000,
]


def test_base_spans_equal_the_patterns(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() + [(10**6 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    found = {r["doc_id"]: r for r in personal_data.find(docs).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        want, r = base_spans(t), found[i]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k + ":") for s in want) for k in KINDS], t
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) or not want
    assert sum(r["spans"] != ",".join(base_spans(dict(rows)[i])) for i, r in found.items()) < 20


def test_the_classifier_adds_spelled_out_addresses(spark):
    rows = [(i, f"please write to name{i} (at) site{i} (dot) com today") for i in range(60)] + [(100 + i, f"mail a{i}@b.com or ip 10.1.2.{i}") for i in range(60)] + [(200, "meet (at) noon")]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].startswith("email:16:") for i in range(60)) and found[200] == ""


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "at a@b.com, é 1.2.3.4!", 24), (1, "at a@b.com, é 1.2.3.4!", 24), (2, "clean", 5), (None, None, None)], "doc_id long, text string, n_chars long")
    out = sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in personal_data.redact(docs).collect())
    assert out == [(-1, None, None), (1, "at [EMAIL], é [IP]!", 19), (1, "at [EMAIL], é [IP]!", 19), (2, "clean", 5)]
    assert personal_data.redact(docs.limit(0)).collect() == [] and personal_data.find(docs.limit(0).drop("n_chars")).collect() == []


def test_redaction_tells_rows_apart_and_keeps_clashing_columns(spark):
    names = "doc_id long, text string, row_key string, row_spans int, row int, kind string, start int, end int, _text string"
    rows = [(1, "at a@b.com", "u", 1, 2, "k", 3, 4, "t"), (1, "at 1.2.3.4", "v", 1, 2, "k", 3, 4, "t"), (None, "c@d.org", "w", None, None, None, None, None, None), (None, "none", "x", 1, 2, "k", 3, 4, "t")]
    docs = spark.createDataFrame(rows, names)
    out = personal_data.redact(docs)
    assert out.columns == docs.columns
    assert {r["row_key"]: r["text"] for r in out.collect()} == {"u": "at [EMAIL]", "v": "at [IP]", "w": "[EMAIL]", "x": "none"}
    assert {(r["row"], r["_text"]) for r in out.collect()} == {(2, "t"), (None, None)}


def plain_em(patterns, rounds):
    """The same estimates, over one row for every candidate."""
    rows = [(k, v) for k, v, n in patterns for _ in range(n)]
    q = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v in rows]
    for _ in range(rounds):
        real = {k: [1 + sum(p for (kk, _), p in zip(rows, q, strict=True) if kk == k), 1 + sum(1 - p for (kk, _), p in zip(rows, q, strict=True) if kk == k)] for k, _ in rows}
        table = {}
        for j in range(5):
            for y in (0, 1):
                sums = [1 + sum((1 - p, p)[1 - y] for (_, v), p in zip(rows, q, strict=True) if v[j] == vote) for vote in (-1, 0, 1)]
                for vote, n in zip((-1, 0, 1), sums, strict=True):
                    table[j, vote, y] = n / sum(sums)
        q = []
        for k, v in rows:
            a, b = real[k]
            for j in range(5):
                a, b = a * table[j, v[j], 0], b * table[j, v[j], 1]
            q.append(a / (a + b))
    by = dict(zip(rows, q, strict=True))
    return [by[k, v] for k, v, _ in patterns]


def test_reliabilities_equal_a_plain_em():
    rng = np.random.default_rng(1)
    seen = {}
    for _ in range(200):
        real, kind = rng.random() < 0.6, int(rng.integers(3))
        votes = tuple(int(rng.choice([-1, 0, 1], p=[0.1, 0.2, 0.7] if real else [0.6, 0.3, 0.1])) for _ in range(5))
        seen[kind, votes] = seen.get((kind, votes), 0) + 1
    patterns = sorted((k, v, n) for (k, v), n in seen.items())
    posterior, share = personal_data.reliabilities(patterns, rounds=12)
    # share[j, v, 1] is that of real spans, of which posterior is the probability
    assert np.allclose(posterior, plain_em(patterns, 12), rtol=1e-6) and share[0, 1, 1] > share[0, 1, 0]


def test_licences(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, "prose\nReleased under the MIT Licence\nmore"), (3, "prose released under the MIT License of old"),
        (4, "a\n\nCopyright 1999 X\n" + mit.replace("\n\n", "\n") + "\n\nb"), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0."), (7, "x\nLICENSED UNDER THE APACHE LICENSE, version 2.0\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, license string")
    found = {r["doc_id"]: (r["n_matches"], r["whole"], r["licenses"]) for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert found[1] == (1, True, "MIT") and found[2] == (1, False, "MIT") and found[3] == (0, False, "") and found[4] == (1, False, "MIT")
    assert found[5] == found[6] == (0, False, "") and found[None] == (1, True, "CC-BY-NC-4.0") and found[7] == (2, False, "Apache-2.0,MIT")
    assert licenses.scan(docs.limit(0), licenses.known(spark)).collect() == []


def test_every_known_text_is_found(spark):
    """Each as a document, in other case and with a copyright line before it."""
    rows = [(k, ("Copyright (c) 2001 A. Body\n" if k % 2 else "") + (t.upper() if k % 3 == 0 else t)) for k, (_, t) in enumerate(licenses.KNOWN)]
    docs = spark.createDataFrame([*rows, (9_999, licenses.KNOWN[-1][1][:-200])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known(spark)).collect()}
    for k, (name, _) in enumerate(licenses.KNOWN):
        assert found[k]["whole"] and name in found[k]["licenses"].split(","), name
    assert not found[9_999]["whole"] and len({a for a, _ in licenses.KNOWN}) > 50
    own = [("house", "You may read this and no more.")]  # a list of the caller's, without any usual word
    note = spark.createDataFrame([(1, "x\nyou may READ this, and no more\ny"), (2, "x " * 100_000)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["licenses"]) for r in licenses.scan(note, licenses.known(spark, own)).collect()) == [(1, "house"), (2, "")]


def test_one_form_in_spark_and_for_the_sql(spark):
    texts = [t for _, t in licenses.KNOWN] + ["(C) x\n  Copyright y\nA-B v2 and/or licence!", "", "\u00c9 \u0130 v 3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t")).alias("c"), "t").collect()
    assert all(r["c"] == licenses.canonical_text(r["t"]) for r in rows)


def test_licences_equal_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(licenses.scan_oracle()).fetchall())
    found = sorted((r["doc_id"], r["n_matches"], r["whole"], r["licenses"]) for r in licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), licenses.known(spark)).collect())
    assert found == want and sum(r[1] for r in found) > 5


def plain_distance(item, text):
    """Least edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = "".join(rng.choice(list("abc "), int(rng.integers(1, 30))))
        text = "".join(rng.choice(list("abc "), int(rng.integers(0, 60))))
        assert decontaminate.edit_distance_within(item, text, 99)[0] == plain_distance(item, text)


def test_leaks_reach_the_recall_and_are_exact(spark):
    rng = np.random.default_rng(5)
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    texts = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 300 AND 1500 LIMIT 200").fetchall()]
    block = decontaminate.Items(items)
    docs, planted = [], set()
    for k, text in enumerate(texts[:160]):
        i = k % len(items)
        share = (0, 0.03, 0.06, 0.1)[k // 40]
        docs.append((k, f"{text} {decontaminate.edited(block.texts[i], int(share * len(block.texts[i])), rng)} {text[:200]}".upper() if k % 2 else f"{text}\n{decontaminate.edited(block.texts[i], int(share * len(block.texts[i])), rng)}"))
        planted.add((k, block.ids[i]))
    docs += [(1000, None), (1001, ""), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (None, "x"), (9999, None), (9998, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(df, bench).collect()}
    assert len(planted & found.keys()) >= 0.95 * len(planted)
    assert all((k, block.ids[k % len(items)]) in found for k in range(40))  # unedited ones always
    assert (None, items[0][0]) in found
    by_id, of = dict(docs), dict(zip(block.ids, block.texts, strict=True))
    for (d, i), distance in list(found.items())[:40]:
        reduced = b" ".join(decontaminate.words_of(by_id[d])).decode()
        assert plain_distance(of[i], reduced) <= distance <= decontaminate.RATIO * len(of[i])
    clean = decontaminate.remove_leaks(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {d for d, _ in found}
    assert decontaminate.leaks(df, bench.limit(0)).collect() == []


def test_a_typo_in_every_second_word_hides_no_item():
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall()
    block, (foreign,) = decontaminate.Items(items), duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 300 AND 900 ORDER BY doc_id LIMIT 1").fetchone()
    tried = 0
    for i, item, most in zip(block.ids, block.texts, block.most, strict=True):
        words = item.split(" ")
        words[1::2] = [w[:-1] + ("z" if w[-1] != "z" else "y") for w in words[1::2]]
        if len(words) // 2 <= most:
            tried += 1
            assert dict(block.leaks([f"{foreign} {' '.join(words)} {foreign}"])[0])[i] <= len(words) // 2
    assert tried > 30


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "\u8bf7\u95ee\u6c34\u7684\u6cb8\u70b9\u5728\u6807\u51c6\u5927\u6c14\u538b\u4e0b\u662f\u591a\u5c11\u5ea6"), (3, "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e"), (4, "?!"), (5, "\u6c34")]
    docs = [(1, "so - who wrote  HAMLET, then"), (2, f"abc\u3002{items[1][1]}\u3002def"), (3, f"x{items[1][1].replace(chr(0x6cb8), chr(0x70e7))}"), (4, f"\u0e41\u0e25\u0e30{items[2][1]}\u0e44"), (5, "who wrote othello"), (6, "Hamlet?! who wrote"), (7, items[4][1])]
    found = {tuple(r) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1, 0), (2, 2, 0), (2, 5, 0), (3, 2, 1), (3, 5, 0), (4, 3, 0), (7, 5, 0)}


def test_leaks_equal_brute_force_for_items_of_all_sizes():
    rng = np.random.default_rng(8)
    for letters in ("ab ", "abcdefgh  ", "a\u00e9\u6c34\u0e01 "):
        make = lambda n: " ".join("".join(rng.choice(list(letters), n)).split())  # noqa: E731, B023
        items = [(n, t) for n in [*range(1, 24), 29, 30, 40, 57, 80] if (t := make(n))]
        texts = [make(int(rng.integers(0, 60))) for _ in range(20)]
        for _, t in items:
            texts.append(make(9) + decontaminate.edited(t, len(t) // 10, rng) + make(9))
        for text, found in zip(texts, decontaminate.Items(items).leaks(texts), strict=True):
            reduced = b" ".join(decontaminate.words_of(text)).decode()
            assert found == [(i, d) for i, t in items if (d := plain_distance(t, reduced)) <= len(t) // 10]


def test_each_share_of_edits_reaches_the_recall():
    rng = np.random.default_rng(6)
    block = decontaminate.Items(duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall())
    (foreign,) = duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 300 AND 900 ORDER BY doc_id LIMIT 1").fetchone()
    for share in (0, 0.03, 0.06, 0.1):
        texts = [f"{foreign} {decontaminate.edited(t, int(share * len(t)), rng)} {foreign}" for t in block.texts for _ in range(3)]
        assert all(block.ids[k // 3] in dict(f) for k, f in enumerate(block.leaks(texts))), share
    # insertions or deletions alone shift a copy most
    for k, (t, most) in enumerate(zip(block.texts, block.most, strict=True)):
        words = t.split(" ")
        for copy in ("q" * int(most) + t, t[int(most):], " ".join([words[0] + "q" * int(most), *words[1:]])):
            assert block.ids[k] in dict(block.leaks([f"{foreign} {copy} {foreign}"])[0])


def test_recall_for_each_length_and_share_of_edits():
    rng = np.random.default_rng(12)
    texts = duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 600 AND 2000 ORDER BY doc_id LIMIT 60").fetchall()
    texts = [b" ".join(decontaminate.words_of(t)).decode() for (t,) in texts]
    for n in (5, 8, 15, 50):
        items = [(k, " ".join(t.split(" ")[20 : 20 + n])) for k, t in enumerate(texts)]
        block = decontaminate.Items(items)
        for share in (0, 0.03, 0.06, 0.1):
            copies = [f"{texts[k - 1][:200]} {decontaminate.edited(t, int(share * len(t)), rng)} {texts[k - 1][:90]}" for k, t in items]
            found = block.leaks(copies)
            assert sum(k in dict(f) for (k, _), f in zip(items, found, strict=True)) >= 0.97 * len(items), (n, share)


def test_items_that_walks_do_not_find_are_held_against_every_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WALKS", 1)
    monkeypatch.setattr(decontaminate, "KEYS", 1)
    texts, rng = [" ".join(f"{k}w{j}x{k * j}" for j in range(4)) for k in range(20)], np.random.default_rng(3)
    items = decontaminate.Items(list(enumerate(texts)))
    assert [w.exact for w in items.walks] != [[]]
    copies = [f"before {decontaminate.edited(t, int(0.1 * len(t)), rng)} after" for t in texts] + ["", "nothing of it", "p" * 3_000 + texts[3]]
    want = [[(k, d) for k, t in enumerate(texts) for most in (int(0.1 * len(t)),) if (d := decontaminate.edit_distance_within(t, " ".join(w.decode() for w in decontaminate.words_of(c)), most)[0]) <= most] for c in copies]
    assert items.leaks(copies) == want and all(k in dict(f) for k, f in enumerate(want[:20]))


def test_very_long_and_repeated_texts(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog while seven wizards hum"
    long = "lorem ipsum dolor " * 60_000
    docs = spark.createDataFrame([(1, long + item), (1, long + item), (2, long), (3, item), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (1, "an other text of the same item id goes here"), (2, "x y z q w e r t y u i o p")], "item_id long, text string")
    for size in (10_000, 1):  # one block, several
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (size,))
        found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(docs, bench).collect())
        assert found == [(1, 1, 0), (1, 1, 0), (3, 1, 0)]
        assert sorted((r["doc_id"], len(r["text"])) for r in decontaminate.remove_leaks(docs, bench).collect()) == [(2, len(long)), (3, 5)]


def test_items_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"one two three four five six seven number{i} eight nine") for i in range(30)], "item_id long, text string")
    assert sorted(x for b, _ in decontaminate.blocks(bench, size=7) for x in b.ids) == list(range(30))
