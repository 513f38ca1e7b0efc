"""The prefix trie against plain Python, and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from bandloom.llm import trie
from bandloom.llm.common import Cuts

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    """Nodes by definition."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + mine[h:])
    found = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            found.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in found.items():
        below = [p for p in found if p[: len(path)] == path]
        child = lambda p: sum(q[:-1] == p for q in found if len(q) == len(p) + 1)
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == path)))
        out.append((
            min(convs), len(path), min(found[path[:-1]]) if path else None, len(convs), child(path), sum(child(p) == 0 for p in below),
            sum((len(found[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def made(n, seed, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "a b c\td", "x" * 50])))
    rng.shuffle(rows)
    return [r for r in rows if r[0] % 40 != 20 or r[1] > 1]  # some families lack a first conversation, or its first turns


def nodes(spark, rows):
    found = trie.prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert found.columns == [c.split()[0] for c in trie.SHAPE.split(", ")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_trie_equals_plain_python_in_small_pieces(spark, monkeypatch):
    for name, value in (("RANGE", 40), ("SIBLINGS", 5), ("BLOCK", 16), ("LAST", 60), ("CHUNK", 20)):
        monkeypatch.setattr(trie, name, value)
    rows = made(90, 1)
    assert nodes(spark, rows) == plain(rows)


def test_hot_conversation_and_copies(spark, monkeypatch):
    """One conversation of a third of all turns, and many equal ones: groups that cross many ranges."""
    for name, value in (("RANGE", 60), ("CHUNK", 40)):
        monkeypatch.setattr(trie, name, value)
    rows = [(5, t, "user", f"turn {t}") for t in range(300)] + [(c, 0, "user", "hello there") for c in range(1_000, 1_300)] + [r for r in made(20, 3) if r[0] != 5]
    assert nodes(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", None), (None, 0, "user", "nobody's"), (2, 3, "user", "same"), (2, 3, "user", "same"), (41, 0, "user", "far"), (4, None, None, None)]
    assert nodes(spark, rows) == plain(rows)
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "a", "b")]) == []
    assert nodes(spark, [(8, 1, "a", "b")]) == plain([(8, 1, "a", "b")])


def test_hash_ties_are_kept_apart_by_length_and_role(spark):
    rows = [(40, 0, "ab", "c"), (60, 0, "a", "bc"), (80, 0, "", "abc"), (100, 0, None, "abc")]
    assert nodes(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 97])
def test_ranks_of_a_shuffled_list(spark, monkeypatch, n):
    monkeypatch.setattr(trie, "LAST", 4)
    names = random.Random(n).sample(range(10_000), n)
    arcs = [(a, b, int(b is not None)) for a, b in zip(names, [*names[1:], None], strict=True)]
    with Cuts(spark) as cut:
        found = {r.arc: r.d for r in trie.ranked(spark.createDataFrame(arcs, "arc long, next long, w long"), n, cut).collect()}
    assert found == {a: n - 1 - k for k, a in enumerate(names)}


def test_sql_of_the_trie(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(trie.ORACLE).fetchall()
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert sorted((tuple(r) for r in trie.prefix_trie(given).collect()), key=repr) == sorted(want, key=repr)
