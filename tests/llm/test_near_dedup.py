import random
import re

import pytest

from bandloom.llm import components, minhash


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True)}


def mutate(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows, k = [], 0

    def add(t):
        nonlocal k
        rows.append(((k * 7919) % 10007, t))
        k += 1

    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        add(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            add(" \n".join(mutate(base, rng.randint(0, max(1, len(base) // 20)), rng)))
    chain = [rng.choice(vocab) for _ in range(120)]
    for _ in range(12):  # each is like its predecessor only
        chain = mutate(chain, 2, rng)
        add(" ".join(chain).upper())
    for t in ("", None, "  \t ", "one", "ONE", "one two three four", "one two three four five", "one two three four", "É é", "é é", "a\x0bb\x0cc d e f"):
        add(t)
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TOGETHER", 2)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z", -1) for i, t in rows], "doc_id long, text string, node string, component_id int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("words", [73, 74])
def test_hot_group_about_the_threshold(spark, words):
    """2,000 copies of one text, each with another word at one of 13 places far apart: copies of one
    place are alike, those of two places have 0.7468 in common with 73 words, 0.75 with 74."""
    base = [f"b{i}" for i in range(words)]
    rows, place = [], {}
    for i in range(2_000):
        at = 5 + 5 * (i * 7 % 13)
        rows.append((i, " ".join([*base[:at], f"n{i}", *base[at + 1 :]])))
        place[i] = at
    first = {}
    for i, at in place.items():
        first.setdefault(at if words == 73 else 0, i)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: first[at if words == 73 else 0] for i, at in place.items()}


def test_block_links_span_what_is_alike():
    rng = random.Random(2)
    import numpy as np

    items = [np.array(sorted(rng.sample(range(14), rng.randint(8, 12)))) for _ in range(40)]
    of = np.array([i // 3 for i in range(40)])
    alike = lambda a, b: 4 * len(set(items[a]) & set(items[b])) >= 3 * len(set(items[a]) | set(items[b]))

    def groups(links):
        root = list(range(40))
        for a, b in links:
            root = [root[b] if r == root[a] else r for r in root]
        return [[r == s for s in root] for r in root]

    inside = [(a, b) for a in range(40) for b in range(a) if of[a] == of[b]]
    for x, y in [(range(40), range(40)), (range(25), range(25, 40))]:
        found = minhash.block_links(of, items, np.array(x), np.array(y))
        assert all(alike(a, b) and of[a] != of[b] for a, b in found)
        assert groups(inside + found) == groups(inside + [(a, b) for a in x for b in y if alike(a, b)])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (9, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()))
    assert found == [(-1, None, False), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_id_on_two_texts(spark):
    alone, copied = "p q r s t u v", "a b c d e f g"
    docs = spark.createDataFrame([(7, alone), (7, copied), (3, copied), (8, "m n o p q r")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert found == [(3, 3, 3, True), (7, 3, 3, False), (7, 3, 7, True), (8, 2, 8, True)]


def test_removal_keeps_one_of_each_group(spark):
    alone, copied, near = "p q r s t u v", " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99))
    rows = [(7, alone, 1, "x"), (7, copied, 2, "x"), (3, near, 3, "x"), (None, copied, 4, None), (None, "n u l l i d", 5, "x"), (None, "n u l l i d", 6, "x"), (9, None, 7, "x"), (9, "", 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, component_id string")
    stay = minhash.remove_near_duplicates(docs)
    assert stay.columns == docs.columns
    left = {r["row_key"] for r in stay.collect()}
    assert left - {5, 6} == {1, 3, 7, 8} and len(left & {5, 6}) == 1
    assert minhash.remove_near_duplicates(docs.limit(0)).collect() == []


def test_very_long_text_and_its_near_copy(spark):
    words = [f"w{i % 5003}x{i % 17}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30_000], "other", *words[30_000:]])), (3, "w " * 50_000)]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_components_of_a_path_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 3), (3, 5), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {3: 3, 5: 3, 9: 3}


@pytest.mark.parametrize("block", [4, 1_000])
def test_buckets_of_one_wide_component_and_others(spark, monkeypatch, block):
    """All texts in one bucket: one wide component, a few narrow ones, and links between them that no centre found."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for group in range(30):
        words = list(base)
        for k in rng.sample(range(40), 3 if group < 22 else 7):
            words[k] = f"g{group}x{k}"
        texts.append(" ".join(words))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(36)} for t in texts]
    of = {i: i for i in range(30)}
    find = lambda v: v if of[v] == v else find(of[v])
    for i in range(30):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                of[find(i)] = find(j)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {}
    for i in range(30):
        parts.setdefault(find(i), []).append(i)
    want = {i: min(p) for p in parts.values() for i in p}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_one_id_on_many_near_copies(spark):
    """Each text meets its own node alone, so the sets that are made are as many as the texts."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(7, " ".join([*words, f"end{k}"])) for k in range(200)] + [(3, "p q r s t u")], "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3)] + [(7, 7)] * 200
