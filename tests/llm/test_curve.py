"""The curve by its definition, and packing along it against the library's ids."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bandloom.llm import curve
from bandloom.llm.common import Cuts

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("axes,bits", [(1, 5), (2, 4), (3, 3), (6, 2)])
def test_curve_visits_every_cell_once_in_steps_of_one(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    key = curve.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
    assert set(steps) == {1}


def test_tail_is_powers_of_two():
    assert curve.tail(4096 * 3 + 11, 4096) == [12288, 12296, 12298, 12299]
    assert curve.tail(4096, 4096) == [4096] and curve.tail(0, 4096) == [0]


def themed(n, seed=2):
    """Texts of twelve themes that share no words."""
    rng = random.Random(seed)
    return [" ".join(f"t{i % 12}w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 120))) for i in range(n)]


def whole(rows, docs, capacity):
    """Every id of every document once, sequences gapless, none padded."""
    library = Tokenizer.from_file(WORD)
    want = {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault((i, zlib.crc32(ids.tobytes())), []).append(ids)
    sequences, parts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0
    total = sum(len(x) for same in want.values() for x in same)
    assert sum(r.length for r in rows) == total
    assert len(sequences) == total // capacity + (total % capacity).bit_count()
    return want, parts


def test_pieces_hold_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(curve, "RANGE", 50)
    monkeypatch.setattr(curve, "PENDING", 1_000)
    many = [*themed(400), "x y " * 3_000, None, "", "", "a<|endoftext|>b"]
    docs = list(enumerate(many))
    table = spark.createDataFrame([(i, t, "s", 5) for i, t in docs], "doc_id long, text string, ids string, row int")
    with Cuts(spark) as cut:
        rows = curve.pieces(table, WORD, cut, 256).collect()
    want, parts = whole(rows, docs, 256)
    for (i, _), (ids,) in want.items():
        mine = sorted(parts[i, len(ids)], key=lambda r: r.start)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
    found = curve.digests(table, WORD, 256).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in found) == sorted((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in rows)


def test_neighbours_are_alike(spark):
    """Along the curve most neighbours are of one theme, of twelve; the tables are dealt at random."""
    docs = list(enumerate(themed(600)))
    random.Random(1).shuffle(docs)
    with Cuts(spark) as cut:
        rows = curve.pieces(spark.createDataFrame(docs, "doc_id long, text string"), WORD, cut, 4096).collect()
    order = [r.doc_id % 12 for r in sorted((r for r in rows if not r.start), key=lambda r: (r.sequence_id, r.offset))]
    same = sum(a == b for a, b in itertools.pairwise(order)) / (len(order) - 1)
    assert same > 0.6, same


def test_equal_texts_lie_together(spark):
    many = ["the same text over and over"] * 150 + themed(300)
    with Cuts(spark) as cut:
        rows = curve.pieces(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), WORD, cut, 64).collect()
    order = [r.doc_id for r in sorted((r for r in rows if not r.start), key=lambda r: (r.sequence_id, r.offset))]
    places = [k for k, i in enumerate(order) if i < 150]
    assert places[-1] - places[0] == 149


def test_odd_tables(spark):
    table = spark.createDataFrame([(None, "a b"), (3, None), (3, None), (3, "a b")], "doc_id long, text string")
    rows = curve.digests(table, WORD).collect()
    assert sum(r.length for r in rows) == 8 and {(r.doc_id, r.doc_tokens) for r in rows} == {(None, 3), (3, 1), (3, 3)}
    empty = curve.digests(table.limit(0), WORD)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    one = curve.digests(table.limit(1), WORD).collect()
    assert sorted((r.sequence_id, r.offset, r.length) for r in one) == [(0, 0, 2), (1, 0, 1)]
