import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bandloom.llm import encoders, packing, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "Bc", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " ", "　", "'s", "'LL", "é", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "7", "!!", "Σ", "\U0001f600", "\x1c", " word", " longerword"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_cached_encoders_equal_the_libraries():
    counter, words = encoders.byte_level_counter(BYTE), encoders.word_level_ids(WORD)
    b, w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for t in texts(3000):
        ids = b.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(ids), repr(t)
        assert counter.bounds(t)[1][-1] == len(ids)
        assert np.frombuffer(words.ids(t), "<u4").tolist() == w.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_go_to_the_model_at_once():
    words, library = encoders.WordLevelIds(WORD), Tokenizer.from_file(WORD)
    assert words.cache._direct
    rng = random.Random(11)
    for _ in range(20_000):
        w = "".join(rng.choice("aeiostnrthéèüößçøÿ" + encoders._LETTERS) for _ in range(rng.randint(1, 18)))
        assert np.frombuffer(words.ids(w), "<u4").tolist() == library.encode(w, add_special_tokens=False).ids, w
    assert not encoders._Ids(Tokenizer.from_file(BYTE))._direct or encoders._Ids(Tokenizer.from_file(BYTE))[b"word"] == np.array(Tokenizer.from_file(BYTE).encode("word").ids, "<u4").tobytes()


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (200, 30)])
def test_spliced_counts_equal_whole_ones(spark, chunk, overlap):
    rng = random.Random(4)
    many = ["".join(texts(rng.randint(20, 80), seed)) for seed in range(30)] + [" " * 500, "a" * 700, "\n" * 300, "ab<|endoftext|>" * 40, None, "", "short"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(many)], "doc_id long, text string, row int")
    library = Tokenizer.from_file(BYTE)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(many))
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs, BYTE, chunk=chunk, overlap=overlap).collect()) == want


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(docs, BYTE).collect()) == [(-1, 2), (3, 0), (3, 0)]
    assert token_counts.count_tokens(docs.limit(0), BYTE).collect() == []


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(8)
    many = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(int(rng.lognormvariate(4, 1.3)))) for _ in range(600)] + ["x " * 9000, None, "", "same", "same"]
    docs = spark.createDataFrame([(i // 2 if i > 600 else i, t, 0) for i, t in enumerate(many)] + [(None, "n", 0)], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, WORD, group=100).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in [(i // 2 if i > 600 else i, t) for i, t in enumerate(many)] + [(None, "n")]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, k // 4096, k, len(p := ids[k : k + 4096]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.03 * sum(w[3] for w in want) / 4096 + 1
    assert packing.pack_documents(docs.limit(0), WORD).collect() == []


def test_sum_of_squares_by_hand():
    bins, offsets, fill = packing.sum_of_squares(np.array([6, 5, 4, 5, 10]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 0, 6, 5, 0] and fill == [10, 10, 10]
