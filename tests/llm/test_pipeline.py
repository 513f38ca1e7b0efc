import corpus_pipeline
from bandloom.llm import decontaminate, minhash, personal_data, toxicity
from bandloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "toxicity":
            want = toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0")
        elif name == "near_dedup":
            want = minhash.near_duplicates(docs).filter("kept")
        elif name == "decontamination":
            want = docs.join(decontaminate.leaks(docs, bench), "doc_id", "left_anti")
        else:
            want = docs
            assert all(r["spans"] == "" for r in personal_data.find(out).collect())
        assert ids(out) == ids(want), name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    rows = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == set(ids(docs))


def test_repeated_rows_leave_one(spark):
    copies = [(i, "a b c d e f g", "en") for i in (1, 1, 2, None)]
    docs = spark.createDataFrame([*copies, (3, None, "en"), (1, "h i j k l m n", "en")], "doc_id long, text string, lang string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in out.fillna("").collect()) == [(1, "a b c d e f g"), (1, "h i j k l m n"), (3, "")]


def test_stages_take_odd_rows(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key string"
    rows = [(None, "write to a@b.com please", "en", None, 23, "a"), (5, "plain words here", None, "s", 16, "b"), (5, "other words there", "en", "s", 17, "c"), (6, "", "en", "s", 0, "d"), (7, None, None, None, None, "e")]
    docs = spark.createDataFrame(rows, shape)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r["row_key"] for r in out.collect()} == set("abcde"), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert sorted(r["doc_id"] or -1 for r in pieces) == [-1, 5, 5, 6, 7]
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF).collect() == []
