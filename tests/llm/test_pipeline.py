from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm.simhash_dedup import fingerprint


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("fp", F.lit("own")).withColumn("spans", F.lit(1))
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if name == "simhash_dedup":
            prints = [fingerprint(r.text or "") for r in docs.collect()]
            assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 2
        if name == "pii":
            assert docs.where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[0] > 150 and counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def test_registered():
    import __spark_entry__

    names = [f"op{i}_" for i in range(1, 11)]
    queries = __spark_entry__.queries()
    assert all(sum(q.startswith(n) for q in queries) == 1 for n in names) and "pipeline" in queries
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def write_tables(spark, folder, docs, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens int, score string, fp int, mix_weight double, mix_key_0 int, input_0 int, KEY_1 int"
    spark.createDataFrame([(*d, 1, "x", 2, 0.5, 3, 4, 5) for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_takes_nulls_repeats_and_long_texts(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(400))
    docs = [(i, f"{words} mail me at a@example.org", "en", "s", 10) for i in range(40)]
    docs += [(100 + i, " ".join(f"own{i}x{j}" for j in range(60)), ["en", None][i % 2], [None, "t"][i % 2], None) for i in range(40)]
    docs += [(100, " ".join(f"own0x{j}" for j in range(60)), "en", None, None), (None, "some words that stand alone here", None, None, None)]
    docs += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "long " + "text of many words " * 40000, "en", "s", 1)]
    write_tables(spark, tmp_path, docs, [(i, 1, 0) for i in range(20)] + [(None, None, None)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and len({r.doc_id for r in out if r.doc_id is not None}) == sum(r.doc_id is not None for r in out)
    # Copies leave one, and so do repeated rows.
    assert sum(r.doc_id is not None and r.doc_id < 40 for r in out) <= 1
    assert all("@example.org" not in r.decoded for r in out) and all(len(r.ids) == r.n_tokens for r in out)


def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_what_stages_after_them_need(spark, tmp_path):
    write_tables(spark, tmp_path, [(1, "a few words", "en", "s", 11), (1, "a few words", "en", "s", 11), (2, None, None, None, None)], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert found.count() <= docs.count()
