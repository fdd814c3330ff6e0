"""The corpus pipeline against brute force on a small table with planted cases."""

import importlib
import random
import re

import corpus_pipeline as pipeline


def planted(tmp_path, spark):
    rng = random.Random(11)
    item = [f"q{i}" for i in range(30)]
    texts, toxic = {}, set()
    for i in range(300):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 90))]
        if i % 5 == 0:
            own[3] = own[7] = "idiot"
            toxic.add(i)
        texts[i] = " ".join(own)
    clean = [i for i in texts if i not in toxic]
    copies, near, leaks = clean[:10], clean[20:30], clean[40:50]
    for k, i in enumerate(copies):
        texts[1000 + k] = texts[i].replace(" ", "  ")
    for k, i in enumerate(near):
        texts[1100 + k] = texts[i] + " extra"
    for i in leaks:
        texts[i] += " " + " ".join(item[5:16])
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i for i in texts if i < 1000 and i not in toxic and i not in leaks}
    return texts, left


def test_pipeline_catches_what_is_planted_and_keeps_the_rest(spark, tmp_path):
    texts, left = planted(tmp_path, spark)
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == left
    for i, r in got.items():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) and 0 <= r.taken <= 2 * r.size
    for s in {r.source for r in got.values()}:
        own = [r for r in got.values() if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 90


def test_a_long_document_loses_a_leak_and_stays(spark, tmp_path):
    planted(tmp_path, spark)
    item, own = [f"q{i}" for i in range(30)], [f"w{i}" for i in range(300)]
    # the second cut's words are only side by side when the first is gone
    texts = [" ".join(x) for x in (own[:100] + item[5:16] + own[100:], own[:150] + item[3:9] + item[12:24] + item[9:15] + own[150:], own, own[:90] + item[5:16])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in dict(pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2} and all(r.text.split() == own and r.n_chars == len(r.text) for r in got.values())


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "mixing"]


def test_stages_survive_an_empty_table(spark, tmp_path):
    planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registration():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {re.match(r"op\d+|.*", x)[0] for x in names}
    assert set(entry.oracle_sql()) <= names
