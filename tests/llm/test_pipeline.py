from brute import similar, substring_dedup, words
from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    junk = spark.createDataFrame([(9001, "Привет мир, как дела сегодня? " * 30, None, "src0", 900)], docs.schema)
    rows = docs.unionByName(junk)
    stage = dict(P.STAGES)
    assert list(stage) == ["language_id", "near_duplicates", "substring_dedup", "mixture", "sentencepiece"]

    def kept(name, df):
        stage[name](spark, df, sf).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    a = kept("language_id", rows)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()}
    b = kept("near_duplicates", a)
    want = {d for d, _, _, c in similar([(r.doc_id, r.text) for r in a.collect()]) if d == c}
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == want
    c = kept("substring_dedup", b)
    whole = substring_dedup([(r.doc_id, r.text) for r in b.collect()])
    assert sorted((r.doc_id, r.s) for r in c.select("doc_id", F.sha2("text", 256).alias("s")).collect()) == sorted((i, s) for i, n, gone, s in whole if not n or gone < n)
    d = kept("mixture", c)
    assert d.columns == docs.columns
    n = sum(len(words(r.text)) for r in d.collect())
    assert abs(n - 1.5 * sum(len(words(r.text)) for r in c.collect())) < 50
    e = kept("sentencepiece", d)
    assert e.count() == d.count() and e.where("round_trip").count() == d.count()


def test_run(spark, sf):
    assert P.run(spark, sf).where("n_tokens > 0").count() > 0
