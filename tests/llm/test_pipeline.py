"""The pipeline's stages over a small corpus: what goes, what stays, and that pieces give the kept texts back."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.test_text_operators import WORDS


def make(tmp_path, spark):
    rng = random.Random(11)
    good = lambda n=80: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    bad = lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(80))
    line = "this very line is shared by many documents"
    rows, labels = [], []
    for i in range(240):
        text = bad() if i % 6 == 0 else good()
        if i % 10 == 1:
            text += "\n" + line
        rows.append([i, text])
        labels.append((i, int(i % 6 > 0), 0))
    item = good(25)
    rows[7][1] = good(20) + " " + item.upper() + " " + good(20)
    rows[8][1] = rows[9][1]
    near = rows[10][1].split()
    near[40] = "changed"
    rows[13][1] = " ".join(near)
    docs = [(i, t, "en", "src", len(t)) for i, t in rows] + [(500, None, "en", "src", None), (501, "", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, line


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lociweave.llm.packing import encoder

    texts, line = make(tmp_path, spark)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i % 6 == 0 for i in kept["quality_classifier"] if i < 500)
    assert all(i in kept["quality_classifier"] for i in range(240) if i % 6)
    assert sum(line in (t or "") for t in kept["line_dedup"].values()) == 1
    assert 8 in kept["minhash_dedup"] and 9 not in kept["minhash_dedup"] and 10 in kept["minhash_dedup"] and 13 not in kept["minhash_dedup"]
    assert set(kept["minhash_dedup"]) - set(kept["decontaminate"]) == {7}
    assert docs.filter("text is not null and n_chars <> length(text)").count() == 0
    by = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by[p.doc_id].append(p)
    assert set(by) == set(kept["decontaminate"])
    for i, pieces in by.items():
        ids = sum((p.ids for p in sorted(pieces, key=lambda p: p.start)), [])
        assert ids == [*encoder().encode_ordinary(kept["decontaminate"][i] or ""), 1]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    make(tmp_path, spark)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_with_clashing_columns_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    make(tmp_path, spark)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = plain.unionByName(plain.filter("doc_id in (3, 9, 500)"))
    for c in ("score", "Predicted", "n_words", "contaminated", "kept", "n_shingles", "__id", "component_id", "n_dropped", "kept_0"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    columns, schema = docs.columns, docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        for r in docs.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in columns[5:])
        ids = [r.doc_id for r in docs.collect()]
        assert ids.count(3) == 2 and ids.count(500) == 2
    assert 9 not in ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(p.doc_id == 500 for p in pieces) == 2
