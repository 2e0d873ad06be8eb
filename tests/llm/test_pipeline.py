"""The pipeline's stages on planted cases, and its queries with SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from presswork.llm import registry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TABLES = "documents embeddings pages benchmark labels".split()


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    item = " ".join(word() for _ in range(15))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s0", 1), (101, texts[4] + " one more", "en", "s1", 1), (102, texts[5] + " " + item + " end", "en", "s2", 1), (103, "12 34 !!", "en", "s0", 1), (104, None, None, None, None), (7, texts[7], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'e' AS extra").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [0.0], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert docs.columns == [*COLUMNS, "extra", *(["slot", "shard"] if name == "sharding" else [])]
    clean = list(range(30))
    assert left["language ID"] == sorted([*clean, 7, 100, 101, 102])
    assert left["near-duplicates"] == sorted([*clean, 102])
    assert left["benchmark decontamination"] == clean
    assert set(left["mixing to target weights"]) <= set(clean) and len(left["mixing to target weights"]) > 10
    assert left["sharding"] == left["mixing to target weights"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left["sharding"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_operator_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda cols, rows: sorted(str([str(r[cols.index(c)]) for c in sorted(cols)]) for r in rows)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(names, want.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
