"""The registered queries against their SQL, and the pipeline against its stages done one by one in Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from rulegate.llm import quality_rules, secret_scan
from rulegate.llm.queries import QUERIES, SQL
from tests.oracle import difference


def test_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    if name == "op8_neighbours":
        assert found.groupBy("query_id").count().where("count <> 20").count() == 0
        return
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found.select("doc_id").distinct().count() == docs.count()
    assert found.where("doc_id IS NULL").count() == 0


def plain_groups(texts):
    """Groups of texts that chains of five-word Jaccard similarities of 0.8 or more connect."""
    sets = {}
    for text in texts:
        words = (text or "").encode().lower().split()
        sets[frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()] = None
    sets = list(sets)
    label, holders = list(range(len(sets))), {}
    for i, own in enumerate(sets):
        for j in {j for s in own for j in holders.get(s, ())}:
            if 5 * len(own & sets[j]) >= 4 * len(own | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
        for s in own:
            holders.setdefault(s, []).append(i)
    return set(label)


def test_stages(spark, sf_dir, odd_docs):
    """Every stage keeps what it should of its own input, odd rows among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.where("doc_id > 11").unionByName(odd)
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert calm.columns == docs.columns and calm.count() < docs.count()
    assert calm.join(labels.where("toxic = 0"), "doc_id", "left_semi").count() == docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    good = stages["quality rules"](spark, calm, sf_dir).cache()
    kept = quality_rules.judge(quality_rules.ledger(quality_rules.measure(calm))).where("kept").count()
    assert good.columns == docs.columns and good.count() == kept
    single = stages["SimHash near-dedup"](spark, good, sf_dir).cache()
    assert single.columns == docs.columns
    assert single.count() == len(plain_groups([r["text"] for r in good.collect()]))
    masked = stages["secret scans"](spark, single, sf_dir).cache()
    assert masked.schema == single.schema and masked.count() == single.count()
    assert secret_scan.scan(masked).where(F.size("secrets") > 0).count() == 0
    packed = stages["best-fit packing"](spark, masked, sf_dir)
    assert packed.where("piece = 0").count() == masked.count()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_any_columns(spark, sf_dir, odd_docs, empty):
    """Columns that clash with an operator's, names with dots, and a table without rows."""
    odd = odd_docs.withColumn("meta.src", F.lit("m")).withColumn("predicted", F.lit(7)).withColumn("n_chars", F.length("text").cast("long"))
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars").where("doc_id > 11")
    docs = odd.limit(0) if empty else odd.unionByName(real.withColumns({"predicted": F.lit(7), "meta.src": F.lit("m")}), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.cache()
        assert docs.where("predicted <> 7 OR `meta.src` <> 'm'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").count() >= docs.count() and (docs.count() == 0) == empty


def test_nothing_learned_keeps_all(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() > 0
