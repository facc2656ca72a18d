"""The pipeline's stages on a small table."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from imgaudit.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.materialize(stage(spark, before, SF), name)
        if name != "sharding":
            assert kept.columns == docs.columns
        old, new = {r[0] for r in before.select("doc_id").collect()}, {r[0] for r in kept.select("doc_id").collect()}
        assert new <= old
        if name == "ngram_jaccard_join":
            words = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
            sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in before.collect() if (w := words(r["text"]))}
            near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
            alike = sorted(new & set(sets))
            assert not any(near(a, b) for k, a in enumerate(alike) for b in alike[:k])
            assert all(any(near(a, b) for b in sets if b != a) for a in (old - new) & set(sets))
        if name == "source_mixing":
            assert kept.groupBy("doc_id").count().where("count > 3").count() == 0
        if name == "sharding":
            assert kept.count() == before.count() and kept.where("shard is null").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls anywhere, an empty and a very long text, repeated rows, and columns named as the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    odd = [(None, "one two three four five six", None, None, None), (900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, long_text, None, "src0", None)]
    full = docs.union(spark.createDataFrame(odd + odd[-1:], docs.schema))
    extra = ["_suspect", "_gone", "_id", "_copies", "_copy", "_row", "size", "copies", "source_size", "component_id", "set_id", "n_words"]
    full = full.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    kept, old = full, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.materialize(stage(spark, kept, SF), name)
        assert kept.columns == full.columns
        assert kept.select(*extra).distinct().collect() == [tuple(range(len(extra)))]
        assert kept.exceptAll(before).count() == 0 or name == "source_mixing"
        if name == "ngram_jaccard_join":
            assert kept.where("doc_id is null").count() == before.where("doc_id is null").count()
            assert kept.where("doc_id = 900003").count() == before.where("doc_id = 900003").count()
    assert 0 < kept.select("doc_id").distinct().count() < old
    placed = corpus_pipeline.place_in_shards(spark, kept, SF)
    assert placed.columns == [*full.columns, "slot", "shard"] and placed.count() == kept.count()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontaminate.decontaminated(full, items, pass_bytes=b) for b in (decontaminate.PASS_BYTES, 3_000))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
