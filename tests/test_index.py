"""The product-quantised index against exact search."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as I
from tidemark.operators import vector


def bytes_read(spark, run):
    """(result, bytes) that the tasks of ``run`` read from files. What they read on behalf of Python isn't in there."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.inputBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(v for k, v in stages().items() if k not in before)


def folder_size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_index_recall(spark, tmp_path, d):
    """Every vector is in the index, and vectors find 0.9 of their neighbours, themselves left out."""
    v = spark.read.parquet(f"/root/testdata/{d}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    index = I.Index.build(v, f"file://{tmp_path}/index", "vec_id", lists=20)
    assert spark.read.parquet(f"{index.path}/vectors").count() == v.count() == spark.read.parquet(f"{index.path}/codes").count()
    index = I.Index.at(spark, index.path)
    hit = total = 0
    for row in v.where("vec_id % 50 = 0").orderBy("vec_id").limit(10).collect():
        exact = {r.vec_id for r in vector.top_k(v, row.vector, 11, "vec_id").collect()} - {row.vec_id}
        found = index.top_k(spark, row.vector, 11, "vec_id")
        hit += len(exact & {r.vec_id for r in found.collect()})
        total += 10
    assert hit / total >= 0.9


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """100,000 vectors around 300 centres, of which each has its own spread; and queries that aren't among them."""
    folder, rng = tmp_path_factory.mktemp("large"), np.random.default_rng(11)
    centres, spread = rng.normal(size=(300, 64)), rng.uniform(0.3, 0.8, size=(300, 1))
    own = np.minimum(rng.zipf(1.3, 100_200) - 1, 299)
    rows = (centres[own] + spread[own] * rng.normal(size=(len(own), 64))).astype(np.float32)
    ids = rng.permutation(100_000)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "vector": pa.FixedSizeListArray.from_arrays(rows[:100_000].ravel(), 64).cast(pa.list_(pa.float32())), "kind": pa.array((ids % 7).astype(str))}), folder / "v.parquet", row_group_size=10_000)
    v = spark.read.parquet(f"file://{folder}/v.parquet")
    return folder, v, rows[100_000:], I.Index.build(v, f"file://{folder}/index", "vec_id")


def test_reads_little(spark, large):
    """Recall of 0.9 for queries outside the index, by a quarter of the vectors' bytes at most."""
    folder, v, queries, index = large
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query int, query_vector array<double>")
    exact = {}
    for r in vector.neighbours(v, asked, 10, "vec_id").collect():
        exact.setdefault(r["query"], set()).add(r.vec_id)
    many = {}
    for r in index.search(spark, asked, 10, "vec_id").collect():
        many.setdefault(r["query"], set()).add(r.vec_id)
    assert np.mean([len(many[i] & exact[i]) / 10 for i in exact]) >= 0.9
    whole, hits, read = folder_size(folder / "index/vectors"), [], []
    for i in range(0, 200, 20):
        found, n = bytes_read(spark, lambda i=i: {r.vec_id for r in index.top_k(spark, queries[i].tolist(), 10, "vec_id").collect()})
        hits.append(len(found & exact[i]) / 10)
        codes = sum(folder_size(folder / f"index/codes/list={x}") for x in index.near(queries[i].tolist()))
        read.append((n + codes) / whole)
    print(f"\nrecall {np.mean(hits):.3f}, of the vectors' bytes read {np.mean(read):.3f} (most {max(read):.3f}); {index.probes} of {len(index.centres)} lists, short list {index.short}")
    assert np.mean(hits) >= 0.9 and 0 < np.mean(read) and max(read) <= 0.25


def test_filters_come_before_the_short_list(spark, large):
    _, v, queries, index = large
    got = [r.vec_id for r in index.top_k(spark, queries[3].tolist(), 10, "vec_id", F.col("kind") == "3").collect()]
    want = {r.vec_id for r in vector.top_k(v, queries[3].tolist(), 10, "vec_id", F.col("kind") == "3").collect()}
    assert len(got) == 10 and all(i % 7 == 3 for i in got) and len(want & set(got)) >= 8


def test_appends_need_no_rebuild(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", rng.normal(size=10).tolist(), f"text {i}") for i in range(600)] + [("none", None, "x"), ("zero", [0.0] * 10, "y")]
    v = spark.createDataFrame(rows, "chunk_hash string, vector array<float>, content string")
    index = I.Index.build(v.where("chunk_hash < 'k4'"), f"file://{tmp_path}/i", lists=4)
    books = index.coder.books.copy()
    I.Index.at(spark, index.path).append(v.where("chunk_hash >= 'k4'"))
    index = I.Index.at(spark, index.path)
    assert (index.coder.books == books).all() and spark.read.parquet(f"{index.path}/vectors").count() == 601
    index.probes, index.short = 4, 600
    for key in ("k5", "k123", "k499"):
        query = rows[int(key[1:])][1]
        assert [(r.chunk_hash, round(r.score, 9)) for r in index.top_k(spark, query, 5).collect()] == [(r.chunk_hash, round(r.score, 9)) for r in vector.top_k(v.where("vector IS NOT NULL").drop("content"), query, 5).collect()]
    with pytest.raises(ValueError):
        I.Index.build(v.where("false"), f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        index.search(spark, v.select(F.col("chunk_hash").alias("query"), F.col("vector").alias("query_vector")), most=10)
