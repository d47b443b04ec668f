"""Joins that cost the same share of the input at every size."""

from pyspark.sql import functions as F

from tracefold.llm import chunks


def test_chunks_are_fetched_by_sorted_merges(spark, tmp_path):
    body = "".join(f"line {k} of a text that two documents hold\n" for k in range(900))
    docs = spark.createDataFrame([(1, body), (2, "front " * 300 + body), (3, "own"), (4, None)], "doc_id long, text string")
    chunks.write_store(docs, str(tmp_path / "store"))
    media = chunks.read_media(spark, str(tmp_path / "store"))
    assert media._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 2
    got = {r.doc_id: bytes(r.payload)[: r.n_bytes].decode() for r in media.select("doc_id", "payload", "n_bytes").collect()}
    assert got == {r.doc_id: r.text or "" for r in docs.withColumn("text", F.col("text")).collect()}
