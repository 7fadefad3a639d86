from papercairn.plans.queries import _probe_queries


def test_probes_chosen_before_texts_are_shuffled(spark, tmp_path):
    """Chunks that are no probe are left out before those delivered twice are put together."""
    chunks = [("a", "x y", None, None), ("a", "x y", None, None), ("b", "z", "h", "Ｅmbed"), ("c", "w", None, None)]
    spark.createDataFrame(chunks, "chunk_id string, text string, context_header string, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 3)], "chunk_id string, vector array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "chunk_id string").write.parquet(f"{tmp_path}/vector_probes.parquet")
    got = _probe_queries(spark, str(tmp_path))
    assert sorted((r["qid"], r["query"], r["vector"] and len(r["vector"])) for r in got.collect()) == [("a", "x y", 64), ("b", "Embed", None)]
    plan = got.select("qid", "query")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate [chunk_id") < plan.index("LeftSemi")
