from pairlab.streaming.rowwise import ANSWER_SCHEMA, stream_answers


def test_stream_scores_new_files(spark, tmpdir_fresh):
    src, sink = f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/out"
    spark.createDataFrame([(1, 0, "a b"), (1, 1, None), (2, 0, "Openai timed out")], ANSWER_SCHEMA) \
        .write.parquet(src)
    q = stream_answers(spark, src, sink, name=tmpdir_fresh.strip("/").replace("/", "_"))
    q.awaitTermination(120)
    rows = {(r["src_id"], r["gen_idx"]): (r["failed"], r["n_tokens"]) for r in spark.read.parquet(sink).collect()}
    assert rows == {(1, 0): (False, 2), (1, 1): (True, 0), (2, 0): (True, 0)}
