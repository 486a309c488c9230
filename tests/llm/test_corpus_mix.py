from loomline.llm import queries as Q


def test_scarce_source_stops_at_its_repeats(spark, tmp_path):
    docs = [(i, "one two three four", "many") for i in range(200)] + [(1000 + i, "one two three four", "few") for i in range(2)] + [(2000, "", "few"), (2001, None, "many"), (2002, "x", None), (2003, "x", "other")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("many", 0.5, 1), ("few", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    mix = {r.doc_id: r.repeats for r in Q.QUERIES["p9_corpus_mix"](spark, str(tmp_path)).collect()}
    assert mix[1000] == mix[1001] == 3 and set(mix.values()) == {1, 3}
    assert 190 <= sum(k < 1000 for k in mix) <= 200
    share = {r.source: r for r in Q.QUERIES["p9_corpus_shares"](spark, str(tmp_path)).collect()}
    assert 0.02 < share["few"].actual_share < 0.04 and share["none"].tokens == 0 and share["many"].actual_share > 0.96
    assert len(Q.QUERIES["p9_mix"](spark, str(tmp_path)).collect()) < 20  # at exact shares the scarce source sets the size
