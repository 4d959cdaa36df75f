import numpy as np

from test_joins import closure, repeats, shingles


def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from loomlake.llm.common import stage_table
    from loomlake.llm.toxicity import Scorer, train

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    scorer = Scorer(train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    clean = stage_table(cp.toxicity(spark, docs, folder), "t")
    one = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(one) == {i for i, r in before.items() if scorer.score(r["text"])[0] < 0.5}
    single = stage_table(cp.ngram_jaccard(spark, clean, folder), "j")
    ids = sorted(one)
    sets = [shingles(one[i]["text"]) for i in ids]
    root = closure(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    two = {r["doc_id"]: r for r in single.collect()}
    assert set(two) == {i for k, i in enumerate(ids) if root[k] == k} and all(two[i] == one[i] for i in two)
    bare = stage_table(cp.suffix_dedup(spark, single, folder), "s")
    three = {r["doc_id"]: r for r in bare.collect()}
    assert bare.columns == docs.columns and set(three) == set(two)
    removed = {i: g for i, _, g, _, _ in repeats([(i, two[i]["text"]) for i in two])}
    for i, r in three.items():
        lost = len(two[i]["text"].encode()) - len(r["text"].encode())
        assert r["n_chars"] == len(r["text"]) and (lost == removed[i] or 0 <= removed[i] - lost <= 6 * 20)
    packed = cp.run(spark, folder).toPandas()
    assert set(packed.doc_id) == set(three) and (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert np.issubdtype(packed.ids_crc32.dtype, np.integer)


def test_empty_table_and_odd_rows(spark, tmp_path):
    """No documents at all; then nulls, empty and repeated rows, with columns whose names the stages might use."""
    import corpus_pipeline as cp

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "a")).count() == 0
    rows = [(1, None, None, None, None), (2, "", "x", "y", 0), (3, "a b c d e f g", "x", "y", 13), (3, "a b c d e f g", "x", "y", 13), (4, "A b c d e f g", None, "y", 13), (None, "q", "x", "y", 1)]
    spark.createDataFrame([(*r, 1, "s") for r in rows], f"{kinds}, block int, cls string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    got = cp.run(spark, str(tmp_path / "b"))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 2), (False, 3), (True, 0)]
