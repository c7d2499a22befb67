"""The whole pipeline on a small folder with planted cases, through its own entry."""

import random

import corpus_pipeline


def test_run(spark, tmp_path):
    rng = random.Random(12)
    words = [f"term{i}" for i in range(4000)]
    text = lambda n=60: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text()) for i in range(200)]
    toxic = [(1000 + i, text(30) + " vileword " + text(10)) for i in range(80)]
    one, near, item, long = text(), text(80).split(" "), text(40), text(6000)
    exact = [(2000 + i, one if i % 2 else one.upper()) for i in range(30)]
    edited = []
    for i in range(20):
        w = list(near)
        w[4 * i % 80] = f"new{i}"
        edited.append((3000 + i, " ".join(w)))
    leaks = [(4000 + i, f"{text(20)} {item} {text(20)}") for i in range(5)]
    odd = [(5000, None), (5001, ""), (5002, long), (None, text()), (5003, "short"), (7, text())]
    rows = [(d, t, "en", "s", 0, "extra") for d, t in docs + toxic + exact + edited + leaks + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sha string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 0, 0) for d, _ in docs] + [(d, 0, 1) for d, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(pieces.doc_id.dropna().astype(int))
    assert {d for d, _ in docs} - kept == set() or len({d for d, _ in docs} - kept) <= 4  # the classifier may be wrong on a few
    assert len(kept & {d for d, _ in toxic}) <= 4
    assert kept & {d for d, _ in exact} == {2029} and len(kept & {d for d, _ in edited}) == 1
    assert not kept & {d for d, _ in leaks} and {5002, 5003} <= kept and len(kept & {5000, 5001}) == 1 and pieces.doc_id.isna().sum() == 1
    assert (pieces.doc_id == 7).sum() == 2 or 7 not in kept
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 4096 and (pieces.doc_id == 5002).sum() > 1
    for _, g in pieces[pieces.doc_id == 5002].groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.iloc[0] == 0 and ((g.start + g.length).iloc[:-1].to_numpy() == g.start.iloc[1:].to_numpy()).all() and g.length.sum() == g.doc_tokens.iloc[0]


def test_run_on_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
