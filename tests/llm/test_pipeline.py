"""The pipeline on the smallest data, stage by stage, and its registration."""

import hashlib

from pyspark.sql import functions as F


def test_stages(spark, sf):
    import corpus_pipeline as P
    from tracewell.llm import bpe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns
        if i < 2:  # what stays is unchanged
            assert docs.exceptAll(before).isEmpty()
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    e = bpe.encoder(bpe.default_vocabulary())
    mixed = {r.doc_id: r.text for r in before.collect()}
    for r in docs.limit(20).collect():
        ids = e.encode(mixed[r.doc_id])
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_good_documents_stay(spark, sf):
    import corpus_pipeline as P

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = P.keep_good(spark, docs, sf).join(labels, "doc_id")
    good = labels.filter("quality = 1").count()
    assert kept.filter("quality = 1").count() >= 0.98 * good and kept.agg(F.avg("quality")).first()[0] > 0.95


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_copies_from_four_fifths_on(spark, sf):
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:72], "y", *words[73:]]))]  # 90 of 110 shingles: 0.818
    assert [r.doc_id for r in P.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()] == [1]


def test_pipeline_on_awkward_rows(spark, sf):
    """Nulls in every column, empty and repeated rows, clashing names; then no rows at all."""
    import corpus_pipeline as P

    long = "x" * 50_000
    rows = [(1, "A quiet text of some words. " * 5, "en", "a", 1), (1, "A quiet text of some words. " * 5, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "No id here, but text. " * 4, None, "b", 9), (4, long, "de", None, 5)]
    names = "size copies row source_size target key salt id _gone node rep set component_id kept was kinds score ids".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("own").alias(c) for c in names])
    for some in (docs, docs.limit(0)):
        at = some
        for i, (_, stage) in enumerate(P.STAGES):
            at = stage(spark, at, sf)
            if i < len(P.STAGES) - 1:
                assert at.columns == docs.columns and all(r[c] == "own" for r in at.collect() for c in names)
        got = at.collect()
        assert len(got) == 0 if some is not docs else {r.doc_id for r in got} <= {1, 2, 3, 4, None}


def test_run_deletes_what_it_no_longer_needs(spark, sf):
    import corpus_pipeline as P
    from tracewell.llm import shared

    before = len(shared.WRITTEN)
    out = P.run(spark, sf)
    assert len(shared.WRITTEN) - before == 1 and out.count() > 0
    shared.drop_tables(spark, keep=before)
    assert len(shared.WRITTEN) == before


def test_python_gets_short_batches(spark, sf, monkeypatch):
    """Whatever the session's length of Arrow batches, no stage's Python sees a long one, and the session keeps its own."""
    import corpus_pipeline as P

    frame = type(spark.range(1))

    def held(batches, fn):
        def checked():
            for b in batches:
                assert b.num_rows <= 1000, f"a batch of {b.num_rows} rows"
                yield b

        return fn(checked())

    monkeypatch.setattr(frame, "mapInArrow", lambda df, fn, *a, plain=frame.mapInArrow, **k: plain(df, lambda batches: held(batches, fn), *a, **k))
    long = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(long), spark.range(1200).coalesce(1).selectExpr("id doc_id", "concat('Words of text ', id, ' and some more of it, ', id * 7) text", "'en' lang", "'a' source")
    for name, stage in P.STAGES:
        if name in ("quality", "near_duplicates", "bpe"):
            assert stage(spark, docs, sf).write.format("noop").mode("overwrite").save() is None
    assert spark.conf.get(long) == before


def test_starts_of_ranges_need_no_python(spark, capsys):
    from tracewell.llm import mixing

    rows = spark.range(20).selectExpr("id source", "id + 1 source_size")
    out = mixing._summed(rows, [F.col("source")], ["source_size"])
    out.explain()
    assert "ExistingRDD" not in capsys.readouterr().out
    assert [tuple(r) for r in out.sort("source").collect()] == [(i, i + 1, i, i * (i + 1) // 2) for i in range(20)]
    assert mixing._summed(rows.limit(0), [F.col("source")], ["source_size"]).count() == 0
