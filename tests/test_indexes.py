"""Indexes give what scans give, and read a share of the files."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import retrieval as R
from tracewell.operators.indexes import TextIndex, VectorIndex


def rows(df):
    return [tuple(r) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def texts(spark):
    rnd, words = random.Random(5), [f"w{i}" for i in range(60)]
    made = [(i, " ".join(rnd.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rnd.choice([1, 3, 20, 400])))) for i in range(1200)]
    made += [(2000, None), (2001, ""), (2002, "...!"), (2003, "Rare w0 W1, w0"), (2004, "rare"), (2005, "Größe w0 w1 日本"), (2006, "w0 w1 " * 30_000)]
    made += [(3000 + i, "w0 w1 copy") for i in range(300)]
    return spark.createDataFrame(made, "chunk_id long, text string").withColumn("rank", F.lit("clashes")).repartition(4).cache()


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return TextIndex.build(texts, str(tmp_path_factory.mktemp("index")), block=16, folders=16)


@pytest.mark.parametrize("query", ["w0", "w0 w1", "W3, w0 w3", "rare", "rare w1", "größe", "copy w1", "w59 w58 w57", "none", "w0 none", "", "..."])
def test_text_search(texts, index, query):
    assert rows(index.search(query, 7)) == rows(R.bm25(texts, query, 7))
    assert rows(index.search(query)) == rows(R.bm25(texts, query))


def test_text_bounds(spark, texts, index):
    scored = texts.filter("chunk_id % 2 = 0").select("chunk_id")
    got = index.search("w0 w1", 7, allowed=scored)
    want = R.ranked(R.bm25(texts, "w0 w1").filter("chunk_id % 2 = 0").drop("rank"), 7)
    assert rows(got) == rows(want)
    df = index._weights(["copy", "w1"])
    every, kept = index.bounds(["w0", "w5"], index._weights(["w0", "w5"])), index.kept_blocks(["w0", "w5"], index._weights(["w0", "w5"]), 7)
    assert df["copy"] == 300 and 0 < kept.count() < every.count()
    # A block's bound is no less than the scores in it, and a word's postings lie in one folder.
    whole = index.parts("postings", "folder", index.facts["folders"])
    assert len(index._of("postings", ["rare"]).inputFiles()) * 4 <= len(whole.inputFiles())
    assert whole.groupBy("term", "block").count().filter("count > 1").isEmpty()
    assert whole.filter("n <> size(held)").isEmpty()


def test_text_build_deals_out_texts_alone(spark, texts, tmp_path):
    """What a build shuffles grows with the texts, not with their postings, which are several for each text."""
    sc = spark.sparkContext
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    built = TextIndex.build(texts, str(tmp_path / "index"), block=16, folders=16)
    postings = built.parts("postings", "folder", built.facts["folders"]).agg(F.sum("n")).first()[0]
    shuffled = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert postings > 10_000 and shuffled < 3 * texts.count()


def test_text_rebuild_and_empty(spark, texts, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        TextIndex(spark, root)
    none = TextIndex.build(texts.filter("chunk_id in (2000, 2001, 2002)"), root)
    assert none.search("w0", 3).columns == ["chunk_id", "score", "rank"] and none.search("w0", 3).isEmpty() and none.terms().isEmpty()
    TextIndex.build(texts.limit(0), root)
    some = TextIndex.build(texts.unionByName(texts.limit(1).withColumn("chunk_id", F.lit(None).cast("long"))), root)
    TextIndex.build(texts.filter("chunk_id >= 3000"), root)
    # A search keeps its build; a new one finds the newest.
    assert rows(some.search("rare", 3)) == rows(R.bm25(texts, "rare", 3)) and TextIndex(spark, root).search("rare", 3).isEmpty()


def test_vector_search(spark, tmp_path):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    made = [(i, [x + rnd.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(1500)]
    made += [(5000 + i, made[7][1]) for i in range(40)]
    bad = [(9000, None), (9001, []), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0] * 7), (9005, [float("inf")] + [1.0] * 7), (9006, [1.0, None] * 4)]
    v = spark.createDataFrame(made, "chunk_id long, embedding array<float>")
    index = VectorIndex.build(v.unionByName(spark.createDataFrame(bad, v.schema)), str(tmp_path / "v"), 8, cells=24)
    for probe, k in [(made[7][1], 5), (made[7][1], 60), (made[11][1], 300), ([-x for x in centres[0]], 9), ([rnd.gauss(0, 1) for _ in range(8)], 2000)]:
        assert rows(index.search(probe, k)) == rows(R.vector_search(v, probe, k))
    assert sum(c["n"] for c in index.facts["cells"]) == 1540
    kept = index.kept_cells(made[7][1], 5)
    assert 0 < len(kept) < len(index.facts["cells"]) / 2
    for probe in ([0.0] * 8, [1.0] * 7, [float("nan")] * 8):
        assert index.search(probe, 5).isEmpty()
    assert VectorIndex.build(v.limit(0), str(tmp_path / "none"), 8).search([1.0] * 8, 3).isEmpty()


def test_histogram_and_source_counts(spark):
    from tracewell.operators.telemetry import histogram
    from tracewell.sources.store import source_counts

    v = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.5), ("b", 9.0), ("b", float("nan")), ("b", None)], "k string, value double")
    assert {tuple(r) for r in histogram(v, "value", [1, 2], "k").collect()} == {("a", 0, 2), ("a", 1, 1), ("b", 2, 2)}
    with pytest.raises(ValueError):
        histogram(v, "value", [2, 1])
    r = spark.createDataFrame([("r1", "bank"), ("r2", "bank"), ("r3", None)], "record_id string, source_system string")
    c = spark.createDataFrame([("r1",), ("r1",), ("r3",), ("gone",)], "record_id string")
    assert {tuple(x) for x in source_counts(r, c).collect()} == {("bank", 2, 2), (None, 1, 2)}
    assert source_counts(r.limit(0), c.limit(0)).count() == 0


def test_stream_outcomes_equal_batch(spark, tmp_path):
    from tracewell.operators.rules import reconciliation
    from tracewell.streaming.events import stream_outcomes

    rnd = random.Random(9)
    made = [(rnd.choice("mc"), f"x{i}", rnd.choice("ab"), rnd.choice("ab"), rnd.choice(["i", "j", None]), rnd.choice(["s", None]), rnd.randrange(0, 20_000)) for i in range(300)]
    schema = "kind string, id string, sender string, receiver string, imei string, subscriber string, s long"
    rows = spark.createDataFrame(made, schema).withColumn("ts", F.timestamp_seconds("s"))
    last = spark.createDataFrame([(k, "last", "z", "z", None, None, 900_000) for k in "mc"], schema).withColumn("ts", F.timestamp_seconds("s"))
    rows.unionByName(last).coalesce(1).write.parquet(str(tmp_path / "in"))
    side = lambda df, kind, name: df.filter(F.col("kind") == kind).select(F.col("id").alias(name), "sender", "receiver", "imei", "subscriber", "ts")
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream_outcomes(side(read(), "m", "msg_id"), side(read(), "c", "cdr_id"), 90)
    out.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.msg_id, r.candidates, r.outcome) for r in spark.table("outcomes").collect())
    want = sorted((r.msg_id, r.candidates, r.outcome) for r in reconciliation(side(rows, "m", "msg_id"), side(rows, "c", "cdr_id"), 90).collect())
    assert got == want and {o for _, _, o in got} == {"unmatched", "same_event", "abstain"}
