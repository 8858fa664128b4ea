"""The store's commit log under concurrent writers, and walks of any length."""

import random
import threading

from pyspark.sql import functions as F

from tracewell.operators import rules as T
from tracewell.sources import store


def test_put_if_absent(spark, tmp_path):
    path, won = str(tmp_path / "x" / "1.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append((store.put_if_absent(spark, path, str(i).encode()), i))) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    winner = [i for ok, i in won if ok]
    assert len(won) == 8 and len(winner) == 1 and store.read_file(spark, path) == str(winner[0]).encode()


def test_concurrent_upserts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    make = lambda lo, hi, mark: spark.range(lo, hi).select(F.col("id").cast("string").alias("record_id"), F.lit(mark).alias("content_hash"))
    failed = []

    def go(i):
        try:
            s.upsert("records", make(5 * i, 5 * i + 5, "a"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and s.versions("records") == [1, 2, 3, 4] and s.read("records").count() == 20
    held = s.read("records")
    assert s.compact("records") == 5 and s.compact("records") is None
    s.upsert("records", make(0, 3, "b"))
    # Readers keep their snapshot; a later one sees what came after the compaction.
    assert held.filter("content_hash = 'b'").isEmpty() and s.read("records", 4).count() == 20 and s.read("records", 2).count() == 10
    assert s.read("records").filter("content_hash = 'b'").count() == 3 and s.read("records").count() == 20
    assert s.vacuum("records") == 0 and held.count() == 20
    assert s.vacuum("records", older_than_s=0) == 4 and s.read("records").count() == 20 and s.versions("records") == [6]
    s.upsert("records", make(20, 21, "c"))
    assert s.versions("records") == [6, 7] and s.read("records").count() == 21


def test_compaction_beside_upserts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    row = lambda i: spark.createDataFrame([(str(i), "x")], "record_id string, content_hash string")
    s.upsert("records", row(0)), s.upsert("records", row(1))
    _, old = s.batches("records")
    slow, fast = store.Store(spark, s.root), store.Store(spark, s.root)
    read = slow.batches
    slow.batches = lambda name, version=None: read(name, version)
    write = slow._commit

    def late(name, change):
        fast.upsert("records", row(2))
        return write(name, change)

    slow._commit = late
    assert slow.compact("records") == 4 and len(s.batches("records")[1]) == 2 and s.read("records").count() == 3
    slow._commit = lambda name, change: (fast.compact("records"), write(name, change))[1]
    assert slow.compact("records") is None and s.read("records").count() == 3 and old[0] not in s.batches("records")[1]


def plain(nodes, edges, root):
    """Reachability and unending walks by repeated search."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    seen, todo = {root}, [root]
    while todo:
        for b in ahead.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b), todo.append(b)
    left = set(edges)
    while True:
        parents, children = {a for a, _ in left}, {b for _, b in left}
        now = {(a, b) for a, b in left if b in parents and a in children}
        if now == left:
            break
        left = now
    return sorted({("cycle", a) for a, _ in left} | {("unreachable", n) for n in nodes - seen})


def check(spark, edges, root="0"):
    nodes = {x for e in edges for x in e} | {root}
    got = T.dag_problems(spark.createDataFrame([(n, "source_ref") for n in sorted(nodes)], "node_id string, kind string"), spark.createDataFrame(sorted(edges), "parent string, child string"), root)
    assert sorted(map(tuple, got.collect())) == plain(nodes, edges, root)


def test_deep_chain_with_a_cycle(spark):
    chain = {(str(i), str(i + 1)) for i in range(1000)}
    check(spark, chain | {("y", "z")} | {("500", "c0"), *((f"c{i}", f"c{(i + 1) % 150}") for i in range(150)), ("c70", "d"), ("d", "e"), ("e", "f"), ("f", "e")})


def test_ladder_and_random_graphs(spark):
    check(spark, {(f"{i}" if j == 0 else f"{i}b", f"{i + 1}" if k == 0 else f"{i + 1}b") for i in range(60) for j in (0, 1) for k in (0, 1)})
    r = random.Random(3)
    check(spark, {(str(r.randrange(60)), str(r.randrange(60))) for _ in range(70)})


def test_hub_keeps_pairs_bounded(spark):
    n = 150
    edges = {("0", "a0")} | {(f"a{i}", f"a{i + 1}") for i in range(20)} | {(f"i{i}", "hub") for i in range(n)} | {("hub", f"o{i}") for i in range(n)} | {("a20", "i3")}
    check(spark, edges)
