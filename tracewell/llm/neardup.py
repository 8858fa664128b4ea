"""Near-duplicates by a signature-coordinate inverted join, each link confirmed on the full shingle sets.

1. Every row gets the hashes of its distinct word shingles, a 128-bit digest of that set and a MinHash signature. Rows
   with equal sets form a class; one member of each class goes on.
2. Classes are posted under (coordinate, value) for the first POSTED coordinates. A class that shares too few posted
   pairs with others can have no link and leaves here (its postings are never merged).
3. The survivors' postings under a prefix of the coordinates are kept: two signatures that agree in `t` of the posted
   coordinates agree in one of the first POSTED - t + 1. First each class meets only one leader: the class that heads
   most of its lists, which each list's most colliding class does. Leaders and members whose full sets are similar
   form stars, and lists that one component of stars fills alone are done, so a large group of copies costs one
   comparison each.
4. What is left of the lists (two or more components) is merged in full, with skips: components already joined are not
   compared again, and a list gives out a spanning forest of the pairs with enough of all coordinates equal, never all
   its pairs. A list beyond LIST_BLOCK classes goes out in pairs of blocks; where one component is most of it, only the
   others go to all blocks.
5. Where forests join components, full sets are compared in the same way: in blocks of SET_BLOCK, with skips. Links of
   leaders and of blocks give the components of the result.

The thresholds are those that a pair at the least similarity misses with a probability of at most MISS each, given
POSTED (for sharing) and COORDINATES (for matching) coordinates; `least_agreeing` computes them for any similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U64, arrow_map, components, cut, mix, short_batches, small, text_pieces, words

COORDINATES, POSTED, MISS = 128, 32, 1e-9
#: Classes in a block of a posting list, in a block of sets, and members that one copy of a leader's set is compared with.
LIST_BLOCK, SET_BLOCK, CHUNK = 2048, 256, 256
#: Ids are broadcast up to this number (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_multiplier = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_offset = mix(np.arange(1001, COORDINATES + 1001, dtype=U64))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted 64-bit hashes of its distinct shingles). With fewer words the whole sequence is one shingle; without words there is none."""
    for first, data, offsets in text_pieces(column):
        h, row = words(data, offsets)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        ends = np.cumsum(counts)
        rolled = np.zeros(max(0, len(h) - size + 1), U64)
        for k in range(size):
            rolled = rolled * U64(0x2545F4914F6CDD1D) + h[k : len(h) - size + 1 + k] if len(rolled) else rolled
        rolled = mix(rolled + U64(size))
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if n >= size:
                yield first + i, np.unique(rolled[end - n : end - size + 1])
            elif n:
                x = U64(0)
                for w in h[end - n : end]:
                    x = mix(np.array([x * U64(0x2545F4914F6CDD1D) + w], U64))[0]
                yield first + i, mix(np.array([x + U64(n)], U64))
            else:
                yield first + i, np.zeros(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES hashes over a set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, U64)
    for i in range(0, len(s), 4096):
        np.minimum(out, ((s[None, i : i + 4096] * _multiplier[:, None] + _offset[:, None]) >> U64(32)).min(1), out=out)
    return out.astype(np.uint32)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix(s), dtype=U64).view(np.int64)), int(np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64).view(np.int64))


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the set's digest), sig (the coordinates to post), fine (the low 16 bits of all coordinates, which can only agree more often)."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        with np.errstate(over="ignore"):
            for _, s in shingle_sets(batch.column(1), size):
                sig = signature(s)
                rows.append((len(s), *_digest(s), sig[:POSTED].view(np.int32), sig.astype(np.uint16).tobytes()))
        n, h1, h2, sig, fine = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32))
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * POSTED), flat)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sigs, pa.array(fine, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "sig", "fine"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>, fine binary")


def least_agreeing(percent: int, n: int, miss: float = MISS) -> int:
    """The largest t such that of n coordinates, each equal with probability percent / 100, fewer than t agree with probability at most `miss`."""
    p, below = percent / 100, 0.0
    for t in range(n + 1):
        below += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if below > miss:
            return max(1, t)
    return n


def joining(comp: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) with linked(i, [j]) that join the components of n items as far as pairs can.

    linked(i, others) tells which of the others i is linked with. Items of the largest component only are others, and
    those of i's own or of a joined component are never asked for, so at most one pair less than there are components
    comes out.
    """
    now = np.unique(comp, return_inverse=True)[1]
    pairs, left = [], np.flatnonzero(now != np.bincount(now).argmax())
    for i in left.tolist():
        others = np.flatnonzero(now != now[i])
        if not len(others):
            break
        hit = others[linked(i, others)]
        if len(hit):
            found, first = np.unique(now[hit], return_index=True)
            pairs += [(i, int(hit[f])) for f in first]
            now[np.isin(now, found)] = now[i]
    return pairs


def _grouped(dealt: DataFrame, key: list[str], fn: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) of reps that fn finds in each group of rows. Groups are bounded by their makers and come sorted, so one is held at a time."""
    dealt, k = dealt.repartition(*key).sortWithinPartitions(*key), len(key)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            pairs = fn(t.combine_chunks()) if len(t) > 1 else []
            if pairs:
                rep = t["rep"].to_numpy()
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            keys = np.column_stack([t[c].to_numpy() for c in key[:k]])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from run(t.slice(a, b - a))
            rest = t.slice(cuts[-1])
        if rest is not None:
            yield from run(rest)

    return dealt.mapInArrow(each, "a long, b long")


def _in_blocks(members: DataFrame, group: list[str], block: int) -> DataFrame:
    """members (rep, comp, ...) of groups of two or more components, with _places: the pairs of blocks (left, right) each row is dealt to.

    Every two rows of different components meet in a pair of blocks. Where a component is most of a large group, rows
    outside it (the left blocks) meet all rows (the right blocks), so a few of them cost one copy of each row; else
    all blocks meet each other.
    """
    sizes = members.groupBy(*group, "comp").agg(F.count(F.lit(1)).alias("_c"))
    of = sizes.groupBy(*group).agg(F.sum("_c").alias("_all"), F.max(F.struct("_c", "comp")).alias("_top"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    blocks = lambda c: F.ceil(c / block).cast("int")
    few = (F.col("_all") > block) & (F.col("_top._c") * 2 > F.col("_all"))
    of = of.select(*group, F.when(few, F.col("_top.comp")).alias("_largest"), blocks(F.col("_all")).alias("_rights"), blocks(F.col("_all") - F.col("_top._c")).alias("_lefts"), few.alias("_few"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    right, left = F.transform(to("_lefts"), lambda b: place(b, own("_rights"))), F.transform(to("_rights"), lambda b: place(own("_lefts"), b))
    each = F.transform(to("_rights"), lambda b: place(F.least(own("_rights"), b), F.greatest(own("_rights"), b)))
    places = F.when(~F.col("_few"), each).when(F.col("comp") == F.col("_largest"), right).otherwise(F.concat(left, right))
    return members.join(of, group).withColumn("_places", places).drop("_largest", "_rights", "_lefts", "_few")


def _in_places(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_at", F.explode("_places")).select("*", "_at.*").drop("_places", "_at")


def _fits(n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])


def _candidates(posts: DataFrame, sigs: DataFrame, stars: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) that join the components of the lists by enough equal coordinates. posts: pos, val, rep; sigs: rep, n, fine; stars: node, component."""
    least = least_agreeing(percent, COORDINATES)
    dealt = cut(_in_blocks(_with_components(posts, stars), ["pos", "val"], LIST_BLOCK))
    rows = _in_places(dealt).join(sigs, "rep")

    def fn(t: pa.Table) -> list[tuple[int, int]]:
        n = t["n"].to_numpy()
        fine = np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint16).reshape(len(n), COORDINATES)
        return joining(t["comp"].to_numpy(), lambda i, others: _fits(n, i, others, percent) & ((fine[others] == fine[i]).sum(1) >= least))

    return _grouped(rows.select("pos", "val", "left", "right", "rep", "comp", "n", "fine"), ["pos", "val", "left", "right"], fn)


def _with_components(df: DataFrame, stars: DataFrame | None) -> DataFrame:
    """comp: the component of rep, by itself where no star has it."""
    if stars is None:
        return df.withColumn("comp", F.col("rep"))
    comps = stars.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return df.join(F.broadcast(comps) if small(comps, BROADCAST_IDS) else comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _linked_sets(docs: DataFrame, near: DataFrame, stars: DataFrame | None, classes: DataFrame, percent: int, size: int) -> DataFrame | None:
    """Links (a, b) by full sets that join components which the candidate pairs `near` (a, b) bring together; None without candidates."""
    near = cut(near)
    if near.isEmpty():
        return None
    both = near if stars is None else near.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b"))
    reached = components(both)
    # Only candidate components that some pair of `near` is in; the others are stars that nothing else comes near.
    open_ = reached.join(near.select(F.col("a").alias("node")).distinct(), "node").select("component").distinct()
    members = reached.join(F.broadcast(open_) if small(open_, BROADCAST_IDS) else open_, "component").select(F.col("node").alias("rep"), F.col("component").alias("group"))
    sizes = classes.select(F.col("node").alias("rep"), F.col("rep").alias("id"), "h1", "h2", "n")
    members = cut(_in_blocks(_with_components(members, stars).join(sizes, "rep"), ["group"], SET_BLOCK))
    sets = _sets(docs, members.select(F.col("rep").alias("node"), F.col("id").alias("rep"), "h1", "h2"), size)
    rows = sets.select(F.col("node").alias("rep"), "set").join(members.select("rep", "group", "comp", "n", "_places"), "rep")

    def fn(t: pa.Table) -> list[tuple[int, int]]:
        n = t["n"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), U64) for x in t["set"]]
        place = np.unique(np.concatenate(found), return_inverse=True)[1]
        at = np.append(0, np.cumsum([len(x) for x in found]))
        mark = np.zeros(int(place.max(initial=0)) + 1, bool)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            mark[place[at[i] : at[i + 1]]] = True
            out = _fits(n, i, others, percent)
            for k in np.flatnonzero(out):
                j = others[k]
                x = int(np.count_nonzero(mark[place[at[j] : at[j + 1]]]))
                out[k] = 100 * x >= percent * (n[i] + n[j] - x)
            mark[place[at[i] : at[i + 1]]] = False
            return out

        return joining(t["comp"].to_numpy(), similar)

    return cut(_grouped(_in_places(rows), ["group", "left", "right"], fn))


def _sets(docs: DataFrame, classes: DataFrame, size: int, carried: Sequence[str] = ()) -> DataFrame:
    """node, set and the carried columns (of longs or ints): the full shingle set of each class (node, rep, h1, h2), from a row of its smallest id that has it."""
    wanted = classes.select(F.col("rep").alias("id"), "node", "h1", "h2", *[F.col(c).cast("long").alias(c) for c in carried])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # A leader stands in `wanted` once for each chunk of its members: bounded by the number of rows.
    chosen = texts.join(F.broadcast(wanted) if small(wanted, BROADCAST_IDS) else wanted, "id").select("text", "node", "h1", "h2", *carried)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep, packed = [], []
        with np.errstate(over="ignore"):
            for i, s in shingle_sets(batch.column(0), size):
                if _digest(s) == (h1[i], h2[i]):
                    keep.append(i), packed.append(s.tobytes())
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(1), pa.array(packed, pa.binary()), *[kept.column(c) for c in range(4, batch.num_columns)]], ["node", "set", *carried])

    return arrow_map(chosen, fn, "node long, set binary" + "".join(f", {c} long" for c in carried))


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame | None:
    """(a, b): those of the pairs of leaders a and members b whose full sets are similar enough; None where there is no pair.

    A set goes once to the pair that it is the b of, and once to each CHUNK of pairs that it is the a of, so a leader's
    pairs are dealt to many tasks and no task holds more than one set and the rows at hand.
    """
    pairs = cut(pairs)
    if pairs.isEmpty():
        return None
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_c"))
    dealt = cut(pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_c")).alias("part"), "b"))
    heads = dealt.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("turn")).distinct()
    roles = heads.unionByName(dealt.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("turn")))
    rows = _sets(docs, roles.join(classes, "node"), size, ["a", "part", "turn"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = None, None
        for batch in batches:
            node, a, part, turn = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            found = []
            for i in range(len(a)):
                s = np.frombuffer(batch.column(1)[i].as_buffer(), U64)
                if turn[i] == 0:
                    head, of = s.copy(), (a[i], part[i])
                elif of == (a[i], part[i]):
                    at = np.minimum(np.searchsorted(head, s), len(head) - 1)
                    x = int((head[at] == s).sum())
                    if 100 * x >= percent * (len(head) + len(s) - x):
                        found.append((a[i], node[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    key = ["a", "part"]
    return cut(rows.repartition(*key).sortWithinPartitions(*key, "turn").mapInArrow(each, "a long, b long"))


def _stars(links: DataFrame) -> DataFrame:
    """node, component: each leader and each member that leads none, under the leader. A part of the components, for what is already joined."""
    heads = links.select(F.col("a").alias("node")).distinct()
    members = links.select(F.col("b").alias("node"), F.col("a").alias("component")).join(heads, "node", "left_anti")
    return cut(members.unionByName(heads.withColumn("component", F.col("node"))))


def _classes(base: DataFrame) -> DataFrame:
    """node, rep, h1, h2, n, sig, fine of each class of equal sets; rep is its smallest doc_id and node its name.

    The name is the smallest id. Only where an id is the smallest of two classes (rows that share an id and not a
    text) the name is a hash of the digest, made negative.
    """
    reps = base.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("fine").alias("fine"), F.first("n_shingles").alias("n"))
    reps = cut(reps)
    twice = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("rep", F.lit(True).alias("_twice"))
    if twice.isEmpty():
        return reps.select(F.col("rep").alias("node"), "rep", "h1", "h2", "n", "sig", "fine")
    node = F.when(F.col("_twice"), -1 - F.shiftrightunsigned(F.xxhash64("h1", "h2"), 1)).otherwise(F.col("rep"))
    return cut(reps.join(twice, "rep", "left").select(node.alias("node"), "rep", "h1", "h2", "n", "sig", "fine"))


def _labelled(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2, component_id of every row of docs, and component: its key, null for a class without links and copies.

    Two components may share their smallest id, where rows share an id; their keys differ.
    """
    base = cut(signatures(docs, size))
    classes = _classes(base)
    shared = least_agreeing(percent, POSTED)
    keys = classes.select("node", "rep", "h1", "h2")
    posts = classes.select("node", F.posexplode("sig").alias("pos", "val"))
    lists = posts.groupBy("pos", "val").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    live = cut(posts.join(lists, ["pos", "val"]).withColumnRenamed("node", "rep"))
    alive = live.groupBy("rep").agg(F.count(F.lit(1)).alias("_c"), F.sum("m").alias("collisions")).filter(F.col("_c") >= shared).select("rep", "collisions")
    alive = cut(alive)
    prefix = live.filter(F.col("pos") <= POSTED - shared).select("pos", "val", "rep")
    posts = cut(prefix.join(F.broadcast(alive) if small(alive, BROADCAST_IDS) else alive, "rep"))

    # Leaders decide what is compared first and never the result: each class's is the head of at least a third of its
    # lists. The sums meet before the shuffle, so a long list is never in one task.
    heads = posts.groupBy("pos", "val").agg((-F.max(F.struct("collisions", (-F.col("rep")).alias("_r")))["_r"]).alias("a"))
    led = posts.join(heads, ["pos", "val"]).filter("a <> rep").groupBy("rep", "a").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= max(1, (POSTED - shared + 1) // 3))
    led = led.groupBy("rep").agg(F.max_by("a", F.struct("_c", -F.col("a"))).alias("a")).select("a", F.col("rep").alias("b"))
    links = _confirmed(docs, led, keys, percent, size)
    stars = _stars(links) if links is not None else None
    near = _candidates(posts.select("pos", "val", "rep"), classes.select(F.col("node").alias("rep"), "n", "fine"), stars, percent)
    more = _linked_sets(docs, near, stars, classes, percent, size)
    edges = [df for df in (links, more) if df is not None]
    linked = components(reduce(DataFrame.unionByName, edges)) if edges else None

    # A component is named by its smallest id; its nodes are that but for the hashed ones.
    named = keys.withColumn("component", F.col("node")) if linked is None else keys.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_c"))
    # Only classes that have copies or links need to be looked up; every other document is its own component.
    copied = base.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = named.join(least, "component").join(copied, ["h1", "h2"], "left").filter("_c > 1 or _n > 1").select("h1", "h2", "component", "component_id")
    found = cut(found)
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(F.broadcast(found) if small(found, BROADCAST_IDS) else found, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "h1", "h2", "component", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text); other columns are left out.

    Two rows are linked where 100 * |intersection| >= percent * |union| of their sets of distinct word shingles;
    component_id is the smallest doc_id of the rows that links lead to. Null and empty texts, and texts of white space,
    have no shingles and no links. Rows that share a doc_id are rows of their own: an id joins nothing, only texts do, so
    such rows may stand in different components. A null doc_id is linked with nothing, its component_id is null and it
    is kept. Long texts count whole. An empty table gives an empty result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: below, the lists prune too little")
    with short_batches(docs.sparkSession):
        out = _labelled(docs, percent, size)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """`docs` with all its columns but only one row of each component of near-duplicates: one with the smallest doc_id.

    Where several rows of a component have that id, the one with the smallest hash of its columns stays. Rows without
    a doc_id, and rows without words, all stay. No name of a column of `docs` is in the way: rows are carried whole.
    """
    with short_batches(docs.sparkSession):
        found = cut(_labelled(docs, percent, 5).filter("doc_id is not null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # Ids of more than one row, whose rows are told apart by their sets; all others are told by the id.
    twice = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("doc_id").alias("id")))
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).unionByName(twice).distinct())
    by_id = lambda ids: F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids
    if twice.isEmpty():
        return rows.join(by_id(gone), "id", "left_anti").select("row.*")

    def digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            d = [(len(s), *_digest(s)) for _, s in shingle_sets(batch.column(1), 5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[c] for x in d], pa.int64()) for c in range(3)], batch.column(2)], ["id", "n", "h1", "h2", "row"])

    long = T.LongType()
    schema = T.StructType([T.StructField(c, long) for c in ("id", "n", "h1", "h2")] + [T.StructField("row", rows.schema["row"].dataType)])
    with short_batches(docs.sparkSession):
        again = cut(arrow_map(rows.join(by_id(twice), "id", "left_semi").select("id", "text", "row"), digests, schema))
    named = found.filter("doc_id = component_id").select(F.col("doc_id").alias("id"), "h1", "h2", "component").distinct()
    held = again.filter("n > 0").join(named, ["id", "h1", "h2"])
    alone = lambda c: F.when(F.col("component").isNull(), F.col(c)).alias(f"alone_{c}")
    one = held.groupBy("component", alone("h1"), alone("h2")).agg(F.min_by("row", F.struct(F.xxhash64("row"), "h1", "h2")).alias("row")).select("row")
    # Wordless rows that share their id with others stay, as all wordless rows do.
    return rows.join(by_id(gone), "id", "left_anti").select("row").unionByName(one).unionByName(again.filter("n = 0").select("row")).select("row.*")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
common as (select g from s group by g having count(*) > 1),
c as (select s.doc_id, s.g from s join common using (g)),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from c a join c b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select p.a, p.b from pairs p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 85 * (x.n + y.n - p.i)
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b
), comp as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, comp.component_id, d.doc_id = comp.component_id as kept
from documents d join comp using (doc_id) left join n using (doc_id)
"""
