"""Collocations: exact counts of candidate phrases in arrays indexed by a minimal perfect hash.

1. A sketch of 2^bits places is filled with the counts of words and pairs, a second one with those of longer phrases
   whose parts pass: a place that holds fewer than min_count occurrences can hold no frequent phrase. Only bits come back.
2. A phrase whose every part passes is a candidate (no frequent phrase is lost, as its parts are at least as frequent).
3. The different candidates, by their keys, get a minimal perfect hash, built in shards on the executors, with each
   slot's second key stored, so that no other phrase is ever taken for a candidate.
4. Each task counts slots with bincount; the arrays are summed as a tree, a chunk of slots at a time.
5. A candidate's count and those of both sides of its cuts are read at their slots.

Where candidates are more than a round's bound, 4 and 5 go round by round over shards, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LOWER, U64, WRITTEN, arrow_map, cut, drop_tables, mix, short_batches, strong_hashes, table, text_pieces

#: What stands between words (1), and what ends a piece (2).
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
#: The first so many of eight bytes, and beyond how many bytes a word is long.
FIRST_BYTES, LONG = np.array([(1 << 8 * n) - 1 for n in range(9)], U64), 64

#: Bits of a sketch's places, and what a round broadcasts at most (about nine bytes a key).
SKETCH_BITS, ROUND_KEYS = 27, 1 << 23
#: Partitions of the input that one task works through, where all cores still have two tasks.
TASK_PARTS = 4
#: Places or slots in a row that tasks send, bits of a shard of candidates, rows added at once, phrases or slots a task gathers first,
#: places of a sketch that it gathers, and keys that it remembers to have sent.
CHUNK, SLOTS, SHARD_BITS, FAN, GATHERED, PLACES, SENT = 1 << 18, 1 << 13, 9, 64, 1 << 18, 1 << 20, 1 << 21


def word_hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time (long words byte by byte); `low` has eight bytes more than the text."""
    step = mix(np.array([seed + 1], U64))[0] | U64(1)
    out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + step)
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    for at in range(0, LONG, 8):
        these = np.flatnonzero((size > at) & (size <= LONG)) if at else np.flatnonzero(size <= LONG)
        if not len(these):
            break
        out[these] = mix(out[these] * step + (eight[start[these] + at] & FIRST_BYTES[np.minimum(size[these] - at, 8)]))
    these = np.flatnonzero(size > LONG)
    if len(these):
        lens = size[these]
        first = np.cumsum(lens) - lens
        out[these] = strong_hashes(low, np.arange(int(lens.sum())) + np.repeat(start[these] - first, lens), first, lens, seed)
    return out


class Words:
    """Words of some texts: where each begins and ends, whether it follows the one before in a piece, and two hashes of each, made when asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> None:
        self.low = np.append(LOWER[data], np.zeros(8, np.uint8))
        kind = KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        np.equal(kind, 0, out=inside[1:-1])
        before, after = inside[:-2].copy(), inside[2:].copy()
        some = offsets[:-1] < offsets[1:]
        before[offsets[:-1][some]] = False
        after[offsets[1:][some] - 1] = False
        self.start = np.flatnonzero(inside[1:-1] & ~before)
        self.size = np.flatnonzero(inside[1:-1] & ~after) + 1 - self.start
        row = np.searchsorted(offsets, self.start, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int64)[self.start] if len(self.start) else self.start
        self.follows = np.zeros(len(self.start), bool)
        self.follows[1:] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        self.row, self.language = row, languages[row]
        self._hashes: dict[int, np.ndarray] = {}

    def key(self, first: np.ndarray, n: int, seed: int) -> np.ndarray:
        """A key of the phrases of n words that begin at these words."""
        if seed not in self._hashes:
            self._hashes[seed] = word_hashes(self.low, self.start, self.size, seed)
        h, key = self._hashes[seed], self.language[first] + U64(n)
        for k in range(n):
            key = mix(key * U64(0x9E3779B97F4A7C15) + h[first + k])
        return key

    def firsts(self, n: int, last: np.ndarray | None = None) -> np.ndarray:
        """The first words of all phrases of n words, or of those whose last words are given."""
        if last is None:
            follows = np.ones(len(self.follows), bool)
            for k in range(n - 1):
                follows[k + 1 :] &= self.follows[1 : len(follows) - k]
                follows[: k + 1] = False
            last = np.flatnonzero(follows)
        return last - (n - 1)

    def phrases(self, n: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, key, second key) of all phrases of n words, or of those whose last words are given."""
        first = self.firsts(n, last)
        return first, self.key(first, n, 0), self.key(first, n, 1)

    def text(self, first: np.ndarray, n: int) -> list[bytes]:
        """The phrases' words with one space between them."""
        low, end = self.low.tobytes(), self.start[first + n - 1] + self.size[first + n - 1]
        plain = (end - self.start[first]) == np.add.reduce([self.size[first + k] for k in range(n)]) + n - 1
        found = [low[a:b].replace(b"\t", b" ") for a, b in zip(self.start[first].tolist(), end.tolist(), strict=True)]
        return [x if p else b" ".join([w for w in x.split(b" ") if w]) for x, p in zip(found, plain.tolist(), strict=True)]


def languages_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different languages (null is und), each row's place among them, and each row's hash."""
    codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("und").dictionary_encode()
    names = codes.dictionary.to_pylist()
    raw = [n.encode() for n in names]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]).astype(np.int64)
    first = np.append(0, ends[:-1]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    hashes = np.zeros(len(raw), U64)
    some = np.flatnonzero(ends > first) if len(raw) else first
    hashes[some] = strong_hashes(data, np.arange(len(data)), first[some], (ends - first)[some], 2)
    at = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return names, at, hashes[at]


def word_pieces(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """The words of (lang, text) rows, some half MB of text at a time, with the languages and each row's place among them."""
    names, at, hashes = languages_of(batch.column(0))
    for i, data, offsets in text_pieces(batch.column(1)):
        rows = slice(i, i + len(offsets) - 1)
        yield Words(data, offsets, hashes[rows]), names, at[rows]
    pa.default_memory_pool().release_unused()


class Sketch:
    """Which places hold min_count occurrences or more."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self.packed, self.bits = packed, bits

    def has(self, key: np.ndarray) -> np.ndarray:
        place = (key >> U64(64 - self.bits)).astype(np.int64)
        return (self.packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def passing(w: Words, sketches: dict[int, Sketch], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first word, key) of the phrases of one word, of two and so on that pass with every part for which there is a sketch."""
    last = None
    for n in range(1, longest + 1):
        first = w.firsts(n, last)
        key = w.key(first, n, 0)
        if n in sketches:
            hit = sketches[n].has(key)
            first, key = first[hit], key[hit]
        yield n, first, key
        ok = np.zeros(len(w.follows), bool)
        ok[first + n - 1] = True
        follows = np.flatnonzero(w.follows)
        last = follows[ok[follows] & ok[follows - 1]]


def tree_sum(rows: DataFrame, tasks: int, add: Callable[[pa.Table], dict], schema: str, keys: list[str], finish: Callable[[dict], dict] = dict) -> DataFrame:
    """Rows (keys, task, ...) of one key added FAN tasks at a time, level by level, until one row a key is left, which `finish` may change."""
    names = [c.split()[0] for c in schema.split(", ")]

    def level(last: bool) -> Callable[[pa.Table], pa.Table]:
        def fn(t: pa.Table) -> pa.Table:
            out = {k: t[k][0].as_py() for k in [*keys, "task"]} | (finish(add(t)) if last else add(t))
            out["task"] //= FAN
            return pa.table({n: pa.array([out[n]], t.schema.field(n).type) for n in names})

        return fn

    while True:
        rows = rows.withColumn("_group", F.floor(F.col("task") / FAN)).groupBy(*keys, "_group").applyInArrow(level(tasks <= FAN), schema)
        if tasks <= FAN:
            return rows
        tasks = -(-tasks // FAN)


def _merged(places: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(places, kind="stable")
    places, counts = places[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.zeros(0, np.int64)
    return places[first], np.minimum(np.add.reduceat(counts, first), most).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)


def sketched(docs: DataFrame, levels: list[int], known: dict[int, Sketch], min_count: int, bits: int) -> tuple[dict[int, Sketch], dict[str, int]]:
    """The sketches of phrases of these numbers of words whose parts pass those known, and each language's words."""
    if not 0 < min_count < 256:
        raise ValueError("min_count must be from 1 to 255")
    held = docs.sparkSession.sparkContext.broadcast(known)
    schema = "level int, chunk int, task int, places binary, counts binary, lang string, words long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words = TaskContext.get().partitionId(), {}
        waiting: dict[int, list[np.ndarray]] = {n: [] for n in levels}
        merged = {n: (np.zeros(0, np.uint32), np.zeros(0, np.uint8)) for n in levels}

        def gather(n: int) -> None:
            if waiting[n]:
                new, counts = np.unique(np.concatenate(waiting[n]), return_counts=True)
                waiting[n] = []
                merged[n] = _merged(np.append(merged[n][0], new), np.append(merged[n][1], np.minimum(counts, min_count)), min_count)

        def rows(n: int) -> Iterator[pa.RecordBatch]:
            places, counts = merged[n]
            merged[n] = (places[:0], counts[:0])
            chunk = places // CHUNK
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            for i in range(0, len(first), 256):
                part = list(zip(first[i : i + 256].tolist(), np.append(first[1:], len(chunk))[i : i + 256].tolist(), strict=True))
                m = len(part)
                columns = [np.full(m, n, np.int32), chunk[[a for a, _ in part]].astype(np.int32), np.full(m, task, np.int32)]
                pieces = [((places[a:b] % CHUNK).astype("<u4").tobytes(), counts[a:b].tobytes()) for a, b in part]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=["level", "chunk", "task", "places", "counts", "lang", "words"])

        for batch in batches:
            for w, names, at in word_pieces(batch):
                if 1 in levels:
                    for i, c in enumerate(np.bincount(at[w.row], minlength=len(names)).tolist()):
                        words[names[i]] = words.get(names[i], 0) + c
                for n, _, key in passing(w, held.value, max(levels)):
                    if n not in waiting:
                        continue
                    waiting[n].append((key >> U64(64 - bits)).astype(np.uint32))
                    if sum(map(len, waiting[n])) > PLACES:
                        gather(n)
                        if len(merged[n][0]) > PLACES:
                            yield from rows(n)
        for n in levels:
            gather(n)
            yield from rows(n)
        if words:
            m = len(words)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())], pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["level", "chunk", "task", "places", "counts", "lang", "words"])

    def add(t: pa.Table) -> dict:
        places, counts = _merged(np.frombuffer(b"".join(t["places"].to_pylist()), "<u4"), np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8), min_count)
        return {"places": places.astype("<u4").tobytes(), "counts": counts.tobytes()}

    def frequent(sums: dict) -> dict:
        """One bit a place of the chunk."""
        bits = np.zeros(CHUNK, bool)
        bits[np.frombuffer(sums["places"], "<u4")[np.frombuffer(sums["counts"], np.uint8) >= min_count]] = True
        return {"places": np.packbits(bits, bitorder="little").tobytes(), "counts": b""}

    stored = cut(docs.mapInArrow(fill, schema))
    held.unpersist()
    sums = tree_sum(stored.filter("chunk is not null").drop("lang", "words"), docs.rdd.getNumPartitions(), add, "level int, chunk int, task int, places binary, counts binary", ["level", "chunk"], frequent)
    packed = {n: np.zeros(max(1, (1 << bits) >> 3), np.uint8) for n in levels}
    size = CHUNK >> 3
    for r in sums.select("level", "chunk", F.col("places").alias("bits")).collect():
        part = packed[r.level][r.chunk * size : (r.chunk + 1) * size]
        part |= np.frombuffer(r.bits, np.uint8)[: len(part)]
    words = {r.lang: r.n for r in stored.filter("words is not null").groupBy("lang").agg(F.sum("words").alias("n")).collect()} if 1 in levels else {}
    return {n: Sketch(p, bits) for n, p in packed.items()}, words


def _line(lang: str) -> bytes:
    """A language as the first part of a line."""
    return lang.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").encode() + b"\t"


def _lang(line: str) -> str:
    return line.replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")


def candidates(docs: DataFrame, held, longest: int) -> DataFrame:
    """(shard, task, lines): each different phrase that passes with all its parts once, one row a shard; a line is a language, a tab and a phrase."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, keys, lines = TaskContext.get().partitionId(), [], []
        sent = np.zeros(SENT, U64)  # a key at its place was sent lately; one that another has driven out is sent again

        def rows() -> Iterator[pa.RecordBatch]:
            order, cuts = _by_shard(np.concatenate(keys))
            order = order.tolist()
            every = np.flatnonzero(np.diff(cuts))
            for shards in (every[i : i + 64] for i in range(0, len(every), 64)):
                # Sorted lines share their beginnings with their neighbours, which the shuffle's compression takes out.
                packed = [b"\n".join(sorted([lines[j] for j in order[cuts[i] : cuts[i + 1]]])) for i in shards]
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(np.full(len(shards), task, np.int32)), pa.array(packed, pa.binary())], ["shard", "task", "lines"])

        for batch in batches:
            for w, known, at in word_pieces(batch):
                begin = [_line(x) for x in known]
                for n, first, key in passing(w, held.value, longest):
                    new = np.flatnonzero(sent[(key % U64(SENT)).astype(np.int64)] != key)
                    new = new[np.unique(key[new], return_index=True)[1]]
                    if len(new):
                        sent[(key[new] % U64(SENT)).astype(np.int64)] = key[new]
                        keys.append(key[new])
                        lines += [begin[i] + x for i, x in zip(at[w.row[first[new]]].tolist(), w.text(first[new], n), strict=True)]
                if len(lines) > GATHERED:
                    yield from rows()
                    keys, lines = [], []
        if lines:
            yield from rows()

    def add(t: pa.Table) -> dict:
        """Of rows of one shard each line once."""
        return {"lines": b"\n".join(sorted(set(b"\n".join(t["lines"].to_pylist()).split(b"\n"))))}

    schema = "shard int, task int, lines binary"
    return cut(tree_sum(docs.mapInArrow(find, schema), docs.rdd.getNumPartitions(), add, schema, ["shard"]))


def _by_shard(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of shards, the keys' highest bits, and where each shard begins."""
    shard = (key >> U64(64 - SHARD_BITS)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=1 << SHARD_BITS)))


def phrase_rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[Words, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """The phrases of each shard's row, some half MB at a time: their words, languages, texts, numbers of words and last words."""
    for i in range(batch.num_rows):
        parts = [x.split("\t") for x in batch.column(column)[i].as_py().decode().split("\n")]
        lang, phrase = pa.array([_lang(x[0]) for x in parts], pa.string()), pa.array([x[1] for x in parts], pa.string())
        _, _, languages = languages_of(lang)
        for x, data, offsets in text_pieces(phrase):
            m = len(offsets) - 1
            w = Words(data, offsets, languages[x : x + m])
            n = np.bincount(w.row, minlength=m)
            yield w, lang.slice(x, m), phrase.slice(x, m), n, np.cumsum(n) - 1


class Slots:
    """A minimal perfect hash over shards of keys: level by level a key's bit is set where no other key of its shard falls."""

    def __init__(self, shards: list[dict]) -> None:
        n_shards = 1 << SHARD_BITS
        depth = max((len(s["sizes"]) for s in shards), default=0)
        self.sizes, self.starts = np.zeros((n_shards, depth), np.int64), np.zeros((n_shards, depth), np.int64)
        at, bits, stored = 0, [], []
        for s in shards:
            sizes = np.array(s["sizes"], np.int64)
            self.sizes[s["shard"], : len(sizes)] = sizes
            self.starts[s["shard"], : len(sizes)] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            bits.append(np.frombuffer(s["bits"], np.uint64)), stored.append(np.frombuffer(s["stored"], np.uint64))
        self.bits = np.concatenate([*bits, np.zeros(1, np.uint64)])
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.bits).astype(np.int64)))
        self.stored = np.concatenate([*stored, np.zeros(1, np.uint64)])
        self.n = len(self.stored) - 1

    @staticmethod
    def place(key: np.ndarray, key2: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
        return (mix(key + mix(key2 + U64(level + 1))) % np.asarray(size).astype(U64)).astype(np.int64)

    @staticmethod
    def build(key: np.ndarray, key2: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """(bits of each level, all bits, 64 bits of both keys in the order of slots) of one shard's different keys."""
        sizes, words, stored = [], [], []
        while len(key):
            if len(sizes) == 64:
                raise ValueError("two candidates share both keys")
            size = -(-2 * len(key) // 64) * 64
            place = Slots.place(key, key2, len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            order = np.argsort(place[alone])
            sizes.append(size), words.append(np.packbits(bits, bitorder="little").tobytes()), stored.append((mix(key) + key2)[alone][order].tobytes())
            key, key2 = key[~alone], key2[~alone]
        return sizes, b"".join(words), b"".join(stored)

    def slots(self, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for those that are none of the candidates."""
        out, shard = np.full(len(key), -1), (key >> U64(64 - SHARD_BITS)).astype(np.int64)
        left = np.arange(len(key))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            bit = self.starts[shard[left], level] + self.place(key[left], key2[left], level, size)
            word, low = self.bits[bit >> 6], (bit & 63).astype(U64)
            hit = (word >> low) & U64(1) != 0
            under = np.bitwise_count(word & ((U64(1) << low) - U64(1))).astype(np.int64)
            slot = (self.before[bit >> 6] + under)[hit]
            out[left[hit]] = np.where(self.stored[slot] == mix(key[left[hit]]) + key2[left[hit]], slot, -1)
            left = left[~hit]
        return out


def shards_of(found: DataFrame) -> DataFrame:
    """Each shard's part of the hash."""

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            keys = [w.phrases(k, last[n == k])[1:] for w, _, _, n, last in phrase_rows(batch.slice(i, 1), 1) for k in np.unique(n).tolist()]
            sizes, bits, stored = Slots.build(*[np.concatenate(x) for x in zip(*keys, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([stored], pa.binary())], ["shard", "sizes", "bits", "stored"])

    return arrow_map(found.select("shard", "lines"), build, "shard int, sizes array<long>, bits binary, stored binary")


def counted(docs: DataFrame, slots, sketches, longest: int, n_slots: int) -> np.ndarray:
    """Occurrences of each slot's phrase over all documents; what the sketches leave out is no candidate and is not looked up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, task, sums, waiting = slots.value, TaskContext.get().partitionId(), np.zeros(n_slots, np.int64), []

        def gather() -> None:
            if waiting:
                np.add(sums, np.bincount(np.concatenate(waiting), minlength=n_slots), out=sums)
                waiting.clear()

        for batch in batches:
            for w, _, _ in word_pieces(batch):
                for n, first, key in passing(w, sketches.value, longest):
                    slot = hash_.slots(key, w.key(first, n, 1))
                    waiting.append(slot[slot >= 0])
                if sum(map(len, waiting)) > GATHERED:
                    gather()
        gather()
        for i in range(0, n_slots, SLOTS):
            if sums[i : i + SLOTS].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLOTS], pa.int32()), pa.array([task], pa.int32()), pa.array([sums[i : i + SLOTS].tobytes()], pa.binary())], ["chunk", "task", "sums"])

    def add(t: pa.Table) -> dict:
        return {"sums": np.add.reduce([np.frombuffer(x, np.int64) for x in t["sums"].to_pylist()]).tobytes()}

    out = np.zeros(n_slots, np.int64)
    schema = "chunk int, task int, sums binary"
    for r in tree_sum(docs.mapInArrow(count, schema), docs.rdd.getNumPartitions(), add, schema, ["chunk"]).collect():
        out[r.chunk * SLOTS : (r.chunk + 1) * SLOTS] = np.frombuffer(r.sums, np.int64)
    return out


def read_cuts(found: DataFrame, slots, counts, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r): of each candidate of two words or more its count, and of its cuts, shortest first part first, both sides' counts.

    What another round counts is 0 here; a phrase without any count in this round is left out.
    """

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hash_, sums = slots.value, counts.value

        def at(w: Words, last: np.ndarray, n: int) -> np.ndarray:
            _, key, key2 = w.phrases(n, last)
            slot = hash_.slots(key, key2)
            return np.where(slot >= 0, sums[slot], 0)

        for w, lang, phrase, n_words, last in phrase_rows(batch, 0):
            for n in range(2, longest + 1):
                these = np.flatnonzero(n_words == n)
                e = last[these]
                a, left, right = at(w, e, n), [at(w, e - n + k, k) for k in range(1, n)], [at(w, e, n - k) for k in range(1, n)]
                some = np.flatnonzero(np.add.reduce([a, *left, *right]) > 0)
                if len(some):
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(x, axis=1)[some].ravel()), n - 1).cast(pa.list_(pa.int64())) for x in (left, right)]
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(these[some])), phrase.take(pa.array(these[some])), pa.array(a[some]), *lists], ["lang", "phrase", "a", "l", "r"])

    return arrow_map(found.select("lines"), read, "lang string, phrase string, a long, l array<long>, r array<long>")


def rounds(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards in order, in runs of at most so many keys (a larger shard is a run of its own); one run even if there are none."""
    out, n = [[]], 0
    for shard in sorted(sizes):
        if out[-1] and n + sizes[shard] > most:
            out.append([])
            n = 0
        out[-1].append(shard)
        n += sizes[shard]
    return out


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, covered_percent: int = 50, most: int = 2000, bits: int = SKETCH_BITS, round_keys: int = ROUND_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language of `docs` (lang, text) its `most` phrases of two words or more that hold together best.

    score is floor(1000000 a a / (l r)) of the cut where it is lowest (ties: the shortest first part). A phrase is left
    out where a longer frequent one that contains it has covered_percent of its count. Null texts have no words, null
    languages are und. Ties go by a, then by the phrase's bytes. Repeated rows count each; whole texts are worked on,
    half a MB at a time; an empty table gives an empty result; other columns are left out.
    """
    with short_batches(docs.sparkSession, 1000):
        return _collocations(docs, min_count, longest, covered_percent, most, bits, round_keys)


def _collocations(docs: DataFrame, min_count: int, longest: int, covered_percent: int, most: int, bits: int, round_keys: int) -> DataFrame:
    spark, mine = docs.sparkSession, len(WRITTEN)
    # What tasks send is counted once a task, so a few longer tasks send less than many short ones.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // TASK_PARTS))
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).coalesce(tasks)
    sketches, words = sketched(docs, [1, 2], {}, min_count, bits)
    for n in range(3, longest + 1):
        sketches |= sketched(docs, [n], sketches, min_count, bits)[0]
    known = spark.sparkContext.broadcast(sketches)
    found = candidates(docs, known, longest)
    shards, parts = cut(shards_of(found)), []
    sizes = {r.shard: r.n for r in shards.select("shard", F.floor(F.octet_length("stored") / 8).alias("n")).collect()}
    for these in rounds(sizes, round_keys):
        slots = Slots([r.asDict() for r in shards.filter(F.col("shard").isin(these)).orderBy("shard").collect()])
        held = spark.sparkContext.broadcast(slots)
        counts = counted(docs, held, known, longest, slots.n)
        sums = spark.sparkContext.broadcast(np.append(counts, 0))
        parts.append(cut(read_cuts(found, held, sums, longest)))
        held.unpersist(), sums.unpersist()
    known.unpersist()
    every = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            every = every.unionByName(p)
        most_of = lambda c: F.array(*[F.coalesce(F.max(F.get(c, F.lit(k))), F.lit(-1)) for k in range(longest - 1)])
        every = every.groupBy("lang", "phrase").agg(F.max("a").alias("a"), most_of("l").alias("l"), most_of("r").alias("r"))
        every = every.withColumns({c: F.filter(c, lambda x: x >= 0) for c in ("l", "r")})
    every = every.filter(F.col("a") >= min_count)
    dec = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(F.arrays_zip("l", "r"), lambda x, k: F.struct(k.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    scored = every.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    scored = scored.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (dec(F.col("a")) * dec(F.col("a"))).cast("decimal(31,0)")).withColumn("down", (dec(F.col("l")) * dec(F.col("r"))).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # Every shorter phrase of two words or more inside a frequent longer one, with the highest count of those.
    parts_of = F.split("phrase", " ", -1)
    inside = every.filter(F.size(parts_of) > 2).select("lang", "a", parts_of.alias("w"))
    spans = [(i, m) for n in range(3, longest + 1) for m in range(2, n) for i in range(n - m + 1)]
    spans = sorted(set(spans))
    inner = F.array(*[F.when((F.size("w") >= i + m) & (F.size("w") > m), F.array_join(F.slice("w", i + 1, m), " ")) for i, m in spans]) if spans else F.array().cast("array<string>")
    inside = inside.select("lang", "a", F.explode(inner).alias("phrase")).filter("phrase is not null").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(F.lit(100) * F.col("longer") >= F.lit(covered_percent) * F.col("a"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    kept = kept.withColumn("rank", rank).filter(F.col("rank") <= most)
    total = spark.createDataFrame([*words.items()], "lang string, n long")
    out = cut(kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    drop_tables(spark, keep=mine, last=1)
    return out


OP13_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select lang, regexp_extract_all(p, '[^ \t]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) as p from d)),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3)) v(k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cuts as (select lang, phrase, k, a, j, array_to_string(w[1:j], ' ') as p, array_to_string(w[j + 1:k], ' ') as q from c, (values (1), (2)) u(j) where j < k),
s as (select cuts.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.k = j and x.phrase = p join f y on y.lang = cuts.lang and y.k = cuts.k - j and y.phrase = q),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where k = 3) group by all),
kept as (select b.* from b left join o on o.lang = b.lang and o.phrase = b.phrase where not coalesce(b.k = 2 and 100 * longer >= 50 * b.a, false))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join n using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
