"""Byte-pair encoding by forced-boundary splitting, equal to the tokenizers library's encoding of a word-end vocabulary.

Where two neighbouring bytes stand together inside no token of the vocabulary, no merge can ever join them: the place
is a certain cut. Words are cut there, the fragments are merged independently (and kept, so that a fragment is merged
once per worker), and the ids are put together again.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, runs_of_rows

#: Words and fragments that a worker keeps; beyond that it starts anew. Longer words are not kept.
KEPT, KEPT_LENGTH = 1 << 17, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: its own where it has one, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


def _category(kind: str) -> str:
    """A character class, as ranges, of all code points of a general category."""
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(rf"\p{{{kind}}}+", every))


class Encoder:
    """Encoding and decoding with the vocabulary in a file of the tokenizers library: a BPE with word ends over bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.signs = byte_signs()
        self.joined = {t[i : i + 2] for t in (t.removesuffix(self.end) for t in self.vocabulary) for i in range(len(t) - 1)}
        letters, numbers = _category("L"), _category("N")
        # White space is never part of a piece, so runs of it need not be made one space first. Alternatives that begin
        # with different signs stand in the order of their frequency.
        white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        short = "'(?:s|t|re|ve|m|ll|d)"
        self.pattern = re.compile(f"[{letters}]+|{short}|[{numbers}]|[^{white}{letters}{numbers}]+")
        near = ["".join(r for r in re.findall(r"\\U[0-9a-f]{8}-\\U[0-9a-f]{8}", x) if r[2:10] < "00010000") for x in (letters, numbers)]
        self.basic = re.compile(f"[{near[0]}]+|{short}|[{near[1]}]|[^{white}{near[0]}{near[1]}]+")
        self.plain = re.compile(f"[a-z]+|[^\\t-\\r a-z0-9']+(?:[^\\t-\\r a-z0-9]+)?|{short}|[0-9]|'[^\\t-\\r a-z0-9]*")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self._pair_table()

    def _pair_table(self) -> None:
        """Merges as arrays: symbols are token ids, a pair's key leads to its rank and to the id of what it makes."""
        v = self.vocabulary
        known = [(r, v[a], v[b], v[a + b]) for (a, b), r in self.ranks.items() if a in v and b in v and a + b in v]
        r, a, b, made = np.array(known, np.int64).T if known else np.zeros((4, 0), np.int64)
        self.base = max(v.values()) + 1
        key = a * self.base + b
        self.none = len(self.ranks)
        bits = 20
        self.shift = np.uint64(64 - bits)
        slot = self._slot(key)
        first = np.full(1 << bits, -1, np.int32)
        order = np.argsort(slot, kind="stable")
        s = slot[order]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        first[s[start]] = start
        self.first, self.deep = first, int(np.diff(np.append(start, len(s))).max(initial=0))
        pad = self.deep
        self.keys, self.rank_of, self.made = np.append(key[order], np.full(pad, -1)), np.append(r[order], np.full(pad, self.none)), np.append(made[order], np.full(pad, -1))
        self.byte_ids = np.array([v[x] for x in self.signs])
        self.end_ids = np.array([v[x + self.end] for x in self.signs])
        joined = np.zeros((256, 256), bool)
        place = {x: i for i, x in enumerate(self.signs)}
        for p in self.joined:
            joined[place[p[0]], place[p[1]]] = True
        self.together = joined

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (none where they don't merge) and the symbol it makes."""
        key = left * self.base + right
        at = self.first[self._slot(key)].astype(np.int64)
        rank, made = np.full(len(key), self.none), np.full(len(key), -1)
        for d in range(self.deep):
            hit = np.flatnonzero((at >= 0) & (self.keys[at + d] == key))
            rank[hit], made[hit] = self.rank_of[at[hit] + d], self.made[at[hit] + d]
        return rank, made

    def learn(self, short: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids and tokens of words: all are cut at the certain cuts, and their fragments merged side by side."""
        new_ids: dict[str, str] = {}
        new_shown: dict[str, str] = {}
        raw = [w.encode() for w in short]
        lens = np.array([len(x) for x in raw])
        if len(raw):
            data = np.frombuffer(b"".join(raw), np.uint8)
            word = np.repeat(np.arange(len(raw)), lens)
            last = np.append(word[1:] != word[:-1], True)
            sym = np.where(last, self.end_ids[data], self.byte_ids[data])
            cut = np.append(last[:-1] | ~self.together[data[:-1], data[1:]], True)
            part = np.cumsum(np.append(0, cut[:-1]))
            # The lowest rank of each fragment is merged at its leftmost place, until none merges.
            done_sym, done_at, at = [], [], np.arange(len(sym))
            while len(sym):
                same = part[1:] == part[:-1]
                rank, made = np.full(len(sym), self.none), np.full(len(sym), -1)
                i = np.flatnonzero(same)
                rank[i], made[i] = self._ranked(sym[i], sym[i + 1])
                start = np.flatnonzero(np.append(True, ~same))
                low = np.minimum.reduceat(rank, start)
                size = np.diff(np.append(start, len(sym)))
                each = np.repeat(low, size)
                ended = each == self.none
                done_sym.append(sym[ended]), done_at.append(at[ended])
                hit = np.flatnonzero((rank == each) & ~ended)
                hit = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])] if len(hit) else hit
                sym[hit] = made[hit]
                keep = ~ended
                keep[hit + 1] = False
                sym, part, at = sym[keep], part[keep], at[keep]
            sym, at = np.concatenate(done_sym), np.concatenate(done_at)
            order = np.argsort(at)
            sym, owner = sym[order], word[at[order]]
            bounds = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
            sym, tokens = sym.tolist(), self.tokens
            for w, a, b in zip(short, bounds, bounds[1:], strict=False):
                new_ids[w] = "".join([f" {x}" for x in sym[a:b]])
                new_shown[w] = "".join([f" {tokens[x]}" for x in sym[a:b]])
        return new_ids, new_shown

    def _long(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a word too long to keep, fragment by fragment."""
        signs = "".join([self.signs[b] for b in word.encode()])
        at = [0, *[i + 1 for i in range(len(signs) - 1) if signs[i : i + 2] not in self.joined], len(signs)]
        parts = [[*signs[a:b]] for a, b in zip(at, at[1:], strict=False)]
        parts[-1][-1] += self.end
        tokens = [t for p in parts for t in self._merge_long(p)]
        return "".join([f" {self.vocabulary[t]}" for t in tokens]), "".join([f" {t}" for t in tokens])

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap over a linked list, for fragments where a scan for each merge would take too long."""
        import heapq

        n, rank = len(parts), self.ranks.get
        left, right, alive = [*range(-1, n - 1)], [*range(1, n), -1], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := rank((parts[p], parts[q]))) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    def _found(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        # A sigma is lower-cased by itself, without regard to where in a word it stands.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.basic if max(text) < "\U00010000" else self.pattern).findall(text)

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text the ids and the decoded tokens, joined by spaces. Strings of special tokens are those tokens."""
        cut = [self.specials.split(t) if self.specials else [t] for t in texts]
        found = [[p if k % 2 else self._found(p) for k, p in enumerate(parts)] for parts in cut]
        every = set()
        for parts in found:
            every.update(*parts[::2])
        missing = every - self.ids.keys()
        long = {w: self._long(w) for w in missing if len(w) > KEPT_LENGTH}
        new_ids, new_shown = self.learn([*(missing - long.keys())])
        known_ids, known_shown = self.ids, self.shown
        if len(self.ids) + len(new_ids) > KEPT:
            # The words of these texts stay at hand whatever their number; only what is kept for later texts starts anew.
            old = every & self.ids.keys()
            known_ids, known_shown = {w: self.ids[w] for w in old} | new_ids, {w: self.shown[w] for w in old} | new_shown
            self.ids.clear(), self.shown.clear()
        if len(new_ids) <= KEPT:
            self.ids.update(new_ids), self.shown.update(new_shown)
        out = []
        for parts in found:
            ids, shown = [], []
            for k, p in enumerate(parts):
                if k % 2:
                    ids.append(f" {self.special[p]}"), shown.append(f" {p}")
                elif long:
                    ids += [long[w][0] if w in long else known_ids[w] for w in p]
                    shown += [long[w][1] if w in long else known_shown[w] for w in p]
                else:
                    ids += map(known_ids.__getitem__, p)
                    shown += map(known_shown.__getitem__, p)
            out.append(("".join(ids)[1:], "".join(shown)[1:]))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without a decoder: tokens with a space between them."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and with keep_ids the ids, for each row of `docs` (doc_id, text).

    Null counts as empty: no tokens, the digests of the empty string. No text is cut: texts are worked on about
    PIECE_BYTES at a time, a longer one by itself. Repeated rows give equal rows, a null doc_id stays null, an empty
    table gives an empty result, and other columns are left out. The vocabulary's file must be readable at the same path
    on every executor.
    """
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for a, end in runs_of_rows(batch.column(1)):
            pairs = e.encode_texts([t.as_py() or "" for t in batch.column(1).slice(a, end - a)])
            n = pa.array([ids.count(" ") + (ids != "") for ids, _ in pairs], pa.int64())
            one, two = (pa.array([hashlib.sha256(p[k].encode()).hexdigest() for p in pairs], pa.string()) for k in (0, 1))
            columns, names = [batch.column(0).slice(a, end - a), n, one, two], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([np.array(ids.split(), np.int32) for ids, _ in pairs], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document with the public vocabulary; the ids themselves are left out."""
    from .shared import table

    return encoded(table(spark, sf_dir, "documents"), keep_ids=False)
