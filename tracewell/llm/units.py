"""Texts cut where public tokenizers can never join, so that what lies between is encoded once and kept.

A unit is a run of white space and what follows it up to the next white space. A byte-level BPE whose pattern ends a
piece before white space, and a piece vocabulary in which no piece has white space after another sign, encode a text
as they encode its units one after another. What the two vocabularies allow is read from them, not assumed.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .bpe import byte_signs

#: Signs that a worker keeps of units; beyond that it starts anew. Signs in one call of a tokenizer.
KEPT_SIGNS, CALL_SIGNS = 1 << 22, 1 << 16


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_pattern(starts: str) -> re.Pattern:
    """Units that begin with one of these white spaces (or with the text); any other white space stays within a unit."""
    return re.compile(rf"\s*\S+(?:[^\S{re.escape(starts)}]\s*\S*)*|\s+")


class Side:
    """One tokenizer: ids of texts, and each id's bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], starts: str, special: dict[str, int] | None = None) -> None:
        self.encode, self.pieces, self.starts, self.special = encode, pieces, starts, special or {}
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts_at = np.cumsum(self.sizes) - self.sizes

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, one after another."""
        size = self.sizes[ids]
        first = np.cumsum(size) - size
        return self.data[np.repeat(self.starts_at[ids] - first, size) + np.arange(int(size.sum()))]

    def joint(self, unit: str) -> bool:
        """Whether both ends of a unit are certain cuts, wherever it stands."""
        return unit[0] in self.starts and not unit[-1].isspace()

    def split(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each unit, whether its ids' bytes are the unit's).

        Runs of joint units are encoded together; the others, and what doesn't come back byte for byte, one by one.
        """
        calls, size = [], CALL_SIGNS
        for i, u in enumerate(units):
            joint = self.joint(u)
            if not joint or size >= CALL_SIGNS:
                calls.append([i, i])
                size = 0 if joint else CALL_SIGNS
            calls[-1][1] += 1
            size += len(u)
        parts = []
        for (x, y), got in zip(calls, self.encode(["".join(units[x:y]) for x, y in calls]), strict=True):
            raw = [u.encode() for u in units[x:y]]
            ids, ends, data = np.array(got, np.int64), np.cumsum([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8)
            at = np.cumsum(self.sizes[ids])
            last = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[last] == ends).all() and np.array_equal(self.bytes_of(ids), data):
                parts.append((ids, np.diff(np.append(-1, last)), np.ones(y - x, bool)))
            else:
                for u, got in zip(units[x:y], self.encode(units[x:y]), strict=True):
                    ids = np.array(got, np.int64)
                    parts.append((ids, np.array([len(ids)]), np.array([self.bytes_of(ids).tobytes() == u.encode()])))
        ids, counts, ok = zip(*parts, strict=True) if parts else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)])
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(ok)


#: Fixed value: the words of byte-level tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space so long that the quick encoder's patterns would overflow; the library encodes such texts.
LONG_BLANK = re.compile(r"\s{4096}")


def _quick_bytes(path: str, pieces: list[bytes], added: set[int]) -> Callable[[str], list[int]] | None:
    """The same encoding of plain text by the tiktoken library, which takes ids for ranks: only for a vocabulary whose merges make
    ids in ascending order, over all single bytes, with the usual words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    ranks = {p: i for i, p in enumerate(pieces) if p and i not in added}
    usual = (spec.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() and not spec.get("normalizer")
    if not usual or merges != sorted(merges) or not {bytes([b]) for b in range(256)} <= ranks.keys() or len(ranks) != len(pieces) - len(added):
        return None
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def byte_level(path: str, plain: bool = True) -> Side:
    """A byte-level BPE in a file of the tokenizers library; plain: strings of special tokens are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    t.encode_special_tokens = plain
    place = {s: b for b, s in enumerate(byte_signs())}
    added = {k: v.content for k, v in t.get_added_tokens_decoder().items()}
    shown = [added.get(i) or t.id_to_token(i) or "" for i in range(max([t.get_vocab_size() - 1, *added]) + 1)]
    pieces = [s.encode() if i in added else bytes(place[c] for c in s) for i, s in enumerate(shown)]
    special = {} if plain else {v: k for k, v in added.items()}
    quick = _quick_bytes(path, pieces, set(added))

    def encode(texts: list[str]) -> list[list[int]]:
        slow = [quick is None or LONG_BLANK.search(x) is not None for x in texts]
        by_library = iter(t.encode_batch([x for x, s in zip(texts, slow, strict=True) if s], add_special_tokens=False))
        return [next(by_library).ids if s else quick(x) for x, s in zip(texts, slow, strict=True)]

    # The pattern of byte-level tokenizers takes a white space at a word's front, never at its end.
    return Side(encode, pieces, " \n\t", special)


@lru_cache(maxsize=2)
def pieces_with_bytes(path: str) -> Side:
    """A BPE model of the sentencepiece library that puts a space before each text; here texts bring it with them."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = [s.id_to_piece(i) for i in range(s.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
    blank = s.piece_to_id("▁")
    free = "".join(w for w in "\n\t" if not any(w in p for i, p in enumerate(shown) if not s.is_byte(i)))
    starts = free if any(re.search("[^▁]▁", p) for p in shown) else " " + free

    def encode(texts: list[str]) -> list[list[int]]:
        # The library's own space stands for the text's; before other white space that joins nothing it is dropped again.
        led = [t[0] == " " for t in texts]
        out = s.encode([t[1:] if x else t for t, x in zip(texts, led, strict=True)], num_threads=1)
        return [([blank] if t == " " else ids) if x else (ids[1:] if ids[:1] == [blank] else ids) for t, ids, x in zip(texts, out, led, strict=True)]

    return Side(encode, pieces, starts)
