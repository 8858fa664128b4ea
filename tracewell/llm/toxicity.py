"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon (as written, and with obfuscating signs read as letters) and of one
learned from the labelled sample, how often their words stand near the second person, capitals, punctuation, repeated signs and the share of words with signs inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample
from .shared import LOWER, SPACE, U64, arrow_map, cut, hash_runs, held, mix, runs, text_pieces

#: At most so many labelled documents are fitted on.
SAMPLE, TREES, DEPTH, BINS, RATE = 12_000, 80, 3, 64, 0.15
# The lexicon, by how strong a word is, and the second person in four languages.
STRONG = "idiot moron scum vermin filth subhuman bastard bitch asshole fuck fucking shit cunt whore slut retard dumbass dickhead wanker abschaum arschloch schlampe hurensohn connard salope imbécile pute idiota imbécil gilipollas puta cabrón".split()
MILD = "stupid clown loser worthless trash pathetic disgusting garbage dumb fool ugly useless hate kill die crap damn jerk freak creep liar lunatic nasty coward parasite rat pig blöd dumm trottel idiotisch dreck crétin débile nul minable basura asqueroso estúpido inútil tonto".split()
SECOND = "you your yours yourself u ur ya tu te ti toi vous ton votre du dich dir dein ihr euch usted ustedes tú vosotros".split()
#: Signs that stand for letters inside an obfuscated word.
READ = LOWER.copy()
for _a, _b in zip(b"013457@$!|+", b"oieastasiit", strict=True):
    READ[_a] = _b
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
ODD = np.zeros(256, bool)
ODD[[*b"0134578@$!|+*#%&_.-"]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
N_FEATURES = 20
#: Toxic documents that a word of the learned lexicon needs, and the least log-odds (one standard error off).
LEAST_DOCS, LEAST_ODDS = 3, 1.5


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(hash_runs(data, np.arange(len(data)), np.array([0]), np.array([len(data)]))[0])
    return np.sort(np.array(out, U64))


_strong, _mild, _second = _hashes(STRONG), _hashes(MILD), _hashes(SECOND)


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a short sorted list, by a table of the low bits first."""
    table = np.zeros(1 << 16, bool)
    table[(known & U64(0xFFFF)).astype(np.int64)] = True
    out = table[(h & U64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
    out[some] = known[at] == h[some]
    return out


def features(column: pa.Array, learned: np.ndarray) -> Iterator[np.ndarray]:
    """Features of each row, piece by piece; a text without words has zeros. learned: sorted hashes of words."""
    with np.errstate(over="ignore"):
        for _, data, offsets in text_pieces(column):
            rows = len(offsets) - 1
            out = np.zeros((rows, N_FEATURES))
            size = np.maximum(1, np.diff(offsets))
            total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
            low = LOWER[data]
            at, first, lens = runs(WORD_BYTE[low], offsets)
            # Words as written, by letters and digits; words between white space, read through their obfuscation.
            dense_at, dense_first, dense_lens = runs(~SPACE[data], offsets)
            if not len(at) or not len(dense_at):
                yield out
                continue
            h = hash_runs(low, at, first, lens)
            row = np.searchsorted(offsets, at[first], "right") - 1
            read = READ[data]
            letters = LETTER[read[dense_at]]
            inner = dense_at[letters]
            owner = np.repeat(np.arange(len(dense_first)), dense_lens)[letters]
            f2 = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            l2 = np.diff(np.append(f2, len(owner)))
            h2 = hash_runs(read, inner, f2, l2)
            row2 = np.searchsorted(offsets, inner[f2], "right") - 1 if len(f2) else f2
            n, n2 = np.maximum(1, np.bincount(row, minlength=rows)), np.maximum(1, np.bincount(row2, minlength=rows))
            count = lambda hit, r: np.bincount(r[hit], minlength=rows).astype(float)
            strong, mild, second = _in(h, _strong), _in(h, _mild), _in(h, _second)
            own_words = _in(h, learned) if len(learned) else np.zeros(len(h), bool)
            strong2, mild2 = _in(h2, _strong), _in(h2, _mild)
            s, m, s2, m2 = count(strong, row), count(mild, row), count(strong2, row2), count(mild2, row2)
            out[:, 0], out[:, 1], out[:, 2], out[:, 3] = s / n, m / n, s2 / n2, m2 / n2
            out[:, 4], out[:, 5] = np.log1p(s + s2), np.log1p(m + m2)
            out[:, 6] = count(second, row) / n
            place = np.flatnonzero(second)
            bad = np.flatnonzero(strong | mild | own_words)
            if len(place) and len(bad):
                i = np.clip(np.searchsorted(place, bad), 1, max(1, len(place) - 1))
                near = np.full(len(bad), 1 << 30)
                for p in (place[np.minimum(i, len(place) - 1)], place[i - 1]):
                    near = np.minimum(near, np.where(row[p] == row[bad], np.abs(p - bad), 1 << 30))
                out[:, 7] = np.bincount(row[bad], 1 / (1 + near / 4), minlength=rows) / n
            out[:, 8] = total((data >= 65) & (data < 91)) / size
            out[:, 9] = total(data == 33) / size
            out[:, 10] = total(data == 63) / size
            out[:, 11] = total(~LETTER[data] & ~SPACE[data]) / size
            twice = np.zeros(len(data), bool)
            twice[1:] = data[1:] == data[:-1]
            out[:, 12] = total(twice) / size
            odd = np.add.reduceat(ODD[data[dense_at]].astype(np.int32), dense_first)
            letters_in = np.add.reduceat(LETTER[data[dense_at]].astype(np.int32), dense_first)
            drow = np.searchsorted(offsets, dense_at[dense_first], "right") - 1
            edge = ODD[data[dense_at[dense_first + dense_lens - 1]]].astype(np.int32)
            out[:, 13] = count((odd > edge) & (letters_in > 0), drow) / np.maximum(1, np.bincount(drow, minlength=rows))
            out[:, 14] = np.log1p(n)
            out[:, 15] = (s + m) > 0
            out[:, 16] = np.maximum(0, s2 + m2 - s - m) / n2
            out[:, 17] = np.bincount(row, lens, minlength=rows) / n
            out[:, 18], out[:, 19] = count(own_words, row) / n, np.log1p(count(own_words, row))
            yield out


class Boosted:
    """Trees of a fixed depth on binned features, fitted to the logistic loss by second-order gains; heap order."""

    def __init__(self, edges: list[np.ndarray], base: float) -> None:
        self.edges, self.base = edges, base
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.steps = (np.array([0.0]), np.array([0.5]))
        self.learned = np.zeros(0, U64)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]).astype(np.int32) if len(x) else np.zeros((0, len(self.edges)), np.int32)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut_at, leaf in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut_at[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities: the isotonic steps, with a little of the raw probability to keep order within a step."""
        raw = self.raw(self.binned(x))
        p = np.interp(raw, *self.steps) if len(self.steps[0]) > 1 else np.full(len(raw), self.steps[1][0])
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pools, in order of x."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, c = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + c]
    return np.array([c / n for _, n, c in pools]), np.array([s / n for s, n, _ in pools])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Boosted:
    """Three quarters grow the trees, the rest calibrates. Without both labels the score is a constant."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(N_FEATURES)]
    rate = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
    model = Boosted(edges, np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        model.steps = (np.array([0.0]), np.array([rate if len(y) else 0.0]))
        return model
    order = np.random.default_rng(seed).permutation(len(y))
    out, use = order[: len(y) // 4], order[len(y) // 4 :]
    b, t = model.binned(x[use]), y[use]
    raw, inner = np.full(len(use), model.base), 2**DEPTH - 1
    rows = np.arange(len(use))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = t - p, p * (1 - p) + 1e-9
        feature, cut_at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(use), np.int64)
        for level in range(DEPTH):
            start, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(N_FEATURES):
                key = (node - start) * (BINS + 1) + b[:, f]
                gs, hs = (np.bincount(key, w, width * (BINS + 1)).reshape(width, -1).cumsum(1) for w in (g, h))
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                ok = (hs >= 2) & (all_h - hs >= 2)
                gain = np.where(ok, gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1), 0)
                k = gain.argmax(1)
                for j in np.flatnonzero(gain.max(1) > best):
                    best[j], feature[start + j], cut_at[start + j] = gain[j, k[j]], f, k[j]
            node = 2 * node + 1 + (b[rows, feature[node]] > cut_at[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = RATE * gs / (hs + 1)
        model.trees.append((feature, cut_at, leaf))
        raw += leaf[leaf_of]
    model.steps = isotonic(model.raw(model.binned(x[out])), y[out]) if len(out) else (np.array([0.0]), np.array([rate]))
    return model


def _fold(batch: pa.RecordBatch) -> np.ndarray:
    return (mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) >> U64(63)).astype(np.int64)


def learned_words(sample: DataFrame) -> list[np.ndarray]:
    """Sorted hashes of the words that mark toxic documents of the sample: learned without its half 0, without its half 1, and from all.

    Words are counted once a document and summed by Spark; the sample bounds their number.
    """

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fold, y = _fold(batch), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, data, offsets in text_pieces(batch.column(1)):
            low = LOWER[data]
            at, start, lens = runs(WORD_BYTE[low], offsets)
            if len(at):
                pairs = np.unique(np.column_stack([(np.searchsorted(offsets, at[start], "right") - 1).astype(np.int64), hash_runs(low, at, start, lens).view(np.int64)]), axis=0)
                row = pairs[:, 0] + first
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(fold[row]), pa.array(y[row])], ["h", "fold", "y"])

    words = arrow_map(sample.select("doc_id", "text", "y"), fn, "h long, fold long, y long")
    n = {(r.fold, r.y): r["count"] for r in arrow_map(sample.select("doc_id", "text", "y"), lambda b: iter([pa.RecordBatch.from_arrays([pa.array(_fold(b)), b.column(2).cast(pa.int64())], ["fold", "y"])]), "fold long, y long").groupBy("fold", "y").count().collect()}
    count = lambda f, y: F.count(F.when((F.col("fold") == f) & (F.col("y") == y), 1))
    by = cut(words.groupBy("h").agg(*[count(f, y).alias(f"c{f}{y}") for f in (0, 1) for y in (0, 1)]).filter(F.col("c01") + F.col("c11") >= LEAST_DOCS))
    out = []
    for folds in ((1,), (0,), (0, 1)):
        toxic, clean = (sum(n.get((f, y), 0) for f in folds) for y in (1, 0))
        a, b = (sum((F.col(f"c{f}{y}") for f in folds), F.lit(0)) for y in (1, 0))
        odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1)) - F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        best = by.filter(a >= LEAST_DOCS).select("h", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
        out.append(np.sort(np.array([r.h for r in best.collect()], np.int64).view(U64)))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fitted on at most `sample` labelled documents, none of the held-out fold.

    While fitting, a document's learned words come from the half of the sample that it is not in. Documents without a
    label, and labels without a document, take no part; of documents that share an id the one with the smallest text
    stands, of labels that share an id the largest; without both labels (an empty table, too) the score is a constant.
    """
    chosen = cut(labelled_sample(docs, labels, "toxic", 5, 0, True, sample))
    lists = learned_words(chosen)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, N_FEATURES))
        both = [np.concatenate([*features(batch.column(1), words), none]) for words in lists[:2]]
        x = np.where(_fold(batch)[:, None] == 0, both[0], both[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).cast(pa.int32())], ["doc_id", "x", "y"])

    got = arrow_map(chosen, fn, "doc_id long, x binary, y int").toPandas().sort_values("doc_id")
    model = fit(np.frombuffer(b"".join(got.x), np.float64).reshape(len(got), N_FEATURES), got.y.to_numpy(np.float64))
    model.learned = lists[2]
    return model


def score(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    Null and empty texts are scored as texts without words, and texts of any length as a whole. Equal texts (repeated
    rows, too) have equal scores, a null doc_id stays null and is not held out, an empty table gives an empty result,
    and other columns are left out.
    """

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = np.concatenate([model.score(x) for x in features(batch.column(1), model.learned)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, score double")
    return out.select("doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
