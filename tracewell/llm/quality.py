"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated temperature.

Every token falls into one of BUCKETS by a hash; each bucket has a sparse random index vector, and its word vector is
the sum of the index vectors of the tokens within two places, over all documents. A document is the mean and spread of
its tokens' word vectors, how alike neighbours are, and its length. The network is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, U64, arrow_map, cut, hash_runs, held, mix, runs, short_batches, text_pieces

#: The table of word vectors has this size whatever the corpus (BUCKETS * DIM doubles, 2 MB).
BUCKETS, DIM, NONZERO, REACH = 8192, 32, 4, 2
#: At most so many labelled documents (those with the smallest hashes of their ids) are fitted on.
SAMPLE, HIDDEN, EPOCHS = 12_000, 24, 60
#: A small sample is gone through more often, for at least so many steps.
BATCH, STEPS = 128, 2000

# Kinds of bytes: letters (and all beyond ASCII), digits, other signs; white space parts tokens, a line's end is a token.
KIND = np.full(256, 3, np.uint8)
KIND[[32, 9, 11, 12, 13]] = 0
KIND[10] = 4
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True

_seeds = mix(np.arange(BUCKETS * NONZERO, dtype=U64) + U64(77)).reshape(BUCKETS, NONZERO)
INDEX_AT = (_seeds % U64(DIM)).astype(np.int64)
INDEX_SIGN = np.where(_seeds >> U64(63), 1.0, -1.0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token: a run of one kind of byte, lower-cased, with its capitals (none, some, all) in the hash."""
    kind = KIND[data]
    change = np.append(True, kind[1:] != kind[:-1])
    at, first, lens = runs(kind > 0, offsets, change)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hash_runs(LOWER[data], at, first, lens)
    capitals = np.add.reduceat(CAPITAL[data[at]].astype(np.int32), first)
    shape = np.where(capitals == 0, 0, np.where((capitals == lens) & (lens > 1), 2, 1))
    bucket = (mix(h + shape.astype(U64)) % U64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(offsets, at[first], "right") - 1


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One unit vector per bucket, from all documents. Tasks add up their own; the driver gets one row per bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for _, data, offsets in text_pieces(batch.column(0)):
                b, row = tokens(data, offsets)
                for k in range(1, REACH + 1):
                    same = np.flatnonzero(row[k:] == row[:-k])
                    for one, other in ((b[same], b[same + k]), (b[same + k], b[same])):
                        for j in range(NONZERO):
                            total += np.bincount(one * DIM + INDEX_AT[other, j], INDEX_SIGN[other, j], BUCKETS * DIM)
        sums = total.reshape(BUCKETS, DIM).astype(np.int64)
        used = np.flatnonzero(sums.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(sums[used, d]) for d in range(DIM)]], ["b", *[f"v{d}" for d in range(DIM)]])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "b int, " + ", ".join(f"v{d} long" for d in range(DIM)))
    rows = parts.groupBy("b").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)]).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[rows.b] = rows.drop(columns="b").to_numpy(np.float64)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Features of each row, piece by piece; a text without tokens has zeros."""
    for _, data, offsets in text_pieces(column, 1 << 18):
        b, row = tokens(data, offsets)
        n = np.bincount(row, minlength=len(offsets) - 1)
        out = np.zeros((len(n), 2 * DIM + 4), np.float64)
        if len(b):
            v = vectors[b]
            some = np.flatnonzero(n)
            start = np.append(0, np.cumsum(n[some]))[:-1]
            count = n[some, None]
            mean = np.add.reduceat(v, start, axis=0) / count
            out[some, :DIM] = mean
            out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, start, axis=0) / count - mean**2))
            for k in (1, 2):
                alike = np.zeros(len(b), np.float32)
                alike[:-k] = np.where(row[k:] == row[:-k], (v[k:] * v[:-k]).sum(1), 0) if len(b) > k else 0
                out[some, 2 * DIM + k - 1] = np.add.reduceat(alike, start) / n[some]
                equal = np.zeros(len(b), np.float32)
                equal[:-k] = (b[k:] == b[:-k]) & (row[k:] == row[:-k]) if len(b) > k else 0
                out[some, 2 * DIM + 3] += np.add.reduceat(equal, start) / n[some]
            out[some, 2 * DIM + 2] = np.log1p(n[some])
        yield out


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Two layers by Adam on four fifths, then the temperature that fits the rest best. Without both labels: a constant."""
    rng = np.random.default_rng(seed)
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = {"mean": mean, "spread": spread, "temperature": np.array(1.0)}
    if len(np.unique(y)) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return model | {"w1": np.zeros((x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.array(np.log(rate / (1 - rate)))}
    z = np.clip((x - mean) / spread, -8, 8)
    order = rng.permutation(len(z))
    out, fit = order[: max(1, len(z) // 5)], order[max(1, len(z) // 5) :]
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    batches = max(1, len(fit) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        for i in np.array_split(rng.permutation(fit), batches):
            h = np.maximum(0, z[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / max(1, len(i))
            back = np.outer(g, p[2]) * (h > 0)
            grads, step = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum()], step + 1
            for a, (grad, rate) in enumerate(zip(grads, [0.004 * (1 - epoch / epochs) + 1e-4] * 4, strict=True)):
                m[a], v[a] = 0.9 * m[a] + 0.1 * grad, 0.999 * v[a] + 0.001 * grad**2
                p[a] = p[a] - rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)
    logit = np.maximum(0, z[out] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: np.logaddexp(0, -np.where(y[out] > 0, 1, -1) * logit / t).mean()
    return model | {"w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3], "temperature": np.array(min(np.geomspace(0.25, 8, 61), key=loss))}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8)
    logit = (np.maximum(0, z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, out: bool, size: int) -> DataFrame:
    """doc_id, text, y of at most `size` labelled documents whose id's crc32 has (out=False) or has not (out=True) the remainder; one row for each id."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("y")).filter("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    fold = held(F.col("_id"), modulus, remainder)
    chosen = cut(ids.filter(~fold if out else fold).orderBy(F.xxhash64("_id"), "_id").limit(size))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors over all documents, and the network fitted on labels whose fold is not held out.

    Documents without a label, and labels without a document, shape the vectors alone or nothing; of documents that share
    an id the one with the smallest text is fitted on, of labels that share an id the largest stands; without both labels
    (an empty table, too) the score is a constant.
    """
    with short_batches(docs.sparkSession):
        vectors = word_vectors(docs)

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([*pooled(batch.column(1), vectors), np.zeros((0, 2 * DIM + 4))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tobytes() and [r.tobytes() for r in x] or [], pa.binary()), batch.column(2).cast(pa.int32())], ["doc_id", "x", "y"])

    # At most `sample` rows.
    with short_batches(docs.sparkSession):
        got = arrow_map(labelled_sample(docs, labels, "quality", 3, 1, True, sample), features, "doc_id long, x binary, y int").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got.x), np.float64).reshape(len(got), 2 * DIM + 4)
    return vectors, fit_network(x, got.y.to_numpy(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    Null and empty texts are scored as texts without tokens, and texts of any length as a whole. Equal texts (repeated
    rows, too) have equal scores, a null doc_id stays null and is not held out, an empty table gives an empty result,
    and other columns are left out.
    """

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = np.concatenate([predict(model, x) for x in pooled(batch.column(1), vectors)] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, score double")
    return out.select("doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with all its columns, without those that the classifier rejects (score below 0.5).

    A text without any token cannot be told to be bad and stays, and so does every row when no label is known.
    """
    vectors, model = train(docs, labels)
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column(names.index("text"))
        x = np.concatenate([*pooled(text, vectors), np.zeros((0, 2 * DIM + 4))])
        yield batch.filter(pa.array((predict(model, x) >= 0.5) | ~x.any(1)))

    return docs.mapInArrow(lambda batches: (y for b in batches for y in fn(b)), docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *train(docs, table(spark, sf_dir, "labels")))
