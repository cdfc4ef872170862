"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossgrid.llm.common import text_or_empty
from lossgrid.llm.subwords import bucket, ngrams, split_words, word_hashes
from lossgrid.llm.tokens import passes, spread
from lossgrid.session import bound_arrow_batches

# the fit reads at most this many labelled rows, those with the smallest hash of their id
SAMPLE_ROWS = 2000
BITS = 17
DIMENSIONS = 8
NGRAMS = (3, 4)
EPOCHS = 4
LEAST_STEPS = 100
RATE = 0.5
BATCH = 64
# a document's mean spreads its gradient thinly over thousands of features; this evens the two layers' steps
SCALE = 30.0
PASS_BYTES = 1 << 19
# training holds every feature of a pass, so its passes are smaller
TRAIN_PASS_BYTES = 1 << 20


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text: (bucket, share of the text's features) and where each text begins.

    Features are words, their character n-grams, and pairs of neighbouring words. A pair's hash is the exclusive or of
    its words' hashes, so all immediate repeats of a word share one feature.
    """
    words = split_words(texts, letters=False)
    names = word_hashes(words.names)
    owner, grams = ngrams(words.names, *NGRAMS)
    order = np.argsort(owner, kind="stable")
    gram_buckets = bucket(grams[order], BITS)
    sizes = np.bincount(owner, minlength=len(names))
    begins = np.cumsum(sizes) - sizes
    at = words.index
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    inner = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    pairs = bucket((names[at[:-1]] ^ names[at[1:]]) + np.uint64(7), BITS)[inner] if len(at) else np.zeros(0, np.int64)
    rows = np.concatenate([text, np.repeat(text, sizes[at]), text[:-1][inner] if len(text) else text])
    cells = np.concatenate([bucket(names, BITS)[at], gram_buckets[spread(begins[at], sizes[at])], pairs])
    found, counts = np.unique(rows << BITS | cells, return_counts=True)
    row = found >> BITS
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    total = np.bincount(row, counts, minlength=len(texts))
    return found & ((1 << BITS) - 1), counts / total[row], bounds


@dataclass
class Model:
    """What every feature adds to the difference of the two classes' logits, and the difference without features."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Softmax probability of label 1. The mean of vectors is linear, so each distinct word is summed up once."""
        words = split_words(texts, letters=False)
        names = word_hashes(words.names)
        owner, grams = ngrams(words.names, *NGRAMS)
        own = self.gain[bucket(names, BITS)] + np.bincount(
            owner, self.gain[bucket(grams, BITS)], minlength=len(names)
        )
        size = 1.0 + np.bincount(owner, minlength=len(names))
        at, ends = words.index, words.bounds
        total, number = (np.concatenate([[0], np.cumsum(x[at])]) for x in (own, size))
        pair = np.zeros(len(at) + 1)
        if len(at):
            pair[1:-1] = self.gain[bucket((names[at[:-1]] ^ names[at[1:]]) + np.uint64(7), BITS)]
        pair = np.concatenate([[0], np.cumsum(pair)])
        a, z = ends[:-1], ends[1:]
        some = z > a
        # pair i lies between the words i - 1 and i
        pairs = np.where(some, pair[z] - pair[np.minimum(a + 1, z)], 0.0)
        n = number[z] - number[a] + np.maximum(z - a - 1, 0)
        mean = (total[z] - total[a] + pairs) / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -50, 50)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss over document means; without both classes a constant."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1))
    column = pa.array(texts, pa.string())
    cells, shares, sizes = [], [], []
    for a, z in passes(column, TRAIN_PASS_BYTES):
        c, s, b = features(column.slice(a, z - a))
        cells.append(c.astype(np.int32))
        shares.append(s.astype(np.float32))
        sizes.append(np.diff(b))
    cells, shares, sizes = map(np.concatenate, (cells, shares, sizes))
    begins = np.cumsum(sizes) - sizes
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    steps, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        shuffled = random.permutation(len(y))
        for first in range(0, len(y), BATCH):
            rows = shuffled[first : first + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            at = spread(begins[rows], sizes[rows])
            c, s = cells[at], shares[at, None]
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            hidden = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(hidden, row, vectors[c] * s)
            logits = hidden @ output.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ output
            output -= rate * (p.T @ hidden)
            bias -= rate * p.sum(axis=0) / len(rows)
            np.add.at(vectors, c, -rate * SCALE * back[row] * s)
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold, in the order of a hash of their id.

    Labels that are null or not 0 or 1 are passed over; of several labels of an id the largest counts.
    """
    chosen = (
        labels.where((fold() != 1) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.select("text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).toPandas()
    return train(sample["text"].tolist(), sample["label"].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): every row of `docs` as a struct, and the probability of label 1 for its whole text.

    The text goes to Python once, inside its row, and comes back pass by pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = pc.fill_null(pc.struct_field(rows, at).cast(pa.string()), "")
            for a, z in passes(texts, PASS_BYTES):
                values = pa.array(shared.value.scores(texts.slice(a, z - a)))
                yield pa.record_batch([rows.slice(a, z - a), values], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = [c.lower() for c in docs.columns].index("text")
    return rows.mapInArrow(run, StructType([rows.schema["row"]]).add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    A null or empty text has no features and gets the score of the bias; a null id is not held out. Repeated rows get
    equal results. Without usable labels of both classes the score is constant. An empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    model = fit(docs, labels, rows)
    scored = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
