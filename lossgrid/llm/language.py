"""Language identification: expectation-maximisation of a document's language mixture from n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, maybe_broadcast, text_or_empty
from lossgrid.llm.quality import fold
from lossgrid.llm.subwords import bucket, ngrams, split_words
from lossgrid.llm.tokens import passes

# the fit reads at most this many rows of a language, those with the smallest hash of their id
ROWS_PER_LANGUAGE = 800
BITS = 18
NGRAMS = (2, 4)
SMOOTHING = 0.5
ROUNDS = 8
# a word of another language must be this much likelier, in nats, per added language, times half the log of the words
PENALTY = 4.0
PASS_BYTES = 4 << 20
UNDETERMINED = "und"


@dataclass
class Model:
    """Languages and the log probability of every n-gram bucket in each."""

    languages: list[str]
    logs: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language with the largest proportion of each text, and that proportion.

        A word's likelihood in a language is the product of its n-grams'; a document draws each word from one of its
        languages. Proportions are estimated over all languages first. Then the sets of the 1, 2, ... largest ones are
        fitted, and the set with the best penalised likelihood is taken.
        """
        words = split_words(texts, letters=True)
        owner, grams = ngrams(words.names, *NGRAMS)
        cells = bucket(grams, BITS)
        size, n = np.diff(words.bounds), len(self.languages)
        log = np.stack([np.bincount(owner, self.logs[cells, k], minlength=len(words.names)) for k in range(n)], axis=1)
        # the distinct words of each text with their counts
        row = np.repeat(np.arange(len(texts)), size)
        found, counts = np.unique(row * max(len(words.names), 1) + words.index, return_counts=True)
        row, word = np.divmod(found, max(len(words.names), 1))
        some = np.flatnonzero(size)
        starts = np.searchsorted(row, some)
        number = np.searchsorted(some, row)
        log = log[word]
        top = log.max(axis=1) if len(log) else np.zeros(0)
        scaled = np.exp(log - top[:, None])
        base = np.add.reduceat(top * counts, starts) if len(some) else np.zeros(0)

        def maximise(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(ROUNDS):
                part = scaled * share[number]
                total = np.maximum(part.sum(axis=1), 1e-300)
                share = np.add.reduceat(part * (counts / total)[:, None], starts, axis=0) / size[some][:, None]
            total = np.maximum((scaled * share[number]).sum(axis=1), 1e-300)
            return share, base + np.add.reduceat(np.log(total) * counts, starts)

        names, values = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if len(some):
            share, fit = maximise(np.full((len(some), n), 1.0 / n))
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
            best, chosen = np.full(len(some), -np.inf), share
            for k in range(1, n + 1):
                if k < n:
                    part = np.where(rank < k, np.maximum(share, 1e-6), 0.0)
                    part, fit_k = maximise(part / part.sum(axis=1, keepdims=True))
                else:
                    part, fit_k = share, fit
                value = fit_k - PENALTY * (k - 1) * np.log(size[some] + 1) / 2
                better = value > best
                chosen = np.where(better[:, None], part, chosen)
                best = np.where(better, value, best)
            values[some] = np.clip(chosen.max(axis=1), 0.0, 1.0)
            for i, k in zip(some.tolist(), chosen.argmax(axis=1).tolist(), strict=True):
                names[i] = self.languages[k]
        return names, values


def train(texts: list[str], languages: list[str]) -> Model:
    """Smoothed n-gram frequencies of each language over the given texts."""
    known = sorted(set(languages))
    counts = np.zeros((1 << BITS, len(known)))
    code = np.searchsorted(known, languages) if known else np.zeros(0, np.int64)
    for k in range(len(known)):
        own = pa.array([t for t, c in zip(texts, code, strict=True) if c == k], pa.string())
        for a, z in passes(own, PASS_BYTES):
            words = split_words(own.slice(a, z - a), letters=True)
            times = np.bincount(words.index, minlength=len(words.names))
            owner, grams = ngrams(words.names, *NGRAMS)
            counts[:, k] += np.bincount(bucket(grams, BITS), times[owner], minlength=1 << BITS)
    counts += SMOOTHING
    return Model(known, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on at most `rows` texts of each language outside the held-out fold, in the order of a hash of their id."""
    labelled = docs.where((fold() != 1) & F.col("lang").isNotNull()).select("doc_id", "lang")
    counts = keep(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # thinned out by the hash to about twice as many rows before a language's rows meet in one task
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labelled.join(maybe_broadcast(counts, counts.count()), "lang")
        .where(place < F.lit(2.0 * rows) / F.col("n"))
        .withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= rows)
        .select("doc_id", "lang")
        .distinct()
    )
    sample = docs.select("doc_id", "lang", text_or_empty("text").alias("text")).join(
        F.broadcast(chosen), ["doc_id", "lang"]
    )
    # a repeated id brings all its rows along, so the bound is set once more
    top = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = sample.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= rows)
    sample = sample.select("text", "lang").toPandas()
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, from its whole text.

    lang_pred is a language seen in training, or `und` with score 0 for a null text, a text without letters, and when
    nothing could be learned. Of equal proportions the first language by name wins. A null id is not held out. Repeated
    rows get equal results; an empty table gives an empty result; columns other than doc_id, text and lang are not read.
    """
    model = fit(docs, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in passes(batch.column(1), PASS_BYTES):
                part = batch.slice(a, z - a)
                if shared.value.languages:
                    names, values = shared.value.predict(part.column(1))
                else:
                    names, values = [UNDETERMINED] * (z - a), np.zeros(z - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(values)], ["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
