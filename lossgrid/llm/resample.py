"""Importance resampling towards a target text distribution, by hashed word n-grams and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, text_or_empty

SIZES = (1, 1)
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# the low bits of monotonically_increasing_id: the place within a partition
PLACE_BITS = 33

# fixed values: words are runs of digits, a-z and bytes from 0x80 on; A-Z become a-z, all else separates
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(c if c in KEPT or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def collapsed(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.translate(TABLE).split())


def ngram_pattern(n: int) -> regex.Pattern:
    """Runs of n words in a collapsed text. Scanned with overlaps; the lookarounds hold a match to whole words."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def feature_counts(texts: DataFrame, text: str, passed: list[Column], sizes: tuple[int, int], buckets: int) -> DataFrame:
    """(passed, n_words, n_features, buckets, counts) per row: how many of its n-grams fall into which bucket.

    Each n-gram's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`; only buckets that occur are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [ngram_pattern(n) for n in range(sizes[0], sizes[1] + 1)]
        gram = itemgetter(0)
        for batch in batches:
            words, features, found, numbers, ends = [], [], [], [], [0]
            for raw in batch.column(0):
                data = collapsed(raw.as_py())
                spans = (m for p in patterns for m in p.finditer(data, overlapped=True))
                codes = np.fromiter(map(crc32, map(gram, spans)), np.uint32)
                which, count = np.unique(codes % np.uint32(buckets), return_counts=True)
                words.append(data.count(b" ") + 1 if data else 0)
                features.append(len(codes))
                found.append(which.astype(np.int32))
                numbers.append(count.astype(np.int64))
                ends.append(ends[-1] + len(which))
            at = pa.array(ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))
                for kind, parts in ((np.int32, found), (np.int64, numbers))
            ]
            columns = [*batch.columns[1:], pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists]
            yield pa.record_batch(columns, [*batch.schema.names[1:], "n_words", "n_features", "buckets", "counts"])

    rows = texts.select(text_or_empty(text).cast("binary").alias("_text"), *passed)
    kinds = [f"{name} {kind}" for name, kind in rows.dtypes[1:]]
    schema = [*kinds, "n_words long", "n_features long", "buckets array<int>", "counts array<long>"]
    return rows.mapInArrow(run, ", ".join(schema))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with the array `gains`: 1000 times the log ratio of a bucket's smoothed shares, rounded down.

    Counts are summed where they lie before they are shuffled; `buckets` bounds the rows that meet.
    """

    def totals(rows: DataFrame, name: str) -> DataFrame:
        cells = rows.select(F.inline(F.arrays_zip("buckets", "counts")))
        return cells.groupBy(F.col("buckets").cast("long").alias("id")).agg(F.sum("counts").alias(name))

    all_buckets = source.sparkSession.range(buckets)
    table = all_buckets.join(totals(source, "s"), "id", "left").join(totals(target, "t"), "id", "left")
    table = table.select("id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    rows = table.agg(
        F.sort_array(F.collect_list(F.struct("id", "s", "t"))).alias("cells"),
        F.sum("s").alias("all_s"),
        F.sum("t").alias("all_t"),
    )

    def gain(cell: Column) -> Column:
        ratio = ((cell["t"] + 1) * (F.col("all_s") + buckets)) / ((cell["s"] + 1) * (F.col("all_t") + buckets))
        return F.floor(1000 * F.ln(ratio)).cast("long")

    return rows.select(F.transform("cells", gain).alias("gains"))


def gumbel(id_column: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution by seed and id, times 1000 and rounded down; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    sizes: tuple[int, int] = SIZES,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of `docs`; `rank` is set for the documents that are drawn.

    Features are the runs of sizes[0] to sizes[1] words. A document's weight is the mean gain of its features, rounded
    down (0 without any); the score adds Gumbel noise, so the highest scores are a sample without replacement in
    proportion to the importance. Of the N documents with `least_words` words, floor(percent * N / 100) are drawn: by
    score, then smaller id (null last); repeated rows are drawn one by one. A null text has no words. An empty `docs`
    gives an empty result, an empty target the same weight rule with no target counts; other columns are not read.

    Texts are read once, whole; their sparse counts are written. Ranks come from one range exchange of narrow rows and
    the row counts of its partitions, so no task orders all rows and a tied score is cut by id.
    """
    ident = [F.col(id_column).cast("long").alias("doc_id")]
    features = keep(feature_counts(docs, text_column, ident, sizes, buckets), "resample-features")
    aims = keep(feature_counts(target, target_text, [], sizes, buckets), "resample-target")
    gains = keep(bucket_gains(features, aims, buckets), "resample-gains")
    # a subquery may not stand in a lambda; as a literal the gains are one object for all rows
    table = ",".join(str(g) for g in gains.first()["gains"])  # `buckets` numbers
    gain = F.split(F.lit(table), ",").cast("array<long>")
    products = F.zip_with("buckets", "counts", lambda b, c: F.get(gain, b) * c)
    total = F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.col("n_features")
    # what pmod leaves over makes the division exact, so it rounds down for negative totals too
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    scored = features.withColumn("total", total).withColumn("weight", weight)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    scored = keep(scored.select("doc_id", "n_words", "n_features", "weight", "score", "row"), "resample-scores")

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ordered = scored.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = keep(ordered.withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("place", PLACE_BITS).alias("part")
    sizes_of = ordered.groupBy(part).agg(F.count("*").alias("n"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes_of.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    drawn = F.floor(F.lit(percent) * sizes_of.agg(F.sum("n")).scalar() / 100)
    place = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.withColumn("rank", F.when(place <= drawn, place))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)
