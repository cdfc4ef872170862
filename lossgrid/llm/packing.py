"""Packing documents into fixed windows by minimum bin slack over the histogram of remaining lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, text_or_empty
from lossgrid.llm.tokens import PASS_BYTES, RANKS, VOCABULARY, encoder, passes
from lossgrid.session import bound_arrow_batches

CAPACITY = 1024
# rows that are numbered in one piece
BUCKET_ROWS = 100_000


def pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
    with_ids: bool = False,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Cut each document's ids, with `end_id` after them, into pieces of `capacity` and a shorter rest.

    Texts are encoded `pass_bytes` at a time: fewer take less of a worker's memory and a little more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, ranks)
        for batch in batches:
            for a, z in passes(batch.column(1), pass_bytes):
                part = batch.slice(a, z - a)
                flat, bounds = coder.encode(part.column(1))
                # one more id at the end of each document
                sizes = np.diff(bounds) + 1
                ids = np.insert(flat, bounds[1:], end_id).astype("<u4")
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, sizes[row] - start)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                cuts = list(zip(begin.tolist(), (begin + length).tolist(), strict=True))
                columns = {
                    "doc_id": part.column(0).take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in cuts], pa.int64()),
                    "doc_tokens": pa.array(sizes[row]),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[i:j].tolist() for i, j in cuts], pa.list_(pa.int32()))
                yield pa.record_batch(columns)

    bound_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The next window: the longest remaining length and the multiset of others that leaves the least padding.

    Bit s of `reach` says that lengths with the sum s can be picked; each length enters in runs of 1, 2, 4, ... copies.
    The sum with the least padding (none at a power of two), then the largest, is traced back through the steps to how
    often each length is used; longer lengths are taken where there is a choice.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts):
        if length > room:
            break
        left = min(counts[length] - (length == longest), room // length)
        run = 1
        while left > 0:
            run = min(run, left)
            steps.append((length, run, reach))
            reach |= reach << (run * length) & mask
            left -= run
            run *= 2
    total = reach.bit_length() - 1
    if total < room:
        powers = [(1 << k) - longest for k in range(capacity.bit_length()) if 1 << k >= longest]
        total = max((s for s in powers if s <= room and reach >> s & 1), default=total)
    used = {longest: 1}
    for length, run, before in reversed(steps):
        if total >= run * length and before >> (total - run * length) & 1:
            used[length] = used.get(length, 0) + run
            total -= run * length
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, uses, first_sequence, offset): where the pieces of a length with rank lo <= rank < hi go.

    A window is repeated as often as the counts allow, so the plan's size depends on the number of distinct lengths, at
    most `capacity`, and not on the number of pieces.
    """
    counts, taken, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        used = fill(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], taken[length] + k * times, k, sequence, offset))
            taken[length] += k * times
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
            offset += k * length
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`parts` with sequence_id and offset: windows of at most `capacity`, filled from 0 without gaps.

    `parts` has doc_id, start, length (1 to `capacity`) and ids_crc32; it is read several times, so it should be a
    written table. Only the histogram of lengths, at most `capacity` rows, reaches the driver. Pieces of a length are
    ranked in buckets and look up their place in the plan. There are as many buckets as shuffle partitions, so that a
    frequent length is spread over all tasks, and more where a bucket would get over `bucket_rows` pieces.
    """
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, capacity)
    schema = "length long, lo long, hi long, uses long, first_sequence long, base long"
    table = F.broadcast(parts.sparkSession.createDataFrame(places, schema))

    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-sum(histogram.values()) // bucket_rows))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).alias("bucket")
    dealt = parts.select("*", key)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (
        dealt.withColumn("within", within)
        .join(sizes.select("length", "bucket", before.alias("before")), ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    in_range = (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    at = F.col("rank") - F.col("lo")
    return ranked.join(table, in_range).select(
        *[ranked[c] for c in parts.columns],
        (F.col("first_sequence") + F.expr("(rank - lo) div uses")).alias("sequence_id"),
        (F.col("base") + at % F.col("uses") * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece of a document: its place in the document and in the packed sequences.

    A document longer than `capacity` is cut into whole windows and a rest; rests are packed by minimum bin slack. A
    null or empty text is its end id alone. Repeated rows are packed one by one. An empty table gives an empty result;
    other columns are not read. `options` go to `pieces`.
    """
    parts = keep(pieces(docs, capacity=capacity, **options), "packing")
    return pack(parts, capacity)
