"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import components, keep, lookup, text_or_empty
from lossgrid.session import bound_arrow_batches

BITS = 64
# distinct fingerprints compared in one piece; a fuller block is cut again, down to at most 2 ** FREE_BITS of them
BLOCK_ROWS = 4096
FREE_BITS = 12


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero for a text without words."""
    found = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space separates
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n], last, strict=False)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3
) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bound_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(free: int, width: int, distance: int) -> list[int]:
    """Cut the bits of `free` into parts; each mask leaves `distance` parts out, about `width` bits in all.

    Two numbers that differ in at most `distance` bits, all of them in `free`, agree under one of the masks: their
    differing bits touch at most `distance` parts.
    """
    bits = [i for i in range(BITS) if free >> i & 1]
    parts = -(-len(bits) * distance // width)
    cuts = [round(len(bits) * i / parts) for i in range(parts + 1)]
    pieces = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    full = (1 << BITS) - 1
    return [full & ~sum(out) for out in combinations(pieces, distance)]


def linked(values: np.ndarray, distance: int) -> np.ndarray:
    """For each of the distinct values the smallest one that it reaches over steps of at most `distance` bits."""
    values = np.sort(values)
    order = values.view(np.uint64)
    root = np.full(len(values), -1)
    for first in range(len(values)):
        if root[first] >= 0:
            continue
        root[first], todo = first, [first]
        while todo:
            at = todo.pop()
            near = np.flatnonzero((np.bitwise_count(order ^ order[at]) <= distance) & (root < 0))
            root[near] = first
            todo.extend(near.tolist())
    return np.stack([values, values[root]], axis=1)


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked over steps of at most `distance` bits.

    Pigeonhole: of 2 * distance blocks, close pairs share `distance`; all choices of them are joined on. A block group
    is compared in one piece when it has at most BLOCK_ROWS distinct fingerprints and yields one edge per member, not
    its pairs. A fuller group is never brought together: its members are dealt out again by finer blocks of the bits
    they do not share yet, where a group has at most 2 ** FREE_BITS members by construction.
    """
    full = (1 << BITS) - 1
    masks = block_masks(full, BITS // 2, distance)
    blocks = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("mask", "key"),
    )
    sizes = blocks.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = blocks.join(sizes, ["mask", "key"])
    light = shared.where(F.col("n") <= BLOCK_ROWS).select("mask", "key", "fp")

    finer = [np.array(block_masks(m, FREE_BITS, distance), np.uint64) for m in (full & ~m for m in masks)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mask in np.unique(outer := batch.column(0).to_numpy()):
                fp = batch.column(1).to_numpy()[outer == mask]
                for part, inner in enumerate(finer[mask]):
                    number = np.full(len(fp), (mask + 1) * 100_000 + part, np.int32)
                    key = (fp.view(np.uint64) & inner).view(np.int64)
                    yield pa.record_batch([pa.array(x) for x in (number, key, fp)], names=["mask", "key", "fp"])

    heavy = shared.where(F.col("n") > BLOCK_ROWS).select("mask", "fp").mapInArrow(cut, "mask int, key long, fp long")
    groups = (
        light.unionByName(heavy)
        .groupBy("mask", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            found = [linked(flat[a:z], distance) for a, z in zip(at, at[1:], strict=False)]
            edges = np.concatenate([f[f[:, 0] != f[:, 1]] for f in found]) if found else np.empty((0, 2), np.int64)
            yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def near_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    distance: int = 3,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprints link at `distance` or fewer differing bits.

    component_id is the smallest doc_id that can be reached over links, the row's own included; null ids are passed
    over and stand only where a whole component has none. A null or blank text has fingerprint zero and is linked like
    any other; repeated rows get equal results. An empty table gives an empty result; other columns are not read.

    Equal fingerprints are folded before anything is joined, so a group of copies is one row; no pairs are emitted.
    """
    rows = keep(fingerprints(docs, id_column, text_column, words), "simhash")
    distinct = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = keep(fingerprint_links(distinct.select("fp"), distance), "simhash-links")
    roots = components(edges, "simhash-components").withColumnRenamed("node", "fp")
    members = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    members = keep(members, "simhash-members")
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = keep(lookup(members, smallest, "root", "inner").select("fp", "component_id"), "simhash-classes")
    return lookup(rows, classes, "fp", "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
