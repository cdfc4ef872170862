"""Repeated byte windows across documents, found by depth-limited radix passes over suffixes.

Suffixes are only told apart through the threshold depth, so nothing is sorted to the end: a pass deals the suffixes that
are still together out by their next digit, groups that lie in one document drop out, and the groups left at full depth
are exactly the repeated windows. Every window of `depth` bytes is filed under its leading digit, one of its
`digit`-byte strings chosen by content (a minimizer), which equal windows share wherever they stand; neighbouring
windows have the same one, so a pass handles a run of windows at once:

1. runs are dealt by leading digit; digits that occur in one document only are done;
2. within a digit, runs are told apart by all their bytes. Runs that an earlier document has as well are repeated as
   a whole; runs that share the digit with other runs go on;
3. the windows of these runs are told apart at full depth.

Documents are kept in batches of a few megabytes. A batch sends the distinct digits of a pass to buckets and gets back
one state per digit, so what moves is about one number per run. A digit that very many batches have would still bring as
many numbers to one bucket; such digits are found in a few batches, with the smallest of their documents there. A batch
whose own documents are larger then knows the answer and sends nothing. A leading digit that very many different runs
share, such as a common line between ever different neighbours, would bring them all to one bucket in pass 2. Such
leading digits are found in the same batches, and all their runs are left open for pass 3, which deals windows by
digits of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, new_folder, text_or_empty
from lossgrid.llm.subwords import mix
from lossgrid.llm.tokens import passes, spread

DEPTH = 50
DIGIT = 30
# shortest string that decides where a leading digit lies
SHORT = 4
BATCH_BYTES = 4 << 20
BLOCK = 1 << 19
# text in one bucket of the stored batches, about
STORE_BYTES = 16 << 20
# Spark takes at most 100 000 buckets for a table; with more text a bucket holds more batches, which are read in turn
MOST_BUCKETS = 50_000
# digits that one bucket handles, about; there is one per run, and a run for every RUN_BYTES of text
BUCKET_DIGITS = 500_000
RUN_BYTES = 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# batches in which hot digits are looked for, in how many of them a digit is hot, and the most digits handed out; digits
# beyond these go through the buckets like all others
SAMPLE_BATCHES = 16
HOT_BATCHES = 6
MOST_HOT = 50_000
# runs that may share a leading digit in pass 2; the runs of a fuller one go to pass 3 straight away
LEAD_DIGITS = 100_000
LAST = np.iinfo(np.int64).max
NOTHING, OPEN, REPEATED, UNKNOWN = 0, 1, 2, 255


@dataclass
class Runs:
    """Runs of windows with the same leading digit: first and last window start, 64-bit digits of run and leader."""

    first: np.ndarray
    last: np.ndarray
    digit: np.ndarray
    lead: np.ndarray


class Hashes:
    """Polynomial hashes of any byte range of a block by one subtraction and one product."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, FACTOR)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]))
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size))


def blocks(data: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[tuple[int, Hashes, np.ndarray]]:
    """Pieces of a batch that overlap by depth - 1: where each begins, its hashes, and which windows lie in a text."""
    inside = np.ones(len(data) + 1, bool)
    for back in range(1, depth):  # a window must not reach over the end of its text
        at = bounds[1:] - back
        inside[at[at >= bounds[:-1]]] = False
    inside[len(data) :] = False
    for start in range(0, max(len(data) - depth + 1, 0), BLOCK):
        part = data[start : start + BLOCK + depth - 1]
        yield start, Hashes(part), inside[start : start + len(part) - depth + 1]


def find_runs(hashes: Hashes, inside: np.ndarray, depth: int, digit: int) -> Runs:
    """All runs of the windows of a block that lie within a text.

    The leader is chosen by the mod-minimizer scheme: the smallest of the window's short strings by hash, its place
    taken modulo the number of places a leading digit has. That changes leaders about every depth - digit bytes.
    """
    places = depth - digit + 1
    short = min(SHORT, digit)
    short += (digit - short) % places
    size = depth - short + 1
    order = hashes.all(short)
    bits = np.uint64(max(len(order), 2).bit_length())
    low = (order >> bits << bits) | np.arange(len(order), dtype=np.uint64)
    have = 1
    while have < size:  # minimum over `size` neighbours by doubling
        step = min(have, size - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    start = np.arange(len(low))
    leader = start + ((low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) - start) % places
    new = inside.copy()
    new[1:] &= (leader[1:] != leader[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= (leader[1:] != leader[:-1]) | ~inside[1:]
    last = np.flatnonzero(stop)
    lead = leader[first]
    whole = hashes.ranges(first, last + depth) + (lead - first).astype(np.uint64) * FACTOR
    return Runs(first, last, mix(whole), hashes.ranges(lead, lead + digit))


class Batch:
    """A few documents and the runs of their windows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, body: bytes, depth: int, digit: int):
        self.ids, self.depth = ids, depth
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blocks = []
        for start, hashes, inside in blocks(self.data, self.bounds, depth):
            runs = find_runs(hashes, inside, depth, digit)
            self.blocks.append((start, Runs(runs.first + start, runs.last + start, runs.digit, runs.lead)))

        def joined(field: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(getattr(r, field) for _, r in self.blocks)])

        places = [joined(f, np.int64) for f in ("first", "last")]
        self.runs = Runs(*places, *[joined(f, np.uint64) for f in ("digit", "lead")])

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The id of the document at each position."""
        return self.ids[np.searchsorted(self.bounds, at, side="right") - 1]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and full-depth digit of each window of the chosen runs."""
        at, digits, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for start, runs in self.blocks:
            own = np.flatnonzero(chosen[seen : seen + len(runs.first)])
            seen += len(runs.first)
            if len(own):
                first = runs.first[own]
                place = spread(first, runs.last[own] - first + 1)
                hashes = Hashes(self.data[start : start + BLOCK + self.depth - 1])
                at.append(place)
                digits.append(hashes.ranges(place - start, place - start + self.depth))
        return np.concatenate(at), np.concatenate(digits)


@dataclass
class Hot:
    """Digits that many batches have, in order, each with a document that has it."""

    digit: np.ndarray
    owner: np.ndarray

    def lowest_of(self, digit: np.ndarray) -> np.ndarray:
        """The known document of each digit, LAST for a digit that is not hot."""
        if not len(self.digit):
            return np.full(len(digit), LAST)
        at = np.minimum(np.searchsorted(self.digit, digit), len(self.digit) - 1)
        return np.where(self.digit[at] == digit, self.owner[at], LAST)

    @staticmethod
    def find(digits: DataFrame) -> Hot:
        """From the (digit, owner) rows of the sampled batches; at most MOST_HOT pairs reach the driver."""
        rows = (
            digits.groupBy("digit")
            .agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
            .where(F.col("n") >= HOT_BATCHES)
            .orderBy(F.desc("n"), "digit")
            .limit(MOST_HOT)
            .collect()
        )
        digit = np.array([r["digit"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(digit)
        return Hot(digit[order], np.array([r["owner"] for r in rows], np.int64)[order])


@dataclass
class Digits:
    """The distinct digits of a batch by bucket and smallest document, and which of them each item has."""

    bucket: np.ndarray
    digit: np.ndarray
    owner: np.ndarray
    item: np.ndarray
    # 32 bits of the leading digit beside the bucket; none in the last pass
    lead: np.ndarray
    # the state of digits that are not sent: repeated in a smaller document, or open as their leading digit is too full
    fixed: np.ndarray

    @staticmethod
    def of(
        digit: np.ndarray,
        owner: np.ndarray,
        lead: np.ndarray | None,
        buckets: int,
        hot: Hot,
        full: np.ndarray | None = None,
    ) -> Digits:
        """Digits are dealt to buckets by their leading digit, in the last pass by themselves. `full` are the leading
        digits, in order, whose runs are not told apart in this pass."""
        place = digit if lead is None else lead
        rest = np.zeros(len(digit), np.uint32) if lead is None else (lead & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((owner, digit))
        new = np.ones(len(order), bool)
        new[1:] = digit[order][1:] != digit[order][:-1]
        distinct = order[new]
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(new) - 1
        bucket = (mix(place[distinct] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        rank = np.lexsort((digit[distinct], owner[distinct], bucket))
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        found, owners = digit[distinct][rank], owner[distinct][rank]
        fixed = np.full(len(found), UNKNOWN, np.uint8)
        if full is not None and len(full):
            leads = lead[distinct][rank]
            at = np.minimum(np.searchsorted(full, leads), len(full) - 1)
            fixed[full[at] == leads] = OPEN
        fixed[hot.lowest_of(found) < owners] = REPEATED
        rest = rest[distinct][rank] if lead is not None else rest[:0]
        return Digits(bucket[rank], found, owners, back[item], rest, fixed)

    def rows(self, batch: int) -> Iterator[dict]:
        """One row per bucket: the digits by owner, and the owners with their number of digits."""
        sent = self.fixed == UNKNOWN
        bucket, digit, owners = (x[sent] for x in (self.bucket, self.digit, self.owner))
        lead = self.lead[sent] if len(self.lead) else self.lead
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, z in zip(cuts, cuts[1:], strict=False):
            owner, number = np.unique(owners[a:z], return_counts=True)
            yield {
                "bucket": int(bucket[a]),
                "batch": batch,
                "digits": digit[a:z].astype("<u8").tobytes(),
                "leads": lead[a:z].astype("<u4").tobytes(),
                "owners": owner.astype("<i8").tobytes(),
                "numbers": number.astype("<u4").tobytes(),
            }

    def states(self, answers: list[dict] | None) -> np.ndarray:
        """The state of each item from the buckets' answers, which come in any order."""
        answers = sorted(answers or [], key=lambda x: x["bucket"])
        own = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x["states"], np.uint8) for x in answers)])
        state = self.fixed.copy()
        if len(own) != np.count_nonzero(state == UNKNOWN):
            raise ValueError("the answers do not fit the batch's digits")
        state[state == UNKNOWN] = own
        return state[self.item]


DIGIT_ROWS = "bucket long, batch long, digits binary, leads binary, owners binary, numbers binary"
DIGIT_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("batch", pa.int64())]
    + [(n, pa.binary()) for n in ("digits", "leads", "owners", "numbers")]
)


def lowest(group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each item's group, and the smallest owner of each group."""
    values, number = np.unique(group, return_inverse=True)
    low = np.full(len(values), LAST)
    np.minimum.at(low, number, owner)
    return number, low


def judge(digit: np.ndarray, owner: np.ndarray, lead: np.ndarray | None) -> np.ndarray:
    """REPEATED where a smaller document has the digit; OPEN where, in pass 2, it may share windows with other runs."""
    number, low = lowest(digit, owner)
    state = np.where(owner > low[number], REPEATED, NOTHING).astype(np.uint8)
    if lead is not None:
        # per leading digit the smallest and the largest first owner of its runs
        lead_of = np.empty(len(low), lead.dtype)
        lead_of[number] = lead
        top, least = lowest(lead_of, low)
        most = np.full(len(least), -LAST)
        np.maximum.at(most, top, low)
        mixed = (least < most)[top]
        state[(state == NOTHING) & mixed[number]] = OPEN
    return state


def answer(sent: DataFrame, leading: bool) -> DataFrame:
    """(batch, answers): for every digit that a batch sent its state."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["batch", "bucket", "digits", "leads", "owners", "numbers"]).to_pylist()
        digits = [np.frombuffer(r["digits"], "<u8") for r in rows]
        owners = [
            np.repeat(np.frombuffer(r["owners"], "<i8"), np.frombuffer(r["numbers"], "<u4").astype(np.int64))
            for r in rows
        ]
        leads = np.concatenate([np.frombuffer(r["leads"], "<u4") for r in rows]) if leading else None
        state = judge(np.concatenate(digits), np.concatenate(owners), leads)
        cuts = np.cumsum([0, *map(len, digits)])
        return pa.table(
            {
                "batch": pa.array([r["batch"] for r in rows], pa.int64()),
                "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
                "states": pa.array([state[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            }
        )

    answers = sent.groupBy("bucket").applyInArrow(run, "batch long, bucket long, states binary")
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "states")).alias("answers"))


def store(docs: DataFrame, batch_bytes: int, total: int) -> DataFrame:
    """The documents in compressed batches: batch, ids, sizes in bytes, body; a table bucketed by batch.

    Each pass joins its answers to the batches. Bucketing lets the batches stay where they are: only answers move. Every
    bucket is written by one task, so there is one file for each. The table's name is dropped at once; its files are
    read by path.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        for part in parts:
            for a, z in passes(part.column(1), batch_bytes):
                texts = [t.encode() for t in part.column(1).slice(a, z - a).to_pylist()]
                yield pa.record_batch(
                    {
                        "batch": pa.array([number], pa.int64()),
                        "ids": pa.array([part.column(0).slice(a, z - a).to_pylist()], pa.list_(pa.int64())),
                        "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                        "body": pa.array([packer.compress(b"".join(texts))], pa.binary()),
                    }
                )
                number += 1

    batches = docs.mapInArrow(run, "batch long, ids array<long>, sizes array<long>, body binary")
    spark, name = docs.sparkSession, f"suffix_batches_{uuid.uuid4().hex}"
    path = new_folder(spark, "suffix-batches")
    parts = store_buckets(total)
    batches.repartition(parts, "batch").write.option("path", path).bucketBy(parts, "batch").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now, so the catalog is not asked again
    spark.sql(f"DROP TABLE {name}")
    return table


def store_buckets(total: int) -> int:
    """Buckets for so many bytes of text, within what Spark allows."""
    return min(max(1, -(-total // STORE_BYTES)), MOST_BUCKETS)


def full_leads(counts: DataFrame, step: int) -> np.ndarray:
    """The leading digits with over LEAD_DIGITS runs, in order, as far as the sampled batches tell (lead, runs).

    Every batch sends each of its different runs once, so `step` times the sampled ones are expected to meet. There are
    at most as many such leading digits as LEAD_DIGITS goes into the sampled runs times `step`.
    """
    rows = counts.groupBy("lead").agg(F.sum("runs").alias("n")).where(F.col("n") * step > LEAD_DIGITS).collect()
    return np.sort(np.array([r["lead"] for r in rows], np.int64).view(np.uint64))


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    depth: int = DEPTH,
    digit: int = DIGIT,
    batch_bytes: int = BATCH_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """Per document the bytes left when all repeats of earlier documents are cut out.

    A byte goes if it is covered by a string of `depth` bytes that also starts in a document with a smaller id, judged
    on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (hex digest of the
    remaining bytes), with `with_text` also `kept`, the remaining bytes. A null text is empty. A null id counts as
    larger than any other. Rows with equal ids do not remove each other's bytes. An empty table gives an empty result;
    other columns are not read. Runs and windows count as equal when their 64-bit hashes are: bytes are not compared, so
    among n different windows about n * n / 2**65 pairs are expected to be taken for equal.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = store(rows, batch_bytes, total)
    step = max(1, -(-total // batch_bytes) // SAMPLE_BATCHES)
    sampled = F.pmod(F.xxhash64("batch"), F.lit(step)) == 0
    nothing = Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    buckets = max(1, -(-total // (RUN_BYTES * BUCKET_DIGITS)))

    def opened(row: dict, hot: Hot, full: np.ndarray) -> tuple[Batch, Digits]:
        ids = np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        batch = Batch(ids, np.array(row["sizes"], np.int64), row["body"], depth, digit)
        owners = batch.owners(batch.runs.first)
        return batch, Digits.of(batch.runs.digit, owners, batch.runs.lead, buckets, hot, full)

    def open_windows(batch: Batch, state: np.ndarray, hot: Hot) -> tuple[np.ndarray, Digits]:
        at, digits = batch.windows(state == OPEN)
        return at, Digits.of(digits, batch.owners(at), None, buckets, hot)

    def pairs(digits: Digits) -> pa.RecordBatch:
        return pa.record_batch({"digit": pa.array(digits.digit.view(np.int64)), "owner": pa.array(digits.owner)})

    def run_states(batch: Batch, digits: Digits, answers: list[dict]) -> np.ndarray:
        """Within the batch a run is also repeated if a smaller document of the batch has it."""
        state = digits.states(answers)
        state[batch.owners(batch.runs.first) > digits.owner[digits.item]] = REPEATED
        return state

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for i in range(part.num_rows):
                yield part.slice(i, 1).to_pylist()[0]

    def sample_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch, digits = opened(row, nothing, no_leads)
            runs = np.unique(np.stack([batch.runs.lead, batch.runs.digit]), axis=1)[0]
            leads, number = np.unique(runs, return_counts=True)
            yield pa.record_batch(
                {
                    "digit": pa.array(np.concatenate([digits.digit, leads]).view(np.int64)),
                    "owner": pa.array(np.concatenate([digits.owner, np.zeros(len(leads), np.int64)])),
                    "runs": pa.array(np.concatenate([np.zeros(len(digits.digit), np.int64), number])),
                }
            )

    no_leads = np.zeros(0, np.uint64)
    seen = keep(batches.where(sampled).mapInArrow(sample_runs, "digit long, owner long, runs long"), "suffix-sample")
    hot_runs = Hot.find(seen.where("runs = 0"))
    full = full_leads(seen.where("runs > 0").withColumnRenamed("digit", "lead"), step)

    def send_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            _, digits = opened(row, hot_runs, full)
            yield pa.RecordBatch.from_pylist(list(digits.rows(row["batch"])), DIGIT_SCHEMA)

    run_answers = keep(answer(batches.mapInArrow(send_runs, DIGIT_ROWS), True), "suffix-run-answers")
    known = batches.join(run_answers, "batch", "left")

    def sample_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch, digits = opened(row, hot_runs, full)
            yield pairs(open_windows(batch, run_states(batch, digits, row["answers"]), nothing)[1])

    hot_windows = Hot.find(known.where(sampled).mapInArrow(sample_windows, "digit long, owner long"))

    def send_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch, digits = opened(row, hot_runs, full)
            _, windows = open_windows(batch, run_states(batch, digits, row["answers"]), hot_windows)
            yield pa.RecordBatch.from_pylist(list(windows.rows(row["batch"])), DIGIT_SCHEMA)

    window_answers = answer(known.mapInArrow(send_windows, DIGIT_ROWS), False)
    window_answers = keep(window_answers.withColumnRenamed("answers", "window_answers"), "suffix-window-answers")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch, digits = opened(row, hot_runs, full)
            state = run_states(batch, digits, row["answers"])
            at, windows = open_windows(batch, state, hot_windows)
            repeated = windows.states(row["window_answers"]) == REPEATED
            repeated |= batch.owners(at) > windows.owner[windows.item]
            whole = state == REPEATED
            change = np.zeros(len(batch.data) + depth + 1, np.int32)
            np.add.at(change, batch.runs.first[whole], 1)
            np.add.at(change, batch.runs.last[whole] + depth, -1)
            np.add.at(change, at[repeated], 1)
            np.add.at(change, at[repeated] + depth, -1)
            gone = np.cumsum(change)[: len(batch.data)] > 0
            out = {"doc_id": row["ids"], "n_bytes": row["sizes"], "n_removed": [], "n_spans": [], "kept_sha256": []}
            texts = []
            for a, z in zip(batch.bounds, batch.bounds[1:], strict=False):
                own = gone[a:z]
                left = batch.data[a:z][~own].tobytes()
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            if with_text:
                out["kept"] = pa.array(texts, pa.binary())
            out["doc_id"] = pa.array(row["ids"], pa.int64())
            yield pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return known.join(window_answers, "batch", "left").mapInArrow(cut, schema + (", kept binary" if with_text else ""))
