"""Line dedup: repeated passages of lines, found by all least windows of lines or by content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossgrid.llm.common import keep, lookup, text_or_empty
from lossgrid.llm.tokens import passes
from lossgrid.session import bound_arrow_batches

# a chunk ends after a line at which the rolling hash of the last WINDOW lines is 0 modulo DIVISOR
WINDOW = 2
DIVISOR = 2
LEAST_LINES = 2
MOST_LINES = 32
# texts that a task takes up as Python objects at a time, about
PASS_BYTES = 2 << 20
# chunk lists of so many bytes in all may be broadcast; beyond it the same join shuffles
BROADCAST_BYTES = 32 << 20
# chunks with fewer characters or fewer lines that are not blank are never removed
LEAST_CHARACTERS = 64
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def chunks(text: str) -> list[str]:
    """The text's lines in chunks; the chunks put together are the text.

    The rolling hash is the sum of the line hashes of the window, each times a power of FACTOR. So a boundary depends on
    the lines before it alone, and chunks fall into step again soon after an inserted or deleted line. A rest shorter
    than LEAST_LINES stays with the chunk before it.
    """
    lines = split_lines(text)
    return ["".join(lines[a:z]) for a, z in chunk_spans(lines)]


def chunk_spans(lines: list[str]) -> list[tuple[int, int]]:
    """The first line of each chunk and the line after its last one."""
    out, start, last = [], 0, []
    for i, line in enumerate(lines, 1):
        last = [*last, xxhash.xxh64_intdigest(line.strip())][-WINDOW:]
        rolling = 0
        for h in last:
            rolling = (rolling * FACTOR + h) & MASK
        length = i - start
        if length >= MOST_LINES or length >= LEAST_LINES and (rolling >> 32) % DIVISOR == 0:
            out.append((start, i))
            start = i
    if start < len(lines):
        if out and len(lines) - start < LEAST_LINES:
            out[-1] = (out[-1][0], len(lines))
        else:
            out.append((start, len(lines)))
    return out


def split_lines(text: str) -> list[str]:
    """Lines with the line feed that ends them."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def body(chunk: str) -> str | None:
    """What is compared of a chunk: all of it but the last line break; None for a chunk that is too small to count."""
    if len(chunk) < LEAST_CHARACTERS or sum(1 for line in chunk.split("\n") if line.strip()) < LEAST_LINES:
        return None
    return chunk.removesuffix("\n")


def windows(text: str) -> list[tuple[int, int]]:
    """The least windows of a text, as first and last line, in order.

    A window begins and ends at a line that is not blank, has LEAST_LINES such lines and LEAST_CHARACTERS characters
    without its last line break. For every such line the shortest window that begins there and the shortest one that
    ends there are listed. Both depend on the window's own lines alone, so equal passages have equal windows, and a
    passage that is large enough to count is covered by the windows inside it.
    """
    starts, ends, full = _bounds(text)
    out = set()
    b = 0
    for a in range(len(full) - LEAST_LINES + 1):
        b = max(b, a + LEAST_LINES - 1)
        while b < len(full) and ends[full[b]] - starts[full[a]] < LEAST_CHARACTERS:
            b += 1
        if b == len(full):
            break
        out.add((full[a], full[b]))
    a = 0
    for b in range(LEAST_LINES - 1, len(full)):
        if ends[full[b]] - starts[full[a]] < LEAST_CHARACTERS:
            continue
        while a + LEAST_LINES <= b and ends[full[b]] - starts[full[a + 1]] >= LEAST_CHARACTERS:
            a += 1
        out.add((full[a], full[b]))
    return sorted(out)


def _bounds(text: str) -> tuple[list[int], list[int], list[int]]:
    """Where each line begins and where it ends without its line break, and the numbers of lines that are not blank."""
    starts, ends, full, at = [], [], [], 0
    for i, line in enumerate(text.split("\n")):
        starts.append(at)
        ends.append(at + len(line))
        at += len(line) + 1
        if line.strip():
            full.append(i)
    return starts, ends, full


def window_bodies(text: str) -> list[str]:
    """What is compared of each window: its bytes without the last line break."""
    starts, ends, _ = _bounds(text)
    return [text[starts[a] : ends[z]] for a, z in windows(text)]


def chunk_bodies(text: str) -> list[str | None]:
    return [body(chunk) for chunk in chunks(text)]


def windows_inside(text: str, numbers: list[int]) -> set[int]:
    """The numbers of the windows that lie in one of these chunks."""
    spans, lines = chunk_spans(split_lines(text)), {}
    for n in numbers:
        lines.update(dict.fromkeys(range(*spans[n]), n))
    return {w for w, (a, z) in enumerate(windows(text)) if a in lines and lines[a] == lines.get(z)}


def _small(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few MB of text, so that only so much is ever held as Python objects."""
    for batch in batches:
        for a, z in passes(batch.column(texts), PASS_BYTES):
            yield batch.slice(a, z - a)


def _digest(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def repeated_chunks(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bodies_of: Callable[[str], list[str | None]] = chunk_bodies,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """(id, hash, chunks): the numbers of the chunks that are not the first of their kind, by document.

    With `seeds`, a result of this function for chunks, windows inside those chunks are left out: they are known not to
    be the first of their kind, as the first chunk of the same bytes has equal ones.
    `bodies_of` gives what is compared of a text's chunks, or of its windows; None is never compared.

    A document is a distinct pair of id and text, so repeated rows are one document; `hash` is Spark's xxhash64 of the
    text. Of equal chunks the first stays: smallest id (null last), then text hash, then place in the document. Digests
    find the candidates; only of these the texts move, and they are grouped by the bytes themselves, so two texts with
    one digest are told apart.
    """
    bound_arrow_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text")
    ).withColumn("hash", F.xxhash64("text"))

    none = F.lit(None).cast("array<long>").alias("chunks")
    seeded = rows.select("*", none) if seeds is None else _with_chunks(rows, seeds, "left")

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            out = {"id": [], "hash": [], "chunk": [], "digest": []}
            for i, text, h, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = windows_inside(text, numbers) if numbers else ()
                for n, found in enumerate(bodies_of(text)):
                    if found is not None and n not in known:
                        for k, v in (("id", i), ("hash", h), ("chunk", n), ("digest", _digest(found))):
                            out[k].append(v)
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in out.items()})

    pointers = seeded.select("id", "text", "hash", "chunks").mapInArrow(point, "id long, hash long, chunk long, digest long").distinct()
    pointers = keep(pointers, "line-pointers")
    repeated = pointers.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    candidates = keep(lookup(pointers, repeated, "digest", "inner"), "line-candidates")

    wanted = candidates.groupBy("id", "hash").agg(F.collect_list("chunk").alias("chunks"))
    wanted = keep(wanted, "line-wanted")
    texts = _with_chunks(rows, wanted, "inner")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            out = {"id": [], "hash": [], "chunk": [], "body": []}
            for i, text, h, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = bodies_of(text)
                for n in numbers:
                    for k, v in (("id", i), ("hash", h), ("chunk", n), ("body", parts[n])):
                        out[k].append(v)
            yield pa.record_batch(
                {k: pa.array(v, pa.string() if k == "body" else pa.int64()) for k, v in out.items()}
            )

    place = F.struct(F.isnull("id").alias("no_id"), "id", "hash", "chunk")
    first = (
        texts.select("id", "text", "hash", "chunks")
        .mapInArrow(bodies, "id long, hash long, chunk long, body string")
        .groupBy("body")
        .agg(F.min(place).alias("first"))
        .select("first.id", "first.hash", "first.chunk")
    )
    same = [candidates[c].eqNullSafe(F.col(f"first_{c}")) for c in ("id", "hash", "chunk")]
    first = first.select(*[F.col(c).alias(f"first_{c}") for c in ("id", "hash", "chunk")])
    gone = candidates.join(first, same[0] & same[1] & same[2], "left_anti")
    return keep(gone.groupBy("id", "hash").agg(F.collect_list("chunk").alias("chunks")), "line-gone")


def _with_chunks(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Rows with the chunk list of their document; broadcast while the lists have few bytes, however many they are."""
    lists = lists.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("chunks"))
    size = lists.agg(F.sum(64 + 8 * F.size("chunks"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    on = rows["hash"].eqNullSafe(F.col("_hash")) & rows["id"].eqNullSafe(F.col("_id"))
    return rows.join(lists, on, how).drop("_id", "_hash")


def remove_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count_column: str = "lines_removed"
) -> DataFrame:
    """`docs` with all their columns, the text without repeated chunks of lines, and `count_column` as last column.

    A chunk is removed if an equal one stands in an earlier document or earlier in the same one. Chunks of less than
    LEAST_LINES lines that are not blank or of less than LEAST_CHARACTERS characters stay, and so do one-line texts.
    A null text stays null, an empty one empty. Rows that repeat id and text are one document and are edited alike.
    An empty table gives an empty result. Other columns are passed through, whatever
    their names; one called like `count_column` is replaced.
    """
    gone = repeated_chunks(docs, id_column, text_column)
    return _edited(docs, id_column, text_column, count_column, gone, without_chunks)


def remove_repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count_column: str = "lines_removed"
) -> DataFrame:
    """Like `remove_repeated_lines`, but every repeated passage goes, whatever stands around it.

    A passage is a run of lines with LEAST_LINES lines that are not blank and LEAST_CHARACTERS characters at least. It is
    removed if an equal one stands in an earlier document or ends before it in the same one. Blank lines at either end of
    a passage stay. As a line goes only with an equal one before it, the first of each kind stays.

    Content-defined chunks find the repeats that both places cut alike. They are the seeds: what they cover is settled,
    and an exact pass over the least windows outside them grows them to whole passages and finds those without a seed.
    """
    seeds = repeated_chunks(docs, id_column, text_column)
    gone = repeated_chunks(docs, id_column, text_column, window_bodies, seeds)
    return _edited(docs, id_column, text_column, count_column, gone, without_windows, seeds)


def without_chunks(text: str, numbers: list[int]) -> tuple[str, int]:
    """The text without these chunks, and the number of lines removed."""
    drop, parts = set(numbers), chunks(text)
    left = "".join(p for n, p in enumerate(parts) if n not in drop)
    return left, sum(len(split_lines(p)) for n, p in enumerate(parts) if n in drop)


def without_windows(text: str, numbers: list[int]) -> tuple[str, int]:
    """The text without these windows, and the number of lines removed.

    A window that overlaps the first one of its kind is left: that one stands in this text if its number is not listed.
    """
    lines, drop, gone, first = split_lines(text), set(numbers), set(), {}
    for n, ((a, z), found) in enumerate(zip(windows(text), window_bodies(text), strict=True)):
        if n not in drop:
            first.setdefault(found, z)
        elif first.get(found, -1) < a:
            gone.update(range(a, z + 1))
    return "".join(line for i, line in enumerate(lines) if i not in gone), len(gone)


def _edited(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    count_column: str,
    gone: DataFrame,
    without: Callable[[str, list[int]], tuple[str, int]],
    seeds: DataFrame | None = None,
) -> DataFrame:
    """The rows without the chunks, or windows, of `gone` and without the windows inside the chunks of `seeds`."""
    bound_arrow_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (count_column, text_column)]
    rows = docs.select(
        # the text moves once, beside the row's other columns; an empty struct cannot go to Python
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(True)]).alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).cast("string").alias("text"),
        F.xxhash64(text_or_empty(text_column)).alias("hash"),
    )
    marked = _with_chunks(rows, gone, "left").withColumnRenamed("chunks", "numbers")
    none = F.lit(None).cast("array<long>").alias("chunks")
    marked = marked.select("*", none) if seeds is None else _with_chunks(marked, seeds, "left")
    marked = marked.select("row", "text", "numbers", "chunks")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            out, number = [], []
            for text, numbers, known in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if known and text is not None:
                    numbers = sorted(windows_inside(text, known).union(numbers or ()))
                left, removed = without(text, numbers) if numbers and text is not None else (text, 0)
                out.append(left)
                number.append(removed)
            columns = [batch.column(0), pa.array(out, pa.string()), pa.array(number, pa.int64())]
            yield pa.record_batch(columns, ["row", "edited", "n"])

    schema = StructType([marked.schema["row"]]).add("edited", "string").add("n", "long")
    edited = marked.mapInArrow(edit, schema)
    columns = [
        F.col("edited" if c == text_column else f"row.`{c}`").alias(c) for c in docs.columns if c != count_column
    ]
    return edited.select(*columns, F.col("n").alias(count_column))
