"""Token counts per section: whole documents are encoded once, tokens are joined to sections by their byte spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import text_or_empty
from lossgrid.llm.tokens import RANKS, VOCABULARY, encoder, passes


def lines(text: str = "text") -> Column:
    """The lines of a text, each with the line break that ends it; an empty text is one empty line."""
    parts = F.split(text_or_empty(text), r"(?<=\n)")
    full = F.filter(parts, lambda x: x != "")
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit("")))


def fields(*names: str, separator: str = "\n") -> Column:
    """Several columns as the sections of one document; a separator belongs to the field it follows."""
    parts = [text_or_empty(n) for n in names]
    return F.array(*[F.concat(p, F.lit(separator)) for p in parts[:-1]], parts[-1])


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and the positions of the tokens that cross a boundary.

    Section i covers the bytes from bounds[i] to bounds[i + 1]. A token that crosses boundaries belongs to the section
    that holds most of its bytes; of equal parts, to the first.
    """
    first = np.searchsorted(bounds, start, side="right") - 1
    last = np.searchsorted(bounds, end, side="left") - 1
    crossing = np.flatnonzero(first != last)
    for i in crossing.tolist():
        inner = np.clip(bounds[first[i] : last[i] + 2], start[i], end[i])
        first[i] += int(np.argmax(np.diff(inner)))
    return first, crossing


def section_tokens(
    df: DataFrame, parts: Column, id_column: str = "doc_id", vocabulary: str = VOCABULARY, ranks: str = RANKS
) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing) for each section of each row.

    `parts` is an array of strings: the sections, whose concatenation is the document. `start` and `end` are byte
    offsets in it, `tokens` the ids attributed to the section, `crossing` how many of them also cover other sections.
    So the tokens of a document's sections add up to the ids of its whole text. A null section counts as empty, an
    empty section has no tokens; a row with a null or empty array has no sections and gives none. Repeated rows are
    counted one by one; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, ranks)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().cast(pa.string())
            cut = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
            edge = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
            edge = edge if len(edge) else np.zeros(1, np.int32)
            docs = pa.StringArray.from_buffers(len(column), pa.py_buffer(edge[cut].copy()), flat.buffers()[2])
            for a, z in passes(docs):
                ids, at = coder.encode(docs.slice(a, z - a))
                bounds = edge[cut[a] : cut[z] + 1].astype(np.int64) - int(edge[cut[a]])
                end = np.cumsum(coder.widths[ids])
                n = len(bounds) - 1
                if (len(end) and end[-1] != bounds[-1]) or at[-1] != len(ids):
                    raise ValueError("token spans do not cover the text")
                section, crossing = attribute(end - coder.widths[ids], end, bounds)
                row = np.repeat(np.arange(z - a), np.diff(cut[a : z + 1]))
                first = cut[a:z][row] - cut[a]
                base = bounds[first]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).take(pa.array(row + a)),
                        "section": pa.array(np.arange(n) - first),
                        "start": pa.array(bounds[:-1] - base),
                        "end": pa.array(bounds[1:] - base),
                        "tokens": pa.array(np.bincount(section, minlength=n)),
                        "crossing": pa.array(np.bincount(section[crossing], minlength=n)),
                    }
                )

    sections = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), sections.alias("parts"))
    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, tokens long, crossing long")
