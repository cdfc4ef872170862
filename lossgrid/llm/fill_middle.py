"""Fill-in-middle: texts are cut at unit borders found by arithmetic on 64-bit words, and put in another order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import text_or_empty
from lossgrid.llm.tokens import passes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
# of 100 documents so many are rearranged, and of 100 of these so many have the suffix first
RATE = 90
SUFFIX_FIRST = 20
# texts are worked on in groups of about this many bytes
PASS_BYTES = 1 << 22

# fixed values: one bit, or one number, in each of the eight bytes of a word
TOP = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)
ONE, SEVEN, FIFTY_SIX = np.uint64(1), np.uint64(7), np.uint64(56)


class Marks:
    """Marked bytes of a buffer, as words with the top bit of each marked byte, with rank and select on them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bytes are marked."""
        word, rest = at >> 3, (at & 7).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((ONE << (rest << np.uint64(3))) - ONE)
        return self.before[word] + np.bitwise_count(inside)

    def select(self, count: np.ndarray) -> np.ndarray:
        """The place behind the byte with the `count`-th mark, counted from 1.

        The word is found by searching the running counts. In the word, a product with ONES gives each byte the number of
        marks up to it; the bytes whose number is still too small are counted.
        """
        word = np.searchsorted(self.before, count, side="left") - 1
        inner = (count - self.before[word]).astype(np.uint64)
        upto = (self.words[word] >> SEVEN) * ONES
        # numbers are at most 8, so number + 0x80 - wanted keeps its top bit exactly where the number is large enough
        reached = ((upto | TOP) - inner * ONES) & TOP
        return (word << 3) + 8 - np.bitwise_count(reached) + 1


def letters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is one of A-Z and a-z."""
    low = (words | ONES * np.uint64(0x20)) & ~TOP
    return (low + ONES * np.uint64(0x80 - 0x61)) & ~(low + ONES * np.uint64(0x80 - 0x7B)) & ~words & TOP


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that continues a UTF-8 character."""
    return words & ~(words << ONE) & TOP


def following(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark moved to the byte before it."""
    return (marks >> np.uint64(8)) | np.append(marks[1:] << FIFTY_SIX, np.uint64(0))


@dataclass
class Units:
    """The ends of units and the first bytes of characters of several texts in one buffer."""

    ends: Marks
    starts: Marks


def units(data: np.ndarray, bounds: np.ndarray) -> Units:
    """Units of the texts data[bounds[i]:bounds[i + 1]], which fill the buffer.

    A unit is a run of letters A-Z and a-z, or any other single character. So a byte ends a unit unless the next byte of
    its text continues its character, or both are letters.
    """
    size = len(data)
    words = np.concatenate([data, np.zeros(-size % 8, np.uint8)]).view("<u8")
    letter, inner = letters(words), continuations(words)
    ends = ~((letter & following(letter)) | following(inner)) & TOP
    flat = ends.view(np.uint8)
    flat[bounds[1:][np.diff(bounds) > 0] - 1] = 0x80  # the last byte of a text ends a unit, whatever text comes next
    flat[size:] = 0
    starts = ~inner & TOP
    starts.view(np.uint8)[size:] = 0
    return Units(Marks(ends), Marks(starts))


def draws(id_column: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row: its text rearranged for infilling.

    A text of n units (runs of A-Z and a-z, or other single code points) is cut behind two drawn numbers of units, both
    from 0 to n. Form `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text as
    it is: of `100 - rate` of 100 documents, of empty texts, and of texts that contain one of the three marks. The
    draws depend on seed and id alone, so repeated rows come out alike. A null text is empty, a null id draws as an
    empty one. Lengths are in code points, null for plain texts. An empty table gives an empty result; other columns
    are not read. Texts are worked on in groups of a few MB, a longer text by itself and whole.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            drawn = [c.to_numpy() for c in batch.columns[2:]]
            for a, z in passes(texts, PASS_BYTES):
                part = texts.slice(a, z - a)
                bounds = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
                first, bounds = int(bounds[0]), bounds.astype(np.int64) - int(bounds[0])
                raw = part.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[first : first + bounds[-1]] if raw and bounds[-1] else np.zeros(0, np.uint8)
                found = units(data, bounds)
                ranks = found.ends.rank(bounds)
                n, base = np.diff(ranks), ranks[:-1]
                h1, h2, h3, h4 = (d[a:z] for d in drawn)
                one, two = h1 % (n + 1), h2 % (n + 1)
                cuts = []
                for k in (np.minimum(one, two), np.maximum(one, two)):
                    at = bounds[:-1].copy()
                    inside = k > 0
                    at[inside] = found.ends.select((base + k)[inside])
                    cuts.append(at)
                chars = [np.diff(found.starts.rank(np.stack(x)), axis=0)[0] for x in ((bounds[:-1], cuts[0]), cuts)]
                whole = data.tobytes()
                forms, outputs = [], []
                for i, (start, x, y, end) in enumerate(zip(bounds[:-1].tolist(), *(c.tolist() for c in cuts), bounds[1:].tolist(), strict=True)):
                    text = whole[start:end]
                    if not text or h3[i] % 100 >= rate or any(mark in text for mark in marks):
                        forms.append("plain")
                        outputs.append(text)
                    elif h4[i] % 100 < suffix_first:
                        forms.append("spm")
                        outputs.append(b"".join((s, whole[y:end], p, whole[start:x], m, whole[x:y])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, whole[start:x], s, whole[y:end], m, whole[x:y])))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(a, z - a),
                        "n": pa.array(n, pa.int64()),
                        "form": pa.array(forms, pa.string()),
                        "prefix_chars": pa.array(chars[0], pa.int64(), mask=plain),
                        "middle_chars": pa.array(chars[1], pa.int64(), mask=plain),
                        "output": pa.array(outputs, pa.binary()).cast(pa.string()),
                    }
                )

    ident = F.col(id_column).cast("long")
    hashes = [h.alias(f"h{i}") for i, h in enumerate(draws(ident, seed), 1)]
    rows = docs.select(ident.alias("doc_id"), text_or_empty(text_column).alias("text"), *hashes)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    No text that was rearranged contains a mark, so the first two marks and the last one are the borders.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring(output, F.lit(1), F.length(output) - F.length(middle) - len(MIDDLE))

    def pieces(mark: str) -> tuple[Column, Column]:
        first = F.substring_index(rest, mark, 1)
        head = F.substring(first, F.lit(len(mark) + 1), F.length(first))  # all marks have one length
        return head, F.substring(rest, F.length(first) + len(mark) + 1, F.length(rest))

    prefix, suffix = pieces(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = pieces(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
