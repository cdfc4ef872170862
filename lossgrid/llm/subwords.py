"""Distinct words of a batch of texts and hashed n-grams of them, all as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The distinct words, the word number at each place of the texts, and where each text begins (and the end)."""

    names: pa.Array
    index: np.ndarray
    bounds: np.ndarray


def split_words(texts: pa.Array, letters: bool) -> Words:
    """White-space separated words as they are, or the lower-cased runs of letters."""
    texts = texts.cast(pa.string())
    if letters:
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    split = pc.utf8_split_whitespace(texts)
    flat, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    real = pc.utf8_length(names).to_numpy() > 0
    if not real.all():  # empty words at the ends of a text
        used = real[index]
        at = np.concatenate([[0], np.cumsum(used)])[at]
        index = (np.cumsum(real) - 1)[index[used]]
        names = names.filter(pa.array(real))
    return Words(names, index, at)


def mix(numbers: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers, so that their top bits can serve as buckets."""
    numbers = numbers * FACTOR
    numbers ^= numbers >> np.uint64(29)
    return numbers * FACTOR


def bucket(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (mix(numbers) >> np.uint64(64 - bits)).astype(np.int64)


def characters(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each within < and >, and where each word begins (and the end)."""
    sizes = pc.utf8_length(names).to_numpy().astype(np.int64) + 2
    text = "".join(f"<{w}>" for w in names.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def word_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit number for each word."""
    if not len(names):
        return np.zeros(0, np.uint64)
    codes, bounds = characters(names)
    powers = np.cumprod(np.full(int(np.diff(bounds).max()), FACTOR, np.uint64))
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.add.reduceat((codes + np.uint64(1)) * powers[place], bounds[:-1])


def ngrams(names: pa.Array, smallest: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, 64-bit hash) of all character n-grams of each word within < and >, in no special order."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(names):
        codes, bounds = characters(names)
        word = np.repeat(np.arange(len(names)), np.diff(bounds))
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(codes))
        value = codes.copy()
        for n in range(1, largest + 1):
            if n > 1:
                value = value[:-1] * FACTOR + codes[n - 1 :]
            if n >= smallest:
                whole = left[: len(value)] >= n
                owners.append(word[: len(value)][whole])
                hashes.append(value[whole] + np.uint64(n))
    return np.concatenate(owners), np.concatenate(hashes)
