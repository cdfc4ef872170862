"""Byte-level BPE ids of many texts at once, with their byte spans."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = "<|endoftext|>"
# bytes of text that one pass over a batch may hold
PASS_BYTES = 4 << 20
# a single space between two other characters is a cut that no token ever spans
CUT = re.compile(r"(?<=\S) (?=\S)")
# texts in which the plain cut at every space could part a run of white space, or that may hold other white space
ODD = r"\s\s|[\x0b\x{85}\x{a0}]|[^\x00-\x{24f}]"
# words of other scripts go through the tokenizers library: two regular expression engines may class them differently
OTHER = r"[^\x09\x0a\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{24f}]|<\|"
MEMO_WORDS = 60_000


class Encoder:
    """Token ids by a public byte-level vocabulary.

    Texts are cut at single spaces, where the vocabulary's own split always cuts, so each distinct word of a batch is
    encoded once. Plain Latin words go through the vocabulary's rank file, which gives the same ids faster; all others,
    and words that hold the end-of-text mark, through the tokenizers library.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.widths = np.zeros(self.slow.get_vocab_size(), np.int64)
        for token, number in table.items():
            self.widths[number] = len(token)
        self.widths[self.slow.token_to_id(END_OF_TEXT)] = len(END_OF_TEXT)
        self.memo: dict[str, list[int]] = {}

    def words(self, words: list[str], other: list[bool]) -> list[list[int]]:
        """The ids of each word; `other` tells which of them the rank file is not used for."""
        memo, plain = self.memo, self.fast.encode_ordinary
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = list(map(memo.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                out[i] = ids = self.slow.encode(w, add_special_tokens=False).ids if other[i] else plain(w)
                if len(memo) <= MEMO_WORDS and len(w) < 32:
                    memo[w] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the offset at which each text's ids begin (and the end)."""
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]).astype(np.int64)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        slow = [CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        words = pa.concat_arrays([split.flatten(), pa.array([w for s in slow for w in s], pa.string())])
        counts = np.concatenate([np.diff(split.offsets.to_numpy()), np.fromiter(map(len, slow), np.int64, len(slow))])
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

        coded = words.dictionary_encode()
        index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # a word stands for itself at the start of a text and has a space in front elsewhere
        first = np.zeros(len(words), bool)
        first[at[:-1]] = True
        index += np.where(first, len(names), 0)
        seen = np.zeros(2 * len(names), bool)
        seen[index] = True
        used = np.flatnonzero(seen)
        index = (np.cumsum(seen) - 1)[index]
        strings = names.take(pa.array(used % max(len(names), 1)))
        other = pc.match_substring_regex(strings, OTHER).to_pylist()
        spaced = [w if u >= len(names) else " " + w for w, u in zip(strings.to_pylist(), used.tolist(), strict=True)]
        ids = self.words(spaced, other)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))

        # words in the order of the texts again, then the ids of each word
        begins = np.empty(len(order), np.int64)
        begins[order] = at[:-1]
        sizes = np.empty(len(order), np.int64)
        sizes[order] = counts
        index = index[spread(begins, sizes)]
        bounds = np.concatenate([[0], np.cumsum(lengths[index])])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat[spread((np.cumsum(lengths) - lengths)[index], lengths[index])], bounds


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for `size` numbers, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(begins - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    """One encoder per process and vocabulary."""
    return Encoder(vocabulary, ranks)


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> list[tuple[int, int]]:
    """Cut a batch into runs of rows of about `limit` bytes; a longer text is a run of its own."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    cuts, start = [], 0
    while start < len(total):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        cuts.append((start, end))
        start = end
    return cuts
