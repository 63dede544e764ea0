"""Token ids of whole texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import itertools
import os
from functools import cache

import numpy as np
import pyarrow as pa

from starloom.llm import words

#: A worker keeps the ids of so many distinct words (40 bytes each) in so many slots (12 bytes
#: each); a word whose slot another has taken is encoded again.
KEPT_WORDS = 500_000
SLOTS = 1 << 21
WORDS_AT_ONCE = 250_000


class WordEncoder:
    """Encodes words one by one and keeps the ids of those it has met.

    Right for tokenizers that drop white space and never join what it separates: their ids of a
    text are those of its words, one after the other. Words are known by their 64-bit hashes.
    Small ASCII letters pass such tokenizers' text steps unchanged, so words of them go straight
    to the tokenizer's model; `__init__` checks both on an example.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator_id = self.tokenizer.encode("a | a", add_special_tokens=False).ids[1]
        self._forget()
        example = "abc don't  stop thelyther, 12 x."
        if not np.array_equal(self.encode(pa.array([example]))[0], self.encode_one(example)):
            raise ValueError(f"{path} does not encode a text word by word")

    def _forget(self) -> None:
        """Kept words: slot (low bits of the hash) -> hash and number; number -> its run of `ids`."""
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_word = np.full(SLOTS, -1, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode_one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. Many words go as one text, with a separator
        whose id marks where each ends; words that hold the separator's sign go alone, at the end."""
        texts = [" | ".join(found[k : k + 256]) for k in range(0, len(found), 256)]
        parts = [np.zeros(0, np.uint32)]
        for k in range(0, len(texts), 64):
            encoded = self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)
            chained = itertools.chain.from_iterable([*e.ids, self.separator_id] for e in encoded)
            parts.append(np.fromiter(chained, np.uint32))
        flat = np.concatenate(parts)
        cut = np.flatnonzero(flat == self.separator_id)
        if len(cut) != len(found):
            raise ValueError("the tokenizer does not keep words apart")
        ends = cut - np.arange(len(cut))
        return np.delete(flat, cut), np.diff(ends, prepend=0)

    def _number(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word; words not met before are encoded."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        number = np.where(self.slot_hash[slot] == hashes, self.slot_word[slot], -1).astype(np.int64)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        distinct, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
        raw, at = data.tobytes(), missing[first]
        found = [raw[s:e].decode() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        # 0: goes to the model as it is, 1: in a text with others, 2: as a text of its own
        way = np.array([0 if w.isascii() and w.isalpha() else 2 if "|" in w else 1 for w in found])
        order = np.argsort(way, kind="stable")
        by_way = [[found[i] for i in order[way[order] == k]] for k in (0, 1, 2)]
        model = self.tokenizer.model
        single = [[t.id for t in model.tokenize(w)] for w in by_way[0]]
        flat = np.fromiter(itertools.chain.from_iterable(single), np.uint32)
        ids, lengths = self._encode_words(by_way[1])
        own = [self.encode_one(w) for w in by_way[2]]
        ids = np.concatenate([flat, ids, *own]).astype(np.uint32)
        lengths = np.concatenate([[len(x) for x in single], lengths, [len(x) for x in own]]).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) + len(self.lengths)
        number[missing] = place[inverse]
        slot = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slot_hash[slot], self.slot_word[slot] = distinct, place
        self.starts = np.concatenate([self.starts, np.cumsum(lengths) - lengths + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        return number

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n + 1 offsets of the texts into them.

        ASCII letters are made small first and a closing full stop or comma is a word of its own,
        so that fewer words differ; neither changes the ids. Texts with the sign `<|`, which
        special tokens start with, are encoded whole.
        """
        data, offsets = words.text_bytes(column)
        special = set()
        if b"<|" in data.tobytes():
            special = {i for i, t in enumerate(column.to_pylist()) if t and "<|" in t}
        data = words.lower_ascii(data)
        start, end, text_at = words.word_spans(data, offsets)
        start, end, text_at = _cut_last_punctuation(data, start, end, text_at)
        hashes = words.span_hashes(data, start, end)
        if len(self.lengths) > KEPT_WORDS:
            self._forget()
        runs, run_lengths = [], []
        for k in range(0, len(start), WORDS_AT_ONCE):
            part = slice(k, k + WORDS_AT_ONCE)
            number = self._number(hashes[part], data, start[part], end[part])
            run_lengths.append(self.lengths[number])
            runs.append(self.ids[words.ragged(self.starts[number], run_lengths[-1])])
        ids = np.concatenate([self.ids[:0], *runs])
        word_at = np.concatenate([[0], np.cumsum(np.concatenate([self.lengths[:0], *run_lengths]))])
        text_ids = word_at[text_at]
        if not special:
            return ids, text_ids
        each = [
            self.encode_one(column[i].as_py()) if i in special else ids[text_ids[i] : text_ids[i + 1]]
            for i in range(len(offsets) - 1)
        ]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _cut_last_punctuation(data, start, end, text_at):
    """Words of ASCII letters followed by one `.` or `,` become two words."""
    last, before = data[end - 1], data[np.maximum(end - 2, 0)]
    cut = (end - start >= 2) & ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
    n = np.where(cut, 2, 1)
    at = np.cumsum(n) - n
    new_start, new_end = np.repeat(start, n), np.repeat(end, n)
    new_end[at[cut]] -= 1
    new_start[at[cut] + 1] = end[cut] - 1
    return new_start, new_end, np.concatenate([at, [n.sum()]])[text_at]


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    return WordEncoder(path)
