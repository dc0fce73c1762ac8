"""Token ids of many texts by a ``tokenizers`` file whose pre-tokenizer never joins words across white space.

Running text repeats its words, so each task encodes every distinct word once and
gathers the ids of whole texts from there with numpy. Ids equal those that
``Tokenizer.encode(text, add_special_tokens=False)`` gives (tests compare them).
"""

from __future__ import annotations

import itertools
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends of words that may be split off before a letters-only part; quotes and the signs of special tokens stay.
TRAILING = "".join(sorted(set(string.punctuation) - set("'<>|")))
#: What a word in the cache takes besides its own letters (an entry, an object, numbers), about.
WORD_BYTES = 150


class WordEncoder:
    """Encodes texts through a cache of words that is bounded in bytes; a task makes its own, so that nothing outlives it."""

    def __init__(self, path: str, most_bytes: int = 32 << 20, words_a_call: int = 500):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_bytes, self.words_a_call = most_bytes, words_a_call
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.held = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int32)
        self.lengths = np.zeros(1 << 12, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins and the last ends."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        first_words = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        stems = pc.utf8_rtrim(words, characters=TRAILING)
        letters = pc.utf8_is_alpha(stems)
        keys = pc.if_else(letters, pc.ascii_lower(stems), words)
        cut = np.flatnonzero(pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False) & letters.to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.take(pa.array(cut)), r"^.*[^" + re.escape(TRAILING) + r"]", "")
        if self.held > self.most_bytes:
            self._forget()
        at = self._rows(keys)
        if len(cut):  # a word and its tail are two units
            at = np.insert(at, cut + 1, self._rows(tails))
            first_words = first_words + np.searchsorted(cut, first_words, side="left")
        lengths = self.lengths[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        shift = np.repeat((self.starts[at] - ends[:-1]).astype(np.int32), lengths)
        shift += np.arange(ends[-1], dtype=np.int32)
        return self.pool[shift], ends[first_words]

    def _rows(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.array(list(map(self.rows.get, names, itertools.repeat(-1))), np.int32)
        if (new := np.flatnonzero(found < 0)).size:
            found[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self._learn([names[i] for i in new.tolist()])
        return found[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Adds rows for words. Letters-only words are encoded many a call; the ids of each must end with its only word end, else all of that call are encoded alone."""
        first = len(self.rows)
        self.held += WORD_BYTES * len(words) + 2 * sum(map(len, words))
        self.rows.update(zip(words, range(first, first + len(words))))
        self.starts = _room(self.starts, first + len(words))
        self.lengths = _room(self.lengths, first + len(words))
        rows = {True: [], False: []}
        for row, word in enumerate(words, first):
            rows[word.isalpha()].append(row)
        alone = rows[False]
        groups = [rows[True][i : i + self.words_a_call] for i in range(0, len(rows[True]), self.words_a_call)]
        texts = [" ".join([words[row - first] for row in group]) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                self._keep(ids, np.array(group), stops)
            else:
                alone += group
        found = [x.ids for x in self.tokenizer.encode_batch_fast([words[row - first] for row in alone], add_special_tokens=False)]
        self._keep(np.array([i for ids in found for i in ids], np.uint32), np.array(alone, np.int64), np.cumsum([len(ids) for ids in found]).astype(np.int64))

    def _keep(self, ids: np.ndarray, rows: np.ndarray, stops: np.ndarray) -> None:
        if not len(rows):
            return
        self.pool = _room(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], stops[:-1]])
        self.starts[rows], self.lengths[rows] = self.used + begins, stops - begins
        self.used += len(ids)


def _room(array: np.ndarray, needed: int) -> np.ndarray:
    if needed <= len(array):
        return array
    out = np.zeros(max(needed, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out
