"""Texts in chunks that no token crosses, and values of chunks that a task learns once.

A chunk is plain white space and what follows it up to the next plain white space.
The byte-level pre-tokenizers never join a sign with white space after it, so their
tokens of a text are those of its chunks, one after the other. White space of other
kinds doesn't end a chunk: libraries differ in what they count as such.

A text of any length is read in windows, so a task holds a bounded number of chunks.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

CHUNK = re.compile(r"[ \t\n]*(?:\S+|[^\S \t\n][ \t\n]*)+|[ \t\n]+")
LAST_CUT = re.compile(r"(?s:.*)\S(?=[ \t\n])")
#: Characters of a text that are cut at a time; bytes of chunks and their values that a table holds.
WINDOW, TABLE_BYTES = 1 << 20, 64 << 20
#: What an entry of a table takes besides its letters, about.
ENTRY_BYTES = 200


def windows(text: str, most: int = WINDOW) -> Iterator[str]:
    """The text in parts of about ``most`` signs, each but the first beginning with plain white space that no token joins to what is before."""
    at, wide = 0, most
    while at + wide < len(text):
        cut = LAST_CUT.match(text, at, at + wide + 1)
        if cut is None:  # no place so far
            wide *= 2
            continue
        yield text[at : cut.end()]
        at, wide = cut.end(), most
    if at < len(text):
        yield text[at:]


class ChunkTable:
    """Values of parts of texts (``cut`` gives a text's parts), learned many at a time by ``learn`` and forgotten when they take too much."""

    def __init__(self, cut: Callable[[str], list[str]], learn: Callable[[list[str]], list], size: Callable[[object], int] = len, most_bytes: int = TABLE_BYTES):
        self.cut, self.learn, self.size, self.most_bytes = cut, learn, size, most_bytes
        self.known: dict[str, object] = {}
        self.held = 0

    def values(self, chunks: list[str]) -> list:
        found = list(map(self.known.get, chunks))
        if None in found:
            if self.held > self.most_bytes:
                self.known, self.held = {}, 0
                found = [None] * len(chunks)
            new = list(dict.fromkeys(c for c, v in zip(chunks, found) if v is None))
            values = self.learn(new)
            self.known.update(zip(new, values))
            self.held += sum(2 * len(c) + self.size(v) + ENTRY_BYTES for c, v in zip(new, values))
            found = list(map(self.known.__getitem__, chunks))
        return found

    def of_texts(self, texts: Sequence[str], window: int = WINDOW) -> Iterator[tuple[int, list]]:
        """(number of the text, values of its parts), text by text; a long text comes in several such lists, an empty one in none.

        Parts of many short texts are looked up together."""

        def looked_up() -> Iterator[tuple[int, list]]:
            values = self.values(list(itertools.chain.from_iterable(chunks for _, chunks in waiting)))
            at = 0
            for i, chunks in waiting:
                yield i, values[at : at + len(chunks)]
                at += len(chunks)

        waiting, size = [], 0
        for i, text in enumerate(texts):
            for part in windows(text, window):
                waiting.append((i, self.cut(part)))
                size += len(part)
                if size >= window:
                    yield from looked_up()
                    waiting, size = [], 0
        yield from looked_up()
