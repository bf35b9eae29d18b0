"""Words of many texts at once, as places and 64-bit numbers on one byte array.

Texts are laid end to end with a line feed between them, which must be a byte between
words; so words never run over the end of a text.  Memory is some sixty times the
bytes laid together: a few megabytes, or one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from marginalia.llm.shingles import _BACK, _BASE, _LETTER, _powers, mix

#: Bytes of texts laid together; a longer text stands alone.
CHUNK = (2 << 20) - 64

_TABLES = [_powers(_BASE, 1), _powers(_BACK, 1)]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def gathered(batches: Iterable[pa.RecordBatch], text: int, most: int = CHUNK) -> Iterator[list[list]]:
    """The columns of successive batches as lists, cut into runs whose texts (column ``text``) have ``most`` bytes or are a single longer one."""
    held: list[list] = []
    size = 0
    for b in batches:
        columns = [bytes_of(c) if k == text else c.to_pylist() for k, c in enumerate(b.columns)]
        at = 0
        for k, t in enumerate(columns[text]):
            if size and size + len(t) > most:
                yield [h + c[at:k] for h, c in zip(held or [[] for _ in columns], columns)]
                held, at, size = [], k, 0
            size += len(t) + 1
        held = [h + c[at:] for h, c in zip(held or [[] for _ in columns], columns)]
    if held and held[text]:
        yield held


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below ``n`` at least."""
    if len(_TABLES[0]) < n:
        size = 1 << (n - 1).bit_length()
        _TABLES[:] = [_powers(_BASE, size), _powers(_BACK, size)]
    return _TABLES[0], _TABLES[1]


class Words:
    """``start`` and ``end`` of each word in ``data``, and ``owner``, the number of its text."""

    def __init__(self, texts: list[bytes], between: np.ndarray) -> None:
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~between[self.data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.owner = np.searchsorted(self.begins, self.start, "right") - 1
        #: Number of the first word of each text, and of the word after the last.
        self.first = np.searchsorted(self.start, self.begins)

    def __len__(self) -> int:
        return len(self.start)

    def marks(self) -> np.ndarray:
        """A 64-bit number for each word, the same for equal words everywhere."""
        n = len(self.data)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def windows(marks: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for each run of ``k`` marks; one fewer than ``k`` runs have none."""
    n = len(marks)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(marks * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + np.uint64(k))
