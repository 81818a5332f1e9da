"""Tables of byte strings by number, for use inside tasks: joining many of them at once, and slicing lists of numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


class Strings:
    """Byte strings under the numbers 0, 1, 2 and so on."""

    def __init__(self, strings: Iterable[bytes]):
        strings = list(strings)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = self.length.cumsum() - self.length
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of these numbers, one after the other, and where each ends."""
        n = self.length[numbers]
        ends = n.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.start[numbers] - (ends - n), n)], ends


def lists(parts: list[bytes]) -> pa.ListArray:
    """Packed little-endian 32-bit numbers as an Arrow array of lists."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists, and how many each row has; null is an empty list."""
    count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), count
