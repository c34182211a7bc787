"""Words of letters, digits and code points beyond ASCII, over the bytes of a whole Arrow column at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words stay, A-Z lower-cased; all others become a blank.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 32


def as_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large strings, and where each text starts and ends."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def translated(text: pa.Array, table: np.ndarray) -> pa.Array:
    """The same texts, each byte looked up in a table of 256 that keeps bytes of characters beyond ASCII."""
    data, at = as_bytes(text)
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(table[data])])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, type=pa.string()) -> pa.Array:
    """The spans of some bytes as an array of strings."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(type, len(sizes), [None, pa.py_buffer(offsets.astype(np.int32 if type == pa.string() else np.int64)), pa.py_buffer(data[at])])
