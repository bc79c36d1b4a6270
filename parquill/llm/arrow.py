"""Arrow helpers of the operators that run Python over whole texts."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: The ASCII white space that splits words: space and U+0009 to U+000D. ``bytes.split`` uses it too.
BLANK = b" \t\n\x0b\x0c\r"


def raw(column: pa.Array, most: int = 256) -> Iterator[bytes]:
    """Texts as UTF-8 bytes, null as empty; few of them are held at a time."""
    for k in range(0, len(column), most):
        for x in column.slice(k, most).cast(pa.binary()).to_pylist():
            yield b"" if x is None else x


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at its end it gives freed memory back, which idle Python workers would keep."""

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def as_text(values: Iterable[bytes | None]) -> pa.Array:
    """UTF-8 bytes as a string column, without another check of the bytes."""
    return pa.array(values, pa.binary()).view(pa.string())


def code_points(text: bytes) -> int:
    """Number of code points of UTF-8 bytes."""
    if text.isascii():
        return len(text)
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Cache(dict):
    """A dictionary that computes what it lacks. When full it starts anew, but what was in it is taken over as it is used again, so memory stays bounded and frequent keys stay."""

    def __init__(self, make: Callable[[bytes], object], most: int = 300_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: bytes) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def shared(name: str, build: Callable[[], object]) -> object:
    """What ``build`` made the first time in this Python worker; functions are shipped by value, so modules keep nothing."""
    home = sys.modules.setdefault("_parquill_worker", types.ModuleType("_parquill_worker"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)

