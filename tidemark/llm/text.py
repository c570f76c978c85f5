"""Helpers for whole texts inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def remainder(key: str, n: int) -> Column:
    """crc32 of a key's text modulo n; a null key's text is empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


_HELD: dict[Hashable, object] = {}


def hold(name: Hashable, make: Callable[[], object]) -> object:
    """The tool of that name in this Python worker, kept between tasks; another one gives way, with all it remembers."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class _Index(dict):
    """Places of chunks in a list of values; a chunk that isn't there gets the next place at once."""

    def __init__(self, old: dict, old_values: list):
        super().__init__()
        self.old, self.old_values = old, old_values
        self.values: list = []
        self.unknown: list = []

    def __missing__(self, chunk: Hashable) -> int:
        at = self[chunk] = len(self.values)
        before = self.old.get(chunk)
        if before is None:
            self.unknown.append(chunk)
            self.values.append(None)
        else:
            self.values.append(self.old_values[before])
        return at


class Memo:
    """Values of chunks that come up again and again; about 2 * ``size`` are held, the longest unused go."""

    def __init__(self, make: Callable[[list], Iterable], size: int = 200_000):
        self.make, self.size = make, size
        self.index = _Index({}, [])

    def __call__(self, chunks: list) -> list:
        """The value of each chunk, in order; values of unknown chunks are made in one call."""
        index = self.index
        places = list(map(index.__getitem__, chunks))
        if index.unknown:
            for chunk, value in zip(index.unknown, self.make(index.unknown), strict=True):
                index.values[index[chunk]] = value
            index.unknown = []
        found = list(map(index.values.__getitem__, places))
        if len(index) > self.size:
            index.old, index.old_values = {}, []
            self.index = _Index(index, index.values)
        return found
