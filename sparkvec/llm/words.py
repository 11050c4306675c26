"""Texts of an Arrow batch as indexes into their distinct space-separated pieces, so that costly work is done once a piece."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(column: pa.Array) -> list[str]:
    """The strings of an array without nulls; much faster than to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def large(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """(where each text begins in the buffer with the end at last, the buffer of their bytes). Null is empty."""
    column = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    return ends - ends[0], data.slice(ends[0], ends[-1] - ends[0])


def split_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each piece, where each text's pieces begin with the end at last, distinct pieces). Pieces are what
    str.split(' ') gives: there is one at least for each text, and joined by spaces they are the text. Null is empty."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0], coded.dictionary


class IdTable:
    """Ids of words, made once. At most limit words are kept, none longer than LONG bytes; when more come, those of the last
    call take their place. Words and ids lie in two arrays, of about 40 bytes a word in all."""

    LONG = 48

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, pa.Array]], limit: int):
        self.make, self.limit = make, limit
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def get(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(where each word's ids are in the array, ids as bytes). make() gives an order of new words and their ids in it."""
        found = pc.index_in(words, value_set=self.words)
        place, n = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64), len(self.words)
        if not found.null_count:
            return place, self.ids
        missing = np.flatnonzero(np.asarray(pc.is_null(found)))
        fresh = words.take(pa.array(missing))
        order, made = self.make(fresh)
        place[missing[order]] = np.arange(n, n + len(missing))
        fresh, ids = fresh.take(pa.array(order)), pa.concat_arrays([self.ids, made])
        if n + len(missing) > self.limit:
            own = np.flatnonzero(np.asarray(pc.less_equal(pc.binary_length(words), self.LONG)))[: self.limit]
            self.words, self.ids = words.take(pa.array(own)), ids.take(pa.array(place[own]))
        else:
            short = pc.less_equal(pc.binary_length(fresh), self.LONG)
            self.words, self.ids = pa.concat_arrays([self.words, fresh.filter(short)]), pa.concat_arrays([self.ids, made.filter(short)])
        return place, ids


class PieceCache:
    """What make() gives for pieces. At most limit pieces are kept, none longer than LONG, so that memory is bounded; when
    more come, those of the last call take their place."""

    LONG = 48

    def __init__(self, make: Callable[[list[str]], list], limit: int = 150_000):
        self.make, self.limit, self.known = make, limit, {}

    def get(self, pieces: list[str]) -> list:
        out = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            names = [pieces[i] for i in missing]
            made = self.make(names)
            for i, x in zip(missing, made, strict=True):
                out[i] = x
            if len(self.known) + len(names) > self.limit:
                names, made, self.known = pieces[: self.limit], out, {}
            self.known.update((p, x) for p, x in zip(names, made, strict=False) if len(p) <= self.LONG)
        return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def release() -> None:
    """Gives back memory that Arrow and the C library hold for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(batches: Iterator) -> Iterator:
    """The same batches; at the end of a task, memory that Arrow and the C library hold for later goes back, as a worker
    lives on beside those of other stages."""
    yield from batches
    release()
