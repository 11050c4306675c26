"""Token ids of whole texts as the tokenizers library gives them for a byte-level vocabulary, each distinct word encoded once.

The vocabulary's splitting pattern ends a match before each run of letters and the one space that may stand before it, and
behind the run. So a text is cut there, and the ids of a text are those of its segments. Where a segment without letters
bears on what follows (an apostrophe before a letter may be a contraction, white space may be shared out otherwise, other
scripts may hold letters too), it isn't cut off. Texts with an added token, and all texts where the file has another
pattern, go to the library whole.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkvec.llm.common import small_batches
from sparkvec.llm.words import IdTable, byte_symbols, large, release, released, strings

_ENCODERS: dict[str, ByteEncoder] = {}

#: Bytes of text that are encoded at once.
BYTES = 4 << 20
#: Words that are kept with their ids, and words whose tokens exist as objects at once.
KEPT, TOKENIZED = 800_000, 8192
#: Kinds of bytes: letters of ASCII, first bytes of two-byte Latin letters, white space, and all others.
_LETTER, _LEAD, _WHITE = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[range(0xC3, 0xC9)] = _LEAD
_KIND[[*range(9, 14), *range(28, 33)]] = _WHITE
#: What consists of those letters, after a space or none.
_PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ȿ]+$"
_PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def segment_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places in UTF-8 data where segments end, with 0 first; bounds are those of texts, all of which are among them."""
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(kind == _LEAD)
    second = data[np.minimum(lead + 1, n - 1)]
    lead = lead[(data[lead] != 0xC3) | (second != 0x97) & (second != 0xB7)]  # two signs among the letters
    letter = np.zeros(n + 2, np.bool_)  # letter[i + 1]: data[i] is part of a letter
    letter[1:-1] = kind == _LETTER
    letter[lead + 1] = letter[lead + 2] = True
    inside = bounds[(bounds > 0) & (bounds < n)]
    edge = letter[1:] != letter[:-1]  # edge[i]: between data[i - 1] and data[i]
    edge[inside] |= letter[inside + 1]
    cut = np.zeros(n + 1, np.bool_)
    starts = np.flatnonzero(edge & letter[1:])
    first = np.zeros(n + 1, np.bool_)
    first[bounds] = True
    rest = starts[~first[starts]]
    before = data[rest - 1]
    spaced = before == 32
    cut[starts[first[starts]]] = True
    cut[rest[spaced] - 1] = True
    bare, before = rest[~spaced], before[~spaced]
    two = first[bare - 1] | (bare < 2)  # nothing of the same text before that byte
    earlier = data[np.maximum(bare - 2, 0)]
    shared = (before == 39) | (before >= 128) | (_KIND[before] == _WHITE) & ~two & ((_KIND[earlier] == _WHITE) | (earlier >= 128))
    cut[bare[~shared]] = True
    ends = np.flatnonzero(edge & letter[:-1])
    ends = ends[(ends == n) | first[ends] | (data[np.minimum(ends, n - 1)] < 128) | letter[np.minimum(ends, n - 1) + 1]]
    cut[ends] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles inside: very many small objects are made there, and none of them refers to another in a cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ByteEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same model without the library's own cache of words, as each word comes once.
        self.model = models.BPE(spec["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]], cache_capacity=0)
        self.tokenizer.model = self.model
        found = spec["pre_tokenizer"] or {}
        # Fields of the model that change what a word gives must be off.
        plain = all(not spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.cuts = plain and spec["normalizer"] is None and all(found.get(k) == v for k, v in _PATTERN.items())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.symbols = dict(enumerate(byte_symbols()))
        self.known = IdTable(self._made, KEPT)

    def _made(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """An order of segments and their ids in it. A segment of letters is one match, so it goes to the library's model
        without a search for more; those come first."""
        plain = np.asarray(pc.match_substring_regex(pieces, _PLAIN))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        names, n, space, symbols = pieces.take(pa.array(order)), int(plain.sum()), self.symbols[32], self.symbols
        ids, sizes = array("I"), array("q")
        for at in range(0, n, TOKENIZED):
            words = [p.replace(" ", space) if p.isascii() else p.encode().decode("latin-1").translate(symbols) for p in strings(names.slice(at, min(TOKENIZED, n - at)))]
            tokens = list(map(self.model.tokenize, words))
            sizes.extend(map(len, tokens))
            ids.extend([t.id for x in tokens for t in x])
        for e in self.tokenizer.encode_batch_fast(strings(names.slice(n)), add_special_tokens=False):
            own = e.ids
            sizes.append(len(own))
            ids.extend(own)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]) * 4
        return order, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined as unsigned 32-bit integers, where each text's ids begin with the end at last)."""
        bounds, data = large(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if not self.cuts:
            return self._whole(texts, np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64), np.arange(len(texts)))
        at = segment_ends(np.frombuffer(data, np.uint8), bounds)
        segments = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        index = segments.indices.to_numpy(zero_copy_only=False)
        with uncollected():
            place, table = self.known.get(segments.dictionary)
        found = table.take(pa.array(place[index]))
        ids = np.frombuffer(found.buffers()[2], "<u4")
        offsets = np.frombuffer(found.buffers()[1], np.int64)[np.searchsorted(at, bounds)] // 4
        odd = np.zeros(len(texts), np.bool_)
        for token in self.added:
            odd |= np.asarray(pc.fill_null(pc.match_substring(texts, token), False))
        return self._whole(texts, ids, offsets, np.flatnonzero(odd)) if odd.any() else (ids, offsets)

    def _whole(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i, e in zip(which, self.tokenizer.encode_batch_fast([texts[int(i)].as_py() or "" for i in which], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def encoder(path: str) -> ByteEncoder:
    """This process's encoder of a vocabulary file, with what it has kept."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
        release()
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text", most: int = BYTES, kept: int = KEPT) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each batch of at most about most bytes of text: the batch, the ids of its texts with end_id after each, and where
    each text's ids begin."""
    own = encoder(path)
    own.known.limit = kept
    for batch in released(small_batches(batches, text, most)):
        if batch.num_rows:
            ids, offsets = own.encode(batch.column(text))
            yield batch, np.insert(ids, offsets[1:], end_id).astype("<u4"), offsets + np.arange(len(offsets))
