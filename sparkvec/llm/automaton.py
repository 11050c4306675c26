"""Byte-pair encoding by a compiled deterministic automaton over tokens.

The automaton reads token sequences and accepts those that the merges give. It starts with one state and a loop for each
base symbol. The gadget of a merge (a, b) -> c, applied in rank order, splits the state that arcs labelled a lead to: its
copy, which those arcs now lead to, lacks the arc b and the arcs that would yet come of it; and wherever an a arc leaves, a
c arc is added that leads where b led. So a label leads to one state, and each gadget makes one more state.

Labels are numbered so that those made from the same left part stand together, in the order of their making, with that
part behind them. Then what a gadget takes from a state is one run of numbers, a state's row is a sorted list of bounds
of such runs, and whether a state has an arc is one search in its row.

A word is read by the automaton and the trie of its labels' spellings at once. Each place of a word is reached by one
path, so places are settled from left to right without a step back. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import ship_code, small_batches, table, text_or_empty
from sparkvec.llm.words import PieceCache, byte_symbols, released, split_batch, strings

_MACHINES: dict[str, WordAutomaton] = {}

#: Words, and pieces between spaces, that a worker keeps with their ids: about 300 bytes each.
WORDS, PIECES = 500_000, 400_000


class WordAutomaton:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            merges.append((vocabulary[a], vocabulary[b], vocabulary[a + b.removeprefix(model["continuing_subword_prefix"] or "")]))
        self._compile(max(self.labels) + 1, merges)
        self._spell(vocabulary, suffix, merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(map(regex.compile(r"\s").search, self.added)):
            raise ValueError("an added token holds white space, at which texts are cut")
        # With no added token, what never matches.
        self.special = regex.compile("(" + ("|".join(map(regex.escape, self.added)) or r"\b\B") + ")")
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.words: dict[str, tuple[int, str, str]] = {}
        self.pieces = PieceCache(lambda ps: [self._piece(p) for p in ps], PIECES)

    def _compile(self, size: int, merges: list[tuple[int, int, int]]) -> None:
        """Applies the gadget of each merge in turn; then number[t] is t's number, and t's arcs lead to the row of bounds
        from row[t] up to row_end[t]."""
        below, ready = [1] * size, [0] * size  # labels with t at their left edge, t among them; the first merge that may use t
        for k, (a, b, c) in enumerate(merges, 1):
            if ready[c] or c in (a, b):
                raise ValueError(f"merge {k} gives a token that another gives, too")
            ready[c] = k
        for k, (a, b, _) in enumerate(merges, 1):
            if max(ready[a], ready[b]) >= k:
                raise ValueError(f"merge {k} uses a token that a later merge gives")
        for a, _, c in reversed(merges):
            below[a] += below[c]
        place, free = [0] * size, 0  # where the next label made from t at its left begins
        for t in range(size):
            if not ready[t]:
                place[t], free = free, free + below[t]
        number = [p + n - 1 for p, n in zip(place, below, strict=True)]
        leads = [0] * size
        origin, first, last = [0], [0], [0]  # of each state: the one it copies, the run of labels that it lacks besides
        self.idle: set[int] = set()  # tokens that no path holds, as no path held the parts of their merge side by side

        def lacks(state: int, label: int) -> bool:
            while state and not first[state] <= label <= last[state]:
                state = origin[state]
            return state > 0

        for a, b, c in merges:
            run = place[b]
            place[c], number[c] = place[a], place[a] + below[c] - 1
            place[a] += below[c]
            if a in self.idle or b in self.idle or lacks(leads[a], number[b]):
                self.idle.add(c)
                continue
            leads[c] = leads[b]
            origin.append(leads[a])
            first.append(run)
            last.append(number[b])
            leads[a] = len(origin) - 1
        self.number, self.states = number, len(origin)
        self._rows(np.array(leads), *(np.array(x, np.int64) for x in (origin, first, last)))

    def _rows(self, leads: np.ndarray, origin: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        used, of = np.unique(leads, return_inverse=True)
        at, row, low, high = used, np.arange(len(used)), [], []
        while len(at):  # a step towards the first state for all rows at once
            at, row = at[at > 0], row[at > 0]
            low.append(row << 32 | first[at])
            high.append(row << 32 | last[at] + 1)
            at = origin[at]
        low, high = np.concatenate(low), np.concatenate(high)
        order = np.argsort(low, kind="stable")
        low, reach = low[order], np.maximum.accumulate(high[order])
        begins = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])[: len(low)])
        bounds = np.stack([low[begins], reach[np.append(begins[1:], len(low)) - 1]], 1)[: len(begins)]
        ends = 2 * np.searchsorted(bounds[:, 0], np.arange(1, len(used) + 1) << 32)
        self.bounds = array("i", (bounds & 0xFFFFFFFF).astype(np.int32).tobytes())
        self.row_end = ends[of].tolist()
        self.row = np.concatenate([[0], ends])[of].tolist()

    def _spell(self, vocabulary: dict[str, int], suffix: str, merges: list[tuple[int, int, int]]) -> None:
        """The trie of the labels: a symbol is a byte, 256 more if a word ends with it."""
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        spelled = {vocabulary[c + end]: (b + more,) for c, b in symbol.items() for end, more in ((suffix, 256), ("", 0)) if c + end in vocabulary}
        for a, b, c in merges:
            spelled[c] = spelled[a] + spelled[b]
        self.step: dict[int, int] = {}
        self.label_at = [-1]
        for t, symbols in spelled.items():
            if t in self.idle:
                continue
            node = 0
            for x in symbols:
                key = node << 9 | x
                if (node := self.step.get(key, 0)) == 0:
                    node = self.step[key] = len(self.label_at)
                    self.label_at.append(-1)
            self.label_at[node] = t

    def arc(self, state: int, label: int) -> bool:
        """Whether label may follow the token state."""
        begin = self.row[state]
        return not (bisect_right(self.bounds, self.number[label], begin, self.row_end[state]) - begin) & 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word. Raises where the vocabulary can't spell it."""
        symbols = list(word.encode("utf-8"))
        n, step, label_at, number, bounds = len(symbols), self.step, self.label_at, self.number, self.bounds
        symbols[-1] += 256
        token, begun = [-1] * (n + 1), [0] * (n + 1)  # the last label of the path to each place, and where it begins
        begin = end = 0
        for at in range(n):
            if at:
                if (state := token[at]) < 0:
                    continue
                begin, end = self.row[state], self.row_end[state]
            node = 0
            for stop in range(at, n):
                if (node := step.get(node << 9 | symbols[stop])) is None:
                    break
                label = label_at[node]
                if label >= 0 and token[stop + 1] < 0 and not (bisect_right(bounds, number[label], begin, end) - begin) & 1:
                    token[stop + 1], begun[stop + 1] = label, at
        out, at = [], n
        while at:
            if token[at] < 0:
                raise ValueError(f"no path spells {word[:40]!r}")
            out.append(token[at])
            at = begun[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                ids.append(self.added[part])
            elif part:
                for word in self.split.findall(self._plain(part)):
                    ids.extend(self.encode_word(word))
        return ids

    @staticmethod
    def _plain(text: str) -> str:
        return text.lower() if text.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", text)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)

    def _shown(self, ids: list[int]) -> tuple[int, str, str]:
        """(number of ids, ids with a space before each, labels with a space before each)."""
        return len(ids), "".join([f" {i}" for i in ids]), "".join([" " + self.labels[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, str, str]:
        if self.special.search(piece):
            return self._shown(self.encode(piece))
        known, out = self.words, []
        for word in self.split.findall(self._plain(piece)):
            if (own := known.get(word)) is None:
                if len(known) >= WORDS:
                    known.clear()
                own = known[word] = self._shown(self.encode_word(word))
            out.append(own)
        if len(out) == 1:
            return out[0]
        return sum([x[0] for x in out]), "".join([x[1] for x in out]), "".join([x[2] for x in out])


def machine(path: str) -> WordAutomaton:
    """This process's automaton for a vocabulary file."""
    if path not in _MACHINES:
        _MACHINES[path] = WordAutomaton(path)
    return _MACHINES[path]


def _digests(path: str):
    def joined(index: np.ndarray, bounds: np.ndarray, strings: list[str]) -> list[str]:
        taken = pa.array(strings, pa.large_string()).take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[bounds]
        data = memoryview(taken.buffers()[2] or b"")
        return [hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in released(small_batches(batches)):
            if not batch.num_rows:
                continue
            index, bounds, distinct = split_batch(batch.column("text"))
            found = own.pieces.get(strings(distinct))
            counts = np.concatenate([[0], np.cumsum(np.array([x[0] for x in found], np.int64)[index])])[bounds]
            columns = [batch.column("doc_id"), pa.array(np.diff(counts)), *(pa.array(joined(index, bounds, [x[k] for x in found]), pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids (decimal, one space between) and of the decoded text.

    Null text is empty: no ids, digests of the empty string. Rows are independent; other columns are ignored. Words are
    cut at white space, over which neither normalisation nor a match reaches, so pieces between spaces are encoded apart.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return own.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and its ids, array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in released(small_batches(batches)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    ship_code(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
