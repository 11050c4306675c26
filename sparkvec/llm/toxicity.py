"""Toxicity of texts whose words may be disguised: a noisy channel is undone first, then the restored text is scored.

The character model holds trigram counts of the whole corpus over the letters a to z, a word boundary and one sign for
all else. A disguised word is a lattice: a mark or digit may stand for letters that look like it or for nothing, a run of
one letter for fewer of them, a space or mark between letters for nothing or for the end of a word. Viterbi decoding finds the letters that the
model and the channel's costs make likeliest. Words of letters alone, none doubled, have one path only, so they aren't
decoded. A word's letters as they are written count beside the restored ones.
The score is a logistic regression over the restored words and their beginnings that labelled documents tell apart.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import BATCH_BYTES, ship_code, small_batches, table, text_or_empty
from sparkvec.llm.labelled import held_out, sample
from sparkvec.llm.words import PieceCache, large, released, split_batch, strings

#: The letters that digits and marks may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Marks that may stand between the letters of a word, and marks that may hide any letter.
BETWEEN, HIDING = "._-~*'`,:;/\\|+^=#", "*#"
#: Costs in nats of a letter that is written otherwise, a mark left out, a letter of a run left out, a hidden letter.
WRITTEN, LEFT_OUT, REPEATED, HIDDEN = 0.7, 0.7, 0.4, 3.0
#: Paths differ in length: what each symbol of one makes good, the mean cost of a letter.
EACH = 2.3

_EDGE, _OTHER, _SYMBOLS = 26, 27, 28
_MARKS = "".join(sorted(set(BETWEEN) | {c for c in LOOKS_LIKE if not c.isalnum()} | set("\"%&)[]{}<>?¡¿«»")))
#: Marks that stand for no letter, so that at a word's ends they say nothing; what no lattice has an arc for.
_IDLE = "".join(c for c in _MARKS if c not in LOOKS_LIKE)
_FOREIGN = re.compile(f"[^a-z{re.escape(''.join(sorted({*LOOKS_LIKE, *BETWEEN, *HIDING})))}]+")
_DISGUISED = re.compile(f"[{re.escape(''.join(sorted({*LOOKS_LIKE, *BETWEEN, *HIDING})))}]|([a-z])\\1")
_LOOKS = re.compile(f"[a-z{re.escape(''.join(LOOKS_LIKE))}]")
_BETWEEN = re.compile(f"[{re.escape(BETWEEN)}]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTERS = re.compile("[a-z]+")
#: Accents as characters of their own, and words of letters with idle marks around them.
_ACCENTS = r"[\x{300}-\x{34E}\x{350}-\x{36F}]"
_LETTERS_IN_MARKS = f"^[{re.escape(_IDLE)}]*[a-z]+[{re.escape(_IDLE)}]*$"
_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]+"
#: Characters of a piece with signs that may be part of a word set apart by spaces; pieces of a lattice at most, and how
#: many of them the next one has too.
SHORT, WINDOW, OVERLAP = 6, 100, 20
#: Characters of a lattice at most; longer words are cut, behind a mark that follows two letters or digits if there is one.
LONGEST = 200
_CUT = re.compile(f"[^\\W_]{{2}}[{re.escape(BETWEEN)}]+")
#: A feature is kept if at least LEAST sampled documents of label 1 have it, four times the share of the others, and the
#: likelihood-ratio statistic is at least GAIN; the FEATURES with most. RIDGE is the penalty on squared weights.
LEAST, GAIN, FEATURES, RIDGE = 5, 24.0, 512, 0.1


def byte_codes() -> np.ndarray:
    """Each byte's symbol: letters regardless of case, white space as a boundary, all else one sign."""
    codes = np.full(256, _OTHER, np.int64)
    codes[97:123] = codes[65:91] = np.arange(26)
    codes[[9, 10, 11, 12, 13, 32]] = _EDGE
    return codes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, total = byte_codes(), np.zeros(_SYMBOLS**3, np.int64)
    for batch in released(small_batches(batches, most=BATCH_BYTES // 2)):
        column = batch.column("text").cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = codes[np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        s = np.insert(data, np.repeat(ends - ends[0], 2), _EDGE)  # two boundaries between texts
        total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=_SYMBOLS**3)
    key = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from every text; at most 28 ** 3 counts reach the driver."""
    ship_code(docs.sparkSession)
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SYMBOLS**3)
    for r in rows.collect():
        counts[r["key"]] = r["n"]
    counts = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 5 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = counts + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def _plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _lattices(plain: str) -> Iterator[str]:
    """The parts of a word in lower case that may stand for other letters."""
    for run in _FOREIGN.split(plain):
        while run:
            part = run
            if len(run) > LONGEST:
                ends = [m.end() for m in _CUT.finditer(run, 0, LONGEST)]
                part = run[: ends[-1] if ends else max(run.rfind(c, 1, LONGEST) for c in BETWEEN) + 1 or LONGEST]
            run = run[len(part) :]
            inner = _BETWEEN.split(part)
            for x in (part, *inner) if len(inner) > 1 else (part,):  # a disguised word may stand between two marks
                bare = x.strip(_IDLE)
                if len(bare) > 1 and _DISGUISED.search(bare) and _LOOKS.search(bare):
                    yield bare


def restore(word: str, model: np.ndarray | list) -> str:
    """The likeliest letters behind disguised words, with spaces between words; a text with signs that stand for no letter
    is given back."""
    text = _plain(word).strip(_IDLE)
    marks = "".join(c for c in LOOKS_LIKE if not c.isalnum())
    first, last = len(text) - len(text.lstrip(marks)), len(text.rstrip(marks))
    paths: dict[tuple[int, int], tuple[float, str]] = {(_EDGE, _EDGE): (0.0, "")}
    previous = ""
    for at, c in enumerate(text):
        if c.isascii() and c.isalpha():
            arcs = [(c, 0.0)] + ([("", REPEATED)] if c == previous else [])
        else:
            arcs = [(x, WRITTEN) for x in LOOKS_LIKE.get(c, "")]
            if c in BETWEEN or c.isspace() or c in marks and not first <= at < last:
                arcs.append(("", 0.0 if c.isspace() else LEFT_OUT))
            if c in BETWEEN or c.isspace():
                arcs.append((" ", 0.0 if c.isspace() else LEFT_OUT))
            if c in HIDING and 0 < at < len(text) - 1:
                arcs += [(x, HIDDEN) for x in "aeiou"]
            if not arcs:
                return text
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, out) in paths.items():
            for x, cost in arcs:
                if x == " " and b == _EDGE:
                    continue
                k = (_EDGE if x == " " else ord(x) - 97) if x else None
                state, value = ((b, k), score - cost + model[a][b][k] + EACH) if x else ((a, b), score - cost)
                if state not in step or value > step[state][0]:
                    step[state] = (value, out + x)
        paths = step
        previous = c if c.isalpha() else previous
    best = max((s + model[a][b][_EDGE], out) for (a, b), (s, out) in paths.items())
    return best[1].strip()


def joined(model: np.ndarray) -> np.ndarray:
    """Whether two words are likelier as one, by the last two letters of the first and the first two of the second: as
    both letters are known, this is what Viterbi decoding finds for the space between them."""
    m, e = model[:26, :26], _EDGE
    one = m[:, :, :26, None] + m[None, :, :, :26]
    two = m[:, :, e][:, :, None, None] + model[:26, e, :26][None, :, :, None] + model[e, :26, :26][None, None] + EACH
    return (one > two).reshape(676, 676)


class Restorer:
    """What pieces of text give as features: the restored word and its beginnings of 4 to 6 letters, as 32-bit hashes."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()  # faster to read one by one
        self.joined = joined(model)
        self.cache = PieceCache(lambda ps: [self.features(p) for p in ps], 120_000)
        self.shapes = PieceCache(lambda ps: [self.shape(p) for p in ps], 120_000)
        self.lattices = PieceCache(lambda ps: [restore(p, self.model).split() for p in ps], 60_000)

    def words(self, piece: str) -> list[str]:
        out = []
        for part in piece.split():
            plain = _plain(part)
            out += [x for x in _NOT_LETTERS.split(plain) if x]
            for x in _lattices(plain):
                out += restore(x, self.model).split()
        return out

    def hashes(self, words: list[str]) -> tuple[int, ...]:
        found: list[int] = []
        for w in words:
            if len(w) > 2:
                found.append(zlib.crc32(w.encode()))
                found += [zlib.crc32(w[:k].encode() + b"*") for k in (4, 5, 6) if len(w) > k]
        return tuple(found)

    def told(self, distinct: pa.Array) -> tuple[list, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of each piece: its features, the first and last of its shape, what is left of it without marks at its ends, and
        whether a word that begins with it may have a feature."""
        pieces = strings(distinct)
        shapes = self.shapes.get(pieces)
        heads, tails = (np.array([x[k] for x in shapes], np.int64) for k in (0, 1))
        return self.cache.get(pieces), heads, tails, [x[2] for x in shapes], np.ones(len(pieces), np.bool_)

    def may_begin(self, letters: str, places: list[int]) -> bool:
        """Whether a word that begins at one of the places may have a feature."""
        return True

    def features(self, piece: str) -> tuple[int, ...]:
        return self.hashes(self.words(piece))

    def shape(self, piece: str) -> tuple[int, int, str]:
        """What may join a piece to its neighbours: its first and last two letters as numbers below 676, -1 for an end
        with marks and both -2 for a letter alone or a short piece with signs; and the piece without marks at its ends."""
        plain = _plain(piece)
        bare = plain.strip(_IDLE)
        if not bare or _FOREIGN.search(bare):
            return -1, -1, ""
        if _LETTERS.fullmatch(bare):
            if len(bare) == 1:
                return -2, -2, bare
            first, last = ((ord(x[0]) - 97) * 26 + ord(x[1]) - 97 for x in (bare[:2], bare[-2:]))
            return first if plain[0] == bare[0] else -1, last if plain[-1] == bare[-1] else -1, bare
        return (-2, -2, bare) if len(bare) <= SHORT else (-1, -1, "")

    def text_features(self, texts: pa.Array) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(text, features) of its pieces and of the words that several pieces make; a text's features come in any order,
        more than once."""
        texts = pc.replace_substring_regex(texts.cast(pa.large_string()), _SPACE, " ")
        index, bounds, distinct = split_batch(texts)
        found, heads, tails, bares, begins = self.told(distinct)
        keep = np.fromiter(map(bool, found), np.bool_, len(found))
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        pairs = np.unique(of[keep[index]] * len(found) + index[keep[index]])
        for k in pairs.tolist():
            yield k // len(found), found[k % len(found)]
        for text, words in self._chains(index, bounds, of, bares, heads[index], tails[index], begins[index]):
            if features := self.hashes(words):
                yield text, features

    def _chains(self, index, bounds, of, bares, heads, tails, begins) -> Iterator[tuple[int, list[str]]]:
        bare = lambda a, b: [bares[i] for i in index[a:b].tolist()]
        link = (tails[:-1] >= 0) & (heads[1:] >= 0) & (of[:-1] == of[1:])
        link[link] = self.joined[tails[:-1][link], heads[1:][link]]
        known = np.concatenate([[0], np.cumsum(begins)])
        for a, b in _runs(link):  # pieces a to b, which are at least two
            if known[b] > known[a]:
                letters = bare(a, b + 1)
                yield int(of[a]), ["".join(letters), *("".join(x) for x in zip(letters, letters[1:], strict=False) if len(letters) > 2)]
        for start, stop in _runs(heads == -2):
            while start < stop:  # a run may go over the end of a text
                low, high = int(bounds[of[start]]), int(bounds[of[start] + 1])
                end = min(stop, high)
                left, right = start, end
                if start > low and tails[start - 1] >= 0:
                    left -= 1
                    while left > low and link[left - 1]:
                        left -= 1
                if end < high and heads[end] >= 0:
                    right += 1
                    while right < high and link[right - 1]:
                        right += 1
                own = bare(start, end)
                before = "".join(bare(left, start))
                after = "".join(bare(end, right))
                if all(len(x) == 1 and "a" <= x <= "z" for x in own):
                    wanted = self.may_begin(before + "".join(own) + after, [0, *range(len(before), len(before) + len(own))])
                else:
                    wanted = True
                for k in range(0, len(own) if wanted else 0, WINDOW - OVERLAP):
                    here = own[k : k + WINDOW]
                    a, b = before if k == 0 else "", after if k + WINDOW >= len(own) else ""
                    if len(here) + bool(a) + bool(b) > 1:
                        # Only two letters of each neighbour bear on what is likeliest between them.
                        words = list(self.lattices.get([" ".join(filter(None, (a[-2:], *here, b[:2])))])[0])
                        if words:
                            words[0] = a[:-2] + words[0]
                            words[-1] += b[2:]
                            yield int(of[start]), words
                    if k + WINDOW >= len(own):
                        break
                start = end


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def collapsed(word: str) -> str:
    """Each run of one letter as that letter."""
    return "".join(c for c, before in zip(word, "\0" + word, strict=False) if c != before)


def beginning(word: str) -> int:
    """The first three letters as a number; what is missing counts as 26. -1 with other characters than a to z."""
    n = 0
    for k in range(3):
        c = ord(word[k]) - 97 if k < len(word) else 26
        if k < len(word) and not 0 <= c < 26:
            return -1
        n = n * 27 + c
    return n


class ToxicityModel:
    """characters: the character model; weights of features by hash, begins: beginning() of each feature's word and of what
    is left of it when collapsed."""

    def __init__(self, characters: np.ndarray, weights: dict[int, float], bias: float, begins: list[tuple[int, int]] = ()):
        self.characters, self.weights, self.bias, self.begins = characters, weights, bias, begins

    def score(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        found: list[set[int]] = [set() for _ in range(len(texts))]
        for text, features in restorer.text_features(texts):
            found[text].update(features)
        return np.array([1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(own)), -30, 30))) for own in found])


class _KnownOnly(Restorer):
    """Finds the features that have a weight only. A word of letters from a to z has none unless it begins as one of their
    words does, or would with doubled letters taken out; so most words need no decoding, and are told by their bytes."""

    def __init__(self, model: ToxicityModel):
        self.weights = model.weights
        super().__init__(model.characters)
        self.plain, self.runs = (np.zeros(27**3, np.bool_) for _ in range(2))
        for word, run in model.begins:
            self.plain[[word, word // 27 * 27 + 26, word // 729 * 729 + 728]] = True  # shorter pieces may be joined to others
            a, b, c = run // 729, run // 27 % 27, run % 27
            self.runs.reshape(27, 27, 27)[a, b if b < 26 else slice(None), c if c < 26 else slice(None)] = True
            self.runs[[run, run // 27 * 27 + 26, run // 729 * 729 + 728]] = True

    def hashes(self, words: list[str]) -> tuple[int, ...]:
        return tuple(f for f in super().hashes(words) if f in self.weights)

    def may_begin(self, letters: str, places: list[int]) -> bool:
        return any(self.runs[beginning(collapsed(letters[p : p + 64])[:3])] for p in places)

    def told(self, distinct: pa.Array) -> tuple[list, np.ndarray, np.ndarray, list[str], np.ndarray]:
        n = len(distinct)
        foreign = np.flatnonzero(~np.asarray(pc.string_is_ascii(distinct)))
        lower = pc.ascii_lower(distinct)
        if len(foreign):
            decomposed = pc.utf8_normalize(pc.utf8_lower(distinct.take(pa.array(foreign))), "NFKD")
            mask = np.zeros(n, np.bool_)
            mask[foreign] = True
            lower = pc.replace_with_mask(lower, pa.array(mask), pc.replace_substring_regex(decomposed, _ACCENTS, ""))
        letters = np.asarray(pc.match_substring_regex(lower, _LETTERS_IN_MARKS))
        simple, others = np.flatnonzero(letters), np.flatnonzero(~letters)
        found: list = [()] * n
        heads, tails, begins = np.full(n, -1), np.full(n, -1), np.zeros(n, np.bool_)
        bares: list = [""] * n
        if len(others):
            pieces = strings(distinct.take(pa.array(others)))
            for i, features, shape in zip(others.tolist(), self.cache.get(pieces), self.shapes.get(pieces), strict=True):
                found[i] = features
                heads[i], tails[i], bares[i] = shape
        if len(simple):
            own = lower.take(pa.array(simple))
            cores = pc.utf8_trim(own, _IDLE)
            ends, data = large(cores)
            size, data = np.diff(ends), np.frombuffer(data, np.uint8).astype(np.int64) - 97
            first, last = data[ends[:-1]] * 26 + data[np.minimum(ends[:-1] + 1, len(data) - 1)], data[np.maximum(ends[1:] - 2, 0)] * 26 + data[ends[1:] - 1]
            starts = np.asarray(pc.match_substring_regex(own, "^[a-z]"))
            stops = np.asarray(pc.match_substring_regex(own, "[a-z]$"))
            heads[simple] = np.where(size == 1, -2, np.where(starts, first, -1))
            tails[simple] = np.where(size == 1, -2, np.where(stops, last, -1))
            changes = np.ones(len(data), np.bool_)
            changes[1:] = data[1:] != data[:-1]
            changes[ends[:-1]] = True
            kept = np.concatenate([[0], np.cumsum(changes)])[ends]
            wanted = self.plain[_beginnings(data, ends)]
            begins[simple] = wanted
            doubled = np.diff(kept) < size
            wanted = wanted | doubled & self.runs[_beginnings(data[changes], kept)]
            for i, b in zip(simple.tolist(), strings(cores), strict=True):
                bares[i] = b
            hit = simple[wanted].tolist()
            for i, features in zip(hit, self.cache.get(strings(distinct.take(pa.array(hit, pa.int64())))), strict=True):
                found[i] = features
        return found, heads, tails, bares, begins


def _beginnings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """beginning() of words given as numbers of letters from 0."""
    n = np.zeros(len(ends) - 1, np.int64)
    for k in range(3):
        at = ends[:-1] + k
        n = n * 27 + np.where(at < ends[1:], data[np.minimum(at, len(data) - 1)], 26)
    return n


class _Noting(Restorer):
    """Notes for each feature how its word begins."""

    def __init__(self, model: np.ndarray):
        super().__init__(model)
        self.begins: dict[int, int] = {}

    def hashes(self, words: list[str]) -> tuple[int, ...]:
        found = super().hashes(words)
        for w in words:
            for f, own in ((zlib.crc32(w.encode()), w), *((zlib.crc32(w[:k].encode() + b"*"), w[:k]) for k in (4, 5, 6) if len(w) > k)):
                if len(w) > 2 and f not in self.begins:
                    a, b = beginning(own), beginning(collapsed(own))
                    self.begins[f] = a << 15 | b if a >= 0 and b >= 0 else -1
        return found


def _sampled(characters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(small_batches(batches, most=BATCH_BYTES // 2)):
            restorer = _Noting(characters)
            found: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for text, features in restorer.text_features(batch.column("text")) if batch.num_rows else ():
                found[text].update(features)
            # only features of toxic texts are chosen
            begins = [np.array([restorer.begins[f] for f in sorted(x)] if label == 1 else [], "<i4").tobytes() for x, label in zip(found, batch.column("_label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array([np.array(sorted(x), "<u4").tobytes() for x in found], pa.binary()), pa.array(begins, pa.binary())], ["doc_id", "label", "features", "begins"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The character model of all texts, and weights learned from a bounded sample of labels.toxic."""
    ship_code(docs.sparkSession)
    characters = character_model(docs)
    rows, shares = sample(docs, labels, "toxic")
    if len(shares) < 2:
        return ToxicityModel(characters, {}, 30.0 * (2 * next(iter(shares), 0) - 1))
    found = sorted(rows.select("doc_id", text_or_empty().alias("text"), "_label").mapInArrow(_sampled(characters), "doc_id long, label int, features binary, begins binary").collect())
    y = np.array([r["label"] for r in found])
    sets = [np.frombuffer(r["features"], "<u4") for r in found]
    begins = {f: b for r, s in zip(found, sets, strict=True) if r["label"] == 1 for f, b in zip(s.tolist(), np.frombuffer(r["begins"], "<i4").tolist(), strict=True)}
    counts = []
    for k in (0, 1):
        own = [s for s, label in zip(sets, y, strict=True) if label == k]
        counts.append((dict(zip(*(x.tolist() for x in np.unique(np.concatenate(own), return_counts=True)), strict=True)) if own else {}, max(1, len(own))))
    (clean, n0), (toxic, n1) = counts
    gain = {}
    for f, n in toxic.items():
        m = clean.get(f, 0)
        if n >= LEAST and n / n1 > 4 * m / n0:
            expected = (n + m) / (n0 + n1)
            g = 2 * (n * np.log(n / (n1 * expected)) + (m * np.log(m / (n0 * expected)) if m else 0))
            if g >= GAIN:
                gain[f] = g
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES]
    place = {f: k for k, f in enumerate(chosen)}
    x = np.zeros((len(sets), len(chosen) + 1))
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, [place[f] for f in s.tolist() if f in place]] = 1
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum())) * len(y)
    w, ridge = np.zeros(len(chosen) + 1), np.append(np.full(len(chosen), RIDGE), 1e-6)
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - y) * weight) + ridge * w
        w -= np.linalg.solve((x * (np.maximum(p * (1 - p), 1e-6) * weight)[:, None]).T @ x + np.diag(ridge), slope)
    b = w[-1]
    known = [(begins[f] >> 15, begins[f] & 32767) for f in chosen if begins[f] >= 0]
    return ToxicityModel(characters, {f: float(w[k]) for f, k in place.items()}, float(b), known)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, 0 to 1: how likely label 1 is. Null and empty texts have no features and the score of the bias;
    repeated rows are scored each; other columns are ignored."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _KnownOnly(model)
        for batch in released(small_batches(batches, most=BATCH_BYTES // 2)):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text"), restorer))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
