"""Decoding against a search of all paths, and the quick way to features against the plain one."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from sparkvec.llm import toxicity


def character_model(text):
    counts = np.ones((28, 28, 28))
    codes = toxicity.byte_codes()[np.frombuffer(text.encode(), np.uint8)]
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    return np.log(counts / counts.sum(2, keepdims=True))


MODEL = character_model("  you idiot are such a loser  you are a stupid moron and i say the scum is a clown  " * 50)


def every_reading(text):
    """The score of each reading by trying every path, under the costs that the module states."""
    marks = "".join(c for c in toxicity.LOOKS_LIKE if not c.isalnum())
    first, last = len(text) - len(text.lstrip(marks)), len(text.rstrip(marks))
    choices, previous = [], ""
    for at, c in enumerate(text):
        if c.isalpha():
            choices.append([(c, 0.0)] + ([("", toxicity.REPEATED)] if c == previous else []))
            previous = c
            continue
        own = [(x, toxicity.WRITTEN) for x in toxicity.LOOKS_LIKE.get(c, "")]
        if c in toxicity.BETWEEN or c == " " or c in marks and not first <= at < last:
            own.append(("", 0.0 if c == " " else toxicity.LEFT_OUT))
        if c in toxicity.BETWEEN or c == " ":
            own.append((" ", 0.0 if c == " " else toxicity.LEFT_OUT))
        if c in toxicity.HIDING and 0 < at < len(text) - 1:
            own += [(x, toxicity.HIDDEN) for x in "aeiou"]
        choices.append(own)
    readings = {}
    for path in itertools.product(*choices):
        a = b = 26
        score, out = 0.0, ""
        for x, cost in path:
            score -= cost
            if x == " " and b == 26:
                break
            if x:
                k = 26 if x == " " else ord(x) - 97
                score += MODEL[a][b][k] + toxicity.EACH
                a, b, out = b, k, out + x
        else:
            readings[out.strip()] = max(readings.get(out.strip(), -np.inf), score + MODEL[a][b][26])
    return readings


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(4)
    words = ["1d10t", "l o s e r", "s-c-u-m", "stuupid", "5tup1d", "m0r0n!", "c|own", "1oser$", "you a", "!d!ot"]
    words += ["".join(r.choice(list("aidotslu015!$ -*"), r.integers(2, 8))) for _ in range(150)]
    tried = 0
    for word in words:
        bare = word.strip(toxicity._IDLE)
        if bare and (readings := every_reading(bare)):
            assert readings[toxicity.restore(bare, MODEL)] > max(readings.values()) - 1e-9, word  # ties may fall either way
            tried += 1
    assert tried > 100


def test_known_features_are_those_of_the_plain_way():
    r = np.random.default_rng(3)
    parts = ["a", "y", "i", " ", "  ", "the", "idiot", "1d10t", "st", "upid", "l o s e r", "é", "É", "STUPID", "stuuupid", "ll", "oo", "-", ".", "@", "5", "\n", "s", "c", "u", "m", "ß", "Привет", "!", "«", "x", " ", "l", "0"]
    texts = pa.array(["".join(r.choice(parts, r.integers(0, 16))) for _ in range(2000)])
    noting = toxicity._Noting(MODEL)
    plain = [set() for _ in texts]
    for text, features in noting.text_features(texts):
        plain[text].update(features)
    every = sorted(set().union(*plain))
    for step in (5, 97):
        weights = dict.fromkeys(every[::step], 1.0)
        begins = [(b >> 15, b & 32767) for f in weights if (b := noting.begins[f]) >= 0]
        quick = [set() for _ in texts]
        for text, features in toxicity._KnownOnly(toxicity.ToxicityModel(MODEL, weights, 0.0, begins)).text_features(texts):
            quick[text].update(features)
        assert quick == [x & set(weights) for x in plain]


def test_a_beginning_is_no_whole_word():
    r = toxicity.Restorer(MODEL)
    assert zlib.crc32(b"yupid") not in r.hashes(["xupidly"])
