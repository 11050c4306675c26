"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as the mean of its words' vectors (how the
word is written, and hashed embeddings of its beginning and end) with measures of repetition. A gated attention network,
learned from document labels only, weighs the passages; the weighted mean is scored. All passages of all texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm.common import BATCH_BYTES, ship_code, small_batches, table, text_or_empty
from sparkvec.llm.labelled import held_out, sample
from sparkvec.llm.words import released, split_batch

PASSAGE, THRESHOLD = 64, 0.3
#: Bytes counted in each word: upper case, lower case, digits, white space, parts of other letters, and single marks.
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13), range(128, 256), b"!", b"|", b".,;:", b"&$#%*", b"\"'()[]{}<>=+-_/\\@^~?`"]
_EMBEDDED, _BUCKETS = 8, 4096


def _class_table() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.int64)
    for k, own in enumerate(_CLASSES):
        out[list(own)] = k
    return out


def _word_vectors(distinct: pa.Array) -> np.ndarray:
    """A row for each distinct word: shares of byte classes, length, class of the last byte, hashed beginning and end."""
    distinct = distinct.cast(pa.large_string())
    ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes, n, kinds = np.diff(ends), len(distinct), len(_CLASSES) + 1
    classes = _class_table()[data]
    counts = np.bincount(np.repeat(np.arange(n), sizes) * kinds + classes, minlength=n * kinds).reshape(n, kinds)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    some = sizes > 0
    last = np.zeros((n, kinds), np.float32)
    last[np.flatnonzero(some), classes[ends[1:][some] - 1]] = 1
    mixed = []
    for near in (ends[:-1], np.maximum(ends[1:] - 3, ends[:-1])):
        key = sum(np.where(k < sizes, padded[near + k], 0) << np.uint64(8 * k) for k in range(3))
        mixed.append(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _BUCKETS)
    table = np.random.default_rng(7).standard_normal((2, _BUCKETS, _EMBEDDED)).astype(np.float32)
    share = counts / np.maximum(sizes, 1)[:, None]
    return np.hstack([share, last, np.minimum(sizes, 40)[:, None] / 10, table[0][mixed[0]], table[1][mixed[1]]]).astype(np.float32)


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each passage, where each text's passages begin with the end at last). A text has one passage at least."""
    index, bounds, distinct = split_batch(texts)
    words = _word_vectors(distinct)
    sizes = np.diff(bounds)
    per_text = -(-sizes // PASSAGE)
    ends = np.concatenate([[0], np.cumsum(per_text)])
    starts = np.repeat(bounds[:-1] - PASSAGE * ends[:-1], per_text) + PASSAGE * np.arange(ends[-1])
    n = np.diff(np.concatenate([starts, bounds[-1:]]))
    means = np.add.reduceat(words[index], starts, axis=0) / n[:, None]
    own = np.repeat(np.arange(len(starts)), n)
    keys, times = np.unique(own * len(distinct) + index, return_counts=True)
    of = keys // len(distinct)
    unique = np.bincount(of, minlength=len(starts)) / n
    most = np.zeros(len(starts))
    np.maximum.at(most, of, times)
    text_unique = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(distinct) + index) // len(distinct)
    whole = np.bincount(text_unique, minlength=len(sizes)) / sizes
    extra = np.stack([unique, most / n, np.log1p(n), np.repeat(whole, per_text), np.log1p(np.repeat(sizes, per_text))], 1)
    return np.hstack([means, extra]).astype(np.float32), ends


def _softmax(e: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    x = np.exp(e - np.maximum.reduceat(e, starts)[of])
    return x / np.add.reduceat(x, starts)[of]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionPool:
    """Gated attention over passages: weight ~ exp(w . (tanh(V h) * sigmoid(U h))), h = relu(W x + b), score = sigmoid(c . sum + c0)."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": init(width, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "c0": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def _forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = _softmax((t * g) @ p["w"], starts, of)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        return self._forward((x - self.mean) / self.scale, ends[:-1], of)["y"]

    def _gradient(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, starts, of)
        do = (f["y"] - y) * weight / weight.sum()
        dz = do[:, None] * p["c"]
        da = (dz[of] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[of])
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ do, "c0": do.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> None:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        r, step = np.random.default_rng(5), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in own])
                of = np.repeat(np.arange(len(own)), sizes)
                grad = self._gradient(np.concatenate([bags[i] for i in own]), np.cumsum(sizes) - sizes, of, y[own], weight[own])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(small_batches(batches, most=BATCH_BYTES // 4)):
        if batch.num_rows:
            x, ends = encode_passages(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame) -> AttentionPool | float:
    """The model, learned from a bounded sample of labels.quality; the share of label 1 where there is one class or none."""
    ship_code(docs.sparkSession)
    rows, shares = sample(docs, labels, "quality")
    if len(shares) < 2:
        return float(next(iter(shares), 1))
    found = sorted(rows.mapInArrow(_bags, "doc_id long, label int, bag binary").collect())
    width = len(encode_passages(pa.array(["x"]))[0][0])
    y = np.array([r["label"] for r in found], float)
    share = {k: (y == k).mean() for k in (0, 1)}
    weight = np.array([shares[int(k)] / share[int(k)] for k in y]) if all(share.values()) else np.ones(len(y))
    model = AttentionPool(width)
    model.fit([np.frombuffer(r["bag"], np.float32).reshape(-1, width) for r in found], y, weight)
    return model


def score_quality(docs: DataFrame, model: AttentionPool | float, out: str = "score") -> DataFrame:
    """docs with out, a double from 0 to 1: how likely label 1 is. Null and empty texts are bags of one empty passage, long
    ones bags of as many passages as they have. Rows are independent, repeated ones are scored each; all columns are kept,
    whatever their names, but one named as out is replaced. No rows give none."""
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field(place)], ["row", "text"]) for b in batches)
        for batch in released(small_batches(with_text, most=BATCH_BYTES // 4)):
            if batch.num_rows:
                y = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(*encode_passages(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(y.astype(np.float64))], ["row", "score"])

    shape = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, shape).select("row.*", F.col("score").alias(out))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
