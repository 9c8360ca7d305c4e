"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

A text becomes the shares that its word n-grams (n = 1, 2) have in all its n-grams, each n-gram hashed to one of
2**bits buckets; a word followed by itself is one common n-gram, whatever the word, so that repetition shows in any
vocabulary. Words are runs of letters and digits, and runs of one other sign. A score is a sparse dot product.

A null text is empty, has no n-grams, and gets the score of the bias alone. Rows that repeat an id are scored each by its own
text; of a labelled id that they share, each is a row of the fit, however many they are. Equal texts have equal scores. Long
texts are scored whole. Other columns aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo
from .labelled import sample

TOKEN = re.compile(r"\w+|([^\w\s])\1*")
REPEAT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters of the texts that one task fits, on average.
PART_CHARS = 1 << 24


def _hash_word(word: str) -> int:
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)


class Featuriser:
    def __init__(self, bits: int):
        self.shift, self.ids = np.uint64(64 - bits), Memo(_hash_word)

    def __call__(self, text: str) -> np.ndarray:
        """The bucket of every n-gram of the text, in order, repeats included."""
        words = [m[0] for m in TOKEN.finditer(text.lower())]
        h = np.fromiter(map(self.ids.__getitem__, words), np.uint64, len(words))
        self.ids.trim()
        pairs = (h[:-1] * MIX) ^ (h[1:] + REPEAT)
        pairs[h[:-1] == h[1:]] = REPEAT
        grams = np.concatenate([h, pairs])
        return ((grams * MIX) >> self.shift).astype(np.int64)


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray = field(repr=False)
    bias: float
    scale: float

    def score(self, grams: np.ndarray) -> float:
        z = self.bias + (self.scale * float(self.weights[grams].sum(dtype=np.float64)) / len(grams) if len(grams) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    def column(self, text: Column) -> Column:
        """The score (0 to 1) of a text column; a null text counts as empty and gets the bias alone."""
        packed = np.flatnonzero(self.weights).astype(np.int32), self.weights[self.weights != 0]
        bits, bias, scale = self.bits, self.bias, self.scale

        @F.pandas_udf("double")
        def quality_score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, grams = unpack(bits, packed, bias, scale), Featuriser(bits)
            for part in parts:
                yield pd.Series([model.score(grams(t or "")) for t in part], dtype="float64")

        return quality_score(text)


def unpack(bits: int, packed: tuple[np.ndarray, np.ndarray], bias: float, scale: float) -> QualityModel:
    weights = np.zeros(1 << bits, np.float32)
    weights[packed[0]] = packed[1]
    return QualityModel(bits, weights, bias, scale)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, scale: float, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> QualityModel:
    """FTRL-proximal, one row at a time in the given order; rows are (bucket, share) pairs; the bias isn't regularised."""
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for (idx, share), y in zip(rows, labels, strict=True):
            x = share * scale
            w, b = weight(z[idx], n[idx]), -zb / ((beta + np.sqrt(nb)) / alpha + 1e-9)
            p = 1 / (1 + np.exp(-np.clip(b + w @ x, -35, 35)))
            g = (p - y) * x
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha * w
            n[idx] += g * g
            zb += (p - y) - (np.sqrt(nb + (p - y) ** 2) - np.sqrt(nb)) / alpha * b
            nb += (p - y) ** 2
    return QualityModel(bits, weight(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha + 1e-9)), scale)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 3000, keep: Column | None = None, bits: int = 18, scale: float = 20.0, **params) -> QualityModel:
    """Learns from at most `most` labelled ids (a documented bound: the model doesn't need more, whatever the corpus), and all of their rows.

    Tasks hash the chosen texts and fit them. Up to `most` rows and PART_CHARS characters are one part, which is fitted row by
    row. Ids that are repeated, or long texts, make more: these are fitted side by side, and the weights of the parts are
    averaged by their rows (parameter mixing). Rows of the same id, label and text travel once with their number, and are dealt
    evenly to the parts. Only weights reach the driver. Without any labelled row, every score is 0.5.
    """

    @F.pandas_udf("idx array<int>, share array<float>")
    def shares(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Featuriser(bits)
        for part in parts:
            out = [np.unique(g, return_counts=True) if len(g := grams(t)) else (g, g) for t in part]
            yield pd.DataFrame({"idx": [i.astype(np.int32) for i, _ in out], "share": [(c / max(1, c.sum())).astype(np.float32) for _, c in out]})

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        """The weights of a part and, as bucket -1, its bias, times its rows."""
        part = part.assign(order=pd.util.hash_array(part.doc_id.to_numpy().astype(np.int64)), size=part.idx.map(len)).sort_values(["order", "size", "key"], kind="stable")
        rows = [(np.asarray(i, np.int64), np.asarray(s, np.float64)) for i, s in zip(part.idx, part.share, strict=True)]
        each = np.repeat(np.arange(len(part)), part.copies)
        model = ftrl([rows[i] for i in each], part.label.to_numpy(np.float64)[each], bits, scale, **params)
        found = np.flatnonzero(model.weights)
        return pd.DataFrame({"bucket": np.append(found, -1).astype(np.int32), "weight": np.append(model.weights[found].astype(np.float64), model.bias) * len(each)})

    rows = sample(docs, labels, label, most, keep)
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not n:
        return QualityModel(bits, np.zeros(1 << bits, np.float32), 0.0, scale)
    n_parts = max(-(-n // most), -(-chars // PART_CHARS))
    hashed = rows.select("doc_id", "label", F.xxhash64("text").alias("key"), shares("text").alias("x"))
    hashed = hashed.groupBy("doc_id", "label", "key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    dealt = hashed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(n_parts)) - 1)))
    part = F.pmod(F.xxhash64("doc_id", "key") % n_parts + F.col("turn"), F.lit(n_parts)).alias("part")
    copies = (F.floor(F.col("n") / n_parts) + (F.col("turn") < F.col("n") % n_parts).cast("long")).alias("copies")
    weights = dealt.select("doc_id", "label", "key", "x.idx", "x.share", part, copies).groupBy("part").applyInPandas(fitted, "bucket int, weight double")
    got = weights.groupBy("bucket").agg((F.sum("weight") / n).alias("weight")).toPandas()
    mean = np.zeros(1 + (1 << bits))
    mean[got.bucket.to_numpy()] = got.weight.to_numpy()  # -1, the bias, is the last one
    return QualityModel(bits, mean[:-1].astype(np.float32), float(mean[-1]), scale)
