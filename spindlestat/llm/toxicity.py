"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds theta_0 <= theta_1 <= ...; the
severity of a text is its expected grade, the sum of these probabilities. Features are 0/1: the words of a text and
their first 3 to 8 letters, hashed, so that inflected forms share evidence. An L1 penalty keeps the weights few.

Labels say only toxic or not, so the grades of toxic training rows are inferred, and not from what the model reads of the
same rows: training rows are dealt into two folds, each fold finds the features that are far more frequent in its own
toxic rows, and a toxic row of the other fold is of grade 1 with up to GRADE_EDGES[0] of these, of grade 2 with up to
GRADE_EDGES[1], of grade 3 beyond. So a grade says how much independent evidence a row holds.

A null text is empty, has no features, and gets the scores of the thresholds alone. Rows that repeat an id are scored each by
its own text; of a labelled id that they share, each is a row of the fit. Equal texts have equal scores. Without labels of
both kinds nothing is toxic. Long texts are scored whole. Other columns aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo, cut_lineage
from .labelled import sample

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
GRADE_EDGES = (3, 9)
#: The cut lies at twice the probability that so large a share of the clean training rows stays below, within these limits.
CLEAN, CUTS = 0.998, (0.05, 0.5)


def word_features(word: str, bits: int) -> tuple[int, ...]:
    """Hashes of the whole word and of its prefixes."""
    mask = (1 << bits) - 1
    names = [f"={word}"] + [word[:k] for k in PREFIXES if k <= len(word)]
    return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names})


@dataclass
class ToxicityModel:
    bits: int
    weights: dict[int, float]
    thresholds: tuple[float, ...]
    cut: float = 0.5  # from this P(grade > 0) on, a text counts as toxic

    def probabilities(self, z: float | np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(z)[..., None] - np.asarray(self.thresholds), -35, 35)))

    def column(self, text: Column) -> Column:
        """struct(p_toxic, severity, n_evidence): P(grade > 0), the expected grade, and how many features spoke for it."""
        bits, weights, thresholds = self.bits, self.weights, self.thresholds

        @F.pandas_udf("p_toxic double, severity double, n_evidence int")
        def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = ToxicityModel(bits, weights, thresholds)
            known = Memo(lambda w: tuple(f for f in word_features(w, bits) if f in weights))
            for part in parts:
                z, n = np.zeros(len(part)), np.zeros(len(part), np.int32)
                for i, t in enumerate(part):
                    found = {f for fs in map(known.__getitem__, set(WORD.findall((t or "").lower()))) if fs for f in fs}
                    z[i], n[i] = sum(weights[f] for f in sorted(found)), sum(weights[f] > 0 for f in found)
                    known.trim()
                p = model.probabilities(z)
                yield pd.DataFrame({"p_toxic": p[:, 0], "severity": p.sum(axis=1), "n_evidence": n})

        return toxicity(text)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 5e-5, steps: int = 400) -> tuple[dict[int, float], tuple[float, ...]]:
    """Weights by feature, and the thresholds, that minimise the mean negative log likelihood plus l1 * |w|: accelerated proximal gradient steps with restarts.

    Thresholds are kept in order by optimising the first one and the logarithms of the gaps.
    """
    names, idx = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, k = len(rows), n_grades - 1
    share = np.array([np.mean(grades > j) for j in range(k)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)))
    gaps = np.log(np.maximum(np.diff(theta), 0.05))
    w = np.zeros(len(names))
    par = np.concatenate([[theta[0]], gaps])
    thresholds = lambda par: np.cumsum(np.concatenate([par[:1], np.exp(par[1:])]))

    def loss(w: np.ndarray, par: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        th = thresholds(par)
        z = np.bincount(row, weights=w[idx], minlength=n) if len(idx) else np.zeros(n)
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - th, -35, 35))), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        slope = above * (1 - above)
        gz = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        gth = np.array([np.sum(np.where(grades == j + 1, slope[:, j + 1], np.where(grades == j, -slope[:, j + 1], 0.0)) / p) / n for j in range(k)])
        gpar = np.concatenate([[gth.sum()], [gth[j + 1 :].sum() * np.exp(par[j + 1]) for j in range(k - 1)]])
        return -np.log(p).mean(), np.bincount(idx, weights=gz[row], minlength=len(w)) if len(idx) else w * 0, gpar

    step, momentum, wy, py, w0, p0 = 4.0, 1.0, w, par, w, par
    for _ in range(steps):
        now, gw, gp = loss(wy, py)
        while True:
            wn = wy - step * gw
            wn = np.sign(wn) * np.maximum(np.abs(wn) - step * l1, 0)
            pn = py - step * gp
            d = np.concatenate([wn - wy, pn - py])
            if step < 1e-4 or loss(wn, pn)[0] <= now + np.concatenate([gw, gp]) @ d + d @ d / (2 * step) + 1e-12:
                break
            step /= 2
        if np.concatenate([wy - wn, py - pn]) @ np.concatenate([wn - w0, pn - p0]) > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        wy, py = wn + (momentum - 1) / following * (wn - w0), pn + (momentum - 1) / following * (pn - p0)
        w0, p0, momentum, step = wn, pn, following, step * 1.2
    return {int(f): float(v) for f, v in zip(names, w0, strict=True) if v}, tuple(map(float, thresholds(p0)))


def evidence(counts: DataFrame, bad: Column, fine: Column, n: int, m: int, least: int = 3, odds: float = 1.5, most: int = 20_000) -> frozenset[int]:
    """Features of at least `least` (bad) of n toxic rows whose rate there is exp(odds) times that in the m others (fine); the `most` frequent ones, ties by feature: a bound on what the driver holds."""
    lift = F.log(bad / max(1, n)) - F.log((fine + 0.5) / max(1, m))
    return frozenset(r[0] for r in counts.filter((bad >= least) & (lift > odds)).orderBy(bad.desc(), "feature").limit(most).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000, keep: Column | None = None, bits: int = 22) -> ToxicityModel:
    """Learns from at most `most` labelled documents (a documented bound). Without labelled or toxic rows, nothing is toxic."""

    def hashed(wanted: frozenset[int] | None):
        """The features of each text, or those of them that are wanted."""

        @F.pandas_udf("array<int>")
        def hashed_features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            of = Memo(lambda w: tuple(f for f in word_features(w, bits) if wanted is None or f in wanted), 100_000)
            for part in parts:
                out = []
                for t in part:
                    out.append(np.array(sorted({f for fs in map(of.__getitem__, set(WORD.findall(t.lower()))) for f in fs}), np.int32))
                    of.trim()
                yield pd.Series(out)

        return hashed_features("text")

    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)).cast("int")
    rows = sample(docs, labels, label, most, keep).withColumn("fold", fold)
    one = lambda test: F.count_if(test)
    sides = {f"{name}{f}": (F.col("label") > 0 if name == "bad" else F.col("label") <= 0) & (F.col("fold") == f) for name in ("bad", "fine") for f in (0, 1)}
    sizes = rows.agg(*[one(t).alias(c) for c, t in sides.items()]).first().asDict()
    if not sizes["bad0"] + sizes["bad1"]:
        return ToxicityModel(bits, {}, (35.0,) * 3)
    per = cut_lineage(rows.select("label", "fold", F.explode(hashed(None)).alias("feature")).groupBy("feature").agg(*[one(t).alias(c) for c, t in sides.items()]))
    kept = evidence(per, F.col("bad0") + F.col("bad1"), F.col("fine0") + F.col("fine1"), sizes["bad0"] + sizes["bad1"], sizes["fine0"] + sizes["fine1"])
    by_fold = [evidence(per, F.col(f"bad{f}"), F.col(f"fine{f}"), sizes[f"bad{f}"], sizes[f"fine{f}"], least=2) for f in (0, 1)]
    got = rows.select("doc_id", "label", "fold", hashed(kept | by_fold[0] | by_fold[1]).alias("idx")).toPandas()
    got = got.assign(size=got.idx.map(len)).sort_values(["doc_id", "size"], kind="stable")
    toxic, found = got.label.to_numpy(np.int64) > 0, [np.asarray(r, np.int64).tolist() for r in got.idx]
    independent = [sum(f in by_fold[1 - fold] for f in r) for r, fold in zip(found, got.fold, strict=True)]
    grades = np.where(toxic, 1 + np.searchsorted(GRADE_EDGES, independent, side="left"), 0)
    rows = [np.array([f for f in r if f in kept], np.int64) for r in found]
    weights, thresholds = fit_ordinal(rows, grades, 2 + len(GRADE_EDGES))
    model = ToxicityModel(bits, weights, thresholds)
    clean = model.probabilities(np.array([sum(weights.get(f, 0.0) for f in r.tolist()) for r, t in zip(rows, toxic, strict=True) if not t] or [0.0]))[:, 0]
    model.cut = float(np.clip(2 * np.quantile(clean, CLEAN), *CUTS))
    return model
