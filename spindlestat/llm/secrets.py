"""Secret scan: three fixed patterns, and a battery of randomness tests for tokens that look like nothing known.

Base spans are the matches of ASSIGN, ACCESS and HEX, leftmost and not overlapping for each kind, short ones dropped.

The method adds spans of kind `random`. Candidates are runs of base-64 signs and, where a run as a whole is none, its parts
between `/ + - _`, of LEAST characters or more. The narrowest alphabet that holds a candidate is its inferred encoding.
Four tests ask whether it is compatible with uniform random draws from that alphabet. The chi-squared test of the whole
alphabet is split into two independent ones, for the shares of its kinds of signs (vowels, common and rare consonants of
either case, digits, other signs), and for the shares of signs within each kind; a runs test counts how often kinds follow
each other; and neighbours are tested for serial correlation. Fisher's rule combines the p-values into one score, which is
even between 0 and 1 for random tokens and near 0 for words.

How near depends on the length, and on whether there are digits, which words rarely have, or signs that join words. So
candidates fall into classes by length and by that, and the score that one must reach is learnt from the corpus for each
class, under control of the false discovery rate. Each document gives decoys of each length, cut from its own words: with
nothing between them, joined by one of the signs, and again from about a word with a digit on, if it has any. The share of decoys that reach a score, times the number of
candidates, over the number of candidates that reach it, estimates the share of false discoveries; the least score at which
that is RATE or below is the cut of the class (Benjamini and Hochberg's rule on p-values from decoys). fit() counts scores
over all texts; only these counts, some hundred numbers, reach the driver.

A class with fewer than ENOUGH decoys can't prove anything, whatever the size of the corpus; its cut is that of DEFAULT. A
class with enough decoys in which no score keeps the rate has no discoveries. Both are told: fit() returns, by class, the
cut, the number of decoys and of candidates, and which case it is. Cuts depend on the corpus; where the same text must have
the same spans in every load, fit once and pass the result on. DEFAULT can be passed as well.

A null text is empty and has no spans. Positions are code points, ends exclusive. Equal texts have equal spans. Without
any text all cuts are those of DEFAULT. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed by the contract of the query.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Shortest candidate, of digits alone too (shorter numbers are ordinary), and the false discovery rate.
LEAST, LEAST_DECIMAL, RATE = 16, 40, 0.02
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
WORDS = re.compile(r"[A-Za-z0-9]+")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "UPPER": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Lengths from which each class of lengths goes on; steps of scores, which are finer near 0; decoys that a class must have to learn from.
LENGTHS = (16, 20, 24, 32, 48, 96)
STEPS, ENOUGH = 100, 300
CLASSES = 3 * len(LENGTHS)  # of letters alone; with digits; with other signs
NEVER = 2.0


@dataclass(frozen=True)
class Thresholds:
    """By class: the score to reach, the numbers of decoys and candidates it was learnt from, and how: `learnt`, `default` (too few decoys), or `none` (no score keeps the rate)."""

    cuts: tuple[float, ...]
    decoys: tuple[int, ...] = (0,) * CLASSES
    candidates: tuple[int, ...] = (0,) * CLASSES
    sources: tuple[str, ...] = ("default",) * CLASSES


#: Scores that few words reach: 1 or 2 in 100 of each class in prose, fewer of long ones.
DEFAULT = Thresholds((0.3, 0.15, 0.05, 0.01, 0.003, 0.001, 0.2, 0.1, 0.03, 0.01, 0.003, 0.001, 0.2, 0.1, 0.03, 0.01, 0.003, 0.001))


def kind_of(c: str) -> str:
    """v, c and r: vowels, common and rare consonants; capitals as V and C; digits d; other signs o."""
    if c.isdigit():
        return "d"
    if not c.isalpha():
        return "o"
    low = c.lower()
    kind = "v" if low in "aeiou" else "c" if low in "bcdfghlmnprst" else "r"
    return kind if c.islower() else "V" if kind == "v" else "C"


class Alphabet:
    def __init__(self, signs: str):
        self.signs, self.index = frozenset(signs), {c: i for i, c in enumerate(signs)}
        self.kinds = {c: kind_of(c) for c in signs}
        self.size = Counter(self.kinds.values())
        self.share = {k: n / len(signs) for k, n in self.size.items()}


SETS = {name: Alphabet(signs) for name, signs in ALPHABETS.items()}


def encoding(run: str) -> str | None:
    """The narrowest alphabet that holds the run; None if no one alphabet does."""
    signs = set(run)
    return next((name for name, a in SETS.items() if signs <= a.signs), None)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x), by Wilson and Hilferty's cube root."""
    if df < 1:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str, name: str) -> tuple[float, float, float, float]:
    """p-values of the chi-squared tests of kinds and within kinds, the runs and the serial-correlation test, for uniform draws from the alphabet."""
    a, n = SETS[name], len(run)
    kinds = [a.kinds[c] for c in run]
    counts = Counter(kinds)
    p_kinds = chi2_tail(sum((counts[k] - n * p) ** 2 / (n * p) for k, p in a.share.items()), len(a.share) - 1)
    # within a kind, signs are even: squares over the expected number, less that number for each sign
    of_kind: Counter = Counter()
    for c, m in Counter(run).items():
        of_kind[a.kinds[c]] += m * m
    within = sum(of_kind[k] * a.size[k] / m - m for k, m in counts.items())
    p_within = chi2_tail(within, sum(a.size[k] - 1 for k in counts))
    squares, cubes = sum(k**2 for k in counts.values()), sum(k**3 for k in counts.values())
    mean = (n * (n + 1) - squares) / n
    var = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n**3) / (n * n * (n - 1)) if n > 1 else 0.0
    turns = 1 + sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    p_runs = two_sided((turns - mean) / math.sqrt(var)) if var > 1e-12 else 1.0
    values = [a.index[c] for c in run]
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    r = sum((x - m) * (y - m) for x, y in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    return p_kinds, p_within, p_runs, two_sided((r + 1 / n) * math.sqrt(n))


def score(run: str) -> float | None:
    """Fisher's combination of the four p-values; None for what is no candidate."""
    name = encoding(run)
    if name is None or len(run) < (LEAST_DECIMAL if name == "decimal" else LEAST):
        return None
    x = -sum(math.log(max(p, 1e-300)) for p in battery(run, name))
    return math.exp(-x) * (1 + x + x * x / 2 + x**3 / 6)


def class_of(run: str) -> int:
    """The class of a run by its length, and whether it has digits or other signs."""
    return bisect_right(LENGTHS, len(run)) - 1 + len(LENGTHS) * (0 if run.isalpha() else 1 if run.isalnum() else 2)


def step_of(x: float) -> int:
    return min(STEPS - 1, int(STEPS * x**0.25))


def candidates(text: str) -> Iterator[tuple[int, int, float, bool]]:
    """(start, end, score, whole): each run that an alphabet holds, and the parts of a run that has several."""
    for m in RUN.finditer(text):
        run, start = m[0], m.start()
        if (s := score(run)) is not None:
            yield start, m.end(), s, True
        if not run.isalnum():
            for part in PART.finditer(run):
                if (s := score(part[0])) is not None:
                    yield start + part.start(), start + part.end(), s, False


def random_spans(text: str, thresholds: Thresholds = DEFAULT) -> list[tuple[int, int]]:
    """The candidates that reach the cut of their class; parts only of runs that don't."""
    out: list[tuple[int, int]] = []
    for start, end, s, _ in candidates(text):
        if s >= thresholds.cuts[class_of(text[start:end])] and not (out and start < out[-1][1]):
            out.append((start, end))
    return out


def decoys(text: str) -> Iterator[str]:
    """Decoys for each class of lengths, cut from the text's words at a place that its hash tells: plain and with a sign between words; and the same from shortly before, or at, a word that has a digit."""
    words = [w for w in WORDS.findall(text) if len(w) < LEAST]
    place = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    longest = LENGTHS[-1] + LENGTHS[-1] // 2
    digits = [i for i, w in enumerate(words) if not w.isalpha()]
    # enough words from a place on; short texts whole
    places = [place % max(1, len(words) - longest // 3)] + ([max(0, digits[place % len(digits)] - place // 7 % 4)] if digits else [])
    for first in places:
        for sign in ("", "_-/+"[place % 4]):
            joined = sign.join(words[first : first + longest])
            for k, low in enumerate(LENGTHS):
                high = LENGTHS[k + 1] if k + 1 < len(LENGTHS) else longest
                n = low + place % (high - low)
                if len(joined) >= n:
                    yield joined[:n]


def learnt(counts: dict[tuple[int, bool, int], int]) -> Thresholds:
    """The thresholds from numbers of (class, is a decoy, step of the score)."""
    cuts, sources, sizes = [], [], []
    for k in range(CLASSES):
        found, false = ([counts.get((k, d, step), 0) for step in range(STEPS)] for d in (False, True))
        all_found, all_false = sum(found), sum(false)
        sizes.append((all_false, all_found))
        least, above, wrong = NEVER, 0, 0
        for step in range(STEPS - 1, 0, -1):
            above, wrong = above + found[step], wrong + false[step]
            if above and (wrong + 1) / (all_false + 1) * all_found / above <= RATE:
                least = (step / STEPS) ** 4
        source = "default" if all_false < ENOUGH else "none" if least == NEVER else "learnt"
        cuts.append(DEFAULT.cuts[k] if source == "default" else least)
        sources.append(source)
    return Thresholds(tuple(cuts), tuple(d for d, _ in sizes), tuple(c for _, c in sizes), tuple(sources))


def fit(docs: DataFrame, text_col: str = "text") -> Thresholds:
    """The thresholds for these texts, from the scores of all candidates and decoys."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                if text:
                    seen.update((class_of(text[s:e]), False, step_of(x)) for s, e, x, _ in candidates(text))
                    seen.update((class_of(d), True, step_of(x)) for d in decoys(text) if (x := score(d)) is not None)
        yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["class", "decoy", "step", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "class int, decoy boolean, step int, n long")
    return learnt({(r["class"], r["decoy"], r["step"]): r["n"] for r in rows.groupBy("class", "decoy", "step").agg(F.sum("n").alias("n")).collect()})


def scan(text: str, thresholds: Thresholds = DEFAULT) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then by kind in the order of KINDS. A random span that meets a base one is none."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    out, at, reach = list(base), 0, 0
    for start, end in random_spans(text, thresholds):
        while at < len(base) and base[at][0] < end:
            reach, at = max(reach, base[at][1]), at + 1
        if reach <= start:
            out.append((start, end, "random"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def spans_column(text: Column, thresholds: Thresholds = DEFAULT) -> Column:
    """struct(n_assign, n_access, n_hex, n_random, base_sha256, spans) of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    def secret_spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part:
                found = scan(text or "", thresholds)
                kinds = [k for *_, k in found]
                base = listed([x for x in found if x[2] != "random"])
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(found)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return secret_spans(text)


def redact(text: str, thresholds: Thresholds = DEFAULT) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one, of the first one's kind."""
    out, at = [], 0
    for s, e, kind in scan(text, thresholds):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted_column(text: Column, thresholds: Thresholds = DEFAULT) -> Column:
    """The redacted text; a null text stays null."""

    @F.pandas_udf("string")
    def redacted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if t is None else redact(t, thresholds) for t in part], dtype=object)

    return redacted(text)
