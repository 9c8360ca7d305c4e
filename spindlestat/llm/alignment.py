"""Alignment of two tokenizers' cuts of the same texts, and how often their tokens meet across the corpus.

Each text is encoded by a byte-level BPE (A, of a space and the text) and by a sentence-piece model (B, of the text, before
which it puts a space). Where the bytes of both token sequences are those of space and text, their ends are places in the
same bytes. A whole slice of an Arrow batch is laid out as one run of bytes, with the places where documents begin. The
ends of all A tokens are counted by place in one bincount, those of all B tokens in another. Where both end, a group ends.
Between two neighbouring ends, whoever's they are, just one A token lies over just one B token: that is a link. Prefix sums
of these three marks, taken between a document's first and last byte, give its tokens, groups and links.

Encoding is by the libraries themselves. No token of either tokenizer holds a single space between two other signs unless
as its first sign, so texts are encoded in parts that begin at such spaces, each part once as long as a worker remembers
it (a vocabulary of sentence pieces for which this fails has its texts encoded whole).

A pair of ids counts once for each document (row) in which a link joins it. Pairs with the greatest counts, MOST_PAIRS at
most, are shipped to tasks as sorted arrays. The rows of all others, which stand in few documents each, are joined by
shuffle. What is kept between the two passes is one compressed table of pair numbers in the folder of checkpoints.

A text that is null, empty, or whose bytes are not both sequences' (it holds U+2581, say) has no tokens: zeros and no
groups. Rows that repeat an id, or have none, are documents of their own. An empty table gives an empty result. Other
columns aren't looked at. Long texts are one row each, whose tokens fit into a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_signs
from .common import cut_lineage, id_and_text, record, slices, stored, strings

#: Pairs of ids that tasks hold as arrays, at most.
MOST_PAIRS = 1 << 20
#: Parts of texts, and their signs, that a worker remembers at most before it begins anew.
MOST_PARTS, MOST_SIGNS = 300_000, 32 << 20
SLICE = 2 << 20
TANGLED, CLEAN = re.compile(r"\s\s|^\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
#: The usual pattern of byte-level BPE, and the first code point from which on later versions of Unicode may have new letters. Fixed values.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = "\u0250"


class Side:
    """The remembered parts of one tokenizer: ids of part k at flat[start[k] : start[k + 1]]; size is the bytes of each id."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.bytes = token_bytes
        self.size = np.zeros(max(token_bytes) + 1, np.int64)
        self.size[list(token_bytes)] = [len(b) for b in token_bytes.values()]
        self.forget()

    def forget(self) -> None:
        self.flat, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, found: list[list[int]]) -> None:
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        self.flat, self.start = np.concatenate([self.flat, flat]), np.concatenate([self.start, self.start[-1] + np.cumsum(n)])

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text

    def ids(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts, one part after the other, and how many each has."""
        first = self.start[parts]
        n = self.start[parts + 1] - first
        return self.flat[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)], n


class Numbers(dict):
    """Numbers parts in the order in which they are first asked for; `new` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = n = len(self)
        return n


def ranked(content: str):
    """The same byte-level BPE by ranks, if the file's merges make ids in ascending order and words are cut by the usual pattern; else None."""
    import tiktoken

    model, cut = (x := json.loads(content))["model"], x.get("pre_tokenizer") or {}
    signs, vocab = byte_signs(), model["vocab"]
    joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if x.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges") or joined != sorted(joined):
        return None
    made = set(joined)
    ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if i in made or len(t) == 1 and t in signs}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Both tokenizers, and the parts of texts that they have encoded."""

    def __init__(self, content_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(content_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.ranked = ranked(content_a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        signs = byte_signs()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        spelt = lambda t: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode()
        self.left = Side({i: spelt(t) for t, i in self.a.get_vocab().items()})
        self.right = Side({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)})
        self.number = Numbers()
        self.fits, self.signs = np.zeros(0, bool), 0
        # a token as it is written within a group, and as its last
        self.written = [f"{i}{sign}" for i in range(len(self.left.size)) for sign in ",|"] + [f"{i}{sign}" for i in range(len(self.right.size)) for sign in ",;"]

    def _encode_a(self, parts: list[str]) -> list[list[int]]:
        """A's ids of a space and each part. Where all signs are of blocks that have long been complete, ranks give the same, at a fraction of the time."""
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)]
        out = [None if p and max(p) >= SETTLED else self.ranked.encode_ordinary(f" {p}") for p in parts]
        others = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(others, self.a.encode_batch_fast([f" {parts[k]}" for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    @property
    def factor(self) -> int:
        """A pair of ids is one number: A's id times this, plus B's."""
        return len(self.right.size)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return [text] if self.whole else CLEAN.split(text) if TANGLED.search(text) else text.split(" ")

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all parts of all texts, and how many each text has."""
        if len(self.number) > MOST_PARTS or self.signs > MOST_SIGNS:
            self.number, self.fits, self.signs = Numbers(), np.zeros(0, bool), 0
            self.left.forget()
            self.right.forget()
        cuts = [self.cut(t) for t in texts]
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cuts)), np.int64, int(n.sum()))
        new, self.number.new = self.number.new, []
        if new:
            ids_a = self._encode_a(new)
            ids_b = self.b.encode(new, num_threads=1)
            whole = [f" {p}".encode() for p in new]
            fits = [self.left.spells(x, w) and self.right.spells(y, w) for x, y, w in zip(ids_a, ids_b, whole, strict=True)]
            self.left.learn(ids_a)
            self.right.learn(ids_b)
            self.fits = np.concatenate([self.fits, fits])
            self.signs += sum(map(len, new))
        return numbers, n


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments that end at `ends` (how many values come up to there)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


class Batch:
    """The alignment of many texts at once: n_a, n_b, n_groups and n_links by text, and a, b: the ids of each link, text by text."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.pair = pair
        parts, n = pair.parts(texts)
        # a text that one part doesn't fit has no tokens
        unfit = _sums(~pair.fits[parts], np.cumsum(n)) > 0
        parts, n = parts[np.repeat(~unfit, n)], np.where(unfit, 0, n)
        (self.ids_a, na), (self.ids_b, nb) = pair.left.ids(parts), pair.right.ids(parts)
        self.n_a, self.n_b = _sums(na, np.cumsum(n)), _sums(nb, np.cumsum(n))
        ends_a, ends_b = np.cumsum(pair.left.size[self.ids_a]), np.cumsum(pair.right.size[self.ids_b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.bincount(ends_a, minlength=size + 1), np.bincount(ends_b, minlength=size + 1)
        both, either = (at_a > 0) & (at_b > 0), (at_a > 0) | (at_b > 0)
        groups, links = np.cumsum(both), np.cumsum(either)
        last = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]  # the place where each text ends
        between = lambda total: np.diff(total[np.concatenate([[0], last])])
        self.n_groups, self.n_links = between(groups), between(links)
        place = np.flatnonzero(either)
        self.a = self.ids_a[(np.cumsum(at_a) - at_a)[place]]
        self.b = self.ids_b[(np.cumsum(at_b) - at_b)[place]]
        self.group_a, self.group_b = groups[ends_a] - both[ends_a], groups[ends_b] - both[ends_b]

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text: the ids of each group."""
        n = int(self.n_groups.sum())
        in_a, in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        up_a, up_b = np.cumsum(in_a), np.cumsum(in_b)
        sign = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        i, j = np.arange(len(self.ids_a)), np.arange(len(self.ids_b))
        sign[i + (up_b - in_b)[self.group_a]] = 2 * self.ids_a + (i + 1 == up_a[self.group_a])
        sign[j + up_a[self.group_b]] = 2 * (len(self.pair.left.size) + self.ids_b) + (j + 1 == up_b[self.group_b])
        out, at, get, signs = [], 0, self.pair.written.__getitem__, sign.tolist()
        for m in (self.n_a + self.n_b).tolist():
            out.append("".join(map(get, signs[at : at + m]))[:-1])
            at += m
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each text, text by text; how often each is linked there; and how many pairs come up to the end of each text."""
        code = self.a * self.pair.factor + self.b
        top = len(self.pair.left.size) * self.pair.factor
        found, times = np.unique(np.repeat(np.arange(len(self.n_links)), self.n_links) * top + code, return_counts=True)
        return found % top, times, np.searchsorted(found, np.arange(1, len(self.n_links) + 1) * top)


_PAIRS: dict[tuple[bytes, bytes], Pair] = {}


def pair_of(content_a: str, model_b: bytes) -> Pair:
    """A worker keeps the last pair of tokenizers, and the parts that it has seen, from task to task."""
    key = hashlib.sha256(content_a.encode()).digest(), hashlib.sha256(model_b).digest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(content_a, model_b)
    return _PAIRS[key]


def _list(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def encoded(docs: DataFrame, content_a: str, model_b: bytes, digest: bool) -> DataFrame:
    """doc_id, COUNTS, groups, pairs, times, row (a number) of every row of docs (doc_id, text); written."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((content_a, model_b))  # the tokenizers' files, a few megabytes
    kind = pa.int64()
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string()), ("pairs", pa.list_(kind)), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*shared.value)
        for batch in slices(batches, most=SLICE):
            found = Batch(pair, strings(batch))
            pairs, times, ends = found.pairs()
            groups = found.groups()
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield record(schema, doc_id=batch.column("doc_id"), groups=groups, pairs=_list(ends, pairs, kind), times=_list(ends, times, pa.int32()), **{c: getattr(found, c) for c in COUNTS})

    out = docs.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups string, pairs array<long>, times array<int>")
    return stored(out.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(rows: DataFrame, factor: int) -> DataFrame:
    """(pair, n, best): in how many rows each pair stands, and whether no pair with the same A id stands in more; materialised."""
    counted = cut_lineage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.floor(F.col("pair") / factor).cast("int")))
    top = counted.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return counted.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _least_count(counted: DataFrame, most: int) -> int:
    """The least count from which on there are `most` pairs at most."""
    if counted.count() <= most:
        return 1
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))
    least = (sizes.filter(F.col("pairs") > most).agg(F.max("n")).first()[0] or 0) + 1
    held, lowest = 0, None
    for r in sizes.filter(F.col("n") >= least).orderBy(F.desc("n")).limit(most).collect():  # a row for each count
        held += r["pairs"]
        if held > most:
            break
        lowest = r["n"]
    return lowest or (counted.agg(F.max("n")).first()[0] + 1)


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, most_pairs: int = MOST_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, or (digest) groups_sha256, of every row.

    path_a, path_b: the tokenizers' files, which the driver reads. n_best: links whose pair's count is the greatest of its
    A id; count_sum: the counts of all links summed up.
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        content_a, model_b = f.read(), g.read()
    factor = Pair(content_a, model_b).factor
    rows = encoded(id_and_text(docs, id_col, text_col), content_a, model_b, digest)
    counted = cut_lineage(pair_counts(rows, factor))
    least = _least_count(counted, most_pairs)
    held = counted.filter(F.col("n") >= least).toArrow()
    order = np.argsort(held.column("pair").to_numpy(), kind="stable")
    arrays = [held.column(c).to_numpy()[order] for c in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast(arrays)  # MOST_PAIRS pairs at most
    columns = ["row", "doc_id", *COUNTS, "groups"]
    kinds = {"groups": pa.string()}
    schema = pa.schema([*((c, kinds.get(c, pa.int64())) for c in columns), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rare", pa.list_(pa.int64())), ("rare_times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, ends = batch.column("pairs").flatten().to_numpy(), np.cumsum(batch.column("pairs").value_lengths().to_numpy())
            times = batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            got = at[known]
            total, tops = np.zeros((2, len(flat)), np.int64)
            total[known], tops[known] = n[got] * times[known], best[got] * times[known]
            left = np.cumsum(_sums(~known, ends))
            yield record(schema, n_best=_sums(tops, ends), count_sum=_sums(total, ends), rare=_list(left, flat[~known], pa.int64()), rare_times=_list(left, times[~known], pa.int32()), **{c: batch.column(c) for c in columns})

    ddl = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in columns)
    out = rows.mapInArrow(run, f"{ddl}, n_best long, count_sum long, rare array<long>, rare_times array<int>")
    if least > 1:
        out = cut_lineage(out)
        links = out.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
        rare = links.join(counted.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_count"))
        out = out.join(rare, "row", "left")
        out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0))})
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256" if digest else "groups"))
