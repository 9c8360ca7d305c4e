"""Byte-pair encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus are compiled into a minimal acyclic automaton over bytes whose states share
suffixes; each arc tells how many words come before it, so a path adds up to the word's number, which points to its ids.
The automaton is one block of bytes in a file that Spark ships to each executor, whose workers all map it into memory. Words that it lacks
are merged exactly, by rank. Words are cut from texts as the library's byte-level pre-tokeniser does.

A null text counts as empty and has no ids. The text of the special token is that token, as in the library. Rows that repeat
an id, or have none, stay, each with the ids of its own text; words that are equally frequent at the lexicon's edge are all
left out. An empty table gives an empty result. Long texts are encoded whole. Other columns aren't looked at.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import Memo, cut_lineage, id_and_text, raw, record, slices, strings

#: Letters and numbers that the library knows and Python's tables lack: those that came with Unicode 16. Fixed values.
NEW_LETTERS = "Ᲊ-ᲊꟋ-ꟍꟚ-Ƛ\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
#: Ids take so many bits in a pair of them.
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 62
#: Words that are merged at a time.
ROWS = 4096
ONE = [bytes([b]) for b in range(256)]
SPACES = "\x09-\x0d\x20\x85\xa0  -     　"


def _category(first: str) -> str:
    """The code points of a Unicode category (L or N) as the inside of a character class."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Cutter:
    """Cuts texts into the words that merges stay within."""

    def __init__(self):
        letters, numbers = _category("L") + NEW_LETTERS, _category("N") + NEW_NUMBERS
        self.words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        self.space, self.meeting = re.compile(f"[{SPACES}]").match, re.compile(f"[{SPACES}](?![^{SPACES}])").search

    def chunks(self, text: str) -> list[str]:
        """Parts whose words are those of the text: cut before single spaces, or the whole text where spaces meet."""
        if not text:
            return []
        if self.space(text) or self.meeting(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *[f" {x}" for x in rest]]


def byte_signs() -> dict[str, int]:
    """The signs that stand for bytes in the vocabulary's strings: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What a tokenizer file says: the bytes of each id, the rank and the result of each merge, and special strings."""

    def __init__(self, content: str):
        spec = json.loads(content)
        signs, model = byte_signs(), spec["model"]
        of = lambda token: bytes(signs[c] for c in token)
        ids = model["vocab"]
        self.bytes = {i: of(t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.single = [ids[next(c for c, b in signs.items() if b == x)] for x in range(256)]
        # left << BITS | right -> rank << BITS | result
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << BITS | ids[b]] = rank << BITS | ids[a + b]
        self.single_array = np.array(self.single, np.int32)
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_values = np.array([self.merges[k] for k in self.pair_keys.tolist()], np.int64)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word: the pair of lowest rank is merged first, from the left, until none is left."""
        ids = [self.single[b] for b in word]
        return self._merge_long(ids) if len(ids) > 48 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> tuple[int, ...]:
        get = self.merges.get
        pairs = [get(a << BITS | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            new = ids[i] = best & MASK
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << BITS | new, NONE)
            if i < len(pairs):
                pairs[i] = get(new << BITS | ids[i + 1], NONE)
        return tuple(ids)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many words at once: rows of a matrix, of which each step merges the first pair of lowest rank."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list = [None] * len(words)
        for at in range(0, len(order), ROWS):
            part = order[at : at + ROWS]
            longest = len(words[part[-1]])
            if longest > 48 or longest < 2 or len(part) < 64:  # few words, or long ones, one by one
                for i in part:
                    out[i] = self.merge(words[i])
                continue
            for i, ids in zip(part, self._merge_rows([words[i] for i in part], longest), strict=True):
                out[i] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << BITS | result of each pair; NONE for pairs that don't merge and where an id is missing (-1)."""
        key = left.astype(np.int64) << BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_values[at], NONE)

    def _merge_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(words)
        sizes = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self.single_array[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        done = np.zeros((n, width), np.int32)
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            first = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), first]
            merging = best != NONE
            if not merging.all():
                done[rows[~merging]] = ids[~merging, :width]
                rows, ids, ranks, first, best = rows[merging], ids[merging], ranks[merging], first[merging], best[merging]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, first] = best & MASK
            ids[:, :width] = np.take_along_axis(ids, columns + (columns > first[:, None]), axis=1)
            ids[:, width] = -1
            ranks[:, : width - 1] = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= first[:, None]), axis=1)
            ranks[:, width - 1] = NONE
            ranks[at, first] = self._ranks(ids[at, first], ids[at, first + 1])
            before = np.maximum(first - 1, 0)
            ranks[at, before] = self._ranks(ids[at, before], ids[at, before + 1])
            sizes[rows] -= 1
        return [tuple(r[:k]) for r, k in zip(done.tolist(), sizes.tolist(), strict=True)]

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same in n log n steps: a heap of pairs by rank, then place; entries of pairs that are gone are skipped."""
        n, get = len(ids), self.merges.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i, p) for i, p in enumerate(a << BITS | b for a, b in zip(ids, ids[1:], strict=False)) if (m := get(p))]
        heapq.heapify(heap)
        while heap:
            m, i, p = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] << BITS | ids[j] != p:
                continue
            ids[i], alive[j], after[i] = m & MASK, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                p = ids[i] << BITS | ids[after[i]]
                if m := get(p):
                    heapq.heappush(heap, (m, i, p))
            if (k := before[i]) >= 0:
                p = ids[k] << BITS | ids[i]
                if m := get(p):
                    heapq.heappush(heap, (m, k, p))
        return tuple(x for x, ok in zip(ids, alive, strict=True) if ok)


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic automaton of the words, with their ids, as one block of bytes.

    Words are added in order; as soon as no later word can pass through a state, it is replaced by an equal one already
    kept, so that the automaton is minimal at any time. Layout: the numbers of states, arcs, words and ids, then 4-byte
    arrays (first arc of each state with its final flag in the lowest bit; target and words-before of each arc; first id
    of each word; ids; the key of each arc, state << 8 | label, which ascends), then the arcs' labels, a byte each.
    """
    kept: dict[tuple, int] = {}
    arcs_of: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        key = node[0], tuple(node[1])
        if key not in kept:
            kept[key] = len(arcs_of)
            arcs_of.append(key[1])
            final.append(node[0])
            count.append(node[0] + sum(count[t] for _, t in key[1]))
        return kept[key]

    ordered = sorted(words)
    path: list[list] = [[False, []]]  # of the last word: [is final, arcs that are done]
    last = b""
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0], last = True, word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    first, target, before, keys, labels = [], [], [], [], bytearray()
    for state, (arcs, is_final) in enumerate(zip(arcs_of, final, strict=True)):
        first.append(len(labels) << 1 | is_final)
        passed = int(is_final)
        for label, to in arcs:
            labels.append(label)
            keys.append(state << 8 | label)
            target.append(to)
            before.append(passed)
            passed += count[to]
    first.append(len(labels) << 1)
    starts, ids = [0], []
    for w in ordered:
        ids += words[w]
        starts.append(len(ids))
    head = struct.pack("<6I", len(arcs_of), len(labels), len(ordered), len(ids), root, 0)
    return head + b"".join(struct.pack(f"<{len(x)}I", *x) for x in (first, target, before, starts, ids, keys)) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped from its file, or from a temporary one that holds the given bytes. Every array is a view of the map."""

    def __init__(self, source: bytes | str):
        with open(source, "rb") if isinstance(source, str) else tempfile.TemporaryFile() as f:
            if not isinstance(source, str):
                f.write(source)
                f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, self.root, _ = struct.unpack_from("<6I", self.map)
        view, at, parts = memoryview(self.map), 24, []
        for n in (states + 1, arcs, arcs, words + 1, ids, arcs):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.before, self.starts, self.ids, self.keys = parts
        self.labels = at

    def __getitem__(self, word: bytes) -> tuple[int, ...] | None:
        state, number, find, first, base = self.root, 0, self.map.find, self.first, self.labels
        for b in word:
            arc = find(ONE[b], base + (first[state] >> 1), base + (first[state + 1] >> 1)) - base
            if arc < 0:
                return None
            number += self.before[arc]
            state = self.target[arc]
        if not first[state] & 1:
            return None
        return tuple(self.ids[self.starts[number] : self.starts[number + 1]])


    def find_all(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of many words at once: all words take their first step through the automaton together, then the second, and so on."""
        if len(words) < 64:
            return [self[w] for w in words]
        first, target, before, keys = (np.asarray(x) for x in (self.first, self.target, self.before, self.keys))
        if not len(keys):
            return [self[w] for w in words]
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        on = np.arange(len(words))
        step = 0
        while len(on := on[size[on] > step]):
            key = (state[on] << 8 | text[start[on] + step]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[arc] == key
            state[on[~found]] = -1
            on, arc = on[found], arc[found]
            number[on] += before[arc]
            state[on] = target[arc]
            step += 1
        known = (state >= 0) & (first[np.maximum(state, 0)] & 1 == 1)
        starts, ids = self.starts, self.ids
        return [tuple(ids[starts[n] : starts[n + 1]]) if k else None for n, k in zip(number.tolist(), known.tolist(), strict=True)]


IDS, WRITTEN, DECODED, LENGTH = map(itemgetter, range(4))


def readable(b: bytes) -> bytes:
    """UTF-8 of the decoded text; bytes that are no valid UTF-8 become replacement signs, as in the library."""
    return b if b.isascii() else b.decode("utf-8", "replace").encode()


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon, self.cutter = vocabulary, lexicon, Cutter()
        self.words: Memo = Memo(None, 150_000)
        self.parts: Memo = Memo(None, 300_000)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        top = max(vocabulary.bytes) + 1
        self.written = [str(i) for i in range(top)]
        self.decoded = [vocabulary.bytes.get(i, b"") for i in range(top)]
        self.special_parts = {s: self._part((i,)) for s, i in vocabulary.special.items()}

    def _part(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes, int]:
        """Ids, as written with commas, as decoded, and how many they are."""
        return ids, ",".join(map(self.written.__getitem__, ids)), b"".join(map(self.decoded.__getitem__, ids)), len(ids)

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of these chunks into the memo: their words come from the lexicon, or are merged, all at once."""
        cut = {c: self.cutter.words(c) for c in chunks}
        new = list(self.words.lacking({w for words in cut.values() for w in words}))
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        found = self.lexicon.find_all(coded) if self.lexicon else [None] * len(new)
        self.words.update((w, ids) for w, ids in zip(new, found, strict=True) if ids is not None)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        self.words.update(zip([new[k] for k in unseen], self.vocabulary.merge_all([coded[k] for k in unseen]), strict=True))
        known = self.words
        for c, words in cut.items():
            self.parts[c] = self._part(known[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(known.__getitem__, words))))
        self.words.trim()

    def parts_of(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str, bytes, int]]]:
        """What _part() gives for each chunk of each text."""
        pieces = [self.special.split(t) if self.special else [t] for t in texts]
        cut = [[self.cutter.chunks(x) for x in p[::2]] for p in pieces]
        self._learn(self.parts.lacking({c for p in cut for chunks in p for c in chunks}))
        out, get = [], self.parts.__getitem__
        for p, chunks in zip(pieces, cut, strict=True):
            found = list(map(get, chunks[0]))
            for k in range(1, len(chunks)):
                found.append(self.special_parts[p[2 * k - 1]])
                found.extend(map(get, chunks[k]))
            out.append(found)
        self.parts.trim()
        return out

    def batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [list(chain.from_iterable(map(IDS, parts))) for parts in self.parts_of(texts)]

    def ids(self, text: str) -> list[int]:
        return self.batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return readable(b"".join(map(self.decoded.__getitem__, ids)))


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder_of(content: str, lexicon: str) -> Encoder:
    """The encoder for a tokenizer and the lexicon in a file that was shipped; a worker keeps the last one, and what it has learnt, from task to task."""
    key = hashlib.sha256(content.encode()).digest(), lexicon
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(content), Lexicon(SparkFiles.get(lexicon)))
    return _ENCODERS[key]


_SHIPPED: set[tuple[str, str]] = set()


def shipped(sc: SparkContext, block: bytes) -> str:
    """The name under which executors find a file with this content; an application ships it once."""
    name = f"spindlestat-lexicon-{hashlib.sha256(block).hexdigest()[:32]}"
    if (sc.applicationId, name) not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix="spindlestat-"), name)
        with open(path, "wb") as f:
            f.write(block)
        sc.addFile(path)
        _SHIPPED.add((sc.applicationId, name))
    return name


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each run of non-space bytes stands in all texts. Tasks count first; few rows travel for a common word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = record(schema, word=list(seen), n=list(seen.values()))
            seen.clear()
            return out

        for batch in slices(batches):
            for text in raw(batch):
                seen.update(text.split())
            if len(seen) > 400_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, vocabulary: Vocabulary, most: int = 32_768) -> bytes:
    """Compiles the words of the `most` most frequent runs of non-space bytes (after a space, as they stand in texts).

    `most` is the bound on what the driver holds and on the lexicon; words beyond it are merged when they are met.
    """
    counted = cut_lineage(word_counts(docs).filter("n > 1"))
    # from the most frequent on, as many frequencies as hold `most` words at most: only those words reach the driver
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") <= most).orderBy(F.desc("n")).limit(most).collect()
    least, held = 2, 0
    for r in sizes:
        held += r["words"]
        if held > most:
            least = r["n"] + 1
            break
    top = counted.filter(F.col("n") >= least).limit(most).collect()
    cut = Cutter()
    words = {w.encode() for r in top for w in cut.words(" " + bytes(r["word"]).decode("utf-8", "replace"))}
    return compile_lexicon({w: vocabulary.merge(w) for w in words})


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(docs: DataFrame, path: str, most: int = 32_768, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and ids with the text decoded from them, or (digest) the SHA-256 of both.

    path: the tokenizer's file, which the driver reads; executors get its content as a broadcast and the lexicon as a file,
    whose sizes the vocabulary and `most` bound.
    """
    docs = id_and_text(docs, id_col, text_col)
    with open(path, encoding="utf-8") as f:
        content = f.read()
    sc = docs.sparkSession.sparkContext
    shared, lexicon = sc.broadcast(content), shipped(sc, frequent_lexicon(docs, Vocabulary(content), most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, lexicon)
        collecting = gc.isenabled()
        gc.disable()  # the memos make millions of tuples and no cycles; each full collection would walk them all
        try:
            yield from coded(encoder, batches)
        finally:
            if collecting:
                gc.enable()

    def coded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            n, first, second = [], [], []
            for parts in encoder.parts_of(strings(batch)):
                n.append(sum(map(LENGTH, parts)))
                text = readable(b"".join(map(DECODED, parts)))
                if digest:
                    first.append(hashlib.sha256(",".join(map(WRITTEN, parts)).encode()).hexdigest())
                    second.append(hashlib.sha256(text).hexdigest())
                else:
                    first.append(list(chain.from_iterable(map(IDS, parts))))
                    second.append(text)
            if digest:
                yield record(DIGEST, doc_id=batch.column(0), n_tokens=n, ids_sha256=first, decoded_sha256=second)
            else:
                yield record(OUT, doc_id=batch.column(0), n_tokens=n, ids=first, decoded=second)

    ddl = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return docs.mapInArrow(run, f"doc_id long, n_tokens long, {ddl}")
