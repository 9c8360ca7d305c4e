"""Language-model scoring with a weighted backoff automaton.

Tokens are words (runs of non-space bytes, A-Z lower-cased), then an end. Counts come from all training texts of the
corpus. With c the counts, N all training tokens and V the distinct ones, the probability of a token is

    P(w) = (c(w) + 1) / (N + V + 1)
    P(w | h) = (c(h w) + PRIOR * P(w | h')) / (c(h) + PRIOR)        h': h without its first word

so each order is a proper distribution. As an automaton: a state for each context that occurs in training, an arc for
each n-gram that does, weighted with its probability, to the state of the longest known context; and from each state a
failure arc to the state of the shorter context, weighted with PRIOR / (c(h) + PRIOR). Texts are scored in one traversal
from left to right, many at a time in step; where a state lacks an arc, its failure arc is taken.

The model isn't held by any one machine: it grows with the corpus. Texts are cut into words once, and written as blocks
into a table that is bucketed by block. A block asks for the n-grams that it contains, each once, in one message for each
shard of the model; a shard adds up the training counts that come with the requests, and answers each block in the order
of its request, with its own tokens and distinct tokens, which sum up to N and V. The block, which stays where it was
written, builds the part of the automaton that its texts can reach. So a word that fills a third of the corpus is one
number in each block's message, and shards get equally many n-grams whatever their frequency. An answer repeats a digest
of the keys it was asked for; a block that finds another digest, or another number of answers or counts, fails.

Sizes follow the corpus of T bytes. A block and a shard stand for 4 and 16 MB of text, and for ROOT * sqrt(T) where that
is more, so that there is no more than a message for each ROOT^2 bytes: work is linear in T, and memory of a task grows
with its root (200 MB of text at 100 TB). N-grams are known by hashes of as many bits as make a false match one in about
ten thousand unknown n-grams, whatever the size; words by 64 bits.

A null text is empty (one token, the end). Rows are scored one by one, so repeated rows and null ids are no special
case; without training texts N and V are 0.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo, checkpoint_folder, gone_at_end, raw, record, slices
from .shingles import mix

#: The order, and the prior of each order from 2 on.
ORDER, PRIORS = 3, (200.0, 100.0)
BLOCK_BYTES, SHARD_BYTES, ROOT = 4 << 20, 16 << 20, 20
#: Partitions of a shuffle at most.
MOST_PARTS = 20_000
U = np.uint64
END = b" "  # no word holds a space
BLOCKS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())])
MESSAGE = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class ModelError(RuntimeError):
    pass


_of_word = xxhash.xxh3_64_intdigest


def distinct(x: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and the place of each element among them."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    order = np.argsort(x, kind=kind)
    ascending = x[order]
    first = np.concatenate([[True], ascending[1:] != ascending[:-1]])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(first) - 1
    return ascending[first], number


class Block:
    """Some rows: ids, whether each is held out, and their tokens as numbers into `words`, the sorted hashes of the block's words."""

    def __init__(self, ids: pa.Array, held_out: np.ndarray, lengths: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.held_out, self.lengths, self.words, self.tokens = ids, held_out, lengths, words, tokens
        self.known: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def grams(self, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What _grams() gives, found once."""
        if (order, bits) not in self.known:
            self.known[order, bits] = list(self._grams(order, bits))
        return self.known[order, bits]

    def _grams(self, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order from 2: the keys (of so many bits) of the block's distinct n-grams in order, the n-gram that ends at each token (-1 where the text is too short), and the training count of each."""
        hashes, place = self.words[self.tokens], np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        trained = np.repeat(~self.held_out, self.lengths)
        key = hashes
        for n in range(2, order + 1):
            inside = np.flatnonzero(place >= n - 1)
            grown = np.zeros(len(key), U)
            grown[inside] = mix(key[inside - 1] * U(0x9E3779B97F4A7C15) + hashes[inside] + U(n))
            key = grown
            keys, number = distinct(key[inside] >> U(64 - bits))
            at = np.full(len(key), -1)
            at[inside] = number
            yield keys, at, np.bincount(number[trained[inside]], minlength=len(keys))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[np.repeat(~self.held_out, self.lengths)], minlength=len(self.words))


def stored_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, shard -1, ids, body): texts (doc_id, held_out, text) cut into words, in blocks numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_of_word)
        part, number, size, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            words, tokens = distinct(np.concatenate([h[3] for h in held]))
            return record(BLOCKS, block=[part << 32 | number], shard=[-1], **packed_block(Block(ids, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), words, tokens)))

        for batch in slices(batches, most=2 << 20):
            texts = raw(batch)
            split = [t.lower().split() for t in texts]
            for words in split:
                words.append(END)
            lengths = np.array([len(w) for w in split])
            hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), U, int(lengths.sum()))
            memo.trim()
            held.append((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths, hashes))
            size += sum(map(len, texts))
            if size >= block_bytes:
                yield close()
                number, size, held = number + 1, 0, []
        if held:
            yield close()

    return docs.mapInArrow(run, "block long, shard int, ids binary, body binary")


def packed(numbers: np.ndarray, plain: int = 3) -> bytes:
    """Numbers in the narrowest integers that hold them: their width and number, the lowest bytes of all, then the next ones. Up to `plain` planes of bytes of wider numbers stand as they are, the others are compressed."""
    width = next((w for w in (1, 2, 4, 8) if int(numbers.max()) < 1 << 8 * w), 8) if len(numbers) else 1
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    plain = min(plain, width - 1)
    return bytes([width, plain]) + len(numbers).to_bytes(4, "little") + planes[:plain].tobytes() + zlib.compress(np.ascontiguousarray(planes[plain:]), 1)


def unpacked(data: bytes) -> np.ndarray:
    width, plain, n = data[0], data[1], int.from_bytes(data[2:6], "little")
    at = 6 + n * plain
    planes = np.frombuffer(data[6:at] + zlib.decompress(data[at:]), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in planes of bytes like counts."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(U), dtype=U)


def join_parts(parts: Sequence[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def packed_block(b: Block) -> dict[str, list[bytes]]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", b.ids.type)])) as w:
        w.write_batch(pa.record_batch([b.ids], ["id"]))
    # common words have low numbers, so that the tokens take little room
    rank = np.argsort(np.argsort(-np.bincount(b.tokens, minlength=len(b.words)), kind="stable"))
    parts = [packed(b.held_out), packed(b.lengths), packed_keys(b.words), packed(rank, 0), packed(rank[b.tokens], 0)]
    return {"ids": [sink.getvalue().to_pybytes()], "body": [join_parts(parts)]}


def restored(ids: bytes, body: bytes) -> Block:
    held_out, lengths, words, rank, tokens = split_parts(body)
    rank = unpacked(rank)
    back = np.empty(len(rank), np.int32)
    back[rank] = np.arange(len(rank))
    return Block(pa.ipc.open_stream(ids).read_all().column(0).combine_chunks(), unpacked(held_out).astype(bool), unpacked(lengths), unpacked_keys(words), back[unpacked(tokens)])


def shard_bounds(keys: np.ndarray, n_shards: int, bits: int) -> np.ndarray:
    """Where each shard's keys begin among sorted keys: shards are equal ranges of hashes."""
    edges = np.array([(k << bits) // n_shards for k in range(1, n_shards)], U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def asked_of(block: Block, order: int, bits: int, n_shards: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """What a block asks for, keys and training counts of each order, and where each shard's part begins."""
    asked = [(block.words, block.word_counts()), *((k, c) for k, _, c in block.grams(order, bits))]
    return asked, [shard_bounds(k, n_shards, bits if n else 64) for n, (k, _) in enumerate(asked)]


def requests(blocks: DataFrame, order: int, bits: int, n_shards: int) -> DataFrame:
    """(block, shard, keys, counts): for each order the keys that a block asks a shard for, and their training counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, body in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "body")), strict=True):
                asked, bounds = asked_of(restored(ids, body), order, bits, n_shards)
                shards = list(range(n_shards))
                keys = [join_parts([packed_keys(k[b[s] : b[s + 1]]) for (k, _), b in zip(asked, bounds, strict=True)]) for s in shards]
                counts = [join_parts([packed(c[b[s] : b[s + 1]]) for (_, c), b in zip(asked, bounds, strict=True)]) for s in shards]
                yield record(MESSAGE, block=[number] * len(shards), shard=shards, keys=keys, counts=counts)

    return blocks.mapInArrow(run, "block long, shard int, keys binary, counts binary")


def by_shard(asked: DataFrame, n_shards: int) -> DataFrame:
    return asked.repartition(min(MOST_PARTS, 2 * n_shards), "shard").sortWithinPartitions("shard", "block")


def runs(batches: Iterator[pa.RecordBatch], key: str, values: Sequence[str]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each run of equal keys."""
    last, group = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(v).to_pylist() for v in values), strict=True):
            if group and k != last:
                yield last, group
                group = []
            last = k
            group.append(tuple(row))
    if group:
        yield last, group


def summed(asks: list[tuple[list[bytes], list[bytes]]], order: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of one order: how many keys each request has, the place of each among the distinct ones, and their summed counts."""
    keys = [unpacked_keys(k[order]) for k, _ in asks]
    values, number = distinct(np.concatenate(keys), "stable")  # ascending runs are merged
    counts = np.concatenate([unpacked(c[order]) for _, c in asks])
    return [len(k) for k in keys], number, np.bincount(number, weights=counts, minlength=len(values)).astype(np.int64)


def answers(asked: DataFrame, n_shards: int) -> DataFrame:
    """(block, shard, ids, body): a digest of each request's keys and the shard's tokens and distinct tokens, and the corpus counts in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(batches, "shard", ("block", "keys", "counts")):
            asks = [(split_parts(k), split_parts(c)) for _, k, c in group]
            replies, sums = [[] for _ in group], b""
            for order in range(len(asks[0][0])):
                sizes, number, total = summed(asks, order)
                sums = sums or np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
                found, at = total[number], 0
                for reply, n in zip(replies, sizes, strict=True):
                    reply.append(packed(found[at : at + n]))
                    at += n
            yield record(BLOCKS, block=[b for b, *_ in group], shard=[shard] * len(group), ids=[zlib.crc32(k).to_bytes(4, "little") + sums for _, k, _ in group], body=[join_parts(r) for r in replies])

    return by_shard(asked, n_shards).mapInArrow(run, "block long, shard int, ids binary, body binary")


class Automaton:
    """States are numbers from 0, the root; a state's level is the length of its context. Arcs have a weight and a target.

    Of a state's arcs only those matter that a text can take: the arc for the symbol at a place, from a state of a level,
    is the n-gram of that length and one more that ends there. arcs[level] tells its number for each place, -1 where the
    state lacks it; the root lacks none.
    """

    #: Texts are traversed in parts of so many tokens; a part starts some tokens earlier, in the state that these lead to.
    PART = 64

    def __init__(self, arcs: list[np.ndarray], weight: np.ndarray, target: np.ndarray, level: np.ndarray, fail: np.ndarray, fail_weight: np.ndarray):
        self.arcs, self.weight, self.target, self.level, self.fail, self.fail_weight = np.concatenate(arcs), weight, target, level, fail, fail_weight
        self.order = len(arcs)

    def traverse(self, lengths: np.ndarray) -> np.ndarray:
        """The summed weights of the path that each text takes from the root, from left to right; parts of texts go in step. A state depends on the last order - 1 symbols, so as many lead up to a part."""
        n_places = int(lengths.sum())
        n_parts = -(-lengths // self.PART)
        text = np.repeat(np.arange(len(lengths)), n_parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        start = (np.cumsum(lengths) - lengths)[text]
        own = start + number * self.PART
        stop = np.minimum(own + self.PART, start + lengths[text])
        begin = np.maximum(own - (self.order - 1), start)
        longest_first = np.argsort(begin - stop, kind="stable")
        begin, own, stop, text = (x[longest_first] for x in (begin, own, stop, text))
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        sizes = stop - begin
        for step in range(int(sizes.max(initial=0))):
            on = int(np.searchsorted(-sizes, -step))  # the parts that are longer
            place, now = begin[:on] + step, state[:on]
            arc, weight = self.arcs[self.level[now] * n_places + place], np.zeros(on)
            stuck = np.flatnonzero(arc < 0)
            while len(stuck):
                at = now[stuck]
                weight[stuck] += self.fail_weight[at]
                now[stuck] = at = self.fail[at]
                arc[stuck] = found = self.arcs[self.level[at] * n_places + place[stuck]]
                stuck = stuck[found < 0]
            total[:on] += np.where(place >= own[:on], weight + self.weight[arc], 0.0)
            state[:on] = self.target[arc]
        return np.bincount(text, weights=total, minlength=len(lengths))


def build(block: Block, counts: list[np.ndarray], n_tokens: int, n_distinct: int, order: int, priors: Sequence[float], bits: int) -> Automaton:
    """The part of the automaton that the block's texts can reach. counts: for each order, the corpus counts of the block's n-grams."""
    words = len(block.words)
    probability = (counts[0] + 1) / (n_tokens + n_distinct + 1)
    end = np.searchsorted(block.words, U(_of_word(END)))
    # states of one word: those that were seen in training, but the end, which no token follows
    is_state = (counts[0] > 0) & (order > 1)
    is_state[end] = False
    state = np.where(is_state, np.cumsum(is_state), 0)
    arcs, weight, target = [block.tokens.astype(np.int64)], [np.log10(probability)], [state]
    seen = counts[0][is_state]
    fail, fail_weight, level = [np.zeros(len(seen) + 1, np.int64)], [np.array([0.0])], [np.array([0]), np.ones(len(seen), np.int64)]
    if order > 1:
        fail_weight.append(np.log10(priors[0] / (seen + priors[0])))
    n_states, n_arcs = len(seen) + 1, words
    # of the n-gram that ends at a token, one order lower: its state (by n-gram), the n-gram at each token, its probability
    number, chance, context_count = block.tokens, probability, counts[0]
    for n, (_, at, _) in enumerate(block.grams(order, bits), 2):
        total, prior = counts[n - 1], priors[n - 2]
        inside = np.flatnonzero(at >= 0)
        first = np.zeros(len(total), np.int64)
        first[at[inside]] = inside  # a token at which each n-gram ends
        context, lower = number[first - 1], number[first]
        p = (total + prior * chance[lower]) / (context_count[context] + prior)
        known = total > 0
        is_state = known & (block.tokens[first] != end) if n < order else np.zeros(len(total), bool)
        new_state = np.where(is_state, n_states - 1 + np.cumsum(is_state), state[lower])
        arc = np.full(len(at), -1, np.int64)
        arc[inside] = np.where(known, n_arcs - 1 + np.cumsum(known), -1)[at[inside]]
        arcs.append(arc)
        weight.append(np.log10(p[known]))
        target.append(new_state[known])
        fail.append(state[lower][is_state])
        if n < order:
            fail_weight.append(np.log10(priors[n - 1] / (total[is_state] + priors[n - 1])))
            level.append(np.full(int(is_state.sum()), n))
        n_states, n_arcs = n_states + int(is_state.sum()), n_arcs + int(known.sum())
        state, number, chance, context_count = new_state, at, p, total
    return Automaton(arcs, *(np.concatenate(x) for x in (weight, target, level, fail, fail_weight)))


def scored(block: Block, counts: list[np.ndarray], n_tokens: int, n_distinct: int, order: int, priors: Sequence[float], bits: int) -> pa.RecordBatch:
    automaton = build(block, counts, n_tokens, n_distinct, order, priors, bits)
    base = np.log10((counts[0] + 1) / (n_tokens + n_distinct + 1))
    add = lambda x: np.add.reduceat(x[block.tokens], np.cumsum(block.lengths) - block.lengths)  # noqa: E731  every row has a token
    return record(SCORES, doc_id=block.ids.cast(pa.int64()), held_out=block.held_out, n_tokens=block.lengths, n_known=add((counts[0] > 0).astype(np.int64)), train_tokens=np.full(len(block.lengths), n_tokens), base_score=add(base), score=automaton.traverse(block.lengths))


def told(block: Block, parts: list[tuple[int, bytes, bytes]], order: int, bits: int, n_shards: int) -> tuple[int, int, list[np.ndarray]]:
    """N, V and the counts of a block's n-grams from the answers to it (shard, digest and sums, body), by shard; raises if they aren't what it asked for."""
    asked, bounds = asked_of(block, order, bits, n_shards)
    if [shard for shard, *_ in parts] != list(range(n_shards)):
        raise ModelError(f"{len(parts)} answers from {n_shards} shards")
    counts = [[] for _ in range(order)]
    sums = np.zeros(2, np.int64)
    for shard, head, body in parts:
        keys = join_parts([packed_keys(k[b[shard] : b[shard + 1]]) for (k, _), b in zip(asked, bounds, strict=True)])
        if zlib.crc32(keys).to_bytes(4, "little") != head[:4]:
            raise ModelError(f"shard {shard} answered another request")
        sums += np.frombuffer(head, np.int64, offset=4)
        for k, part in enumerate(split_parts(body)):
            counts[k].append(unpacked(part))
    out = [np.concatenate(c) for c in counts]
    if any(len(c) != len(k) for c, (k, _) in zip(out, asked, strict=True)):
        raise ModelError(f"{[len(c) for c in out]} counts for {[len(k) for k, _ in asked]} n-grams")
    return int(sums[0]), int(sums[1]), out


def written(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """The blocks as a table in the folder of checkpoints, bucketed by block: a join by block finds them in place. A task writes a file for each of its blocks.

    The result of score() is lazy and reads the table, so it stays until the application ends; then the table is dropped and its files are deleted.
    """
    spark = blocks.sparkSession
    name = f"spindlestat_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark)}/{name}"
    blocks.write.bucketBy(n_buckets, "block").option("path", path).saveAsTable(name)
    gone_at_end(spark, path, name)
    return spark.table(name)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float | Sequence[float] = PRIORS, n_shards: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows where held_out holds don't train.

    prior: of all orders, or of each from 2 on. n_shards, block_bytes: by the size of the corpus, unless given.
    """
    priors = [float(prior)] * (order - 1) if isinstance(prior, (int, float)) else [float(p) for p in prior][: order - 1]
    if len(priors) < order - 1:
        raise ValueError(f"{order - 1} priors are needed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    root = int(ROOT * size**0.5)
    n_shards = n_shards or -(-size // max(SHARD_BYTES, root))
    block_bytes = block_bytes or max(BLOCK_BYTES, root)
    bits = min(64, max(40, size.bit_length() + 12))
    blocks = written(stored_blocks(rows, block_bytes), max(1, min(MOST_PARTS, 2 * size // block_bytes)))

    def of_block(mine: pa.Table, told_: pa.Table) -> pa.Table:
        block = restored(mine.column("ids")[0].as_py(), mine.column("body")[0].as_py())
        parts = sorted(zip(*(told_.column(c).to_pylist() for c in ("shard", "ids", "body")), strict=True))
        n_tokens, n_distinct, counts = told(block, parts, order, bits, n_shards)
        return pa.Table.from_batches([scored(block, counts, n_tokens, n_distinct, order, priors, bits)])

    told_ = answers(requests(blocks, order, bits, n_shards), n_shards)
    both = blocks.groupBy("block").cogroup(told_.groupBy("block"))
    return both.applyInArrow(of_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
