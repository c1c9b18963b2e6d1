"""Masked pseudo-likelihood of texts with a bidirectional window network.

Every token is predicted from the tokens around it, two on each side: their embeddings, weighted by
place, go through a tanh layer to a binary tree over the words (hierarchical softmax).  The eight upper
levels of the tree are logistic decisions of the network, each with a vector of its own; below a node of the last one a word has its
share of the node's count, which no context changes.  The sum of the conditional log-probabilities scores a text.

What it takes from the corpus grows with it: counts of all words of all documents, hashed into the more buckets the
more text there is (``sizes``), and gradients from the windows of every token of every
document, each a target once: round k of n takes each n-th token from the k-th on.  Training is data-parallel: in each round
every task trains one copy of the network on its documents with plain numpy, and the copies are averaged, weighted by
the windows they saw, in a tree of groups of ``GROUP`` copies.  Texts never leave their tasks.

Copies are trained in the order of a task's rows, so scores depend a little on how the input is partitioned (the
second decimal of a mean log-likelihood); equal partitions give equal scores.

Defined results: a null or empty text has no tokens and score 0; repeated rows score alike; an empty
corpus gives an empty table; a kept column that is named like an output is returned as ``kept_<name>``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, add_columns, by_bytes, kept_names
from roadflow.llm.hashing import LOWER, hashed_words
from roadflow.session import ship

#: Buckets of words as inputs, their width, and the words seen on either side.
INPUTS = 1 << 14
WIDTH = 16
REACH = 2
ROUNDS = 3
RATE = 0.1
#: Examples in a step, and so many at most count for one vector.
STEP, LIMIT = 8192, 16
#: Upper levels of the tree that are worked out for all their nodes at once, as products of matrices.
TOP = 4
BATCH_BYTES = 1 << 20
#: Copies averaged in one task, and values in a block of them.
GROUP = 64
BLOCK = 1 << 13


def sizes(n_bytes: int) -> tuple[int, int]:
    """(buckets that are counted, leaves of the trained tree) for so much text: a bucket for each KB, 256 leaves."""
    bits = min(20, max(14, math.ceil(math.log2(max(1, n_bytes) / 1024))))
    return 1 << bits, 1 << 8


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(20 bits of the hash of each word, words in each text)."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    hashed, start = hashed_words(data)
    cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return (hashed >> np.uint64(44)).astype(np.int32), np.diff(np.r_[0, cut])


def _parts(batch: pa.RecordBatch, name: str):
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).fill_null(b"")
    for a, b in by_bytes(column, BATCH_BYTES):
        yield _words(column.slice(a, b - a).to_pylist())


def contexts(word: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inputs around the words at some places, -REACH to REACH without the word itself; INPUTS stands for beyond the text."""
    ends = np.cumsum(count)
    text = np.searchsorted(ends, at, side="right")
    first, end = (ends - count)[text], ends[text]
    out = np.empty((len(at), 2 * REACH), np.int64)
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        near = at + step
        inside = (near >= first) & (near < end)
        out[:, k] = np.where(inside, word[np.clip(near, 0, max(len(word) - 1, 0))] >> 6, INPUTS)
    return out


def tree_of(counts: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each bucket, log of its share there): buckets by falling count are dealt into leaves of about equal mass.

    Every bucket counts one more than seen, so words that the corpus doesn't have keep a probability.
    """
    mass = counts.astype(float) + 1
    order = np.argsort(-mass, kind="stable")
    run = np.cumsum(mass[order]) - mass[order]
    leaf = np.empty(len(mass), np.int32)
    leaf[order] = np.minimum(run / mass.sum() * leaves, leaves - 1).astype(np.int32)
    return leaf, np.log(mass / np.bincount(leaf, mass, leaves)[leaf]).astype(np.float32)


class Network:
    """embed (inputs + 1, width), place (2 * reach, width), out and bias (leaves, width and none): node k of the tree has the children 2k and 2k + 1."""

    def __init__(self, leaf: np.ndarray, share: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.leaf, self.share, self.leaves, self.depth = leaf, share, leaves, int(math.log2(leaves))
        self.embed = rng.normal(0, 0.3, (INPUTS + 1, WIDTH)).astype(np.float32)
        self.place = np.full((2 * REACH, WIDTH), 0.5, np.float32)
        self.out, self.bias = np.zeros((leaves, WIDTH), np.float32), np.zeros(leaves, np.float32)
        self.shift = 20 - int(math.log2(len(leaf)))

    def hidden(self, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(embeddings seen at each place, hidden layer)."""
        seen = [self.embed[context[:, k]] for k in range(2 * REACH)]
        total = seen[0] * self.place[0]
        for k in range(1, 2 * REACH):
            total += seen[k] * self.place[k]
        return seen, np.tanh(total)

    def upper(self, h: np.ndarray) -> tuple[int, np.ndarray]:
        """(number of upper levels, probability that the tree goes to the right, to the odd child, at each of their nodes)."""
        levels = min(TOP, self.depth)
        x = h @ self.out[: 1 << levels].T + self.bias[: 1 << levels]
        return levels, 1 / (1 + np.exp(-np.clip(x, -20, 20)))

    def right(self, h: np.ndarray, node: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The same at one node for each row."""
        x = np.einsum("nk,nk->n", h, weight) + self.bias[node]
        return 1 / (1 + np.exp(-np.clip(x, -20, 20)))

    def log_probability(self, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each word, given its neighbours."""
        out = np.empty(len(word))
        for a in range(0, len(word), STEP):
            at = np.arange(a, min(a + STEP, len(word)))
            h = self.hidden(contexts(word, count, at))[1]
            bucket = word[at] >> self.shift
            node = self.leaves + self.leaf[bucket]
            levels, all_right = self.upper(h)
            row, p = np.arange(len(at)), np.ones(len(at))
            for k in range(self.depth, 0, -1):
                up = node >> k
                right = all_right[row, up] if self.depth - k < levels else self.right(h, up, self.out[up])
                p *= np.where((node >> (k - 1)) & 1, right, 1 - right)
            out[at] = np.log(p) + self.share[bucket]
        return out

    def slopes(self, context: np.ndarray, word: np.ndarray) -> tuple[list[tuple], tuple, np.ndarray]:
        """Sums of the slopes of the log-probabilities: (nodes, out, bias, examples) of the upper levels and of each lower one; (embed, examples); places."""
        node = self.leaves + self.leaf[word >> self.shift]
        by = np.argsort(node.astype(np.int16), kind="stable")
        node, context = node[by], context[by]
        seen, h = self.hidden(context)
        levels, all_right = self.upper(h)
        miss, row = np.zeros((len(node), 1 << levels), h.dtype), np.arange(len(node))
        many = np.zeros(1 << levels, np.int64)
        for k in range(self.depth, self.depth - levels, -1):
            up = node >> k
            miss[row, up] = ((node >> (k - 1)) & 1).astype(h.dtype) - all_right[row, up]
            many += np.bincount(up, minlength=1 << levels)
        back = miss @ self.out[: 1 << levels]
        some = np.flatnonzero(many)
        nodes = [(some, (miss.T @ h)[some], miss.sum(axis=0)[some], many[some])]
        for k in range(self.depth - levels, 0, -1):
            up = node >> k
            weight = self.out[up]
            miss = (((node >> (k - 1)) & 1).astype(h.dtype) - self.right(h, up, weight))[:, None]
            back += miss * weight
            head = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            nodes.append((up[head], np.add.reduceat(miss * h, head, axis=0), np.add.reduceat(miss[:, 0], head), np.diff(np.r_[head, len(up)])))
        back *= 1 - h * h
        total = np.empty((WIDTH, INPUTS + 1))
        cell = context.T.ravel()
        for d in range(WIDTH):
            total[d] = np.bincount(cell, (back[:, d] * self.place[:, d : d + 1]).ravel(), INPUTS + 1)
        return nodes, (total.T, np.bincount(cell, minlength=INPUTS + 1)), np.array([np.einsum("nk,nk->k", s, back) for s in seen])

    def step(self, context: np.ndarray, word: np.ndarray, rate: float = RATE) -> None:
        """One step up: each vector moves by its mean slope, times the examples it has, ``LIMIT`` at most."""
        nodes, (total, n), place = self.slopes(context, word)
        self.embed += total * (rate * np.minimum(1, LIMIT / np.maximum(n, 1)))[:, None]
        for at, total, bias, n in nodes:
            weight = (rate * np.minimum(1, LIMIT / n)).astype(np.float32)
            self.out[at] += total * weight[:, None]
            self.bias[at] += bias * weight
        self.place += (rate / len(context)) * place

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.place.ravel(), self.out.ravel(), self.bias])

    def load(self, flat: np.ndarray) -> None:
        ends = np.cumsum([self.embed.size, self.place.size, self.out.size])
        self.embed, self.place, self.out, self.bias = (x.reshape(own.shape).copy() for x, own in zip(np.split(flat, ends), (self.embed, self.place, self.out, self.bias)))


# --- one row of blocks for each task, added up in a tree -----------------------------------------------------

BLOCKS = "block long, seen long, values binary"


def _blocks(values: np.ndarray, seen: int) -> pa.RecordBatch:
    parts = [values[a : a + BLOCK].tobytes() for a in range(0, len(values), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "seen", "values"])


def _added(kind: str, mean: bool) -> Callable[[pa.Table], pa.Table]:
    def add(rows: pa.Table) -> pa.Table:
        total, seen = 0, 0
        for n, raw in zip(rows["seen"].to_pylist(), rows["values"].to_pylist()):
            total, seen = total + np.frombuffer(raw, kind).astype(float) * (n if mean else 1), seen + n
        values = (total / max(1, seen) if mean else total).astype(kind)
        return pa.table({"block": rows["block"][:1], "part": rows["part"][:1], "seen": pa.array([seen], pa.int64()), "values": pa.array([values.tobytes()], pa.binary())})

    return add


def gathered(texts: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str, mean: bool, scratch: Scratch) -> np.ndarray | None:
    """Sum, or mean weighted by ``seen``, of the arrays that the tasks yield; at most ``GROUP`` of them meet in a task."""
    ship(texts.sparkSession)
    rows = texts.mapInArrow(run, BLOCKS).withColumn("part", F.spark_partition_id().cast("long"))
    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / GROUP)).groupBy("block", "part").applyInArrow(_added(kind, mean), "block long, part long, seen long, values binary")
        rows = scratch.save(rows)
        if not rows.agg(F.max("part")).first()[0]:
            break
    found = [np.frombuffer(r["values"], kind) for r in rows.orderBy("block").collect()]
    scratch.drop(rows)
    return np.concatenate(found) if found else None


def _counter(text: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, shift = np.zeros(buckets, np.int64), 0, 20 - int(math.log2(buckets))
        for batch in batches:
            for word, _ in _parts(batch, text) if batch.num_rows else ():
                total += np.bincount(word >> shift, minlength=buckets)
                seen += len(word)
        if seen:
            yield _blocks(total.astype("<i8"), seen)

    return run


def _trainer(text: str, network: Network, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Network(network.leaf, network.share, network.leaves), 0
        own.load(network.parameters())
        for batch in batches:
            for word, count in _parts(batch, text) if batch.num_rows else ():
                for a in range(turn, len(word), STEP * rounds):
                    at = np.arange(a, min(a + STEP * rounds, len(word)), rounds)
                    own.step(contexts(word, count, at), word[at])
                    seen += len(at)
        if seen:
            yield _blocks(own.parameters().astype("<f4"), seen)

    return run


def fit(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """Counts over all texts, then rounds of training in every task and averaging."""
    texts, scratch = df.select(F.col(text_col).cast("string").alias("text")), Scratch(df.sparkSession, "lm")
    buckets, leaves = sizes(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counts = gathered(texts, _counter("text", buckets), "<i8", False, scratch)
    network = Network(*tree_of(np.zeros(buckets) if counts is None else counts, leaves), leaves)
    for turn in range(rounds if counts is not None else 0):
        mean = gathered(texts, _trainer("text", network, turn, rounds), "<f4", True, scratch)
        if mean is not None:
            network.load(mean)
    return network


def _score(batch: pa.RecordBatch, text: str, network: Network) -> list[pa.Array]:
    words, total = [], []
    for word, count in _parts(batch, text):
        run = np.r_[0, np.cumsum(network.log_probability(word, count))]
        end = np.cumsum(count)
        words.append(count)
        total.append(run[end] - run[end - count])
    n, s = np.concatenate(words), np.concatenate(total)
    return [pa.array(n, pa.int64()), pa.array(np.round(s, 4)), pa.array(np.round(s / np.maximum(n, 1), 6))]


def score(df: DataFrame, network: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, log_likelihood (sum) and mean_log_likelihood."""
    fields = "n_words long, log_likelihood double, mean_log_likelihood double"
    mine = [f"_{i}" for i in range(len(keep))]
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], F.col(text_col).cast("string").alias("_text"))
    found = add_columns(plain, _score, fields, mine, "_text", network)
    return found.withColumnsRenamed(dict(zip(mine, kept_names(keep, fields))))
