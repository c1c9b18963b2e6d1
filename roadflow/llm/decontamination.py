"""Benchmark decontamination with a stored, distributed positional inverted index.

1. *Index.*  The training texts are cut into parts of at most ``SEGMENT_BYTES``; each part becomes
   one segment, a row of the index: its terms (64-bit hashes of words, ascending), where the postings of each begin, and the
   postings, that is, the ascending positions of a term in the segment.  Segments are written once, as Parquet in the
   shared folder; they are small, so a frequent term is spread over all of them.
2. *Rarest terms.*  The terms and list lengths of all segments, and nothing else, are read to count the test terms over the whole corpus.
3. *Search.*  Test phrases are windows of consecutive item words.  In each segment a phrase starts from the list of its rarest
   term and is intersected with the lists of its other terms, the rarest first: an occurrence is *near* if
   every term's list has a position within ``reach`` words of it in its document, and *exact* if the lists, less each term's
   offset in the phrase, have the same position in common.

The test side is sent to the tasks as arrays, in blocks of at most ``BLOCK_BYTES`` of text (an item is not cut); more text
means more passes over the index, never a larger table in a task.

Defined results: a null or empty text has no words and no hits; null or empty
items have no phrases; items that repeat count once for each item_id; an item without an id hits words but is
named nowhere; equal texts have equal results; an
empty corpus gives an empty table, an empty benchmark no hits; a kept column that is named like an output is returned as
``kept_<name>``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, by_bytes, kept_names, map_batches, settings
from roadflow.llm.hashing import LOWER, hashed_words

WORDS = 13
#: Words around the rarest term in which a near match has all others.
REACH = 20
#: Benchmark text that one pass looks for.
BLOCK_BYTES = 4 << 20
#: Document text in one segment of the index.
SEGMENT_BYTES = 1 << 18
#: Occurrences that are followed at once.
OCCURRENCES = 1 << 19
#: Bytes that pass between Spark and Python at once; and the index, in pages and row groups that suit its few and long rows. Buffers of many MB
#: for each of its rows would fill an executor's heap with garbage.
PASSED = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
WRITTEN = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4, "parquet.enable.dictionary": "false"}
READ = {"spark.sql.parquet.columnarReaderBatchSize": 16}

_U = np.uint64
#: Bytes between words: ASCII but digits and letters (texts are lower-cased first).
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[ord("0") : ord("9") + 1] = False
_GAP[ord("a") : ord("z") + 1] = False


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, where the words of each text end)."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    hashed, start = hashed_words(data, _GAP)
    return hashed, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def starts_of(terms: bytes, starts: bytes) -> np.ndarray:
    """The starts of a packed segment: one for each term, and the end."""
    return np.frombuffer(starts, f"<u{len(starts) // (len(terms) // 8 + 1)}").astype(np.int64)


@dataclass
class Segment:
    """terms ascending; the postings of term i are ``positions[starts[i] : starts[i + 1]]``; ends: where each document ends."""

    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Segment:
        term, ends = words_of(texts)
        by = np.argsort(term, kind="stable")
        term = term[by]
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        return cls(term[head], np.r_[head, len(term)], by, ends)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Lists as bytes; positions as differences, which compress. Starts and positions take two bytes each where the segment has few words."""
        unit = "<u2" if len(self.positions) < 1 << 16 else "<u4"
        steps = np.diff(self.positions.astype(unit), prepend=np.zeros(1, unit))
        return self.terms.astype("<u8").tobytes(), self.starts.astype(unit).tobytes(), steps.astype(unit).tobytes(), self.ends.astype("<u4").tobytes()

    @classmethod
    def unpacked(cls, terms: bytes, starts: bytes, positions: bytes, ends: bytes) -> Segment:
        starts = starts_of(terms, starts)
        unit = f"<u{len(positions) // starts[-1]}" if starts[-1] else "<u2"
        place = np.cumsum(np.frombuffer(positions, unit), dtype=unit)
        return cls(np.frombuffer(terms, "<u8"), starts, place.astype(np.int64), np.frombuffer(ends, "<u4").astype(np.int64))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Number of each wanted term, -1 where the segment doesn't have it."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        i = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[i] == wanted, i, -1)


class Phrases:
    """The windows of some items as arrays: the number of each term (filled up with -1), the order from the rarest on."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WORDS):
        items = sorted({(i or "", i is not None, t) for i, t in items if t})
        term, ends = words_of([t.encode() for _, _, t in items]) if items else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.terms = np.unique(term)
        number = np.searchsorted(self.terms, term).astype(np.int32)
        begin = np.r_[0, ends[:-1]] if len(items) else ends
        length = ends - begin
        windows = np.where(length > 0, np.maximum(1, length - size + 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        first = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows - begin, windows)
        at = first[:, None] + np.arange(size)
        rows = np.where(at < ends[item][:, None], number[np.minimum(at, max(len(number) - 1, 0))], -1) if len(item) else np.zeros((0, size), np.int32)
        self.rows, which = np.unique(rows.astype(np.int32), axis=0, return_inverse=True) if len(item) else (rows, item)
        self.size = (self.rows >= 0).sum(axis=1)
        named = np.array([known for _, known, _ in items], bool)[item] if len(item) else np.zeros(0, bool)
        pair = np.unique(np.c_[which.ravel()[named], item[named]], axis=0)
        self.item, self.of = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.rows) + 1))
        self.names = [name for name, _, _ in items]
        self.rank_by(np.zeros(len(self.terms), np.int64))

    def rank_by(self, counts: np.ndarray) -> None:
        """Order the words of each window from the rarest on; missing words come last."""
        many = np.where(self.rows >= 0, counts[np.maximum(self.rows, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(many, axis=1, kind="stable").astype(np.int8)

    def named(self, window: np.ndarray) -> list[str]:
        """The items of some windows, sorted as texts."""
        found = np.concatenate([self.item[self.of[w] : self.of[w + 1]] for w in window]) if len(window) else window
        return sorted({self.names[i] for i in found})


def occurrences(segment: Segment, phrases: Phrases, reach: int = REACH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place of its rarest term, place of the whole phrase or -1) of the near matches, some at a time."""
    number = segment.find(phrases.terms)
    if not len(phrases.rows) or (number < 0).all():
        return
    there = np.r_[number >= 0, True]  # the last stands for no word
    alive = np.flatnonzero(there[phrases.rows].all(axis=1))
    counts = np.diff(segment.starts)
    key = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) | segment.positions
    rare = number[phrases.rows[alive, phrases.order[alive, 0]]]
    run = np.cumsum(counts[rare])
    reach = max(reach, phrases.rows.shape[1] - 1)
    at = 0
    while at < len(alive):
        upto = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + OCCURRENCES, side="right")))
        n = counts[rare[at:upto]]
        window = np.repeat(alive[at:upto], n)
        place = segment.positions[np.arange(int(n.sum())) + np.repeat(segment.starts[rare[at:upto]] - (np.cumsum(n) - n), n)]
        at = upto
        document = np.searchsorted(segment.ends, place, side="right")
        low = np.maximum(place - reach, np.r_[0, segment.ends][document])
        high = np.minimum(place + reach, segment.ends[document] - 1)
        start = place - phrases.order[window, 0]
        exact = (start >= np.r_[0, segment.ends][document]) & (start + phrases.size[window] <= segment.ends[document])
        for r in range(1, phrases.rows.shape[1]):
            if not len(window):
                break
            more = r < phrases.size[window]
            offset = phrases.order[window, r]
            term = number[np.maximum(phrases.rows[window, offset], 0)].astype(np.int64) << 32
            i = np.minimum(np.searchsorted(key, term | low), len(key) - 1)
            near = ~more | ((key[i] >= term | low) & (key[i] <= term | high))
            wanted = term | np.where(exact, start + offset, 0)
            i = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            exact &= ~more | (key[i] == wanted)
            window, place, low, high, start, exact = (x[near] for x in (window, place, low, high, start, exact))
        if len(window):
            yield window, place, np.where(exact, start, -1)


def search(segment: Segment, phrases: Phrases, reach: int = REACH) -> list[tuple[list[str], list[str], list[dict]]]:
    """(items, near items, spans of hit words) of each document of a segment."""
    n = len(segment.ends)
    out: list[tuple] = [([], [], [])] * n
    total = int(segment.ends[-1]) if n else 0
    edge, seen = np.zeros(total + 1, np.int32), []
    for window, place, start in occurrences(segment, phrases, reach):
        hit = start >= 0
        np.add.at(edge, start[hit], 1)
        np.add.at(edge, start[hit] + phrases.size[window[hit]], -1)
        seen.append(np.unique(np.c_[np.searchsorted(segment.ends, place, side="right"), window, hit], axis=0))
    if not seen:
        return out
    seen = np.unique(np.concatenate(seen), axis=0)
    mark = np.cumsum(edge[:-1]) > 0
    first = np.r_[0, segment.ends]
    for d in np.unique(seen[:, 0]).tolist():
        own = seen[seen[:, 0] == d]
        cut = np.flatnonzero(np.diff(np.r_[False, mark[first[d] : first[d + 1]], False].astype(np.int8))).tolist()
        out[d] = (phrases.named(own[own[:, 2] == 1, 1]), phrases.named(np.unique(own[:, 1])), [{"from": a, "to": b} for a, b in zip(cut[::2], cut[1::2])])
    return out


INDEX = "terms binary, starts binary, positions binary, ends binary, one array<long>, two array<long>"
FOUND = "one long, two long, n_words long, items array<string>, near_items array<string>, spans array<struct<from: long, to: long>>"


def _segments(batch: pa.RecordBatch):
    column = batch.column(2)
    for a, b in by_bytes(column, SEGMENT_BYTES):
        packed = Segment.of([x or b"" for x in column.slice(a, b - a).cast(pa.binary()).to_pylist()]).packed()
        keys = [pa.array([batch.column(k).slice(a, b - a).to_pylist()], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed] + keys, ["terms", "starts", "positions", "ends", "one", "two"])


def build_index(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The written index of (one, two, text), one row for each segment; one and two are the text's key."""
    with settings(scratch.spark, PASSED | WRITTEN):
        return scratch.save(map_batches(texts.select("one", "two", "text"), _segments, INDEX))


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    for i, row in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("terms", "starts", "positions", "ends")))):
        yield i, Segment.unpacked(*(x.as_py() for x in row))


def _count_terms(batch: pa.RecordBatch, terms: np.ndarray):
    total = np.zeros(len(terms), np.int64)
    for own, starts in zip(batch.column(0), batch.column(1)):
        segment = Segment(np.frombuffer(own.as_py(), "<u8"), starts_of(own.as_py(), starts.as_py()), terms[:0], terms[:0])
        i = segment.find(terms)
        total += np.where(i >= 0, np.r_[np.diff(segment.starts), 0][i], 0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


def _look(batch: pa.RecordBatch, phrases: Phrases, reach: int):
    names = ["one", "two", "n_words", "items", "near_items", "spans"]
    for i, segment in _unpack(batch):
        items, near, spans = zip(*search(segment, phrases, reach)) if len(segment.ends) else ((), (), ())
        text = pa.list_(pa.string())
        arrays = [batch.column(batch.schema.get_field_index(c))[i].values for c in ("one", "two")]
        arrays += [pa.array(np.diff(segment.ends, prepend=0)), pa.array(items, text), pa.array(near, text), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def find_contamination(df: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The columns ``keep`` of each document, with n_words, n_hit, items (exact phrases; sorted strings), near_items (proximity), and
    spans of hit words (positions, end exclusive; those of several blocks may overlap)."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "decontamination")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    mine = [f"_{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")]
    index = build_index(df.select(*key, text.alias("text")), scratch)
    found = None
    with settings(spark, PASSED | READ):
        for b in range(blocks):
            block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
            phrases = Phrases((r[0], r[1]) for r in block.collect())
            counts = np.zeros(len(phrases.terms), np.int64)
            if len(phrases.terms):
                counted = map_batches(index.select("terms", "starts"), _count_terms, "term long, n long", phrases.terms)
                for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # the terms of one block at most
                    counts[r[0]] = r[1]
            phrases.rank_by(counts)
            # equal texts have equal results in a block: one of them is kept, and no list is gathered over repetitions
            part = map_batches(index, _look, FOUND, phrases, reach).groupBy("one", "two").agg(*[F.first(c).alias(c) for c in ("n_words", "items", "near_items", "spans")])
            found = part if found is None else found.unionByName(part if blocks == 1 else scratch.save(part))
        if blocks > 1:  # a row for each block
            flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
            found = found.groupBy("one", "two").agg(F.max("n_words").alias("n_words"), flat("items"), flat("near_items"), flat("spans"))
        n_hit = F.expr("aggregate(spans, struct(0L as upto, 0L as n), (acc, s) -> struct(greatest(acc.upto, s.to) as upto, acc.n + greatest(0L, s.to - greatest(s.from, acc.upto)) as n), acc -> acc.n)")
        found = scratch.save(found.withColumn("n_hit", n_hit))
    scratch.drop(index)
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], *key)
    names = kept_names(keep, FOUND + ", n_hit long")
    return plain.join(found, ["one", "two"], "left").select(*[F.col(m).alias(c) for c, m in zip(names, mine)], "n_words", "n_hit", "items", "near_items", "spans")


def contaminated():
    """The rule: a hit, and hits in at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
