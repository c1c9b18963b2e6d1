"""Repeated passages: byte strings of a threshold length that also start in an earlier document.

Distributed prefix doubling over sampled positions.  Strings of ``GRAM`` bytes are ranked where they
lie (equal strings, equal ranks); from there on Spark sorts pairs of a position's rank and the rank of what
lies at an offset, each round over longer strings, and after each round positions are dropped:

1. *Length ``GRAM``.*  Of each window of ``threshold`` bytes only the place of the smallest rank, its anchor, stands for it, a
   choice that depends on the window's bytes alone; so windows that repeat have anchors that
   repeat.  Spark sorts the ranks; those that a single text has are unique and gone.
2. *Whole stretches.*  Neighbouring windows with one anchor are a stretch.  Spark sorts the pairs (rank of the
   anchor, rank of the bytes around it).  A stretch that an earlier document has is removed whole, and a rank
   that is left with one stretch or one document is settled: its first document keeps it, nobody else is open.
3. *Length ``threshold``.*  What is open goes past the threshold window by window: pairs of two ranks of 64 and 31 bits.

A stretch that occurs several times in a document is one row with several places.  Texts that are equal
as a whole count once; later copies are removed whole.  What is repeated inside one part of a
batch is settled there: a hot rank leaves a part once, and the settled rows travel under keys of their own.

Defined results: null texts are empty; a text shorter than the threshold keeps all; rows without an
id are kept whole and are no source; rows that repeat an id are not earlier than each other; ids that are no whole numbers count in their own order (texts by their bytes);
an empty table gives an empty table; a kept column that is named like an output is returned as ``kept_<name>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.common import Scratch, add_columns, by_bytes, kept_names, map_batches
from roadflow.llm.hashing import BLOCK, FIRST, SECOND, Ranks, spread
from roadflow.operators.ordering import number_rows

THRESHOLD = 50
GRAM = 24
#: Text bytes in which repeats are settled before anything is sent.
PART_BYTES = 16 << 20
#: Rows in a batch that leaves a function.
SEND = 100_000

PLACES = "key long, other long, doc long, kind byte"
STRETCHES = "rank long, around long, doc long, version long, count int, settled boolean, firsts array<long>"
WINDOWS = "one long, two int, doc long, place long, more array<long>, settled boolean"

_U = np.uint64
_PLACE_BITS = _U((1 << 18) - 1)


def stretches(data: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(rank, rank of all bytes, text, place of the first window, number of windows) of the stretches of joined texts, block by block.

    ``ends``: where each text ends.  No window reaches into the next text; of equal ranks in a window the leftmost is its anchor.
    A stretch that a block's end cuts is two.
    """
    for a in range(0, len(data) - threshold + 1, BLOCK):
        block = data[a : a + BLOCK + threshold - 1]
        windows = len(block) - threshold + 1
        ranks = Ranks(block, FIRST)
        rank = ranks.all(gram)
        low, width, done = (rank & ~_PLACE_BITS) | np.arange(len(rank), dtype=_U), threshold - gram + 1, 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[step:], low[:-step])
            done += step
        inside = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(block), side="left")] - a
        edge = np.zeros(windows + 1, np.int32)  # windows that reach over the end of their text
        np.add.at(edge, np.clip(inside - threshold + 1, 0, windows), 1)
        np.add.at(edge, np.clip(inside, 0, windows), -1)
        bad = np.cumsum(edge[:-1]) > 0
        head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (bad[1:] != bad[:-1])])
        count = np.diff(np.r_[head, windows])
        good = ~bad[head]
        head, count = head[good], count[good]
        if len(head):
            place = (low[head] & _PLACE_BITS).astype(np.int64)
            around = Ranks(block, SECOND).at(head, count + threshold - 1) + _U(threshold) * (place - head).astype(_U)
            yield rank[place], around, np.searchsorted(ends, a + head, side="right"), a + head, count


def _join(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each ends)."""
    parts = [np.frombuffer(v.as_buffer(), np.uint8) for v in column]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _bytes(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).fill_null(b"")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, in sorted rows."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _lists(values: np.ndarray, size: np.ndarray, null_empty: bool = False) -> pa.Array:
    """Lists of the given sizes over consecutive values."""
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    mask = pa.array(size == 0) if null_empty else None
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)), mask=mask)


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all slices, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)


def _places(batch: pa.RecordBatch, threshold: int, gram: int):
    """Rows (key, other, doc, kind): 0 a rank of one text in the part (other: the text), 1 the first of several, 2 one of several (other: the rank)."""
    import xxhash

    docs, column = batch.column(0).to_numpy(), _bytes(batch, "text")
    for a, b in by_bytes(column, PART_BYTES):
        owners: dict[int, int] = {}  # row of each text: of equal texts only the smallest document goes on
        for i in range(a, b):
            key = xxhash.xxh3_64_intdigest(column[i].as_buffer())
            if key not in owners or docs[i] < docs[owners[key]]:
                owners[key] = i
        rows, keys = np.fromiter(owners.values(), np.int64), np.fromiter(owners, _U)
        data, ends = _join(column.take(pa.array(rows)))
        found = [(rank, text) for rank, _, text, _, _ in stretches(data, ends, threshold, gram)]
        if not found:
            continue
        rank, text = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((text, rank))
        rank, text = rank[by], text[by]
        once = _runs(rank, text)
        rank, text = rank[once], text[once]
        head = _runs(rank)
        count = np.diff(np.r_[np.flatnonzero(head), len(rank)])
        several = np.repeat(count > 1, count)
        # the first of several goes twice: as the rank's only row, and with the others under a key of its own
        send = np.r_[np.flatnonzero(head), np.flatnonzero(several)]
        kind = np.r_[several[head].astype(np.int8), np.full(int(several.sum()), 2, np.int8)]
        rank, text = rank[send], keys[text[send]]
        doc = docs[rows][np.concatenate([x[1] for x in found])[by][once][send]]
        settled = kind == 2
        key = np.where(settled, spread(rank + text * _U(3)), rank)
        other = np.where(settled, rank, text)
        for c in range(0, len(key), SEND):
            d = c + SEND
            yield pa.RecordBatch.from_arrays([pa.array(key[c:d].view(np.int64)), pa.array(other[c:d].view(np.int64)), pa.array(doc[c:d]), pa.array(kind[c:d])], ["key", "other", "doc", "kind"])


def _shared(sent: DataFrame) -> DataFrame:
    """(doc, ranks): for each document its ranks that another text has too."""
    w = W.partitionBy("key")
    shared = sent.withColumn("shared", (F.max("kind").over(w) > 0) | (F.min("other").over(w) != F.max("other").over(w))).where("shared and kind <> 1")
    live = shared.select("doc", F.when(F.col("kind") == 2, F.col("other")).otherwise(F.col("key")).alias("rank"))
    return live.groupBy("doc").agg(F.collect_list("rank").alias("ranks"))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _live_stretches(batch: pa.RecordBatch, threshold: int, gram: int):
    """One row for each live stretch of a document in a part of the batch, with all its places there."""
    docs, versions, column, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch, "text"), batch.column(3)
    for a, b in by_bytes(column, PART_BYTES):
        data, ends = _join(column.slice(a, b - a))
        live = np.unique(wanted.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).view(_U))
        parts = []
        for part in stretches(data, ends, threshold, gram):
            take = _among(part[0], live)
            parts.append([x[take] for x in part])
        if not parts:
            continue
        rank, around, text, first, count = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((first, text, docs[a + text], around, rank))
        rank, around, text, first, count = (x[by] for x in (rank, around, text, first, count))
        if not len(rank):
            continue
        doc = docs[a + text]
        group = np.flatnonzero(_runs(rank, around))
        least = np.repeat(doc[group], np.diff(np.r_[group, len(rank)]))
        row = np.flatnonzero(_runs(rank, around, text))
        places = _lists(first - np.r_[0, ends][text], np.diff(np.r_[row, len(rank)]))
        rank, around, text, count, doc, settled = (x[row] for x in (rank, around, text, count, doc, doc > least))
        key = np.where(settled, spread(rank + doc.view(_U) + _U(11) * around), rank)
        for c in range(0, len(rank), SEND):
            s = slice(c, c + SEND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[s].view(np.int64)), pa.array(around[s].view(np.int64)), pa.array(doc[s]), pa.array(versions[a + text[s]]), pa.array(count[s].astype(np.int32)), pa.array(settled[s]), places.slice(c, len(rank[s]))],
                ["rank", "around", "doc", "version", "count", "settled", "firsts"],
            )


def _windows(batch: pa.RecordBatch, threshold: int):
    """One row for each window of the open stretches, with the further places of the same window in its document (more).

    What an earlier document of the part has is settled: runs of such windows are one row, whose ``two`` is the number of windows.
    Places hold 24 bits of the text's version above the position.
    """
    docs, versions, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch, "text")
    for a, b in by_bytes(column, PART_BYTES):
        data, ends = _join(column.slice(a, b - a))
        begin = np.r_[0, ends]
        size = np.diff(batch.column(3).slice(a, b - a).offsets.to_numpy())
        first, count = (batch.column(k).slice(a, b - a).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
        text = np.repeat(np.arange(b - a), size)
        by = np.lexsort((first, text))
        first, count, text = begin[text[by]] + first[by], count[by], text[by]
        at, text = _slices(first, count), np.repeat(text, count)
        one, two = np.empty(len(at), _U), np.empty(len(at), _U)
        for c in range(0, len(data) - threshold + 1, BLOCK):
            i, j = np.searchsorted(at, (c, c + BLOCK))
            if i < j:
                block = data[c : c + BLOCK + threshold - 1]
                one[i:j] = Ranks(block, FIRST).all(threshold)[at[i:j] - c]
                two[i:j] = Ranks(block, SECOND).all(threshold)[at[i:j] - c]
        two &= _U(0x7FFFFFFF)
        by = np.lexsort((at, text, docs[a + text], two, one))
        one, two, at, text = one[by], two[by], at[by], text[by]
        own = docs[a + text]
        group = np.flatnonzero(_runs(one, two))
        settled = own > np.repeat(own[group], np.diff(np.r_[group, len(one)]))
        mark = (versions[a + text] & 0xFFFFFF) << 32
        row = np.flatnonzero(_runs(one, two, text) & ~settled)
        place = mark + at - begin[text]
        rest = np.flatnonzero(~settled)
        nth = np.searchsorted(rest, row)
        more = np.diff(np.r_[nth, len(rest)]) - 1
        others = np.delete(place[rest], nth)
        upto = np.cumsum(more)
        for c in range(0, len(row), SEND):
            r = row[c : c + SEND]
            some = others[upto[c] - more[c] : upto[min(c + SEND, len(row)) - 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[r].view(np.int64)), pa.array(two[r].astype(np.int32)), pa.array(own[r]), pa.array(place[r]), _lists(some, more[c : c + SEND], True), pa.array(np.zeros(len(r), bool))],
                WINDOW_NAMES,
            )
        gone = np.sort(at[settled])
        if len(gone):
            head = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1] + 1])  # texts are further apart
            run = np.diff(np.r_[head, len(gone)])
            of = np.searchsorted(ends, gone[head], side="right")
            place = ((versions[a + of] & 0xFFFFFF) << 32) + gone[head] - begin[of]
            key = spread(place.view(_U) + docs[a + of].view(_U) * _U(13))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(run.astype(np.int32)), pa.array(docs[a + of]), pa.array(place), pa.nulls(len(head), pa.list_(pa.int64())), pa.array(np.ones(len(head), bool))],
                WINDOW_NAMES,
            )


WINDOW_NAMES = ["one", "two", "doc", "place", "more", "settled"]


def covered(n: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks of the bytes in any of the spans."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batch: pa.RecordBatch, with_text: bool) -> list[pa.Array]:
    column, copied = _bytes(batch, "_text"), batch.column(batch.schema.get_field_index("_copied")).to_pylist()
    firsts, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("_first", "_size"))
    out = []
    for i, value in enumerate(column):
        raw = value.as_py()
        if copied[i]:
            mark = np.ones(len(raw), bool)
        elif firsts[i].is_valid:
            mark = covered(len(raw), firsts[i].values.to_numpy(), sizes[i].values.to_numpy())
        else:
            mark = np.zeros(len(raw), bool)
        kept = np.frombuffer(raw, np.uint8)[~mark].tobytes() if mark.any() else raw
        spans = int(np.count_nonzero(np.diff(np.r_[False, mark].astype(np.int8)) == 1))
        out.append((len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array(x, k) for x, k in list(zip(zip(*out), kinds))[: 5 if with_text else 4]]


def remove_repeats(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every document with n_bytes, n_removed, n_spans, kept_sha256 (and kept_text: what is left, cut characters dropped)."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "repeats")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    mine = [f"_{i}" for i in range(len(keep))]
    whole_ids = isinstance(df.schema[id_col].dataType, T.IntegralType)
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    if not whole_ids:  # numbers in the order of the ids take their place
        ids = number_rows(plain.where("_id is not null").select("_id").distinct(), ["_id"], "_nth")
        plain = scratch.save(plain.join(ids, "_id", "left").drop("_id").withColumnRenamed("_nth", "_id"))
    plain = plain.withColumn("_id", F.col("_id").cast("long"))
    plain = plain.withColumn("_version", F.xxhash64("_text"))
    long_ones = plain.where(F.col("_id").isNotNull() & (F.octet_length("_text") >= threshold))

    # equal texts
    seen = scratch.save(long_ones.select("_id", "_version", F.md5(F.col("_text").cast("binary")).alias("same")))
    first_of = scratch.save(seen.groupBy("same").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first"))  # a join of written tables can split a large group
    copied = scratch.save(seen.join(first_of, "same").where("_id > first").select("_id", "_version").distinct())
    scratch.drop(seen, first_of)

    # round 1: anchors
    one = long_ones.select(F.col("_id").alias("doc"), F.col("_version").alias("version"), F.col("_text").alias("text"))
    live = _shared(map_batches(one, lambda b: _places(b, threshold, gram), PLACES))
    done = copied.groupBy(F.col("_id").alias("doc")).agg(F.collect_set("_version").alias("done"))
    live = scratch.save(live.join(done, "doc", "left"))

    # round 2: stretches
    work = one.join(live, "doc").where("done is null or not array_contains(done, version)").select("doc", "version", "text", "ranks")
    found = map_batches(work, _live_stretches, STRETCHES, threshold, gram)
    judged = found.withColumn("gone", F.col("settled") | (F.col("doc") > F.min("doc").over(W.partitionBy("rank", "around"))))
    judged = scratch.save(judged.select("rank", "around", "doc", "version", "count", "firsts", "gone"))
    scratch.drop(live)

    # round 3: windows of the ranks that are still open
    left = judged.where(~F.col("gone"))
    several = left.groupBy("rank").agg(F.min("around").alias("a"), F.max("around").alias("b"), F.min("doc").alias("c"), F.max("doc").alias("d")).where("a <> b and c <> d")
    places = left.join(several.select("rank"), "rank", "left_semi").select("doc", "version", "count", F.explode("firsts").alias("first"))
    places = scratch.save(places.groupBy("doc", "version").agg(F.collect_list(F.struct("first", "count")).alias("p")).select("doc", F.col("version").alias("v"), F.col("p.first").alias("firsts"), F.col("p.count").alias("counts")))
    bits = F.lit(0xFFFFFF)
    whole = scratch.save(judged.where("gone").select("doc", F.col("version").bitwiseAND(bits).alias("v"), "firsts", (F.col("count") + threshold - 1).cast("long").alias("size")))
    scratch.drop(judged)
    work = one.join(places, "doc").where("version = v").select("doc", "version", "text", "firsts", "counts")
    windows = map_batches(work, _windows, WINDOWS, threshold)
    gone = F.col("settled") | (F.col("doc") > F.min("doc").over(W.partitionBy("one", "two")))
    again = scratch.save(windows.withColumn("gone", gone).where("gone").select("doc", "place", "more", F.when(F.col("settled"), F.col("two")).otherwise(1).alias("run")))
    scratch.drop(places)

    # spans of each document
    spans = whole.select("doc", "v", F.explode("firsts").alias("first"), "size")
    placed = again.select("doc", "place", "run").unionByName(again.where("more is not null").select("doc", F.explode("more").alias("place"), "run"))
    spans = spans.unionByName(placed.select("doc", F.shiftright("place", 32).alias("v"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("first"), (F.col("run") + threshold - 1).cast("long").alias("size")))
    spans = spans.groupBy(F.col("doc").alias("_id"), "v").agg(F.collect_list(F.struct("first", "size")).alias("s"))
    copies = copied.select("_id", F.col("_version").bitwiseAND(bits).alias("v"), F.lit(True).alias("_copied"))
    spans = spans.join(copies, ["_id", "v"], "full").select("_id", "v", F.col("s.first").alias("_first"), F.col("s.size").alias("_size"), F.coalesce("_copied", F.lit(False)).alias("_copied"))
    spans = scratch.save(spans)
    scratch.drop(whole, again, copied)
    out = plain.withColumn("v", F.col("_version").bitwiseAND(bits)).join(spans, ["_id", "v"], "left").withColumn("_copied", F.coalesce("_copied", F.lit(False)))
    done = add_columns(out, _cut, fields, mine, with_text)
    return done.select(*[F.col(m).alias(c) for m, c in zip(mine, kept_names(keep, fields))], *done.columns[len(mine) :])
