"""Near copies by fingerprints: a byte-position inverted index with count filtering.

1. *Fingerprints.*  Every word shingle of a text, repeats included, votes with the 64 bits of its hash; a bit is set if more
   than half of the shingles have it.  Only different fingerprints go on, each with its smallest id.
2. *Index.*  A posting says which byte a fingerprint has at a position.  Two fingerprints that differ in at most two bits differ in at
   most two of eight bytes, so the tally of their common postings is at least six.  A list for each single posting would
   hold a 256th of all fingerprints, and tallies of its pairs would grow with the square of the corpus; so the guaranteed minimum is the key: each
   of the 28 lists of a fingerprint stands for six postings, and whoever meets in a list has the tally.
3. *Lists.*  The members of a list differ in 16 bits at most, so a list has at most 65,536 of them, whatever the corpus repeats.  Their
   pairs are not written out: two members are in reach if a change of at most one bit in each makes them equal, so members meet
   under their 17 changed values and are linked to the smallest one there.  This loses no connection and gives at most 17 links for a posting.
4. *Verification.*  Tally and bits of each link are counted again from the fingerprints themselves; components come from the links.

Defined results: a null, empty or blank text has the fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; rows that repeat, or repeat an id, are judged each; a row without an id links, but gives no component its id
(null where a component has no other); an empty table gives an empty table; a kept column that is named like an output is returned as
``kept_<name>``.  Texts of any length are read in blocks of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, add_columns, by_bytes, kept_names, map_batches
from roadflow.llm.jaccard import components

WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ, and the postings of eight that such a pair must share.
BITS, LEAST = 2, 6
#: Text bytes that are split into words at once.
BLOCK_BYTES = 1 << 18
#: Shingles whose bits are unpacked at once.
VOTES = 1 << 16
#: The two positions that a list leaves open, the first one higher.
OPEN = [(i, j) for j, i in combinations(range(8), 2)]

_U = np.uint64
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: No change, and a change of one of 16 bits.
_CHANGES = np.r_[0, 1 << np.arange(16)]


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The lower-case words (runs without white space), some of them at a time."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        cut = _WHITE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()  # bytes: A-Z only, and ASCII white space only
        at = end


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of all shingles, block by block."""
    from xxhash import xxh64_intdigest as digest

    tail: list[bytes] = []
    seen = False
    for block in word_blocks(text):
        block = tail + block
        if len(block) >= words:
            joined = b" ".join(block)
            end = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
            start = np.r_[0, end[:-1] + 1][: len(block) - words + 1]
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end[words - 1 :].tolist())], _U)
            seen = True
        tail = block[-(words - 1) :] if words > 1 else []
    if tail and not seen:
        yield np.array([digest(b" ".join(tail), SEED)], _U)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """For each hash its 64 bits, the lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """One number of 64 bits for each text."""
    count, size = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    waiting = 0

    def flush() -> None:
        if held:
            start = np.cumsum([0] + [len(h) for h in held[:-1]])
            np.add.at(count, owner, np.add.reduceat(_votes(np.concatenate(held)), start, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, words):
            held.append(hashes)
            owner.append(i)
            size[i] += len(hashes)
            waiting += len(hashes)
            if waiting >= VOTES:
                flush()
                waiting = 0
    flush()
    return np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def _fingerprint_column(batch: pa.RecordBatch, text: str, words: int) -> list[pa.Array]:
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"")
    parts = [fingerprints(column.slice(a, b - a).to_pylist(), words) for a, b in by_bytes(column, 4 << 20)]
    return [pa.array(np.concatenate(parts).view(np.int64))]


def postings(marks: DataFrame) -> DataFrame:
    """(list, key, rest): for each ``mark`` its 28 keys of six positional bytes, and the 16 bits that a key leaves open."""
    one = []
    for n, (i, j) in enumerate(OPEN):
        hole = (0xFF << 8 * i) | (0xFF << 8 * j)
        mask = int(np.array([~hole & (1 << 64) - 1], _U).view(np.int64)[0])
        rest = F.shiftleft(F.shiftrightunsigned("mark", 8 * i).bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftrightunsigned("mark", 8 * j).bitwiseAND(F.lit(0xFF)))
        one.append(F.struct(F.lit(n).cast("byte").alias("list"), F.col("mark").bitwiseAND(F.lit(mask)).alias("key"), rest.cast("int").alias("rest")))
    return marks.select(F.explode(F.array(*one)).alias("p")).select("p.*")


def near_members(number: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place of the smallest member under a common changed value) inside the lists that ``number`` tells apart."""
    n = len(rest)
    changed = ((number[:, None] << 16) | (rest[:, None] ^ _CHANGES)).ravel()
    place = np.repeat(np.arange(n), len(_CHANGES))
    by = np.lexsort((rest[place], changed))
    changed, place = changed[by], place[by]
    head = np.r_[True, changed[1:] != changed[:-1]]
    first = place[head][np.cumsum(head) - 1]
    link = np.unique(place[first != place] * n + first[first != place])
    return link // n, link % n


def _links(batch: pa.RecordBatch):
    which, key, rest = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U), batch.column(2)
    size = np.diff(rest.offsets.to_numpy())
    held = rest.flatten().to_numpy().astype(np.int64)
    at = np.r_[0, np.cumsum(size)]
    begin = 0
    while begin < len(size):  # lists of some hundred thousand members at once
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + (1 << 17), side="right")) - 1)
        own = held[at[begin] : at[end]]
        number = np.repeat(np.arange(end - begin), size[begin:end])
        a, b = near_members(number, own)
        high, low = (np.array([8 * p[k] for p in OPEN], _U)[which[begin:end][number]] for k in (0, 1))
        mark = key[begin:end][number] | ((own >> 8).astype(_U) << high) | ((own & 0xFF).astype(_U) << low)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(mark[b].view(np.int64)), pa.array(mark[a].view(np.int64))], ["a", "b"])
        begin = end


def shared_bytes(a: str, b: str):
    """The tally of a pair: at how many of eight positions both have the same byte."""
    change = F.col(a).bitwiseXOR(F.col(b))
    same = [F.when(F.shiftrightunsigned(change, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(8)]
    return sum(same[1:], same[0])


def link_marks(marks: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (``mark``, each once) within two bits of each other."""
    lists = postings(marks).groupBy("list", "key").agg(F.collect_set("rest").alias("rest")).where(F.size("rest") > 1)
    found = map_batches(lists, _links, "a long, b long")
    return found.where((shared_bytes("a", "b") >= LEAST) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))


def near_copies(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The columns ``keep`` of every document with fingerprint (hexadecimal) and component_id."""
    scratch = Scratch(df.sparkSession, "simhash")
    mine = [f"_k{i}" for i in range(len(keep))]
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marked = scratch.save(add_columns(plain, _fingerprint_column, "mark long", [*mine, "_id"], "_text", words))
    marks = scratch.save(marked.groupBy("mark").agg(F.min("_id").alias("first_id")))
    links = scratch.save(link_marks(marks.select("mark")).distinct())
    label = components(links, scratch).withColumnRenamed("class", "mark")
    named = marks.join(label, "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = scratch.save(named.join(lowest, "label").select("mark", "component_id"))
    names = kept_names(keep, "fingerprint string, component_id long")
    out = marked.join(ids, "mark", "left")
    return out.select(*[F.col(m).alias(c) for c, m in zip(names, mine)], F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
