"""Phrase collocations: frequent word sequences by level-wise passes, scored by their weakest cut.

1. *Level one* counts the words of every language.  Each task numbers the words of a part of its texts exactly (as an Arrow
   dictionary) and sends one row for each different word of the part.
2. *Levels two to ``longest``.*  A sequence of k words can only be frequent if both sequences of k - 1 words in it are.  So the
   frequent ones of the level before are broadcast, as a table of bits under their hashes, and a task counts a sequence only if both bits are
   set.  The table has 16 bits for each entry and ``MOST_BITS`` bits at most: that bound holds for any corpus, and where it is reached more
   sequences are counted than need be.  Counts decide in the end, and they are exact, so the table never changes a result.
3. *Scores.*  The parts of each cut are looked up in the tables of the levels, as joins; nothing is counted again.
4. *Inner phrases.*  Each longer candidate tells its inner phrases its count; their maximum decides who is dropped.

Cuts, joins and maxima have the phrase in their key, so a common word or language is dealt over all tasks.  The first places of a
language are taken in two steps: of ``SALTS`` parts of it each, then of what those left.

Defined results: a null text is empty, a null language is ``und``; rows that repeat, or repeat an id, count each; a text without
words counts nothing; ties are ranked by score, count, then phrase by its bytes; without candidates, and for an empty table, the result
is empty.  Other columns are not read.  A long text is cut between words, and each part sees the words that its last sequences need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, by_size, map_batches
from roadflow.llm.hashing import LOWER, hashed_words, spread, word_spans

LEAST, LONGEST, TOP = 30, 4, 2000
#: Percent of a phrase's count from which a longer candidate stands for it.
INSIDE = 80
#: Text bytes that are counted together.
PART_BYTES = 4 << 20
#: Bits of the broadcast table: for each entry, and in all (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
SALTS = 256
#: Rows in a batch that leaves a function.
SEND = 100_000

COUNTS = "lang string, phrase string, n long"

_U = np.uint64
#: Bytes that end a piece, and those together with the ones between words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_ANY_GAP = re.compile(rb"[.,;:!?\x20\x09-\x0D]")


def spans(text: bytes, limit: int, longest: int = LONGEST) -> Iterator[tuple[int, int, int]]:
    """(begin, end of what is counted, end with the words after it) of the parts of a text, cut between words."""
    reach = re.compile(rb"(?:[.,;:!?\x20\x09-\x0D]*[^.,;:!?\x20\x09-\x0D]+){0,%d}" % (longest - 1))
    at = 0
    while at < len(text) or at == 0:
        cut = _ANY_GAP.search(text, at + limit) if at + limit < len(text) else None
        if cut is None:
            yield at, len(text), len(text)
            return
        yield at, cut.start(), reach.match(text, cut.start()).end()
        at = cut.start()


class Part:
    """The words of some text parts: number of each in the part's dictionary, language, and whether the next one is in the same piece."""

    def __init__(self, parts: list[tuple[bytes, int, int]]):
        """``parts``: (bytes, bytes of it that are counted, number of the language)."""
        data = LOWER[np.frombuffer(b"\n".join(p for p, _, _ in parts), np.uint8)]
        start, end = word_spans(data, _GAP)
        bare = np.ascontiguousarray(data[~_GAP[data]])
        offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy()
        breaks = np.flatnonzero(_BREAK[data])
        self.together = np.searchsorted(breaks, start[1:]) == np.searchsorted(breaks, end[:-1])
        begin = np.cumsum([0] + [len(p) + 1 for p, _, _ in parts])
        of = np.searchsorted(begin, start, side="right") - 1
        self.own = start < (begin[:-1] + np.array([n for _, n, _ in parts], np.int64))[of]
        self.lang = np.array([g for _, _, g in parts], np.int32)[of]

    def runs(self, k: int) -> np.ndarray:
        """Whether k words from each place on are in one piece."""
        n = max(0, len(self.word) - k + 1)
        ok = np.ones(n, bool)
        for j in range(k - 1):
            ok &= self.together[j : j + n]
        return ok

    def hashes(self, k: int, languages: np.ndarray) -> np.ndarray:
        """The hash of k words from each place on."""
        own = word_hashes(self.words)
        n = max(0, len(self.word) - k + 1)
        value = languages[self.lang[:n]]
        for j in range(k):
            value = chain(value, own[self.word[j : j + n]])
        return value

    def distinct(self, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, count) of the different sequences of k words at some places, told apart by language and words."""
        number = self.lang[place]
        for j in range(k):
            number = pa.array((number.astype(np.int64) << 32) | self.word[place + j]).dictionary_encode().indices.to_numpy()
        count = np.bincount(number)
        first = np.empty(len(count), np.int64)
        first[number[::-1]] = place[::-1]
        return first, count


def chain(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    return spread((value * _U(0x9E3779B97F4A7C15)) ^ word)


def word_hashes(words: pa.Array) -> np.ndarray:
    return hashed_words(np.frombuffer(b" ".join(words.to_pylist()), np.uint8))[0]


def language_hashes(names: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], _U)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Part, list[str]]]:
    """Parts of about ``PART_BYTES`` of (lang, text) rows, and the names of their languages."""
    langs = batch.column(0).dictionary_encode()
    names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    column = batch.column(1).cast(pa.binary())
    cut = [(i, *s) for i in range(len(lang)) for s in spans(column[i].as_py(), PART_BYTES)] if pc.max(pc.binary_length(column)).as_py() > PART_BYTES else None
    if cut is None:
        sizes = pc.binary_length(column).to_pylist()
        for a, b in by_size(sizes, PART_BYTES):
            yield Part([(t, len(t), g) for t, g in zip(column.slice(a, b - a).to_pylist(), lang[a:b].tolist())]), names
        return
    for a, b in by_size((c[3] - c[1] for c in cut), PART_BYTES):
        yield Part([(column[i].as_py()[begin:end], own - begin, int(lang[i])) for i, begin, own, end in cut[a:b]]), names


def _send(part: Part, names: list[str], first: np.ndarray, count: np.ndarray, k: int):
    for a in range(0, len(first), SEND):
        at = first[a : a + SEND]
        words = [part.words.take(pa.array(part.word[at + j])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, b" ")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(part.lang[at])), phrase.cast(pa.string()), pa.array(count[a : a + SEND])], ["lang", "phrase", "n"])


def _count_words(batch: pa.RecordBatch):
    """(lang, word, n) of each part, and the number of all its words under a null."""
    for part, names in _parts(batch):
        place = np.flatnonzero(part.own)
        if len(place):
            yield from _send(part, names, *part.distinct(place, 1), 1)
            total = np.bincount(part.lang[place], minlength=len(names))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[g] for g in some], pa.string()), pa.nulls(len(some), pa.string()), pa.array(total[some])], ["lang", "phrase", "n"])


def _count_level(batch: pa.RecordBatch, k: int, table: np.ndarray, shift: int):
    """(lang, phrase, n) of the sequences of k words whose two inner ones have their bits in the table."""
    for part, names in _parts(batch):
        if len(part.word) < k:
            continue
        at = part.hashes(k - 1, language_hashes(names)) >> _U(shift)
        known = part.runs(k - 1) & ((table[at >> _U(6)] >> (at & _U(63))) & _U(1)).astype(bool)
        place = np.flatnonzero(known[:-1] & known[1:] & part.runs(k) & part.own[: len(known) - 1])
        if len(place):
            yield from _send(part, names, *part.distinct(place, k), k)


def _bits(batch: pa.RecordBatch, k: int, shift: int):
    """The place in the table of each (lang, phrase) of k words."""
    langs = batch.column(0).dictionary_encode()
    words = word_hashes(batch.column(1).cast(pa.binary())).reshape(-1, k)
    value = language_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
    for j in range(k):
        value = chain(value, words[:, j])
    yield pa.RecordBatch.from_arrays([pa.array((value >> _U(shift)).astype(np.int64))], ["at"])


def bit_table(level: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """(words of 64 bits, shift of a hash to its place) for the sequences of k words in a table: at most ``MOST_BITS`` bits."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * level.count()):
        size *= 2
    shift = 64 - (size.bit_length() - 1)
    at = map_batches(level.select("lang", "phrase"), _bits, "at long", k, shift)
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size >> 6, _U)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(_U)
    return table, shift


def count_levels(df: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) of all words, the written tables (lang, phrase, n) of the frequent sequences of 1, 2, ... words)."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = lambda counted: counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = scratch.save(total(map_batches(rows, _count_words, COUNTS)).where((F.col("n") >= least) | F.col("phrase").isNull()))
    levels = [words.where("phrase is not null")]
    for k in range(2, longest + 1):
        table, shift = bit_table(levels[-1], k - 1)
        levels.append(scratch.save(total(map_batches(rows, _count_level, COUNTS, k, table, shift)).where(F.col("n") >= least)))
    return words.where("phrase is null").select("lang", "n"), levels


def _slices(phrase: str, k: int, size: int) -> list:
    """The inner phrases of ``size`` words of a phrase of k."""
    return [F.expr(f"array_join(slice(split({phrase}, ' '), {i}, {size}), ' ')") for i in range(1, k - size + 2)]


def score_cuts(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of two words or more, by the cut with the lowest score."""
    cuts = None
    for k, level in enumerate(levels[1:], 2):
        for j in range(1, k):
            one = level.select("lang", "phrase", F.col("n").alias("a"), F.lit(j).alias("k"), F.expr(f"substring_index(phrase, ' ', {j})").alias("first"), F.expr(f"substring_index(phrase, ' ', {j - k})").alias("rest"))
            cuts = one if cuts is None else cuts.unionByName(one)
    known = levels[0]
    for level in levels[1:-1]:
        known = known.unionByName(level)
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # a product of counts may pass 64 bits: decimals divide exactly
    scored = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def stood_for(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer candidate around each inner phrase."""
    inner = None
    for k, level in enumerate(levels[2:], 3):
        one = level.select("lang", F.explode(F.array(*[x for size in range(2, k) for x in _slices("phrase", k, size)])).alias("phrase"), "n")
        inner = one if inner is None else inner.unionByName(one)
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    scratch = Scratch(df.sparkSession, "collocations")
    totals, levels = count_levels(df, scratch, lang_col, text_col, least, longest)
    scored = score_cuts(levels)
    if longest > 2:
        scored = scored.join(stood_for(levels), ["lang", "phrase"], "left").where(f"most is null or 100 * most < {inside} * a").drop("most")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> str:
    """The same in DuckDB: every sequence of one to four words is counted, none is filtered before."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from t),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
f as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f from w, unnest(range(1, len(w) + 1)) as a(i), unnest([1, 2, 3, 4]) as b(k) where i + k - 1 <= len(w) group by all),
c as (select lang, phrase, string_split(phrase, ' ') as w, k, f as a from f where k > 1 and f >= {least}),
s as (select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, (2000000::HUGEINT * c.a) // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as j from c) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, array_to_string(w[b:b + n - 1], ' ') as phrase, max(a) as most from c, unnest(range(1, 4)) as u(b), unnest([2, 3]) as v(n) where n < k and b + n - 1 <= k group by all),
o as (select m.* from m left join i using (lang, phrase) where most is null or 100 * most < {inside} * a),
n as (select lang, sum(f)::BIGINT as n from f where k = 1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::BIGINT as rank, phrase, a::BIGINT as a, l::BIGINT as l, r::BIGINT as r, n, score::BIGINT as score
from o join n using (lang) qualify rank <= {top}"""
