"""Packing of token sequences into windows by non-negative least squares.

1. Every text is encoded once.  Whole windows are cut off a long document and fill sequences of their own; what is left is one piece
   shorter than a window.
2. Pieces are dealt over shards by a hash of the document, the piece and its row, ``SHARD_DOCS``
   documents in each on average, so a shard is a bounded task at every size, however often an id or a text repeats.
3. In a shard the lengths are binned; shallow combinations of at most three
   bins that fill a window exactly are enumerated; their repeat counts are the
   non-negative least squares solution against the shard's histogram, rounded down (to the nearest, uniform lengths
   fill 98.5 % of the windows, down 99 %).  Pieces are laid by these counts, and the residual ones go greedily, the
   longest first, into the fullest sequence that still has room.

Only lengths and checksums are shuffled, never texts or ids.  Defined results: a null
or empty text is one piece, its end id; repeated rows of one id are
separate pieces with the same id; ids keep their type; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import by_bytes, map_batches, texts
from roadflow.llm.tokens import BATCH_BYTES, TOKENIZER, tokenizer_path, word_encoder

WINDOW = 2048
END_ID = 1
#: Documents in a shard, on average.
SHARD_DOCS = 4000
#: Bins of a window's length in the least squares problem.
BINS = 256
#: Steps at most, and the change of all counts below which they end.
ROUNDS, TOLERANCE = 1000, 0.01

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batch: pa.RecordBatch, name: str, window: int):
    encoder = word_encoder(tokenizer_path(name))
    out: list[tuple] = []
    column = batch.column(1)
    end, size = END_ID.to_bytes(4, "little"), 4 * window
    for a, b in by_bytes(column, BATCH_BYTES):
        for row, text in enumerate(column.slice(a, b - a).to_pylist(), a):
            cut, start, rest = [], 0, b""
            for part in encoder.packed(text):
                rest += part
                whole = len(rest) // size * size
                for at in range(0, whole, size):
                    cut.append((start, window, zlib.crc32(rest[at : at + size])))
                    start += window
                rest = rest[whole:]
            rest += end
            cut.append((start, len(rest) // 4, zlib.crc32(rest)))
            total = start + len(rest) // 4
            out += [(s, n, c, total, row) for s, n, c in cut]
    found = [pa.array(x, pa.int64()) for x in zip(*out)]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(found[-1]), *found], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])


@lru_cache(maxsize=4)
def combinations(bins: int) -> np.ndarray:
    """Every multiset of one to three bins that adds up to all of them, as rows of bin numbers (0: none)."""
    rows = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(1, bins // 2 + 1)]
    for a in range(1, bins // 3 + 1):
        rows += [(a, b, bins - a - b) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(rows)


def solve_counts(histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring sum(x * combination) close to the histogram.

    Non-negative least squares by accelerated projected gradient; the matrix is sparse
    (three entries a row), so products are gathers and scatters.
    """
    bins = len(histogram) - 1
    combos = combinations(bins)
    used = combos[((combos == 0) | (histogram[combos] > 0)).all(axis=1)]
    target = histogram.astype(float)
    target[0] = 0
    if not len(used):
        return np.zeros(len(combos))
    weight = (used > 0).astype(float)

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(used.ravel(), (weight * x[:, None]).ravel(), bins + 1)

    degree = np.bincount(used.ravel(), weight.ravel(), bins + 1)
    step = 1.0 / max(1.0, (weight * degree[used]).sum(axis=1).max())  # no less than the largest eigenvalue, by row sums
    x = y = np.zeros(len(used))
    t = 1.0
    for _ in range(rounds):
        slope = ((product(y) - target)[used] * weight).sum(axis=1)
        z = np.maximum(0.0, y - step * slope)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        moved = np.abs(z - x).max()
        y, x, t = z + (t - 1) / u * (z - x), z, u
        if moved < TOLERANCE:
            break
    out = np.zeros(len(combos))
    out[((combos == 0) | (histogram[combos] > 0)).all(axis=1)] = x
    return out


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; lengths are 1 to ``window``."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == window).sum())
    sequence[order[:full]] = np.arange(full)
    rest = order[full:]
    width = window // bins
    of_bin = -(-lengths[rest] // width)
    histogram = np.bincount(of_bin, minlength=bins + 1)
    stacks = {b: list(rest[of_bin == b][::-1]) for b in np.flatnonzero(histogram)}
    room: list[tuple[int, int]] = []
    at = full
    counts = solve_counts(histogram)
    for c in np.argsort(-counts, kind="stable"):
        repeat = int(counts[c])
        if repeat < 1:
            break
        need = [int(b) for b in combinations(bins)[c] if b]
        for _ in range(repeat):
            if any(len(stacks.get(b, ())) < need.count(b) for b in need):
                break
            used = 0
            for b in need:
                piece = stacks[b].pop()
                sequence[piece], offset[piece] = at, used
                used += int(lengths[piece])
            if used < window:
                room.append((window - used, at))
            at += 1
    room.sort()
    left = sorted((p for s in stacks.values() for p in s), key=lambda p: (-lengths[p], p))
    for piece in left:
        size = int(lengths[piece])
        i = bisect.bisect_left(room, (size, -1))
        free, into = room.pop(i) if i < len(room) else (window, at)
        at += into == at
        sequence[piece], offset[piece] = into, window - free
        if free > size:
            bisect.insort(room, (free - size, into))
    return sequence, offset


def _pack_shard(key, batches):
    shard = key[0].as_py()
    data = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
    data = data.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    sequence, offset = pack_lengths(data["length"].to_numpy(), WINDOW)
    sequence = (np.int64(shard) << 32) + sequence
    out = data.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def cut_pieces(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and the row in its batch."""
    return map_batches(texts(df, id_col, text_col), _pieces, f"doc_id {df.schema[id_col].dataType.simpleString()}, {PIECES}, row long", tokenizer, WINDOW)


def pack(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence_id and offset; sequence ids are unique, not consecutive."""
    shards = max(1, -(-df.count() // SHARD_DOCS))
    pieces = cut_pieces(df, tokenizer, id_col, text_col)
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(shards)).cast("long")
    fields = f"doc_id {df.schema[id_col].dataType.simpleString()}, {PIECES}, sequence_id long, offset long"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack_shard, fields)
