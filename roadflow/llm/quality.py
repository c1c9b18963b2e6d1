"""Document quality from a linear-chain conditional random field over lines.

Each line of a text gets features of its own bytes and of its neighbours; the field
labels every line good or bad.  The marginals of forward-backward, weighted by line
length, add up to the quality of the document.

Training reads labelled documents only, ``TRAIN_DOCS`` of each class at most, taken
in the order of a checksum of their ids, and of each ``TRAIN_LINES`` neighbouring lines at most, from a place
that the checksum gives.  Every line of a training document carries its document's
label.  Features are made on the executors; what reaches the driver is bounded by
these two parameters.  Scoring covers every whole text; one of many lines goes through in blocks of lines, and its
chain in segments that advance together.

Defined results: a null or empty text is one empty line; its score is the field's
marginal of such a line.  Equal texts have equal scores.  Labels that repeat or
disagree count by their minimum; null labels are left out.  Without labels of both
classes every score is 0.5.  An empty table gives an empty table.  A kept column that is named like the output is
returned as ``kept_<name>``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import add_columns, by_size, map_batches

TRAIN_DOCS = 1500
TRAIN_LINES = 256
STEPS = 150
#: Text bytes, and 128 more for each line, that are looked at together.
BATCH_BYTES = 1 << 20
LINE_BYTES = 128
#: Lines of one text that are looked at together.
BLOCK_LINES = 1 << 13

#: Byte classes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 sentence mark, 5 exclamation, 6 bar and other separators, 7 symbol, 8 beyond ASCII, 9 control.
CLASSES = 10


def _classes() -> np.ndarray:
    table = np.full(256, 9, np.uint8)
    table[33:127] = 7
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for c in b" \t":
        table[c] = 3
    for c in b".,;:?'\"()-":
        table[c] = 4
    table[ord("!")] = 5
    for c in b"|/\\_<>=~":
        table[c] = 6
    table[128:] = 8
    return table


_TABLE = _classes()
#: Features of one line, and of a line with its neighbours and a constant.
OWN = CLASSES - 1 + 9
WIDTH = 3 * OWN + 3


def own_features(lines: list[bytes], again: np.ndarray) -> np.ndarray:
    """Features of lines by themselves; ``again`` marks those that their text had before."""
    size = np.array([len(x) for x in lines], np.int64)
    n = len(size)
    data = np.frombuffer(b"".join(lines), np.uint8)
    tally = np.bincount(np.repeat(np.arange(n), size) * CLASSES + _TABLE[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    fresh = np.ones(n)
    for i, x in enumerate(lines):
        if words := x.split():
            fresh[i] = len(set(words)) / len(words)
    share = tally / np.maximum(size, 1)[:, None]
    words = tally[:, 3] + 1
    letters = tally[:, 0] + tally[:, 1] + tally[:, 8]
    return np.column_stack([
        share[:, : CLASSES - 1],
        np.log1p(size) / 6,
        np.minimum(size / words, 40) / 10,
        tally[:, 1] / np.maximum(letters, 1),
        (tally[:, 5] + tally[:, 6] + tally[:, 7]) / words,
        tally[:, 4] / words,
        again & (size > 0),
        size == 0,
        1 - fresh,
        fresh < 0.5,
    ])


def repeated(lines: list[bytes], seen: set[bytes]) -> list[bool]:
    """Whether each line is among those seen before; ``seen`` grows."""
    out = []
    for x in lines:
        out.append(x in seen)
        seen.add(x)
    return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length, lines in each text)."""
    split = [t.split(b"\n") for t in texts]
    count = np.array([len(x) for x in split], np.int64)
    flat = [x for lines in split for x in lines]
    own = own_features(flat, np.array([r for lines in split for r in repeated(lines, set())], bool))
    n = len(flat)
    first = np.cumsum(count) - count
    last = first + count - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.zeros((n, 3))
    edge[:, 0] = 1
    edge[first, 1], edge[last, 2] = 1, 1
    return np.hstack([own, before, after, edge]), np.array([len(x) for x in flat], float), count


def line_scores(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of the good label, length) of every line of a text: ``line_features`` times the weights, block by block."""
    cut = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    start, end = np.r_[0, cut + 1], np.r_[cut, len(text)]
    n = len(start)
    good, parts, seen, again = np.empty(n), np.split(weights, (OWN, 2 * OWN, 3 * OWN)), set(), np.empty(n, bool)
    for a in range(0, n, BLOCK_LINES):
        b = min(a + BLOCK_LINES, n)
        low, high = max(a - 1, 0), min(b + 1, n)
        lines = [text[s:e] for s, e in zip(start[low:high].tolist(), end[low:high].tolist())]
        known = a + 1 if a else 0  # flags of the lines before are there: the last block looked one line ahead
        again[known:high] = repeated(lines[known - low :], seen)
        own = own_features(lines, again[low:high])
        total = own[a - low : b - low] @ parts[0] + parts[3][0]
        total[int(a == 0) :] += own[: b - low - 1] @ parts[1]
        after = own[a - low + 1 :] @ parts[2]
        total[: len(after)] += after
        good[a:b] = total
    good[0] += parts[3][1]
    good[-1] += parts[3][2]
    return good, (end - start).astype(float)


@dataclass
class Field:
    """Weights of the good label for each feature, and the four transition scores (from, to; 0 bad, 1 good)."""

    weights: np.ndarray
    links: np.ndarray

    def marginals(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _forward_backward(features @ self.weights, self.links, count)[0]


def _forward_backward(good: np.ndarray, links: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of good for each line, expected transitions, sum of log partition functions).

    All documents advance together, the longest first, so step t works on those
    with more than t lines.
    """
    order = np.argsort(-count, kind="stable")
    start = (np.cumsum(count) - count)[order]
    left = count[order]
    steps = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(steps), side="left")  # documents with more than t lines
    emit = np.zeros((len(good), 2))
    peak = np.maximum(good, 0)
    emit[:, 0], emit[:, 1] = np.exp(-peak), np.exp(good - peak)
    move = np.exp(links)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(good))
    for t in range(steps):
        i = start[: alive[t]] + t
        a = emit[i] if t == 0 else (alpha[i - 1] @ move) * emit[i]
        scale[i] = total = a.sum(axis=1)
        alpha[i] = a / total[:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        i = start[: alive[t]] + t
        back = emit[i] * beta[i] / scale[i][:, None]
        beta[i - 1] = back @ move.T
        pairs += (alpha[i - 1].T @ back) * move
    return alpha[:, 1] * beta[:, 1], pairs, float(np.log(scale).sum() + peak.sum())


def long_marginals(good: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Marginals of good along one long chain.

    The chain is cut into about as many segments as each has lines.  A segment's steps multiply to one matrix;
    with these the messages at the segments' ends are known, and all segments go on from there together.
    """
    n = len(good)
    width = int(np.ceil(np.sqrt(n)))
    rows = -(-n // width)
    pad = np.concatenate([good, np.zeros(rows * width - n)]).reshape(rows, width)
    inside = (np.arange(rows * width) < n).reshape(rows, width)
    move = np.exp(links)

    def steps(j: int) -> np.ndarray:
        """The matrices (from, to) of line j of every segment; the first line comes from nowhere, lines beyond the end change nothing."""
        peak = np.maximum(pad[:, j], 0)
        out = move * np.stack([np.exp(-peak), np.exp(pad[:, j] - peak)], axis=1)[:, None, :]
        if j == 0:
            out[0] = np.diag(out[0, 0] / move[0])
        out[~inside[:, j]] = np.eye(2)
        return out

    whole = np.tile(np.eye(2), (rows, 1, 1))
    for j in range(width):
        whole = whole @ steps(j)
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    left, right = np.ones((rows + 1, 2)), np.ones((rows + 1, 2))  # messages before each segment, and behind it
    for k in range(rows):
        left[k + 1] = left[k] @ whole[k]
        left[k + 1] /= left[k + 1].sum()
    for k in range(rows - 1, 0, -1):
        right[k] = whole[k] @ right[k + 1]
        right[k] /= right[k].sum()
    out, now = np.empty((rows, width)), left[:-1, None, :]
    for j in range(width):
        now = now @ steps(j)
        now /= now.sum(axis=2, keepdims=True)
        out[:, j] = now[:, 0, 1]
    now = right[1:, :, None]
    for j in range(width - 1, -1, -1):
        good_side = out[:, j] * now[:, 1, 0]
        out[:, j] = good_side / (good_side + (1 - out[:, j]) * now[:, 0, 0])
        now = steps(j) @ now
        now /= now.sum(axis=1, keepdims=True)
    return out.ravel()[:n]


def train(features: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> Field:
    """Maximum likelihood (Adam, full batch, weight decay); documents weigh alike, and so do the classes."""
    weights, links = np.zeros(features.shape[1]), np.zeros((2, 2))
    of_class = np.bincount(label, minlength=2)
    if not of_class.all():
        return Field(weights, links)
    document = np.repeat(np.arange(len(count)), count)
    share = 1 / (2 * of_class[label] * count)
    truth = label[document].astype(float)
    inner = (count - 1) * share
    seen = np.array([[inner[label == 0].sum(), 0], [0, inner[label == 1].sum()]])
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, steps + 1):
        p, pairs, _ = _forward_backward(features @ weights, links, count)
        slope = features.T @ ((p - truth) * share[document]) + decay * weights
        expected = pairs / max(1.0, pairs.sum()) * seen.sum()
        grad = np.r_[slope, (expected - seen).ravel() + 10 * decay * links.ravel()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, links = weights - move[:-4], links - move[-4:].reshape(2, 2)
        links = np.clip(links, -2, 2)  # lines of a document agree in the training labels always; do not let that drown the lines
    return Field(weights, links)


def _texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).fill_null(b"")


def _some_lines(text: bytes, key: int) -> bytes:
    """At most ``TRAIN_LINES`` neighbouring lines of a text."""
    cut = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    if len(cut) < TRAIN_LINES:
        return text
    first = key % (len(cut) + 2 - TRAIN_LINES)
    last = first + TRAIN_LINES - 1
    return text[int(cut[first - 1]) + 1 if first else 0 : int(cut[last]) if last < len(cut) else len(text)]


def _features_out(batch: pa.RecordBatch):
    column = _texts(batch, "text")
    for i in range(batch.num_rows):
        text = column[i].as_py()
        features = line_features([_some_lines(text, zlib.crc32(text))])[0]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([features.astype("<f4").tobytes()], pa.binary())], ["doc_id", "label", "features"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = TRAIN_DOCS, seed: str = "quality") -> Field:
    """Train on a bounded sample of the labelled documents; ``labels`` holds only rows that may be learnt from."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    key = F.crc32(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    picked = [known.where(f"label = {k}").orderBy(key, "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = docs.join(sample, "doc_id").select("doc_id", "label", "text")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = map_batches(chosen, _features_out, f"doc_id {kind}, label int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    if not rows:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, WIDTH) for r in rows]
    return train(np.vstack(parts), np.array([len(x) for x in parts]), np.array([r["label"] for r in rows]))


def _score(batch: pa.RecordBatch, text: str, field: Field) -> list[pa.Array]:
    texts = _texts(batch, text)
    out = []
    # one copy of a text at a time
    for a, b in by_size((len(v.as_buffer()) + LINE_BYTES * (1 + int(np.count_nonzero(np.frombuffer(v.as_buffer(), np.uint8) == 10))) for v in texts), BATCH_BYTES):
        part = texts.slice(a, b - a).to_pylist()
        if len(part) == 1 and part[0].count(b"\n") >= BLOCK_LINES:
            good, size = line_scores(part[0], field.weights)
            out.append(np.array([(long_marginals(good, field.links) * (size + 1)).sum() / (size + 1).sum()]))
            continue
        features, size, count = line_features(part)
        weight = size + 1
        ends = np.cumsum(count) - count
        good = np.add.reduceat(field.marginals(features, count) * weight, ends)
        out.append(good / np.add.reduceat(weight, ends))
    return [pa.array(np.clip(np.round(np.concatenate(out), 6), 0, 1))]


def score(df: DataFrame, field: Field, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` of every document with its quality from 0 to 1."""
    return add_columns(df.select(*dict.fromkeys([*keep, text_col])), _score, f"{out} double", keep, text_col, field)


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
