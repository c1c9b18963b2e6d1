"""Near-duplicate documents: a Jaccard self-join of word shingles by prefixes under several global orders.

Documents with equal shingle sets form one class; only classes are compared.

1. *Which classes can have a partner at all.*  Under the first global order (by
   shingle hash) each class ships a prefix so long that a partner shares at
   least ``r`` shingles in it.  Shingles that no other class has in its prefix count for nothing;
   classes with fewer than ``r`` shared ones are gone.  A shingle that is shared inside
   one batch is settled there, so a hot one leaves a batch at most once.
2. The classes left are counted exactly: a shingle that a single class has can't be part of
   any intersection, so a class keeps its shared shingles only, and needs three
   quarters of its set among them.
3. *Candidates* share a shingle in their prefixes under the second order (rare first), and must share one under the third and the
   fourth order (two independent hashes) too, before the sets are intersected.
4. Groups of copies are not expanded into pairs.  In a round each prefix shingle
   compares its classes with a few pivots only, those whose shingles are the most
   common, that is, the ones closest to all others: one in the first rounds, then 16, 64, ...
   Classes that are connected
   already need no comparison, and neither do those with too few shingles left
   behind the common one for the smallest set in reach.  A pivot has met its whole group and leaves it, so the
   rounds end; only links that connect something are looked for, not all links of a component.

Defined results: a null, empty or blank text has no shingles, links with nothing and is its
own component; a text of fewer than five words is one shingle; repeated rows are copies of each
other; rows that repeat an id with another text are documents of their own that share the id; rows without an id link
like others, but give no class or component its id (null where a component has no other); an empty table gives an empty
table; a kept column that is named like an output is returned as ``kept_<name>``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, add_columns, by_bytes, kept_names, map_batches
from roadflow.llm.hashing import LOWER, hashed_words

WORDS = 5
#: Similarity as a fraction: 75 / 100.
NUM, DEN = 3, 4
BATCH_BYTES = 1 << 20
#: Rows up to which a table of classes is broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pivots of a group in each round; the last number grows fourfold from round to round.
PIVOTS = (1, 1, 16)

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (shift, multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_PLACE = _mix(np.arange(101, 101 + 64, dtype=_U)) | _U(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    joined = b" ".join(texts)
    data = LOWER[np.frombuffer(joined, np.uint8)]
    hashed, start = hashed_words(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, ends)
    n = len(hashed)
    whole = np.zeros(max(0, n - words + 1), _U)
    for j in range(words):
        whole += hashed[j : j + len(whole)] * _PLACE[j]
    whole = _mix(whole + _U(words))
    out, a = [], 0
    for b in cut.tolist():
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            out.append(_mix((hashed[a:b] * _PLACE[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
        a = b
    return out


def fingerprint(found: np.ndarray) -> int:
    """64 bits of a set, as a signed integer."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))).astype(np.int64))


def _sets(batch: pa.RecordBatch, text: str):
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"")
    for a, b in by_bytes(column, BATCH_BYTES):
        yield from shingle_sets(column.slice(a, b - a).to_pylist())


def _classes(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    rows = [(len(s), fingerprint(s)) for s in _sets(batch, text)]
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any partner: three quarters, rounded up."""
    return -(-NUM * n // DEN)


def _prefixes(batch: pa.RecordBatch, text: str):
    """Rows (token, class, weight, shared): what a batch can't settle alone, and for each class what it can, less what it needs."""
    sets: dict[int, np.ndarray] = {}
    for s in _sets(batch, text):
        if len(s):
            sets.setdefault(fingerprint(s), s)
    if not sets:
        return
    classes = np.array(list(sets), np.int64)
    n = np.array([len(s) for s in sets.values()])
    spare = np.maximum(1, -(-n // 10))
    size = np.minimum(n, n - least_overlap(n) + spare)
    need = np.maximum(1, -(-least_overlap(n) // 10))
    token = np.concatenate([s[:k] for s, k in zip(sets.values(), size)])
    owner = np.repeat(np.arange(len(n)), size)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    head = np.r_[True, token[1:] != token[:-1]]
    count = np.diff(np.r_[np.flatnonzero(head), len(token)])
    shared = np.repeat(count > 1, count)
    settled = np.bincount(owner[shared], minlength=len(n))
    send = head  # one row of each token
    key = np.r_[token[send], _mix(classes.view(_U) + _U(0x5851F42D4C957F2D))].view(np.int64)
    whose = np.r_[classes[owner[send]], classes]
    weight = np.r_[(~shared[send]).astype(np.int64), settled - need]
    known = np.r_[shared[send], np.ones(len(n), bool)]
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whose), pa.array(weight), pa.array(known)], ["token", "class", "weight", "shared"])


def _full_sets(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    found = list(_sets(batch, text))
    ends = np.cumsum([0] + [len(s) for s in found]).astype(np.int32)
    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([fingerprint(s) for s in found], pa.int64())]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, label): one label for each connected component; ``links`` has a and b.

    Contraction: each node moves to the smallest node among itself and its neighbours, links move along,
    and links inside one node vanish, until none is left.
    """
    edges = scratch.save(links.select("a", "b").where("a <> b").distinct())
    moved = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        step = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")))
        if moved is None:
            moved = step.select(F.col("a").alias("class"), F.col("to").alias("label"))
        else:
            moved = scratch.save(moved.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("class", F.coalesce("to", "label").alias("label")))
        ends = edges.join(step.select("a", F.col("to").alias("ta")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = scratch.save(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    return moved if moved is not None else edges.select(F.col("a").alias("class"), F.col("b").alias("label"))


def _can_pair(a: str, b: str):
    """Exact bounds for a pair that meets at its first common shingle: sizes within three quarters, and on either
    side enough shingles from there on (``m``; those before are not common)."""
    n1, n2 = F.col(f"{a}n"), F.col(f"{b}n")
    return (DEN * n1 >= NUM * n2) & (DEN * n2 >= NUM * n1) & ((NUM + DEN) * F.least(f"{a}m", f"{b}m") >= NUM * (n1 + n2))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, top) that share prefix shingles under the third and fourth order and are similar enough."""
    one = lambda c: sets.select(F.col("class").alias(c), *[F.col(x).alias(c + x) for x in ("n", "set", "third", "fourth")])
    full = pairs.join(one("a"), "a").join(one("b"), "b")
    near = full.where(F.arrays_overlap("athird", "bthird") & F.arrays_overlap("afourth", "bfourth"))
    return near.withColumn("both", F.size(F.array_intersect("aset", "bset"))).where(DEN * F.col("both") >= NUM * (F.col("an") + F.col("bn") - F.col("both"))).select("a", "b", "top")


def link_classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect whatever is connected; ``sets``: class, n, s, weight, set, prefix, third, fourth.

    Classes with one label are connected, so rows of a group with one label, rows without a possible partner in
    their group, and pivots, which have met their group, are gone for good.
    """
    rows = sets.select("class", "n", "s", "weight", F.posexplode("prefix").alias("at", "token"), F.col("class").alias("label"))
    rows = rows.select("class", "n", (F.col("s") - F.col("at")).alias("m"), "weight", "token", "label")
    links: list[DataFrame] = []
    turn, before = 0, []
    while True:
        most = PIVOTS[turn] if turn < len(PIVOTS) else PIVOTS[-1] * 4 ** (turn - len(PIVOTS) + 1)
        now = scratch.save(rows)
        scratch.drop(*before)
        group = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
        live = now.join(group.where("low <> high"), "token").where((NUM + DEN) * F.col("m") >= NUM * (F.col("n") + F.greatest("least", F.ceil(NUM * F.col("n") / DEN))))
        live = scratch.save(live.select("token", "class", "n", "m", "weight", "label"))
        scratch.drop(now)
        if links and not live.limit(1).count():
            break
        top = F.row_number().over(W.partitionBy("token").orderBy(F.desc("weight"), "class"))
        pivots = scratch.save(live.withColumn("nth", top).where(F.col("nth") <= most))
        pivot = pivots.select("token", F.col("weight").alias("rank"), F.col("class").alias("a"), F.col("n").alias("an"), F.col("m").alias("am"), F.col("label").alias("of"))
        pairs = live.select("token", F.col("class").alias("b"), F.col("n").alias("bn"), F.col("m").alias("bm"), "label").join(pivot, "token").where("label <> of").where(_can_pair("a", "b"))
        pairs = pairs.groupBy("a", "b").agg(F.max(F.struct("rank", "of")).alias("top"))
        found = scratch.save(_verify(pairs, sets))
        links.append(found.select("a", "b"))
        moved = found.groupBy(F.col("b").alias("class")).agg(F.max("top").alias("top")).select("class", F.col("top.of").alias("to"))
        rows = live.join(pivots.select("token", "class"), ["token", "class"], "left_anti").join(moved, "class", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        before, turn = [live, pivots], turn + 1
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def near_duplicates(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with n_shingles, class_id and component_id.

    class_id is the smallest id with the same shingle set, component_id the smallest id
    reachable by links; without shingles both are the document's own.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "jaccard")
    mine = [f"_{i}" for i in range(len(keep))]
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_version", F.xxhash64("_text"))
    meta = scratch.save(add_columns(plain, _classes, "n long, class long", [*mine, "_id", "_version"], "_text"))
    one_text = F.min(F.struct("_id", "_version"))
    classes = scratch.save(meta.where("n > 0").groupBy("class").agg(F.min("_id").alias("class_id"), F.first("n").alias("n"), one_text.alias("one")).select("class", "class_id", "n", "one.*"))

    token = W.partitionBy("token")
    sent = map_batches(plain.select("_text"), _prefixes, "token long, class long, weight long, shared boolean", "_text")
    judged = sent.select("class", "weight", (F.max("shared").over(token) | (F.min("class").over(token) != F.max("class").over(token))).alias("shared"))
    partnered = scratch.save(judged.where("shared").groupBy("class").agg(F.sum("weight").alias("w")).where("w >= 0").select("class"))

    chosen = classes.join(partnered, "class", "left_semi").select("class", F.col("_id").alias("cid"), F.col("_version").alias("cv"), "n")
    few = partnered.count() <= BROADCAST_ROWS
    chosen = scratch.save(chosen)
    one = F.broadcast(chosen) if few else chosen
    texts = plain.select("_id", "_version", "_text").join(one, F.col("_id").eqNullSafe(F.col("cid")) & (F.col("_version") == F.col("cv")))
    full = add_columns(texts, _full_sets, "set array<long>, found long", ["class", "n"], "_text")
    # one text of each class, known by its fingerprint
    full = full.where("found = class").select("class", "n", F.explode("set").alias("token"))
    counted = full.withColumn("df", F.count(F.lit(1)).over(token)).where("df > 1")
    listed = counted.groupBy("class", "n").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("by_df")).withColumn("s", F.size("by_df").cast("long"))
    listed = listed.where(DEN * F.col("s") >= NUM * F.col("n"))
    length = (F.col("s") - F.ceil(NUM * F.col("n") / DEN) + 1).cast("int")
    hashed = lambda seed: F.transform("by_df", lambda x: F.xxhash64(x["token"], F.lit(seed)))
    sets = scratch.save(listed.select(
        "class", "n", "s",
        (F.aggregate("by_df", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.col("n")).alias("weight"),
        F.transform("by_df", lambda x: x["token"]).alias("set"),
        F.transform(F.slice("by_df", F.lit(1), length), lambda x: x["token"]).alias("prefix"),
        F.slice(F.array_sort(hashed(1)), F.lit(1), length).alias("third"),
        F.slice(F.array_sort(hashed(2)), F.lit(1), length).alias("fourth"),
    ))
    links = link_classes(sets, scratch)
    label = components(links, scratch)
    scratch.drop(sets, chosen, partnered)
    named = classes.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    ids = scratch.save(named.join(lowest, "label").select("class", "class_id", "component_id"))
    out = meta.drop("_version").join(ids, "class", "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("_id")).alias(c)
    names = kept_names(keep, "n_shingles long, class_id long, component_id long")
    return out.select(*[F.col(m).alias(c) for m, c in zip(mine, names)], F.col("n").alias("n_shingles"), own("class_id"), own("component_id"))
