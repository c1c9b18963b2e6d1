"""The training-data operators against brute force, libraries and round trips, on small inputs with awkward rows."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import os
import random
import re
import wave
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
#: Null, empty, blank, short, repeated, long, accented and odd texts.
ODD = [None, "", "   ", "one two", "one two", "a " * 3000, "x" * 5000, "Éa b̈ ﬃ İstanbul ΣΑΣ don't we'll 12a <|endoftext|> <|ENDOFTEXT|>", "tab\tline\r\nand  nbsp\u00a0ok\u2003em 中文 字", "😀😀 ok"]


def documents(spark, n=None):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:n]
    return rows + [(10_000 + i, t) for i, t in enumerate(ODD)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- tokens and packing ------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    from roadflow.llm.tokens import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts(spark, library):
    from roadflow.llm.tokens import token_counts

    rows = documents(spark)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(frame(spark, rows)).collect()}
    assert got == {d: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows}


def test_slices_keep_ids(library, monkeypatch):
    from roadflow.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_CHARS", 40)
    encoder = tokens.WordEncoder(tokens.tokenizer_path())
    rng = random.Random(5)
    letters = "abcé .,'<|>\n\tÀ1中̈😀"
    for text in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)] + [t or "" for t in ODD]:
        ids = np.frombuffer(b"".join(encoder.packed(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(tokens.slices(text)) == text


def test_packing(spark, library):
    from roadflow.llm.packing import pack

    rows = documents(spark)
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in pack(frame(spark, rows)).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    filled = sum(r["length"] for m in sequences.values() for r in m)
    assert filled > 0.97 * 2048 * (len(sequences) - 1)


def test_least_squares_fills_windows():
    from roadflow.llm.packing import pack_lengths

    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 5000)
    sequence, offset = pack_lengths(lengths)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and used.sum() / 2048 / len(used) > 0.99
    assert len({(s, o) for s, o in zip(sequence, offset)}) == len(lengths)


# --- near duplicates -----------------------------------------------------------


def _shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(rows):
    sets = {d: _shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                o = len(x & y)
                if 100 * o >= 75 * (len(x) + len(y) - o):
                    parent[find(a)] = find(b)
    low = {}
    for d in ids:
        low[find(d)] = min(low.get(find(d), d), d)
    return {d: (len(sets[d]), low[find(d)]) for d in ids}


def _copies(n, seed, size=120, most=12):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(size)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("case", ["corpus", "copies"])
def test_near_duplicates(spark, case):
    from roadflow.llm.jaccard import near_duplicates

    rows = documents(spark) if case == "corpus" else list(enumerate(_copies(60, 1) + _copies(25, 2, 40, 8) + _copies(8, 3, 8, 1) + ["a b c d e f g"] * 5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows), ["doc_id"]).collect()}
    assert got == _components(rows)


def test_near_duplicates_of_nothing(spark):
    from roadflow.llm.jaccard import near_duplicates

    assert near_duplicates(frame(spark, []), ["doc_id"]).collect() == []


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    from roadflow.llm.jaccard import near_duplicates

    rng = random.Random(21)
    words = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    a, b, c = words(), words(), words()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:30] + b[30:])), (7, " ".join(c)), (None, " ".join(c)), (None, " ".join([*c[:-1], "other"])), (None, "alone")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in near_duplicates(frame(spark, rows), ["doc_id"]).collect())
    assert got == [(0, 1, 0), (0, 56, 7), (0, 56, 7), (1, 56, 1), (1, 56, 1), (2, 56, 2), (7, 56, 7)]


def test_near_duplicates_near_the_threshold(spark, monkeypatch):
    """A group that shares most of its words and links in places only: pivot rounds go on until nothing is open."""
    from roadflow.llm import jaccard

    monkeypatch.setattr(jaccard, "PIVOTS", (1, 2))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(70):
        words = list(base)
        at = rng.randrange(0, 88)
        words[at : at + 12] = [f"v{rng.randint(0, 3)}_{at}_{k}" for k in range(12)]
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows), ["doc_id"]).collect()}
    assert got == _components(rows) and len({c for _, c in got.values()}) > 5


def _alternating(size):
    """Two different words of letters a and b (Thue and Morse) whose sums of letters times powers are equal modulo 2**64 for every odd base."""
    x = "a"
    while len(x) < size:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [512, 4096])
def test_different_words_have_different_hashes(spark, size):
    from roadflow.llm.decontamination import find_contamination
    from roadflow.llm.jaccard import near_duplicates

    x, y = _alternating(size)
    got = near_duplicates(frame(spark, [(1, f"one two {x} four five six"), (2, f"one two {y} four five six")]), ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["component_id"], r["class_id"]) for r in got) == [(1, 1, 1), (2, 2, 2)]
    items = spark.createDataFrame([("i", x)], "item_id string, text string")
    found = find_contamination(frame(spark, [(1, f"one {x}"), (2, f"one {y}")]), items, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["n_hit"]) for r in found) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_word_hashes(monkeypatch, block):
    from roadflow.llm import hashing

    monkeypatch.setattr(hashing, "BLOCK", block)
    rng, known = random.Random(block), {}
    for _ in range(60):
        text = bytes(rng.choice(b"abc  \n") for _ in range(rng.choice([0, 1, 5, 300]))) + rng.choice([b"", b" ", b"q" * rng.randint(1, 200)])
        value, start = hashing.hashed_words(np.frombuffer(text, np.uint8))
        words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        assert start.tolist() == [a for a, _ in words]
        assert all(known.setdefault(w, v) == v for v, (_, w) in zip(value.tolist(), words))
    assert len(set(known.values())) == len(known)
    for size in (8, 16, 32, 64, 512, 1024, 2048, 4096):
        x, y = _alternating(size)
        assert len(set(hashing.hashed_words(np.frombuffer(f"{x} {y}".encode(), np.uint8))[0].tolist())) == 2


# --- repeats ---------------------------------------------------------------------


def test_repeats_with_text_ids(spark):
    from roadflow.llm.repeats import remove_repeats

    words = "".join(random.Random(2).choice("abcdef ") for _ in range(90))
    rows = [("b2", words), ("a1", "x" + words), ("c3", words[:49]), (None, words), ("b2", "0" + words + "1")]
    got = sorted((r["doc_id"] or "", r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), ["doc_id"]).collect())
    assert got == [("", 90, 0), ("a1", 91, 0), ("b2", 90, 90), ("b2", 92, 90), ("c3", 49, 0)]


def test_repeats(spark):
    from roadflow.llm.repeats import remove_repeats

    rng = random.Random(9)
    shared = "".join(rng.choice("abcdef ") for _ in range(170))
    made = [(20_000 + i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + shared[rng.randint(0, 60) : rng.randint(100, 170)] + "é" * rng.randint(0, 70)) for i in range(30)]
    rows = documents(spark) + made + [(30_000, made[3][1]), (30_001, "ab" * 400), (30_002, "ab" * 30)]
    rows += [(30_003, (shared + "0") * 40), (30_004, "x" + shared[:49] + "y" + shared[:50]), (30_005, "é" * 70_000 + shared)]
    got = {r["doc_id"]: r for r in remove_repeats(frame(spark, rows), ["doc_id"], with_text=True).collect()}
    seen = set()
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark, windows = np.zeros(len(b), bool), [b[i : i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                mark[i : i + 50] = True
        seen.update(windows)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r["kept_text"] == kept.decode("utf-8", "ignore")


def test_repeats_of_no_rows_and_of_clashing_names(spark):
    from roadflow.llm.repeats import remove_repeats

    assert remove_repeats(frame(spark, []), ["doc_id"]).collect() == []
    rows = [(2, "a long sentence that is repeated in another document " * 2, 7), (None, "a long sentence that is repeated in another document " * 2, 8), (1, "so: a long sentence that is repeated in another document ", 9)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"), ["doc_id", "n_bytes"])
    assert found.columns == ["doc_id", "kept_n_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((r["kept_n_bytes"], r["n_removed"]) for r in found.collect()) == [(7, 106), (8, 0), (9, 0)]


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_repeats_of_copies_in_any_order(spark, order):
    from roadflow.llm.repeats import remove_repeats

    rng = random.Random(12)
    passage = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    early, late = passage(80), passage(80)
    copied = passage(60) + early + passage(60) + late + passage(60)
    rows = [(1, passage(70) + early + passage(70)), (9, passage(70) + late + passage(70))] + [(d, copied) for d in (5, 7, 150, 151)]
    rows.sort(key=lambda r: -r[0])
    if order == "shuffled":
        rng.shuffle(rows)
        rows.sort(key=lambda r: r[0] == 5)  # after one of its copies
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame(spark, rows).coalesce(1), ["doc_id"]).collect()}
    seen = set()
    for d, t in sorted(rows):
        mark, windows = np.zeros(len(t), bool), [t[i : i + 50] for i in range(len(t) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                mark[i : i + 50] = True
        seen.update(windows)
        kept = "".join(x for x, m in zip(t, mark) if not m)
        assert got[d] == (mark.sum(), (np.diff(np.r_[0, mark.astype(int)]) == 1).sum(), hashlib.sha256(kept.encode()).hexdigest())


# --- quality ------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    from roadflow.llm.registry import op4_quality

    sf = "/root/testdata/sf0.01"
    marked = op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in marked]) > 0.93


def test_forward_backward_against_enumeration():
    import itertools

    from roadflow.llm.quality import _forward_backward

    rng = np.random.default_rng(0)
    good, links, count = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([3, 1, 3])
    p, _, total = _forward_backward(good, links, count)
    want, logz, at = [], 0.0, 0
    for n in count:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(good[at + i] * y for i, y in enumerate(path)) + sum(links[a, b] for a, b in zip(path, path[1:])) for path in paths])
        want += [w[[path[i] == 1 for path in paths]].sum() / w.sum() for i in range(n)]
        logz, at = logz + np.log(w.sum()), at + n
    assert np.allclose(p, want) and np.isclose(total, logz)


def test_quality_by_hand(spark):
    """The score of a document from plain loops over lines, characters and labels."""
    import itertools
    import math

    from roadflow.llm import quality

    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(0, 0.5, quality.WIDTH), np.array([[0.4, -0.3], [-0.6, 0.7]]))

    def own(lines, i):
        x = lines[i].encode()
        kinds = [("a" <= chr(c) <= "z", "A" <= chr(c) <= "Z", chr(c) in "0123456789", chr(c) in " \t", chr(c) in ".,;:?'\"()-", c == 33, chr(c) in "|/\\_<>=~") for c in x]
        n = [sum(k[j] for k in kinds) for j in range(7)]
        plain = sum(33 <= c < 127 and not any(k) for c, k in zip(x, kinds))
        wide = sum(c >= 128 for c in x)
        words, parts = n[3] + 1, x.split()
        fresh = len(set(parts)) / len(parts) if parts else 1
        return [*(v / max(1, len(x)) for v in [*n, plain, wide]), math.log1p(len(x)) / 6, min(len(x) / words, 40) / 10, n[1] / max(1, n[0] + n[1] + wide), (n[5] + n[6] + plain) / words, n[4] / words, len(x) > 0 and lines[i] in lines[:i], len(x) == 0, 1 - fresh, fresh < 0.5]

    def score(text):
        lines = (text or "").split("\n")
        f = [own(lines, i) for i in range(len(lines))]
        none = [0] * quality.OWN
        good = [float(np.dot(f[i] + (f[i - 1] if i else none) + (f[i + 1] if i + 1 < len(f) else none) + [1, i == 0, i == len(f) - 1], field.weights)) for i in range(len(f))]
        paths = list(itertools.product((0, 1), repeat=len(lines)))
        w = np.exp([sum(g * y for g, y in zip(good, p)) + sum(field.links[a, b] for a, b in zip(p, p[1:])) for p in paths])
        p = [w[[x[i] == 1 for x in paths]].sum() / w.sum() for i in range(len(lines))]
        weight = [len(x.encode()) + 1 for x in lines]
        return float(np.dot(p, weight) / sum(weight))

    rows = [r for r in documents(spark) if (r[1] or "").count("\n") < 9] + [(7, "One two\n\nONE, two! 3|4 é\nOne two\nx x x x"), (8, "\n"), (9, "a\n" * 7)]
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(frame(spark, rows), field, ["doc_id", "text"]).collect()}
    assert len(got) == len(rows) and all(abs(got[d, t] - score(t)) < 2e-6 for d, t in rows)


def test_quality_of_many_lines(spark, monkeypatch):
    import time

    import pyarrow as pa

    from roadflow.llm import quality

    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(0, 0.5, quality.WIDTH), np.array([[0.4, -0.3], [-0.6, 0.7]]))
    for n in (1, 2, 5, 90):
        good = rng.normal(size=n)
        assert np.allclose(quality.long_marginals(good, field.links), quality._forward_backward(good, field.links, np.array([n]))[0])
    texts = ["\n".join(rng.choice(["", "a b", "A! 1", "é", "a b c " * 9]) for _ in range(int(rng.integers(1, 60)))) for _ in range(40)]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x)], ["text"])
    want = quality._score(batch(texts), "text", field)[0].to_pylist()
    with monkeypatch.context() as m:
        m.setattr(quality, "BLOCK_LINES", 3)
        m.setattr(quality, "BATCH_BYTES", 1)
        assert np.allclose(quality._score(batch(texts), "text", field)[0].to_pylist(), want, atol=2e-6)
        m.setattr(quality, "TRAIN_LINES", 5)
        for t in texts:
            some = quality._some_lines(t.encode(), 12345).decode()
            assert f"\n{some}\n" in f"\n{t}\n" and len(some.split("\n")) == min(5, len(t.split("\n")))
    began = time.time()
    assert 0 <= quality._score(batch(["\n" * 10_000_000]), "text", field)[0][0].as_py() <= 1
    assert time.time() - began < 120


def test_quality_of_odd_texts(spark):
    from roadflow.llm.quality import WIDTH, Field, score

    field = Field(np.linspace(-1, 1, WIDTH), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    rows = score(frame(spark, [(i, t) for i, t in enumerate(ODD)]), field, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[0] == by[1] and by[3] == by[4]


# --- language model ---------------------------------------------------------------------


def _network(leaves=8, buckets=1 << 14, seed=2):
    from roadflow.llm import lm

    rng = np.random.default_rng(seed)
    network = lm.Network(*lm.tree_of(rng.integers(0, 50, buckets), leaves), leaves)
    network.out[:], network.bias[:] = rng.normal(size=network.out.shape), rng.normal(size=leaves)
    return network


def test_network_learns(spark):
    from roadflow.llm import lm

    docs = frame(spark, documents(spark, 150)).repartition(2)
    trained = lm.fit(docs)
    plain = lm.Network(trained.leaf, trained.share, trained.leaves)
    found = {r["doc_id"]: r for r in lm.score(docs, trained, ["doc_id"]).collect()}
    total = lambda net: sum(r["log_likelihood"] for r in lm.score(docs, net, ["doc_id"]).collect())
    words = sum(r["n_words"] for r in found.values())
    assert total(trained) > total(plain) + 0.1 * words
    assert found[10_000]["n_words"] == 0 and found[10_000]["log_likelihood"] == 0
    clash = spark.createDataFrame([("a b", 1)], "text string, n_words int")
    assert lm.score(clash, trained, ["n_words"]).columns == ["kept_n_words", "n_words", "log_likelihood", "mean_log_likelihood"]


def test_network_counts_every_word_once(spark):
    from roadflow.llm import lm

    rows = documents(spark, 120)
    texts = frame(spark, rows).select("text").repartition(5)
    counts = lm.gathered(texts, lm._counter("text", 1 << 14), "<i8", False, lm.Scratch(spark, "test"))
    want = np.zeros(1 << 14, int)
    for _, t in rows:
        np.add.at(want, lm._words([(t or "").encode()])[0] >> 6, 1)
    assert counts.tolist() == want.tolist() and counts.sum() > 1000
    assert lm.gathered(texts.limit(0), lm._counter("text", 1 << 14), "<i8", False, lm.Scratch(spark, "test")) is None


def test_network_scores_by_hand():
    import math

    from roadflow.llm import lm

    network = _network()
    word, count = lm._words([b"one two three one", b"", b"two"])
    got = network.log_probability(word, count)
    texts, at = [[0, 1, 2, 3], [4]], 0
    for text in texts:
        for i in text:
            h = np.zeros(lm.WIDTH)
            for k, step in enumerate((-2, -1, 1, 2)):
                near = word[i + step] >> 6 if i + step in text else lm.INPUTS
                h += network.embed[near].astype(float) * network.place[k]
            h = np.tanh(h)
            share = {}
            for leaf in range(8):
                p, node = 1.0, 1
                for bit in (leaf >> 2, leaf >> 1 & 1, leaf & 1):
                    right = 1 / (1 + math.exp(-(h @ network.out[node] + network.bias[node])))
                    p, node = p * (right if bit else 1 - right), 2 * node + bit
                share[leaf] = p
            assert abs(sum(share.values()) - 1) < 1e-9
            bucket = word[i] >> 6
            assert abs(got[at] - math.log(share[int(network.leaf[bucket])]) - network.share[bucket]) < 1e-4
            at += 1
    assert np.allclose(np.bincount(network.leaf, np.exp(network.share.astype(float))), 1, atol=1e-4)


@pytest.mark.parametrize("top", [1, 6])
def test_network_slopes_against_differences(monkeypatch, top):
    from roadflow.llm import lm

    monkeypatch.setattr(lm, "TOP", top)
    network = _network()
    rng = np.random.default_rng(5)
    word, count = rng.integers(0, 1 << 20, 40).astype(np.int32), np.array([25, 15])
    for name in ("embed", "place", "out", "bias"):
        setattr(network, name, getattr(network, name).astype(float))
    nodes, cells, place = network.slopes(lm.contexts(word, count, np.arange(40)), word)
    want = {"embed": np.zeros_like(network.embed), "place": place, "out": np.zeros_like(network.out), "bias": np.zeros_like(network.bias)}
    want["embed"][:] = cells[0]
    for at, out, bias, n in nodes:
        want["out"][at], want["bias"][at] = out, bias
    assert sum(n.sum() for _, _, _, n in nodes) == 40 * 3 and cells[1].sum() == 40 * 4
    for name, slope in want.items():
        flat = getattr(network, name).reshape(-1)
        places = np.flatnonzero(slope.reshape(-1))[:: max(1, np.count_nonzero(slope) // 25)]
        for i in places:
            old, d = flat[i], 1e-5
            flat[i] = old + d
            up = network.log_probability(word, count).sum()
            flat[i] = old - d
            down = network.log_probability(word, count).sum()
            flat[i] = old
            assert abs((up - down) / (2 * d) - slope.reshape(-1)[i]) < 1e-3


def test_network_trains_on_every_word(monkeypatch):
    import pyarrow as pa

    from roadflow.llm import lm

    texts = ["one two", "", None, "three", " ".join(f"w{i}" for i in range(7000)), "four five six"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    network, seen = _network(), []
    monkeypatch.setattr(lm.Network, "step", lambda self, context, word: seen.append(np.c_[context, word]))
    told = [b["seen"][0].as_py() for turn in range(lm.ROUNDS) for b in lm._trainer("text", network, turn, lm.ROUNDS)(iter([batch, batch.slice(0, 0)]))]
    word, count = next(lm._parts(batch, "text"))
    want = np.c_[lm.contexts(word, count, np.arange(len(word))), word]
    assert sum(told) == len(word) == 7006
    assert sorted(np.concatenate(seen).tolist()) == sorted(want.tolist())


# --- media -----------------------------------------------------------------------------------


def test_media(spark):
    from roadflow.llm import media

    rows = documents(spark, 60)
    for r in media.store_documents(frame(spark, rows), ["doc_id"]).collect():
        text = (dict(rows)[r["doc_id"]] or "").encode()
        payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[: len(text)] == text
        stored = media.store(payload)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(text), len(payload), zlib.crc32(payload[-32:]), len(stored))


def test_sniffing(spark):
    from roadflow.llm import media

    sound, packed = media.store(b"abc"), gzip.compress(b"hello" * 9)
    lead = b"BM GIF89a \xff\xd8\xff RIFF"
    blob = lead + packed + b"--" + sound + b"tail"
    assert [(a, n, k) for a, n, k in media.sniff(blob)] == [(len(lead), len(packed), "application/gzip"), (len(lead) + len(packed) + 2, len(sound), "audio/wav")]
    df = spark.createDataFrame([(1, bytearray(sound), "image/png"), (2, bytearray(blob), "text/plain"), (3, None, "image/png"), (4, bytearray(b""), "image/png"), (5, bytearray(sound[:-1]), "audio/wav")], "id int, v binary, says string")
    got = {r["id"]: r for r in media.sniff_media(df, ["id"], "v", "says").collect()}
    assert [got[i]["media_type"] for i in (1, 2, 3, 4, 5)] == ["audio/wav", "text/plain", None, media.UNKNOWN, media.UNKNOWN]
    assert [bytes(c["content"]) for c in got[2]["carved"]] == [packed, sound]


def _media():
    """One small sound medium of each type."""
    import struct
    import zipfile

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04" + bytes(4) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">H", 5) + b"abc" + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"data" + b"\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    flac = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + b"\xff\xf8" + b"frames"
    return {"image/png": png, "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "application/zip": packed.getvalue(), "application/pdf": pdf, "application/gzip": gzip.compress(b"x" * 99), "audio/flac": flac}


def test_every_validator():
    from roadflow.llm import media

    sounds = {**_media(), "audio/wav": media.store(b"abcd")}
    assert set(sounds) == set(media.VALIDATORS)
    for kind, sound in sounds.items():
        assert media.sniff(sound) == [(0, len(sound), kind)]
        tail = b"" if kind == "audio/flac" else b" tail"  # its length is all that follows
        assert media.sniff(b"lead " + sound + tail)[0] == (5, len(sound), kind)
        for cut in range(len(sound)):
            assert not any(k == kind and n > cut for _, n, k in media.sniff(sound[:cut]))
        if kind not in ("audio/flac",):
            assert (0, len(sound), kind) not in media.sniff(sound[:-1])
    rest = [x for k, x in sounds.items() if k != "audio/flac"]
    assert [n for _, n, _ in media.sniff(b"--".join(rest))] == [len(x) for x in rest]


@pytest.mark.parametrize("magic", [b"%PDF-", b"PK\x03\x04", b"GIF89aaaaa\x00aa!a", b"\x1f\x8b\x08\x00", b"\xff\xd8\xff\xc0\x00\x02\xff\xda\x00\x02", b"BM", b"RIFF"])
def test_many_magics_take_linear_time(magic):
    import time

    from roadflow.llm import media

    took = []
    for size in (500_000, 4_000_000):
        value = magic * (size // len(magic))
        began = time.process_time()
        assert media.sniff(value) == []
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 2


# --- decontamination -----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16 << 20, 2000])
def test_decontamination(spark, monkeypatch, block):
    from roadflow.llm import decontamination as dc

    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Short One"), (901, None), (902, ""), (903, "short one")]
    rows = documents(spark) + [(40_000, "x short-ONE y short one"), (40_001, "short"), (40_002, "one")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    found = dc.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    got = {r["doc_id"]: r for r in found.collect()}
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(names))
        assert {x for s in r["spans"] for x in range(s["from"], s["to"])} == hit


def test_proximity(spark):
    from roadflow.llm.decontamination import Phrases, Segment, find_contamination, search

    rng = random.Random(3)
    letters = "abcdefgh"
    texts = [[rng.choice(letters) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))) for i in range(30)]
    segment = Segment.unpacked(*Segment.of([" ".join(t).encode() for t in texts]).packed())
    phrases = Phrases(items, 4)
    phrases.rank_by(np.array([sum(t.count(x) for t in texts) for x in sorted(letters, key=lambda x: phrases.terms.tolist().index(int(Phrases([("0", x)]).terms[0])))]))
    for words, (exact, near, spans) in zip(texts, search(segment, phrases, 5)):
        want, close, hit = set(), set(), set()
        for name, text in items:
            own = text.split()
            for k in range(max(1, len(own) - 3)):
                w = own[k : k + 4]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        want.add(name)
                        hit |= set(range(p, p + len(w)))
                lead = min(w, key=lambda x: (sum(t.count(x) for t in texts)))
                if any(x == lead and set(w) <= set(words[max(0, p - 5) : p + 6]) for p, x in enumerate(words)):
                    close.add(name)
        assert exact == sorted(want) and near == sorted(close)
        assert {x for s in spans for x in range(s["from"], s["to"])} == hit
    docs = frame(spark, [(1, "alpha one beta"), (2, "alpha " + "x " * 21 + "beta"), (3, None), (4, "Beta, ALPHA"), (4, "Beta, ALPHA")])
    items = spark.createDataFrame([(5, "alpha beta"), (None, "beta alpha")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_hit"], r["items"], r["near_items"]) for r in find_contamination(docs, items, ["doc_id"]).collect())
    assert got == [(1, 0, [], ["5"]), (2, 0, [], []), (3, 0, [], []), (4, 2, [], ["5"]), (4, 2, [], ["5"])]


# --- urls --------------------------------------------------------------------------------------------


def test_urls(spark):
    from roadflow.llm.urls import filter_urls

    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Example.COM/en/x?a"), (4, "http://www.example.com/en/"), (5, "http://a.www.EXAMPLE.com/en/1#t"), (6, "https://x.net/es/1"), (7, "https://xnet/es/1"), (8, "http://com"), (9, "http://notexample.com/en/"), (10, "a://b://c.com/d"), (11, "http://ads.banner-click.test/promo/casino"), (12, "http://www.library.test/en/guide/12"), (13, "://")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(rows, "page_id int, url string"), ["page_id"]).collect()}
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[4][2:] == got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2] is None
    assert got[8][:3] == ("com", "", None) and got[9][2:] == ("com/", "allow")
    assert got[10][:3] == ("b:", "//c.com/d", None)
    assert got[1][:3] == got[2][:3] == got[13][:3] == ("", "", None)
    assert got[11][3] == "block" and got[12][3] == "allow"


# --- personal data -----------------------------------------------------------------------------------------


def _base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]


def test_personal_data(spark):
    from roadflow.llm import pii

    rng = random.Random(4)
    hard = ["a@b.c_d@e.f+1 (234) 555-7777", "1.2.3.4.5.6.7.8 001.255.0.256 999.1.1.1 0000001.2.3.4", "4041894974608795 4041-8949-7460-8795 12 4041894974608796", "😀é a.b@c-d.e.f@g.h 😀 10.0.0.1😀", "+12345678 +1 2 3 +123456789012345678 +1+12345678", "5 4041894974608795", "x" * 9000 + "@", "1 " * 3000, "."]
    hard += ["".join(rng.choice("a1.@+- (_4é") for _ in range(200)) for _ in range(120)]
    rows = documents(spark) + [(50_000 + i, t) for i, t in enumerate(hard)]
    for r in pii.find(frame(spark, rows), ["doc_id"]).collect():
        want = _base(dict(rows)[r["doc_id"]] or "")
        assert [tuple(x) for x in r["base"]] == want
        assert set(want) <= {tuple(x) for x in r["spans"]}


def test_added_spans_and_redaction(spark):
    from roadflow.llm import pii

    rows = [(1, "mail me anna (at) mail3 (dot) example (dot) com ok"), (2, "on 2024-10-12 we met"), (3, "at a.b@c.de or 10.0.0.1."), (4, None)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(frame(spark, rows), ["doc_id"]).collect()}
    assert got[1] == [("email", 8, 47)] and got[2] == [] and got[4] == []
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert text == {1: "mail me [EMAIL] ok", 2: rows[1][1], 3: "at [EMAIL] or [IP].", 4: None}


def test_very_many_addresses(spark):
    from roadflow.llm import pii

    texts = ["".join(f"u{i}@host.org " for i in range(n)) + "call 020 555 1234 now " * (n // 4) for n in (40, 3000, 100_000)]
    rows = pii.redact(frame(spark, list(enumerate(texts)))).collect()
    for text, row in zip(texts, sorted(rows, key=lambda r: r["doc_id"])):
        assert row["text"].count("[EMAIL]") == text.count("@") and "@" not in row["text"]
        assert row["text"].count("now") == text.count("now")
    few = pii.find(frame(spark, list(enumerate(texts[:2]))), ["doc_id"]).collect()
    for row in few:
        assert [tuple(x) for x in row["base"]] == _base(texts[row["doc_id"]])
        spans = sorted((x["start"], x["end"]) for x in row["spans"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


# --- all together --------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    from roadflow.llm.common import Scratch

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == cp.COLUMNS
            assert {r["doc_id"] for r in docs.collect()} <= set(before)
        if name == "near_duplicates":
            comp = _components([(d, t) for d, t in before.items()])
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in comp.values()}
        if name == "personal_data":
            assert docs.count() == len(before)
            assert not any(_base(r["text"]) for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} == set(before)


def test_near_duplicates_stage_with_odd_ids(spark):
    import corpus_pipeline as cp

    words = lambda seed: " ".join(f"w{random.Random(seed).randint(0, 10**6) + i}" for i in range(40))
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (2, b), (2, a), (3, b), (None, b), (None, c), (4, None), (5, ""), (6, c + " x"), (6, c + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in cp.near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(1, a), (2, b), (4, ""), (5, ""), (6, c + " x"), (6, c + " x")])


@pytest.mark.parametrize("name", ["op1_packing", "op2_repeats", "op3_jaccard", "op4_quality", "op5_lm_score", "op6_token_counts", "op7_media", "op8_decontamination", "op9_url_filter", "op10_pii", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    import __spark_entry__ as entry

    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).count() == 0


def test_kept_columns_named_like_outputs(spark):
    """Every operator returns a kept column that is named like one of its outputs as kept_<name>, with its values."""
    from roadflow.llm import decontamination, jaccard, lm, media, pii, quality, repeats, urls

    df = spark.createDataFrame([(1, "a b c d e f g", None), (2, None, "http://a.b/c")], "doc_id long, text string, url string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    network = lm.Network(*lm.tree_of(np.ones(1 << 14), 4), 4)
    calls = {
        "n_bytes": lambda d, k: repeats.remove_repeats(d, k),
        "component_id": lambda d, k: jaccard.near_duplicates(d, k),
        "score": lambda d, k: quality.score(d, quality.Field(np.zeros(quality.WIDTH), np.zeros((2, 2))), k),
        "n_words": lambda d, k: lm.score(d, network, k),
        "feature": lambda d, k: media.store_documents(d, k),
        "n_hit": lambda d, k: decontamination.find_contamination(d, items, k),
        "host": lambda d, k: urls.filter_urls(d, k),
        "base": lambda d, k: pii.find(d, k),
    }
    for name, call in calls.items():
        clash = df.selectExpr("doc_id", "text", "url", f"'own' || doc_id as `{name}`", "'q' as _0", "'r' as _text")
        got = call(clash, ["doc_id", name, "_0"])
        assert got.columns[:3] == ["doc_id", f"kept_{name}", "_0"] and got.columns.count(name) == 1
        assert sorted((r["doc_id"], r[f"kept_{name}"], r["_0"]) for r in got.collect()) == [(1, "own1", "q"), (2, "own2", "q")]
    clash = df.selectExpr("doc_id", "text", "'x' as base", "'y' as spans", "'z' as _text")
    assert sorted(map(tuple, pii.redact(clash).collect()), key=str) == [(1, "a b c d e f g", "x", "y", "z"), (2, None, "x", "y", "z")]


def test_text_ids(spark):
    from roadflow.llm.packing import pack
    from roadflow.llm.tokens import token_counts

    df = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["length"]) for r in pack(df).collect()) == [("", 1), ("a", 3), ("a", 3)]
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in token_counts(df).collect()) == [("", 0), ("a", 2), ("a", 2)]


def test_clashing_columns(spark):
    from roadflow.llm.decontamination import find_contamination
    from roadflow.llm.jaccard import near_duplicates
    from roadflow.llm.pii import find

    df = frame(spark, [(1, "a b c d e f g"), (2, None)]).selectExpr("doc_id", "text", "1 as base_x", "'q' as class", "2 as token", "3 as n", "4 as g", "5 as m")
    keep = ["doc_id", "class", "token", "n", "g", "m"]
    assert near_duplicates(df, keep).columns[: len(keep)] == keep
    assert find(df, keep).columns[: len(keep)] == keep
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(df, items, keep).count() == 2
