"""Fingerprints and their components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(marks):
    """The smallest id reachable from each (id, mark)."""
    label = list(range(len(marks)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(marks))]


def near_texts(seed, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def check(spark, rows):
    from roadflow.llm.simhash import near_copies

    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()
    marks = [(d, fingerprint(t)) for d, t in rows]
    want = sorted(((repr(d), t or "", f"{m:016x}", repr(c)) for (d, t), (_, m), c in zip(rows, marks, groups(marks))))
    assert sorted((repr(r["doc_id"]), r["text"] or "", r["fingerprint"], repr(r["component_id"])) for r in got) == want
    return got


def test_corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " \t\n", "one", "One  two", "one two", "one two three", "A b\x0bc d", "É é   x", "x" * 5000, "same " * 3000, "😀 b c"]
    check(spark, rows + [(10_000 + i, t) for i, t in enumerate(odd)])


def test_near_copies(spark):
    got = check(spark, list(enumerate(near_texts(1) + near_texts(2, 30) + ["a b c d"] * 20)))
    assert 2 < len({r["component_id"] for r in got}) < 90


def test_missing_and_repeated_ids(spark):
    check(spark, [(None, "alone here now"), (None, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (3, "else f g h"), (3, "else f g h"), (7, None), (9, "")])


def test_no_rows(spark):
    check(spark, [])


def test_blocks_of_words(monkeypatch):
    from roadflow.llm import simhash

    rng = random.Random(3)
    for size, votes in ((1, 1), (7, 5), (50, 64)):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        monkeypatch.setattr(simhash, "VOTES", votes)
        texts = ["".join(rng.choice("abC  \n") for _ in range(rng.randint(0, 200))) for _ in range(60)]
        assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def test_links_of_dense_fingerprints(spark):
    """Fingerprints a few bits apart: every pair within two bits is connected, and no link is longer."""
    from roadflow.llm.simhash import link_marks, near_members

    rng = np.random.default_rng(5)
    marks = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(60):
            marks.add(centre ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)))))
    marks = sorted(marks)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in link_marks(spark.createDataFrame([(m,) for m in signed], "mark long")).distinct().collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    label = {m: m for m in marks}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[root(a)] = root(b)
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root(a) == root(b)
    # a full list: links grow with its members, not with their pairs
    a, b = near_members(np.zeros(1 << 16, np.int64), np.arange(1 << 16))
    assert len(a) <= 17 << 16


def test_clashing_names(spark):
    from roadflow.llm.simhash import near_copies

    df = spark.createDataFrame([(1, "a b c", "x", 5)], "doc_id long, text string, fingerprint string, mark int")
    out = near_copies(df, ["doc_id", "fingerprint", "mark"])
    assert out.columns == ["doc_id", "kept_fingerprint", "mark", "fingerprint", "component_id"]
    assert out.first()["mark"] == 5
