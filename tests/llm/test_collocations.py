"""Collocations against a plain Python version on awkward texts, and against SQL."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top=2000, longest=4, inside=80):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {g: n for g, n in count.items() if len(g[1]) > 1 and n >= least}
    scored = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if any(g == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))) and 100 * n >= inside * a for (g, w), n in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        scored[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in scored.items():
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(n=150):
    rng = random.Random(6)
    words = ["a", "b", "c", "Éa", "éa", "d'or", "中文", "x y", "-", "😀"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "de", None, "und"]), t) for t in [*made, None, "", "...", " \t", "A a A a " * 300, "one " * 2, "w" * 3000 + " a b c a b c"]]


def run(spark, rows, **options):
    from roadflow.llm.collocations import collocations

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    return sorted(map(tuple, collocations(df, **options).collect()))


@pytest.mark.parametrize(("part", "bits"), [(64, 1 << 28), (1, 64)])
def test_against_plain_counts(spark, monkeypatch, part, bits):
    """Small parts cut long texts; a full table of bits lets everything through; the result stays."""
    from roadflow.llm import collocations

    monkeypatch.setattr(collocations, "PART_BYTES", part)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "LEAST_BITS", min(bits, 1 << 16))
    rows = texts(40 if part == 1 else 120)
    assert run(spark, rows, least=4) == by_hand(rows, 4)


def test_first_places(spark):
    rows = texts()
    assert run(spark, rows, least=4, top=7) == by_hand(rows, 4, 7)
    assert run(spark, rows, least=3, longest=2) == by_hand(rows, 3, longest=2)


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", ""), ("en", "few words here")]) == []


def test_spans():
    from roadflow.llm.collocations import spans

    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b"abc  .\n") for _ in range(rng.randint(0, 80)))
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^.,;:!?\x20\x09-\x0D]+", text)]
        seen = []
        for begin, own, end in spans(text, rng.randint(1, 20)):
            for i, (a, b) in enumerate(words):
                if begin <= a < own:
                    seen.append(a)
                    assert all(y <= end for _, y in words[i : i + 4])
        assert seen == [a for a, _ in words]


def test_products_past_64_bits(spark):
    from roadflow.llm.collocations import score_cuts

    big = 4_000_000_000_000_000_001
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big - 5)], "lang string, phrase string, n long")
    row = score_cuts([one, two]).first()
    assert (row["a"], row["l"], row["r"]) == (big - 5, big, big + 7)
    assert row["score"] == 2000000 * (big - 5) // (2 * big + 7)


def test_query_against_sql(spark):
    from roadflow.llm import registry

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op11_collocations"]).fetchall()
    assert sorted(map(tuple, registry.queries()["op11_collocations"](spark, SF).collect())) == sorted(want)
