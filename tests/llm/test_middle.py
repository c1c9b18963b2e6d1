"""Infilling rearrangement against a plain Python version, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    units = [m.group() for m in UNITS.finditer(text)]
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    rng = random.Random(4)
    pieces = ["word", "é", "😀", " ", "  ", "\t", "\n", "\x0b", "\x1e", "\x1f", "\x1ec", "\x1ee", "c", "e", "<", "P", ">", "<P", "S>", " ", " ", "\x00", "$0", "\\"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*made, None, "", " ", "\n" * 5000, "one", " one ", "a<P>b", "<M>", "a " * 60_000, "x" * 200_000, " " * 200_000 + "y", "the same", "the same"]


def test_rearranged_and_restored(spark):
    from roadflow.llm.middle import rearrange, restore

    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (3, "an id twice"), (10**15, "large id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as source_text")
    got = restore(rearrange(df, ["doc_id", "source_text"])).collect()
    assert len(got) == len(rows)
    want = sorted((repr(d), t or "", *map(repr, by_hand(d, t))) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["source_text"] or "", *map(repr, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in got) == want
    assert all(r["restored"] == (r["source_text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seeds(spark):
    from roadflow.llm.middle import rearrange

    df = spark.createDataFrame([(i, "a b c d e f") for i in range(2000)], "doc_id long, text string")
    forms = [r["form"] for r in rearrange(df, ["doc_id"], seed=7, rate=30, suffix_first=50).collect()]
    assert 0.25 < 1 - forms.count("plain") / 2000 < 0.35
    assert 0.4 < forms.count("spm") / (2000 - forms.count("plain")) < 0.6
    assert all(r["form"] == "plain" for r in rearrange(df, ["doc_id"], rate=0).collect())


def test_empty_tables_and_clashing_names(spark):
    from roadflow.llm.middle import rearrange

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rearrange(empty, ["doc_id"]).collect() == []
    df = spark.createDataFrame([("a", "one two", 1, "f")], "doc_id string, text string, n int, form string")
    made = rearrange(df, ["doc_id", "n", "form", "text"])
    assert made.columns == ["doc_id", "kept_n", "kept_form", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.first()["n"] == 2


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_against_sql(spark, name):
    import duckdb

    from roadflow.llm import registry

    path = f"/root/testdata/{name}"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op13_middle"]).fetchall()
    got = registry.queries()["op13_middle"](spark, path).collect()
    assert sorted(map(tuple, got)) == sorted(want)
