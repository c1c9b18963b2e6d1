"""Fill-in-the-middle: texts rearranged as prefix, suffix and middle between sentinel markers, in columns only.

1. *Escape.*  A delimiter that no unit may contain is freed: the escape character and the delimiter are
   replaced by two characters each where a text has them.  None of them is white space, so units stay as they are.
2. *Inject and count.*  ``regexp_replace`` appends the delimiter to each unit; the number of delimiters is the number of units.
3. *Cut.*  ``substring_index`` takes what stands before the i-th delimiter; delimiters go, escapes are undone.
4. *Assemble.*  Markers and parts are joined.  A marker begins with a character that it holds once, so in a text without markers
   it is found again where it was put, and ``restore`` gives the exact text back.

A unit is a run of white space with the word behind it, or white space at the end of a text.  Cuts and form depend on the id and
a seed alone, so a row that is computed again, or repeated, gives the same output.

Defined results: a null text is an empty one, which is plain, with no units; a text that holds a marker is plain; a null id is
hashed as the word ``null``; prefix_chars and middle_chars are null for plain texts; an empty table gives an empty one; other
columns are kept if they are asked for, those named like an output as ``kept_<name>``.  Texts are cut whole, of any length that a
value of Spark may have; the pattern never backtracks over what it has taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import kept_names

SEED = 42
#: Percent of texts that are rearranged, and of those the share with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The unit: white space is space, tab, line feed, vertical tab, form feed, carriage return.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The delimiter, the escape character, and what stands for either.
CUT, ESCAPE = "\x1f", "\x1e"
ESCAPED_CUT, ESCAPED_ESCAPE = ESCAPE + "c", ESCAPE + "e"

FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(CUT), F.lit(ESCAPED_CUT))


def _plain(part: Column) -> Column:
    """A part without delimiters, and its escapes undone: the delimiter's first, as no escape character follows another."""
    joined = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(joined, F.lit(ESCAPED_CUT), F.lit(CUT)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def numbers(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns ``keep`` of every row with n (units), form (plain, psm, spm), prefix_chars, middle_chars and output."""
    mine = [f"_k{i}" for i in range(len(keep))]
    h = numbers(F.col(id_col), seed)
    rows = df.select(
        *[F.col(c).alias(m) for c, m in zip(keep, mine)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[x.alias(f"_h{i}") for i, x in enumerate(h, 1)]
    )
    # each step is a projection of its own, so no long text is made twice
    marked = rows.withColumn("_marked", F.regexp_replace(_escaped(F.col("_text")), F.lit(UNIT), F.lit("$0" + CUT)))
    counted = marked.withColumn("n", (F.octet_length("_marked") - F.octet_length(F.replace("_marked", F.lit(CUT), F.lit("")))).cast("long"))
    cuts = counted.withColumns({"_i": F.expr("_h1 % (n + 1)"), "_j": F.expr("_h2 % (n + 1)")})
    has_marker = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when((F.col("_text") == "") | has_marker | (F.col("_h3") % 100 >= rate), "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm")
    formed = cuts.withColumn("form", form)
    # up to the smaller and up to the larger cut, still marked
    upto = lambda k: F.expr(f"substring_index(_marked, '{CUT}', cast({k} as int))")
    apart = formed.withColumns({"_one": F.when(F.col("form") != "plain", upto("least(_i, _j)")), "_two": F.when(F.col("form") != "plain", upto("greatest(_i, _j)"))})
    parts = apart.withColumns({
        "_prefix": _plain(F.col("_one")),
        "_middle": _plain(F.expr("substring(_two, length(_one) + 1)")),
        "_suffix": _plain(F.expr("substring(_marked, length(_two) + 1)")),
    })
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle"))
    output = output.otherwise(F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle"))
    names = kept_names(keep, FIELDS)
    return parts.select(
        *[F.col(m).alias(c) for c, m in zip(names, mine)], "n", "form",
        F.length("_prefix").cast("long").alias("prefix_chars"), F.length("_middle").cast("long").alias("middle_chars"), output.alias("output"),
    )


def restore(df: DataFrame, out: str = "restored", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The frame with the text that an output was made from, by its form alone."""
    first, second = F.when(F.col(form_col) == "psm", SUFFIX).otherwise(PREFIX), len(MIDDLE)
    bare = df.withColumn("_rest", F.expr(f"substring(`{output_col}`, {len(PREFIX) + 1})")).withColumn("_mark", first)
    one = bare.withColumn("_a", F.expr("substring_index(_rest, _mark, 1)")).withColumn("_rest", F.expr("substring(_rest, length(_a) + length(_mark) + 1)"))
    two = one.withColumn("_b", F.expr(f"substring_index(_rest, '{MIDDLE}', 1)")).withColumn("_c", F.expr(f"substring(_rest, length(_b) + {second + 1})"))
    text = F.when(F.col(form_col) == "plain", F.col(output_col)).when(F.col(form_col) == "psm", F.concat("_a", "_c", "_b")).otherwise(F.concat("_b", "_c", "_a"))
    return two.withColumn(out, text).drop("_rest", "_mark", "_a", "_b", "_c")


def middle_sql(seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    """The digest of ``rearrange`` in DuckDB: units as a list, parts as slices of it; the restored text is the text itself."""
    number = lambda i: f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT"
    return rf"""
with t as (select doc_id, coalesce(text, '') as text, sha256('{seed}:' || doc_id) as d from documents),
u as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, {number(0)} as h1, {number(1)} as h2, {number(2)} as h3, {number(3)} as h4 from t),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as j,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {suffix_first} then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(w[1:i], ''), '') as a, coalesce(array_to_string(w[i + 1:j], ''), '') as b, coalesce(array_to_string(w[j + 1:n], ''), '') as s from c)
select doc_id, n::BIGINT as n, form, case when form <> 'plain' then length(a)::BIGINT end as prefix_chars, case when form <> 'plain' then length(b)::BIGINT end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || a || '{SUFFIX}' || s || '{MIDDLE}' || b else '{SUFFIX}' || s || '{PREFIX}' || a || '{MIDDLE}' || b end) as output_sha256,
  sha256(text) as restored_sha256
from p"""
