"""Personal data in texts: candidate spans, boosted trees, calibrated thresholds.

Everything on texts is column expressions.  Per kind (email, ip, card, phone):

* the base pattern's matches, leftmost and without overlap, that pass its check are always spans;
* high-recall generators propose more spans, which may overlap; boosted trees see format and context features of each, and those
  above their generator's calibrated threshold are added, if no base span overlaps and no other candidate with a
  higher score does (ties: the earlier).

Offsets are code points, ends exclusive.  The trees learn from examples made by rule from
templates (``examples``), pass through the same feature expressions as a small
table, and are fitted on the driver; thresholds come from a second half of the examples.

The base patterns are searched in a form that gives the same matches in
time linear in the text: a match can begin only where the previous character could not belong to
it or where the last match ended.

Folds go through chunks and many spans are searched by halving, so a text with very many of them takes hardly more than linear time.

Defined results: a null or empty text has no spans; repeated rows are judged each; an empty table
gives an empty table; a kept column that is named like an output is returned as ``kept_<name>``.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm.common import kept_names

KINDS = ("email", "ip", "card", "phone")

#: Kind -> (cheap test that a text may hold one, its pattern, check of a match m).
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
BASE = {
    "email": ("contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"text rlike r'[0-9]\.[0-9]++\.[0-9]'", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", rf"m rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'"),
    "card": (r"text rlike r'[0-9](?:[ -]?[0-9]){15}'", r"(?:\G|(?<![0-9]))(?=(?:[0-9][\x20-]?){15}[0-9])[0-9](?:[\x20-]?[0-9])++", "length(digits) between 16 and 19 and luhn"),
    "phone": (r"text rlike r'\+[0-9]'", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 8 and 15"),
}

#: Generator -> (kind, cheap test, pattern).
GENERATORS = {
    "spelled_email": ("email", r"text rlike r'(?i)[(\[{] ?at ?[)\]}]'", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{] ?dot ?[)\]}] ?|\.)[A-Za-z0-9-]{1,63}){1,8}"),
    "spelled_ip": ("ip", r"text rlike r'[0-9]\[\.\][0-9]'", r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])"),
    "loose_card": ("card", r"text rlike r'[0-9]{4}[ ._/-]{1,2}[0-9]{4}'", r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])"),
    "loose_phone": ("phone", r"text rlike r'[0-9]{2}[)]?[ ./-]{1,2}[0-9]{2,5}[ ./-][0-9]{2}'", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{0,2}[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,3}(?![0-9A-Za-z])"),
}

_LUHN = """aggregate(transform(sequence(1, greatest(length({d}), 1)), i -> cast(substr({d}, length({d}) - i + 1, 1) as int) * (1 + (i + 1) % 2) - if(i % 2 = 0 and cast(substr({d}, length({d}) - i + 1, 1) as int) > 4, 9, 0)), 0, (a, b) -> a + b) % 10 = 0"""

#: Features of a candidate (m: match, pre: what stands before it, post: behind, digits: its digits, g: number of its generator).
FEATURES = [
    "g",
    "length(digits)",
    "length(m)",
    "size(regexp_extract_all(m, r'[0-9]+', 0))",
    "cast(contains(m, '(') as int)",
    "cast(luhn as int)",
    rf"cast(m rlike r'^{_OCTET}(?:\[?\.\]?{_OCTET}){{3}}$' as int)",
    "cast(lower(pre) rlike r'(?:tel|phone|call|mobile|fax|cell|dial|sms)[a-z]*\\W*(?:\\w+\\W+)?$' as int)",
    "cast(lower(pre) rlike r'(?:card|visa|credit|payment|paid)' as int)",
    "cast(lower(pre) rlike r'(?:host|addr|server|login|from)' as int)",
    "cast(lower(pre) rlike r'(?:mail|contact|write|reach)' as int)",
    "cast(lower(pre) rlike r'(?:isbn|issn|version|order|invoice|ref|page|serial|build|part|no\\.|#)\\W*(?:\\w+\\W+)?$' as int)",
    "cast(m rlike r'^(?:19|20)[0-9]{2}[-/. ]|[-/. ](?:19|20)[0-9]{2}$' as int)",
    "cast(pre rlike r'[0-9A-Za-z]$' as int)",
    "cast(post rlike r'^[0-9A-Za-z%$]' as int)",
    "cast(m rlike r'(?i)[(\\[{] ?at ?[)\\]}].*\\W[a-z]{2,6}$' as int)",
]
ROUNDS, RATE, PRECISION = 30, 0.3, 0.98
EXAMPLES = 600


#: Characters before a candidate that are its context.
CONTEXT = 24
#: Elements that one fold goes through, as a growing array is copied with every element; characters in a piece of text, a power of two.
CHUNK, PIECE = 256, 1024


def _let(name: str, value: str, body: str) -> str:
    """SQL body in which the value, evaluated once, has a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(items: str, body: str) -> str:
    """SQL array of what the body makes of each chunk ``part`` of the items, and of its number j."""
    return f"transform(sequence(0, cast((size({items}) - 1) div {CHUNK} as int)), j -> {_let('part', f'slice({items}, j * {CHUNK} + 1, {CHUNK})', body)})"


def _span_list(pattern: str, extra: str) -> str:
    """SQL for the matches of a pattern with their places: gaps between matches and matches, added up chunk by chunk.

    pre is the end of the match and the gap before, post the beginning of the gap behind; a
    place in a long text would take long to find.
    """
    kind = "array<struct<m: string, start: int, end: int, pre: string, post: string>>"
    n = "size(p.found)"
    items = f"""zip_with(zip_with(slice(p.gaps, 1, {n}), p.found, (gap, m) -> struct(gap as gap, m as m)),
      zip_with(slice(concat(array(''), p.found), 1, {n}), slice(p.gaps, 2, {n}), (b, a) -> struct(b as b, a as a)),
      (x, y) -> struct(length(x.gap) as n, x.m as m, right(concat(y.b, x.gap), {CONTEXT}) as pre, left(y.a, 8) as post))"""
    sizes = _chunks("found", "aggregate(part, 0, (acc, x) -> acc + x.n + length(x.m))")
    new = "array(struct(x.m as m, acc.at + x.n as start, acc.at + x.n + length(x.m) as end, x.pre as pre, x.post as post))"
    placed = f"""aggregate(part, struct(aggregate(slice(sizes, 1, j), 0, (acc, x) -> acc + x) as at, cast(array() as {kind}) as done),
      (acc, x) -> struct(acc.at + x.n + length(x.m) as at, concat(acc.done, {new}) as done), acc -> acc.done)"""
    every = _let("found", items, _let("sizes", sizes, f"flatten({_chunks('found', placed)})"))
    both = f"struct(split(text, r'{pattern}', -1) as gaps, regexp_extract_all(text, r'{pattern}', 0) as found)"
    return _let("p", both, extra.replace("FOUND", every))


def _bound(spans: str, field: str, above: str) -> str:
    """SQL for the place of the first of ascending spans whose field is above a value, by halving."""
    return f"""aggregate(sequence(0, cast(log2(size({spans}) + 1) as int) + 1), struct(0 as low, size({spans}) as high),
        (acc, i) -> case when acc.low >= acc.high then acc
                         when get({spans}, shiftright(acc.low + acc.high, 1)).{field} > {above} then struct(acc.low as low, shiftright(acc.low + acc.high, 1) as high)
                         else struct(shiftright(acc.low + acc.high, 1) + 1 as low, acc.high as high) end, acc -> acc.low)"""


def _overlapping(spans: str) -> str:
    """SQL array of the spans that candidate c may overlap: all of a few, else those found by halving (spans ascend and don't overlap each other)."""
    first, behind = _bound(spans, "end", "c.start"), _bound(spans, "start", "c.end - 1")
    return f"if(size({spans}) <= 16, {spans}, {_let('first', first, f'slice({spans}, first + 1, greatest({behind} - first, 0))')})"


def _with_digits(body: str) -> str:
    """SQL body over m in which ``digits`` and ``luhn`` are written out."""
    d = "regexp_replace({m}, r'[^0-9]', '')"
    return body.replace("luhn", f"({_LUHN.format(d=d.format(m='m'))})").replace("digits", d.format(m="m"))


def _base(kind: str) -> str:
    test, pattern, check = BASE[kind]
    keep = _with_digits(check).replace("(m,", "(c.m,").replace("m rlike", "c.m rlike")
    found = f"transform(filter(FOUND, c -> {keep}), c -> struct('{kind}' as kind, c.start as start, c.end as end))"
    return f"case when {test} then {_span_list(pattern, found)} else cast(array() as array<struct<kind: string, start: int, end: int>>) end"


def _proposed(name: str) -> str:
    kind, test, pattern = GENERATORS[name]
    g = list(GENERATORS).index(name)
    found = f"transform(FOUND, c -> struct('{kind}' as kind, c.start as start, c.end as end, {g} as g, c.m as m, c.pre as pre, c.post as post))"
    return f"case when {test} then {_span_list(pattern, found)} else cast(array() as array<struct<kind: string, start: int, end: int, g: int, m: string, pre: string, post: string>>) end"


def _features(c: str) -> str:
    """SQL array of a candidate's features; c names the candidate."""
    out = []
    for f in FEATURES:
        f = _with_digits(f)
        for name in ("m", "pre", "post"):
            for a, b in ((f"({name},", f"({c}.{name},"), (f"({name})", f"({c}.{name})"), (f"({name} rlike", f"({c}.{name} rlike")):
                f = f.replace(a, b)
        out.append(f"{c}.g" if f == "g" else f)
    return "array(" + ", ".join(out) + ")"


# --- the model -----------------------------------------------------------


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """(text with one candidate, whether it is personal data), made by rule."""
    rng = random.Random(seed)
    words = ["delta", "harbor", "with", "the", "meeting", "about", "garden", "later", "under", "and"]
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["anna", "j.smith", "li", "omar.k", "info", "team9"])
    filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))

    def card() -> str:
        digits = "4" + num(14)
        odd = sum(int(c) for c in digits[1::2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[0::2])
        return digits + str(-odd % 10)

    out = []
    for i in range(n):
        good, kind = i % 2, (i // 2) % 4
        sep = rng.choice([" ", ".", "-", "/"])
        if kind == 0:
            text = rng.choice([f"{name()} (at) mail{num(1)} (dot) example (dot) com", f"{name()}[at]host{num(1)}.org"]) if good else rng.choice([f"look (at) {rng.choice(words)}.{num(2)}", f"meet [at] noon.{num(1)}"])
            cue = rng.choice(["mail me", "contact", "write to", ""]) if good else rng.choice(["", "please"])
        elif kind == 1:
            text = "[.]".join(str(rng.randint(1, 254)) for _ in range(4)) if good else "[.]".join(rng.choice(["999", "300", num(1), "512"]) for _ in range(4))
            cue = rng.choice(["login from", "host", "server", ""]) if good else rng.choice(["version", "build", "section"])
        elif kind == 2:
            digits = card() if good else num(16)
            text = rng.choice([". ", "_", "/", "."]).join(digits[j : j + 4] for j in range(0, 16, 4))
            cue = rng.choice(["card", "visa", "paid by credit card"]) if good else rng.choice(["serial", "order no.", "part", ""])
        else:
            if good:
                text = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(2)} {num(3)} {num(4)}"])
                cue = rng.choice(["call", "phone", "tel.", "my mobile is", "fax:"])
            else:
                text = rng.choice([f"20{num(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/20{num(2)}", f"{num(3)}-{num(2)}-{num(5)}-{num(3)}", f"{num(2)} {num(3)} {num(3)}"])
                cue = rng.choice(["isbn", "order", "invoice", "page", "on", "about", "version", ""])
        out.append((f"{filler()} {cue} {text} {filler()}", good))
    return out


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree (feature, cut, left, right) or a leaf value, by Newton gain."""
    value = -gradient.sum() / (hessian.sum() + 1.0)
    best = (1e-6, 0, 0.0)
    if depth:
        base = gradient.sum() ** 2 / (hessian.sum() + 1)
        for f in range(x.shape[1]):
            cuts = np.unique(x[:, f])
            for cut in (cuts[:-1] + cuts[1:]) / 2:
                left = x[:, f] <= cut
                gl, hl = gradient[left].sum(), hessian[left].sum()
                gr, hr = gradient.sum() - gl, hessian.sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - base
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(cut))
    if best[0] <= 1e-6:
        return float(value)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], gradient[left], hessian[left], depth - 1), _grow(x[~left], gradient[~left], hessian[~left], depth - 1))


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, depth: int = 3) -> list:
    trees, z = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, p - y, p * (1 - p), depth)
        trees.append(tree)
        z += rate * np.array([_value(tree, r) for r in x])
    return trees


def calibrate(score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest threshold at which the examples at or above it reach the precision; beyond 1 if none does."""
    for t in np.unique(np.round(score, 6)):
        if y[score >= t].mean() >= precision:
            return float(max(t, 0.5))
    return 2.0


@lru_cache(maxsize=4)
def _model_of(rows: tuple) -> tuple[list, list[float]]:
    x = np.array([r[0] for r in rows], float)
    y = np.array([r[1] for r in rows], float)
    half = np.arange(len(y)) // 8 % 2 == 0
    trees = fit_trees(x[half], y[half])
    score = 1 / (1 + np.exp(-RATE * np.array([sum(_value(t, r) for t in trees) for r in x])))
    cuts = [calibrate(score[~half & (x[:, 0] == g)], y[~half & (x[:, 0] == g)]) if (~half & (x[:, 0] == g)).any() else 2.0 for g in range(len(GENERATORS))]
    return trees, cuts


def fit(spark: SparkSession) -> tuple[list, list[float]]:
    """(trees, threshold of each generator), from the examples seen through the feature expressions."""
    made = examples()
    values = ", ".join(f"({i}, '{t}', {y})" for i, (t, y) in enumerate(made))
    frame = spark.sql(f"select * from values {values} as t(i, text, y)")
    rows = frame.selectExpr("i", "y", f"explode({_all_proposed()}) as c").selectExpr("i", "y", f"{_features('c')} as x").collect()
    rows = sorted((r["i"], tuple(int(v) for v in r["x"]), r["y"]) for r in rows)
    return _model_of(tuple((x, y) for _, x, y in rows))


def _all_proposed() -> str:
    return "concat(" + ", ".join(_proposed(name) for name in GENERATORS) + ")"


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"if(f[{tree[0]}] <= {tree[1]!r}D, {_tree_sql(tree[2])}, {_tree_sql(tree[3])})"


def find(df: DataFrame, keep: list[str], text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """The columns ``keep`` with ``base`` and ``spans``: arrays of (kind, start, end), by kind as listed, then start."""
    trees, cuts = model or fit(df.sparkSession)
    z = " + ".join(f"({_tree_sql(t)})" for t in trees)
    cut = "case c.g " + " ".join(f"when {g} then {t!r}D" for g, t in enumerate(cuts)) + " end"
    score = f"1D / (1D + exp(-{RATE}D * element_at(transform(array({_features('c')}), f -> {z}), 1)))"
    mine = [f"_{i}" for i in range(len(keep))]
    plain = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own, more = [f"_base_{k}" for k in KINDS], [f"_added_{g}" for g in range(len(GENERATORS))]
    based = plain.withColumns({c: F.expr(_base(k)) for c, k in zip(own, KINDS)}).withColumn("proposed", F.expr(_all_proposed()))
    free = " and ".join(f"not exists({_overlapping(c)}, b -> b.start < c.end and c.start < b.end)" for c in own)
    scored = based.withColumn("base", F.concat(*own)).withColumn("scored", F.expr(f"""
      filter(transform(filter(proposed, c -> {free}),
        c -> struct(c.start as start, c.end as end, c.kind as kind, c.g as g, {score} as score)), c -> c.score >= {cut})"""))
    dealt = scored.withColumns({c: F.expr(f"filter(scored, c -> c.g = {g})") for g, c in enumerate(more)})
    beats = "d.g <> c.g and d.start < c.end and c.start < d.end and (d.score > c.score or d.score = c.score and (d.start < c.start or d.start = c.start and d.g < c.g))"
    alone = " and ".join(f"not exists({_overlapping(c)}, d -> {beats})" for c in more)
    apart = dealt.withColumn("added", F.expr(f"if(size(scored) < 2, scored, filter(scored, c -> {alone}))"))
    order = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    spans = f"transform(array_sort(transform(concat(base, transform(added, c -> struct(c.kind as kind, c.start as start, c.end as end))), s -> struct({order} as o, s.start as start, s.end as end, s.kind as kind))), s -> struct(s.kind as kind, s.start as start, s.end as end))"
    out = kept_names(keep, "base int, spans int, _text int")
    return apart.select(*[F.col(m).alias(c) for m, c in zip(mine, out)], "base", F.expr(spans).alias("spans"), F.col("text").alias("_text"))


def joined(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')")


def redact(df: DataFrame, text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """All columns, with each span of the text replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    names = df.columns
    mine = [f"_keep_{i}" for i in range(len(names))]
    found = find(df.toDF(*mine), mine, mine[names.index(text_col)], model)
    bits = PIECE.bit_length() - 1
    cut = lambda a, b: f"substr(array_join(slice(pieces, shiftright({a}, {bits}) + 1, shiftright({b}, {bits}) - shiftright({a}, {bits}) + 1), ''), pmod({a}, {PIECE}) + 1, {b} - {a})"
    ends = _chunks("s", "array_max(transform(part, x -> x.end))")
    groups = f"""aggregate(part, struct(coalesce(array_max(slice(ends, 1, j)), 0) as upto, cast(array() as array<struct<from: int, to: int, kind: string>>) as done),
      (acc, x) -> struct(greatest(acc.upto, x.end) as upto, if(x.start >= acc.upto, concat(acc.done, array(struct(acc.upto as from, x.start as to, x.kind as kind))), acc.done) as done), acc -> acc.done)"""
    joined_up = f"concat(array_join(transform(flatten({_chunks('s', groups)}), x -> concat({cut('x.from', 'x.to')}, '[', upper(x.kind), ']')), ''), {cut('array_max(ends)', 'length(_text)')})"
    sorted_spans = "array_sort(transform(spans, s -> struct(s.start as start, s.end as end, s.kind as kind)))"
    clean = _let("pieces", f"regexp_extract_all(_text, r'(?s).{{1,{PIECE}}}', 0)", _let("s", sorted_spans, _let("ends", ends, joined_up)))
    return found.select(*[(F.when(F.size("spans") > 0, F.expr(clean)).otherwise(F.col(m)) if c == text_col else F.col(m)).alias(c) for m, c in zip(mine, names)])
