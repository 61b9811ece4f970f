"""Secret scans on built-in expressions only: patterns, and entropy windows with incremental counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns in report order: (kind, pattern, group whose length counts, least length).
#: ``{n,}`` finds in a run of one class what ``+`` and a length filter would, as runs are taken whole.
BASE_PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Character classes of the entropy windows: (kind, class in regex form, members, least bits a character).
ENTROPY_CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", "0123456789ABCDEFabcdef", 3.0),
    ("entropy_base64", "A-Za-z0-9+/_=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
WINDOW = 24

#: Candidates that hold one of these are known to be harmless: placeholders, runs, alphabets, UUIDs.
ALLOW_LIST = (
    r"(?i)example", r"(?i)sample", r"(?i)placeholder", r"(?i)changeme", r"(?i)dummy", r"(?i)redacted",
    r"(.)\1{7}", r"0123456789", r"(?i)abcdefgh", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
)

#: Sums of c * log2(c) are whole numbers of this many parts, so they are exact in any order.
PARTS = 1_000_000
_CHUNK = 256
_TEXT, _FOUND = "__text", "array<struct<start:int,end:int,value:string>>"
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plogp(n: int) -> list[int]:
    """c * log2(c) for c from 0 to n, in PARTS."""
    return [0, *(round(c * math.log2(c) * PARTS) for c in range(1, n + 1))]


def entropy_limit(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c * log2(c) at which a window has ``bits`` or more a character."""
    return math.floor((math.log2(window) - bits) * window * PARTS)


def _matches(df: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds array ``name`` of (start, end, value): the leftmost non-overlapping matches whose group is long enough.

    Spark gives matches without places. Places follow from the lengths of the matches and of the text between
    them, summed in chunks of 256, so that the work doesn't grow with the square of the number of matches.
    """
    m, v, g, lens, sums, base, ends = (f"__{name}_{x}" for x in ("m", "v", "g", "lens", "sums", "base", "ends"))
    p = quoted(pattern)
    value = f"regexp_extract_all({_TEXT}, {p}, {group})" if group else m
    steps = [
        {m: f"regexp_extract_all({_TEXT}, {p}, 0)"},
        {g: f"if(size({m}) > 0, split({_TEXT}, {p}, -1), NULL)", v: f"if(size({m}) > 0, {value}, NULL)"},
        {lens: f"zip_with(slice({g}, 1, size({m})), {m}, (a, b) -> length(a) + length(b))"},
        {sums: f"transform(sequence(0, (size({lens}) - 1) div {_CHUNK}), c -> aggregate(slice({lens}, int(c * {_CHUNK} + 1), {_CHUNK}), 0, (a, x) -> a + x))"},
        {base: f"transform(sequence(0, size({sums}) - 1), c -> aggregate(slice({sums}, 1, c), 0, (a, x) -> a + x))"},
        {ends: f"""flatten(transform(sequence(0, size({base}) - 1), c -> transform(sequence(1, int(least({_CHUNK}, size({lens}) - c * {_CHUNK}))),
            i -> get({base}, c) + aggregate(slice({lens}, int(c * {_CHUNK} + 1), i), 0, (a, x) -> a + x))))"""},
        {name: f"""filter(transform(sequence(0, size({ends}) - 1), i -> named_struct(
            'start', get({ends}, i) - length(get({m}, i)), 'end', get({ends}, i), 'value', get({v}, i))), x -> length(x.value) >= {least})"""},
    ]
    for step in steps:
        df = df.withColumns({k: F.expr(e if k in (m, g, v) else f"if({g} IS NULL, NULL, {e})") for k, e in step.items()})
    none = F.array().cast(_FOUND)
    return df.withColumn(name, F.coalesce(F.col(name).cast(_FOUND), none)).drop(m, v, g, lens, sums, base, ends)


def _hot_part(value: str, members: str, bits: float) -> str:
    """SQL for (first, last): the characters of ``value`` covered by its windows of high entropy; first is -1 if none.

    One pass. The state holds the window's count of each member and the sum of c * log2(c) over them; a step
    changes the counts of the character that enters and the one that leaves, and only their terms of the sum.
    """
    f = "array(" + ", ".join(f"{x}L" for x in plogp(WINDOW)) + ")"
    place = lambda i: f"instr({quoted(members)}, substring({value}, {i}, 1)) - 1"
    return f"""aggregate(sequence(0, length({value}) - 1),
        named_struct('counts', array_repeat(0, {len(members)}), 'total', 0L, 'first', -1, 'last', -1),
        (a, i) -> get(transform(transform(
            array(named_struct('into', {place("i + 1")}, 'out', if(i >= {WINDOW}, {place(f"i + 1 - {WINDOW}")}, -1))),
            s -> named_struct('into', s.into, 'out', s.out, 'total', if(s.into = s.out, a.total,
                a.total + get({f}, get(a.counts, s.into) + 1) - get({f}, get(a.counts, s.into))
                + if(s.out < 0, 0L, get({f}, get(a.counts, s.out) - 1) - get({f}, get(a.counts, s.out)))))),
            s -> named_struct(
                'counts', if(s.into = s.out, a.counts, transform(a.counts, (n, j) -> n + if(j = s.into, 1, 0) - if(j = s.out, 1, 0))),
                'total', s.total,
                'first', if(a.first < 0 AND i >= {WINDOW - 1} AND s.total <= {entropy_limit(bits)}L, i - {WINDOW - 1}, a.first),
                'last', if(i >= {WINDOW - 1} AND s.total <= {entropy_limit(bits)}L, i + 1, a.last))), 0),
        a -> named_struct('first', a.first, 'last', a.last))"""  # fmt: skip


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets", allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """Adds ``into``: array of (start, ord, end, kind), every secret of the whole text, in order of start and kind.

    Places are code points from 0, end exclusive. Base kinds are those of ``BASE_PATTERNS``. The method adds, for
    each class of ``ENTROPY_CLASSES``, candidates of ``WINDOW`` or more characters of the class that hold a digit
    and a letter: the part that windows with the class's entropy cover, unless the candidate is on the allow-list
    or the part lies in a base span. All is done row by row on built-in expressions: no shuffle, no Python.

    Write the result before filtering on ``into``: Spark would copy its large expression into the filter.
    Null or empty text: an empty array. Equal rows: equal arrays. Other columns stay as they are.
    """
    kinds = [k for k, *_ in BASE_PATTERNS]
    df = df.withColumn(_TEXT, F.coalesce(F.col(text), F.lit("")))
    for kind, pattern, group, least in BASE_PATTERNS:
        df = _matches(df, f"__k_{kind}", pattern, group, least)
    tag = lambda kind, n: f"transform(__k_{kind}, x -> named_struct('start', x.start, 'ord', {n}, 'end', x.end, 'kind', '{kind}'))"
    df = df.withColumn("__base", F.expr(f"concat({', '.join(tag(k, n) for n, k in enumerate(kinds))})").cast(_SPAN)).drop(*(f"__k_{k}" for k in kinds))
    harmless = " OR ".join(f"x.value RLIKE {quoted(p)}" for p in allow_list) or "false"
    for n, (kind, chars, members, bits) in enumerate(ENTROPY_CLASSES, len(kinds)):
        df = _matches(df, f"__k_{kind}", rf"(?<![{chars}])[{chars}]{{{WINDOW},}}+", 0, WINDOW)
        other = "" if kind == "entropy_hex" else "AND NOT x.value RLIKE '^[0-9A-Fa-f]+$'"
        df = df.withColumn(f"__k_{kind}", F.expr(f"""filter(transform(
            filter(__k_{kind}, x -> x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]' {other} AND NOT ({harmless})),
            x -> named_struct('at', x.start, 'part', {_hot_part("x.value", members, bits)})), x -> x.part.first >= 0)"""))
        df = df.withColumn(f"__k_{kind}", F.expr(f"""filter(transform(__k_{kind}, x -> named_struct('start', x.at + x.part.first, 'ord', {n}, 'end', x.at + x.part.last, 'kind', '{kind}')),
            x -> size(__base) = 0 OR NOT exists(__base, b -> b.start <= x.start AND x.end <= b.end))""").cast(_SPAN))
    added = [f"__k_{k}" for k, *_ in ENTROPY_CLASSES]
    return df.withColumn(into, F.array_sort(F.concat("__base", *added))).drop("__base", _TEXT, *added)


def span_list(spans: str, keep: str = "true") -> Column:
    """The spans as ``kind:start:end``, comma-joined; ``keep``: SQL on span x."""
    return F.expr(f"array_join(transform(filter({spans}, x -> {keep}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``text`` with each stretch that spans cover replaced by ``mark``. Null text stays null; spans may overlap."""
    df = df.withColumn("__cut", F.expr(f"""aggregate({spans}, CAST(array() AS array<struct<s:int,e:int>>), (a, x) -> if(size(a) > 0 AND element_at(a, -1).e >= x.start,
        concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.end)))),
        concat(a, array(named_struct('s', x.start, 'e', x.end)))))"""))
    piece = f"substring({text}, coalesce(get(__cut, i - 1).e, 0) + 1, coalesce(get(__cut, i).s, length({text})) - coalesce(get(__cut, i - 1).e, 0))"
    return df.withColumn(text, F.expr(f"if({text} IS NULL OR size(__cut) = 0, {text}, array_join(transform(sequence(0, size(__cut)), i -> {piece}), {quoted(mark)}))")).drop("__cut")


def secret_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, the counts of each base kind, base_sha256 and all spans."""
    df = find_secrets(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    n = len(BASE_PATTERNS)
    return df.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(secrets, x -> x.ord = {i})) AS long)").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE_PATTERNS)],
        F.sha2(span_list("secrets", f"x.ord < {n}"), 256).alias("base_sha256"),
        span_list("secrets").alias("spans"),
    )
