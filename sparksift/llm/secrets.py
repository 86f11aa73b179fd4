"""Secret scans with built-in functions only.

Pattern kinds are found leftmost and without overlap: the text is split at a pattern's matches, and running
lengths of the pieces and matches give each match's place in code points.

The entropy kinds add candidate strings, the runs of ``candidate``: over each, a window of ``window`` characters
slides by one, the counts of its characters change by the one that leaves and the one that enters, and with them
the sum of c * log2(c) that gives the window's Shannon entropy. A run is a secret if a window reaches the
threshold of its class (hex: hexadecimal digits only; base64: capitals, small letters and digits), unless the
allow-list (a pattern searched for in the run) suppresses it.

A null text is empty; without a match the spans are empty. Rows are independent: ties, repeated rows and extra
columns change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs only, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALLOW = r"(?i:example|sample|placeholder|lorem|xxxx|0123456789|abcdefgh)"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 24
BLOCK = 64
HEX_BITS, BASE64_BITS = 3.0, 3.8
KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_FOUND = "cast(array() as array<struct<start:int,kind:int,stop:int,value:string,g:int>>)"


def _spans(text: str, kind: int, pattern: str, group: int, least: int, gate: str) -> str:
    """SQL for the array of (start, kind, stop, value) of a pattern's matches whose ``group`` has ``least`` characters.

    Running lengths are taken within blocks of ``BLOCK`` matches and then over the blocks, so that an array grows by
    one match at a time within a block only, however many matches a long text has.
    """
    p = _lit(pattern)
    pieces = f"""aggregate(array(regexp_extract_all({text}, {p}, 0)), cast(array() as array<struct<gap:int,m:string,g:int>>), (none, hits) ->
        zip_with(slice(split({text}, {p}, -1), 1, size(hits)), zip_with(hits, {'hits' if not group else f'regexp_extract_all({text}, {p}, {group})'}, (m, g) -> struct(m as m, g as g)),
                 (gap, x) -> struct(length(gap) as gap, x.m as m, length(x.g) as g)))"""
    blocks = f"""aggregate(array({pieces}), cast(array() as array<array<struct<gap:int,m:string,g:int>>>), (none, x) ->
        transform(if(size(x) = 0, cast(array() as array<int>), sequence(0, (size(x) - 1) div {BLOCK})), b -> slice(x, cast(b * {BLOCK} + 1 as int), {BLOCK})))"""
    sums = "transform(x, b -> aggregate(b, 0, (n, s) -> n + s.gap + length(s.m)))"
    offsets = "transform(sums, (n, i) -> aggregate(slice(sums, 1, i), 0, (a, k) -> a + k))"
    within = f"""aggregate(b, struct(at as at, {_FOUND} as found),
        (acc, s) -> struct(acc.at + s.gap + length(s.m) as at,
                           concat(acc.found, array(struct(acc.at + s.gap as start, {kind} as kind, acc.at + s.gap + length(s.m) as stop, s.m as value, s.g as g))) as found),
        acc -> acc.found)"""
    spans = f"""aggregate(array({blocks}), {_FOUND}, (none, x) -> aggregate(array({sums}), {_FOUND}, (none2, sums) ->
        flatten(zip_with(x, {offsets}, (b, at) -> {within}))))"""
    return f"if({gate}, filter({spans}, s -> s.g >= {least}), {_FOUND})"


def _most_entropy(run: str, window: int) -> str:
    """SQL for the highest entropy, in bits, of any window over a run, from counts kept up to date."""
    f = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 1)) + ")"
    zero = "array_repeat(0, " + str(len(ALPHABET)) + ")"
    place = lambda i: f"(instr({_lit(ALPHABET)}, substring({run}, {i}, 1)) - 1)"
    change = lambda counts, at, by: f"transform({counts}, (c, i) -> if(i = {at}, c + {by}, c))"
    first = f"aggregate(sequence(1, {window}), {zero}, (n, k) -> {change('n', place('k'), 1)})"
    total = f"aggregate({first}, 0D, (t, c) -> t + get({f}, c))"
    step = f"""(acc, k) -> if({place('k')} = {place(f'k - {window}')}, acc, struct(
        {change(change('acc.n', place(f'k - {window}'), -1), place('k'), 1)} as n,
        acc.t + get({f}, get(acc.n, {place('k')}) + 1) - get({f}, get(acc.n, {place('k')}))
              + get({f}, get(acc.n, {place(f'k - {window}')}) - 1) - get({f}, get(acc.n, {place(f'k - {window}')})) as t,
        least(acc.low, acc.t + get({f}, get(acc.n, {place('k')}) + 1) - get({f}, get(acc.n, {place('k')}))
              + get({f}, get(acc.n, {place(f'k - {window}')}) - 1) - get({f}, get(acc.n, {place(f'k - {window}')}))) as low))"""
    walk = f"aggregate(if(length({run}) > {window}, sequence({window} + 1, length({run})), cast(array() as array<int>)), struct({first} as n, {total} as t, {total} as low), {step}, acc -> acc.low)"
    return f"({math.log2(window)!r}D - {walk} / {window}D + 1e-9D)"


def found(text: str = "text", *, window: int = WINDOW, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS, allow: str = ALLOW) -> tuple[Column, Column]:
    """Columns of arrays of (start, kind, stop, value): the patterns' matches, and the runs of high entropy."""
    t = f"coalesce(cast(`{text}` as string), '')"
    base = [
        _spans(t, 0, ASSIGN, 2, 6, f"{t} rlike '[:=]' and {t} rlike '(?i:password|passwd|secret|token|api_?key)'"),
        _spans(t, 1, ACCESS, 0, 20, f"contains({t}, 'AKIA')"),
        _spans(t, 2, HEX, 0, 24, f"{t} rlike '[0-9a-f]{{24}}'"),
    ]
    runs = _spans(t, 3, CANDIDATE, 0, window, f"{t} rlike {_lit(CANDIDATE)}")
    kind = f"""if(s.value rlike {_lit(allow)}, -1,
        if(s.value rlike '^([0-9a-f]+|[0-9A-F]+)$', if({_most_entropy('s.value', window)} >= {hex_bits}D, 3, -1),
        if(s.value rlike '[a-z]' and s.value rlike '[A-Z]' and s.value rlike '[0-9]', if({_most_entropy('s.value', window)} >= {base64_bits}D, 4, -1), -1)))"""
    entropy = f"filter(transform({runs}, s -> struct(s.start as start, {kind} as kind, s.stop as stop, s.value as value)), s -> s.kind >= 0)"
    slim = f"transform(concat({', '.join(base)}), s -> struct(s.start as start, s.kind as kind, s.stop as stop, s.value as value))"
    return F.expr(f"array_sort({slim})"), F.expr(f"array_sort({entropy})")


def scan(docs: DataFrame, *, text: str = "text", output: str = "secrets", **options) -> DataFrame:
    """``docs`` and ``output``: array of (start, kind, end, value) of all kinds, by start and kind; code points, end exclusive."""
    base, entropy = found(text, **options)
    names = F.array(*(F.lit(k) for k in KINDS))
    both = F.array_sort(F.concat(base, entropy))
    return docs.withColumn(output, F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["stop"].alias("end"), s["value"].alias("value"))))


def redacted(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each run of overlapping secrets in ``text`` replaced by ``mark``; a text without secrets stays as it is, null too."""
    t = f"`{text}`"
    spans = free_name(docs.columns, "secrets")
    out = scan(docs, text=text, output=spans, **options)
    piece = f"""aggregate(`{spans}`, struct(0 as at, '' as done),
        (acc, s) -> struct(greatest(acc.at, s.`end`) as at,
                           concat(acc.done, if(s.start >= acc.at, concat(substring({t}, acc.at + 1, s.start - acc.at), {_lit(mark)}), '')) as done),
        acc -> concat(acc.done, substring({t}, acc.at + 1, length({t}))))"""
    return out.withColumn(text, F.expr(f"if(size(`{spans}`) > 0, {piece}, {t})")).drop(spans)
