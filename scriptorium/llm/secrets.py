"""Secret scan with DataFrame expressions only: fixed patterns, and the entropy of sliding windows.

Three patterns give the base spans (``assign``, ``access``, ``hex``).  Besides, every run of 20 or more characters of the
base64 alphabet that holds a digit and a letter is a candidate.  A window's class is ``hexadecimal`` if the candidate has only
such digits, or the window has only such digits and among them a decimal one and a letter, as in a key behind ``SESSION=``;
else it is ``base64``.  A fold over the characters keeps the sum of n log2 n over the counts of the symbols in the last ``WINDOW``
characters; it changes by what the count of the one character that enters and of the one that leaves change.  Where a window's Shannon entropy reaches its class's
threshold, the stretch from the first to the last such window is a span of kind ``entropy``, unless the candidate is on the
allow-list (placeholders, alphabets and counting sequences, UUIDs) or touches a base span.

Offsets are code points, ends exclusive.  Positions come from splitting the text at a pattern's matches and adding lengths,
so each pattern is run only on rows that a cheap test lets through.  Lists are walked in blocks of ``BLOCK``, so that no list
that grows step by step gets long: time is linear in the text, however many matches it has.  A null or empty text has no spans; ids are not
interpreted, and rows with equal ids are scanned one by one.  Everything is narrow: nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
#: Bits for each class; the most that a window of 20 can have is 4 and 4.32.
THRESHOLDS = {"hexadecimal": 3.0, "base64": 3.8}
#: Fixed values.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|abcdefgh|01234567|12345678|87654321|qwerty"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)

BLOCK = 256

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value`` evaluated once and bound to ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _walk(items: str, zero: str, step, emit) -> str:
    """SQL for the spans that emit(state, x) gives for each x of ``items`` in order, where the state, an int, begins as ``zero``
    and becomes step(state, x)."""
    begin = f"aggregate(blocks, named_struct('s', {zero}, 'out', cast(array() as array<int>)), (acc, k) -> named_struct('s', aggregate(k, acc.s, (s, x) -> {step('s', 'x')}), 'out', concat(acc.out, array(acc.s))), acc -> acc.out)"
    inner = f"aggregate(k, named_struct('s', s0, 'out', cast(array() as {_SPAN})), (a, x) -> named_struct('s', {step('a.s', 'x')}, 'out', concat(a.out, {emit('a.s', 'x')})), a -> a.out)"
    blocks = f"transform(sequence(0, greatest(size(z) - 1, 0) div {BLOCK}), i -> slice(z, i * {BLOCK} + 1, {BLOCK}))"
    return _let(items, "z", _let(blocks, "blocks", f"flatten(zip_with(blocks, {begin}, (k, s0) -> {inner}))"))


_NONE = f"cast(array() as {_SPAN})"


def _spans(text: str, pattern: str, guard: str, kind: str, rank: int, keep: str) -> Column:
    """The spans of a pattern's matches m that ``keep``; only where ``guard`` holds.  All arguments but kind are SQL."""
    pairs = f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))"
    step = lambda s, x: f"{s} + length({x}.`0`) + coalesce(length({x}.`1`), 0)"
    span = lambda s, x: f"named_struct('start', {s} + length({x}.`0`), 'rank', {rank}, 'end', {step(s, x)}, 'kind', '{kind}', 'value', {x}.`1`)"
    emit = lambda s, x: f"if({x}.`1` is not null and ({keep.replace('$m', f'{x}.`1`')}), array({span(s, x)}), {_NONE})"
    return F.expr(f"case when {guard} then {_walk(pairs, '0', step, emit)} else {_NONE} end")


def _free(candidates: str, base: str) -> str:
    """SQL for the candidates that touch no base span: none that began before ends within, and none begins within."""
    both = f"array_sort(concat({base}, {candidates}))"
    before = _walk(both, "0", lambda s, x: f"if({x}.rank < 3, greatest({s}, {x}.end), {s})", lambda s, x: f"if({x}.rank = 3 and {s} > {x}.start, {_NONE}, array({x}))")
    behind = _walk(f"reverse({before})", "2147483647", lambda s, x: f"if({x}.rank < 3, least({s}, {x}.start), {s})", lambda s, x: f"if({x}.rank = 3 and {s} >= {x}.end, array({x}), {_NONE})")
    return f"if(size({candidates}) = 0 or size({base}) = 0, {candidates}, reverse({behind}))"


def _literal(pattern: str) -> str:
    """An SQL string literal of a pattern; raw, so that backslashes stay."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    assert "\\'" not in pattern
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entropy(candidates: str) -> Column:
    """Spans of kind entropy among candidate spans."""
    sums = ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(WINDOW + 2))
    f = lambda n: f"get(array({sums}), {n})"
    coded = f"transform({candidates}, c -> named_struct('start', c.start, 'value', c.value, 'hex', c.value rlike '^[0-9a-fA-F]+$', 'codes', transform(split(c.value, ''), ch -> instr('{ALPHABET}', ch))))"
    digit = lambda c: f"if({c} between 53 and 62, 1, 0)"
    letter = lambda c: f"if({c} between 1 and 6 or {c} between 27 and 32, 1, 0)"
    ends = f"named_struct('enter', get(c.codes, i), 'leave', if(i >= {WINDOW}, get(c.codes, i - {WINDOW}), 0), 'window', slice(c.codes, greatest(i - {WINDOW}, 0) + 1, least(i, {WINDOW})))"
    # how often the one that enters was there, how often the one that leaves is there with it, and the two classes' counts
    counts = f"""named_struct('had', size(filter(e.window, k -> k = e.enter)), 'then', if(e.leave > 0, size(filter(e.window, k -> k = e.leave)) + if(e.enter = e.leave, 1, 0), 0),
      'digits', acc.digits + {digit("e.enter")} - {digit("e.leave")}, 'letters', acc.letters + {letter("e.enter")} - {letter("e.leave")})"""
    total = f"acc.s + {f('v.had + 1')} - {f('v.had')} + if(v.then > 0, {f('v.then - 1')} - {f('v.then')}, 0D)"
    least = f"if(c.hex or (v.digits > 0 and v.letters > 0 and v.digits + v.letters = {WINDOW}), {THRESHOLDS['hexadecimal']}D, {THRESHOLDS['base64']}D)"
    seen = f"i >= {WINDOW - 1} and log2({WINDOW}D) - t / {WINDOW}D >= {least} - 1e-9"
    moved = f"if(q, named_struct('s', t, 'digits', v.digits, 'letters', v.letters, 'first', if(acc.first < 0, i - {WINDOW - 1}, acc.first), 'last', i + 1), named_struct('s', t, 'digits', v.digits, 'letters', v.letters, 'first', acc.first, 'last', acc.last))"
    step = _let(ends, "e", _let(counts, "v", _let(total, "t", _let(seen, "q", moved))))
    walked = f"transform({coded}, c -> named_struct('c', c, 'r', aggregate(sequence(0, size(c.codes) - 1), named_struct('s', 0D, 'digits', 0, 'letters', 0, 'first', -1, 'last', -1), (acc, i) -> {step})))"
    return F.expr(f"""transform(filter({walked}, x -> x.r.first >= 0), x -> named_struct('start', x.c.start + x.r.first, 'rank', 3, 'end', x.c.start + x.r.last, 'kind', 'entropy', 'value', substring(x.c.value, x.r.first + 1, x.r.last - x.r.first)))""")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``base`` and ``added`` spans in order of start, then kind."""
    assign, access, hexa, candidate = map(_literal, (ASSIGN, ACCESS, HEX, CANDIDATE))
    long_assign = _literal(ASSIGN[:-3] + "]{12,})")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({
        "a": _spans("text", assign, f"(contains(text, '=') or contains(text, ':')) and text rlike {long_assign}", "assign", 0, f"length(regexp_extract($m, {assign}, 2)) >= 12"),
        "k": _spans("text", access, "contains(text, 'AKIA')", "access", 1, "length($m) >= 18"),
        "h": _spans("text", hexa, f"text rlike {hexa}", "hex", 2, "true"),
        "c": _spans("text", candidate, f"text rlike '[0-9]' and text rlike {candidate}", "candidate", 3, f"$m rlike '[0-9]' and $m rlike '[A-Za-z]' and not $m rlike {_literal(ALLOWED)}"),
    })
    rows = rows.select("doc_id", "a", "k", "h", "c", F.expr("array_sort(concat(a, k, h))").alias("base"))
    return rows.select("doc_id", "base", F.when(F.size("c") > 0, _entropy(_free("c", "base"))).otherwise(F.expr(_NONE)).alias("added"))


def joined(spans: str) -> Column:
    """kind:start:end of spans in their order."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
