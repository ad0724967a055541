"""Personal data: fixed patterns, and a semi-Markov conditional random field for what those miss.

The patterns give base spans of the kinds email, ip, card and phone, leftmost and non-overlapping per kind.  The random field
looks at every whole text.  Its candidate segments are

* numbers: groups of digits, at most ``MOST_DIGITS`` together, with at most ``GAP`` characters between two groups and neither
  a letter nor a line end within, begun by the first group or by plus signs and brackets before it;
* addresses: all of a local part of whatever length, an at sign, spelt out or not, and two labels at least.  A host of more
  than ``MOST_LABELS`` labels can't be a name of at most 253 characters.

A segment is scored as a whole (number of digits, shape, Luhn and octet tests, separators, last label, what stands before and
behind), which token labels could not do, and dynamic programming over the segments chooses the boundaries and kinds that
score best together.  Between segments everything is outside and scores 0, so only the best path of each kind to each open
end is kept: memory doesn't grow with the text, but for the spans found, and time is linear in it.  Spans are added where
they touch no base span; base spans always stay.

The weights are fitted in the driver, by gradient ascent of the conditional likelihood, on sentences that ``examples``
makes from a rule with a fixed seed: no corpus rows are used, so the fit is the same everywhere and small.

Offsets are code points, ends exclusive.  A null text counts as empty and has no spans; rows with equal ids are scanned one
by one, and ids may have any type.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.shared import with_fields
from scriptorium.llm.textblock import packed, utf8

KINDS = ("email", "ip", "card", "phone")
MOST_DIGITS, GAP, MOST_LABELS = 19, 4, 127
EPOCHS, RATE, PENALTY, SENTENCES, SEED = 12, 0.25, 1e-4, 260, 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# The random field.

_RUN = re.compile(r"[0-9](?:(?!\n)[\W\d_])*+")
_DIGITS = re.compile("[0-9]+")
_SHAPE = str.maketrans("012345678", "9" * 9)
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\sat\s[^\s]+\sdot\s", re.IGNORECASE)
#: At signs: (kind, what a text needs to have one, pattern).
_MARKS = (
    ("@", re.compile("@"), re.compile(r"\s?@\s?")),
    ("[at]", re.compile(r"[\[({<]\s?at", re.IGNORECASE), re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?", re.IGNORECASE)),
    ("at", re.compile(r"\sdot\s", re.IGNORECASE), re.compile(r"\sat\s(?=[^\s]+\sdot\s)", re.IGNORECASE)),
)
_LABEL = re.compile(r"[\w-]++")
_DOT = re.compile(r"(\.)|(\s\.\s)|(\s?[\[({<]\s?dot\s?[\])}>]\s?)|(\sdot\s)", re.IGNORECASE)
_CUES = {"email": "mail", "mail": "mail", "contact": "mail", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "payment": "card", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone"}
_LONGEST_CUE = max(map(len, _CUES))
#: Common last parts of host names.
_LAST = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv uk us ca au nz ie in za de at ch fr be nl es pt it pl cz se no fi dk gr ru ua tr jp kr cn br mx ar cl eu".split())


def _cue(text: str, at: int) -> str | None:
    """What the word before a place hints at, if at most four signs, numbers or blanks lie between."""
    parts = 0
    while at and not text[at - 1].isalpha():
        parts += 1
        if parts > 4:
            return None
        c = text[at - 1]
        same = str.isspace if c.isspace() else "0123456789".__contains__ if c in "0123456789" else None
        at -= 1
        while same and at and same(text[at - 1]):
            at -= 1
    start = at
    while start and at - start <= _LONGEST_CUE and text[start - 1].isalpha():
        start -= 1
    return _CUES.get(text[start:at].lower())


def _around(text: str, s: int, e: int) -> tuple[bool, bool]:
    """Whether a segment is glued to a word, and whether more of the same seems to go on."""
    before, after = text[s - 1 : s], text[e : e + 1]
    return before.isalnum() or after.isalnum(), before in ("+", ".", "-", "@", "/", "(") or after in ("@", "/") or after in (".", "-") and text[e + 1 : e + 2].isalnum()


#: A candidate: start, end, and all that its features depend on.
Candidate = tuple[int, int, tuple]


def _numbers(text: str) -> Iterator[Candidate]:
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 4:
            continue
        held: list[tuple[int, int]] = []  # the groups of which a segment may still begin with the first
        for m in _DIGITS.finditer(text, run.start(), run.end()):
            if held and m.start() - held[-1][1] > GAP:
                while held:
                    yield from _begun(text, held)
                    held.pop(0)
            held.append(m.span())
            while sum(b - a for a, b in held) > MOST_DIGITS:
                yield from _begun(text, held)
                held.pop(0)
        while held:
            yield from _begun(text, held)
            held.pop(0)


def _begun(text: str, groups: list[tuple[int, int]]) -> Iterator[Candidate]:
    """The segments that begin with the first of the groups, by start."""
    first = groups[0][0]
    starts = [first]
    while len(starts) < 3 and starts[0] and text[starts[0] - 1] in "+(":
        starts.insert(0, starts[0] - 1)
    ends, digits, parts = [], 0, []
    for a, b in groups:
        digits += b - a
        if digits > MOST_DIGITS:
            break
        parts.append(text[a:b])
        octets = len(parts) == 4 and all(map(_octet, parts))
        if digits >= 7 or octets:
            ends.append((b, digits, octets, luhn("".join(parts)) if digits >= 13 else None))
    if not ends:
        return
    for s in starts:
        cue = _cue(text, s)
        for e, digits, octets, sound in ends:
            yield s, e, ("number", text[s:e].translate(_SHAPE), digits, sound, octets, *_around(text, s, e), cue)


def _addresses(text: str, kind: str, mark: re.Pattern) -> Iterator[Candidate]:
    for m in mark.finditer(text):
        s = m.start()
        while s and (text[s - 1] in _LOCAL or text[s - 1].isalnum()):
            s -= 1
        while s < m.start() and text[s] in ".-+%":
            s += 1
        label = _LABEL.match(text, m.end())
        if s == m.start() or not label:
            continue
        cue, n = _cue(text, s), 1
        dot, label = _following(text, label.end())
        while label and (n := n + 1) <= MOST_LABELS:
            kind_of_dot, last, e = dot, label[0].lower(), label.end()
            dot, label = _following(text, e)
            yield s, e, ("address", kind, kind_of_dot, last.isalpha() and 2 <= len(last) <= 6, last in _LAST, min(n, 4), *_around(text, s, e), label is not None and dot, cue)


def _following(text: str, at: int) -> tuple[int, re.Match | None]:
    """The kind of dot at a place, spelt out or not, and the label after it."""
    dot = _DOT.match(text, at)
    return (dot.lastindex, _LABEL.match(text, dot.end())) if dot else (0, None)


def candidates(text: str) -> Iterator[Candidate]:
    """The segments that could be an entity, by start."""
    return merge(_numbers(text), *(_addresses(text, kind, mark) for kind, need, mark in _MARKS if need.search(text)), key=lambda c: c[0])


def features(of: tuple) -> list[str]:
    """The features of a candidate."""
    if of[0] == "address":
        _, kind, dot, plain, known, n, glued, more, on, cue = of
        return ["address", f"on={on}", f"on={on},{dot}", f"glued={glued}", f"more={more}", f"cue={cue}", f"tld={plain}", f"last={known}", f"last={known},{kind}", f"at={kind},{dot}", f"labels={n}"]
    _, shape, digits, sound, octets, glued, more, cue = of
    groups = _DIGITS.findall(shape)
    seps = "".join(sorted(set(shape.replace("9", ""))))
    out = ["bias", f"glued={glued}", f"more={more}", f"cue={cue}", f"digits={digits}", f"seps={seps}", f"groups={len(groups)}", f"shape={shape}", f"plus={shape[0] == '+'}", f"paren={shape[0] == '('}", f"octets={octets},{seps}", f"sizes={','.join(str(len(g)) for g in groups[-3:])},{seps}"]
    return out if sound is None else [*out, f"luhn={sound},{digits >= 16}"]


class Field:
    """Weights of (kind, feature) and of neighbouring kinds; 0 is "no entity", kinds count from 1."""

    def __init__(self, weights: dict | None = None):
        self.w: dict = weights if weights is not None else {}
        self.known: dict[tuple, list[tuple[int, float]]] = {}
        kinds = range(len(KINDS) + 1)
        self.step = [[self.w.get(("next", p, k), 0.0) for k in kinds] for p in kinds]
        self.most = [max(self.step[p][k] - self.step[p][0] + self.step[k][q] - self.step[0][q] for p in kinds for q in kinds) for k in kinds]

    def score(self, k: int, own: list[str]) -> float:
        return sum(self.w.get((k, f), 0.0) for f in own)

    def scores(self, of: tuple) -> list[tuple[int, float]]:
        """(kind, score) of a candidate; the same for all that look alike.  Kinds that lose against outside whatever stands
        beside them are left out, as they are in no best path."""
        if of not in self.known:
            if len(self.known) > 20000:
                self.known.clear()
            own = features(of)
            self.known[of] = [(k, x) for k in range(1, len(KINDS) + 1) if (x := self.score(k, own)) + self.most[k] > 0]
        return self.known[of]

    def best(self, text: str) -> list[tuple[str, int, int]]:
        """The most likely segmentation's entities.  A path is (path before, kind, start, end); of all paths to an open end the
        best of each kind is kept, and of those that are outside the best of all."""
        step, here, beside = self.step, -1, {}  # beside: the paths that end where the candidates at hand begin
        outside: tuple[float, tuple | None] = (0.0, None)
        ends: dict[int, dict[int, tuple[float, tuple]]] = {}

        def close(at: dict[int, tuple[float, tuple]]) -> None:
            nonlocal outside
            for k, (v, path) in at.items():
                if v + step[k][0] > outside[0]:
                    outside = v + step[k][0], path

        for s, e, of in candidates(text):
            scores = self.scores(of)
            if not scores:
                continue
            if s > here:
                close(beside)
                for x in sorted(x for x in ends if x < s):
                    close(ends.pop(x))
                here, beside = s, ends.pop(s, {})
            before = [(p, v, path) for p, (v, path) in beside.items()]
            at = ends.setdefault(e, {})
            for k, own in scores:
                top, path = outside[0] + step[0][k], outside[1]
                for p, v, other in before:
                    if v + step[p][k] > top:
                        top, path = v + step[p][k], other
                if k not in at or top + own > at[k][0]:
                    at[k] = (top + own, (path, k, s, e))
        close(beside)
        for x in sorted(ends):
            close(ends[x])
        out, path = [], outside[1]
        while path:
            path, k, s, e = path
            out.append((KINDS[k - 1], s, e))
        return out[::-1]

    def learn(self, edges: list[tuple[int, int, list[str]]], gold: set[tuple[str, int, int]], rate: float) -> None:
        """A step up the conditional log likelihood of a sentence, of which ``edges`` are the candidates and their features."""
        kinds, none = range(len(KINDS) + 1), -math.inf
        total = lambda xs: none if (m := max(xs, default=none)) == none else m + math.log(sum(math.exp(x - m) for x in xs))
        step = lambda p, k: self.w.get(("next", p, k), 0.0)
        places = sorted({-1, *(s for s, _, _ in edges), *(e for _, e, _ in edges), 1 << 40})
        number = {x: i for i, x in enumerate(places)}
        into: list[list] = [[] for _ in places]  # (from, kind, features, score)
        for i in range(1, len(places)):
            into[i].append((i - 1, 0, [], 0.0))
        for s, e, f in edges:
            into[number[e]] += [(number[s], k, f, self.score(k, f)) for k in kinds[1:]]
        ahead = [[0.0] + [none] * len(KINDS)]
        for own in into[1:]:
            ahead.append([total([ahead[i][p] + s + step(p, k) for i, kk, _, s in own if kk == k for p in kinds]) for k in kinds])
        back = [[none] * (len(KINDS) + 1) for _ in places]
        back[-1][0] = 0.0
        behind: list[list[list[float]]] = [[[] for _ in kinds] for _ in places]
        for j in range(len(places) - 1, 0, -1):
            if j < len(places) - 1:
                back[j] = [total(x) for x in behind[j]]
            for i, k, _, s in into[j]:
                for p in kinds:
                    behind[i][p].append(back[j][k] + s + step(p, k))
        z = ahead[-1][0]
        grad: dict = {}

        def add(key, x: float) -> None:
            grad[key] = grad.get(key, 0.0) + x

        held = {(s, e): f for s, e, f in edges}
        before, end = 0, -1
        for s, e, kind in sorted((s, e, kind) for kind, s, e in gold if (s, e) in held):
            k = KINDS.index(kind) + 1
            if s > end and before:
                add(("next", before, 0), 1.0)
                before = 0
            add(("next", before, k), 1.0)
            for f in held[s, e]:
                add((k, f), 1.0)
            before, end = k, e
        if before:
            add(("next", before, 0), 1.0)
        for j in range(1, len(places)):
            for i, k, f, s in into[j]:
                if back[j][k] == none:
                    continue
                for p in kinds:
                    if ahead[i][p] > none and (q := math.exp(min(0.0, ahead[i][p] + s + step(p, k) + back[j][k] - z))) > 1e-4:
                        add(("next", p, k), -q)
                        for x in f:
                            add((k, x), -q)
        grad.pop(("next", 0, 0), None)  # stays 0: outside is free, however long
        for key, g in grad.items():
            self.w[key] = self.w.get(key, 0.0) * (1 - PENALTY) + rate * g


def examples(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, set]]:
    """Sentences with known entities, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 8)))

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return r.choice(("", " ", "-", ".")).join(x[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = r.choice(("", "", word() + r.choice("._-+"))) + word() + r.choice(("", "", d(2)))
        host, tld = word(), r.choice(("com", "org", "net", "de", "fr", "edu", "io"))
        if r.random() < 0.3:
            host, tld = r.choice(((f"{word()}.{host}", tld), (host, r.choice(("co.uk", "com.au", "ac.at")))))
        dotted = lambda dot: f"{host}.{tld}".replace(".", dot)
        return r.choice((f"{name}@{dotted('.')}", f"{name} [at] {dotted(' [dot] ')}", f"{name} (at) {dotted(' (dot) ')}", f"{name} at {dotted(' dot ')}", f"{name}[at]{dotted('.')}", f"{name}[at]{dotted('[dot]')}", f"{name} @ {dotted(' . ')}", f"{name} (at) {dotted('.')}"))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+{d(2)} {a} {b} {c}"))

    def ip() -> str:
        return r.choice((".", ".", ".", " . ")).join(str(r.randint(0, 255)) for _ in range(4))

    def none() -> str:
        return r.choice((f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 23):02}:{d(2)}:{d(2)}", d(r.randint(1, 12)), f"{r.randint(1, 9)},{d(3)}.{d(2)}", f"{r.randint(0, 9)}.{d(1)}.{d(2)}", d(16), d(16)[:13], f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(2)}/{d(4)} {d(2)}:{d(2)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(4)} {d(4)} {d(4)}", f"{d(5)}-{d(4)}", f"arrive at {word()} {d(7)}", f"meet at {word()} dot", f"look at {word()} dot {word()}", f"look at {word()} dot {word()}", f"{d(3)}.{d(3)}.{d(3)},{d(2)}", f"{d(2)}.{d(2)}.{d(4)} {d(2)}", f"{d(1)} . {d(1)}", f"{d(2)} . {d(3)} . {d(1)}", ", ".join(d(r.randint(1, 3)) for _ in range(r.randint(3, 7))), " ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 7)))))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.3:
                    text += r.choice([c for c, k in _CUES.items() if k.startswith(kind[-4:])] or ["id"]) + r.choice((": ", " "))
                entity = makers[kind]()
                if kind == "card" and not luhn(_NOT_DIGIT.sub("", entity)):
                    continue
                gold.add((kind, len(text), len(text) + len(entity)))
                text += entity + r.choice((" ", ". ", ", "))
            else:
                text += none() + r.choice((" ", ". ", ", "))
        out.append((text + word(), gold))
    return out


@lru_cache(1)
def trained() -> dict:
    field, sentences = Field(), [([(s, e, features(of)) for s, e, of in candidates(t)], g) for t, g in examples()]
    for epoch in range(EPOCHS):
        for edges, gold in sentences:
            field.learn(edges, gold, RATE / (1 + epoch / 3))
    return field.w


def find_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and those that the field adds."""
    base = base_spans(text)
    taken, added = sorted((s, e) for _, s, e in base), []
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    for kind, s, e in field.best(text):
        k = int(np.searchsorted(starts, e)) - 1
        if k < 0 or ends[k] <= s:
            added.append((kind, s, e))
    return base, added


_NEEDED = np.zeros(256, bool)
_NEEDED[[*range(48, 58), 64]] = True


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that have a digit or an at sign, spelt out or not."""
    raw, at = utf8(column)
    count = np.zeros(len(column), np.int64)
    step = 4 << 20
    for lo in range(int(at[0]), int(at[-1]), step):
        hits = np.flatnonzero(_NEEDED[raw[lo : min(lo + step, int(at[-1]))]]) + lo
        np.add.at(count, np.searchsorted(at, hits, "right") - 1, 1)
    return (count > 0) | pc.fill_null(pc.match_substring_regex(column, _AT.pattern, ignore_case=True), False).to_numpy(zero_copy_only=False)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.schema([("base", _SPANS), ("added", _SPANS)])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``base`` and ``added`` spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            text, done = b.column("text"), 0

            def found(text=text):
                for row, suspect in zip(text, _suspects(text), strict=True):
                    yield tuple(map(as_rows, find_spans(row.as_py(), field))) if suspect else ([], [])

            for part in packed(found(), _FOUND, lambda r: 40 * (len(r[0]) + len(r[1]))):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, part.num_rows), *part.columns], ["doc_id", "base", "added"])
                done += part.num_rows

    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, with_fields(rows, ["doc_id"], f"base {spans}, added {spans}"))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, with every span replaced by its kind in brackets; overlapping spans are replaced together
    by the kinds in order.  ``length_col``, if there is one, gets the new number of characters where a text changed."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    schema = docs.schema

    def clean(text: str, field: Field) -> str:
        base, added = find_spans(text, field)
        out, at, open_ = [], 0, None
        for s, e, kind in sorted((s, e, k) for k, s, e in base + added):
            if open_ is not None and s < open_[1]:
                open_ = (open_[0], max(e, open_[1]), [*open_[2], kind])
                continue
            if open_ is not None:
                out += [text[at : open_[0]], "".join(f"[{k.upper()}]" for k in dict.fromkeys(open_[2]))]
                at = open_[1]
            open_ = (s, e, [kind])
        if open_ is not None:
            out += [text[at : open_[0]], "".join(f"[{k.upper()}]" for k in dict.fromkeys(open_[2]))]
            at = open_[1]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for b in batches:
            text = b.column(text_col)
            rows = np.flatnonzero(_suspects(text)).tolist()
            new = {i: t for i in rows if (t := clean(was := text[i].as_py(), field)) != was}
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                cols = {text_col: pc.replace_with_mask(text, pa.array(mask), pa.array(list(new.values()), text.type))}
                if length_col in b.schema.names:
                    kind = b.column(length_col).type
                    cols[length_col] = pc.replace_with_mask(b.column(length_col), pa.array(mask), pa.array([len(t) for t in new.values()]).cast(kind))
                b = pa.RecordBatch.from_arrays([cols.get(n, b.column(n)) for n in b.schema.names], schema=b.schema)
            yield b

    return docs.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the string of all spans, by kind, then by start."""

    def text(spans: str):
        kinds = ", ".join(f"'{k}'" for k in KINDS)
        ordered = f"array_sort(transform({spans}, x -> named_struct('rank', array_position(array({kinds}), x.kind), 'start', x.start, 'end', x.end, 'kind', x.kind)))"
        return F.expr(f"array_join(transform({ordered}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")

    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("concat(base, added)").alias("spans"))
