"""Language identification in two levels.

A linear support vector machine on hashed byte n-grams first picks the language family, one against the rest; within the
family, machines for each pair of languages vote (ties go to the larger sum of margins).  The machines have no bias, so a
text's whole n-gram counts need no normalising to be classed: each adds up one weight per position, over all of the text.

Training: of each of the ``MOST_LANGUAGES`` most frequent labels at most ``PER_LANGUAGE`` different rows, and ``MOST_SAMPLES`` of all, chosen by a
hash of id and text among the rows that may be learned from; only their n-gram counts come to the driver, where dual coordinate descent fits the machines and a two-parameter
logistic turns margins per n-gram into probabilities.  ``score`` is the family's probability times the least one within it.

A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn from.  Rows
with equal ids are classed one by one; equal texts get equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.llm.shared import fresh
from scriptorium.llm.textblock import ALNUM, LOWER, blocks

PER_LANGUAGE, MOST_LANGUAGES, MOST_SAMPLES = 400, 200, 8000
SIZE = 1 << 14
ORDERS = (2, 3, 4)
EPOCHS, COST = 12, 1.0
UNKNOWN = "und"
#: Families of languages; one that is not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy".split(),
    "romance": "fr es pt it ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indic": "hi bn pa gu or mr ne ur si as".split(),
    "dravidian": "ta te kn ml".split(),
    "semitic": "ar he am mt ti".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "uralic": "fi et hu".split(),
    "sinitic": "zh yue".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = ALNUM.copy()
_LETTER[48:58] = False


def _cleaned(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, everything else one space; and the rows' offsets in that."""
    if not len(raw):
        return raw, at
    low = np.where(_LETTER[raw], LOWER[raw], np.uint8(32))
    before = np.empty_like(raw)
    before[0], before[1:] = 0, raw[:-1]
    capital = (before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)  # Latin-1 capitals
    low = np.where(capital, low + np.uint8(32), low).astype(np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[at[:-1][at[:-1] < len(raw)]] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _codes(low: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the feature of every position where an n-gram starts, and whether it ends in the same row."""
    wide = low.astype(np.uint32)
    value = wide.copy()
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(low))
    for n in range(2, max(ORDERS) + 1):
        value = value[:-1] * np.uint32(257) + wide[n - 1 :] if len(value) > 1 else value[:0]
        if n in ORDERS:
            mix = (value + np.uint32(n * 7919)) * np.uint32(2654435761)
            yield (mix >> np.uint32(18)).astype(np.int32), left[: len(value)] >= n


def _counts(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each row the counts of its features, dense."""
    low, at = _cleaned(raw, at)
    out = [np.zeros(SIZE, np.float32) for _ in range(len(at) - 1)]
    for code, whole in _codes(low, at):
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            out[i] += np.bincount(code[a:b][whole[a:b]], minlength=SIZE)
    return out


def _has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum(_LETTER[raw] & (raw < 128))])[at]
    wide = np.concatenate([[0], np.cumsum(raw >= 128)])[at]
    out = np.diff(ascii_) > 0
    for i in np.flatnonzero(~out & (np.diff(wide) > 0)).tolist():
        out[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode(errors="replace"))
    return out


Sparse = list[tuple[np.ndarray, np.ndarray]]


def _machine(x: Sparse, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent (Hsieh et al., 2008) over the given rows of x, each of
    length one."""
    w, alpha, order = np.zeros(SIZE, np.float32), np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            at, v = x[rows[i]]
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1.0), 0.0), COST)
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * v
                alpha[i] = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) is the probability of y = 1, after Platt."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = np.abs(margin).mean() or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        t -= np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * t), -2, 2)
    return float(t[0] / scale), float(t[1])


class Model:
    """Machines of families and of pairs of languages, and their logistics."""

    def __init__(self, x: Sparse, langs: list[str]):
        """x: of each text the features that it has, and how often."""
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY_OF.get(c, c) for c in self.langs})
        self.of = {f: [c for c in self.langs if FAMILY_OF.get(c, c) == f] for f in self.families}
        unit = [(at, n / np.linalg.norm(n)) for at, n in x]
        lang = np.array(langs)
        family = np.array([FAMILY_OF.get(c, c) for c in langs])
        weights, self.logistics, self.index = [], [], {}

        def add(key, rows: np.ndarray, y: np.ndarray) -> None:
            w = _machine(unit, rows, y)
            self.index[key] = len(weights)
            weights.append(w)
            self.logistics.append(_logistic(np.array([float(w[x[i][0]] @ x[i][1] / x[i][1].sum()) for i in rows]), y))

        if len(self.families) > 1:
            for f in self.families[: 1 if len(self.families) == 2 else None]:
                add(f, np.arange(len(lang)), np.where(family == f, 1.0, -1.0))
        for f in self.families:
            for i, a in enumerate(self.of[f]):
                for b in self.of[f][i + 1 :]:
                    rows = np.flatnonzero((lang == a) | (lang == b))
                    add((a, b), rows, np.where(lang[rows] == a, 1.0, -1.0))
        self.weights = np.array(weights, np.float32).reshape(-1, SIZE)

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        letter = _has_letter(raw, at)
        low, at = _cleaned(raw, at)
        n = len(at) - 1
        sums, total = np.zeros((len(self.weights), n)), np.zeros(n)
        for code, whole in _codes(low, at):
            code = np.where(whole, code, SIZE)
            a, b = np.minimum(at[:-1], len(code)), np.minimum(at[1:], len(code))
            total += np.diff(np.concatenate([[0], np.cumsum(whole)])[np.stack([a, b])], axis=0)[0]
            for k, w in enumerate(self.weights):
                run = np.concatenate([[0.0], np.cumsum(np.append(w, np.float32(0))[code], dtype=np.float64)])
                sums[k] += run[b] - run[a]
        margin = sums / np.maximum(total, 1)
        p = np.array([1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) for (a, b), m in zip(self.logistics, margin, strict=True)]).reshape(len(self.weights), n)
        if len(self.families) == 1:
            best, score = np.zeros(n, int), np.ones(n)
        elif len(self.families) == 2:
            best, score = np.where(p[0] >= 0.5, 0, 1), np.maximum(p[0], 1 - p[0])
        else:
            own = p[[self.index[f] for f in self.families]]
            best, score = own.argmax(axis=0), own.max(axis=0)
        names = np.full(n, UNKNOWN, object)
        for f, family in enumerate(self.families):
            rows, codes = np.flatnonzero(best == f), self.of[family]
            votes, margins, least = (np.zeros((len(codes), len(rows))) for _ in range(3))
            least += 1
            for i, a in enumerate(codes):
                for j in range(i + 1, len(codes)):
                    q = p[self.index[(a, codes[j])]][rows]
                    for k, r in ((i, q), (j, 1 - q)):
                        votes[k] += r > 0.5
                        margins[k] += r
                        least[k] = np.minimum(least[k], r)
            pick = np.argmax(votes + margins / (len(codes) + 1), axis=0) if len(rows) else np.zeros(0, int)
            names[rows] = np.array(codes, object)[pick]
            score[rows] *= least[pick, np.arange(len(rows))]
        names[~letter], score[~letter] = UNKNOWN, 0.0
        return names.tolist(), score


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and their counts, deflated: all samples pass through the driver's JVM."""
    return zlib.compress(np.diff(at, prepend=np.int32(0)).astype(np.int32).tobytes() + n.astype(np.float32).tobytes(), 1)


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = np.split(np.frombuffer(zlib.decompress(held), np.int32), 2)
    return np.cumsum(step, dtype=np.int32), n.view(np.float32)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from a bounded sample of the rows that are not held out and have a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return None
    per_language = min(per_language, MOST_SAMPLES // len(sizes))
    share = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, min(1.0, 1.3 * per_language / n) * (1 << 30))])
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mark"))
    few = rows.where(F.pmod("mark", F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "mark"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, at in blocks(b.column("text")):
                made = pa.array([_packed(np.flatnonzero(c).astype(np.int32), c[c > 0]) for c in _counts(raw, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(lo, hi - lo), made], ["lang", "packed"])

    found: list[tuple[str, np.ndarray, np.ndarray]] = []
    for b in sample.mapInArrow(count, "lang string, packed binary").toArrow().to_batches():
        rows = ((lang, *_unpacked(x.as_py())) for lang, x in zip(b.column("lang").to_pylist(), b.column("packed"), strict=True))
        found += [r for r in rows if len(r[1])]
    if not found:
        return None
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    return Model([(at, n) for _, at, n in found], [lang for lang, _, _ in found])


def classify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred and score of every row; with ``keep`` all columns of the documents, and then the two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source, own = (text_col, docs.columns) if keep else ("text", ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, raw, at in blocks(b.column(source)):
                lang, score = m.predict(raw, at) if m else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score)], [*own, *names])

    return rows.mapInArrow(run, rows.select(*own).schema.add(names[0], "string").add(names[1], "double"))


def with_language(docs: DataFrame, *, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, whose language is found with a score of ``least`` at any rate, a language that was null being
    replaced by the one found; the model is learned from them."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = classify(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col, keep=True, names=(lang, score))
    kept = found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least))
    return kept.select(*(F.coalesce(c, lang).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns))
