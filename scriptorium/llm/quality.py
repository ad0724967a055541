"""Quality scores by a sparse ensemble of rules.

Statistics of every whole text are computed in one pass (counts of characters by class, words, repeated words and lines).
On a bounded sample of labelled rows, shallow trees are grown over bootstrap samples; every path from a root is a rule, a
conjunction of thresholds.  Logistic weights for the rules are fitted under an L1 penalty, which leaves few; the rules
become Spark column expressions over the statistics, so that scoring is a projection.

The sample is at most ``MOST_ROWS`` labels, those whose ids have the smallest hashes, and at most as many of the rows they
join.  A null or empty text has statistics 0 and a
score like any other.  Rows with equal ids are scored one by one; a label counts once for each pair of rows that it joins.
Without labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.langid import held_out
from scriptorium.llm.shared import use_checkpoint_dir, with_fields
from scriptorium.llm.textblock import NOT_SPACE, Words, blocks

MOST_ROWS = 6000
TREES, DEPTH, CUTS, LEAST = 30, 3, 24, 12
PENALTY, STEPS, SEED = 0.004, 400, 5

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4
_CLASS[128:] = 5
_CLASS[[*b".,;:'\"-()?"]] = 6
_CLASS[[*b"!"]] = 7
_CLASS[[*b"|"]] = 8

STATISTICS = ("chars", "words", "upper", "lower", "digits", "space", "wide", "plain", "bangs", "bars", "symbols", "word_length", "long_words", "distinct", "top_word", "same_next", "lines", "line_words", "distinct_lines", "ends")
STATS_FIELDS = "held_out boolean, " + ", ".join(f"s_{c} double" for c in STATISTICS)


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each row of a block."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    kind = _CLASS[raw]
    share = {k: _per_row(kind == k, at) / size for k in range(9)}
    words = Words(raw, at, NOT_SPACE)
    row, count = words.row(), np.diff(words.first)
    per = np.maximum(count, 1).astype(float)
    hashes = words.hashes()
    length = words.end - words.start

    def repeats(row: np.ndarray, key: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the count of the most frequent, for each row."""
        distinct, top = np.zeros(n), np.zeros(n)
        if len(row):
            order = np.lexsort((key, row))
            r, k = row[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
            runs = np.diff(np.append(first, len(r)))
            np.add.at(distinct, r[first], 1)
            np.maximum.at(top, r[first], runs)
        return distinct / total, top / total

    distinct, top = repeats(row, hashes, per)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    not_newline = np.ones(256, bool)
    not_newline[10] = False
    lines = Words(raw, at, not_newline)
    n_lines = np.maximum(np.diff(lines.first), 1).astype(float)
    distinct_lines, _ = repeats(lines.row(), lines.hashes(), n_lines)
    last = kind[words.end - 1] if words.n else np.zeros(0, np.uint8)
    columns = [
        np.diff(at), count, share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[0],
        _per_row(length, words.first) / per, _per_row(length > 12, words.first) / per, distinct, top, _per_row(same, words.first) / per,
        np.diff(lines.first), count / n_lines, distinct_lines, _per_row((last == 0) | (last == 7) | (last == 8), words.first) / per,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics (s_...) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, at in blocks(b.column("text")):
                made = statistics(raw, at)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(c) for c in made.T)], ["doc_id", "held_out", *(f"s_{c}" for c in STATISTICS)])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, with_fields(rows, ["doc_id"], STATS_FIELDS))


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], random: np.random.Generator, depth: int, path: Rule, out: set) -> None:
    """Add the paths of a tree below ``path``: conditions (statistic, above, threshold)."""
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return
    best = (0.0, None)
    gini = lambda k, n: k * (n - k) / np.maximum(n, 1)
    for j in random.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        if not len(cuts[j]):
            continue
        above = x[:, j, None] > cuts[j]
        n, k = above.sum(axis=0), (above * y[:, None]).sum(axis=0)
        gain = gini(y.sum(), len(y)) - gini(k, n) - gini(y.sum() - k, len(y) - n)
        gain[(n < LEAST) | (len(y) - n < LEAST)] = 0
        if gain.max() > best[0] + 1e-9:
            best = (float(gain.max()), (int(j), float(cuts[j][gain.argmax()])))
    if best[1] is None:
        return
    j, cut = best[1]
    for above in (True, False):
        rows = (x[:, j] > cut) == above
        longer = tuple(sorted({*path, (j, above, cut)}))
        out.add(longer)
        _grow(x[rows], y[rows], cuts, random, depth - 1, longer, out)


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.stack([np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in rule]) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept, and the rules that keep a weight."""
    random = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    found: set = set()
    for _ in range(TREES):
        rows = random.integers(0, len(y), len(y))
        _grow(x[rows], y[rows], cuts, random, DEPTH, (), found)
    rules = sorted(found)
    fired = fires(rules, x)
    _, first = np.unique(fired, axis=1, return_index=True) if rules else (None, np.zeros(0, int))
    rules = [rules[i] for i in sorted(first)]  # of rules that fire alike the first
    fired = fires(rules, x)
    w, b = np.zeros(len(rules)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rate = 4.0 / (1 + (np.linalg.norm(fired, 2) ** 2 / len(y) if rules else 0))
    ahead, ahead_b, t = w.copy(), b, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(fired @ ahead + ahead_b, -30, 30)))
        new = ahead - rate * (fired.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_b = ahead_b - rate * float((p - y).mean())
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / next_t * (new - w), new_b + (t - 1) / next_t * (new_b - b)
        w, b, t = new, new_b, next_t
    return b, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6]


def compiled(model: tuple[float, list[tuple[float, Rule]]]) -> Column:
    """The score as a column expression over the statistics."""
    b, rules = model
    total = F.lit(b)
    for weight, rule in rules:
        test = None
        for j, above, cut in rule:
            c = F.col(f"s_{STATISTICS[j]}")
            one = c > F.lit(cut) if above else c <= F.lit(cut)
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", most_rows: int = MOST_ROWS) -> tuple[float, list]:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    n = own.count()
    if not n:
        return 0.0, []
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, 1.2 * most_rows / n) * (1 << 30))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_rows)
    columns = [f"s_{c}" for c in STATISTICS]
    rows = F.broadcast(own).join(stats, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *columns).limit(most_rows).select("label", *columns).toPandas()
    if not len(rows):
        return 0.0, []
    values = rows.sort_values(list(rows.columns), kind="stable").to_numpy(float)
    return fit(values[:, 1:], values[:, 0])


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    use_checkpoint_dir(docs.sparkSession)
    stats = with_statistics(docs, id_col=id_col, text_col=text_col).checkpoint()
    model = train(stats, labels, id_col=id_col, label_col=label_col)
    return stats.select("doc_id", "held_out", compiled(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
