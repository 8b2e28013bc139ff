"""Quality classifier: a sparse rule ensemble over statistics of the text.

Statistics of every whole text are made in one pass over its bytes. On labelled rows small boosted trees are grown;
every path from a root, whole or in part, is a rule, a conjunction of bounds on statistics. Lasso logistic regression
over the rules leaves few of them, and those become one Spark column expression, so scoring is a projection.

The fit uses at most MAX_LABELLED labelled rows, those of the smallest hash of their id; all else covers all rows.

Edge cases: null and empty texts have all statistics 0 and a score like any other; several labels of an id count by the
lowest, null labels not at all; labels of one class give one score, and none give 1 (nothing is known against a text);
repeated rows give a row each; a null id isn't held out; other columns stay out of the score; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import IdFilter, cut, id_filter, slices, utf8

#: Labelled rows that a model is fitted on, at most.
MAX_LABELLED = 20_000
#: Trees, their depth, rows of a leaf at least, and quantile bins of a statistic.
TREES, DEPTH, LEAF_ROWS, BINS, SHRINKAGE = 40, 3, 8, 64, 0.3
#: Lasso penalties that are tried on a fifth of the rows, and steps of the solver.
PENALTIES, STEPS = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005), 150

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "pipes", "symbols", "exclaims", "stops", "other_marks", "beyond_ascii", "distinct_words",
    "adjacent_repeats", "top_word", "markless_words", "lines_per_word", "distinct_lines", "byte_entropy", "long_words", "controls",
)
PREFIX = "_qs_"
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "pipes": b"|", "symbols": b"#$%&*@^~<>{}[]\\/=+_`", "exclaims": b"!?", "stops": b".,", "other_marks": b"\"'():;-", "controls": bytes([*range(9), *range(14, 32), 127])}
_WEIGHTS = np.zeros((256, len(_KINDS)))
for _i, _bytes in enumerate(_KINDS.values()):
    _WEIGHTS[list(_bytes), _i] = 1.0
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_NOT_LETTERS = bytes(c for c in range(256) if c not in _LETTERS)


def statistics_of(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = dict(zip(_KINDS, (seen @ _WEIGHTS / size).tolist(), strict=True))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    p = seen[seen > 0] / size
    letters = size - sum(seen[list(_NOT_LETTERS)])
    return [
        float(np.log1p(n)), letters / n, share["upper"], share["digits"], share["pipes"], share["symbols"], share["exclaims"], share["stops"], share["other_marks"],
        float(seen[128:].sum()) / size, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        sum(c for w, c in counts.items() if w.isalpha()) / n, len(lines) / n, len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()),
        sum(c for w, c in counts.items() if len(w) > 14) / n, share["controls"],
    ]


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text", only: IdFilter | None = None) -> DataFrame:
    """The keep columns and the statistics (PREFIX before their names) for every row of docs, or for those whose first
    keep column passes a filter."""

    def make(batches):
        ok = only() if only else None
        for b in batches:
            if ok is not None:
                ids = b.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(ok(ids)))
            texts = utf8(b.column(len(keep)))
            for lo, hi in slices(texts):
                got = np.array([statistics_of(t or b"") for t in texts[lo:hi]]).reshape(hi - lo, len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), *(pa.array(got[:, i]) for i in range(got.shape[1]))], [*keep, *(PREFIX + s for s in STATISTICS)]
                )

    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    for s in STATISTICS:
        schema = schema.add(PREFIX + s, "double")
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("_qs_text")).mapInArrow(make, schema)


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high for all of them."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, f] > low) & (x[:, f] <= high) for f, low, high in self.bounds])

    def column(self) -> Column:
        parts = []
        for f, low, high in self.bounds:
            if np.isfinite(low):
                parts.append(F.col(PREFIX + STATISTICS[f]) > float(low))
            if np.isfinite(high):
                parts.append(F.col(PREFIX + STATISTICS[f]) <= float(high))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole & p
        return whole


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules of boosted trees for a 0/1 label: each node's path from the root."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, path: dict[int, tuple[float, float]], depth: int) -> None:
        g, h = gradient[rows], weight[rows]
        best = (1e-6, 0, 0)
        if depth < DEPTH and len(rows) >= 2 * LEAF_ROWS:
            for f, e in enumerate(edges):
                if len(e):
                    b = binned[rows, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g, h, None))
                    right_g, right_h = g.sum() - left_g, h.sum() - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(left_n < LEAF_ROWS) | (len(rows) - left_n < LEAF_ROWS)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
        if not best[0] > 1e-6:
            raw[rows] += SHRINKAGE * g.sum() / (h.sum() + 1)
            return
        _, f, at = best
        low, high = path.get(f, (-np.inf, np.inf))
        cutoff = float(edges[f][at])
        for side, part in (((low, cutoff), rows[binned[rows, f] <= at]), ((cutoff, high), rows[binned[rows, f] > at])):
            own = path | {f: side}
            rules[Rule(tuple((k, *v) for k, v in sorted(own.items())))] = None
            grow(part, gradient, weight, own, depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grow(np.arange(len(y)), y - p, p * (1 - p), {}, 0)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an absolute penalty, by accelerated proximal steps."""
    n, m = r.shape
    a = np.column_stack((r, np.ones(n)))
    v = np.random.default_rng(0).random(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / (np.linalg.norm(a.T @ (a @ v)) * 1.1 + 1e-9)
    w = np.zeros(m + 1) if start is None else start.copy()
    z, t = w.copy(), 1.0
    for _ in range(STEPS):
        new = z - step * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of 0/1 labels y by statistics x, rows in a fixed order."""
    if not len(y):
        return Model(40.0, ())
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float)
    test = np.array([zlib.crc32(b"%d" % i) % 5 == 0 for i in range(len(y))])
    losses = []
    for penalty in PENALTIES:
        w, b = lasso(r[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[test] @ w + b))), 1e-9, 1 - 1e-9)
        losses.append(float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()) if test.any() else 0.0)
    # The sparsest model that is nearly as good as the best.
    chosen = next(p for p, loss in zip(PENALTIES, losses, strict=True) if loss <= min(losses) * 1.02 + 1e-4)
    w, b = lasso(r, y, chosen)
    return Model(b, tuple((rule, float(x)) for rule, x in zip(rules, w, strict=True) if x))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 2, folds: int = 4, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `most` labelled rows outside the held-out fold, in the order of a hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    wanted = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("double").alias("_label")).where(~held_out("_id", fold, folds))
    wanted = cut(wanted.orderBy(F.xxhash64("_id"), "_id").limit(most), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    stats = statistics(texts, ["_id"], "_text", id_filter(wanted, "_id"))
    names = [PREFIX + s for s in STATISTICS]
    rows = stats.join(wanted, "_id").orderBy(F.xxhash64("_id"), "_id", *names).limit(most).select("_label", *names).toPandas()
    return rows[names].to_numpy(float), rows["_label"].to_numpy(float)


def held_out(id_col: str, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The keep columns and the score for every row of docs; texts are read twice and never shuffled."""
    model = fit(*labelled(docs, labels, id_col, text_col))
    return statistics(docs, keep, text_col).select(*(F.col(f"`{c}`") for c in keep), model.column().alias(score_col))
