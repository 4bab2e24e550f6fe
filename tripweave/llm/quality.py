"""Quality: a sparse ensemble of rules over text statistics.

Shallow regression trees are boosted on a bounded sample of labelled documents; every path from a root is a conjunction of
comparisons, a rule. A logistic model with an L1 penalty gives each rule a weight, most of them none. What is left is
compiled into one Spark column expression over the statistics, so scoring is plain arithmetic inside Spark's generated code.

Null and empty texts have statistics of zero and a score like any other. Whole texts are read. Repeated rows get equal
scores. With labels of one kind or none the score is the share of good labels, 0 without any. Empty tables and
further columns are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.hostrules import counts_of
from tripweave.llm.sampling import labelled_sample
from tripweave.llm.toxicity import fold

#: Labelled documents that rules and weights are fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
#: Penalties that are tried, on a fifth of the sample.
PENALTIES = (0.0003, 0.001, 0.003)
LEAF = 10

STATISTICS = (
    "chars", "words", "lines", "word_length", "line_words", "letters", "capitals", "digits", "blanks", "symbols", "marks", "bars", "other_bytes",
    "distinct_words", "top_word", "same_next", "repeat_words", "dup_lines", "capital_words", "marked_words", "lone_letters", "long_words", "stops",
)
_UPPER = tx.byte_set((65, 90))
_LETTER = tx.byte_set((65, 90), (97, 122), (128, 255))
_DIGIT = tx.byte_set((48, 57))
_BLANK = ~tx.NOT_BLANK
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>@^~_=+\\/{}[]", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def statistics_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    data = fold(raw)
    starts, ends, bounds = tx.spans(data, offsets, tx.NOT_BLANK)
    owner, words = tx.row_of(bounds), tx.hash_spans(data, starts, ends)
    size = np.diff(offsets).astype(float)
    n_words, _, _, dup_lines, repeated = (c.astype(float) for c in counts_of(data, offsets))

    def share(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    def words_with(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n_words, 1)

    l_starts, _, l_bounds = tx.spans(data, offsets, ~tx.byte_set((10, 10)))
    lines = np.diff(l_bounds).astype(float)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(words):
        order = np.lexsort((words, owner))
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
        first = np.flatnonzero(new)
        many = np.diff(np.concatenate([first, [len(order)]]))
        distinct += np.bincount(owner[order][first], minlength=n)
        np.maximum.at(top, owner[order][first], many)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    length = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    cover = np.maximum(n_words, 1)
    columns = [
        size, n_words, lines, (length_sum := _sums(length, bounds)) / cover, n_words / np.maximum(lines, 1), share(_LETTER), share(_UPPER), share(_DIGIT),
        share(_BLANK), share(_SYMBOL), share(_MARK), share(np.arange(256) == 124), share(np.arange(256) >= 128), distinct / cover, top / cover, words_with(again),
        repeated / cover, dup_lines / np.maximum(lines, 1), words_with(_all_capitals(raw, starts, ends)),
        words_with(_SYMBOL[last] | _MARK[last]), words_with(length == 1), words_with(length > 20), words_with(_STOP[last]),
    ]
    del length_sum
    return np.stack(columns, axis=1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _all_capitals(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of two or more capitals and no small letter."""
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    lower = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    return (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its STATISTICS; they replace columns of their names."""
    kept = [c for c in docs.columns if c not in (text, *STATISTICS)]
    schema = docs.select(*kept).schema
    for c in STATISTICS:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, text):
                x = statistics_of(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in kept), *(pa.array(c) for c in x.T)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


#: A rule: (statistic, is above, threshold) of every comparison.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Model:
    rules: list[Rule] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    constant: float | None = None


def grow(codes: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree on binned statistics: the rule of every node below the root, and the fitted value of each row."""
    rules, value = [], np.zeros(len(codes))

    def split(rows: np.ndarray, path: Rule) -> None:
        value[rows] = residual[rows].sum() / (weight[rows].sum() + 1e-3)
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-6, 0, 0)
        whole = residual[rows].sum() ** 2 / (weight[rows].sum() + 1e-3)
        for j in range(codes.shape[1]):
            if not len(cuts[j]):
                continue
            c = codes[rows, j]
            g, h, m = (np.cumsum(np.bincount(c, v, len(cuts[j]) + 1))[:-1] for v in (residual[rows], weight[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1e-3) + (residual[rows].sum() - g) ** 2 / (weight[rows].sum() - h + 1e-3) - whole
            gain[(m < LEAF) | (len(rows) - m < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[0] <= 1e-6:
            return
        _, j, k = best
        for above in (False, True):
            rule = (*path, (j, above, float(cuts[j][k])))
            rules.append(rule)
            split(rows[(codes[rows, j] > k) == above], rule)

    split(np.arange(len(codes)), ())
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the log loss with an L1 penalty; the constant is free."""
    x = np.hstack([np.ones((len(r), 1)), r])
    bound = 0.25 * np.linalg.norm(x, 2) ** 2 / len(x)
    w, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - x.T @ (p - y) / len(x) / bound
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / bound, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """Rules of boosted trees, duplicates removed, and their weights under the penalty that suits the rows kept apart."""
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rules, value = grow(codes, cuts, y - p, p * (1 - p))
        for rule in rules:
            found.setdefault(frozenset(rule), rule)
        score += SHRINK * np.clip(value, -4, 4)
    unique = {}
    for rule in found.values():
        mask = holds(rule, x)
        unique.setdefault(mask.tobytes(), (rule, mask))
    rules = [r for r, _ in unique.values()]
    matrix = np.stack([m for _, m in unique.values()], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    apart = np.random.default_rng(seed).random(len(y)) < 0.2
    best = None
    for penalty in PENALTIES:
        b, w = lasso(matrix[~apart], y[~apart], penalty)
        p = 1 / (1 + np.exp(-np.clip(matrix[apart] @ w + b, -30, 30)))
        loss = -np.mean(np.log(np.maximum(np.where(y[apart] == 1, p, 1 - p), 1e-12)))
        if best is None or loss < best[0]:
            best = (loss, penalty)
    b, w = lasso(matrix, y, best[1])
    some = np.flatnonzero(w)
    return Model([rules[i] for i in some], w[some], b)


def fit(stats: DataFrame, labels: DataFrame, held: Column, rows: int = TRAIN_ROWS) -> Model:
    """Model of up to ``rows`` labelled documents that are not held out; ``stats`` holds doc_id and STATISTICS."""
    sample = labelled_sample(labels, "quality", held, rows)
    stats = stats.select("doc_id", *STATISTICS)  # other columns may have the names of the sample's
    got = stats.join(sample, stats["doc_id"] == sample["train_id"]).select(*STATISTICS, F.col("label").cast("double")).toPandas().to_numpy(float)
    got = got[np.lexsort(got.T)]  # the same order on every run
    return train(got[:, :-1], (got[:, -1] == 1).astype(float))


def compiled(model: Model) -> Column:
    """The score as an expression over STATISTICS."""
    if model.constant is not None:
        return F.lit(model.constant)
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights.tolist(), strict=True):
        test = F.lit(True)
        for j, above, cut in rule:
            test = test & ((F.col(STATISTICS[j]) > cut) if above else (F.col(STATISTICS[j]) <= cut))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
