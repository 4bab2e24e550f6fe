"""Toxicity: a noisy channel restores disguised words, then the restored text is scored.

A character language model (four letters, all documents) and a channel of leetspeak, stray signs, spacing and repetition
span a lattice over each disguised token of any length; the Viterbi path is what the writer meant, words apart. Labels teach which words and word
beginnings are found in toxic documents and not in others, and a logistic model over a document's worst ones gives the score.

Null and empty texts have no words and get the score of a document without any sign of toxicity. Texts are read whole, by
one row at a time. Repeated rows get equal scores. Without labels of both kinds the score is the share of
toxic labels, 0 if there is none. Empty tables and further columns are allowed; output columns replace columns of their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.sampling import held_out, labelled_sample
from tripweave.sources.storage import stage, unstage

#: Labelled documents that the model is fitted on.
TRAIN_ROWS = 20_000
#: Toxic documents that a word or beginning must be in to be a sign.
SUPPORT = 3
#: Signs that a task counts before it hands them on.
FLUSH = 1_000_000
#: Bytes of a word's beginnings, and the least log odds of a sign.
BEGIN, LEAST = range(4, 10), 1.5
#: Letters of the language model: 0 stands between words, 1 to 26 are a to z, 27 is a byte of any other letter.
LETTERS = 28
_ORDER = 4
_CODE = np.array([b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0 for b in tx.LOWER.tolist()], np.int64)

# fixed values: letters that a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
#: Costs in nats: reading a sign as a letter, dropping a sign, halving a double letter, shortening a longer run, ending a word.
SIGN, DROP, HALVE, SHORTEN, GAP = 0.5, 2.5, 3.0, 0.5, 1.0
#: Letters of a token whose decoding is remembered; longer ones are decoded each time.
REMEMBERED = 40

_LETTER = tx.byte_set((97, 122), (128, 255))
_BREAK = np.isin(np.arange(256), np.frombuffer(b".-_", np.uint8))
_READ = np.isin(np.arange(256), np.frombuffer(b"0123456789@$!|+(*#", np.uint8))
_GAP = np.isin(np.arange(256), np.frombuffer(b" .-_*", np.uint8))
_TOKEN = r"[\w@$!|+(*#.\-]"
_DISGUISED = re.compile(
    r"(?<![^\W_])(?:[^\W\d_][ .\-_*]+){3,}[^\W\d_](?![^\W_])"  # i d i o t
    # a word with a sign before two letters, after a letter at any place or between two, or with one letter three times
    rf"|(?<!{_TOKEN})(?={_TOKEN}*?(?:[0-9@$!|+(*#](?=[^\W\d_]{{2}})|[^\W\d_](?:[.\-_]*[0-9@$!|+(*#]|[.\-_]+[^\W_])|([^\W\d_])\1\1)){_TOKEN}+"
)
_SPACED = re.compile(r"(?:[^\W\d_][ .\-_*]+){3,}[^\W\d_]")
_SPACED_RUN = re.compile(r"[ .\-_*]+|(.)\1*", re.S)
_RUN = re.compile(r"[.\-_]+|(.)\1*", re.S)


def letter_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(gram, n): how often each run of four letters occurs in all texts; at most LETTERS ** 4 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**_ORDER, np.int64)
        for batch in batches:
            for _, _, data, offsets in tx.pieces(batch, column):
                # texts lie side by side, with the gap between words at every edge
                code = np.insert(_CODE[data], offsets[:-1], 0)
                code = np.concatenate([[0, 0, 0], code, [0]])
                code = code[np.concatenate([[True, True], (code[2:] != 0) | (code[1:-1] != 0) | (code[:-2] != 0)])]
                gram = ((code[:-3] * LETTERS + code[1:-2]) * LETTERS + code[2:-1]) * LETTERS + code[3:]
                total += np.bincount(gram, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    return docs.select(column).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(letter | three before), shape (LETTERS,) * 4, each order smoothed with the next shorter one."""
    seen = np.zeros(LETTERS**_ORDER)
    for row in counts.toLocalIterator():
        seen[row.gram] = row.n
    seen = seen.reshape((LETTERS,) * _ORDER)
    chance = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, _ORDER + 1):
        count = seen.sum(axis=tuple(range(_ORDER - order)))
        chance = (count + 5 * chance) / (count.sum(-1, keepdims=True) + 5)
    return np.log(chance).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised tokens; remembers a bounded number of them."""

    def __init__(self, chance: np.ndarray):
        self.chance, self.known = chance, {}

    def restore(self, text: str) -> str:
        return _DISGUISED.sub(self._match, text)

    def _match(self, found: re.Match[str]) -> str:
        token = found[0]
        core = token.strip(".-_")  # what ends a sentence
        at = token.index(core)
        return token[:at] + self.decode(core) + token[at + len(core) :]

    def decode(self, token: str) -> str:
        if len(token) > REMEMBERED:
            return self._viterbi(token)
        if len(self.known) > 50_000:
            self.known.clear()
        if token not in self.known:
            self.known[token] = self._viterbi(token)
        return self.known[token]

    def _steps(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of one character, or of separators, what it may stand for and what that costs; what is no letter ends a word."""
        spaced = bool(_SPACED.fullmatch(token))
        wide = min(map(len, re.findall(r"[ .\-_*]+", token))) if spaced else 0
        for run in (_SPACED_RUN if spaced else _RUN).finditer(token):
            whole, c = run[0], run[0][0]
            n = len(whole)
            if c.isalpha():
                yield [(c, SHORTEN if n > 2 else HALVE), (c * 2, SHORTEN if n > 2 else 0.0)] if n > 1 else [(c, 0.0)]
            elif spaced and c in " .-_*":  # wider than elsewhere in the token: between words
                yield [("", 0.0 if n == wide else GAP), (" ", GAP if n == wide else 0.0)]
            else:
                drop = DROP if not c.isdigit() else 2 * DROP
                yield [(x * k, SIGN * n) for x in LEET.get(c, "") for k in {1, min(n, 2)}] + [("", drop), (whole, drop)]

    def _viterbi(self, token: str) -> str:
        # a path is (path before, letters), so that paths share what they have in common
        best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for step in self._steps(token):
            after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for state, (score, path) in best.items():
                for letters, cost in step:
                    s, now = state, score - cost
                    for c in letters if letters[:1].isalpha() else letters[:1]:
                        code = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                        now += float(self.chance[s][code])
                        s = (s[1], s[2], code)
                    if s not in after or now > after[s][0]:
                        after[s] = (now, (path, letters) if letters else path)
            best = after
        path = max(((score + float(self.chance[s][0]), path) for s, (score, path) in best.items()), key=lambda x: x[0])[1]
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals of Latin-1 in lower case."""
    data = tx.LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    return data


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a disguised token: all that ``_DISGUISED`` finds has one of these marks, whatever else is in the text."""
    n = len(data)
    letter, read = _LETTER[data], _READ[data]
    found = np.zeros(n, bool)
    if n > 1:  # a sign after a letter
        found[1:] |= letter[:-1] & read[1:]
    if n > 2:  # a sign before two letters, one letter three times
        found[2:] |= read[:-2] & letter[1:-1] & letter[2:]
        found[2:] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    for width, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((data[: max(0, n - 3 * width + 1)] >= low) & (data[: max(0, n - 3 * width + 1)] < high))
        for k in range(2 * width):
            at = at[data[at + k] == data[at + k + width]]
        found[at] = True
    # any number of separators between a letter and a letter, digit or sign
    edge = np.diff(np.concatenate([[False], _BREAK[data], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = (starts > 0) & (ends < n)
    starts, ends = starts[inner], ends[inner]
    found[starts] |= letter[starts - 1] & (letter | read)[ends]
    # four letters with nothing but gaps between: the two in the middle stand alone
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) > 3:
        size = ends - starts
        alone = (size == 1) | (size <= 4) & (data[starts] >= 0xC2)
        others = np.concatenate([[0], np.cumsum(~_GAP[data])])
        apart = others[starts[1:]] == others[ends[:-1]]
        found[starts[1:-2]] |= apart[:-2] & apart[1:-1] & apart[2:] & alone[1:-2] & alone[2:-1]
    before = np.concatenate([[0], np.cumsum(found)])
    return before[offsets[1:]] > before[offsets[:-1]]


def restored(batch: pa.RecordBatch, column: str, read: Restorer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[int, str]]]:
    """(first row, end row, folded bytes, offsets, changed texts by row) with the disguised tokens of every text restored."""
    for low, high, data, offsets in tx.pieces(batch, column):
        data = fold(data)
        changed: dict[int, str] = {}
        for i in np.flatnonzero(suspicious(data, offsets)).tolist():
            before = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            after = read.restore(before)
            if after != before:
                changed[i] = after
        if changed:
            parts = [changed[i].encode() if i in changed else data[offsets[i] : offsets[i + 1]].tobytes() for i in range(high - low)]
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        yield low, high, data, offsets, changed


def signs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, sign) by hash: first every word as a whole, then the beginnings of words that are as long."""
    starts, ends, bounds = tx.spans(data, offsets, _LETTER)
    row, word = tx.row_of(bounds), tx.hash_spans(data, starts, ends)
    yield row, word, tx.mix(word ^ np.uint64(1))
    for n in BEGIN:
        long = np.flatnonzero(ends - starts >= n)
        yield row[long], word[long], tx.mix(tx.hash_spans(data, starts[long], starts[long] + n) ^ np.uint64(n << 8))


@dataclass
class Model:
    chance: np.ndarray
    #: Sorted hashes of the signs, and in how many toxic and other documents of how many each was found.
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bad: np.ndarray = field(default_factory=lambda: np.zeros(0))
    good: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n_bad: int = 0
    n_good: int = 0
    logit: np.ndarray = field(default_factory=lambda: np.zeros(4))
    #: Score of every document where there was nothing to learn from.
    constant: float | None = None

    def odds(self, without: int | None = None) -> np.ndarray:
        """Log odds of the signs; ``without`` leaves one document of that label out, as for a document that was counted."""
        bad, good = self.bad - (without == 1), self.good - (without == 0)
        n_bad, n_good = self.n_bad - (without == 1), self.n_good - (without == 0)
        value = np.log((bad + 0.2) / (n_bad + 0.4)) - np.log((np.maximum(good, 0) + 0.2) / (n_good + 0.4))
        return np.where((bad >= SUPPORT) & (value > LEAST), value, 0.0)


def evidence(data: np.ndarray, offsets: np.ndarray, model: Model, labels: list[int] | None = None) -> np.ndarray:
    """By text: 1, the worst sign's log odds, the sum of the worst five, and the log of their count; of each word its worst sign."""
    tables = [model.odds()] if labels is None else [model.odds(0), model.odds(1)]
    worst: dict[tuple[int, int], float] = {}
    if len(model.keys):
        for row, word, sign in signs(data, offsets):
            at = np.minimum(np.searchsorted(model.keys, sign), len(model.keys) - 1)
            hit = np.flatnonzero(model.keys[at] == sign)
            for r, w, k in zip(row[hit].tolist(), word[hit].tolist(), at[hit].tolist(), strict=True):
                value = tables[labels[r] if labels else 0][k]
                if value > worst.get((r, w), 0.0):
                    worst[r, w] = value
    of: dict[int, list[float]] = {}
    for (r, _), value in worst.items():
        of.setdefault(r, []).append(value)
    out = np.zeros((len(offsets) - 1, 4))
    out[:, 0] = 1
    for r, values in of.items():
        values.sort(reverse=True)
        out[r, 1:] = values[0], sum(values[:5]), math.log1p(len(values))
    return out


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised log loss; the first column is the constant and is not penalised."""
    w, penalty = np.zeros(x.shape[1]), np.array([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_signs(sums: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """Of all (sign, bad, good), the signs of ``SUPPORT`` toxic documents or more whose log odds are above ``LEAST``; as many as the sample has."""
    odds = F.log((F.col("bad") + 0.2) / (n_bad + 0.4)) - F.log((F.col("good") + 0.2) / (n_good + 0.4))
    fit_for = sums.withColumn("odds", odds).filter((F.col("bad") >= SUPPORT) & (F.col("odds") > LEAST))
    return fit_for


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Language model over all documents; signs and weights from up to ``rows`` labelled documents that are not held out."""
    model = Model(language_model(letter_counts(docs)))
    sample = labelled_sample(labels, "toxic", held_out(4, 2), rows)
    texts = docs.select("doc_id", "text")  # other columns may have the names of the sample's
    chosen = texts.join(sample, texts["doc_id"] == sample["train_id"]).select("text", (F.col("label") == 1).cast("int").alias("label"))
    chosen = stage(chosen, "toxicity-sample")
    chance = model.chance

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen, total = Restorer(chance), (Counter(), Counter()), [0, 0]

        def flush() -> pa.RecordBatch:
            names = np.array([*(seen[0] | seen[1])], np.uint64)
            out = [
                pa.array([*names.view(np.int64).tolist(), None], pa.int64()),
                pa.array([*(seen[1][s] for s in names.tolist()), total[1]], pa.int64()),
                pa.array([*(seen[0][s] for s in names.tolist()), total[0]], pa.int64()),
            ]
            seen[0].clear(), seen[1].clear()
            total[:] = 0, 0
            return pa.RecordBatch.from_arrays(out, ["sign", "bad", "good"])

        for batch in batches:
            label = np.array(batch.column("label").to_pylist())
            for low, high, data, offsets, _ in restored(batch, "text", read):
                kinds = label[low:high]
                row, sign = (np.concatenate(x) for x in zip(*((r, s) for r, _, s in signs(data, offsets)), strict=True))
                pair = np.unique(np.stack([row.astype(np.uint64), sign]), axis=1)
                for kind in (0, 1):
                    value, n = np.unique(pair[1][kinds[pair[0].astype(np.int64)] == kind], return_counts=True)
                    seen[kind].update(dict(zip(value.tolist(), n.tolist(), strict=True)))
                    total[kind] += int((kinds == kind).sum())
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        yield flush()

    sums = chosen.mapInArrow(count, "sign long, bad long, good long").groupBy("sign").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = stage(sums.filter((F.col("bad") >= SUPPORT) | F.col("sign").isNull()), "toxicity-signs")
    for row in sums.filter("sign is null").collect():
        model.n_bad, model.n_good = row.bad, row.good
    if not model.n_bad or not model.n_good:
        model.constant = model.n_bad / max(1, model.n_bad + model.n_good)
        unstage(sums, chosen)
        return model
    best = best_signs(sums.filter("sign is not null"), model.n_bad, model.n_good).collect()
    unstage(sums)
    keys = np.array([r.sign for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    got = np.array([(r.bad, r.good) for r in best], float).reshape(-1, 2)[order]
    model.keys, model.bad, model.good = keys[order], got[:, 0], got[:, 1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(chance)
        for batch in batches:
            label = batch.column("label").to_pylist()
            for low, high, data, offsets, _ in restored(batch, "text", read):
                x = evidence(data, offsets, model, label[low:high])
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(label[low:high], pa.int32())], ["x", "label"])

    got = chosen.mapInArrow(gather, "x array<double>, label int").collect()
    model.logit = fit_logit(np.array([r.x for r in got]), np.array([float(r.label) for r in got]))
    unstage(chosen)
    return model


def score(docs: DataFrame, model: Model, restored_as: str | None = None) -> DataFrame:
    """``docs`` with ``score``, and on request the restored text in lower case."""
    added = ["score"] + [restored_as] * bool(restored_as)
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add("score", "double")
    schema = schema.add(restored_as, "string") if restored_as else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Restorer(model.chance)
        for batch in batches:
            for low, high, data, offsets, _ in restored(batch, "text", read):
                if model.constant is None:
                    value = 1 / (1 + np.exp(-np.clip(evidence(data, offsets, model) @ model.logit, -30, 30)))
                else:
                    value = np.full(high - low, model.constant)
                out = [*(batch.column(c).slice(low, high - low) for c in kept), pa.array(value)]
                if restored_as:
                    out.append(pa.array([data[i:j].tobytes().decode() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, schema.fieldNames())

    return docs.mapInArrow(run, schema)
