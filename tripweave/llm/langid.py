"""Language of texts: averaged embeddings of hashed subwords and a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 2, 3 and 4 bytes of the text in lower case, with everything but letters as one gap. A document is the mean of its
subwords' embeddings. Training reads at most PER_LANGUAGE documents of each language; a part of them is kept for
calibration: a temperature makes the confidence honest, and a confidence below the level that nearly all right answers reach is rejected.

A text that is null or has no letter is ``und`` with score 0; so is every text when nothing could be learned. Whole texts are read.
Repeated rows get equal answers; empty tables and further columns are allowed, output columns replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.llm.toxicity import fold

#: Training documents of a language, of which CALIBRATE are kept apart.
PER_LANGUAGE, CALIBRATE = 500, 0.2
BUCKETS, WIDTH, ORDERS = 1 << 14, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 5, 32, 0.2
#: Share of the right answers that a rejection may cost.
REJECT_RIGHT = 0.005
_LETTER = tx.byte_set((97, 122), (128, 255))
_ASCII_LETTER = tx.byte_set((97, 122))


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: the bucket of every run of bytes, and the texts' bounds among them."""
    data = fold(data)
    keep = _LETTER[data]
    again = np.zeros(len(data), bool)  # a gap after a gap in the same text
    if len(data):
        again[1:] = ~keep[1:] & ~keep[:-1]
        again[offsets[:-1][offsets[:-1] < len(data)]] = False
    code = np.where(keep, data, 32)[~again].astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(~again)])[offsets]
    for n in ORDERS:
        if len(code) < n:
            yield np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
            continue
        h = np.full(len(code) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ code[j : j + len(h)]) * np.uint32(0x01000193)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        inside = tx.starts_within(bounds, n, len(code))[: len(h)]
        yield (h >> np.uint32(32 - 14))[inside].astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[np.minimum(bounds, len(h))]


@dataclass
class Model:
    languages: list[str]
    #: Contribution of a subword to each language: embeddings times weights.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        count = np.zeros(len(offsets) - 1)
        for bucket, bounds in subwords(data, offsets):
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                for k in range(len(self.languages)):
                    total[some, k] += np.add.reduceat(self.table[k][bucket], bounds[:-1][some])
                count += np.diff(bounds)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def training_rows(docs: DataFrame, held: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, buckets, shares): sparse subword frequencies of about ``per_language`` documents of each language."""
    known = docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, per_language / n)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(draw < share[F.col("lang")]).limit(2 * per_language * len(counts)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, "text"):
                parts = list(subwords(data, offsets))
                rows = []
                for i in range(high - low):
                    found, n = np.unique(np.concatenate([b[o[i] : o[i + 1]] for b, o in parts]), return_counts=True)
                    rows.append((found.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(low, high - low), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                    ["lang", "buckets", "shares"],
                )

    return chosen.mapInArrow(run, "lang string, buckets binary, shares binary")


def train(rows: list[tuple[str, bytes, bytes]], seed: int = 7) -> Model:
    """Stochastic gradient descent on embeddings and softmax weights, then calibration on the rows kept apart."""
    pick = np.random.default_rng(seed)
    rows = [(lang, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for lang, b, s in sorted(rows)]
    languages = sorted({r[0] for r in rows})
    y = np.array([languages.index(r[0]) for r in rows])
    order = pick.permutation(len(rows))
    apart = order[: int(CALIBRATE * len(rows))]
    learn = order[len(apart) :] if len(order) > len(apart) else order
    embed = pick.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps = EPOCHS * -(-len(learn) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        learn = pick.permutation(learn)
        for at in range(0, len(learn), BATCH):
            some = learn[at : at + BATCH]
            used, place = np.unique(np.concatenate([rows[i][1] for i in some]), return_inverse=True)
            x = np.zeros((len(some), len(used)), np.float32)
            x[np.repeat(np.arange(len(some)), [len(rows[i][1]) for i in some]), place] = np.concatenate([rows[i][2] for i in some])
            own = embed[used]
            hidden = x @ own
            z = hidden @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            rate = RATE * (1 - step / steps)
            embed[used] = own - rate * (x.T @ (p @ weight.T)) * 8
            weight -= rate * (hidden.T @ p) / len(some) * 8
            bias -= rate * p.mean(0) * 0.1
            step += 1
    model = Model(languages, np.ascontiguousarray((embed @ weight).T), bias)
    if len(apart):
        z = np.array([[float(model.table[k][rows[i][1]] @ rows[i][2]) for k in range(len(languages))] for i in apart]) + bias
        best = None
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            loss = -np.log(np.maximum(model.probabilities(z)[np.arange(len(apart)), y[apart]], 1e-12)).mean()
            if best is None or loss < best[0]:
                best = (loss, float(t))
        model.temperature = best[1]
        p = model.probabilities(z)
        right = p.argmax(1) == y[apart]
        if right.any():
            model.reject_below = float(np.quantile(p.max(1)[right], REJECT_RIGHT))
    return model


def fit(docs: DataFrame, held: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Model of the ``lang`` labels of rows that are not held out; None where there are none."""
    rows = training_rows(docs, held, per_language)
    got = rows.collect() if rows is not None else []
    return train([tuple(r) for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, text):
                before = np.concatenate([[0], np.cumsum(_ASCII_LETTER[tx.LOWER[data]])])
                spoken = before[offsets[1:]] > before[offsets[:-1]]
                for i in np.flatnonzero(~spoken).tolist():
                    spoken[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
                if model is None:
                    name, score = ["und"] * (high - low), np.zeros(high - low)
                else:
                    p = model.probabilities(model.logits(data, offsets))
                    best = p.argmax(1)
                    name = [model.languages[k] if s else "und" for k, s in zip(best.tolist(), spoken.tolist(), strict=True)]
                    score = np.where(spoken, p.max(1), 0.0)
                rejected = score < (model.reject_below if model else 1.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in kept), pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], schema.fieldNames()
                )

    return docs.mapInArrow(run, schema)
