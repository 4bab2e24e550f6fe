"""Quality rules of documents, and of the hosts that they come from.

Five counts a document feed the rules. A document fails its base rules by itself. By host, the documents that fail are counted rule
by rule: the base rules together and apart, symbols, repeated lines, words of one letter. Every rule has its own beta prior, fitted to all hosts' rates
of that rule (method of moments), which shrinks the rates of hosts with few documents. A host with a shrunk rate above ``reject`` in any
rule takes all its documents with it; the verdict is joined back to them.

Words are runs without white space. Null text has none. Rows without a host (null) share no host: they are judged
alone. Repeated rows are counted and returned as often as they occur. Empty tables give empty results; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm import text as tx
from tripweave.sources.storage import stage

#: Words of a window, least words of a document, per cent of its words in repeated windows at most, shrunk failure rate of a host at most.
WINDOW, LEAST_WORDS, MOST_REPEAT, REJECT = 5, 10, 20, 0.5
#: Words for each symbol and each repeated line, letters of a word on average, at least.
WORDS_A_SYMBOL, WORDS_A_DUP_LINE, LEAST_LETTERS = 10, 20, 2
#: Prior counts where hosts do not differ enough, or are too few, to fit a prior.
WEAK, STRONG = 2.0, 1e6
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a value per position over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of hashes found twice or more in their text, and of those that are not the first."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (owner[order[1:]] == owner[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def counts_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text."""
    starts, ends, bounds = tx.spans(data, offsets, tx.NOT_BLANK)
    words = tx.hash_spans(data, starts, ends)
    letter = (data & 0xC0) != 0x80  # the first byte of a character
    # of every window found twice or more, its words
    owner = tx.row_of(bounds)
    at = np.flatnonzero(tx.starts_within(bounds, WINDOW, len(words)))
    twice, _ = _again(owner[at], tx.runs(words, WINDOW)[at]) if len(at) else (np.zeros(0, bool),) * 2
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    # lines with a word
    l_starts, l_ends, l_bounds = tx.spans(data, offsets, ~tx.byte_set((10, 10)))
    first = np.searchsorted(starts, l_starts)
    wordy = np.flatnonzero((first < np.searchsorted(starts, l_ends)))
    _, later = _again(tx.row_of(l_bounds)[wordy], tx.hash_spans(data, l_starts[wordy], l_ends[wordy]))
    dup = np.zeros(len(l_starts), np.int64)
    dup[wordy[later]] = 1
    return [
        np.diff(bounds), _per_text(letter & tx.NOT_BLANK[data], offsets), _per_text(_SYMBOL[data], offsets),
        _per_text(dup, l_bounds), _per_text(covered, bounds),
    ]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its COUNTS; they replace columns of their names."""
    kept = [c for c in docs.columns if c not in (text, *COUNTS)]
    schema = docs.select(*kept).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.pieces(batch, text):
                values = [pa.array(v.astype(np.int64)) for v in counts_of(data, offsets)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in kept), *values], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Whether a document with COUNTS fails, by rule. A text without words fails only the rules on its number of words."""
    return {
        "base": base_failed(),
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeat_words": 100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"),
        "symbols": WORDS_A_SYMBOL * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": WORDS_A_DUP_LINE * F.col("n_dup_lines") > F.col("n_words"),
        "short_words": F.col("word_chars") < LEAST_LETTERS * F.col("n_words"),
    }


def host_verdicts(judged: DataFrame, host: str, reject: float = REJECT) -> DataFrame:
    """(host, n, failed_<rule>.., rate_<rule>.., rate, host_ok): one row for each host of ``judged``, which has the COUNTS;
    ``rate`` is the greatest of the rules' rates."""
    names = list(rules())
    failed = [F.count(F.when(fails, 1)).alias(f"failed_{r}") for r, fails in rules().items()]
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *failed)
    prior = [F.count("*").alias("hosts"), F.avg(1 / F.col("n")).alias("small")]
    for r in names:
        p = F.col(f"failed_{r}") / F.col("n")
        prior += [(F.sum(f"failed_{r}") / F.sum("n")).alias(f"mean_{r}"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias(f"spread_{r}")]
    found = hosts.agg(*prior).first()  # one row
    rates = {}
    for r in names:
        mean = found[f"mean_{r}"] or 0.0
        strength = prior_strength(found.hosts, mean, found.small, found[f"spread_{r}"])
        rates[f"rate_{r}"] = (F.col(f"failed_{r}") + mean * strength) / (F.col("n") + strength)
    worst = F.greatest(*rates)
    return hosts.withColumns(rates).withColumn("rate", worst).withColumn("host_ok", F.col("rate") <= reject)


def prior_strength(hosts: int, mean: float | None, small: float | None, spread: float) -> float:
    """Prior documents: what binomial noise leaves of the spread between hosts is the prior's variance."""
    if hosts < 2:
        return WEAK
    extra = spread - mean * (1 - mean) * small
    return STRONG if extra <= 0 else min(STRONG, max(WEAK, mean * (1 - mean) / extra - 1))


def apply_rules(docs: DataFrame, host: Column, reject: float = REJECT) -> DataFrame:
    """Counts, ``base_failed``, the host's greatest shrunk ``rate`` and ``kept`` of every document; the text goes. These replace columns of their
    names; all others stay, whatever they are called."""
    kept = [c for c in docs.columns if c not in ("base_failed", "rate", "kept")]
    host_name = tx.free_name("rule_host", docs.columns)
    judged = stage(counted(docs.select(*kept, host.alias(host_name))).withColumn("base_failed", base_failed()), "judged")
    # written, so that its size decides how it is joined
    hosts = stage(host_verdicts(judged, host_name, reject).select("host", "rate", "host_ok"), "hosts")
    j, h = judged.alias("j"), hosts.alias("h")
    verdict = ~F.col("j.base_failed") & F.coalesce("h.host_ok", F.lit(True))
    left = [F.col(f"j.`{c}`") for c in judged.columns if c != host_name]
    return j.join(h, F.col(f"j.`{host_name}`") == F.col("h.host"), "left").select(*left, "h.rate", verdict.alias("kept"))
