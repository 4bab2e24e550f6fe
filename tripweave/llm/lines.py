"""Line dedup: repeated runs of whole lines across the corpus, by prefix doubling over line-id sequences.

Every document is a sequence of line ids (lines without a word are passed over). The suffix that starts at a line gets a
rank by its first 1, 2, 4, ... lines; a rank at depth h is the place of the first suffix with these h lines, so suffixes
of equal rank form one interval of common prefix h or more, and the rank at depth 2h comes from the pair of ranks at
depth h, h lines apart. Suffixes whose rank nobody shares leave the next round. Ranks by first place instead of sort order name the same
intervals, and need no window that would hold a line of a third of all rows in one task: only partial minima and joins.

A run counts from ``min_words`` words on. The depth needed is thus at most ``min_words`` lines, whatever the length of the
documents: a maximal repeated run is the union of the shortest sufficient runs from each of its first lines on and up to
each of its last lines, and a run of n lines is named by its two ranks of depth 2^k <= n, at its start and at its end.
Of each repeated run the first copy stays, in the order of doc_id, then text hash, then line; later copies that do not
overlap it are deleted. A line that is deleted always stands further up too.

Null text stays null and an emptied document stays as an empty text. Rows that repeat doc_id and text are one document
and change alike. Null ids, empty tables and further columns are allowed; a name clash with internal columns is not
possible since only doc_id and text are read before the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.sources.storage import stage, unstage

#: A shared passage of so many words is a copy; shorter repeated lines (licenses, headings) are left alone.
MIN_WORDS = 50
_DOC = ["doc_id", "text_key"]


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def word_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, seq, line_no, n_words, a, b): each line with a word, its number among those, and its 128-bit id."""
    lines = F.split("text", "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), line.alias("line"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words")))
    return (
        docs.filter("text is not null")
        .select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        .select(*_DOC, F.posexplode(F.filter(numbered, lambda x: x["n_words"] > 0)).alias("seq", "x"))
        .select(*_DOC, "seq", "x.line_no", "x.n_words", F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(1), "x.line").alias("b"))
        .dropDuplicates([*_DOC, "seq"])
    )


def _place() -> Column:
    return F.struct("doc_id", "text_key", "seq")


def _ranked(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``rows`` whose keys occur twice or more, with the first place of these keys as their rank."""
    names = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.min(_place()).alias("rank")).filter("members > 1").drop("members")
    return rows.join(names, keys).select(*keep, "rank")


def shortest_runs(active: DataFrame, min_words: int) -> DataFrame:
    """Adds, within each stretch of neighbouring repeated lines: ``ahead``, lines from here to reach ``min_words``, ``back``,
    lines up to here, whether the stretch has that many words (``ahead_ok``, ``back_ok``), and ``depth``, the deepest rank
    that a run over this line needs."""
    doc = Window.partitionBy(*_DOC).orderBy("seq")
    stretch = Window.partitionBy(*_DOC, "stretch")
    upto = stretch.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        active.withColumn("stretch", F.col("seq") - F.row_number().over(doc))
        .withColumn("upto", F.sum("n_words").over(upto))
        .withColumn("before", F.col("upto") - F.col("n_words"))
        .withColumn("total", F.sum("n_words").over(stretch))
        .withColumn("ahead", F.count("*").over(stretch.orderBy("before").rangeBetween(0, min_words - 1)).cast("int"))
        .withColumn("back", F.count("*").over(stretch.orderBy("upto").rangeBetween(1 - min_words, 0)).cast("int"))
    )
    depth = F.lit(1)
    h = 2
    while h <= min_words:
        over = (F.col("ahead") >= h) | (F.coalesce(F.lead("back", h - 1).over(stretch.orderBy("seq")), F.lit(0)) >= h)
        depth = F.when(over, F.lit(h)).otherwise(depth)
        h *= 2
    return rows.select(
        *_DOC, "seq", "line_no", "rank", "ahead", "back",
        (F.col("total") - F.col("before") >= min_words).alias("ahead_ok"), (F.col("upto") >= min_words).alias("back_ok"), depth.alias("depth"),
    )


def double(level: DataFrame, h: int) -> DataFrame:
    """Ranks of depth 2h from ranks of depth h, for the suffixes that need and share them."""
    there = level.select(*(F.col(c).alias(f"o_{c}") for c in (*_DOC, "seq")), F.col("rank").alias("second"))
    pairs = (
        level.filter(F.col("depth") >= 2 * h)
        .withColumnRenamed("rank", "first")
        .join(there, F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("text_key") == F.col("o_text_key")) & (F.col("seq") + h == F.col("o_seq")))
        .select(*_DOC, "seq", "depth", "first", "second")
    )
    return _ranked(pairs, ["first", "second"], [*_DOC, "seq", "depth"])


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): for documents with deleted lines, their sorted line numbers."""
    lines = stage(word_lines(docs), "lines")
    first = _ranked(lines, ["a", "b"], [*_DOC, "seq", "line_no", "n_words"])
    rows = stage(shortest_runs(first, min_words), "repeated-lines")
    unstage(lines)
    h, level = 1, rows.select(*_DOC, "seq", "depth", "rank")
    levels, written = [level.withColumn("h", F.lit(1))], []
    while 2 * h <= min_words:
        level = stage(double(level, h), f"ranks-{2 * h}")
        written.append(level)
        h *= 2
        if level.isEmpty():
            break
        levels.append(level.withColumn("h", F.lit(h)))
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.union(more)
    ranks = ranks.select(*(F.col(c).alias(f"r_{c}") for c in (*_DOC, "seq", "h")), "rank")

    runs = (
        rows.filter("ahead_ok").select(*_DOC, "seq", F.col("ahead").alias("n"))
        .union(rows.filter("back_ok").select(*_DOC, (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("n")))
        .distinct()
        .withColumn("h", F.expr("shiftleft(1, cast(floor(log2(n)) as int))"))
    )

    def named(frame: DataFrame, at: Column, name: str) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_key") == F.col("r_text_key")) & (at == F.col("r_seq")) & (F.col("h") == F.col("r_h"))
        return frame.join(ranks.withColumnRenamed("rank", name), on).drop("r_doc_id", "r_text_key", "r_seq", "r_h")

    runs = named(named(runs, F.col("seq"), "head"), F.col("seq") + F.col("n") - F.col("h"), "tail")
    copies = _ranked(runs, ["n", "head", "tail"], [*_DOC, "seq", "n"])
    elsewhere = ~(F.col("rank.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rank.text_key") == F.col("text_key")))
    copies = copies.filter(elsewhere | (F.col("seq") >= F.col("rank.seq") + F.col("n")))
    gone = copies.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")).distinct()
    numbers = rows.select(*(F.col(c).alias(f"l_{c}") for c in (*_DOC, "seq")), "line_no")
    on = F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("text_key") == F.col("l_text_key")) & (F.col("seq") == F.col("l_seq"))
    out = gone.join(numbers, on).groupBy(*_DOC).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    out = stage(out, "deleted-lines")
    unstage(rows, *written)
    return out


def _without(text: Column, gone: Column) -> Column:
    """The lines between the deleted ones, joined again."""
    lines = F.split(text, "\n", -1)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
    until = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    kept = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, before(i) + 2, until(i) - before(i) - 1))
    return F.array_join(F.flatten(kept), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` without the later copies of repeated runs; ``removed`` names a further column with the count of deleted lines."""
    gone = later_copies(docs, min_words).withColumnsRenamed({"doc_id": "gone_doc_id", "text_key": "gone_text_key"})
    d, g = docs.alias("d"), gone.alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.gone_doc_id")) & (F.xxhash64("d.text") == F.col("g.gone_text_key"))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(_without(F.col("d.text"), F.col("g.gone"))).alias("text")
    out = [text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    if removed:
        out.append(F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias(removed))
    # the deletions grow with the documents, so they are not for broadcasting at any size
    return d.join(g.hint("merge"), on, "left").select(*out)
