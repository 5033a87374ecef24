"""Quality rules: per-document heuristics, then cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for each host, the distinct documents
that hold a line are counted, equal texts once, so that copies don't make each other's lines boilerplate. A
line above both limits (a number of documents, and a share of the host's documents) is removed; a document with
too small a share of its words left is depleted and rejected. ``cleaned`` gives the texts that are left.

The default share is a tenth of a host's distinct documents: site furniture is on most pages of a host, while
families of near copies and quoted passages, which are for other stages, are not.

Everything is DataFrame functions. Texts are read once, into a checkpointed table of measures and line hashes; a
document's verdict depends on its host and its text, so only (host, digest of the text, line hash) rows are shuffled,
and hot hosts and lines are counted in two steps. Lines count as equal if 64 bits of hash are.

Edge cases: a null text has no words and fails; a null host is a host of its own; rows that repeat a document
are judged each, alike; columns that clash with names used here are carried untouched, but for those that ``judged``
adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpoint

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(text: Column) -> Column:
    """``text``, which is used three times, with A-Z lower-cased and nothing else."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def less(text: Column, letters: str) -> Column:
    """``text`` without ``letters``."""
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_in(text: Column) -> Column:
    """The words of a text that isn't null."""
    cut = F.btrim(text, F.lit(_WHITE))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, SPACE_CLASS + "+"))


def _covered(at: Column, width: int) -> Column:
    """How many places sorted window starts cover."""
    n = F.size(at)
    step = lambda x, i: F.when(i + 1 < n, F.least(F.lit(width), F.get(at, i + 1) - x)).otherwise(F.lit(width))
    return F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that are found twice or more."""
    none = F.lit(0).cast("long")

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(F.size(w) < width, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(places(h))))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda at: _covered(at, width))

        return let(ordered, twice)

    return let(words, of)


def _fails(n: Column, again: Column) -> Column:
    return (n < 50) | (100 * again > 50 * n)


#: What ``measured`` adds, and ``judged`` on top of it.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _normal(line: Column) -> Column:
    """A line as it is compared with others: lower-cased (A-Z), white space collapsed."""
    return let(F.btrim(F.regexp_replace(line, SPACE_CLASS + "+", " ")), lowered)


def _read(text: Column) -> dict[str, Column]:
    """``stats`` (n, again), the other measures, and ``lines``: (h, n) of each written line, its hash and words."""

    def stats(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))

    def lines(held: Column) -> Column:
        return F.size(held) - F.size(F.array_distinct(held))

    def line(x: Column) -> Column:
        return let(_normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n")))

    written = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    held = let(written, lambda x: F.struct(lines(x).cast("long").alias("dup"), F.transform(x, line).alias("lines")))
    return {
        "stats": let(words_in(text), stats),
        "word_chars": F.length(less(text, _WHITE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(less(text, SYMBOLS))).cast("long"),
        "held": held,
    }


def _profile(docs: DataFrame, host_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """(row, host, digest, measures, lines) of each row of ``docs``, read once and checkpointed; ``row`` has ``carried``."""
    host, digest = _keys(host_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.lit(0), *carried).alias("row"), host.alias("host"), digest.alias("digest"), *(c.alias(k) for k, c in _read(text).items()))
    return checkpoint(rows.select("row", "host", "digest", F.col("stats.n").alias("n_words"), "word_chars", "n_symbols", F.col("held.dup").alias("n_dup_lines"), F.col("stats.again").alias("n_repeat_words"), _fails(F.col("stats.n"), F.col("stats.again")).alias("base_failed"), F.col("held.lines").alias("lines")))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    others = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.struct(F.lit(0), *others).alias("row"), *(c.alias(k) for k, c in _read(text).items()))
    out = out.select("row", F.col("stats.n").alias("n_words"), "word_chars", "n_symbols", F.col("held.dup").alias("n_dup_lines"), F.col("stats.again").alias("n_repeat_words"), _fails(F.col("stats.n"), F.col("stats.again")).alias("base_failed"))
    return out.select(*(F.col("row")[c].alias(c) for c in others), *MEASURES)


def _keys(host_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\x00null")), F.md5(text)


def _lost(profile: DataFrame, min_documents: int, share: float) -> DataFrame:
    """(host, digest, n_removed, gone) of the texts of each host that hold lines above the limits; ``gone`` has their hashes."""
    texts = profile.select("host", "digest", "lines").dropDuplicates(["host", "digest"])
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_host"))
    distinct = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda s: s["h"]))).alias("h"))
    many = distinct.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_documents)
    many = many.join(hosts, "host").where(F.col("n_docs") >= share * F.col("n_host")).select("host", "h")
    held = texts.select("host", "digest", F.explode("lines").alias("s")).select("host", "digest", "s.h", "s.n")
    return held.join(many.hint("rebalance"), ["host", "h"]).groupBy("host", "digest").agg(F.sum("n").cast("long").alias("n_removed"), F.collect_set("h").alias("gone"))


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_documents: int = 20, share: float = 0.1, min_left: float = 0.3) -> DataFrame:
    """``docs`` without the text, with the measures, n_removed and kept."""
    others = [c for c in docs.columns if c != text_col and c not in (*MEASURES, "n_removed", "kept")]
    rows = _profile(docs, host_col, text_col, others)
    lost = _lost(rows, min_documents, share).select("host", "digest", "n_removed")
    out = rows.drop("lines").join(lost, ["host", "digest"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= min_left * F.col("n_words"))
    return out.select(*(F.col("row")[c].alias(c) for c in others), *MEASURES, "n_removed", kept.alias("kept"))


def cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_documents: int = 20, share: float = 0.1, min_left: float = 0.3, remove: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, without their lines above the limits, where what is left passes too.

    Without ``remove`` the texts of the rows that stay are as they were.
    """
    host, digest = _keys(host_col, text_col)
    rows = _profile(docs, host_col, text_col, [])
    lost = _lost(rows, min_documents, share)
    texts = rows.select("host", "digest", "n_words", "base_failed").dropDuplicates(["host", "digest"]).join(lost, ["host", "digest"], "left")
    rejected = F.col("base_failed") | (F.coalesce(F.col("n_words") - F.col("n_removed") < min_left * F.col("n_words"), F.lit(False)))
    # only what changes or goes is joined to the texts
    marks = texts.select(F.col("host").alias("at"), F.col("digest").alias("sum"), rejected.alias("rejected"), "gone").where("rejected or gone is not null")
    whole = docs.select(F.struct(*docs.columns).alias("row"), host.alias("host"), digest.alias("digest"))
    held = whole.join(marks.hint("rebalance"), (F.col("host") == F.col("at")) & (F.col("digest") == F.col("sum")), "left").where(~F.coalesce("rejected", F.lit(False)))
    if not remove:
        return held.select("row.*")
    text = F.col("row")[text_col].cast("string")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(_normal(x)))), "\n")
    held = held.select("row", F.when(F.col("gone").isNotNull(), left).alias("left"))
    # what is left is measured again only where something went
    passes = F.when(F.col("left").isNull(), True).otherwise(let(words_in(F.col("left")), lambda w: ~_fails(F.size(w), repeated_words(w))))
    columns = [F.coalesce("left", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return held.where(passes).select(*columns)


def accepted(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_documents: int = 20, share: float = 0.1, min_left: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns."""
    return cleaned(docs, host_col, text_col, min_documents, share, min_left, remove=False)
