"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least k-gram hash of each run of ``w`` consecutive k-grams, k + w - 1 = window.
Two texts that share ``window`` words share all the k-grams of one run there, and so its least: no shared window is
missed. Documents meet benchmark items on their fingerprints; each hit is extended word by word to both sides,
as far as a window reaches, and counts if at least ``window`` words agree. An item shorter than a window is a
window of its own, met on the hash of all its words.

Everything is DataFrame functions. Fingerprints travel as (text digest, hash) rows, so copies count once; only texts
that have a hit are fingerprinted again with the places, and the words around a hit travel only from there. All of it is
linear in the length of a text. Whether a side is broadcast is left to the planner, which checks its size.

Edge cases: null texts and texts without words are clean; items without words are ignored; rows that repeat a
document are judged each, alike; rows that repeat an item count once; an empty benchmark leaves all clean; columns
that clash with names used here are carried untouched, but for those that ``report`` adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .rules import let, lowered

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of other characters beyond ASCII."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-grams, in order."""
    at = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) < k, F.array().cast("array<long>")).otherwise(at)


def fingerprints(words: Column, k: int, w: int) -> Column:
    """Distinct winnowed k-gram hashes; all of a text with fewer than ``w`` k-grams gives its least."""
    if w == 1:
        return let(words, lambda x: F.array_distinct(_grams(x, k)))

    def least(g: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i, w)))
        return F.when(F.size(g) == 0, g).otherwise(F.array_distinct(runs))

    return let(words, lambda x: let(_grams(x, k), least))


def placed(words: Column, k: int, w: int) -> Column:
    """(h, at): the winnowed k-grams with their places; of equal ones in a run the first."""

    if w == 1:
        return let(words, lambda x: F.transform(_grams(x, k), lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def least(g: Column) -> Column:
        # places are distinct as numbers: distinct structs would take square time
        first = lambda i: let(F.slice(g, i + 1, w), lambda run: i + F.array_position(run, F.array_min(run)).cast("int") - 1)
        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(g) - w, F.lit(0))), first))
        none = F.array().cast("array<struct<h:bigint,at:int>>")
        return F.when(F.size(g) == 0, none).otherwise(F.transform(places, lambda i: F.struct(F.get(g, i).alias("h"), i.alias("at"))))

    return let(words, lambda x: let(_grams(x, k), least))


def _agree(a: Column, i: Column, b: Column, j: Column, step: int, most: int) -> Column:
    """How many words agree from places i and j on, in steps of +1 or -1, up to ``most``."""
    same = [F.coalesce(F.get(a, i + step * d) == F.get(b, j + step * d), F.lit(False)) for d in range(most)]
    out = F.lit(most)
    for d in range(most - 1, -1, -1):
        out = F.when(~same[d], F.lit(d)).otherwise(out)
    return out


def _met(texts: DataFrame, items: DataFrame, k: int, w: int, whole: bool) -> DataFrame:
    """(digest, item_id, begin, end): word spans of ``texts`` (digest, text) that windows of ``items`` (item_id, words) cover.

    ``whole``: all items have k words, and each is one window.
    """
    window = k + w - 1
    ctx = window - k
    marks = items.select("item_id", "words", F.explode(placed(F.col("words"), k, w)).alias("s"))
    known = checkpoint(marks.select("s.h").distinct())
    probes = texts.select("digest", F.explode(fingerprints(words_of(F.col("text")), k, w)).alias("h"))
    hits = probes.join(known, "h", "left_semi").select("digest").distinct()

    def around(words: Column, s: Column) -> Column:
        """A k-gram with the words beside it."""
        near = F.slice(words, F.greatest(s["at"] - ctx, F.lit(0)) + 1, F.least(s["at"], F.lit(ctx)) + k + ctx)
        return F.struct(s["h"].alias("h"), s["at"].alias("at"), F.least(s["at"], F.lit(ctx)).alias("c"), near.alias("near"))

    # hits are rebalanced, so that both sides are shuffled for the join and hot texts can be split
    hit = checkpoint(texts.join(hits.hint("rebalance"), "digest").dropDuplicates(["digest"]))
    spots = hit.select("digest", F.explode(placed(words_of(F.col("text")), k, w)).alias("s")).select("digest", "s.h", "s.at").join(known, "h", "left_semi")
    spots = spots.groupBy("digest").agg(F.collect_list(F.struct("h", "at")).alias("spots"))
    there = hit.join(spots, "digest").select("digest", F.explode(let(words_of(F.col("text")), lambda x: F.transform("spots", lambda s: around(x, s)))).alias("s")).select("digest", "s.*")
    here = items.select("item_id", F.explode(let(F.col("words"), lambda x: F.transform(placed(x, k, w), lambda s: around(x, s)))).alias("s"))
    here = here.select("item_id", "s.h", F.col("s.c").alias("ic"), F.col("s.near").alias("inear"))
    both = there.join(here, "h")
    left = _agree(F.col("near"), F.col("c") - 1, F.col("inear"), F.col("ic") - 1, -1, ctx)
    right = _agree(F.col("near"), F.col("c") + k, F.col("inear"), F.col("ic") + k, 1, ctx)
    core = F.slice("near", F.col("c") + 1, k) == F.slice("inear", F.col("ic") + 1, k)
    both = both.where(core).select("digest", "item_id", "at", left.alias("l"), right.alias("r"))
    return both.where(F.col("l") + F.col("r") + k >= window).select("digest", "item_id", (F.col("at") - F.col("l")).alias("begin"), (F.col("at") + k + F.col("r")).alias("end"))


def _spans(docs: DataFrame, benchmark: DataFrame, window: int, k: int, text_col: str, item_col: str) -> DataFrame:
    """(digest, spans, items): for each distinct text (by MD5) with a hit, its sorted hit spans and the items' names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.md5(text).alias("digest"), text.alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    out = _met(texts, items.where(F.size("words") >= window), k, window - k + 1, False)
    # lengths below the window: at most window - 1 values, whatever the benchmark's size
    for (n,) in items.where(F.size("words") < window).select(F.size("words")).distinct().collect():
        out = out.unionByName(_met(texts, items.where(F.size("words") == n), n, 1, True))
    return out.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def covered(spans: Column) -> Column:
    """How many words sorted spans cover."""

    def add(a: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(s["begin"], a["to"]), F.lit(0))
        return F.struct((a["n"] + more).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to"))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), add, lambda a: a["n"])


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(digest, n_hit, items): for each distinct text (by MD5) with a hit, its hit words and the items."""
    return _spans(docs, benchmark, window, k, text_col, item_col).select("digest", covered(F.col("spans")).alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, share: int = 20, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the text, with n_words, n_hit, n_items, items (sorted strings) and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    added = ("n_words", "n_hit", "items", "n_items", "contaminated")
    others = [c for c in docs.columns if c != text_col and c not in added]
    rows = docs.select(F.struct(F.lit(0), *others).alias("row"), F.md5(text).alias("of"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    hits = overlaps(docs, benchmark, window, k, text_col, item_col)
    out = rows.join(hits.hint("rebalance"), F.col("of") == F.col("digest"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    verdict = (n_hit > 0) & (share * n_hit >= F.col("n_words"))
    return out.select(*(F.col("row")[c].alias(c) for c in others), "n_words", n_hit.alias("n_hit"), items.alias("items"), F.size(items).cast("long").alias("n_items"), verdict.alias("contaminated"))


def without(text: Column, spans: Column) -> Column:
    """A text without the words of sorted ``spans`` and what stands before each of them."""
    between = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # of texts that aren't lower-cased yet
    words = F.regexp_extract_all(text, F.lit(f"[{between}]*+[^{between}]++"), F.lit(0))
    tail = F.regexp_extract(text, rf"(?<![{between}])[{between}]*+\z", 0)

    def merge(a: Column, s: Column) -> Column:
        begin = F.greatest(s["begin"], a["to"])
        return F.struct(F.concat(a["cut"], F.array(F.struct(a["to"].alias("lo"), begin.alias("hi")))).alias("cut"), F.greatest(s["end"], a["to"]).alias("to"))

    start = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("cut"), F.lit(0).alias("to"))
    held = F.aggregate(spans, start, merge)

    def left(w: Column) -> Column:
        kept = let(held, lambda a: F.concat(a["cut"], F.array(F.struct(a["to"].alias("lo"), F.size(w).alias("hi")))))
        return F.array_join(F.flatten(F.transform(kept, lambda s: F.slice(w, s["lo"] + 1, F.greatest(s["hi"] - s["lo"], F.lit(0))))), "")

    return F.concat(let(words, left), tail)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, share: int | None = 20, cut: bool = False, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated: share * n_hit < n_words, or with ``share`` None, no hit at all.

    With ``cut``, the rows that stay lose the words of their hits.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.md5(text).alias("of"))
    held = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    found = _spans(docs, benchmark, window, k, text_col, item_col).select("digest", "spans")
    if share is None:
        return whole.join(found.select("digest").hint("rebalance"), F.col("of") == F.col("digest"), "left_anti").select("row.*")
    out = whole.join(found.hint("rebalance"), F.col("of") == F.col("digest"), "left")
    out = out.where(F.col("spans").isNull() | (share * covered(F.col("spans")) < F.size(words_of(held))))
    left = F.when(F.col("spans").isNotNull(), without(held, F.col("spans")))
    return out.select(*(F.coalesce(left, F.col("row")[c]).alias(c) if cut and c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
