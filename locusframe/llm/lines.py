"""Line deduplication over content-defined chunks of lines.

A rolling hash over the hashes of the last written lines chooses chunk boundaries, so an inserted or deleted line shifts
only the chunk that it is in. A boundary lies only after a written line that another written line of its chunk precedes
and two of its text follow, so that every chunk has two written lines or more, but for a text of one written line,
which is a chunk of its own. A chunk that occurs more than once in the corpus stays where it occurs first (by doc_id, then
place) and is removed elsewhere, after its bytes have been compared. No chunk is exempt, so a later copy of a text goes as
a whole, whatever its chunks' shapes.

Occurrences travel as narrow (hash, document, place) rows until a hash is known to repeat; only candidates' bytes
then meet, on the hash, where each is compared with the first occurrence: no pairs within a group. Hashes that
are equal by chance never remove anything.

Edge cases: null texts stay null; a text all of whose chunks are repeats becomes empty; rows equal in doc_id and
text are one document and are treated alike; a null doc_id comes first; extra columns are kept, whatever their names,
but for one named like ``removed_col``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let

_WHITE = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    """32 bits of a line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(text: Column, mean_lines: int = 2, window: int = 2) -> Column:
    """array<struct<text, written>>: a text's chunks in order, which joined by newlines are the text."""
    is_written = lambda x: F.btrim(x, F.lit(_WHITE)) != ""

    def cut(lines: Column) -> Column:
        written = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: is_written(s["x"]))
        hashed = F.transform(written, lambda s: F.struct(s["i"].alias("i"), line_hash(s["x"]).alias("h")))
        return let(hashed, lambda w: let(ends(lines, w), lambda e: parts(lines, e)))

    def ends(lines: Column, w: Column) -> Column:
        rolled = lambda k: sum((F.coalesce(F.get(w, k - j)["h"], F.lit(0).cast("long")) * 31**j for j in range(window)), F.lit(0).cast("long"))
        cuts = lambda k: rolled(k) % mean_lines == 0
        # never at two written lines in a row: of a run of places that would cut, the first does
        inner = F.filter(w, lambda s, k: (k > 0) & (k < F.size(w) - 2) & cuts(k) & ((k == 1) | ~cuts(k - 1)))
        return F.concat(F.transform(inner, lambda s: s["i"]), F.array(F.size(lines) - 1))

    def parts(lines: Column, e: Column) -> Column:
        def part(end: Column, j: Column) -> Column:
            start = F.coalesce(F.get(e, j - 1) + 1, F.lit(0))
            held = F.slice(lines, start + 1, end - start + 1)
            return F.struct(F.array_join(held, "\n").alias("text"), F.size(F.filter(held, is_written)).alias("written"))

        return F.transform(e, part)

    return let(F.split(text, "\n"), cut)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = 2, window: int = 2, removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated chunks taken out of their texts; ``removed_col`` gets the number of written lines that went."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), text.alias("text"))

    places = rows.select("key", "id", F.posexplode(chunked(F.col("text"), mean_lines, window)).alias("place", "c")).where("c.written > 0")
    places = places.select(F.xxhash64("c.text").alias("h"), F.struct("id", "key", "place").alias("spot"))
    first = places.groupBy("h").agg(F.min("spot").alias("first"), F.max("spot").alias("last")).where("first <> last").select("h", "first")
    # each right side is rebalanced, so that both sides are shuffled for the join and hot hashes can be split
    candidates = places.join(first.hint("rebalance"), "h").select("spot.key", "spot.place", "h", (F.col("spot") == F.col("first")).alias("stays"))
    listed = candidates.groupBy("key").agg(F.collect_set(F.struct("place", "h", "stays")).alias("spots"))

    # chunks are made once a text, within the generator
    wanted = let(chunked(F.col("text"), mean_lines, window), lambda c: F.transform("spots", lambda s: F.struct(s["place"].alias("place"), s["h"].alias("h"), s["stays"].alias("stays"), F.get(c, s["place"])["text"].alias("text"))))
    texts = rows.join(listed, "key").select("key", F.explode(wanted).alias("s")).select("key", "s.*")
    kept = texts.where("stays").groupBy("h").agg(F.first("text").alias("kept"))
    gone = texts.where("not stays").join(kept.hint("rebalance"), "h").where("text = kept").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("gone"))

    def rebuilt(chunks: Column) -> Column:
        ends = F.concat("gone", F.array(F.size(chunks)))
        between = lambda e, j: let(F.coalesce(F.get(ends, j - 1) + 1, F.lit(0)), lambda s: F.slice(chunks, s + 1, e - s))
        left = F.flatten(F.transform(ends, between))
        lost = F.aggregate("gone", F.lit(0), lambda a, i: a + F.get(chunks, i)["written"])
        return F.struct(F.array_join(F.transform(left, lambda c: c["text"]), "\n").alias("text"), lost.alias("lost"))

    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("of"))
    held = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    made = F.when(F.col("gone").isNotNull(), let(chunked(held, mean_lines, window), rebuilt))
    out = whole.join(gone, F.col("of") == F.col("key"), "left").select("row", made.alias("made"))
    columns = [F.coalesce("made.text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != removed_col]
    if removed_col:
        columns.append(F.coalesce("made.lost", F.lit(0)).cast("long").alias(removed_col))
    return out.select(*columns)
