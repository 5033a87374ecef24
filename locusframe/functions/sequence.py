"""Sequence expressions over strings and index arrays; all run in the JVM.

Letters have fixed indices: DNA A0 C1 G2 T3, proteins 20 letters in order. Unknown letters, and k-mers that contain one, are -1.
A sequence is split into an array once; per-position ``substring`` would scan long strings again and again.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "ACGT"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alphabet(seqtype: str) -> str:
    if seqtype not in ("dna", "protein"):
        raise ValueError(f"unknown sequence type {seqtype}")
    return DNA if seqtype == "dna" else PROTEIN


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper(seq: Column) -> Column:
    """A-Z only, so that the length never changes."""
    return F.translate(seq, _LOWER, _UPPER)


def letter_index(seq: Column, letters: str = DNA) -> Column:
    """array<int> of letter indices, -1 for unknown letters."""
    held = F.split(upper(seq), "")
    return F.when(F.length(seq) == 0, F.array().cast("array<int>")).otherwise(F.transform(held, lambda c: F.when(c == "", -1).otherwise(F.instr(F.lit(letters), c) - 1)))


def kmer_index(index: Column, order: int = 1, size: int = len(DNA)) -> Column:
    """array<int> of k-mer indices, the first letter most significant; -1 where a letter is unknown."""
    if order == 1:
        return index

    def of(ind: Column) -> Column:
        def kmer(i: Column) -> Column:
            digits = [F.get(ind, i + j) for j in range(order)]
            value = sum((d * size ** (order - 1 - j) for j, d in enumerate(digits)), F.lit(0))
            return F.when(F.least(*digits) < 0, -1).otherwise(value).cast("int")

        return F.when(F.size(ind) < order, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(ind) - order), kmer))

    return let(index, of)


def kmers(seq: Column, order: int = 1, seqtype: str = "dna") -> Column:
    letters = alphabet(seqtype)
    return kmer_index(letter_index(seq, letters), order, len(letters))


def one_hot(index: Column, order: int = 1, size: int = len(DNA)) -> Column:
    """array<array<tinyint>>: a one at each k-mer's index, all zeros where it is unknown."""
    slots = F.sequence(F.lit(0), F.lit(size**order - 1))
    return F.transform(index, lambda v: F.transform(slots, lambda j: (v == j).cast("tinyint")))


def letter_counts(seq: Column, letters: str = DNA) -> Column:
    """array<long>: how often each letter occurs, which is the sum of the one-hot encoding over positions, without making it."""
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("long")
    return let(upper(seq), lambda s: F.array(*(count(s, c) for c in letters)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def rc_kmer(kmer: Column, order: int = 1) -> Column:
    """The index of a k-mer's reverse complement; -1 stays."""
    digits = [F.pmod(F.floor(kmer / 4**j), F.lit(4)) for j in range(order)]  # the last letter first
    value = sum(((3 - d) * 4 ** (order - 1 - j) for j, d in enumerate(digits)), F.lit(0))
    return F.when(kmer < 0, kmer).otherwise(value).cast("int")


def rc_kmers(index: Column, order: int = 1) -> Column:
    """The k-mer array of the opposite strand."""
    return F.reverse(F.transform(index, lambda v: rc_kmer(v, order)))


def rc_permutation(order: int) -> list[int]:
    """For each k-mer index, that of its reverse complement: an involution."""
    words = ["".join(p) for p in product(DNA, repeat=order)]
    turned = {w: w.translate(str.maketrans(DNA, DNA[::-1]))[::-1] for w in words}
    place = {w: i for i, w in enumerate(words)}
    return [place[turned[w]] for w in words]


def labels(order: int, seqtype: str = "dna") -> list[str]:
    """All k-mers in index order."""
    return ["".join(p) for p in product(alphabet(seqtype), repeat=order)]


def pad(seq: Column, length: int, fill: str = ".") -> Column:
    """Cut or filled at the end to ``length``."""
    return F.rpad(F.substring(seq, 1, length), length, fill)


def extract(seq: Column, start: Column, end: Column, fill: str = "N") -> Column:
    """Positions [start, end) of a sequence that begins at 0; what lies beyond its end is ``fill``."""
    size = (end - start).cast("int")
    return F.rpad(F.substring(seq, (start + 1).cast("int"), size), size, fill)


def motif_scores(kmer: Column, weights: list[list[float]], order: int = 1) -> Column:
    """array<double>: at each place, the sum of weights[j][k-mer at j]; unknown k-mers add nothing."""
    width = len(weights)
    table = [F.array(*(F.lit(float(x)) for x in row)) for row in weights]

    def at(k: Column, i: Column) -> Column:
        return sum((F.coalesce(F.get(table[j], F.get(k, i + j)), F.lit(0.0)) for j in range(width)), F.lit(0.0))

    return let(kmer, lambda k: F.when(F.size(k) < width, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(k) - width), lambda i: at(k, i))))


def scan_both_strands(kmer: Column, weights: list[list[float]], order: int = 1, merge: str | None = "max") -> Column:
    """Motif scores on both strands: merged by 'max' or 'ave', or as struct<forward, reverse> for 'concat' and None."""
    if merge not in ("max", "ave", "concat", None):
        raise ValueError(f"unknown merge mode {merge}")
    turn = rc_permutation(order)
    opposite = [[row[turn[i]] for i in range(len(row))] for row in reversed(weights)]
    forward, reverse = motif_scores(kmer, weights, order), motif_scores(kmer, opposite, order)
    if merge == "max":
        return F.zip_with(forward, reverse, lambda a, b: F.greatest(a, b))
    if merge == "ave":
        return F.zip_with(forward, reverse, lambda a, b: (a + b) / 2)
    return F.struct(forward.alias("forward"), reverse.alias("reverse"))


def scan_summary(seq: Column, weights: list[list[float]], merge: str = "max", block: int = 1 << 20) -> Column:
    """struct<best, total>: the greatest and the sum of ``scan_both_strands`` over a DNA sequence, for motifs of single letters.

    Arrow batches and NumPy, as arrays of scores a place are never needed; ``block`` places at a time, however long a sequence is.
    A sequence shorter than the motif has no best score and a total of 0.
    """
    import numpy as np
    import pyarrow as pa

    if merge not in ("max", "ave"):
        raise ValueError(f"unknown merge mode {merge}")
    turn = rc_permutation(1)
    forward = np.zeros((len(weights), 5))  # the last column is that of unknown letters
    forward[:, :4] = weights
    reverse = np.zeros_like(forward)
    reverse[:, :4] = forward[::-1, turn]
    code = np.full(256, 4, np.uint8)
    for i, c in enumerate(DNA):
        code[[ord(c), ord(c.lower())]] = i
    width = len(weights)

    def scan(seqs):
        best, total = [], []
        for x in seqs:
            if not x.is_valid:
                best.append(None)
                total.append(None)
                continue
            data = np.frombuffer(x.as_buffer(), np.uint8)
            letters = code[data[(data & 0xC0) != 0x80]]  # one of each code point
            top, held = None, 0.0
            for at in range(0, len(letters) - width + 1, block):
                part = letters[at : at + block + width - 1]
                n = len(part) - width + 1
                a, b = (sum(w[j][part[j : j + n]] for j in range(width)) for w in (forward, reverse))
                s = np.maximum(a, b) if merge == "max" else (a + b) / 2
                top = float(s.max()) if top is None else max(top, float(s.max()))
                held += float(s.sum())
            best.append(top)
            total.append(held)
        return pa.StructArray.from_arrays([pa.array(best, pa.float64()), pa.array(total, pa.float64())], ["best", "total"])

    scan.__annotations__ = {"seqs": pa.Array, "return": pa.Array}  # Spark wants types, not the strings of this module's hints
    return F.arrow_udf(scan, "best double, total double")(seq)


def first_letter(kmer: Column, order: int) -> Column:
    """The index of a k-mer's first letter."""
    return F.when(kmer < 0, kmer).otherwise(F.floor(kmer / 4 ** (order - 1))).cast("int")


def local_average(values: Column, width: int) -> Column:
    """Moving averages of ``width`` neighbours, only where all of them exist."""
    add = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) < width, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(values) - width + 1), lambda i: add(F.slice(values, i, width)) / width))
