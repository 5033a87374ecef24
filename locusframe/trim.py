"""Trims a BED file's intervals to multiples: ``python -m locusframe.trim in.bed out.bed -divby 50`` writes a folder of parts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.windows import trim_to_multiple
from .sources.intervals import read_bed
from .sources.sinks import write_tsv


def trim(spark: SparkSession, source: str, target: str, by: int = 1) -> None:
    """Rows stay in file order; an interval that holds no whole multiple has nothing left between its start and end."""
    rows = trim_to_multiple(read_bed(spark, source), by).fillna(".", ["name"])
    rows = rows.repartitionByRange("ord").sortWithinPartitions("ord").select("chrom", "start", "end", "name", "score", "strand")
    write_tsv(rows, target, header=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="locusframe.trim", description="Trims starts up and ends down to multiples of a number.")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("-divby", type=int, default=1)
    given = parser.parse_args(argv)
    trim(SparkSession.builder.getOrCreate(), given.source, given.target, given.divby)


if __name__ == "__main__":
    main()
