from __future__ import annotations

from locusframe.operators.track import read_track
from locusframe.streaming import tracks

SCHEMA = "chrom string, reference_start long, reference_end long, is_reverse boolean, is_unmapped boolean, mapq int, is_paired boolean, is_proper_pair boolean, is_read2 boolean, next_chrom string, next_reference_start long, template_length long, query_length long"


def test_partials_add_up(spark, tmp_path):
    rows = [("c", s % 7, s % 7 + 5, s % 2 == 0, False, 9, False, False, False, None, -1, 0, 5) for s in range(60)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tracks.write_partials(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    view = lambda df: sorted((r.chrom, r.start, r.strand, r.value) for r in df.collect())
    assert view(tracks.merged(spark, str(tmp_path / "out"))) == view(read_track(whole))
    assert tracks.live_counts(stream).isStreaming
