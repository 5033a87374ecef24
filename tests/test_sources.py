"""Files of every format, written here and read back."""

from __future__ import annotations

import io
import random
import struct
import zlib
from pathlib import Path

import pytest

from locusframe.sources import bam, bigwig, fasta, sinks
from locusframe.sources.intervals import as_intervals, check_files, read_bed, read_bedgraph, read_chrom_sizes, read_regions, read_vcf, stem


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_bed_and_bedgraph(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "# note\ntrack name=x\nchr1\t0\t10\nchr1\t5\t20\tn\t7\t-\n")
    rows = read_bed(spark, bed).orderBy("ord").collect()
    assert [(r.chrom, r.start, r.end, r.name, r.score, r.strand) for r in rows] == [("chr1", 0, 10, None, None, "."), ("chr1", 5, 20, "n", "7", "-")]
    graph = put(tmp_path, "a.bedgraph", "chr1\t0\t10\t1.5\nchr1\t10\t20\t.5\n")
    assert [float(r.score) for r in read_bedgraph(spark, graph).orderBy("ord").collect()] == [1.5, 0.5]
    assert read_regions(spark, graph).count() == 2 and stem(graph) == "a"
    with pytest.raises(ValueError):
        check_files([])


def test_gff_vcf_sizes(spark, tmp_path):
    gff = put(tmp_path, "a.gtf", 'chr1\tsrc\tgene\t15001\t25000\t.\t-\t.\tgene_id "x"\n')
    row = read_regions(spark, gff).first()
    assert (row.start, row.end, row.strand, row.name) == (15000, 25000, "-", "gene")
    vcf = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\nchr2\t60\trs1\ta\tC\t.\tPASS\t.\tGT\t0/1\nchr2\t70\t.\tAC\t.\t.\tPASS\t.\tGT\t0/0\n")
    rows = read_vcf(spark, vcf).orderBy("ord").collect()
    assert [(r.start, r.end, r.name, r.pos, r.ref, r.alt) for r in rows] == [(59, 60, "rs1", 60, "A", "C"), (69, 71, "", 70, "AC", "")]
    sizes = put(tmp_path, "a.sizes", "chr1\t300\nchr1_random\t20\n")
    assert [(r.chrom, r.length) for r in read_chrom_sizes(spark, sizes).collect()] == [("chr1", 300)]
    assert read_chrom_sizes(spark, sizes, skip_random=False).count() == 2


def test_region_sources(spark):
    import pandas as pd

    for source in ([("c", 1, 5)], pd.DataFrame({"chrom": ["c"], "start": [1], "end": [5]}), spark.createDataFrame([("c", 1, 5)], "chrom string, start int, end int")):
        row = as_intervals(spark, source).first()
        assert (row.chrom, row.start, row.end, row.strand) == ("c", 1, 5, ".")
    for source in (pd.DataFrame({"chrom": ["c"], "start": [1]}), spark.createDataFrame([("c", 1)], "chrom string, start int")):
        with pytest.raises(ValueError):
            as_intervals(spark, source)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first one\nACGT\nacgn\n\n>s2\nTT\n>s3\n\n")
    rows = fasta.read_fasta(spark, path).orderBy("ord").collect()
    assert [(r.chrom, r.seq) for r in rows] == [("s1", "ACGTacgn"), ("s2", "TT"), ("s3", "")]
    assert {r.seq for r in fasta.fixed_length(fasta.read_fasta(spark, path), 3).collect()} == {"ACG", "TT.", "..."}
    with pytest.raises(ValueError):
        fasta.fixed_length(fasta.read_fasta(spark, path))
    with pytest.raises(ValueError):
        fasta.fixed_length(spark.createDataFrame([("a", "A"), ("a", "C")], "chrom string, seq string"))


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25)
    return head + raw + struct.pack("<II", zlib.crc32(data), len(data))


REFS = [("chr1", 100_000), ("chr2", 50_000)]


def bam_file(rows, size=700):
    data = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(REFS))
    for name, length in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for name, ref, pos, mapq, flag, cigar, seq_n, next_ref, next_pos, tlen in rows:
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, seq_n, next_ref, next_pos, tlen)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + b"\x11" * ((seq_n + 1) // 2) + b"\x1e" * seq_n
        data += struct.pack("<i", len(body)) + body
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


@pytest.fixture(scope="module")
def alignments(tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(800):
        n = rng.randrange(20, 60)
        rows.append((f"read{i}", rng.randrange(2), rng.randrange(40_000), rng.randrange(60), rng.choice([0, 16, 4, 99, 147]), [(n - 5, 0), (3, 2), (5, 0)], n, rng.randrange(-1, 2), rng.randrange(40_000), rng.randrange(-300, 300)))
    path = tmp_path_factory.mktemp("bam") / "x.bam"
    path.write_bytes(bam_file(rows))
    return rows, str(path)


def test_bam(spark, alignments):
    rows, path = alignments
    want = sorted((r[0], REFS[r[1]][0], r[2], r[2] + r[6] + 3, bool(r[4] & 16), bool(r[4] & 4), bool(r[4] & 128), r[3], r[6], r[9]) for r in rows)
    view = lambda df: sorted((r.name, r.chrom, r.reference_start, r.reference_end, r.is_reverse, r.is_unmapped, r.is_read2, r.mapq, r.query_length, r.template_length) for r in df.collect())
    assert view(bam.read_bam(spark, path)) == want
    assert [(r.chrom, r.length) for r in bam.bam_sizes(spark, path).orderBy("ord").collect()] == REFS
    for split in (1, 3000, 1 << 30):  # every record once, wherever the file is cut
        reader = bam.BamReader([(path, Path(path).stat().st_size)], split)
        parts = reader.partitions()
        assert sorted(r[-2] for p in parts for r in reader.rows(p)) == sorted(r[0] for r in rows), split
    spark.dataSource.register(bam.BamDataSource)
    assert view(spark.read.format("bam").option("split", 9000).load(path)) == want


def bai_file(data):
    """An index that files every record of a BAM file under its smallest bin, without a linear index."""
    f = io.BytesIO(data)
    refs, block_at, place = bam.header(f)
    text, bounds = b"", []
    for offset, part in bam.blocks(f, block_at):
        bounds.append((offset, len(text)))
        text += part
    voffset = lambda at: next(o << 16 | (at - b) for o, b in reversed(bounds) if b <= at)
    bins, at = [{} for _ in refs], place
    while at < len(text):
        size = struct.unpack_from("<i", text, at)[0]
        row = bam.record(text, at, refs)
        start, end = row[1], row[2]
        bin_of = next((((1 << 3 * n) - 1) // 7 + (start >> k) for n, k in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)) if start >> k == (end - 1) >> k), 0)
        bins[[c for c, _ in refs].index(row[0])].setdefault(bin_of, []).append((voffset(at), voffset(min(at + 4 + size, len(text) - 1))))
        at += 4 + size
    out = b"BAI\1" + struct.pack("<i", len(refs))
    for held in bins:
        out += struct.pack("<i", len(held))
        for ident, chunks in held.items():
            out += struct.pack("<Ii", ident, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", 0)
    return out


def test_bam_index(spark, tmp_path):
    rows = sorted(((f"r{i}", i % 2, 37 * i, 9, 0, [(30, 0)], 30, -1, -1, 0) for i in range(1000)), key=lambda r: r[1:3])
    path = tmp_path / "x.bam"
    path.write_bytes(bam_file(rows))
    (tmp_path / "x.bam.bai").write_bytes(bai_file(path.read_bytes()))
    regions = [("chr1", 0, 500), ("chr2", 20_000, 20_100)]
    near = lambda start, end, chrom: any(c == chrom and s < end and e > start for c, s, e in regions)
    want = sorted(r[0] for r in rows if near(r[2], r[2] + 30, REFS[r[1]][0]))
    for split in (300, 1 << 20):
        reader = bam.BamReader([(str(path), path.stat().st_size)], split, regions)
        read = [r for p in reader.partitions() for r in reader.rows(p)]
        assert sorted(r[-2] for r in read if near(r[1], r[2], r[0])) == want and len({r[-2] for r in read}) == len(read)
        assert len(want) <= len(read) < 1000
    got = bam.read_bam(spark, str(path), regions).collect()
    assert sorted(r.name for r in got if near(r.reference_start, r.reference_end, r.chrom)) == want and len(got) < 1000
    assert bam.read_bam(spark, str(path), []).count() == 0 and bam.read_bam(spark, str(tmp_path / "*.bam")).count() == 1000
    with pytest.raises(FileNotFoundError):
        bam.read_bam(spark, str(tmp_path / "none.bam"))


def test_bad_bam():
    with pytest.raises(ValueError):
        bam.header(io.BytesIO(b"not a bam file at all"))


def test_bigwig_round_trip(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for c in ("chr1", "chr10", "chr2"):
        at = 0
        for _ in range(3000):
            at += rng.randrange(0, 5)
            n = rng.randrange(1, 9)
            want.append((c, at, at + n, rng.randrange(100) / 4))
            at += n
    sizes = [("chr2", 60_000), ("chr1", 50_000), ("chr10", 70_000)]
    path = tmp_path / "x.bw"
    with open(path, "wb") as f:
        bigwig.write_bigwig(f, sizes, want, items=10)  # more blocks than one index node holds
    rows = lambda df: [(r.chrom, r.start, r.end, r.value) for r in df.orderBy("chrom", "start").collect()]
    assert rows(bigwig.read_bigwig(spark, str(path))) == want
    assert {(r.chrom, r.length) for r in bigwig.bigwig_sizes(spark, str(path)).collect()} == set(sizes)
    spark.dataSource.register(bigwig.BigWigDataSource)
    assert rows(spark.read.format("bigwig").option("blocks", 100).load(str(path))) == want


def test_bigwig_index_levels_and_regions(spark, tmp_path):
    n = 512 * 512 + 700  # more blocks than two levels of the index hold
    path = tmp_path / "x.bw"
    with open(path, "wb") as f:
        bigwig.write_bigwig(f, [("a", 10 * n)], (("a", 10 * i, 10 * i + 5, float(i % 7 + 1)) for i in range(n)), items=1)
    with open(path, "rb") as f:
        index = bigwig.header(f)[1]
        assert len(bigwig.data_blocks(f, index)) == n
        assert len(bigwig.data_blocks(f, index, [(0, 1000, 2000), (0, 2_000_001, 2_000_002)])) == 101
    rows = bigwig.read_bigwig(spark, str(path), regions=[("a", 1000, 1020), ("b", 0, 9)]).orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in rows] == [(1000, 1005, 3.0), (1010, 1015, 4.0)]
    reader = bigwig.BigWigReader([(str(path), path.stat().st_size)], 5000)
    assert len(reader.partitions()) == -(-n // 5000)


def test_bigwig_block_kinds():
    head = lambda kind, n: struct.pack("<IIIIIBBH", 0, 100, 200, 10, 5, kind, 0, n)
    chroms = {0: ("c", 500)}
    assert list(bigwig.block_runs(head(2, 2) + struct.pack("<IfIf", 7, 1.5, 30, 2.5), chroms)) == [("c", 7, 12, 1.5), ("c", 30, 35, 2.5)]
    assert list(bigwig.block_runs(head(3, 2) + struct.pack("<ff", 1.5, 2.5), chroms)) == [("c", 100, 105, 1.5), ("c", 110, 115, 2.5)]


RUNS = "chrom string, start long, end long, strand int, condition string, value double"


def test_track_sinks(spark, tmp_path):
    track = spark.createDataFrame([("a", 0, 10, 0, "x", 1.0), ("a", 5, 20, 1, "x", 2.0), ("b", 3, 4, 0, "y", 5.0)], RUNS)
    rows = [(r.condition, r.chrom, r.start, r.end, r.value) for r in sinks.bedgraph_rows(track).orderBy("condition", "chrom", "start").collect()]
    assert rows == [("x", "a", 0, 5, 1.0), ("x", "a", 5, 10, 3.0), ("x", "a", 10, 20, 2.0), ("y", "b", 3, 4, 5.0)]
    sinks.write_bedgraph(track, str(tmp_path / "g"))
    assert read_bedgraph(spark, [str(p) for p in (tmp_path / "g").glob("*/part*")]).count() == 4
    sizes = spark.createDataFrame([("a", 100), ("b", 100)], "chrom string, length long")
    sinks.write_bigwigs(track, sizes, str(tmp_path / "w"), "cover")
    got = bigwig.read_bigwig(spark, str(tmp_path / "w" / "cover.x.bigwig"))
    assert [(r.start, r.end, r.value) for r in got.orderBy("start").collect()] == [(0, 5, 1.0), (5, 10, 3.0), (10, 20, 2.0)]


def test_bed_rows(spark):
    windows = spark.createDataFrame([(0, "c", 0, 14), (1, "c", 14, 28)], "idx long, chrom string, start long, end long")
    values = spark.createDataFrame([(i, b, "k", float(b)) for i in (0, 1) for b in range(7)], "idx long, bin long, condition string, value double")
    rows = sinks.bed_rows(windows, values, 2).orderBy("start").collect()
    assert len(rows) == 14 and (rows[-1].start, rows[-1].end, rows[-1].score) == (26, 28, 6.0)
