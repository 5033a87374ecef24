"""What the findings of round 3 named."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from locusframe.functions import sequence as Q
from locusframe.operators import rangejoin, track, variants
from locusframe.operators import windows as W
from locusframe.plans import catalog, projection


def intervals(n, seed, length=60):
    rng = random.Random(seed)
    return [("c%d" % rng.randrange(2), s, s + rng.randrange(0, length)) for s in (rng.randrange(-20, 400) for _ in range(n))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark):
    a, b = intervals(60, 2), intervals(80, 3)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate([*a, (None, 5, 9)])], "k long, chrom string, start long, end long")
    right = spark.createDataFrame([*b, *b[:20], (None, 0, 50)], "chrom string, start long, end long")
    held = {i: [(max(s, t), min(e, u)) for d, t, u in b + b[:20] if t < u and s < e and c == d and s < u and t < e] for i, (c, s, e) in enumerate(a)}
    return left, right, held | {60: []}


def test_overlap_counts_match_brute_force_without_pairs(spark):
    left, right, held = sides(spark)
    for bin_size in (1, 7, 64, 1 << 14):
        got = {r.k: (r.n, r.bases) for r in rangejoin.overlap_counts(left, right, "k", bin_size).collect()}
        assert got == {k: (len(v), sum(e - s for s, e in v)) for k, v in held.items()}


def test_overlap_left_leaves_pairs_where_they_met(spark):
    left, right, held = sides(spark)
    out = rangejoin.overlap_left(left, right, "k", 16)
    assert sorted((r.k, max(r.start, r.r_start), min(r.end, r.r_end)) for r in out.where("r_start is not null").collect()) == sorted((k, *x) for k, v in held.items() for x in v)
    assert {r.k for r in out.where("r_start is null").collect()} == {k for k, v in held.items() if not v}


def test_clustered_pairs_lie_in_the_order_of_starts(spark):
    left, right, held = sides(spark)
    out = rangejoin.overlap_join(left, right, 64, clustered=True)
    assert sorted((r.k, max(r.start, r.r_start), min(r.end, r.r_end)) for r in out.collect()) == sorted((k, *x) for k, v in held.items() for x in v)
    met = out.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).collect()
    keys = [(r.part, r.chrom, max(r.start, r.r_start) // 64) for r in met]
    assert sum(a != b for a, b in zip(keys, keys[1:])) + 1 == len(set(keys))  # a bin's pairs lie together
    assert all(a.start <= b.start for (a, b), (j, k) in zip(zip(met, met[1:]), zip(keys, keys[1:])) if j == k)


def test_painting_by_tree_nodes_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), s, s + rng.randrange(0, 90), i, rng.choice([None, float(i)]), rng.choice(["x", "y", None])) for i, s in enumerate(rng.randrange(-50, 300) for _ in range(200))]
    features = spark.createDataFrame(rows, "chrom string, start long, end long, ord long, value double, category string")
    want = {}
    for chrom, s, e, _, value, category in rows:
        want |= {(chrom, p): (value, category) for p in range(s, e)}
    for size in (1, 5, 64, 400, None):
        for values, pick in ((["value"], lambda r: (r.value,)), (["value", "category"], lambda r: (r.value, r.category))):
            got = [((r.chrom, p), pick(r)) for r in track.paint(features, values, bin_size=size).collect() for p in range(r.start, r.end)]
            assert len(got) == len(want) and all(want[k][: len(v)] == v for k, v in got)


def test_painting_pairs_no_feature_with_segments(spark):
    """300 features on top of one another over 256 segments: pairs would be 38,400, tree nodes are at most 511."""
    features = spark.range(300).select(F.lit("c").alias("chrom"), (F.col("id") % 128).alias("start"), (256 - F.col("id") % 128).alias("end"), F.col("id").alias("ord"), F.col("id").cast("double").alias("value"))
    out = track.paint(features, bin_size=256)
    assert out.count() == 255 and "SortAggregate" not in plan(out)
    rows = []

    def walk(node):
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        inner = [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        for child in inner + [children.apply(i) for i in range(children.size())]:
            walk(child)

    out._jdf.collectToPython()
    walk(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 255 * 9


def runs_of(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder))


def documents(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def test_motif_summary_equals_the_scan(spark):
    rng = random.Random(5)
    texts = ["", "AC", None, "é€😀acg", "acgtn" * 9, *("".join(rng.choice("ACGTacgtN ") for _ in range(n)) for n in (3, 40, 333))]
    weights = [[rng.randrange(-4, 5) / 2 for _ in range(4)] for _ in range(3)]
    df = documents(spark, texts).repartition(3)
    for merge in ("max", "ave"):
        for block in (7, 1 << 20):
            s, x = Q.scan_both_strands(Q.kmers(F.col("text")), weights, merge=merge), Q.scan_summary(F.col("text"), weights, merge, block)
            rows = df.select("text", F.array_max(s).alias("best"), F.aggregate(s, F.lit(0.0), lambda a, v: a + v).alias("total"), x.alias("x")).collect()
            assert len(rows) == len(texts) and all((r.best, r.total) == (r.x.best, r.x.total) if r.text is not None else r.x.best is None for r in rows)


def test_letter_counts_equal_the_one_hot_sums(spark):
    df = documents(spark, ["", "acgtACGTNn é€", "tttT", "xyz"])
    hot = Q.one_hot(Q.kmers(F.col("text")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.aggregate(hot, F.lit(0).cast("long"), lambda a, r: a + F.get(r, j)))
    assert all(r.a == r.b for r in df.select(sums.alias("a"), Q.letter_counts(F.col("text")).alias("b")).collect())


def test_chunks_of_any_letters_join_up(spark):
    texts = ["", "a" * 10, "b" * 11, "é€😀\n" * 7, None]
    rows = variants.chunked(documents(spark, texts).select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq")), 5).collect()
    got = {i: [r.seq for r in sorted(rows, key=lambda r: r.chunk) if r.chrom == i] for i in range(5)}
    assert {i: "".join(v) for i, v in got.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(len(x) == 5 for v in got.values() for x in v[:-1])


def test_letters_of_texts_are_as_before(spark):
    rows = documents(spark, ["".join(map(chr, range(1, 700))), "acgtN\U0001F600퟿Ä\r\n", ""])
    old = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N")
    assert all(r.a == r.b and len(r.a) == r.n for r in rows.select(old.alias("a"), projection._letters(F.col("text")).alias("b"), F.length("text").alias("n")).collect())


def test_variant_contexts_are_made_once(spark, tmp_path):
    docs = documents(spark, ["acgt" * 20 * (i + 1) for i in range(12)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).coalesce(1)
    out = runs_of(spark, tmp_path, "variant_strand", documents=docs, labels=labels)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and out.count() > 0
    once = catalog.queries()["seq_window"](spark, str(tmp_path))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and once.count() == 12


def compared(spark, folder, name):
    """Whether a query's rows equal its SQL's, on the tables of a folder."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    catalog.queries()[name](spark, str(folder)).write.parquet(str(folder / "got"))
    con.execute(f"CREATE TABLE want AS {catalog.oracle_sql()[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE want").fetchall())
    return all(con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == [] for a, b in (("want", f"'{folder}/got/*.parquet'"), (f"'{folder}/got/*.parquet'", "want")))


def test_dna_index_of_empty_and_repeated_texts(spark, tmp_path):
    rows = [(1, "acgt"), (2, ""), (3, None), (4, "aan"), (4, "aan"), (5, "ac"), (5, "ca"), (None, "a"), (None, "")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compared(spark, tmp_path, "dna_index")


def test_nan_to_num_of_odd_embeddings(spark, tmp_path):
    odd = [float("nan"), float("inf"), float("-inf"), 1.5] + [0.25] * 60
    rows = [(i, odd, label) for i, label in enumerate((0, 1, 2, -1, -2, -3, None))] + [(20, odd, 2), (20, odd[::-1], 1), (None, odd, 2), (30, None, 1), (31, [], 0), (32, [None, 1.0], 1), (33, [None, 1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert compared(spark, tmp_path, "nan_to_num")


def test_windows_are_made_once_and_numbered_in_order(spark):
    rng = random.Random(6)
    rows = [("c%d" % rng.randrange(2), s, s + rng.randrange(0, 70), i * 40_000) for i, s in enumerate(rng.randrange(200) for _ in range(30))]
    regions = spark.createDataFrame(rows, "chrom string, start long, end long, ord long")
    for size, step, padding in ((20, 15, True), (20, 20, False), (50, 7, True), (5, 12, True)):
        df = W.Windows.create_from_file(regions, size, step, zero_padding=padding).df
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
        cols = ["idx", "chrom", "start", "end", "strand", "ord", "k"]
        assert sorted(df.select(cols).collect()) == sorted(W.numbered(W.tile(regions, size, step, padding)).select(cols).collect())
        assert sorted(r.idx for r in df.collect()) == list(range(df.count()))


def test_read_places_are_worked_out_once(spark):
    names = "chrom string, reference_start long, reference_end long, is_reverse boolean, is_unmapped boolean, mapq int, is_paired boolean, is_proper_pair boolean, is_read2 boolean, next_chrom string, next_reference_start long, template_length long, query_length long"
    reads = spark.createDataFrame([("c", 5, 9, False, False, 3, False, False, False, None, None, None, 4), ("c", 5, 9, True, False, 3, True, True, False, "c", 20, 19, 4)], names)
    out = track.read_track(reads).where("end > start and start >= 0")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("greatest(reference_end") == 1
    assert sorted((r.start, r.end, r.strand, r.value) for r in out.collect()) == [(5, 6, 0, 1.0), (24, 25, 1, 1.0)]
