"""The driver's tables seen as a genome, as DataFrames and as SQL; see the README for the roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import floor_div, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(day: str, key: str):
    """A position: a thousand for each day since 1995, and a place in the day by key."""
    return F.datediff(F.col(day).cast("date"), F.lit("1995-01-01").cast("date")).cast("long") * 1000 + F.pmod(F.col(key) * 7919, F.lit(1000))


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of interest: orders."""
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    start = _spread("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 60 * 10).alias("end"),
        F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 7).cast("string").alias("score"), strand.alias("strand"), F.col("o_orderkey").alias("ord"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads: lineitem. Rows may repeat, and count each."""
    n = F.col("l_quantity").cast("long")
    chrom = F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"))
    start = _spread("l_shipdate", "l_orderkey")
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        chrom.alias("chrom"), start.alias("reference_start"), (start + n).alias("reference_end"), (F.col("l_linestatus") == "O").alias("is_reverse"), (k == 7).alias("is_unmapped"), n.cast("int").alias("mapq"),
        (F.col("l_returnflag") != "N").alias("is_paired"), (F.col("l_returnflag") == "R").alias("is_proper_pair"), (k % 2 == 0).alias("is_read2"),
        F.when(k % 3 == 0, F.lit("chrX")).otherwise(chrom).alias("next_chrom"), (start + (k - 3) * 20).alias("next_reference_start"), ((k - 3) * 20 + n).alias("template_length"), n.alias("query_length"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bedGraph features: events, by minutes since 2024; many overlap."""
    start = floor_div(F.unix_timestamp("ts") - F.lit(1704067200), 60)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("chrom"), start.alias("start"), (start + 1 + F.col("event_id") % 120).alias("end"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("name"),
        F.col("value").cast("string").alias("score"), F.lit(".").alias("strand"), F.col("event_id").alias("ord"))


#: ASCII that is no base; a table of letters is several times as fast as a pattern that matches nearly each of them.
_OTHERS = "".join(chr(c) for c in range(1, 128) if chr(c) not in "ACGTNacgt")


def _letters(text):
    return F.regexp_replace(F.translate(text, "acgt" + _OTHERS, "ACGT" + "N" * len(_OTHERS)), "[^ACGTN]", "N")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences: documents, in which all letters but a, c, g and t are N."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), _letters(F.coalesce("text", F.lit(""))).alias("seq"), F.col("lang"))


def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, chrom, length) of ``sequences``: each letter of a text is one of its sequence, so none has to be turned."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("idx"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants: labelled documents. Each fifth names a wrong reference letter, each seventh has two alternatives."""
    # places and letters are read off the texts before these meet the labels: one letter of each is turned into a base, none moves
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.length("text") > 0)
    pos = (1 + F.pmod(F.col("doc_id") * 37, F.length("text"))).cast("long")
    docs = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), pos.alias("pos"), F.substring(F.col("text"), pos.cast("int"), F.lit(1)).alias("letter"))
    rows = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id")
    base = _letters(F.col("letter"))
    turn = F.translate(base, "ACGTN", "CGTAA")
    ref = F.when(F.col("doc_id") % 5 == 0, turn).otherwise(base)
    return rows.select(
        F.col("doc_id").alias("ord"), "chrom", "pos", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("name"), ref.alias("ref"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.translate(ref, "ACGTN", "GTACC"), F.lit(",T"))).otherwise(F.translate(ref, "ACGTN", "GTACC")).alias("alt"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, y, p): document quality against a coarse function of length, by language; scores have many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    p = F.pmod(F.length("text") * 31, F.lit(257)).cast("double") + F.least(F.length("text") / 100, F.lit(90)).cast("int")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("lang").alias("condition"), F.col("quality").alias("y"), p.alias("p"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, y, p): event values against a linear function."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("value").alias("y"), (F.col("value") * 0.5 + F.pmod("event_id", F.lit(50))).alias("p"), "event_id")


#: Flat tensors: 16 positions, 2 strands, 2 conditions.
SHAPE = (16, 2, 2)


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("values"), "label")


SQL = {
    "roi": """SELECT 'chr' || (o_custkey % 5) AS chrom, s AS start, s + 1 + o_orderkey % 60 * 10 AS "end", o_orderpriority AS name, CAST(o_orderkey % 7 AS VARCHAR) AS score,
    CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand, o_orderkey AS ord
    FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000 + (o_orderkey * 7919) % 1000 AS s FROM orders)""",
    "reads": """SELECT 'chr' || (l_suppkey % 5) AS chrom, s AS reference_start, s + n AS reference_end, l_linestatus = 'O' AS is_reverse, k = 7 AS is_unmapped, n AS mapq, l_returnflag <> 'N' AS is_paired,
    l_returnflag = 'R' AS is_proper_pair, k % 2 = 0 AS is_read2, CASE WHEN k % 3 = 0 THEN 'chrX' ELSE 'chr' || (l_suppkey % 5) END AS next_chrom, s + (k - 3) * 20 AS next_reference_start, (k - 3) * 20 + n AS template_length, n AS query_length
    FROM (SELECT *, CAST(l_quantity AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS k, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 + (l_orderkey * 7919) % 1000 AS s FROM lineitem)""",
    "runs": """SELECT event_type AS chrom, s AS start, s + 1 + event_id % 120 AS "end", 'u' || (user_id % 3) AS name, value, event_id AS ord
    FROM (SELECT *, CAST(floor((epoch(date_trunc('second', ts)) - 1704067200) / 60) AS BIGINT) AS s FROM events)""",
    "seqs": """SELECT doc_id AS idx, 'd' || doc_id AS chrom, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq, lang FROM documents""",
    "vars": """SELECT doc_id AS ord, chrom, pos, 'v' || doc_id AS name, ref, CASE WHEN doc_id % 7 = 0 THEN translate(ref, 'ACGTN', 'GTACC') || ',T' ELSE translate(ref, 'ACGTN', 'GTACC') END AS alt, seq
    FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN translate(base, 'ACGTN', 'CGTAA') ELSE base END AS ref FROM (SELECT doc_id, chrom, seq, 1 + doc_id * 37 % length(seq) AS pos, substr(seq, CAST(1 + doc_id * 37 % length(seq) AS BIGINT), 1) AS base
    FROM labels JOIN (SELECT idx AS doc_id, chrom, seq FROM seqs) USING (doc_id) WHERE length(seq) > 0))""",
    "preds": """SELECT lang AS condition, quality AS y, CAST(length(text) * 31 % 257 AS DOUBLE) + CAST(floor(least(length(text) / 100, 90)) AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)""",
    "regr": """SELECT event_type AS condition, value AS y, value * 0.5 + event_id % 50 AS p, event_id FROM events""",
    "tens": """SELECT vec_id AS idx, CAST(v AS DOUBLE) AS value, CAST(i // 4 AS INTEGER) AS pos, CAST(i // 2 % 2 AS INTEGER) AS strand, CAST(i % 2 AS INTEGER) AS condition
    FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over projections and further common table expressions."""
    parts = {n: SQL[n] for n in names} | more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" + body


def sql_tiles(source: str, binsize: int, stepsize: int, padding: bool = True) -> str:
    """(idx, chrom, start, end, strand, ord, k) of a table's tiling."""
    room = f'"end" - start - {binsize} + {stepsize}' if stepsize <= binsize else '"end" - start'
    tail = f"((room % {stepsize}) + {stepsize}) % {stepsize} > 0" if padding else "false"
    return f"""SELECT row_number() OVER (ORDER BY ord, k) - 1 AS idx, chrom, start + k * {stepsize} AS start, CASE WHEN k >= 0 AND k < n THEN start + k * {stepsize} + {binsize} ELSE "end" END AS "end", strand, ord, k
    FROM (SELECT *, unnest(CASE WHEN {tail} THEN list_append(range(0, greatest(n, 0)), n) ELSE range(0, greatest(n, 0)) END) AS k
    FROM (SELECT *, CAST(floor(room / {stepsize}) AS BIGINT) AS n FROM (SELECT *, {room} AS room FROM {source})))"""
