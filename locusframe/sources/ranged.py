"""Binary files that tasks read by ranges, on mounted file systems and in stores that pyarrow opens."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import floor_div
from ..shipping import ship

#: Regions are widened to multiples of this, so that their list is bounded by the genome and not by the windows.
REACH = 1 << 20
ROWS = 20_000


def _store(path: str):
    """(pyarrow file system, path in it), or None where Python opens the path itself."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + path.split("://", 1)[1] if path.startswith(("s3a://", "s3n://")) else path)


def open_at(path: str):
    """The file, seekable."""
    store, at = _store(path)
    return open(at, "rb") if store is None else io.BufferedReader(store.open_input_file(at), 1 << 20)


def exists(path: str) -> bool:
    import os

    store, at = _store(path)
    return os.path.exists(at) if store is None else store.get_file_info(at).is_file


def _statuses(spark: SparkSession, path: str | list[str]) -> list:
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    out = []
    for one in [path] if isinstance(path, str) else path:
        at = jvm.org.apache.hadoop.fs.Path(one)
        store = at.getFileSystem(conf)
        found = list(store.globStatus(at) or [])
        if not found:
            raise FileNotFoundError(one)
        for status in found:
            held = store.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [s for s in held if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return out


def located(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files that paths, folders and patterns name; one that names none raises."""
    return [(s.getPath().toString(), s.getLen()) for s in _statuses(spark, path)]


def stamps(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of the files that paths name, in any store."""
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in _statuses(spark, path)]


def by_ranges(files: list[tuple[str, int]]) -> bool:
    """Whether files can be read by ranges: the driver tries the first of each store."""
    for one in {path.split(":", 1)[0]: path for path, _ in files}.values():
        try:
            with open_at(one) as f:
                f.read(1)
        except (OSError, ValueError, ImportError, NotImplementedError):
            return False
    return True


def load(spark: SparkSession, source: type, files: list[tuple[str, int]], regions: list[tuple[str, int, int]] | None) -> DataFrame:
    ship(spark)
    held = spark.__dict__.setdefault("_locusframe_sources", set())
    if source.name() not in held:
        spark.dataSource.register(source)
        held.add(source.name())
    reader = spark.read.format(source.name()).option("files", json.dumps(files))
    return (reader if regions is None else reader.option("regions", json.dumps(regions))).load()


def options(given) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]] | None]:
    """What ``load`` passed, or the one file of a path on a mounted file system."""
    import os

    if "files" in given:
        files = [(p, n) for p, n in json.loads(given["files"])]
    else:
        files = [(given["path"], os.path.getsize(_store(given["path"])[1]))]
    return files, [tuple(r) for r in json.loads(given["regions"])] if "regions" in given else None


def arrow_batches(rows: Iterable[tuple], schema) -> Iterator:
    """Rows as Arrow batches, a bounded number at a time."""
    from itertools import islice

    import pyarrow as pa

    rows = iter(rows)
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def reach(windows: DataFrame) -> list[tuple[str, int, int]]:
    """(chrom, start, end) runs that hold all windows, in steps of ``REACH``: a row a step reaches the driver."""
    first = F.greatest(floor_div(F.col("start"), REACH), F.lit(0).cast("long"))
    last = F.greatest(floor_div(F.col("end"), REACH), first)
    steps = windows.select("chrom", F.explode(F.sequence(first, last)).alias("step")).distinct()
    out: list[tuple[str, int, int]] = []
    for chrom, step in sorted(map(tuple, steps.collect())):
        if out and out[-1][0] == chrom and out[-1][2] == step * REACH:
            out[-1] = (chrom, out[-1][1], (step + 1) * REACH)
        else:
            out.append((chrom, step * REACH, (step + 1) * REACH))
    return out
