"""The stream of error records: JSON lines, plain or gzip, partitioned by bare directories."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directory levels below .../stream (fixed values).
LEVELS = ("stage", "type", "year", "month", "day", "hour")
SCHEMA = "apikey string, event string, message string"
MARKER = "===empty==="


def whole_schema() -> str:
    return SCHEMA + "".join(f", {x} string" for x in LEVELS)


def may_hold(predicate: tuple | None, known: dict[str, str | None]) -> bool:
    """Whether a row of these levels may satisfy predicate; levels that are not known yet may be anything."""
    return predicate is None or _truth(predicate, known) is not False


def _truth(p: tuple, known: dict[str, str | None]) -> bool | None:
    """True, False, or None where it cannot be told."""
    op, *args = p
    if op in ("and", "or"):
        each = [_truth(x, known) for x in args]
        decided = op == "or"
        return decided if decided in each else None if None in each else not decided
    if op == "not":
        own = _truth(args[0], known)
        return None if own is None else not own
    if len(args) == 2 and (args[0] in known) != (args[1] in known):
        flip = args[0] not in known
        name, value = args[::-1] if flip else args
        level = known[name]
        if level is None or not isinstance(value, str):
            return False if level is None and op in ("=", "<", "<=", ">", ">=") else None
        a, b = (value, level) if flip else (level, value)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(op)
    return None


def files(spark: SparkSession, base: str, predicate: tuple | None = None) -> list[str]:
    """The files of the stream whose levels may satisfy predicate; folders that cannot are not listed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{base}/stream")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: list[str] = []

    def walk(path, levels: tuple[str, ...]) -> None:
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if s.isDirectory() and len(levels) < len(LEVELS):
                held = dict(zip(LEVELS, (*levels, name), strict=False))
                if may_hold(predicate, held):
                    walk(s.getPath(), (*levels, name))
            elif s.isFile() and s.getLen() and may_hold(predicate, {n: levels[i] if i < len(levels) else None for i, n in enumerate(LEVELS)}):
                out.append(s.getPath().toString())

    if fs.exists(top):
        walk(top, ())
    return out


def read(spark: SparkSession, base: str, org: str, predicate: tuple | None = None) -> DataFrame:
    """The org's error records with a column for each directory level; marker files have no row of any org.

    Files named .gz are unpacked by Hadoop's codecs, those named .gzip, which it does not
    know, as a whole (they are an hour's records of a stage at most).
    """
    found = files(spark, base, predicate)
    packed, plain = [f for f in found if f.endswith(".gzip")], [f for f in found if not f.endswith(".gzip")]
    rows = spark.read.schema(SCHEMA).json(plain).withColumn("_path", F.col("_metadata.file_path")) if plain else spark.createDataFrame([], SCHEMA + ", _path string")
    if packed:
        unpacked = spark.read.format("binaryFile").load(packed).select(F.col("path").alias("_path"), "content").mapInArrow(_unpack, "_path string, line string")
        parsed = unpacked.where("trim(line) <> ''").select("_path", F.from_json("line", SCHEMA).alias("r")).select("r.*", "_path")
        rows = rows.unionByName(parsed)
    return with_levels(rows).where((F.col("apikey") == org) & (F.col("apikey") != MARKER))


def _unpack(batches):
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = gzip.decompress(content).decode().splitlines()
            for low in range(0, len(lines), 10_000):
                some = lines[low : low + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some, pa.string())], ["_path", "line"])


def with_levels(rows: DataFrame) -> DataFrame:
    below = F.split(F.regexp_extract("_path", r".*/stream/(.*)/[^/]*$", 1), "/")
    return rows.select("*", *[F.get(below, i).alias(n) for i, n in enumerate(LEVELS)]).drop("_path")
