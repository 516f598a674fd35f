"""Queries over the test tables, each with the DuckDB SQL that gives the same rows.

The unified ones read events through the engine from stores that are laid out as
files once for each application (archive days, recent windows, the error stream).
"""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metadata
from .catalog import Catalog, Field, Metric
from .operators.unified import expand, split_key, unified
from .plans.dialect import translate
from .plans.intervals import bounds
from .plans.predicate import column
from .session import Engine
from .sources import errors
from .sources.archive import Archive
from .sources.keys import KeyMapper, choose
from .sources.nearline import Nearline
from .streaming.recent import read as stream
from .streaming.recent import tumbling

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ORG, DAY = "org0", 86_400_000
BOUNDARY, WEEK = 1705363200000, 7 * DAY  # 2024-01-16
EPOCH = "(epoch_us(ts) // 1000)"
FIELDS = (Field("c1", "value", "DOUBLE", ("val_v1",)), Field("c2", "event_id", "LONG"), Field("c3", "kind", "BYTES"), Field("c4", "late", "STRING"))
METRIC = Metric(ORG, "m-events", "events", FIELDS, ("ev",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with timestamp (epoch ms) and org."""
    return table(spark, sf_dir, "events").withColumn("timestamp", F.expr("unix_millis(cast(ts as timestamp))")).withColumn("org", F.concat(F.lit("org"), F.col("user_id") % 3))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive rows: of all days; those from the boundary on have other values and must not surface."""
    value = F.when(F.col("timestamp") < BOUNDARY, F.col("value")).otherwise(F.lit(-1.0)).cast("string")
    odd = F.col("event_id") % 2 == 1
    return events(spark, sf_dir).select(
        F.col("org").alias("companykey"), F.lit(METRIC.metric_id).alias("metrictype"), "timestamp",
        F.when(odd, value).alias("value"), F.when(~odd, value).alias("val_v1"), F.col("event_id").cast("string").alias("c2"),
        F.base64(F.col("event_type").cast("binary")).alias("kind"), F.get_json_object("props", "$.k").alias("uk"), F.to_date(F.timestamp_millis("timestamp")).alias("_fd0"),
    )


def windows(spark: SparkSession, sf_dir: str, every: int | None = None) -> Nearline:
    """Weekly tables from the boundary on.  every: events of so many ms share an item."""
    own = events(spark, sf_dir).where(F.col("timestamp") >= BOUNDARY)
    ts = F.col("timestamp") if every is None else F.col("timestamp") - F.col("timestamp") % every
    one = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), c)))
    out = Nearline()
    for k in range(3):
        start, end = BOUNDARY + k * WEEK, BOUNDARY + (k + 1) * WEEK
        rows = own.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
        out.tables[f"nl_{start}_{end}"] = rows.groupBy(F.concat(F.col("org"), F.lit(METRIC.metric_id)).alias("pk"), ts.alias("ts")).agg(
            F.collect_list(F.col("event_id").cast("string")).alias("ids"), one(F.col("value").cast("string")).alias("value"), one(F.col("event_id").cast("string")).alias("c2"),
            one(F.base64(F.col("event_type").cast("binary"))).alias("kind"),
        )
    return out


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events as records with their levels."""
    own = events(spark, sf_dir).where("event_type = 'error'")
    stage = F.when(F.col("event_id") % 2 == 0, "raw").otherwise("staged")
    kind = F.when(F.col("event_id") % 3 == 0, "malformed").otherwise("error")
    at = F.timestamp_millis("timestamp")
    return own.select(F.col("org").alias("apikey"), F.col("props").alias("event"), F.col("event_id").cast("string").alias("message"), stage.alias("stage"), kind.alias("type"), F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"))


_stores: dict[tuple[str, str], str] = {}


def stores(spark: SparkSession, sf_dir: str) -> str:
    """A folder with events laid out once for each application as the stores have them: an archive as Parquet and as
    JSON, recent windows (one event an item, and hourly items), and the error stream (plain, .gz and .gzip files)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        base = f"{top}/stores-{uuid.uuid4().hex}"
        rows = stored(spark, sf_dir)
        days = rows.withColumn("_o", F.col("companykey")).withColumn("_d", F.col("_fd0").cast("string")).drop("_fd0").repartition("_o", "_d")
        for kind in ("parquet", "json"):
            days.write.partitionBy("_o", "_d").format(kind).save(f"{base}/raw-{kind}")
            _bare(spark, f"{base}/raw-{kind}", lambda o, d, kind=kind: f"{base}/0/{kind}/{o}/{METRIC.metric_id}/{d}", 2)
        for every, name in ((None, base), (3_600_000, f"{base}/hourly")):
            for window, items in windows(spark, sf_dir, every).tables.items():
                items.write.parquet(f"{name}/{window}")
        records, levels = error_records(spark, sf_dir), ("stage", "type", "year", "month", "day")
        for stage, packed in (("raw", "none"), ("staged", "gzip")):
            own = records.where(F.col("stage") == stage).repartition(*levels)
            own.write.partitionBy(*levels).option("compression", packed).json(f"{base}/errors-{stage}")
            _bare(spark, f"{base}/errors-{stage}", lambda *parts: f"{base}/stream/{'/'.join(parts)}", 5, gzip=".gzip")
        _stores[key] = base
        atexit.register(_remove, spark, base)
    return _stores[key]


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the application may be gone already
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bare(spark: SparkSession, folder: str, target: Callable[..., str], depth: int, gzip: str | None = None) -> None:
    """Move partition folders (name=value) to folders of bare values; .gz files of every other day get another ending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def walk(at, parts: tuple[str, ...]) -> None:
        if len(parts) == depth:
            new = path(target(*parts))
            fs.mkdirs(new.getParent())
            fs.rename(at, new)
            for s in fs.listStatus(new):
                name = s.getPath().getName()
                if gzip and name.endswith(".gz") and int(parts[-1]) % 2:
                    fs.rename(s.getPath(), path(f"{new.toString()}/{name[:-3]}{gzip}"))
            return
        for s in fs.listStatus(at):
            if s.isDirectory():
                walk(s.getPath(), (*parts, s.getPath().getName().split("=", 1)[1]))

    walk(path(folder), ())
    fs.delete(path(folder), True)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    base = stores(spark, sf_dir)
    catalog = Catalog([METRIC, Metric("org1", "m1", "events", FIELDS)], ("org2",))
    return Engine(spark, catalog, Nearline(base), (Archive(base),), base)


def _unified(predicate: tuple | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = stores(spark, sf_dir)
        rows = unified(spark, METRIC, nearline=Nearline(base), archives=(Archive(base),), predicate=predicate, **options)
        return rows.where(column(predicate)).select("timestamp", "event_id", "value")

    return run


def _tenant(sql: str, args: list | None = None, max_rows: int | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir)
        own.radio = options.get("radio", False)
        return own.session(ORG).sql(sql, args=args, max_rows=max_rows)

    return run


OWN = f"(SELECT {EPOCH} AS timestamp, event_id, value, event_type, user_id, props, ts FROM events WHERE user_id % 3 = 0) AS e"
_A, _B = BOUNDARY - 3 * DAY, BOUNDARY + 9 * DAY
_TIMES = {
    "unified_union": (None, "TRUE"),
    "time_range_filter": (("and", (">=", "timestamp", _A), ("<", "timestamp", _B)), f"timestamp >= {_A} AND timestamp < {_B}"),
    "time_le": (("<=", "timestamp", _A), f"timestamp <= {_A}"),
    "time_gt": ((">", "timestamp", _B), f"timestamp > {_B}"),
    "time_neq": (("<>", "timestamp", _A), f"timestamp <> {_A}"),
    "time_flipped": (("and", ("<=", _B, "timestamp"), ("not", (">", "timestamp", _B + DAY))), f"{_B} <= timestamp AND NOT timestamp > {_B + DAY}"),
    "time_or_unbounded": (("or", (">", "timestamp", _B), ("<", "value", 10.0)), f"timestamp > {_B} OR value < 10"),
    "time_or_gap": (("or", (">", "timestamp", _B), ("<", "timestamp", _A)), f"timestamp > {_B} OR timestamp < {_A}"),
    "time_none": (("and", (">", "timestamp", _B), ("<", "timestamp", _A)), "FALSE"),
}


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stores(spark, sf_dir)
    rows = unified(spark, METRIC, nearline=Nearline(base), archives=(Archive(base),))
    return rows.select("event_id", "late", F.col("kind").cast("string").alias("kind"))


def _radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unified(spark, METRIC, archives=(Archive(stores(spark, sf_dir)),), radio=True)
    return rows.select("event_id", F.to_json("_fm").alias("_fm"), F.col("_fm")["uk"].alias("uk"))


def _archive(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """The archive alone: all of its days, with the values that the recent store hides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = unified(spark, METRIC, archives=(Archive(stores(spark, sf_dir), kind),))
        return rows.select("timestamp", "event_id", "value", F.col("kind").cast("string").alias("kind"))

    return run


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unified(spark, METRIC, nearline=Nearline(f"{stores(spark, sf_dir)}/hourly"))
    return rows.select("timestamp", "event_id", "value")


def _all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = Nearline(stores(spark, sf_dir))
    return reduce(lambda a, b: a.unionByName(b), [recent.read(spark, w) for w in recent.windows(spark)])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_key(_all_items(spark, sf_dir), ("org", "metric"), r"^(org\d)(.*)$").groupBy("org", "metric").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of fixed lengths, by the mapper of the first regex that matches the table's name."""
    mappers = {"other": KeyMapper("pk", ("x",), lengths=(None,)), "nl_.*": KeyMapper("pk", ("h1", "h2"), lengths=(4, None))}
    return choose(mappers, "nl_0_1").split(_all_items(spark, sf_dir)).groupBy("h1", "h2").agg(F.count("*").alias("n"))


def _pruned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tenant's archive the days that a range of timestamps needs, with the exact filter above."""
    where = ("and", (">", "timestamp", _A), ("<=", "timestamp", _A + 2 * DAY))
    archive = Archive(stores(spark, sf_dir))
    own = [archive.read(spark, Metric(f"org{i}", METRIC.metric_id, "events"), bounds(where)) for i in range(3)]
    rows = reduce(lambda a, b: a.unionByName(b), [x for x in own if x is not None]).where(column(where))
    return rows.groupBy(F.to_date(F.timestamp_millis("timestamp")).alias("_fd0")).agg(F.count("*").alias("n"))


def _empty_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without ids have no event."""
    items = _all_items(spark, sf_dir).withColumn("ids", F.when(F.col("ts") % 2 == 0, F.col("ids")))
    return expand(items).where("pk like 'org0%'").select(F.col("c2").cast("long").alias("event_id"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent store's tables as they are found."""
    found = Nearline(stores(spark, sf_dir)).windows(spark)
    return spark.createDataFrame([(w.name, w.start, w.end) for w in found], "name string, first long, past long")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Archive(stores(spark, sf_dir)).days(spark, METRIC)
    return spark.createDataFrame([(d,) for d in found], "day string")


def _error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.read(spark, stores(spark, sf_dir), ORG)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first recent window, read as a stream, counted by the day."""
    recent = Nearline(stores(spark, sf_dir))
    folder = f"{recent.base}/{recent.windows(spark)[0].name}"
    made = tumbling(stream(spark, folder, spark.read.parquet(folder).schema, METRIC), "1 day", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))
    name = f"daily_{uuid.uuid4().hex}"
    made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "s")


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements a tenant may run."""
    own, rows = engine(spark, sf_dir).session(ORG), []
    for name, sql in STATEMENTS:
        try:
            own.check(sql)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "statement string, allowed boolean")


STATEMENTS = [
    ("query", "SELECT count(*) FROM events"),
    ("qualified", "SELECT count(*) FROM tidemark.org0.events"),
    ("with", "WITH t AS (SELECT 1 AS x) SELECT x FROM t"),
    ("other tenant", "SELECT * FROM tidemark.org1.events"),
    ("unknown", "SELECT * FROM nothing"),
    ("file", "SELECT * FROM parquet.`/tmp`"),
    ("outside of the with", "SELECT s.x FROM t s, (WITH t AS (SELECT 1 AS x) SELECT x FROM t) u"),
    ("window name", "SELECT row_number() OVER t AS n FROM t WINDOW t AS (ORDER BY x)"),
    ("insert", "INSERT INTO events SELECT 1"),
    ("delete", "DELETE FROM events"),
    ("update", "UPDATE events SET value = 1"),
    ("merge", "MERGE INTO events a USING events b ON a.event_id = b.event_id WHEN MATCHED THEN DELETE"),
    ("create", "CREATE TABLE x AS SELECT 1"),
    ("set", "SET spark.sql.ansi.enabled=false"),
    ("reflect", "SELECT reflect('java.lang.System', 'nanoTime')"),
]


def _orgs_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = [], engine(spark, sf_dir)
    for given in ({"COMPANY_KEY": ORG}, {"COMPANY_KEY": "nobody"}, {}, {"COMPANY_KEY": "", "user": ORG}):
        try:
            rows.append((len(rows), own.session(given).org))
        except ValueError:
            rows.append((len(rows), None))
    return spark.createDataFrame(rows, "k int, org string")


def _as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's encoded query, its result as JSON lines, read again."""
    rows = engine(spark, sf_dir).session(ORG).rows("%22SELECT+event_id%2C+value+FROM+events+WHERE+value+%3E+60%22")
    lines = [(json.dumps(r),) for r in rows]
    return spark.createDataFrame(lines, "line string").select(F.from_json("line", "event_id long, value double").alias("r")).select("r.*")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = engine(spark, sf_dir).session(ORG).sql("EXPLAIN PLAN FOR SELECT count(*) AS n FROM events")
    return plan.select(F.col("plan").contains("Scan").alias("scans"), F.col("plan").contains("HashAggregate").alias("sums"))


def _metadata(make: Callable, **patterns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: metadata.matching(make(spark, engine(spark, sf_dir).catalog, ORG), **patterns)


def _repeated_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain("SELECT *, r_name, * FROM region")(spark, sf_dir).toDF("a", "b", "f", "c", "d")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's metric between two times, across the archive and the recent store."""
    return _unified(_TIMES["time_range_filter"][0], ordered=True)(spark, sf_dir)


#: name: SQL in the accepted dialect, and DuckDB's where it differs.
SQL: dict[str, tuple[str, str | None]] = {
    # projections, filters, predicates
    "select_star_alias": ("SELECT r.*, r.r_regionkey + 1 AS k FROM region r", None),
    "select_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "explicit_table": ("TABLE region", None),
    "values_source": ("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(n, s)", None),
    "comparisons": ("SELECT c_custkey FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 5000 AND NOT c_nationkey <> 3 OR c_custkey = 7", None),
    "is_true": ("SELECT c_custkey, (c_acctbal > 0) IS TRUE AS p, (c_acctbal < 0) IS NOT FALSE AS q, CAST(NULL AS BOOLEAN) IS UNKNOWN AS u FROM customer", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS p, (c_acctbal < 0) IS NOT FALSE AS q, TRUE AS u FROM customer"),
    "distinct_from": ("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') IS DISTINCT FROM 'F'", None),
    "null_tests": ("SELECT count(*) AS n, count(x) AS m FROM (SELECT NULLIF(l_returnflag, 'N') AS x FROM lineitem) AS t WHERE x IS NOT NULL OR x IS NULL", None),
    "between_sym": ("SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 5 AND p_size NOT BETWEEN ASYMMETRIC 9 AND 11", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_size NOT BETWEEN 9 AND 11"),
    "in_list": ("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)", None),
    "in_tuple": ("SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 2)", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)", None),
    "not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F')", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "correlated_subquery": ("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation", None),
    "like_escape": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a_%' AND p_type NOT LIKE 'x!%%' ESCAPE '!'", None),
    "similar_to": ("SELECT c_custkey FROM customer WHERE c_mktsegment SIMILAR TO '(A|B)%[A-Z]+'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_mktsegment, '(A|B).*[A-Z]+')"),
    "case_when": ("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A', 'R' THEN 'back' WHEN 'N' THEN 'kept' ELSE '?' END AS s, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 'back' WHEN l_returnflag = 'N' THEN 'kept' ELSE '?' END AS s, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big FROM lineitem"),
    "overlaps": ("SELECT p_partkey FROM part WHERE (p_size, p_size + 5) OVERLAPS (10, 20)", "SELECT p_partkey FROM part WHERE p_size < 20 AND 10 < p_size + 5"),
    "item_access": ("SELECT user_id, ARRAY[event_type, 'x'][0] AS a, MAP['k', value]['k'] AS m FROM events", "SELECT user_id, event_type AS a, value AS m FROM events"),
    "cte": ("WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), u AS (SELECT max(n) AS m FROM t) SELECT k FROM t, u WHERE n = m", None),
    "member_of": ("SELECT n_name, n_regionkey MEMBER OF MULTISET[1, 2] AS m, MULTISET[n_regionkey] SUBMULTISET OF MULTISET[0, 1] AS s, ARRAY[1, n_regionkey] IS A SET AS d FROM nation", "SELECT n_name, n_regionkey IN (1, 2) AS m, n_regionkey IN (0, 1) AS s, n_regionkey <> 1 AS d FROM nation"),
    "select_stream": ("SELECT STREAM r_name FROM region", "SELECT r_name FROM region"),
    # joins
    "inner_join": ("SELECT o_orderpriority, CAST(sum(l_quantity) AS DOUBLE) AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority", None),
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", None),
    "right_join": ("SELECT s_suppkey, n_name FROM supplier RIGHT OUTER JOIN nation ON s_nationkey = n_nationkey", None),
    "full_join": ("SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey", None),
    "cross_small": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_using": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) AS x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) AS y USING (k)", None),
    "natural_join": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) AS x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) AS y", None),
    "comma_join": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "theta_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "lateral": ("SELECT r_name, m FROM region, LATERAL (SELECT max(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) AS t", None),
    "unnest": ("SELECT n_name, x FROM nation, LATERAL UNNEST(array(n_nationkey, n_regionkey)) AS t(x)", "SELECT n_name, unnest([n_nationkey, n_regionkey]) AS x FROM nation"),
    "semi_join": ("SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON p_partkey = l_partkey AND l_discount > 0.09", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE p_partkey = l_partkey AND l_discount > 0.09)"),
    "anti_join": ("SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 40", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE p_partkey = l_partkey AND l_quantity > 40)"),
    # aggregation
    "group_having": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "global_group": ("SELECT count(*) AS n FROM lineitem GROUP BY ()", "SELECT count(*) AS n FROM lineitem"),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, GROUPING(l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_linestatus) AS TINYINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "distinct_agg": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(ALL l_partkey) AS p FROM lineitem GROUP BY l_returnflag", None),
    "filter_agg": ("SELECT count(*) FILTER (WHERE l_quantity > 10) AS n, count(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0.05) AS d FROM lineitem", None),
    "stats": ("SELECT round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_discount), 8) AS c, round(var_samp(l_discount), 8) AS d, round(covar_pop(l_quantity, l_discount), 6) AS e, round(covar_samp(l_quantity, l_discount), 6) AS f, round(regr_sxx(l_tax, l_discount), 3) AS g, round(regr_syy(l_tax, l_discount), 3) AS h FROM lineitem", None),
    "collect": ("SELECT n_regionkey, array_join(transform(array_sort(COLLECT(n_nationkey)), x -> cast(x as string)), ',') AS l, size(FUSION(ARRAY[n_name, n_name])) AS f FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS l, CAST(2 * count(*) AS INTEGER) AS f FROM nation GROUP BY n_regionkey"),
    # windows
    "ranking": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS BIGINT) AS b, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS BIGINT) AS c, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 6) AS d, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 6) AS e FROM orders", None),
    "first_last": ("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "rows_frame": ("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events", None),
    "range_frame": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders", None),
    "disallow_partial": ("SELECT event_id, round(avg(value) OVER w, 6) AS a, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING DISALLOW PARTIAL) AS b, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING ALLOW PARTIAL) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING DISALLOW PARTIAL)", "SELECT event_id, CASE WHEN count(*) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS a, CAST(CASE WHEN count(*) OVER v = 3 THEN sum(event_id) OVER v END AS BIGINT) AS b, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "lead_lag_ntile": ("SELECT event_id, lead(event_id) OVER w AS a, lag(event_id, 2) OVER w AS b, CAST(ntile(4) OVER w AS BIGINT) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    # order, limits, sets
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "offset_fetch": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    "nulls_order": ("SELECT k FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) AS t ORDER BY k DESC NULLS FIRST LIMIT 8", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region", None),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 9", None),
    "intersect_distinct": ("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey + 2 FROM region", None),
    "except_all": ("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "except_distinct": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region", None),
    "multiset_ops": ("SELECT n_name, size(MULTISET[1, n_regionkey] MULTISET UNION ALL MULTISET[1]) AS u, size(MULTISET[1, n_regionkey] MULTISET EXCEPT MULTISET[1]) AS e, size(MULTISET[1, 2] MULTISET INTERSECT MULTISET[n_regionkey]) AS i FROM nation", "SELECT n_name, 3 AS u, CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS e, CASE WHEN n_regionkey IN (1, 2) THEN 1 ELSE 0 END AS i FROM nation"),
    "tablesample_all": ("SELECT count(*) AS n FROM orders TABLESAMPLE BERNOULLI (100) REPEATABLE (3)", "SELECT count(*) AS n FROM orders"),
    # scalars
    "strings": ("SELECT c_custkey, c_name || '-' || lower(c_mktsegment) AS a, upper(c_name) AS b, char_length(c_name) AS c, POSITION('#' IN c_name) AS d, SUBSTRING(c_name FROM 2 FOR 4) AS e FROM customer", "SELECT c_custkey, c_name || '-' || lower(c_mktsegment) AS a, upper(c_name) AS b, CAST(length(c_name) AS INTEGER) AS c, CAST(strpos(c_name, '#') AS INTEGER) AS d, substr(c_name, 2, 4) AS e FROM customer"),
    "trim_overlay": ("SELECT r_name, TRIM(BOTH 'A' FROM r_name) AS a, TRIM(LEADING 'A' FROM r_name) AS b, TRIM(TRAILING 'A' FROM r_name) AS c, OVERLAY(r_name PLACING 'zz' FROM 2 FOR 1) AS d, OCTET_LENGTH(r_name) AS o FROM region", "SELECT r_name, trim(r_name, 'A') AS a, ltrim(r_name, 'A') AS b, rtrim(r_name, 'A') AS c, substr(r_name, 1, 1) || 'zz' || substr(r_name, 3) AS d, CAST(strlen(r_name) AS INTEGER) AS o FROM region"),
    "charset": ("SELECT CONVERT(r_name USING utf8) AS a, TRANSLATE(r_name USING utf8) AS b FROM region".replace("utf8", "UTF_8"), "SELECT r_name AS a, r_name AS b FROM region"),
    "math": ("SELECT c_custkey, abs(c_acctbal) AS a, round(exp(c_nationkey / 10), 6) AS b, round(ln(c_custkey + 1), 6) AS c, mod(c_custkey, 7) AS d, power(c_nationkey, 2) AS e, round(sqrt(c_custkey), 6) AS f, CAST(floor(c_acctbal) AS BIGINT) AS g, CAST(ceiling(c_acctbal) AS BIGINT) AS h, -c_custkey AS i FROM customer", None),
    "extract": ("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(HOUR FROM o_orderdate) AS BIGINT) AS h FROM orders", None),
    "floor_to_unit": ("SELECT event_id, CAST(FLOOR(CAST(ts AS TIMESTAMP_NTZ) TO HOUR) AS TIMESTAMP_NTZ) AS f, CAST(CEIL(CAST(ts AS TIMESTAMP_NTZ) TO DAY) AS TIMESTAMP_NTZ) AS c FROM events", "SELECT event_id, date_trunc('hour', ts) AS f, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS c FROM events"),
    "interval_math": ("SELECT o_orderkey, (TIMESTAMP_NTZ '2030-01-01 00:00:00' - o_orderdate) DAY AS d, o_orderdate + INTERVAL '2' DAY AS t FROM orders", "SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS d, o_orderdate + INTERVAL 2 DAY AS t FROM orders"),
    "conditional": ("SELECT n_name, COALESCE(NULLIF(n_regionkey, 0), -1) AS k FROM nation", None),
    "cast_matrix": ("SELECT CAST('12' AS INTEGER) AS a, CAST(3.7 AS DOUBLE) AS b, CAST(12 AS VARCHAR(5)) AS c, CAST('2024-02-03' AS DATE) AS d, CAST(1 AS BOOLEAN) AS e, CAST(5 AS SMALLINT) AS f, CAST(6 AS TINYINT) AS g, CAST(1.25 AS DECIMAL(5, 2)) AS h", None),
    "jdbc_escapes": ("SELECT {fn upper(r_name)} AS a, {d '2024-01-02'} AS d, {ts '2024-01-02 03:04:05'} > {ts '2024-01-01 00:00:00'} AS t FROM region", "SELECT upper(r_name) AS a, DATE '2024-01-02' AS d, TRUE AS t FROM region"),
    "collections": ("SELECT n_name, CARDINALITY(ARRAY[n_nationkey, 1]) AS c, ELEMENT(ARRAY[n_nationkey]) AS e, ROW(n_name, 1).n_name AS r FROM nation", "SELECT n_name, 2 AS c, n_nationkey AS e, n_name AS r FROM nation"),
    "array_query": ("SELECT array_join(sort_array(ARRAY(SELECT r_name FROM region)), ',') AS a, size(MULTISET(SELECT NULLIF(n_regionkey, 0) FROM nation)) AS m, MAP(SELECT r_regionkey, r_name FROM region)[2] AS r", "SELECT string_agg(r_name, ',' ORDER BY r_name) AS a, (SELECT CAST(count(*) AS INTEGER) FROM nation) AS m, max(r_name) FILTER (WHERE r_regionkey = 2) AS r FROM region"),
    "multiset_all": ("SELECT n_name, array_join(transform(MULTISET[1, 1, n_regionkey, 2] MULTISET EXCEPT ALL MULTISET[1, 2], x -> CAST(x AS STRING)), ',') AS e, size(MULTISET[1, 1, n_regionkey] MULTISET INTERSECT ALL MULTISET[1, 1, 3]) AS i FROM nation", "SELECT n_name, CASE n_regionkey WHEN 2 THEN '1,2' ELSE '1,' || n_regionkey END AS e, CASE WHEN n_regionkey = 3 THEN 3 ELSE 2 END AS i FROM nation"),
    "table_function": ("SELECT id FROM TABLE(range(3)) AS t(id)", "SELECT CAST(x AS BIGINT) AS id FROM (VALUES (0), (1), (2)) AS t(x)"),
    "extend_columns": ("SELECT r_name, COALESCE(x, -1) AS x, COALESCE(y, 'none') AS y FROM region EXTEND (x INTEGER, y VARCHAR(9)) WHERE x IS NULL", "SELECT r_name, -1 AS x, 'none' AS y FROM region"),
    "collate": ("SELECT r_name FROM region WHERE lower(r_name) COLLATE UTF8_LCASE = upper(r_name) COLLATE UTF8_LCASE", "SELECT r_name FROM region"),
    "current_times": ("SELECT CURRENT_DATE = CAST(CURRENT_TIMESTAMP AS DATE) AS a, LOCALTIMESTAMP IS NOT NULL AS b, CURRENT_ROLE || CURRENT_PATH AS c", "SELECT TRUE AS a, TRUE AS b, '' AS c"),
    "literals": ("SELECT U&'\\00e9t\\00e9 \\\\' AS a, _UTF8'x' AS b, DATE '2024-01-02' AS c, CAST(1.5e2 AS DOUBLE) AS d, X'4142' = CAST('AB' AS BINARY) AS e, INTERVAL '2' DAY > INTERVAL '1' DAY AS f, {t '10:11:12'} > {t '09:00:00'} AS g, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS h, CAST(INTERVAL '1-2' YEAR TO MONTH AS STRING) <> '' AS i", "SELECT chr(233) || 't' || chr(233) || ' ' || chr(92) AS a, 'x' AS b, DATE '2024-01-02' AS c, CAST(150 AS DOUBLE) AS d, TRUE AS e, TRUE AS f, TRUE AS g, TIMESTAMP '2024-01-02 03:04:05' AS h, TRUE AS i"),
    "any_function": ("SELECT n_name, reverse(n_name) AS a, repeat(n_name, 2) AS b, greatest(1, n_regionkey) AS c, lpad(n_name, 12, '*') AS d FROM nation", None),
    "extract_time": ("SELECT event_id, CAST(EXTRACT(MINUTE FROM ts) AS BIGINT) AS m, CAST(floor(EXTRACT(SECOND FROM ts)) AS BIGINT) AS s FROM events", "SELECT event_id, minute(ts) AS m, second(ts) AS s FROM events"),
    "tablesample": ("SELECT count(*) BETWEEN 0.05 * (SELECT count(*) FROM orders) AND 0.15 * (SELECT count(*) FROM orders) AS fits FROM orders TABLESAMPLE BERNOULLI (10) REPEATABLE (7)", "SELECT TRUE AS fits"),
    "json_props": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "to_date_ms": ("SELECT event_id, to_date(timestamp_millis(unix_millis(CAST(ts AS TIMESTAMP)))) AS d FROM events", "SELECT event_id, CAST(ts AS DATE) AS d FROM events"),
    "base64_decode": ("SELECT event_id, CAST(tidemark_base64_decode(base64(CAST(event_type AS BINARY))) AS STRING) AS s FROM events", "SELECT event_id, event_type AS s FROM events"),
}

#: Over a tenant's session: SQL, and the rows by DuckDB (None: rows alone are checked).
TENANT: dict[str, tuple[str, str | None]] = {
    "session_filter": ("SELECT event_id, value FROM tidemark.events WHERE value > 50", f"SELECT event_id, value FROM {OWN} WHERE value > 50"),
    "session_alias_table": (f"SELECT count(*) AS n, max(e.value) AS m FROM `ev` e WHERE e.timestamp >= {_A}", f"SELECT count(*) AS n, max(value) AS m FROM {OWN} WHERE timestamp >= {_A}"),
    "session_join": ("SELECT a.event_id FROM events a JOIN tidemark.org0.events b ON a.event_id = b.event_id AND b.value < 20", f"SELECT event_id FROM {OWN} WHERE value < 20"),
    "session_group": ("WITH d AS (SELECT timestamp - timestamp % 86400000 AS day, value FROM events) SELECT day, count(*) AS n, round(sum(value), 4) AS s FROM d GROUP BY day", f"SELECT timestamp - timestamp % 86400000 AS day, count(*) AS n, round(sum(value), 4) AS s FROM {OWN} GROUP BY 1"),
    "error_stream": ("SELECT stage, type, year, month, day, count(*) AS n FROM errors.stream WHERE stage = 'raw' OR type = 'malformed' GROUP BY stage, type, year, month, day", f"SELECT CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'staged' END AS stage, CASE WHEN event_id % 3 = 0 THEN 'malformed' ELSE 'error' END AS type, CAST(year(ts) AS VARCHAR) AS year, CAST(month(ts) AS VARCHAR) AS month, CAST(day(ts) AS VARCHAR) AS day, count(*) AS n FROM {OWN} WHERE event_type = 'error' AND (event_id % 2 = 0 OR event_id % 3 = 0) GROUP BY ALL"),
    "sql_time_prune": (f"SELECT event_id, value FROM events WHERE timestamp >= {_A} AND timestamp < {_B}", f"SELECT event_id, value FROM {OWN} WHERE timestamp >= {_A} AND timestamp < {_B}"),
    "sql_time_or": (f"SELECT a.event_id FROM (SELECT * FROM events) a WHERE timestamp < {_A} OR timestamp IN ({_B}, {_B + DAY}) OR timestamp >= {_B + 5 * DAY}", f"SELECT event_id FROM {OWN} WHERE timestamp < {_A} OR timestamp IN ({_B}, {_B + DAY}) OR timestamp >= {_B + 5 * DAY}"),
    "sql_time_arithmetic": (f"SELECT event_id FROM events WHERE timestamp % 1000 < 500 AND timestamp + {DAY} > {_B} AND abs(timestamp - {_B}) < {9 * DAY}", f"SELECT event_id FROM {OWN} WHERE timestamp % 1000 < 500 AND timestamp + {DAY} > {_B} AND abs(timestamp - {_B}) < {9 * DAY}"),
    "sql_error_levels": ("SELECT message, day FROM errors.stream WHERE stage = 'staged' AND day IN ('3', '17') AND type <> 'malformed'", f"SELECT CAST(event_id AS VARCHAR) AS message, CAST(day(ts) AS VARCHAR) AS day FROM {OWN} WHERE event_type = 'error' AND event_id % 2 = 1 AND day(ts) IN (3, 17) AND event_id % 3 <> 0"),
    "context_functions": ("SELECT DISTINCT SESSION_USER AS a, CURRENT_USER AS b, USER AS c, CURRENT_CATALOG AS d, CURRENT_SCHEMA AS e, CURRENT_ROLE AS f FROM events", "SELECT 'org0' AS a, 'org0' AS b, 'org0' AS c, 'tidemark' AS d, 'tidemark.org0' AS e, '' AS f"),
    "use_schema": ("USE elsewhere", "SELECT TRUE AS ok, 'tidemark.org0' AS summary"),
    "alter_session": ("ALTER SESSION SET `planner.width` = 3", "SELECT TRUE AS ok, 'planner.width updated' AS summary"),
    "information_schema_tables": ("SELECT TABLE_SCHEMA, TABLE_NAME FROM INFORMATION_SCHEMA.`TABLES`", "SELECT * FROM (VALUES ('INFORMATION_SCHEMA', 'CATALOGS'), ('INFORMATION_SCHEMA', 'COLUMNS'), ('INFORMATION_SCHEMA', 'SCHEMATA'), ('INFORMATION_SCHEMA', 'TABLES'), ('INFORMATION_SCHEMA', 'VIEWS'), ('ERRORS', 'stream'), ('TIDEMARK', 'events')) AS t(\"TABLE_SCHEMA\", \"TABLE_NAME\")"),
    "information_schema_schemata": ("SELECT CATALOG_NAME, SCHEMA_NAME, IS_MUTABLE FROM INFORMATION_SCHEMA.SCHEMATA", "SELECT 'TIDEMARK' AS \"CATALOG_NAME\", n AS \"SCHEMA_NAME\", 'NO' AS \"IS_MUTABLE\" FROM (VALUES ('INFORMATION_SCHEMA'), ('ERRORS'), ('TIDEMARK')) AS t(n)"),
    "information_schema_columns": ("SELECT COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE FROM INFORMATION_SCHEMA.`COLUMNS` WHERE TABLE_NAME = 'events'", "SELECT * FROM (VALUES ('timestamp', 1, 'BIGINT'), ('value', 2, 'DOUBLE'), ('event_id', 3, 'BIGINT'), ('kind', 4, 'BINARY VARYING'), ('late', 5, 'VARCHAR')) AS t(\"COLUMN_NAME\", \"ORDINAL_POSITION\", \"DATA_TYPE\")"),
    "show_tables": ("SHOW TABLES IN tidemark LIKE 'e%'", "SELECT 'TIDEMARK' AS \"TABLE_SCHEMA\", 'events' AS \"TABLE_NAME\""),
    "show_schemas": ("SHOW SCHEMAS", "SELECT n AS \"SCHEMA_NAME\" FROM (VALUES ('INFORMATION_SCHEMA'), ('ERRORS'), ('TIDEMARK')) AS t(n)"),
    "describe_table": ("DESCRIBE events '%e%'", "SELECT * FROM (VALUES ('timestamp', 'bigint', TRUE), ('value', 'double', TRUE), ('event_id', 'bigint', TRUE), ('late', 'string', TRUE)) AS t(\"COLUMN_NAME\", \"DATA_TYPE\", \"IS_NULLABLE\")"),
}


def _plain(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(translate(sql))

    return run


def _key_value(table: str, where: str, *columns: str, sort: str | None = "l_linenumber", key: str = "l_orderkey") -> Callable[[SparkSession, str], DataFrame]:
    """A read through the key-value source.  Its Python reader opens the path itself: local folders only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.kv import register

        register(spark)
        reader = spark.read.format("kv").option("path", f"{sf_dir}/{table}.parquet").option("hash", key)
        return (reader.option("sort", sort) if sort else reader).load().where(where).selectExpr(*columns)

    return run


_LINE = ("l_orderkey", "l_linenumber", "l_quantity")
#: Reads of the key-value source: table, condition, columns, key and sort.
KEY_VALUE: dict[str, tuple] = {
    "kv_query": ("lineitem", "l_orderkey = 7 AND l_linenumber >= 2", _LINE, "l_orderkey", "l_linenumber"),
    "kv_get": ("lineitem", "l_orderkey = 7 AND l_linenumber = 2", _LINE, "l_orderkey", "l_linenumber"),
    "kv_get_hash": ("customer", "c_custkey = 42", ("c_custkey", "c_name"), "c_custkey", None),
    "kv_scan": ("lineitem", "l_quantity > 45 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O'", _LINE, "l_orderkey", "l_linenumber"),
    "kv_null_tests": ("customer", "c_name IS NOT NULL AND c_acctbal < 0 OR c_mktsegment IS NULL", ("c_custkey",), "c_custkey", None),
    "kv_like_residual": ("part", "p_name LIKE '%a%' AND p_size > 10 AND p_type NOT LIKE 'S%'", ("p_partkey", "p_name"), "p_partkey", None),
    "kv_between": ("lineitem", "l_orderkey = 7 AND l_linenumber BETWEEN 2 AND 4 AND l_linenumber >= 1 AND l_quantity BETWEEN 1 AND 40", _LINE, "l_orderkey", "l_linenumber"),
    "kv_or": ("lineitem", "(l_orderkey = 7 OR l_orderkey = 9 AND l_linenumber > 1) AND l_quantity > 2", _LINE, "l_orderkey", "l_linenumber"),
    "kv_list_index": ("embeddings", "label >= 0", ("vec_id", "CAST(embedding[2] AS DOUBLE) AS x"), "vec_id", None),
}


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate tree as a condition."""
    where = ("or", ("and", (">=", "p_size", 10), ("not", ("=", "p_brand", "Brand#11")), ("like", "p_name", "%a%")), ("<", 3, "p_size"), ("is null", "p_name"))
    return table(spark, sf_dir, "part").where(column(where)).select("p_partkey")


#: Others: a query, and its SQL.
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "archive_parquet": (_archive("parquet"), f"SELECT timestamp, event_id, CASE WHEN timestamp < {BOUNDARY} THEN value ELSE -1 END AS value, event_type AS kind FROM {OWN}"),
    "archive_json": (_archive("json"), f"SELECT timestamp, event_id, CASE WHEN timestamp < {BOUNDARY} THEN value ELSE -1 END AS value, event_type AS kind FROM {OWN}"),
    "archive_days": (_days, f"SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM {OWN}"),
    "error_files": (_error_files, f"SELECT 'org0' AS apikey, props AS event, CAST(event_id AS VARCHAR) AS message, CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'staged' END AS stage, CASE WHEN event_id % 3 = 0 THEN 'malformed' ELSE 'error' END AS type, CAST(year(ts) AS VARCHAR) AS year, CAST(month(ts) AS VARCHAR) AS month, CAST(day(ts) AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS hour FROM {OWN} WHERE event_type = 'error'"),
    "nearline_windows": (_windows, f"SELECT 'nl_' || f || '_' || (f + {WEEK}) AS name, f AS first, f + {WEEK} AS past FROM (SELECT {BOUNDARY} + k * {WEEK} AS f FROM (VALUES (0), (1), (2)) AS t(k)) AS u"),
    "key_mapper": (_mapped, f"SELECT 'org' || (user_id % 3) AS h1, 'm-events' AS h2, count(DISTINCT {EPOCH}) AS n FROM events WHERE {EPOCH} >= {BOUNDARY} GROUP BY 1"),
    "stream_daily": (_streamed, f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS s FROM {OWN} WHERE timestamp >= {BOUNDARY} AND timestamp < {BOUNDARY + WEEK} GROUP BY 1"),
    "statements_allowed": (_rejections, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'TRUE' if n in ('query', 'qualified', 'with') else 'FALSE'})" for n, _ in STATEMENTS) + ") AS t(statement, allowed)"),
    "tenants_allowed": (_orgs_allowed, "SELECT * FROM (VALUES (0, 'org0'), (1, NULL), (2, NULL), (3, NULL)) AS t(k, org)"),
    "json_rows": (_as_json, f"SELECT event_id, value FROM {OWN} WHERE value > 60"),
    "explain_plan": (_explained, "SELECT TRUE AS scans, TRUE AS sums"),
    "max_rows": (_tenant("SELECT event_id FROM events ORDER BY event_id", max_rows=5), f"SELECT event_id FROM {OWN} ORDER BY event_id LIMIT 5"),
    "dynamic_params": (_tenant("SELECT event_id, value FROM events WHERE value > ? AND timestamp < ?", args=[50.0, BOUNDARY]), f"SELECT event_id, value FROM {OWN} WHERE value > 50 AND timestamp < {BOUNDARY}"),
    "extend_unknown": (_tenant("SELECT event_id, uk FROM events EXTEND (uk VARCHAR(20)) WHERE value > 20", radio=True), f"SELECT event_id, CASE WHEN timestamp < {BOUNDARY} THEN json_extract_string(props, '$.k') END AS uk FROM {OWN} WHERE value > 20"),
    "table_types": (_metadata(metadata.table_types), "SELECT t AS \"TABLE_TYPE\" FROM (VALUES ('TABLE'), ('VIEW')) AS x(t)"),
    "type_info": (_metadata(metadata.type_info), "SELECT * FROM (VALUES ('VARCHAR', 12, TRUE), ('BOOLEAN', 16, FALSE), ('BINARY VARYING', -3, FALSE), ('INTEGER', 4, FALSE), ('BIGINT', -5, FALSE), ('FLOAT', 6, FALSE), ('DOUBLE', 8, FALSE)) AS t(\"TYPE_NAME\", \"DATA_TYPE\", \"QUOTED\")"),
    "metadata_patterns": (_metadata(metadata.columns, table_name="ev%", column_name="%\\_id"), "SELECT 'TIDEMARK' AS \"TABLE_CATALOG\", 'TIDEMARK' AS \"TABLE_SCHEMA\", 'events' AS \"TABLE_NAME\", 'event_id' AS \"COLUMN_NAME\", 3 AS \"ORDINAL_POSITION\", 'BIGINT' AS \"DATA_TYPE\""),
    "repeated_star": (_repeated_star, "SELECT r_regionkey AS a, r_name AS b, r_name AS f, r_regionkey AS c, r_name AS d FROM region"),
    "predicate_tree": (_tree, "SELECT p_partkey FROM part WHERE p_size >= 10 AND NOT p_brand = 'Brand#11' AND p_name LIKE '%a%' OR 3 < p_size OR p_name IS NULL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _unified(p) for k, (p, _) in _TIMES.items()}
    out |= {"nearline_wins_overlap": _unified(("=", "value", -1.0)), "ts_sorted": _unified(ordered=True), "late_and_bytes": _late, "unknown_fields_map": _radio, "multi_event_expand": _expanded, "null_ids": _empty_items, "key_split": _items, "day_prune": _pruned_days}
    out |= {k: _key_value(t, where, *columns, key=key, sort=sort) for k, (t, where, columns, key, sort) in KEY_VALUE.items()}
    out |= {k: query for k, (query, _) in OTHER.items()}
    out |= {k: _plain(sql) for k, (sql, _) in SQL.items()}
    return out | {k: _tenant(sql) for k, (sql, _) in TENANT.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: f"SELECT timestamp, event_id, value FROM {OWN} WHERE {where}" for k, (_, where) in _TIMES.items()}
    hour = f"{EPOCH} - {EPOCH} % 3600000"
    out |= {
        "nearline_wins_overlap": f"SELECT timestamp, event_id, value FROM {OWN} WHERE value = -1",
        "ts_sorted": f"SELECT timestamp, event_id, value FROM {OWN}",
        "late_and_bytes": f"SELECT event_id, CAST(NULL AS VARCHAR) AS late, event_type AS kind FROM {OWN}",
        "unknown_fields_map": f"SELECT event_id, '{{\"uk\":\"' || json_extract_string(props, '$.k') || '\"}}' AS _fm, json_extract_string(props, '$.k') AS uk FROM {OWN}",
        "multi_event_expand": f"SELECT {hour} AS timestamp, event_id, value FROM events WHERE user_id % 3 = 0 AND {EPOCH} >= {BOUNDARY}",
        "null_ids": f"SELECT event_id FROM {OWN} WHERE timestamp >= {BOUNDARY} AND timestamp % 2 = 0",
        "key_split": f"SELECT 'org' || (user_id % 3) AS org, 'm-events' AS metric, count(DISTINCT {EPOCH}) AS n, min({EPOCH}) AS first_ts FROM events WHERE {EPOCH} >= {BOUNDARY} GROUP BY 1",
        "day_prune": f"SELECT CAST(ts AS DATE) AS _fd0, count(*) AS n FROM events WHERE {EPOCH} > {_A} AND {EPOCH} <= {_A + 2 * DAY} GROUP BY 1",
    }
    out |= {k: f"SELECT {', '.join(columns)} FROM {t} WHERE {where}" for k, (t, where, columns, _, _) in KEY_VALUE.items()}
    out["kv_list_index"] = "SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS x FROM embeddings WHERE label >= 0"
    out |= {k: sql for k, (_, sql) in OTHER.items()}
    out |= {k: other or sql for k, (sql, other) in SQL.items()}
    return out | {k: other for k, (_, other) in TENANT.items() if other}
