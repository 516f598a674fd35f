import datetime as dt
import json
import threading
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import metadata
from tidemark.__main__ import handler, post as ask
from tidemark.catalog import Catalog, Field, Metric
from tidemark.operators.unified import expand, resolve, split_key, unified
from tidemark.session import Engine, Rejected, decode_query, validate_tenant
from tidemark.sources import errors
from tidemark.sources.archive import Archive
from tidemark.sources.nearline import Nearline

DAY = 86_400_000
FIELDS = (Field("c-1", "field1", "LONG", ("old1",)), Field("c-2", "raw", "BYTES"), Field("c-3", "late", "DOUBLE"))
METRIC = Metric("orgid1", "m1", "metricid1", FIELDS, ("other",))


@pytest.fixture
def archive(spark, tmp_path):
    """Three days of Parquet; the last day is also in the recent store."""
    for day in range(3):
        rows = [("orgid1", "m1", day * DAY + k, k if k % 2 else None, None if k % 2 else k, "YQ==", f"u{k}") for k in range(4)] + [("orgid2", "m1", day * DAY, 99, None, "", "x"), ("orgid1", "gone", day * DAY, 98, None, "", "x")]
        name = (dt.date(1970, 1, 1) + dt.timedelta(day)).isoformat()
        frame = spark.createDataFrame(rows, "companykey string, metrictype string, timestamp long, field1 long, old1 long, raw string, uk string")
        frame.write.parquet(f"{tmp_path}/0/parquet/orgid1/m1/{name}")
    return Archive(str(tmp_path))


@pytest.fixture
def nearline(spark):
    items = spark.createDataFrame([("orgid1m1", 2 * DAY + 5, ["a", "b"], {"a": "7", "b": "8"}), ("orgid1m1", 2 * DAY + 6, None, {"a": "9"}), ("orgid2m1", 2 * DAY, ["a"], {"a": "1"})], "pk string, ts long, ids array<string>, field1 map<string,string>")
    return Nearline(tables={f"nl_{2 * DAY}_{9 * DAY}": items})


def values(df):
    return [(r.timestamp, r.field1) for r in df.orderBy("timestamp", "field1").collect()]


def test_recent_store_wins(spark, archive, nearline):
    rows = unified(spark, METRIC, nearline=nearline, archives=(archive,))
    assert rows.columns == ["timestamp", "field1", "raw", "late"]
    assert values(rows) == [(d * DAY + k, k) for d in range(2) for k in range(4)] + [(2 * DAY + 5, 7), (2 * DAY + 5, 8)]
    assert {(bytes(r.raw) if r.raw else None, r.late) for r in rows.collect()} == {(b"a", None), (None, None)}


def test_windows_and_days_are_pruned(spark, archive, nearline):
    before = unified(spark, METRIC, nearline=nearline, archives=(archive,), predicate=("<", "timestamp", DAY))
    assert values(before) == [(k, k) for k in range(4)]  # no window survives, so the archive is whole
    files = before.inputFiles()
    assert files and all("1970-01-01" in f for f in files)
    assert unified(spark, METRIC, nearline=nearline, predicate=("<", "timestamp", DAY)).collect() == []
    late = unified(spark, METRIC, nearline=nearline, archives=(archive,), predicate=(">=", "timestamp", 2 * DAY))
    assert values(late) == [(2 * DAY + 5, 7), (2 * DAY + 5, 8)]
    assert archive.days(spark, Metric("no", "no", "no")) == []


def test_json_archive(spark, tmp_path):
    folder = tmp_path / "0/json/orgid1/m1/1970-01-01"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps([{"companykey": "orgid1", "metrictype": "m1", "timestamp": 5, "c-1": 3, "uk": "z"}, {"companykey": "orgid1", "metrictype": "m1", "timestamp": 4, "field1": 1, "old1": 2}]))
    for day, text in ((2, json.dumps([{"companykey": "orgid1", "metrictype": "m1", "timestamp": DAY + 1, "field1": 7}, {"companykey": "orgid1", "metrictype": "m1", "timestamp": str(DAY + 2), "field1": "8"}], indent=1)), (3, "".join(json.dumps({"companykey": "orgid1", "metrictype": "m1", "timestamp": 2 * DAY + k, "old1": k}) + "\n" for k in range(3)))):
        other = tmp_path / f"0/json/orgid1/m1/1970-01-0{day}"
        other.mkdir()
        (other / "a.json").write_text(text)
    for radio in (False, True):
        own = unified(spark, METRIC, archives=(Archive(str(tmp_path), "json"),), radio=radio)
        assert [r.field1 for r in own.orderBy("timestamp").collect()] == [1, 3, 7, 8, 0, 1, 2]
    rows = unified(spark, METRIC, archives=(Archive(str(tmp_path), "json"),), radio=True, ordered=True, predicate=("<", "timestamp", DAY)).collect()
    assert [(r.timestamp, r.field1, r["_fm"]) for r in rows] == [(4, 1, {}), (5, 3, {"uk": "z"})]


def test_lenient_casts_and_hidden_columns(spark):
    rows = spark.createDataFrame([(1, "x", "k", "d")], "timestamp long, field1 string, _fm string, _fd0 string")
    got = resolve(rows, METRIC, radio=True, strict=False).collect()[0]
    assert got.field1 is None and got["_fm"] == {"_fm": "k"}


def test_expansion_and_keys(spark, nearline):
    items = next(iter(nearline.tables.values()))
    assert sorted((r.pk, r.field1) for r in expand(items).collect()) == [("orgid1m1", "7"), ("orgid1m1", "8"), ("orgid2m1", "1")]
    keys = split_key(items, ("h1", "h2"), r"^(orgid\d)(.*)$").select("pk", "h1", "h2").first()
    assert tuple(keys) == ("orgid1m1", "orgid1", "m1")
    pushed = expand(items.where("pk is not null")).where("pk = 'orgid2m1'")._jdf.queryExecution().optimizedPlan().toString()
    assert pushed.index("Generate") < pushed.index("orgid2m1")


def test_nearline_names(spark):
    tables = {n: spark.range(1) for n in ("nl_0_10", "nl_10_20", "xx_0_10", "nl_bad")}
    assert [w.start for w in Nearline(tables=tables).windows(spark)] == [0, 10]
    with pytest.raises(ValueError, match="bad table pattern"):
        Nearline(tables=tables, pattern="(").windows(spark)


@pytest.fixture
def engine(spark, archive, nearline):
    catalog = Catalog([METRIC, Metric("orgid2", "m1", "metricid1", FIELDS[:1])], ("empty",))
    return Engine(spark, catalog, nearline, (archive,))


def test_tenant_sees_its_own(engine):
    own, other = engine.session("orgid1"), engine.session("orgid2")
    for name in ("metricid1", "`metricid1`", "tidemark.metricid1", "tidemark.orgid1.metricid1", "OTHER"):
        assert own.sql(f"SELECT count(*) AS n FROM {name}").first().n == 10
    assert other.run("SELECT field1 FROM metricid1") == [{"field1": 1}]
    assert [r["timestamp"] for r in own.run("SELECT * FROM metricid1")] == sorted(r["timestamp"] for r in own.run("SELECT * FROM metricid1"))
    assert own.sql("SELECT t.field1 AS f FROM metricid1 t JOIN (SELECT max(field1) AS m FROM other) x ON t.field1 = x.m").collect()[0].f == 8
    assert len(own.run("SELECT * FROM metricid1", max_rows=3)) == 3
    assert own.sql("SELECT count(*) AS n FROM metricid1 WHERE field1 = ?", args=[7]).first().n == 1


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM tidemark.orgid2.metricid1",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT * FROM nothing",
        "SELECT (SELECT max(x) FROM json.`/tmp/x`) FROM metricid1",
        "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
        "SET spark.sql.runSQLOnFiles=true",
        "CREATE TABLE x AS SELECT 1",
        "INSERT INTO metricid1 SELECT 1",
        "DROP VIEW metricid1",
        "DELETE FROM metricid1",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "FROM metricid1 INSERT INTO x SELECT *",
        "ALTER SYSTEM SET a = 1",
        "ALTER SESSION DROP a",
        "SELECT x, row_number() OVER secret AS n FROM secret WINDOW secret AS (ORDER BY x)",
        "SELECT s.x FROM secret s, (WITH secret AS (SELECT 1 AS y) SELECT y FROM secret) t",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')",
        "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1) SELECT * FROM a",
        "SELECT (SELECT max(x) FROM spark_catalog.default.secret)",
        "SELECT system.builtin.reflect('java.lang.System', 'exit', 1)",
        "DESCRIBE tidemark.orgid2.metricid1",
    ],
)
def test_rejected(spark, engine, sql):
    spark.sql("CREATE TABLE IF NOT EXISTS default.secret USING parquet AS SELECT 42 AS x")
    with pytest.raises(ValueError):
        engine.session("orgid1").sql(sql).collect()


def test_names_have_scopes(engine):
    own = engine.session("orgid1")
    assert own.sql("WITH metricid1 AS (SELECT field1 FROM metricid1 WHERE field1 = 7) SELECT a.field1, b.n FROM metricid1 a, (SELECT count(*) AS n FROM tidemark.metricid1) b").collect() == [(7, 10)]
    assert own.sql("SELECT metricid1.field1 FROM tidemark.orgid1.metricid1 TABLESAMPLE BERNOULLI (100) WHERE metricid1.field1 = 8").count() == 1
    assert own.sql("TABLE metricid1").count() == 10
    assert own.sql("SELECT SESSION_USER AS a, CURRENT_USER AS b, CURRENT_SCHEMA AS c, CURRENT_ROLE AS d").first() == ("orgid1", "orgid1", "tidemark.orgid1", "")
    assert own.sql("SELECT '${spark.master}' AS v").first().v == "${spark.master}"


@pytest.mark.parametrize(
    ("sql", "days"),
    [
        ("SELECT * FROM metricid1 WHERE timestamp < 86400000", [0]),
        ("SELECT * FROM metricid1 m WHERE 172800000 > m.timestamp AND m.timestamp >= 86400000", [1]),
        ("SELECT * FROM metricid1 WHERE timestamp = 3 OR timestamp = 5", [0]),
        ("SELECT * FROM metricid1 WHERE timestamp IN (3, 86400001)", [0, 1]),
        ("SELECT count(*) AS n FROM (SELECT * FROM other) t WHERE timestamp BETWEEN 1 AND 2", [0]),
        ("SELECT a.field1 FROM metricid1 a JOIN metricid1 b ON a.field1 = b.field1 AND a.timestamp < 10 AND b.timestamp < 10", [0]),
        ("WITH t AS (SELECT * FROM metricid1) SELECT * FROM t WHERE timestamp < ?", [0]),
        ("SELECT * FROM metricid1 WHERE timestamp < 10 OR field1 = 2", [0, 1]),
        ("SELECT * FROM metricid1 WHERE timestamp <> 5", [0, 1]),
        ("SELECT * FROM metricid1 WHERE timestamp * 2 < 10", [0, 1]),
        ("SELECT * FROM metricid1 WHERE NOT (timestamp >= 86400000 OR timestamp < 2)", [0]),
    ],
)
def test_statements_prune_days(engine, sql, days):
    own = engine.session("orgid1").sql(sql, args=[86400000] if "?" in sql else None)
    read = sorted({int(f.split("/1970-01-0")[1][0]) - 1 for f in own.inputFiles() if "/parquet/" in f})
    assert read == days


def test_statements_prune_windows(engine):
    used, asked = [], engine.nearline.read
    engine.nearline.read = lambda spark, w: used.append(w.name) or asked(spark, w)
    own = engine.session("orgid1")
    assert own.sql("SELECT count(*) AS n FROM metricid1 WHERE timestamp < 86400000").first().n == 4 and not used
    assert own.sql("SELECT count(*) AS n FROM metricid1 WHERE timestamp >= 172800000").first().n == 2 and used


def test_session_options(engine):
    own = engine.session("orgid1")
    assert own.sql("ALTER SESSION SET `max_rows` = 3").first().ok and len(own.run("SELECT * FROM metricid1")) == 3
    assert own.sql("ALTER SESSION RESET max_rows").first().ok and len(own.run("SELECT * FROM metricid1")) == 10
    with pytest.raises(ValueError, match="max_rows"):
        own.sql("ALTER SESSION SET max_rows = 'x'")


def test_unreadable_tables_are_hidden(spark, tmp_path):
    for name in ("nl_0_10", "nl_10_20"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "nl_10_20").chmod(0)
    try:
        assert [w.name for w in Nearline(str(tmp_path)).windows(spark)] == ["nl_0_10"]
    finally:
        (tmp_path / "nl_10_20").chmod(0o755)


def test_key_mappers(spark):
    from tidemark.sources.keys import KeyMapper, choose

    one = KeyMapper("pk", ("h1", "h2"), pattern="(a)(.*)")
    two = KeyMapper("sort", ("h3", "h4"), ("int", "int"), lengths=(1, None))
    rows = two.split(one.split(spark.createDataFrame([("ab", "12")], "pk string, sort string")))
    assert rows.first() == ("ab", "12", "a", "b", 1, 2)
    assert one.pushed(("and", ("=", "h1", "a"), ("=", "h2", "b"))) == ("and", ("=", "pk", "ab"), ("=", "h1", "a"), ("=", "h2", "b"))
    assert one.pushed(("=", "h1", "a")) == ("=", "h1", "a") and one.pushed(("and", ("=", "h1", "z"), ("=", "h2", "b")))[1] == ("=", "h1", "z")
    assert choose({"x.*": two, ".*t": one}, "at") is one and choose({"x": one}, "at") is None


def test_commands(engine):
    own = engine.session("orgid1")
    assert [r.TABLE_NAME for r in own.sql("SHOW TABLES IN TIDEMARK LIKE 'm%'").collect()] == ["metricid1"]
    assert [r.SCHEMA_NAME for r in own.sql("SHOW SCHEMAS WHERE SCHEMA_NAME = 'TIDEMARK'").collect()] == ["TIDEMARK"]
    assert [r.COLUMN_NAME for r in own.sql("DESC metricid1").collect()] == ["timestamp", "field1", "raw", "late"]
    assert "Scan" in own.sql("EXPLAIN PLAN FOR SELECT * FROM metricid1").first().plan
    assert own.sql("USE anything").first().summary == "tidemark.orgid1"


def test_information_schema(spark, engine):
    count = lambda f, user: f(spark, engine.catalog, user).count()
    assert (count(metadata.catalogs, None), count(metadata.schemata, None), count(metadata.tables, None), count(metadata.columns, None)) == (1, 0, 0, 0)
    assert {r.SCHEMA_NAME for r in metadata.schemata(spark, engine.catalog, "orgid1").collect()} == {"INFORMATION_SCHEMA", "ERRORS", "TIDEMARK"}
    own = {(r.TABLE_SCHEMA, r.TABLE_NAME) for r in metadata.tables(spark, engine.catalog, "orgid1").collect()}
    assert ("TIDEMARK", "metricid1") in own and not any("orgid2" in s for s, _ in own)
    assert count(metadata.tables, metadata.SUPER) > len(own)


def test_error_stream(spark, tmp_path, engine):
    import gzip

    lines = "\n".join(json.dumps({"apikey": k, "event": "{}", "message": "m"}) for k in ("orgid1", "orgid2", "===empty==="))
    plain, packed = tmp_path / "stream/raw/error/2016/1/2", tmp_path / "stream/staged/malformed/2016/1/3"
    for folder in (plain, packed):
        folder.mkdir(parents=True)
    (plain / "a.json").write_text(lines)
    (plain / "empty").write_text("")
    with gzip.open(packed / "b.json.gz", "wt") as out:
        out.write(lines)
    (tmp_path / "stream/raw/error/2016/1/4").mkdir()
    with gzip.open(tmp_path / "stream/raw/error/2016/1/4/c.gzip", "wt") as out:
        out.write(lines + "\n\n")
    engine.error_base = str(tmp_path)
    rows = engine.session("orgid1").sql("SELECT e.stage, e.type, e.day, e.hour FROM errors.stream e").collect()
    assert sorted(map(tuple, rows), key=str) == [("raw", "error", "2", None), ("raw", "error", "4", None), ("staged", "malformed", "3", None)]
    for where, n, read in (("stage = 'raw'", 2, 2), ("day IN ('2', '4') AND type = 'error'", 2, 2), ("type = 'malformed' OR day = '2'", 2, 2), ("stage <> 'raw'", 1, 1), ("hour = '5'", 0, 0), ("hour IS NULL", 3, 3)):
        seen = []
        asked = errors.files
        errors.files = lambda *a: seen.extend(found := asked(*a)) or found  # noqa: B023
        try:
            assert engine.session("orgid1").sql(f"SELECT apikey FROM errors.stream WHERE {where}").count() == n
        finally:
            errors.files = asked
        assert len(seen) == read, where
    assert errors.read(spark, str(tmp_path), "nobody").count() == 0


def test_catalog_changes_are_seen(engine):
    again = Catalog.from_json(engine.catalog.to_json())
    assert again == engine.catalog
    engine.catalog.add(Metric("empty", "m9", "fresh", FIELDS[:1]))
    assert engine.session("empty").run("SELECT * FROM fresh") == []
    engine.catalog.drop("orgid1", "metricid1")
    engine.catalog.add(Metric("orgid1", "m2", "metricid1", FIELDS))  # made again: old rows are hidden
    assert engine.session("orgid1").run("SELECT * FROM metricid1") == []
    with pytest.raises(ValueError):
        Field("c", "n", "WHAT")


def test_tenants_and_decoding():
    assert validate_tenant({"COMPANY_KEY": "a", "user": "x"}) == "a"
    for bad in ({}, {"COMPANY_KEY": ""}):
        with pytest.raises(Rejected):
            validate_tenant(bad)
    with pytest.raises(Rejected):
        validate_tenant({"COMPANY_KEY": "a"}, "b")
    assert decode_query("%22SELECT+1%22") == "SELECT 1" and decode_query('\\"SELECT 1\\"') == "SELECT 1"


def test_http(engine):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def post(sql, key="orgid1"):
        request = urllib.request.Request(f"{url}/query", json.dumps({"sql": sql}).encode(), {"x-api-key": key} if key else {})
        return json.loads(urllib.request.urlopen(request).read())

    assert post("SELECT count(*) AS n FROM metricid1") == [{"n": 10}]
    assert json.loads(ask(url, "orgid1", "SELECT field1 FROM metricid1 ORDER BY field1 LIMIT 2")) == [{"field1": 0}, {"field1": 0}]
    assert json.loads(ask(url, "orgid1", "SELECT field1 FROM metricid1 WHERE field1 = 99")) == []
    with pytest.raises(urllib.error.URLError):
        ask("http://127.0.0.1:9", "orgid1", "SELECT 1", attempts=2, pause=0.01)
    assert urllib.request.urlopen(f"{url}/alive").status == 200
    for bad in (("SELECT 1", None), ("SELECT * FROM nothing", "orgid1"), ("SELECT 1", "unknown")):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(*bad)
        assert e.value.code == 400
    server.shutdown()


def test_key_value_source(spark, tmp_path):
    from tidemark.sources import kv

    kv.register(spark)
    spark.createDataFrame([(f"k{i % 5}", i, f"v{i}") for i in range(100)], "pk string, sort long, v string").repartition(3).write.parquet(f"{tmp_path}/t")
    rows = spark.read.format("kv").option("path", f"{tmp_path}/t").option("hash", "pk").option("sort", "sort").load()
    assert rows.count() == 100 and rows.rdd.getNumPartitions() == 1
    assert rows.where("v = 'v7'").count() == 1 and rows.where("v in ('v7', 'v8')").count() == 2 and rows.where("v <> 'v7'").count() == 99
    assert rows.where("v is null").count() == 0 and rows.where("v is not null and sort < 3").count() == 3
    read = kv.Reader(rows.schema, {"path": f"{tmp_path}/t", "hash": "pk", "sort": "sort"})
    list(read.pushFilters([kv.EqualTo(("v",), "v7")]))
    assert [sum(b.num_rows for b in read.read(s)) for s in read.partitions()] == [1]
    wide = spark.read.format("kv").option("path", f"{tmp_path}/t").option("hash", "pk").option("segments", 3).load()
    assert wide.rdd.getNumPartitions() == 3 and wide.count() == 100
    one = rows.where("pk = 'k1' and sort = 6")
    assert [r.v for r in one.collect()] == ["v6"] and one.rdd.getNumPartitions() == 1
    assert rows.where("pk = 'k1' and sort >= 50 and v like '%1'").count() == 5
    assert (kv.segments(5), kv.segments(5000), kv.segments(10**9)) == (1, 5, 10)


def test_stream(spark, tmp_path):
    from tidemark.streaming import recent

    schema = "pk string, ts long, ids array<string>, field1 map<string,string>"
    frame = spark.createDataFrame([("orgid1m1", 1000 * k, ["a", "b"], {"a": str(k), "b": "1"}) for k in range(10)], schema)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    made = recent.tumbling(recent.read(spark, f"{tmp_path}/in", frame.schema, METRIC), "5 seconds", "1 second", F.sum("field1").alias("s"))
    query = made.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.s for r in spark.table("sums").collect()) == [15, 40]
