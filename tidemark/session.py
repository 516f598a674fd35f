"""A tenant's session: its tables as views, and nothing else.

A statement is run only if its parsed plan is a query whose tables, by the scopes of the
plan, are the tenant's; and then only if every leaf of the analysed plan lies in a view
that was made for it.  File paths, commands, other schemas, functions that call into the
JVM and ${variables} of the configuration are out of reach.

Conditions on a table are taken from the optimised plan of the statement over stand-ins
for its tables: those on the timestamp prune windows and days, those on the levels of
the error stream its folders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metadata
from .catalog import Catalog
from .functions.patterns import like_to_regex
from .operators.unified import columns_of, unified
from .plans.dialect import text, tokens, translate
from .plans.parsed import Reference, Rejected, only_reads, pushed, references, replaced
from .sources import errors
from .sources.archive import Archive
from .sources.nearline import Nearline

ISCHEMA = "information_schema"
READS = {"SELECT", "WITH", "VALUES", "TABLE", "FROM", "("}
MARK = "@"

@dataclass
class Engine:
    """Stores and catalog of all tenants."""

    spark: SparkSession
    catalog: Catalog
    nearline: Nearline | None = None
    archives: tuple[Archive | DataFrame, ...] = ()
    error_base: str | None = None
    radio: bool = False
    strict: bool = True
    error_frames: Callable[[str], DataFrame] | None = None

    def session(self, properties: dict[str, str] | str) -> Session:
        return Session(self, validate_tenant(properties) if isinstance(properties, dict) else properties)


def validate_tenant(properties: dict[str, str], expected: str | None = None) -> str:
    """The org of connection properties: COMPANY_KEY, and no user or password of the client's."""
    org = properties.get("COMPANY_KEY") or properties.get("company_key")
    if not org:
        raise Rejected("no tenant is given")
    if expected is not None and org != expected:
        raise Rejected("this server serves another tenant")
    return org


def decode_query(raw: str) -> str:
    """A query as clients send it: url-encoded, perhaps within quotes."""
    from urllib.parse import unquote_plus

    sql = unquote_plus(raw).strip()
    for mark in ('\\"', '"'):
        if sql.startswith(mark) and sql.endswith(mark) and len(sql) >= 2 * len(mark):
            sql = sql[len(mark) : -len(mark)]
    return sql


@dataclass
class Session:
    engine: Engine
    org: str
    spark: SparkSession = field(init=False)
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.org) > 1024 or self.org not in self.engine.catalog.orgs():
            raise Rejected(f"unknown tenant {self.org!r}")
        self.spark = self.engine.spark.newSession()
        self.spark.conf.set("spark.sql.variable.substitute", "false")

    def names(self) -> dict[tuple[str, ...], str]:
        """Each name a query may use, in lower case, and its view."""
        out: dict[tuple[str, ...], str] = {}
        org, root = self.org.lower(), self.engine.catalog.root.lower()
        for m in self.engine.catalog.tables(self.org):
            for n in (*m.aliases, m.name):
                for full in ((n.lower(),), (root, n.lower()), (root, org, n.lower())):
                    out[full] = m.name
        for n in (("errors", "stream"), (root, "errors", "stream")):
            out[n] = "errors.stream"
        for n in metadata.ALL:
            out[ISCHEMA, n.lower()] = f"{ISCHEMA}.{n.lower()}"
        return out

    def table(self, name: str, predicate: tuple | None = None) -> DataFrame:
        """A frame of this session by its view's name.  predicate prunes windows and days, or folders of the error stream."""
        if name.startswith(ISCHEMA + "."):
            return metadata.ALL[name.split(".")[1].upper()](self.spark, self.engine.catalog, self.org)
        if name == "errors.stream":
            if self.engine.error_frames is not None:
                return self.engine.error_frames(self.org)
            if self.engine.error_base is None:
                return self.spark.createDataFrame([], errors.whole_schema())
            return errors.read(self.spark, self.engine.error_base, self.org, predicate)
        metric = self.engine.catalog.find(self.org, name)
        return unified(self.spark, metric, nearline=self.engine.nearline, archives=self.engine.archives, predicate=predicate, radio=self.engine.radio, strict=self.engine.strict)

    def _stand_in(self, name: str, key: int) -> DataFrame | None:
        """An empty frame of a prunable table's columns, over columns that bear a mark and key; not so plain that the optimiser sees through it."""
        if name.startswith(ISCHEMA + ".") or name == "errors.stream" and self.engine.error_base is None:
            return None
        schema = errors.whole_schema() if name == "errors.stream" else columns_of(self.engine.catalog.find(self.org, name), radio=self.engine.radio)
        fields = T._parse_datatype_string(schema).fields
        marked = T.StructType([T.StructField(f"{f.name}{MARK}{key}", f.dataType) for f in fields])
        frame = self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), marked)
        return frame.toDF(*[f.name for f in fields])

    def _own(self, df: DataFrame) -> DataFrame:
        """df in this session, whichever session's frames it was made of."""
        plan = df._jdf.logicalPlan()
        return DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def check(self, sql: str) -> list[Reference]:
        """The tables of a query; Rejected for what is no query over this tenant's tables."""
        parts = tokens(sql)
        if not parts or parts[0].upper() not in READS:
            raise Rejected(f"not a query: {sql[:80]!r}")
        used, known = references(self.spark, sql), self.names()
        for r in used:
            if r.key not in known:
                raise Rejected(f"no table {'.'.join(r.parts)!r}")
        return used

    def predicates(self, sql: str, used: list[Reference], args: list | dict | None = None) -> list[tuple | None]:
        """For each reference: the condition right above it (None: none, or none that is of use)."""
        known, frames = self.names(), {}
        for i, r in enumerate(used):
            frame = self._stand_in(known[r.key], i)
            if frame is None:
                frame = self.table(known[r.key])
            frames[i] = f"_s{i}"
            self._own(frame).createOrReplaceTempView(frames[i])
        df = self.spark.sql(replaced(sql, [(r, frames[i]) for i, r in enumerate(used)]), args=args)
        only_reads(self.spark, df, {v.lower() for v in frames.values()})
        found = pushed(df, MARK)
        # A table of a WITH that is used twice has two leaves: what either may need is read.
        out: list[tuple | None] = []
        for i in range(len(used)):
            each = found.get(str(i), [None])
            out.append(None if None in each else each[0] if len(each) == 1 else ("or", *each))
        return out

    def sql(self, query: str, *, args: list | dict | None = None, max_rows: int | None = None, predicate: tuple | None = None) -> DataFrame:
        """A query, SHOW, DESCRIBE, USE, EXPLAIN or ALTER SESSION in the accepted dialect.

        Unified tables without an ORDER BY come in timestamp order where the result has that column.
        predicate: a condition that holds for all tables besides the statement's own.
        """
        parts = tokens(query)
        first = parts[0].upper() if parts else ""
        if first in ("SHOW", "DESCRIBE", "DESC", "USE", "ALTER"):
            return self._command(parts)
        sql = translate(query, user=self.org, root=self.engine.catalog.root, radio=self.engine.radio)
        explain = tokens(sql)[0].upper() == "EXPLAIN"
        if explain:
            sql = re.sub(r"(?i)^\s*explain\s+(formatted\s+)?", "", sql)
        used = self.check(sql)
        known = self.names()
        views = []
        for i, (r, own) in enumerate(zip(used, self.predicates(sql, used, args), strict=True)):
            both = own if predicate is None else predicate if own is None else ("and", own, predicate)
            self._own(self.table(known[r.key], both)).createOrReplaceTempView(f"_t{i}")
            views.append((r, f"_t{i}"))
        df = self.spark.sql(replaced(sql, views), args=args)
        only_reads(self.spark, df, {v for _, v in views})
        if explain:
            return self.spark.createDataFrame([(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")
        upper = [p.upper() for p in parts]
        if "ORDER" not in upper and "LIMIT" not in upper and "FETCH" not in upper and "timestamp" in df.columns:
            df = df.orderBy("timestamp")
        most = max_rows or int(self.options.get("max_rows") or 0)
        return df.limit(most) if most else df

    def run(self, query: str, **options: Any) -> list[dict]:
        """Rows as dictionaries, as a client gets them."""
        return list(self.rows(query, **options))

    def rows(self, query: str, **options: Any) -> Iterator[dict]:
        """Like run(), one partition's rows after the other."""
        for r in self.sql(decode_query(query), **options).toLocalIterator():
            yield r.asDict(recursive=True)

    def _command(self, parts: list[str]) -> DataFrame:
        upper = [p.upper() for p in parts]
        unquoted = [p.strip("`'\"") for p in parts]
        if upper[0] == "USE":
            return self.spark.createDataFrame([(True, f"{self.engine.catalog.root}.{self.org}")], "ok boolean, summary string")
        if upper[0] == "ALTER":
            return self._alter(parts, upper)
        if upper[0] == "SHOW" and upper[1] in ("SCHEMAS", "DATABASES", "TABLES"):
            name = "TABLES" if upper[1] == "TABLES" else "SCHEMATA"
            column = "TABLE_NAME" if name == "TABLES" else "SCHEMA_NAME"
            rows = metadata.ALL[name](self.spark, self.engine.catalog, self.org)
            if name == "TABLES" and len(parts) > 3 and upper[2] in ("FROM", "IN"):
                schema = unquoted[-1] if not {"LIKE", "WHERE"} & set(upper) else unquoted[min(i for i, x in enumerate(upper) if x in ("LIKE", "WHERE")) - 1]
                rows = rows.where(F.upper("TABLE_SCHEMA") == schema.upper())
            if "LIKE" in upper and "WHERE" not in upper:
                rows = rows.where(F.col(column).rlike(like_to_regex(unquoted[upper.index("LIKE") + 1])))
            if "WHERE" in upper:
                condition = translate(text(parts[upper.index("WHERE") + 1 :]))
                if self.check(f"SELECT 1 FROM {ISCHEMA}.tables WHERE {condition}")[1:]:
                    raise Rejected("SHOW takes no subquery")
                rows = rows.where(condition)
            return rows.select(*(["TABLE_SCHEMA", "TABLE_NAME"] if name == "TABLES" else ["SCHEMA_NAME"]))
        if upper[0] in ("DESCRIBE", "DESC"):
            end = next((i for i in range(2, len(parts)) if parts[i] != "." and parts[i - 1] != "."), len(parts))
            key = tuple(p.lower() for p in unquoted[1:end] if p != ".")
            if key not in self.names():
                raise Rejected(f"no table {'.'.join(key)!r}")
            df = self.table(self.names()[key])
            rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
            if end < len(parts):
                wanted = re.compile(like_to_regex(unquoted[end]), re.I)
                rows = [r for r in rows if wanted.match(r[0])]
            return self.spark.createDataFrame(rows, "COLUMN_NAME string, DATA_TYPE string, IS_NULLABLE boolean")
        raise Rejected(f"{text(parts)[:80]!r} is not supported")

    def _alter(self, parts: list[str], upper: list[str]) -> DataFrame:
        """ALTER SESSION SET name = value, ALTER SESSION RESET name | ALL.  Options are this session's own and never Spark's."""
        if upper[1:2] != ["SESSION"] or len(parts) < 4 or upper[2] not in ("SET", "RESET"):
            raise Rejected(f"{text(parts)[:80]!r} is not supported")
        if upper[2] == "RESET":
            name = "".join(parts[3:]).strip("`\"")
            self.options = {} if name.upper() == "ALL" else {k: v for k, v in self.options.items() if k != name}
            return self.spark.createDataFrame([(True, f"{name} reset")], "ok boolean, summary string")
        at = parts.index("=") if "=" in parts else 0
        name, value = "".join(parts[3:at]).strip("`\""), "".join(parts[at + 1 :]).strip("'")
        if not at or not name or not value:
            raise Rejected(f"{text(parts)[:80]!r} is not supported")
        if name == "max_rows" and not value.isdigit():
            raise ValueError(f"max_rows must be a number, not {value!r}")
        self.options[name] = value
        return self.spark.createDataFrame([(True, f"{name} updated")], "ok boolean, summary string")
