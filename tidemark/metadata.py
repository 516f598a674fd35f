"""INFORMATION_SCHEMA of a user: anonymous, a tenant, or the hidden super-user (None is anonymous)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.patterns import like_to_regex
from .sources.errors import LEVELS

SUPER = "**super**"
TYPES = {"STRING": "VARCHAR", "BOOLEAN": "BOOLEAN", "BYTES": "BINARY VARYING", "INT": "INTEGER", "LONG": "BIGINT", "FLOAT": "FLOAT", "DOUBLE": "DOUBLE"}
ISCHEMA = ("CATALOGS", "COLUMNS", "SCHEMATA", "TABLES", "VIEWS")


def _orgs(catalog: Catalog, user: str | None) -> list[str]:
    return catalog.orgs() if user == SUPER else [user] if user in catalog.orgs() else []


def catalogs(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    return spark.createDataFrame([(catalog.root.upper(), "Internal", "")], "CATALOG_NAME string, CATALOG_DESCRIPTION string, CATALOG_CONNECT string")


def schemata(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    root = catalog.root.upper()
    names = [] if user is None else ["INFORMATION_SCHEMA", "ERRORS", root] if user != SUPER else ["INFORMATION_SCHEMA", "ERRORS", root, *(f"{root}.{o}" for o in catalog.orgs())]
    return spark.createDataFrame([(root, n, "<owner>", "NO") for n in names], "CATALOG_NAME string, SCHEMA_NAME string, SCHEMA_OWNER string, IS_MUTABLE string")


def _schema(catalog: Catalog, user: str | None, org: str) -> str:
    root = catalog.root.upper()
    return root if user != SUPER else f"{root}.{org}"


def tables(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    rows, root = [], catalog.root.upper()
    if user is not None:
        rows = [(root, "INFORMATION_SCHEMA", t, "TABLE") for t in ISCHEMA] + [(root, "ERRORS", "stream", "TABLE")]
        rows += [(root, _schema(catalog, user, o), m.name, "TABLE") for o in _orgs(catalog, user) for m in catalog.tables(o)]
    return spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string")


def views(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    return spark.createDataFrame([], "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, VIEW_DEFINITION string")


def columns(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    rows, root = [], catalog.root.upper()
    if user is not None:
        rows = [(root, "ERRORS", "stream", c, i + 1, "VARCHAR") for i, c in enumerate(("apikey", "event", "message", *LEVELS))]
        for o in _orgs(catalog, user):
            for m in catalog.tables(o):
                own = [("timestamp", "BIGINT"), *((f.name, TYPES[f.type.upper()]) for f in m.fields)]
                rows += [(root, _schema(catalog, user, o), m.name, n, i + 1, t) for i, (n, t) in enumerate(own)]
    return spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string")


def table_types(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    return spark.createDataFrame([("TABLE",), ("VIEW",)], "TABLE_TYPE string")


def type_info(spark: SparkSession, catalog: Catalog, user: str | None) -> DataFrame:
    """Declared types as a client sees them: SQL name, java.sql.Types code, whether it is quoted."""
    codes = {"VARCHAR": 12, "BOOLEAN": 16, "BINARY VARYING": -3, "INTEGER": 4, "BIGINT": -5, "FLOAT": 6, "DOUBLE": 8}
    return spark.createDataFrame([(n, codes[n], n == "VARCHAR") for n in TYPES.values()], "TYPE_NAME string, DATA_TYPE int, QUOTED boolean")


def matching(rows: DataFrame, **patterns: str | None) -> DataFrame:
    """rows of whose columns (by name, in upper case) each matches a LIKE pattern, as a client's getTables() and its like ask; None matches all."""
    for name, pattern in patterns.items():
        if pattern is not None:
            rows = rows.where(F.col(name.upper()).rlike(like_to_regex(pattern, "\\")))
    return rows


ALL = {"CATALOGS": catalogs, "SCHEMATA": schemata, "TABLES": tables, "VIEWS": views, "COLUMNS": columns}
