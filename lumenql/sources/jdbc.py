"""Import from databases by JDBC, with their types mapped to catalog types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import SPARK, internal_type

# Vendor types and the catalog types that they become.
TYPES = {
    "sqlserver": {
        "CHAR": "VARCHAR",
        "VARCHAR": "VARCHAR2",
        "VARCHAR2": "VARCHAR2",
        "TEXT": "VARCHAR2",
        "DECIMAL": "DOUBLE",
        "FLOAT": "DOUBLE",
        "BIGINT": "BIG_INT",
        "INT": "INT",
        "TINYINT": "INT",
        "NUMERIC": "NUMBER",
        "SMALLINT": "INT",
        "DATETIME": "DATE1",
    },
    "mysql": {"INT": "INT", "LONGTEXT": "VARCHAR2", "FLOAT": "DOUBLE", "VARCHAR": "VARCHAR2"},
    "oracle": {
        "NUMERIC": "DOUBLE",
        "CHAR": "VARCHAR",
        "VARCHAR": "VARCHAR2",
        "VARCHAR2": "VARCHAR2",
        "TEXT": "VARCHAR2",
        "DECIMAL": "DOUBLE",
        "FLOAT": "DOUBLE",
        "BIGINT": "BIG_INT",
        "INT": "INT",
        "TINYINT": "INT",
        "SMALLINT": "INT",
        "DATE": "DATE1",
        "NUMBER": "DOUBLE",
        "TIMESTAMP": "DATE1",
        "TIMESTAMP(6)": "DATE1",
    },
}
URLS = {
    "sqlserver": "jdbc:sqlserver://{host};databaseName={database}",
    "mysql": "jdbc:mysql://{host}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}/{database}",
}


def catalog_type(vendor: str, declared: str) -> str:
    """The catalog type of a vendor's type; text where there is no mapping. A
    number with a fraction is a DOUBLE whatever the table of types says."""
    kinds, name = TYPES[vendor.lower()], declared.upper().replace(" ", "")
    plain, _, size = name.partition("(")
    kind = kinds.get(name) or kinds.get(plain, "VARCHAR2")
    exact = plain in ("NUMERIC", "NUMBER", "DECIMAL")
    whole = size.endswith(",0)") or size and "," not in size
    return "DOUBLE" if exact and kind == "NUMBER" and not whole else kind


def url(vendor: str, host: str, database: str) -> str:
    return URLS[vendor.lower()].format(host=host, database=database)


def custom_schema(vendor: str, columns: dict[str, str]) -> str:
    """The reader's ``customSchema`` for columns of vendor types."""
    kinds = {c: SPARK[internal_type(catalog_type(vendor, t))] for c, t in columns.items()}
    names = {"timestamp_ntz": "timestamp"}
    return ", ".join(f"{c} {names.get(k.simpleString(), k.simpleString())}" for c, k in kinds.items())


def read_table(
    spark: SparkSession,
    vendor: str,
    host: str,
    database: str,
    table: str,
    columns: dict[str, str] | None = None,
    split: tuple[str, int, int] | None = None,
    parts: int = 8,
    **properties: str,
) -> DataFrame:
    """A table of a database. With ``split`` (numeric column, lowest, highest)
    it is read by ``parts`` tasks over ranges of that column."""
    options = {"url": url(vendor, host, database), "dbtable": table, **properties}
    if columns:
        options["customSchema"] = custom_schema(vendor, columns)
    if split:
        column, low, high = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(parts),
        }
    return spark.read.format("jdbc").options(**options).load()
