"""Catalog descriptors: the declared schema of a database, as text or XML.

The text form is a list of words: the database's name, the number of tables,
and for each table its quoted name, id, number of rows and number of columns,
followed by the quoted name, id, size and type of each column.
"""

from __future__ import annotations

import shlex
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Declared type names and the families that they belong to.
DECLARED = {
    "INT": "INT",
    "NUMBER": "INT",
    "BIG_INT": "BIG_INT",
    "LONG": "BIG_INT",
    "FLOAT": "DOUBLE",
    "REAL": "DOUBLE",
    "DOUBLE": "DOUBLE",
    "CHAR": "VARCHAR",
    "VARCHAR": "VARCHAR",
    "VARCHAR2": "VARCHAR",
    "RAW": "VARCHAR",
    "DATE": "DATE",
    "DATE1": "DATE",
    "DATE2": "DATE",
    "DATE3": "DATE",
}
SPARK = {
    "INT": T.IntegerType(),
    "BIG_INT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "DATE": T.TimestampNTZType(),
}
NUMERIC = {"INT", "BIG_INT", "DOUBLE"}


class CatalogError(ValueError):
    """A descriptor that can't be read, or a name that isn't in it."""


def internal_type(declared: str) -> str:
    try:
        return DECLARED[declared.upper()]
    except KeyError:
        raise CatalogError(f"unknown column type: {declared}") from None


def compatible(a: str, b: str) -> bool:
    """Numeric types go together; text and dates only with themselves."""
    a, b = internal_type(a), internal_type(b)
    return a == b or {a, b} <= NUMERIC


@dataclass
class ColumnDef:
    name: str
    id: int
    size: int
    type: str

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK[internal_type(self.type)])


@dataclass
class TableDef:
    name: str
    id: int
    rows: int
    columns: list[ColumnDef] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])


@dataclass
class Database:
    name: str
    tables: list[TableDef] = field(default_factory=list)

    def table(self, name: str) -> TableDef:
        for t in self.tables:
            if t.name.upper() == name.upper():
                return t
        raise CatalogError(f"cannot find table {name}")


def parse_text(text: str) -> Database:
    words = iter(shlex.split(text, posix=True))
    try:
        db = Database(next(words))
        for _ in range(int(next(words))):
            name, id_, rows, count = next(words), *(int(next(words)) for _ in range(3))
            table = TableDef(name, id_, rows)
            for _ in range(count):
                table.columns.append(ColumnDef(next(words), int(next(words)), int(next(words)), next(words)))
                internal_type(table.columns[-1].type)
            db.tables.append(table)
    except StopIteration:
        raise CatalogError("the descriptor ends early") from None
    return db


def to_text(db: Database) -> str:
    out = [db.name, str(len(db.tables)), ""]
    for t in db.tables:
        out.append(f'"{t.name}" {t.id} {t.rows} {len(t.columns)}')
        out += [f'"{c.name}" {c.id} {c.size} {c.type}' for c in t.columns]
        out.append("")
    return "\n".join(out)


def parse_xml(text: str) -> Database:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise CatalogError(f"the descriptor isn't XML: {e}") from None
    db = Database(root.attrib["Name"])
    for t in root.iterfind("./Tables/Table"):
        table = TableDef(t.attrib["Name"], int(t.attrib["ID"]), int(t.attrib["NbRows"]))
        for c in t.iterfind("./Columns/Column"):
            a = c.attrib
            table.columns.append(ColumnDef(a["Name"], int(a["ID"]), int(a["Size"]), a["Type"]))
            internal_type(a["Type"])
        db.tables.append(table)
    return db


def to_xml(db: Database) -> str:
    out = [f"<Database Name={quoteattr(db.name)}>", "<Tables>"]
    for t in db.tables:
        out += [f'<Table Name={quoteattr(t.name)} ID="{t.id}" NbRows="{t.rows}">', "<Columns>"]
        out += [
            f'<Column Name={quoteattr(c.name)} ID="{c.id}" Size="{c.size}" Type="{c.type}"/>' for c in t.columns
        ]
        out += ["</Columns>", "</Table>"]
    return "\n".join([*out, "</Tables>", "</Database>", ""])


_NAMES = {
    T.IntegerType: "INT",
    T.ShortType: "INT",
    T.ByteType: "INT",
    T.LongType: "BIG_INT",
    T.FloatType: "DOUBLE",
    T.DoubleType: "DOUBLE",
    T.DecimalType: "DOUBLE",
    T.StringType: "VARCHAR2",
    T.TimestampNTZType: "DATE",
    T.TimestampType: "DATE",
    T.DateType: "DATE",
}


def describe(df: DataFrame, name: str, id_: int = 1, rows: int = 0, size: int = 255) -> TableDef:
    """The definition of a table that holds ``df``."""
    columns = []
    for k, f in enumerate(df.schema.fields, 1):
        if type(f.dataType) not in _NAMES:
            raise CatalogError(f"column {f.name} has a type without a name here: {f.dataType}")
        declared = _NAMES[type(f.dataType)]
        columns.append(ColumnDef(f.name, k, size if declared == "VARCHAR2" else 1, declared))
    return TableDef(name, id_, rows, columns)


def register_folder(spark: SparkSession, folder: str, names: list[str]) -> None:
    """A temporary view for each Parquet table of a folder."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
