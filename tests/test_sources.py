import datetime

import pytest

from lumenql.sources import catalog, delimited, jdbc

TEXT = """TEST
2

"table_1" 1 10000 7
"id"      1 1 INT
"champ_1" 2 11 VARCHAR2
"val_1"   3 1 INT
"val_2"   4 1 FLOAT
"val_3"   5 1 DOUBLE
"val_4"   6 1 BIG_INT
"date_1"  7 1 DATE

"table_2" 2 100000 1
"id"      1 1 INT
"""


def test_catalog_round_trips():
    db = catalog.parse_text(TEXT)
    assert [t.rows for t in db.tables] == [10000, 100000]
    assert catalog.parse_xml(catalog.to_xml(db)) == db
    assert catalog.parse_text(catalog.to_text(db)) == db
    assert db.table("TABLE_1").schema.simpleString() == (
        "struct<id:int,champ_1:string,val_1:int,val_2:double,val_3:double,val_4:bigint,date_1:timestamp_ntz>"
    )


def test_catalog_errors():
    with pytest.raises(catalog.CatalogError, match="unknown column type"):
        catalog.parse_text('x 1 "t" 1 1 1 "c" 1 1 BLOB')
    with pytest.raises(catalog.CatalogError, match="ends early"):
        catalog.parse_text('x 1 "t" 1 1 2 "c" 1 1 INT')
    with pytest.raises(catalog.CatalogError, match="cannot find"):
        catalog.parse_text("x 0").table("t")
    assert catalog.compatible("INT", "FLOAT") and not catalog.compatible("DATE", "CHAR")


def test_delimited_load_and_sinks(spark, tmp_path):
    table = catalog.parse_text(TEXT).table("table_1")
    (tmp_path / "table_1.txt").write_text(
        "1;alpha  ;2;1,5;2.25;9007199254740993;2024-01-02 03:04:05\n;a long text here;NULL;;;;\n"
    )
    df = delimited.load_delimited(spark, str(tmp_path / "table_1.txt"), table)
    first, second = df.collect()
    assert tuple(first) == (1, "alpha", 2, 1.5, 2.25, 9007199254740993, datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert tuple(second) == (None, "a long text", None, None, None, None, None)
    lines = [r.line for r in delimited.answer_lines(df).collect()]
    assert lines[0] == "; 1; alpha; 2; 1.50; 2.25; 9007199254740993; 2024-01-02 03:04:05"
    assert lines[1].startswith("; NULL; a long text; NULL")
    delimited.write_answer(df, str(tmp_path / "answer"))
    assert spark.read.text(str(tmp_path / "answer/0-header")).first()[0].startswith("; id; champ_1")
    delimited.import_tables(spark, str(tmp_path), [table], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/table_1.parquet")).count() == 2
    assert "| alpha" in delimited.grid(df)


def test_quoted_text(spark, tmp_path):
    table = catalog.TableDef("q", 1, 0, [catalog.ColumnDef("a", 1, 20, "VARCHAR"), catalog.ColumnDef("b", 2, 1, "INT")])
    (tmp_path / "q.txt").write_text('"x, ""y""",3\n')
    df = delimited.load_delimited(spark, str(tmp_path / "q.txt"), table, sep=",", quote='"')
    assert df.first().b == 3


def test_vendor_types():
    assert jdbc.catalog_type("SqlServer", "decimal") == "DOUBLE"
    assert jdbc.catalog_type("Oracle", "TIMESTAMP(6)") == "DATE1"
    assert jdbc.custom_schema("oracle", {"a": "NUMBER", "b": "DATE", "c": "BIGINT"}) == "a double, b timestamp, c bigint"
    assert jdbc.url("mysql", "h:3306", "d") == "jdbc:mysql://h:3306/d"
