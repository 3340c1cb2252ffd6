import os
import sys
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tallygrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def table(spark):
    """Grid from a dict of columns of strings, in row order."""
    import tallygrid as tg

    def make(columns: dict, partitions: int = 3):
        names = list(columns)
        rows = [(i, *values) for i, values in enumerate(zip(*columns.values()))]
        schema = ", ".join(["rid bigint", *(f"`x{i}` string" for i in range(len(names)))])
        df = spark.createDataFrame(rows, schema).repartition(partitions)
        picked = [f"x{i}" for i in range(len(names))]
        return tg.grid(df, ["rid"], distinct_order=True, columns=picked, names=names)

    return make


def write_workbook(path, sheets: dict, date1904: bool = False):
    """A minimal xlsx. Cells: str, bool, int/float, ('date', serial), None."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []

    def cell(ref, value):
        if value is None:
            return ""
        if isinstance(value, tuple):
            return f'<c r="{ref}" s="1"><v>{value[1]}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            shared.append(value)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}"><v>{value!r}</v></c>'

    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>',
        )
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        items = "".join(f"<si><t>{escape(t)}</t></si>" for t in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")
