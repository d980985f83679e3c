"""A report as an XLSX workbook, written with the standard library: header, frozen first row, best rows highlighted."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

MOST_ROWS = 1_048_575
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Fills of the header and of best rows.
HEADER_FILL, BEST_FILL = "D9EAF7", "FFF2CC"


def _name(column: int) -> str:
    name = ""
    while column >= 0:
        name, column = chr(65 + column % 26) + name, column // 26 - 1
    return name


def _cell(value: object, row: int, column: int, style: int) -> str:
    at = f'r="{_name(column)}{row}" s="{style}"'
    if value is None:
        return f"<c {at}/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f"<c {at}><v>{value!r}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(columns: list[str], rows: list[tuple], best: set[int], title: str = "report") -> bytes:
    """Bytes of a workbook of one sheet; `best` holds the places of highlighted rows, counted from 0."""
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a sheet holds at most {MOST_ROWS} rows below its header")
    widths = [min(max([len(name) + 2, 10, *(len(str(r[k])) + 2 for r in rows if r[k] is not None)]), 48) for k, name in enumerate(columns)]
    lines = [f'<row r="{n}">' + "".join(_cell(v, n, k, style) for k, v in enumerate(row)) + "</row>" for n, (row, style) in enumerate([(columns, 1), *((r, 2 if k in best else 0) for k, r in enumerate(rows))], 1)]
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{x}"/></patternFill></fill>' for x in (HEADER_FILL, BEST_FILL))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        + "</Types>",
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{k}" Target="{t}.xml"/>' for n, k, t in ((1, "worksheet", "worksheets/sheet1"), (2, "styles", "styles")))
        + "</Relationships>",
        "xl/workbook.xml": f'<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(title[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet {_NS}><fonts count="2"><font/><font><b/></font></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {_NS}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{"".join(f"""<col min="{k}" max="{k}" width="{x}" customWidth="1"/>""" for k, x in enumerate(widths, 1))}</cols><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, _HEAD + text)
    return out.getvalue()


def write_xlsx(report: DataFrame, path: str, group: str, title: str = "report") -> None:
    """A sorted report as one workbook on any store Spark writes to; the first row of each group is highlighted.

    A workbook is one file for people to read: the driver holds its rows, at most what a sheet can hold.
    """
    rows = [tuple(r) for r in report.limit(MOST_ROWS + 1).collect()]
    seen, best, at = set(), set(), report.columns.index(group)
    for k, row in enumerate(rows):
        if row[at] not in seen:
            seen.add(row[at])
            best.add(k)
    data = workbook(report.columns, rows, best, title)
    spark = report.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
