"""Where results go: tables, CSV, spreadsheets."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A catalogue table in any format that the cluster has (``delta`` where its jar is there)."""
    df.write.format(fmt).mode(mode).saveAsTable(name)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def bounded_pandas(df: DataFrame, rows: int = 200_000) -> pd.DataFrame:
    """At most ``rows`` rows on the driver, for plots and sheets."""
    return df.limit(rows).toPandas()


def output_dir(root: str | Path, scenario: str = "") -> Path:
    path = Path(root) / scenario
    path.mkdir(parents=True, exist_ok=True)
    return path


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        i, rest = divmod(i, 26)
        name, i = chr(65 + rest) + name, i - 1
    return name


def _cell(row: int, col: int, value) -> str:
    ref = f"{_column(col)}{row}"
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}"><v>{value!r}</v></c>'


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def sheet_rows(tables: Iterable[tuple[str, pd.DataFrame]]) -> list[list]:
    """Titled tables one under the other: title, empty row, header, rows, two empty rows."""
    rows: list[list] = []
    for title, table in tables:
        rows += [[title], [], list(table.columns), *[[_plain(v) for v in r] for r in table.itertuples(index=False)], [], []]
    return rows


def write_xlsx(path: str | Path, sheets: Sequence[tuple[str, list[list]]]) -> Path:
    """A spreadsheet of ``(name, rows)`` sheets; names are cut to 31 characters and made unique."""
    used: dict[str, int] = {}
    names = []
    for name, _ in sheets:
        short = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "Sheet"
        n = used[short] = used.get(short, 0) + 1
        names.append(short if n == 1 else f"{short[:28]}~{n}")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        for i, (_, rows) in zip(numbers, sheets, strict=True):
            body = "".join(f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return Path(path)
