"""Workbooks (.xlsx) and text documents (.docx): zipped XML, so a file is read by one task, and files are dealt over tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces and part names of the file formats.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _column(reference: str) -> int:
    """The number of a cell's column, from 0: letters are digits to base 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _plain(node: ElementTree.Element) -> str:
    """The text of a string, without the phonetic runs beside it."""
    return "".join(t.text or "" for part in [node, *node.findall(f"{_SHEET}r")] for t in part.findall(f"{_SHEET}t"))


def sheet_rows(raw: bytes, name: str) -> Iterator[dict[int, str]]:
    """The rows of a sheet, each with its cells by column; a workbook without the sheet has none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheets = {s.get("name"): s.get(_LINK) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if name not in sheets:
            return
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = parts[sheets[name]]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_plain(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        with z.open(target[1:] if target.startswith("/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_SHEET}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.findall(f"{_SHEET}c"):
                    at = _column(c.get("r", "")) if c.get("r") else max(cells, default=-1) + 1
                    value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                    if inline is not None:
                        cells[at] = _plain(inline)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield cells
                row.clear()


def _number(x: str | None) -> bool:
    try:
        return x is not None and float(x) == float(x)
    except ValueError:
        return False


def sheet(spark: SparkSession, path: str, name: str, columns: list[str], key: str | None = None, labelled: bool | None = None) -> DataFrame:
    """``file, place`` and the given columns, as text, of a sheet of every workbook at ``path``; the first row has the names.

    With a ``key``, a second row whose key is not a number holds labels and is left out, as are rows without any value.
    Where ``labelled`` declares such a row, or that there is none, a sheet that says otherwise is an error.  A column that a
    workbook lacks is null there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"]):
                rows = sheet_rows(raw, name)
                named = {v: k for k, v in next(rows, {}).items()}
                out = []
                for place, cells in enumerate(rows):
                    if key and place == 0:
                        labels = not _number(cells.get(named.get(key)))
                        if labelled is not None and labels != labelled:
                            raise ValueError(f"{file}: sheet {name} is {'' if labels else 'not '}labelled, unlike declared")
                        if labels:
                            continue
                    if not cells:
                        continue
                    out.append((file, place, *(cells.get(named.get(c)) for c in columns)))
                if out:
                    yield pd.DataFrame(out, columns=["file", "place", *columns])

    schema = ", ".join(["file string", "place int", *(f"`{c}` string" for c in columns)])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, text``: the body's paragraphs of every document at ``path``, blank ones left out and not counted.

    Paragraphs inside tables are not the body's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
                out = []
                for p in [] if body is None else body.findall(f"{_WORD}p"):
                    runs = [r for x in p for r in (x.findall(f"{_WORD}r") if x.tag == f"{_WORD}hyperlink" else [x] if x.tag == f"{_WORD}r" else [])]
                    text = "".join(signs.get(x.tag, (x.text or "") if x.tag == f"{_WORD}t" else "") for r in runs for x in r)
                    if text.strip():
                        out.append((file, len(out), text))
                if out:
                    yield pd.DataFrame(out, columns=["file", "place", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, place int, text string")


def _written(spark: SparkSession, path: str, parts: dict[str, str]) -> str:
    """A zipped document of the given parts, written to any file system that the session knows."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(raw.getvalue()))
    finally:
        out.close()
    return path


def _package(kind: str, main: str, more: dict[str, str]) -> dict[str, str]:
    types = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in {main: f"{kind}.main", **more}.items())
    return {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="r0" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


#: Rows of a sheet, at most: the format's bound.
SHEET_ROWS = 1 << 20


def workbook(sheets: dict[str, DataFrame], path: str) -> str:
    """One workbook with a sheet a table, for people to read; a table of more rows than a sheet holds is an error."""
    tables = {}
    for name, rows in sheets.items():
        got = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).limit(SHEET_ROWS).collect()
        if len(got) == SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet")
        lines = [rows.columns, *got]
        tables[name] = "".join("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r) + "</row>" for r in lines)
    paths = {name: f"worksheets/sheet{i + 1}.xml" for i, name in enumerate(tables)}
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(paths))
    links = "".join(f'<Relationship Id="r{i + 1}" Type="{_OFFICE}/worksheet" Target="{p}"/>' for i, p in enumerate(paths.values()))
    main = {"xl/workbook.xml": f'<workbook xmlns="{_SHEET[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}">{links}</Relationships>'}
    data = {f"xl/{paths[n]}": f'<worksheet xmlns="{_SHEET[1:-1]}"><sheetData>{x}</sheetData></worksheet>' for n, x in tables.items()}
    package = _package("spreadsheetml.sheet", "xl/workbook.xml", {p: "spreadsheetml.worksheet" for p in data})
    return _written(next(iter(sheets.values())).sparkSession, path, {**package, **main, **data})


def document(spark: SparkSession, texts: list[str], path: str) -> str:
    """One text document of the given paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
    main = {"word/document.xml": f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>'}
    return _written(spark, path, {**_package("wordprocessingml.document", "word/document.xml", {}), **main})
