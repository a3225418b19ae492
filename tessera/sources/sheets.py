"""Workbook cells: reading and writing xlsx files, rows, merged ranges, rendered text.

An xlsx file is a zip of XML, which the standard library reads.  Spark lists and reads the files (binaryFile); each is one row.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
TEXT = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
CELLS = "workbook string, sheet string, row int, col int, text string"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells with a value, row by row; shared and inline strings, numbers as written."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(LINK)].lstrip("/")
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}c"):
                letters, row = re.match(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                value = c.find(f"{MAIN}v")
                text = _texts(c) if c.get("t") == "inlineStr" else value.text if value is not None else None
                if text is not None:
                    yield sheet.get("name"), int(row), column_number(letters), shared[int(text)] if c.get("t") == "s" else text


def textboxes_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(shape, row, column, paragraphs) of the shapes with text; the anchor's cell counts from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.startswith("xl/drawings/drawing")):
            for anchor in ElementTree.fromstring(z.read(name)):
                start = anchor.find(f"{DRAWING}from")
                for shape in anchor.iter(f"{DRAWING}sp"):
                    lines = ["".join(t.text or "" for t in p.iter(f"{TEXT}t")) for p in shape.iter(f"{TEXT}p")]
                    lines = [x for x in lines if x.strip()]
                    if lines and start is not None:
                        yield shape.find(f".//{DRAWING}cNvPr").get("name"), int(start.find(f"{DRAWING}row").text) + 1, int(start.find(f"{DRAWING}col").text) + 1, "\n".join(lines)


def _read(spark: SparkSession, path: str, parse, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for p, content in zip(files["path"], files["content"]):
                book = p.rsplit("/", 1)[-1].removesuffix(".xlsx")
                yield pd.DataFrame([(book, *x) for x in parse(bytes(content))], columns=columns)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, schema)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(workbook, sheet, row, col, text) of the xlsx files in a folder."""
    return _read(spark, path, cells_of, ["workbook", "sheet", "row", "col", "text"], CELLS)


def read_textboxes(spark: SparkSession, path: str) -> DataFrame:
    """(workbook, shape, row, col, paragraphs) of the shapes of the xlsx files in a folder."""
    return _read(spark, path, textboxes_of, ["workbook", "shape", "row", "col", "paragraphs"], "workbook string, shape string, row int, col int, paragraphs string")


def workbook(cells: list[tuple[str, int, int, str]], shapes: list[tuple[str, int, int, list[str]]] = ()) -> bytes:
    """The bytes of an xlsx file with the given cells, and shapes on its first sheet.  Row 0 becomes row 1 of nothing: rows start at their numbers."""
    out = io.BytesIO()
    names = list(dict.fromkeys(c[0] for c in cells))
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {rel}>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for _, r, c, text in (x for x in cells if x[0] == name):
                rows.setdefault(r, []).append((c, text))
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(t or "")}</t></is></c>' for c, t in sorted(x)) + "</row>" for r, x in sorted(rows.items()))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
        if shapes:
            parts = "".join(
                f'<d:twoCellAnchor><d:from><d:col>{c - 1}</d:col><d:row>{r - 1}</d:row></d:from><d:sp><d:nvSpPr><d:cNvPr id="{i}" name="{escape(n)}"/></d:nvSpPr><d:txBody>'
                + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in lines)
                + "</d:txBody></d:sp></d:twoCellAnchor>"
                for i, (n, r, c, lines) in enumerate(shapes, 1)
            )
            z.writestr("xl/drawings/drawing1.xml", f'<d:wsDr xmlns:d="{DRAWING[1:-1]}" xmlns:a="{TEXT[1:-1]}">{parts}</d:wsDr>')
    return out.getvalue()


#: Rows of a file; more go to further files of the workbook.
ROWS = 100_000


def write_workbooks(cells: DataFrame, name: str, shapes: DataFrame | None = None) -> str:
    """Writes (sheet, row, col, text) as xlsx files into a new folder of the shared one and returns it: one for each value of ``name`` and each ROWS rows.

    shapes: (``name``, shape, row, col, lines), put on the first sheet of their workbook's file of these rows.  Tasks build the files and write them
    by Arrow's file systems, so that no content passes the driver.  A file lies in the folder of its range of rows under the workbook's name, so all files of
    a workbook are read under that name.
    """
    spark = cells.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/books-{uuid.uuid4().hex}"
    target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    part = F.floor(F.col("row") / ROWS).cast("int").alias("part")
    by = cells.select(F.col(name).cast("string").alias("name"), part, "sheet", "row", "col", "text")
    if shapes is None:
        shapes = spark.createDataFrame([], f"{name} string, shape string, row int, col int, lines array<string>")
    drawn = shapes.select(F.col(name).cast("string").alias("name"), part, "shape", "row", "col", "lines")

    def build(key: tuple, rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sheet", "row", "col"])
        content = workbook(list(rows[["sheet", "row", "col", "text"]].itertuples(index=False, name=None)), list(boxes[["shape", "row", "col", "lines"]].itertuples(index=False, name=None)))
        fs, base = pafs.FileSystem.from_uri(target)
        base = f"{base}/rows={key[1]}"
        fs.create_dir(base, recursive=True)
        path = f"{base}/{key[0]}.xlsx"
        draft = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(content)
        fs.move(draft, path)  # whole files only, also where a task runs twice
        return pd.DataFrame({"path": [path]})

    by.groupBy("name", "part").cogroup(drawn.groupBy("name", "part")).applyInPandas(build, "path string").write.format("noop").mode("overwrite").save()
    return folder


def row_blocks(cells: DataFrame) -> DataFrame:
    """(sheet, row, text, cells): each row's texts in column order."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.groupBy("sheet", "row").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " | ").alias("text"), F.count(F.lit(1)).alias("cells"))


def render(rows: DataFrame) -> DataFrame:
    """(sheet, text): the rows of each sheet, one to a line."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "text")))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def with_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the merged range that holds them, if any: an equi join on the sheet with a range condition."""
    m = merges.withColumnRenamed("sheet", "__sheet")
    inside = F.col("row").between(F.col("row0"), F.col("row1")) & F.col("col").between(F.col("col0"), F.col("col1"))
    return cells.join(m, (F.col("sheet") == F.col("__sheet")) & inside, "left").drop("__sheet")


def fill_merged(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet, row, label): the label of a range in the first column on every row that it spans; of several the one that starts last."""
    spans = merges.where("col0 = 1").select("sheet", "row0", "label", F.explode(F.sequence("row0", "row1")).alias("row"))
    labels = spans.groupBy("sheet", "row").agg(F.max_by("label", "row0").alias("label"))
    return rows.join(labels, ["sheet", "row"], "left").select("sheet", "row", "label")
