"""Reading document files: dispatch by format, and a DOCX data source.

Files become rows (path, n, kind, text) of paragraphs and table rows in document order. PDF pages and
their images need libraries that are not part of this package: ``read_documents`` takes readers by
extension, and files without one come out as a row that says so, never silently dropped.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, n int, kind string, text string"


def docx_rows(data: bytes) -> Iterator[tuple[str, str]]:
    """(kind, text) of a DOCX file's body in order; nested tables follow their cell, merged cells count once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    yield from _walk(body if body is not None else [])


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br"):
            out.append("\t" if x.tag.endswith("tab") else "\n")
    return "".join(out)


def _walk(node) -> Iterator[tuple[str, str]]:
    for x in node:
        if x.tag == f"{_W}p":
            if (t := _text(x)).strip():
                yield "paragraph", t
        elif x.tag == f"{_W}tbl":
            for row in x.findall(f"{_W}tr"):
                cells, nested = [], []
                for cell in row.findall(f"{_W}tc"):
                    if cell.find(f"{_W}tcPr/{_W}vMerge") is not None and cell.find(f"{_W}tcPr/{_W}vMerge").get(f"{_W}val") != "restart":
                        continue  # goes on from the cell above
                    cells.append("\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip())
                    nested += cell.findall(f"{_W}tbl")
                if any(cells):
                    yield "row", " | ".join(cells)
                for t in nested:
                    yield from _walk([t])


def text_rows(data: bytes) -> Iterator[tuple[str, str]]:
    for line in data.decode("utf-8", "replace").splitlines():
        if line.strip():
            yield "paragraph", line


READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str]]]] = {".docx": docx_rows, ".txt": text_rows}


def read_documents(spark: SparkSession, path: str, readers: dict | None = None) -> DataFrame:
    """Rows of all files under a folder by their extension; unread and broken files give one row of kind ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    by = READERS | (readers or {})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += _rows(p, data, by)
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "n", "kind", "text"])

    return files.mapInArrow(run, SCHEMA)


def _rows(path: str, data: bytes, readers: dict) -> list[tuple]:
    reader = readers.get(os.path.splitext(path)[1].lower())
    if reader is None:
        return [(path, 0, "error", "unsupported format")]
    try:
        return [(path, n, kind, text) for n, (kind, text) in enumerate(reader(data))]
    except Exception as e:  # noqa: BLE001 - a broken file must not fail the others
        return [(path, 0, "error", f"{type(e).__name__}: {e}"[:200])]


class DocxDataSource(DataSource):
    """``spark.read.format("docx").load(folder)``; needs ``spark.dataSource.register(DocxDataSource)`` once."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _DocxReader(self.options["path"])


class _DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(r, f) for r, _, fs in os.walk(self.path) for f in fs if f.lower().endswith(".docx")] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            yield from _rows(partition.value, f.read(), READERS)
