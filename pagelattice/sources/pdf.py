"""PDF files as tables of annotations, page texts and page pictures, with PyMuPDF where it is installed.

register(spark) makes spark.read.format("pdf_annotations"), ("pdf_text") and ("pdf_pages") with options path (a glob) and dpi. One partition reads one file.
"""

from __future__ import annotations

import glob
import importlib.util

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows):
        self.paths, self.dpi, self.rows = options["path"], int(options.get("dpi", 300)), rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.paths))]

    def read(self, partition: InputPartition):
        import fitz

        with fitz.open(partition.value) as doc:
            for number, page in enumerate(doc, 1):
                yield from self.rows(partition.value, number, page, self.dpi)


def annotation_rows(path: str, number: int, page, dpi: int):
    seq, ann = 0, page.first_annot
    while ann is not None:
        r = ann.rect
        yield path, number, number * 100_000 + seq, ann.info.get("content", ""), (float(r.x0), float(r.y0), float(r.x1), float(r.y1)), str(ann.type[1])
        seq, ann = seq + 1, ann.next


def text_rows(path: str, number: int, page, dpi: int):
    yield path, number, page.get_text("text")


def picture_rows(path: str, number: int, page, dpi: int):
    yield path, number, page.get_pixmap(dpi=dpi).tobytes("png")


def _source(name_: str, schema_: str, rows) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, rows)

    return Source


Annotations = _source("pdf_annotations", "doc_id string, page int, seq long, content string, rect struct<x0:double,y0:double,x1:double,y1:double>, type string", annotation_rows)
Texts = _source("pdf_text", "doc_id string, page int, text string", text_rows)
Pages = _source("pdf_pages", "doc_id string, page int, picture binary", picture_rows)


def register(spark: SparkSession) -> None:
    """Raises where PyMuPDF is missing."""
    if not available():
        raise ImportError("reading PDF files needs PyMuPDF")
    for s in (Annotations, Texts, Pages):
        spark.dataSource.register(s)
