import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.operators import reading as G
from pagelattice.sources import ocr

KNOWN = ["VSTESTCD", "AETERM", "QNAM"]
SCHEMA = "doc_id string, page int, box_seq int, rect struct<x:int,y:int,w:int,h:int>, picture binary"


@pytest.fixture
def reader():
    def read(picture, variant, mode, tiny):
        """Reads what the picture says: variant/mode:text parts."""
        if picture == b"broken":
            raise OSError("no picture")
        said = dict(p.split(":", 1) for p in picture.decode().split("|"))
        return said.get(f"{variant}/{mode}", ""), 90.0

    return read


def boxes(spark, *pictures, w=200, h=40):
    return spark.createDataFrame([("d", 1, i, (0, 0, w, h), p) for i, p in enumerate(pictures)], SCHEMA)


def texts(df):
    return {r["box_seq"]: r["text"] for r in df.collect()}


def test_chain(spark, reader):
    got = texts(G.read_chain(boxes(
        spark, b"plain/6:AETERM|otsu_dilated/7:the patient was seen", b"broken", None, b"adaptive_dilated/6:VSTESTCD", b"adaptive_dilated/7:VSTESTCD",
        b"plain/6:QONAM = X|adaptive/7:QNAM = X", b"plain/6:VSTE STCD = PULSE|adaptive/7:VSTESTCD = PULSE", b"plain/6:a few words of body text",
    ), KNOWN, reader))
    # a clear token; nothing to read twice; the fallback reads with the first mode only; a second reading counts if it is better by 0.35: not 12.7 against 12.4
    assert got == {0: "AETERM", 1: "", 2: "", 3: "VSTESTCD", 4: "", 5: "QNAM = X", 6: "VSTE STCD = PULSE", 7: "a few words of body text"}
    assert texts(G.read_chain(boxes(spark, b"plain/13+:AETERM|plain/6:VSTESTCD", w=40), KNOWN, reader)) == {0: "AETERM"}
    assert G.read_chain(boxes(spark, b"").limit(0), KNOWN, reader).count() == 0


def test_inset(spark):
    df = spark.createDataFrame([((100, 100, 400, 50),), ((0, 0, 30, 8),), ((590, 790, 20, 20),)], "rect struct<x:int,y:int,w:int,h:int>")
    got = [tuple(r[0]) for r in df.select(G.inset(F.col("rect"), F.lit(600), F.lit(800), 1)).collect()]
    assert got == [(101, 102, 398, 46), (0, 0, 31, 9), (589, 790, 11, 10)]


def test_budgets_and_outlines(spark):
    rows = [("p", i, (0, 0, 200, 40), "AETERM = 1" if i % 2 else "some body text") for i in range(20)]
    read = spark.createDataFrame(rows, "page string, box_seq int, rect struct<x:int,y:int,w:int,h:int>, text string")
    assert [r["box_seq"] for r in G.for_costly_reader(read, "trocr", KNOWN, ["page"]).orderBy("box_seq").collect()] == [0, 2, 4, 6]
    assert G.for_costly_reader(read, "easyocr", KNOWN, ["page"]).count() == 8
    few = [("few", i, s, i) for s, n in (("color", 3), ("border", 200)) for i in range(n)]
    many = [("many", i, s, i) for s, n in (("color", 22), ("border", 5)) for i in range(n)]
    measured = spark.createDataFrame(few + many, "page string, box_seq int, source string, area int")
    got = G.contours(measured, measured, ["page"])
    assert {(r["page"], r["source"]): r["count"] for r in got.groupBy("page", "source").count().collect()} == {("few", "color"): 3, ("few", "border"): 180, ("many", "color"): 22}
    assert got.where("page = 'few' and source = 'border'").agg(F.min("area")).first()[0] == 20


def test_pictures():
    rnd = np.random.default_rng(3)
    gray = np.full((30, 60), 200, np.uint8)
    gray[10:20, 15:40] = 30
    gray = (gray + rnd.integers(0, 10, gray.shape)).astype(np.uint8)
    ink = np.zeros(gray.shape, bool)
    ink[10:20, 15:40] = True
    assert ((ocr.otsu(gray) == 0) == ink).all()
    wide = ocr.dilated(ocr.otsu(gray)) == 0
    assert wide.sum() == 9 * 24 and wide[11:20, 16:40].all()
    edge = ocr.adaptive(gray) == 0
    assert edge[10, 15:40].all() and ocr.adaptive(np.full((12, 12), 7, np.uint8)).all() and not ocr.otsu(np.zeros((4, 4), np.uint8)).any()
