import pytest

from pagelattice.operators import classify as C
from pagelattice.operators import index as I
from pagelattice.operators import reconcile as R
from pagelattice.plans import flow, report
from pagelattice.sources import define_xml, gold, ocr, pdf, vocabulary

XML = """<?xml version="1.0"?>
<ODM xmlns="http://a" xmlns:def="http://b"><Study><!-- <ItemDef OID="IT.X.HIDDEN" Name="HIDDEN"/> -->
<ItemDef OID="IT.VS.VSDTC" Name="VSDTC" DataType="date"><def:Origin><def:DocumentRef><def:PDFPageRef Type="PhysicalRef" PageRefs="7  7 8"/><def:PDFPageRef PageRefs="99"/></def:DocumentRef></def:Origin></ItemDef>
<ItemDef OID="IT.AE.NOPAGES" Name="TWICE"/><ItemDef OID="IT.CM.TWICE" Name="TWICE"><def:PDFPageRef PageRefs="1"/></ItemDef>
<ItemDef OID="XX.VS.OTHER" Name="OTHER"><def:PDFPageRef PageRefs="7-9"/></ItemDef>
<ItemDef OID="IT.SUPPCM.V" Name="V"><def:PDFPageRef PageRefs="3"/></ItemDef><ItemDef OID="IT.DM.V" Name="V"><def:PDFPageRef PageRefs="4"/></ItemDef>
</Study></ODM>"""


def contract(spark, text):
    docs = spark.createDataFrame([("d", text)], "doc_id string, value string")
    return define_xml.contract(define_xml.item_definitions(docs))


def test_define_xml(spark):
    got = {r["variable"]: (r["dataset"], r["page_tokens"], r["page_count"]) for r in contract(spark, XML).collect()}
    assert got == {"VSDTC": ("VS", ["7", "7", "8"], 3), "OTHER": ("", ["7-9"], 1), "V": ("SUPPCM", ["3"], 1)}
    assert define_xml.contract_summary(contract(spark, XML)).first()["datasets"] == 2


@pytest.mark.parametrize("text", ['<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><ODM><ItemDef Name="A" OID="&e;"/></ODM>'])
def test_document_types_are_refused(spark, text):
    with pytest.raises(Exception, match="document type"):
        contract(spark, text).collect()


def test_read_define_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    assert define_xml.read_define_xml(spark, str(tmp_path)).count() == 3


def test_vocabulary(spark, tmp_path):
    (tmp_path / "affix.csv").write_text("﻿ Category ,TERM\ndataset,--\ndataset, supp--\nvariable,'--xfn\nother,Q\n")
    (tmp_path / "black.txt").write_text("# words\nyes\n\nnot related\n")
    v = vocabulary.load_vocabulary(spark, str(tmp_path / "none.csv"), str(tmp_path / "affix.csv"), str(tmp_path / "black.txt"))
    assert (v.exact_dataset, sorted(v.dataset_affixes), v.variable_affixes, v.blacklist) == ([], ["--", "SUPP--"], ["'--XFN"], ["NOT RELATED", "YES"])
    strict = vocabulary.load_vocabulary(spark, str(tmp_path / "none.csv"), str(tmp_path / "affix.csv"), str(tmp_path / "black.txt"), "strict")
    assert (strict.dataset_affixes, strict.variable_affixes) == (["SUPP--"], ["--XFN"])


def test_a_vocabulary_too_large_for_constants_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "terms.csv").write_text("category,term\nvariable,A1\nvariable,A2\nvariable,A3\n")
    monkeypatch.setattr(vocabulary, "MOST_TERMS", 2)
    with pytest.raises(ValueError, match="at most"):
        vocabulary.load_vocabulary(spark, str(tmp_path / "terms.csv"), str(tmp_path / "none.csv"), str(tmp_path / "none.txt"))


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 1)], "x string, y int")
    report.write_csv(rows, ["y", "missing", "x"], str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == 'y,missing,x\n1,,"a,b"\n'


def test_cross_validation_files(spark, tmp_path):
    c = spark.createDataFrame([(1, "DM", "AGE", [1])], "pos int, dataset string, variable string, pages array<int>")
    i = spark.createDataFrame([(1, "AGE", [1], "x", ["r"])], "seq int, variable string, pages array<int>, category string, raw_texts array<string>")
    report.write_cross_validation(R.cross_validate(c, i, spark.createDataFrame([], "domain string, pages array<int>")), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "detail")).first()["diff_type"] == "MATCH"


def test_two_documents_are_kept_apart(spark, tmp_path):
    """Two files of one item each, whose items have the same place: neither is held against the other's annotations."""
    for name, item in (("one", "AAA"), ("two", "BBB")):
        (tmp_path / f"{name}.xml").write_text(f'<ODM xmlns:def="http://b"><ItemDef Label="a > b" OID="IT.DM.{item}" Name="{item}"><def:PDFPageRef PageRefs="3"/></ItemDef></ODM>')
    notes = spark.createDataFrame([("one", 3, 1, "BBB"), ("two", 3, 1, "BBB"), ("two", 4, 2, "CCC")], "doc_id string, page int, seq int, content string")
    text = spark.createDataFrame([("two", 9, "not submitted, NOT SUBMITTED")], "doc_id string, page int, text string")
    out = str(tmp_path / "out")
    found = flow.cross_validate_files(spark, str(tmp_path / "*.xml"), notes, text, C.Vocabulary([], ["AAA", "BBB"], [], [], []), out)
    assert {(r["doc_id"], r["XML_Variable"], r["diff_type"], r["PDF_Pages"]) for r in found.detail.collect()} == {("one", "AAA", "MISSING_IN_PDF", ""), ("two", "BBB", "MATCH", "3")}
    assert {(r["doc_id"], r["PDF_Name"]) for r in found.extra_variables.collect()} == {("one", "BBB"), ("two", "CCC")}
    assert {(r["doc_id"], r["matched"], r["missing_in_pdf"], r["extra_in_pdf_variables"]) for r in found.summary.collect()} == {("one", 0, 1, 1), ("two", 1, 0, 1)}
    assert spark.read.option("header", True).csv(f"{out}/detail").count() == 2
    index = I.structural_index(notes, text, C.Vocabulary([], ["AAA", "BBB"], [], [], []))
    assert [(r["doc_id"], r["variable"], r["page_string"]) for r in index.in_order().collect()] == [("one", "BBB", "3"), ("two", "BBB", "3"), ("two", "CCC", "4"), ("two", "NOT SUBMITTED", "9,9")]
    both = flow.reconcile_parsers(index, I.ocr_index(notes.where("page = 3"), C.Vocabulary([], ["AAA", "BBB"], [], [], [])))
    assert {(r["doc_id"], r["consensus_count"], r["pymupdf_only_count"]) for r in both.summary.collect()} == {("one", 1, 0), ("two", 1, 2)}
    with pytest.raises(ValueError):
        R.cross_validate(define_xml.read_define_xml(spark, str(tmp_path / "*.xml")), index.variables.drop("doc_id"), index.domains)


def test_gold(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 4, 5, "AE")], gold.SCHEMA)
    gold.append_gold(rows, str(tmp_path / "g"))
    gold.append_gold(rows, str(tmp_path / "g"))
    assert gold.read_gold(spark, str(tmp_path / "g")).count() == 2


def test_missing_readers_say_so(spark):
    if not pdf.available():
        with pytest.raises(ImportError):
            pdf.register(spark)
    boxes = spark.createDataFrame([("d", 1, 1, bytearray(b"x"))], "doc_id string, page int, box_seq int, picture binary")
    if not ocr.available("tesseract"):
        with pytest.raises(ImportError):
            ocr.read_boxes(boxes, "tesseract")
    assert ocr.read_boxes(boxes, "own", lambda p: (p.decode().upper(), 0.5)).first()["text"] == "X"


def test_stream(spark, tmp_path):
    from pagelattice.streaming.term_index import stream_terms

    schema = "doc_id string, page int, content string"
    spark.createDataFrame([("d", 1, "AE and VSORRES"), ("d", 2, "VSORRES")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_terms(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert {r["term"]: r["pages"] for r in spark.sql("select * from terms").collect()} == {"AE": [1], "VSORRES": [1, 2]}
