"""Cases of single operators: rows in, rows out."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import names as N
from pagelattice.functions import ocr as O
from pagelattice.functions import pages as P
from pagelattice.functions import text as X
from pagelattice.operators import boxes as B
from pagelattice.operators import classify as C
from pagelattice.operators import index as I
from pagelattice.operators import reconcile as R
from pagelattice.operators.repair import Repairer, repair
from pagelattice.sources import gold


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], f"c {schema}").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, pages", [("1, 2 3", [1, 2, 3]), ("9-7", [7, 8, 9]), ("7-9,8", [7, 8, 9]), ("1,x,2-", [1]), ("", []), (None, []), ("²", []), ("99999999999999", []), ("1-2-3", [])])
def test_parse_pages(spark, text, pages):
    assert one(spark, text, "string", lambda c: P.parse_pages(P.page_tokens(c))) == pages


RELATIONS = [([], [], "exact", ""), ([1, 2], [1, 2, 3], "pdf_superset", "pdf_only=3"), ([1, 2, 3], [1, 2], "pdf_subset", "xml_only=3"), ([1, 2], [2, 3], "overlap", "xml_only=1; pdf_only=3"), ([1], [2], "disjoint", "xml_only=1; pdf_only=2"), ([], [1], "disjoint", "pdf_only=1"), ([1], [], "disjoint", "xml_only=1")]


def test_relations(spark):
    rows = spark.createDataFrame([(x, p) for x, p, _, _ in RELATIONS], "x array<int>, p array<int>")
    got = rows.select(P.relation(F.col("x"), F.col("p")).alias("r"), P.diff_detail(F.col("x"), F.col("p")).alias("d")).collect()
    assert [(r["r"], r["d"]) for r in got] == [(r, d) for _, _, r, d in RELATIONS]


def test_relation_mirrors(spark):
    sets = [list(s) for n in range(4) for s in itertools.combinations([1, 2, 3], n)]
    rows = spark.createDataFrame([(a, b) for a in sets for b in sets], "x array<int>, p array<int>")
    mirror = {"pdf_superset": "pdf_subset", "pdf_subset": "pdf_superset"}
    for r in rows.select(P.relation(F.col("x"), F.col("p")).alias("a"), P.relation(F.col("p"), F.col("x")).alias("b")).collect():
        assert r["b"] == mirror.get(r["a"], r["a"])


def test_normalize(spark):
    assert one(spark, "  a \tb \n ", "string", P.normalize_text) == "A B"
    assert one(spark, None, "string", P.normalize_text) == ""


@pytest.mark.parametrize("name, kind, target, key", [
    ("faorres", "simple", "FAORRES", ""), ("DSSTDTC.DS.DSDECOD.INFORMED CONSENT OBTAINED", "vlm", "DSSTDTC", "DSDECOD=INFORMED CONSENT OBTAINED"), ("IEORRES.IE.IETESTCD.EQ.I03V020", "vlm", "IEORRES", "IETESTCD=I03V020"),
    ("A.B.C.IN.1.5", "vlm", "A", "C=1.5"), ("A.B.C.EQ", "vlm", "A", "C=EQ"), ("FAORRES.FA.FATESTCD.CLNRSPC.FA.FACAT.1.FA.FASCAT.2", "multi_criteria", "FAORRES", "FATESTCD=CLNRSPC AND FACAT=1 AND FASCAT=2"),
    ("A.B", "low_confidence", "", ""), ("A.B.C", "low_confidence", "", ""), ("A.B.C.D.E", "low_confidence", "", ""), (".", "low_confidence", "", ""), ("A..B", "low_confidence", "", ""),
])
def test_names(spark, name, kind, target, key):
    r = one(spark, name, "string", N.parse_name)
    assert (r["kind"], r["target_var"], r["qualifier_key"]) == (kind, target, key)


@pytest.mark.parametrize("text, cleaned", [("( y ) FAORRES when FATESTCD=REL", "FAORRES when FATESTCD=REL"), ("(x FAORRES when FATESTCD=LDIAM", "FATESTCD=LDIAM"), ("( FAORRES when FATESTCD=LDIAM", "FATESTCD=LDIAM"), ("(x LONGVARIABLETEXT", "LONGVARIABLETEXT"), ("AE (AE)", "AE"), ("DM (Demographics)", "DM (Demographics)"), (None, "")])
def test_clean(spark, text, cleaned):
    assert one(spark, text, "string", X.clean) == cleaned


def test_candidates(spark):
    got = lambda t: set(one(spark, t, "string", X.candidates))
    assert got("LBORRES appears on page 12") == {"LBORRES"}
    assert {"DSTERM", "DSDECOD"} <= got("DSTERM if No then DSTERM/DSDECOD=COMPLETED")
    assert got("VSORRES when VSTESTCD=HEIGHT") == {"VSORRES", "VSTESTCD"}
    assert "AEPTRTPT" in got("AEPTRTPT in SUPPAE")


@pytest.mark.parametrize("text, pairs", [("DSDECOD/DSTERM=ENTERED INTO TRIAL", ["DSDECOD=ENTERED INTO TRIAL", "DSTERM=ENTERED INTO TRIAL"]), ("AE=Adverse Events", []), ("USTRTPT=BEFORE and SUSTTPT=INFORMED CONSENT", ["SUSTTPT=INFORMED CONSENT"]), ("VSSTAT=NOT DONE when VSTESTCD=VSALL", ["VSTESTCD=VSALL"]), ("QNAM=AEHOSPDT in SUPPAE", ["QNAM=AEHOSPDT"])])
def test_value_pairs(spark, text, pairs):
    assert [p["pair"] for p in one(spark, text, "string", X.value_pairs)] == pairs


def test_supp_pairs(spark):
    pairs = lambda f, t: [tuple(p) for p in one(spark, t, "string", f)]
    assert pairs(X.supp_pairs, "QNAM=AEHOSPDT in SUPPAE") == [("AEHOSPDT", "SUPPAE")]
    assert pairs(X.supp_pairs, "QNAM in SUPPxx") == []
    assert pairs(X.ocr_supp_pairs, "AEPTRTPT in SUPPAE") == [("AEPTRTPT", "SUPPAE")]
    assert pairs(X.ocr_supp_pairs, "SUPPAE.AEPTRTPT") == [("AEPTRTPT", "SUPPAE")]
    assert pairs(X.ocr_supp_pairs, "QNAM in SUPPxx") == [("QNAM", "SUPPXX")]
    assert pairs(X.ocr_supp_pairs, "QNAM=AEHOSPDT in SUPPAE") == [("QNAM", "SUPPAE"), ("AEHOSPDT", "SUPPAE")]


@pytest.mark.parametrize("text, n", [("NOT SUBMITTED", 1), ("This is NOT SUBMITTED and also NOTSUBMITTED", 2), ("No submissions here", 0), (None, 0)])
def test_not_submitted(spark, text, n):
    assert one(spark, text, "string", X.not_submitted_count) == n


SHIPPED = C.Vocabulary([], [], ["--", "SQAP--", "AP--", "SUPP--", "REL--", "FA--"], ["--", "'--ACN"], ["YES"])


@pytest.mark.parametrize("term, context, profile, found", [("ZZTOP", "ZZTOP", "structural", ("standard_variable", "suffix_prefix")), ("ZZTOP", "ZZTOP", "ocr", ("unknown", "none")), ("FATESTCD", "FATESTCD", "ocr", ("dataset_name", "suffix_prefix")), ("AE", "AE (Adverse Events)", "structural", ("dataset_name", "exact")), ("YES", "YES", "structural", ("blacklist", "none")), ("XX", "a SUPPAE b", "ocr", ("supp_variable", "supp"))])
def test_classify(spark, term, context, profile, found):
    r = spark.createDataFrame([(term, context)], "t string, c string").select(C.classify(F.col("t"), F.col("c"), SHIPPED, profile).alias("r")).first()["r"]
    assert tuple(r) == found


def test_strong_signal(spark):
    rows = [("AB", "AB=1", True), ("AB", "x AB ; y", True), ("AB", "AB when it rains hard", True), ("AB", "AB (label) of something", True), ("AB", "AB", True), ("AB", "one AB three four", False), ("AB", "XAB= one two", False)]
    got = spark.createDataFrame([(t, c) for t, c, _ in rows], "t string, c string").select(C.strong_signal(F.col("t"), F.col("c")).alias("r")).collect()
    assert [r["r"] for r in got] == [w for _, _, w in rows]


def test_fold_like_one_by_one(spark):
    import random

    rnd, rows, want = random.Random(1), [], {}
    cats, levels = ["dataset_name", "standard_variable", "supp_variable", "unknown", "SUPPAE", "SUPPDM", "not_submitted"], list(C.LEVEL_RANKS)
    for k in range(300):
        category, level = "unknown", "none"
        for seq in range(rnd.randint(1, 6)):
            c, m = rnd.choice(cats), rnd.choice(levels)
            rows.append((k, seq, c, m))
            a, b = C.LEVEL_RANKS[m], C.LEVEL_RANKS[level]
            if a > b:
                category, level = c, m
            elif a == b and c != "unknown" and C.CATEGORY_RANKS.get(c, 0) >= C.CATEGORY_RANKS.get(category, 0):
                category = c
        want[k] = (category, level)
    c, m = C.fold(F.col("c"), F.col("m"), F.col("seq"))
    got = spark.createDataFrame(rows, "k int, seq int, c string, m string").groupBy("k").agg(c.alias("c"), m.alias("m")).collect()
    assert {r["k"]: (r["c"], r["m"]) for r in got} == want


def contract(spark, *rows):
    return spark.createDataFrame([(i, d, v, p) for i, (d, v, p) in enumerate(rows)], "pos int, dataset string, variable string, pages array<int>")


def index(spark, *rows):
    return spark.createDataFrame([(i, v, p, c, ["raw"]) for i, (v, p, c) in enumerate(rows)], "seq int, variable string, pages array<int>, category string, raw_texts array<string>")


def test_cross_validation(spark):
    found = R.cross_validate(
        contract(spark, ("DD", "DDORRES.DD.DDTESTCD.EQ.AUTOPIND", [4]), ("VS", "VSORRES.VS.VSTESTCD.EQ.HEIGHT", [119]), ("FA", "FAORRES.FA.FATESTCD.EQ.REL", [5]), ("DM", "AGE", [19]), ("", "SEX", [1]), ("X", "A.B", [1]), ("DM", "RACE", [19])),
        index(spark, ("DDORRES", [4], "standard_variable"), ("DDTESTCD=AUTOPIND", [4], "unknown"), ("VSTESTCD=HEIGHT", [119], "unknown"), ("FAORRES", [5, 6], "x"), ("FATESTCD=REL", [5], "x"), ("age", [19], "x"), ("A.B", [1], "x"), ("X=Y", [1], "x"), ("RACE", [19, 20], "x"), ("DM", [1], "dataset_name")),
        spark.createDataFrame([("AE", [1])], "domain string, pages array<int>"),
    )
    got = {r["XML_Variable"]: (r["diff_type"], r["match_path"], r["page_subset"], r["page_diff_detail"]) for r in found.detail.collect()}
    assert got == {
        "DDORRES.DD.DDTESTCD.EQ.AUTOPIND": ("VLM_RESOLVED", "path_A_target_var", "exact", ""), "VSORRES.VS.VSTESTCD.EQ.HEIGHT": ("VLM_RESOLVED", "path_B_qualifier_value", "exact", ""), "FAORRES.FA.FATESTCD.EQ.REL": ("VLM_RESOLVED", "path_B_qualifier_value", "exact", ""),
        "AGE": ("MATCH", "simple", "exact", ""), "SEX": ("MISSING_IN_PDF", "", "", ""), "A.B": ("LOW_CONFIDENCE", "", "", ""), "RACE": ("PAGE_MISMATCH", "simple", "pdf_superset", "pdf_only=20"),
    }
    assert [(r["PDF_Name"], r["subtype"]) for r in found.extra_variables.collect()] == [("X=Y", "value_pair")]
    assert {r["PDF_Domain"] for r in found.extra_domains.collect()} == {"AE"}
    assert {r["Dataset"] for r in found.summary_by_dataset.collect()} == {"DD", "VS", "FA", "DM", "UNKNOWN", "X"}
    assert found.summary.first()["vlm_resolved"] == 3


def test_cross_validation_of_nothing(spark):
    found = R.cross_validate(spark.createDataFrame([], "pos int, dataset string, variable string, pages array<int>"), spark.createDataFrame([], "seq int, variable string, pages array<int>, category string, raw_texts array<string>"), spark.createDataFrame([], "domain string, pages array<int>"))
    assert found.detail.count() == 0 and found.summary.first()["total_xml_variables"] == 0


def test_reconcile(spark):
    left = index(spark, ("AE", [1, 2], "x"), ("B", [1], "x"), ("C", [1, 1], "x"), ("NOT SUBMITTED", [1, 1, 2], "not_submitted"), ("L", [1], "x"))
    right = index(spark, ("ae", [2, 1], "x"), ("b", [1, 2], "x"), ("C", [1], "x"), ("NOT SUBMITTED", [1, 2], "not_submitted"), ("R", [1], "x"), ("R", [3], "y"))
    r = R.reconcile(left, right)
    assert {x["Variable"]: x["PageString"] for x in r.consensus.collect()} == {"AE": "1,2", "C": "1"}
    assert {x["Variable"]: (x["MismatchReason"], x["PyMuPDF_PageCount"], x["OpenCV_PageCount"]) for x in r.page_mismatch.collect()} == {"B": ("page_set_mismatch", 1, 2), "NOT SUBMITTED": ("occurrence_count_mismatch", 3, 2)}
    assert [(x["Variable"], x["Pages"]) for x in r.only("opencv").collect()] == [("R", "3")]
    assert [x["Variable"] for x in r.only("pymupdf").collect()] == ["L"]


VARIABLES = ["FACAT", "FAOBJ", "FAORRES", "FASCAT", "QSCAT", "VSORRES", "VSORRESU", "RSSTAT", "DSTERM", "DSDECOD", "SUOCCUR", "SUSTRTPT", "QNAM"]


@pytest.mark.parametrize("text, repaired", [
    ("ACAT=DISEASE CHARACTERISTICS CROHNS DISEASE", "FACAT=DISEASE CHARACTERISTICS CROHNS DISEASE"), ("AOBJ=FEVER OVER 37.8 DEGREES CELSIUS", "FAOBJ=FEVER OVER 37.8 DEGREES CELSIUS"), ("AORRES when FATESTCD=OCCUR", "FAORRES when FATESTCD=OCCUR"),
    ("SORRES/VSORRESU when VSTESTCD=SYSBP", "VSORRES/VSORRESU when VSTESTCD=SYSBP"), ("SSTAT=NOT DONE when RSTESTCD=RSALL", "RSSTAT=NOT DONE when RSTESTCD=RSALL"), ("STERM when DSDECOD=VOLUNTARY WITHDRAWAL", "DSTERM when DSDECOD=VOLUNTARY WITHDRAWAL"), ("OSCAT=IBDQ", "QSCAT=IBDQ"),
    ("UOCCUR=Y when Former or Current is selected", "SUOCCUR=Y when Former or Current is selected"), ("USTRTPT=BEFORE and SUSTTPT=INFORMED CONSENT", "SUSTRTPT=BEFORE and SUSTRTPT=INFORMED CONSENT"), ("FASC AT=X", "FASCAT=X"), ("ON AM=Y in SUPPAE", "QNAM=Y in SUPPAE"), ("QONAM=Y in SUPPAE", "QNAM=Y in SUPPAE"), (None, ""),
])
def test_repair(text, repaired):
    assert Repairer(VARIABLES).repair(text) == repaired


def test_repair_column(spark):
    assert one(spark, "OSCAT=IBDQ", "string", lambda c: repair(c, VARIABLES)) == "QSCAT=IBDQ"


def test_scores(spark):
    rows = spark.createDataFrame([("",), ("AE (Adverse Events)",), ("the whole page is plain text",), ("X" * 300,)], "t string")
    got = [r["s"] for r in rows.select(O.score(F.col("t")).alias("s")).collect()]
    assert got[0] == -10 and got[1] > 3 and got[2] < 0 and got[3] == pytest.approx(-80 / 35, abs=0.01)
    assert one(spark, "the whole page is plain text", "string", lambda c: O.analysis_texts(c)) == []


def test_boxes(spark):
    rect = "struct<x:int,y:int,w:int,h:int>"
    rows = spark.createDataFrame([(1, 1, (0, 0, 10, 10), 0.9), (1, 2, (1, 1, 10, 10), 0.8), (1, 3, (50, 50, 10, 10), 0.5), (2, 1, (0, 0, 5, 5), 0.1)], f"page int, box_seq int, rect {rect}, confidence double")
    assert [(r["page"], r["kept_seq"], r["box_seq"]) for r in B.suppress(rows, ["page"]).orderBy("page", "kept_seq").collect()] == [(1, 1, 1), (1, 2, 3), (2, 1, 1)]
    assert rows.select(B.iou(F.col("rect"), F.col("rect")).alias("i")).first()["i"] == 1.0


def test_nearest(spark):
    t = spark.createDataFrame([("AEBC",), ("ZZ",), ("FACAT",)], "token string")
    v = spark.createDataFrame([("AEBCD",), ("FACAS",), ("FACAR",)], "term string")
    assert [tuple(r) for r in C.nearest_unique(t, v).collect()] == [("AEBC", "AEBCD")]


def test_profiles(spark):
    def kind(*contents):
        rows = spark.createDataFrame([("d", 1, c) for c in contents], "doc_id string, page int, content string")
        return I.annotation_profile(rows).first()["type_key"]

    assert kind("", None) == "annotation_flattened"
    assert kind(*["A"] * 5, *["NOT SUBMITTED"] * 3, "", "") == "msg2_readable"
    assert kind(*["A"] * 4, *["NOT SUBMITTED"] * 4, "", "") == "partial_weak_annotation"


def test_term_index(spark):
    rows = spark.createDataFrame([("d", 1, 1, "VSORRES when VSTESTCD=HEIGHT"), ("d", 2, 2, "VSORRES"), ("d", 2, 3, "VSORRES"), ("d", 3, 4, "DM (Demographics)")], "doc_id string, page int, seq int, content string")
    texts = I.clean_annotations(rows)
    v = C.Vocabulary(["DM"], ["VSORRES"], [], [], [])
    found = I.occurrences(texts, v)
    got = {r["term"]: (r["page_string"], r["category"], r["raw_texts"]) for r in I.term_index(found).collect()}
    assert got["VSORRES"] == ("1,2", "standard_variable", ["VSORRES when VSTESTCD=HEIGHT", "VSORRES"])
    assert got["VSTESTCD=HEIGHT"] == ("1", "unknown", ["VSTESTCD=HEIGHT"])
    assert {r["domain"]: r["page_string"] for r in I.domain_index(texts, found, ["DM"]).collect()} == {"DM": "3"}
    assert I.term_index(I.occurrences(texts, v, "ocr")).count() > 0


def test_recognised_names_snap(spark):
    texts = spark.createDataFrame([("d", 1, 1, "FACATT=X when FAORRES=Y")], "doc_id string, page int, seq int, content string")
    found = I.occurrences(texts, C.Vocabulary([], ["FACAT", "FAORRES"], [], [], []), "ocr")
    assert {(r["term"], r["category"]) for r in found.collect()} == {("FACAT=X", "standard_variable"), ("FAORRES=Y", "standard_variable"), ("FACAT", "standard_variable"), ("FAORRES", "standard_variable")}


def test_page_spec(spark):
    assert one(spark, "11-30,35,40-42, x", "string", lambda c: gold.page_spec(c, F.lit(13))) == [11, 12, 13]
    assert one(spark, None, "string", lambda c: gold.page_spec(c, F.lit(13))) == []
