"""The registered queries and the SQL that gives the same rows. Each query runs an operator over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import names as N
from pagelattice.functions import ocr as O
from pagelattice.functions import pages as P
from pagelattice.functions import text as X
from pagelattice.operators import boxes as B
from pagelattice.operators import classify as C
from pagelattice.operators import index as I
from pagelattice.operators import reading as G
from pagelattice.operators import reconcile as R
from pagelattice.operators.repair import repair
from pagelattice.plans import derived as D
from pagelattice.plans import flow, report
from pagelattice.sources import define_xml, gold

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _relation(x: str, p: str) -> str:
    out = lambda a, b: f"len(list_filter({a}, lambda e: NOT list_contains({b}, e)))"
    return f"CASE WHEN {x} = {p} THEN 'exact' WHEN len({x}) > 0 AND {out(x, p)} = 0 THEN 'pdf_superset' WHEN len({p}) > 0 AND {out(p, x)} = 0 THEN 'pdf_subset' WHEN list_has_any({x}, {p}) THEN 'overlap' ELSE 'disjoint' END"


def _diff(x: str, p: str) -> str:
    only = lambda a, b, n: f"CASE WHEN len(list_filter({a}, lambda e: NOT list_contains({b}, e))) > 0 THEN '{n}=' || array_to_string(list_filter({a}, lambda e: NOT list_contains({b}, e)), ',') END"
    return f"concat_ws('; ', {only(x, p, 'xml_only')}, {only(p, x, 'pdf_only')})"


# --- scalar functions


@query("SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || chr(9) || ' x ', '\\s+', ' ', 'g'))) AS name FROM part")
def normalize_names(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit("\t x "))
    return D.read(spark, sf_dir, "part").select("p_partkey", P.normalize_text(raw).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE '' END AS dataset FROM part")
def oid_dataset(spark, sf_dir):
    k = F.col("p_partkey") % 3
    oid = F.when(k == 0, F.concat(F.lit("IT."), F.col("p_brand"), F.lit(".V"))).when(k == 1, F.concat(F.lit("XX."), F.col("p_brand"), F.lit(".V"))).otherwise(F.concat(F.lit("IT."), F.col("p_brand")))
    return D.read(spark, sf_dir, "part").select("p_partkey", X.oid_dataset(oid).alias("dataset"))


@query("""
WITH t AS (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN generate_series(p_size, p_size + 2) WHEN 1 THEN [p_size, 7] WHEN 2 THEN generate_series(least(p_size, 9), greatest(p_size, 9)) ELSE [p_size] END) AS page FROM part)
SELECT p_partkey, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, CAST(count(*) AS INTEGER) AS n FROM (SELECT DISTINCT * FROM t) GROUP BY 1""")
def parse_pages_ranges(spark, sf_dir):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat((F.col("p_size") + 2).cast("string"), F.lit("-"), s)).when(k == 1, F.concat(F.lit("7, x "), s, F.lit(",2-"))).when(k == 2, F.concat(s, F.lit("-9,"), s)).otherwise(F.concat(s, F.lit(" 1-2-3 "), s))
    pages = P.parse_pages(P.page_tokens(text))
    return D.read(spark, sf_dir, "part").select("p_partkey", P.format_pages(pages).alias("pages"), F.size(pages).alias("n"))


@query("SELECT p_partkey, array_to_string(list_sort([p_size, 3, CAST(p_partkey % 5 AS INTEGER)]), ' ') AS pages FROM part")
def format_pages(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(", x,3 ,"), (F.col("p_partkey") % 5).cast("string"))
    return D.read(spark, sf_dir, "part").select("p_partkey", P.format_pages(P.int_list(raw), " ").alias("pages"))


@query(f"WITH {D.SETS_SQL} SELECT k, {_relation('xml', 'pdf')} AS relation, CAST(list_position(['disjoint', 'overlap', 'pdf_subset', 'pdf_superset', 'exact'], {_relation('xml', 'pdf')}) - 1 AS INTEGER) AS rank FROM sets")
def page_relation(spark, sf_dir):
    rel = P.relation(F.col("xml"), F.col("pdf"))
    return D.page_sets(spark, sf_dir).select("k", rel.alias("relation"), P.relation_rank(rel).alias("rank"))


@query(f"WITH {D.SETS_SQL} SELECT k, {_diff('xml', 'pdf')} AS detail FROM sets")
def page_diff_detail(spark, sf_dir):
    return D.page_sets(spark, sf_dir).select("k", P.diff_detail(F.col("xml"), F.col("pdf")).alias("detail"))


@query("""
WITH s AS (SELECT p_partkey AS k, greatest(1, p_size - 10) AS low, least(40, p_size) AS high FROM part), t AS (SELECT k, unnest(generate_series(low, high)) AS p FROM s UNION SELECT k, 5 FROM s)
SELECT k, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM t GROUP BY k""")
def page_specification(spark, sf_dir):
    spec = F.concat(F.col("p_size").cast("string"), F.lit("-"), F.greatest(F.col("p_size") - 10, F.lit(0)).cast("string"), F.lit(", 5,900,z"))
    return D.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), P.format_pages(gold.page_spec(spec, F.lit(40))).alias("pages"))


@query("SELECT p_partkey, CASE WHEN length(p_name || p_type) > 20 THEN substr(p_name || p_type, 1, 20) || '...' ELSE p_name || p_type END AS preview, replace(p_type || ',x; y | z', ',', ',' || chr(10)) AS wrapped FROM (SELECT *, 1 FROM part)".replace("replace(p_type || ',x; y | z', ',', ',' || chr(10))", "replace(replace(replace(p_type || ',x; y | z', ',', ',' || chr(10)), '; ', ';' || chr(10)), ' | ', chr(10))"))
def cell_text(spark, sf_dir):
    return D.read(spark, sf_dir, "part").select("p_partkey", report.preview(F.concat("p_name", "p_type"), 20).alias("preview"), report.wrap(F.concat("p_type", F.lit(",x; y | z"))).alias("wrapped"))


_PARTED = r"""
raw AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'v' || p_partkey WHEN 1 THEN 'V.' || p_partkey WHEN 2 THEN 'V..' || p_partkey || '.Q.X Y' WHEN 3 THEN 'V.D.Q.EQ.' || p_size || '.5' WHEN 4 THEN 'V.D.Q.Z.' || p_size
  WHEN 5 THEN 'V.A.QA.' || p_size || '.B.QB.' || p_partkey WHEN 6 THEN 'A.B.C.EQ' ELSE 'A.B.C.in.E.F.G.H' END AS name FROM part),
parts AS (SELECT k, name, list_filter(list_transform(string_split(upper(name), '.'), lambda x: trim(x)), lambda x: x <> '') AS p FROM raw),
kinds AS (SELECT *, CASE WHEN len(p) = 1 THEN 'simple' WHEN len(p) >= 5 AND p[4] IN ('EQ', 'IN') THEN 'vlm' WHEN len(p) = 4 THEN 'vlm' WHEN len(p) >= 7 AND (len(p) - 1) % 3 = 0 THEN 'multi_criteria' ELSE 'low_confidence' END AS kind FROM parts)"""


def _names(spark, sf_dir):
    k, s, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 8
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    name = F.when(n == 0, cat("v", k)).when(n == 1, cat("V.", k)).when(n == 2, cat("V..", k, ".Q.X Y")).when(n == 3, cat("V.D.Q.EQ.", s, ".5")).when(n == 4, cat("V.D.Q.Z.", s)).when(n == 5, cat("V.A.QA.", s, ".B.QB.", k)).when(n == 6, F.lit("A.B.C.EQ")).otherwise(F.lit("A.B.C.in.E.F.G.H"))
    return D.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), N.parse_name(name).alias("n"))


@query(f"""WITH {_PARTED}
SELECT k, kind, CASE WHEN kind = 'low_confidence' THEN '' ELSE p[1] END AS target, CASE WHEN kind = 'vlm' AND len(p) >= 5 THEN p[4] ELSE '' END AS operator,
  CASE WHEN kind = 'vlm' AND len(p) = 4 THEN p[3] || '=' || p[4] WHEN kind = 'vlm' THEN p[3] || '=' || array_to_string(p[5:], '.')
    WHEN kind = 'multi_criteria' THEN array_to_string(list_transform(range(2, len(p), 3), lambda i: p[i + 1] || '=' || p[i + 2]), ' AND ') ELSE '' END AS key,
  CAST(CASE kind WHEN 'vlm' THEN 1 WHEN 'multi_criteria' THEN (len(p) - 1) // 3 ELSE 0 END AS INTEGER) AS n_criteria FROM kinds""")
def parse_names(spark, sf_dir):
    return _names(spark, sf_dir).select("k", "n.kind", F.col("n.target_var").alias("target"), "n.operator", F.col("n.qualifier_key").alias("key"), F.size("n.criteria").alias("n_criteria"))


# --- contract


@query("""
WITH items AS (SELECT o_custkey % 500 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (o_orderkey % 9) || '  ' || (o_orderkey % 9) END AS refs, o_orderkey FROM orders),
f AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY name ORDER BY o_orderkey) = 1)
SELECT 'N' || name AS variable, array_to_string(string_split_regex(refs, ' +'), ' ') AS page_string, 2 AS page_count FROM f WHERE refs <> ''""")
def define_contract_dedupe(spark, sf_dir):
    k = F.col("o_orderkey")
    refs = F.when(k % 3 != 0, F.concat((k % 9).cast("string"), F.lit("  "), (k % 9).cast("string")))
    items = D.read(spark, sf_dir, "orders").select(k.alias("pos"), F.concat(F.lit("N"), (F.col("o_custkey") % 500).cast("string")).alias("name"), F.lit("IT.A.B").alias("oid"), refs.alias("page_refs"))
    return define_xml.contract(items).select("variable", "page_string", "page_count")


@query("SELECT 'P' || p_partkey AS variable, p_brand AS dataset, CASE WHEN p_size % 2 = 0 THEN p_size || ' 7' ELSE CAST(p_size AS VARCHAR) END AS page_string, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS page_count FROM part WHERE p_size % 5 <> 0")
def xml_contract_roundtrip(spark, sf_dir):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    refs = F.when(s % 5 == 0, "").otherwise(F.concat(F.lit('<d:Origin><d:DocumentRef><d:PDFPageRef Type="PhysicalRef" PageRefs="'), s.cast("string"), F.when(s % 2 == 0, " 7").otherwise(""), F.lit('"/></d:DocumentRef></d:Origin>')))
    item = F.concat(F.lit('<ItemDef OID="IT.'), F.col("p_brand"), F.lit(".P"), k, F.lit('" Name="P'), k, F.lit('">'), refs, F.lit("</ItemDef>"))
    rows = D.read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).cast("string").alias("doc_id")).agg(F.array_join(F.collect_list(item), "\n").alias("items"))
    docs = rows.select("doc_id", F.concat(F.lit('<ODM xmlns:d="urn:d"><Study>'), "items", F.lit("</Study></ODM>")).alias("value"))
    return define_xml.contract(define_xml.item_definitions(docs)).select("variable", "dataset", "page_string", "page_count")


@query("SELECT count(*) AS variables, CAST(sum(n) AS BIGINT) AS page_refs, count(DISTINCT d) AS datasets FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS d FROM part)")
def contract_summary(spark, sf_dir):
    rows = D.read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, 2).otherwise(1).alias("page_count"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("dataset"))
    return define_xml.contract_summary(rows)


# --- cross-validation

_CROSS = f"""WITH {D.CONTRACT_SQL},
vars AS (
  SELECT upper(variable) AS name, list_sort(list_distinct(flatten(list(pages)))) AS pages, arg_min(CASE WHEN category = '' THEN 'unknown' ELSE category END, seq) AS category,
    array_to_string(list_distinct_ordered, ' | ') AS raws
  FROM (SELECT t.*, r.list_distinct_ordered FROM term_rows t JOIN (SELECT variable AS v, list(raw ORDER BY s) AS list_distinct_ordered FROM (SELECT variable, raw, min(seq) AS s FROM term_rows GROUP BY 1, 2) GROUP BY 1) r ON r.v = t.variable)
  WHERE category NOT IN ('dataset_name', 'not_submitted') GROUP BY upper(variable), list_distinct_ordered),
doms AS (SELECT name, list_sort(list_distinct(flatten(list(pages)))) AS pages FROM (SELECT upper(domain) AS name, pages FROM domain_rows UNION ALL SELECT upper(variable), pages FROM term_rows WHERE category = 'dataset_name') GROUP BY 1),
parsed AS (SELECT *, pos % 6 AS m, CASE pos % 6 WHEN 0 THEN 'simple' WHEN 5 THEN 'simple' WHEN 3 THEN 'multi_criteria' WHEN 4 THEN 'low_confidence' ELSE 'vlm' END AS kind FROM contract),
cands AS (
  SELECT pos, 0 AS ord, CASE WHEN m IN (0, 5) THEN 'V' || pos WHEN m = 4 THEN 'V' || pos || '.B' ELSE 'V' || pos END AS name, CASE WHEN m IN (0, 4, 5) THEN 'simple' ELSE 'path_A_target_var' END AS path FROM parsed
  UNION ALL SELECT pos, 1, 'Q' || pos || '=' || CASE WHEN m = 1 THEN 'X' ELSE '1.5' END, 'path_B_qualifier_value' FROM parsed WHERE m IN (1, 2)
  UNION ALL SELECT pos, 1, 'QA=' || pos, 'path_B_criteria_0' FROM parsed WHERE m = 3
  UNION ALL SELECT pos, 2, 'QB=' || pos, 'path_B_criteria_1' FROM parsed WHERE m = 3),
hits AS (SELECT c.*, v.pages AS mp, {_relation('p.pages', 'v.pages')} AS rel FROM cands c JOIN parsed p USING (pos) JOIN vars v USING (name) WHERE p.kind <> 'low_confidence'),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY pos ORDER BY list_position(['disjoint', 'overlap', 'pdf_subset', 'pdf_superset', 'exact'], rel) DESC, ord) = 1),
detail AS (
  SELECT p.dataset AS XML_Dataset, p.variable AS XML_Variable, array_to_string(p.pages, ',') AS XML_Pages, CAST(len(p.pages) AS INTEGER) AS XML_PageCount, coalesce(b.name, '') AS PDF_Matched_Name,
    coalesce(array_to_string(b.mp, ','), '') AS PDF_Pages, CAST(coalesce(len(b.mp), 0) AS INTEGER) AS PDF_PageCount,
    CASE WHEN kind = 'low_confidence' THEN 'LOW_CONFIDENCE' WHEN b.rel IS NULL THEN 'MISSING_IN_PDF' WHEN b.rel <> 'exact' THEN 'PAGE_MISMATCH' WHEN kind = 'simple' THEN 'MATCH' ELSE 'VLM_RESOLVED' END AS diff_type,
    coalesce(b.rel, '') AS page_subset, coalesce(b.path, '') AS match_path, CASE WHEN b.rel IS NULL THEN '' ELSE {_diff('p.pages', 'b.mp')} END AS page_diff_detail,
    CASE WHEN kind = 'low_confidence' THEN 'Unable to parse XML variable into simple or VLM pattern.' ELSE '' END AS note, p.pos
  FROM parsed p LEFT JOIN best b USING (pos)),
extra AS (SELECT 'EXTRA_IN_PDF' AS diff_type, name AS PDF_Name, array_to_string(pages, ',') AS PDF_Pages, CAST(len(pages) AS INTEGER) AS PDF_PageCount, category AS Category, CASE WHEN contains(name, '=') THEN 'value_pair' ELSE 'unmapped_variable' END AS subtype, raws AS RawTexts FROM vars WHERE name NOT IN (SELECT name FROM cands)),
extra_domains AS (SELECT 'EXTRA_IN_PDF' AS diff_type, name AS PDF_Domain, array_to_string(pages, ',') AS PDF_Pages, CAST(len(pages) AS INTEGER) AS PDF_PageCount, 'extra_domain' AS subtype FROM doms WHERE name NOT IN (SELECT upper(dataset) FROM contract))
"""


def _cross(spark, sf_dir) -> R.CrossValidation:
    return R.cross_validate(*D.contract_tables(spark, sf_dir))


@query(_CROSS + "SELECT * EXCLUDE (pos) FROM detail")
def cross_validation_detail(spark, sf_dir):
    return _cross(spark, sf_dir).detail


@query(_CROSS + "SELECT pos, name AS matched_name, path AS match_path, array_to_string(mp, ',') AS pages, rel AS relation FROM best")
def best_match(spark, sf_dir):
    contract, index, _ = D.contract_tables(spark, sf_dir)
    rows = contract.withColumn("parsed", N.parse_name(F.col("variable"))).where("parsed.kind <> 'low_confidence'").withColumn("candidates", N.candidate_names(F.col("parsed")))
    return R.best_matches(rows, R.variable_index(index)).select("pos", "matched_name", "match_path", P.format_pages(F.col("matched_pages")).alias("pages"), "relation")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE diff_type = '{d}') AS {{{d}}}" for d in R.DIFFS.values())


@query(_CROSS + "SELECT XML_Dataset AS Dataset, count(*) AS XML_Variable_Count, " + _COUNTS.format(**{d: d for d in R.DIFFS.values()}) + " FROM detail GROUP BY 1")
def summary_by_dataset(spark, sf_dir):
    return _cross(spark, sf_dir).summary_by_dataset


@query(_CROSS + "SELECT count(*) AS total_xml_variables, " + _COUNTS.format(**{d: n for n, d in R.DIFFS.items()}) + ", (SELECT count(*) FROM vars) AS total_pdf_variables, (SELECT count(*) FROM doms) AS total_pdf_domains, (SELECT count(*) FROM extra) AS extra_in_pdf_variables, (SELECT count(*) FROM extra_domains) AS extra_in_pdf_domains FROM detail")
def summary_total(spark, sf_dir):
    return _cross(spark, sf_dir).summary


@query(_CROSS + "SELECT * FROM extra")
def extra_variables(spark, sf_dir):
    return _cross(spark, sf_dir).extra_variables


@query(_CROSS + "SELECT * FROM extra_domains")
def extra_domains(spark, sf_dir):
    return _cross(spark, sf_dir).extra_domains


@query(_CROSS + "SELECT name, array_to_string(pages, ',') AS pages, category, raws FROM vars")
def pdf_variable_index(spark, sf_dir):
    return R.variable_index(D.contract_tables(spark, sf_dir)[1]).select("name", P.format_pages(F.col("pages")).alias("pages"), "category", F.array_join("raw_texts", " | ").alias("raws"))


@query(_CROSS + "SELECT XML_Dataset || ' / ' || XML_Variable AS item, replace(XML_Pages, ',', ',' || chr(10)) || ' (' || XML_PageCount || ')' AS xml_pages, PDF_Matched_Name AS matched, replace(PDF_Pages, ',', ',' || chr(10)) || ' (' || PDF_PageCount || ')' AS pdf_pages, diff_type || ' / ' || page_subset || ' / ' || match_path AS verdict, replace(replace(page_diff_detail, ',', ',' || chr(10)), '; ', ';' || chr(10)) AS difference FROM detail")
def detail_display(spark, sf_dir):
    return report.detail_display(_cross(spark, sf_dir).detail)


# --- whole documents: Define-XML, annotations and page texts to results


def _documents(spark, sf_dir) -> R.CrossValidation:
    xml, notes, text = D.documents(spark, sf_dir)
    return flow.cross_validate_documents(define_xml.contract(define_xml.item_definitions(xml)), notes, text, _vocabulary())


_DOCUMENTS = f"""WITH {D.DOCUMENTS_SQL},
pair AS (SELECT c.doc_id, c.name, c.dataset, c.xml, v.pages, CASE WHEN v.pages IS NOT NULL THEN {_relation('c.xml', 'v.pages')} END AS rel FROM contract c LEFT JOIN vars v ON v.doc_id = c.doc_id AND v.name = c.name),
detail AS (SELECT doc_id, dataset AS XML_Dataset, name AS XML_Variable, array_to_string(xml, ',') AS XML_Pages, CAST(len(xml) AS INTEGER) AS XML_PageCount, CASE WHEN rel IS NULL THEN '' ELSE name END AS PDF_Matched_Name,
  coalesce(array_to_string(pages, ','), '') AS PDF_Pages, CAST(coalesce(len(pages), 0) AS INTEGER) AS PDF_PageCount, CASE WHEN rel IS NULL THEN 'MISSING_IN_PDF' WHEN rel = 'exact' THEN 'MATCH' ELSE 'PAGE_MISMATCH' END AS diff_type,
  coalesce(rel, '') AS page_subset, CASE WHEN rel IS NULL THEN '' ELSE 'simple' END AS match_path, CASE WHEN rel IS NULL THEN '' ELSE {_diff('xml', 'pages')} END AS page_diff_detail, '' AS note FROM pair),
extra AS (SELECT v.doc_id, 'EXTRA_IN_PDF' AS diff_type, v.name AS PDF_Name, array_to_string(v.pages, ',') AS PDF_Pages, CAST(len(v.pages) AS INTEGER) AS PDF_PageCount, 'standard_variable' AS Category, 'unmapped_variable' AS subtype, 'see ' || v.name AS RawTexts
  FROM vars v ANTI JOIN contract c ON v.doc_id = c.doc_id AND v.name = c.name)
"""


@query(_DOCUMENTS + "SELECT * FROM detail")
def documents_detail(spark, sf_dir):
    return _documents(spark, sf_dir).detail


@query(_DOCUMENTS + "SELECT * FROM extra")
def documents_extra_variables(spark, sf_dir):
    return _documents(spark, sf_dir).extra_variables


@query(_DOCUMENTS + "SELECT doc_id, XML_Dataset AS Dataset, count(*) AS XML_Variable_Count, " + _COUNTS.format(**{d: d for d in R.DIFFS.values()}) + " FROM detail GROUP BY 1, 2")
def documents_summary_by_dataset(spark, sf_dir):
    return _documents(spark, sf_dir).summary_by_dataset


@query(_DOCUMENTS + ", v AS (SELECT doc_id, count(*) AS n FROM vars GROUP BY 1), e AS (SELECT doc_id, count(*) AS n FROM extra GROUP BY 1) SELECT d.doc_id, count(*) AS total_xml_variables, " + _COUNTS.format(**{d: n for n, d in R.DIFFS.items()}) + ", coalesce(any_value(v.n), 0) AS total_pdf_variables, CAST(0 AS BIGINT) AS total_pdf_domains, coalesce(any_value(e.n), 0) AS extra_in_pdf_variables, CAST(0 AS BIGINT) AS extra_in_pdf_domains FROM detail d LEFT JOIN v ON v.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id")
def documents_summary(spark, sf_dir):
    return _documents(spark, sf_dir).summary


@query(f"""WITH {D.DOCUMENTS_SQL},
r AS (SELECT doc_id, 0 AS last, name AS variable, array_to_string(pages, ',') AS pages, CAST(len(pages) AS INTEGER) AS page_count, 'standard_variable' AS category, 'suffix_prefix' AS match_level, 'see ' || name AS raw_texts FROM vars
  UNION ALL SELECT doc_id, 1, 'NOT SUBMITTED', string_agg(CAST(page AS VARCHAR), ',' ORDER BY page), CAST(count(*) AS INTEGER), 'not_submitted', '', '' FROM bags GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY last, variable) AS INTEGER) AS place, variable, pages, page_count, category, match_level, raw_texts FROM r""")
def structural_index(spark, sf_dir):
    _, notes, text = D.documents(spark, sf_dir)
    rows = I.structural_index(notes, text, _vocabulary()).variables
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("place"), "variable", F.col("page_string").alias("pages"), "page_count", "category", "match_level", F.array_join("raw_texts", " | ").alias("raw_texts"))


# --- annotation texts


@query(f"WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL} SELECT doc_id, page, content FROM texts")
def clean_annotations(spark, sf_dir):
    return I.clean_annotations(D.annotations(spark, sf_dir)).select("doc_id", "page", "content")


_STOP = "['" + "', '".join(X.STOPWORDS) + "']"


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents)
SELECT doc_id, token FROM w WHERE regexp_full_match(token, '[A-Z][A-Z0-9]{{1,7}}') AND NOT list_contains({_STOP}, token)""")
def candidate_tokens(spark, sf_dir):
    # '=' begins a value span, of which these texts' tokens are no part here
    text = F.replace(F.col("text"), F.lit("="), F.lit(";"))
    return D.read(spark, sf_dir, "documents").select("doc_id", F.explode(X.candidates(text)).alias("token"))


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL}, m AS (SELECT seq, doc_id, page, content, regexp_replace(content, '(=\\s*)[A-Z0-9](?:[A-Z0-9\\s/\\-]{{0,79}}([A-Z0-9/\\-]))?', '\\1_\\2', 'g') AS masked FROM texts),
t AS (SELECT DISTINCT doc_id, page, content, unnest(regexp_extract_all(masked, '\\b([A-Z][A-Z0-9]{{1,7}})\\b', 1)) AS token FROM m)
SELECT * FROM t WHERE NOT list_contains({_STOP}, token) AND token NOT IN ('SMALL', 'LARGE')""")
def candidates_masked(spark, sf_dir):
    return I.clean_annotations(D.annotations(spark, sf_dir)).select("doc_id", "page", "content", F.explode(X.candidates(F.col("content"), D.VOCABULARY["blacklist"])).alias("token"))


#: The words of each annotation's template, from which its pairs follow: DuckDB's patterns have no look-ahead.
_TEMPLATE_SQL = """w AS (SELECT CAST(l_orderkey % 40 AS VARCHAR) AS doc_id, CAST(l_suppkey % 25 + 1 AS INTEGER) AS page, (l_orderkey + l_linenumber) % 6 AS kind, w
  FROM lineitem JOIN (SELECT p_partkey, string_split(upper(p_type || ' ' || p_name), ' ') AS w FROM part) ON p_partkey = l_partkey)"""


@query(f"""WITH {_TEMPLATE_SQL}, p AS (SELECT doc_id, page, w[2] AS variable, w[3] AS value FROM w WHERE kind = 0 UNION ALL SELECT doc_id, page, w[1], w[2] || ' DONE' FROM w WHERE kind = 1
  UNION ALL SELECT doc_id, page, w[3], w[2] || ' DONE' FROM w WHERE kind = 1 UNION ALL SELECT doc_id, page, 'QNAM', w[3] FROM w WHERE kind = 2)
SELECT *, variable || '=' || value AS pair FROM p""")
def value_pairs(spark, sf_dir):
    rows = D.annotations(spark, sf_dir)
    return rows.select("doc_id", "page", F.explode(X.value_pairs(F.col("content"))).alias("p")).select("doc_id", "page", "p.variable", "p.value", "p.pair")


@query(f"""
WITH {D.ANNOTATIONS_SQL}, f AS (
  SELECT doc_id, page, seq, unnest(list_zip(regexp_extract_all(content, '([A-Z][A-Z0-9]*?)\\s+in\\s+(SUPP[A-Z]{{2,}})', 1), regexp_extract_all(content, '([A-Z][A-Z0-9]*?)\\s+in\\s+(SUPP[A-Z]{{2,}})', 2))) AS p FROM annotations)
SELECT doc_id, page, p[1] AS variable, p[2] AS dataset FROM f WHERE length(p[1]) <= 8 AND length(p[2]) <= 8""")
def supp_pairs(spark, sf_dir):
    return D.annotations(spark, sf_dir).select("doc_id", "page", F.explode(X.supp_pairs(F.col("content"))).alias("p")).select("doc_id", "page", "p.variable", "p.dataset")


@query(f"""WITH {_TEMPLATE_SQL} SELECT doc_id, page, 'QNAM' AS variable, 'SUPPAE' AS dataset FROM w WHERE kind = 2 UNION ALL SELECT doc_id, page, w[3], 'SUPPAE' FROM w WHERE kind = 2 UNION ALL SELECT doc_id, page, w[3], 'SUPPVS' FROM w WHERE kind = 5""")
def ocr_supp_pairs(spark, sf_dir):
    return D.annotations(spark, sf_dir).select("doc_id", "page", F.explode(X.ocr_supp_pairs(F.col("content"))).alias("p")).select("doc_id", "page", "p.variable", "p.dataset")


@query(f"""
WITH {D.ANNOTATIONS_SQL}, n AS (SELECT doc_id, page, len(regexp_extract_all(content, '(?i)\\b(?:NOT\\s+SUBMITTED|NOTSUBMITTED)\\b')) AS n FROM annotations),
p AS (SELECT doc_id, page, unnest(range(n)) FROM n WHERE n > 0)
SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, count(*) AS occurrences, CAST(count(DISTINCT page) AS INTEGER) AS page_count FROM p GROUP BY 1""")
def not_submitted_bag(spark, sf_dir):
    return I.not_submitted_bag(D.annotations(spark, sf_dir), "content").select("doc_id", F.col("page_string").alias("pages"), "occurrences", "page_count")


# --- classification and indexes


def _vocabulary() -> C.Vocabulary:
    v = D.VOCABULARY
    return C.Vocabulary(v["dataset"], v["variable"], v["dataset_affixes"], v["variable_affixes"], v["blacklist"])


_SQL_LIST = lambda words: "('" + "', '".join(w.replace("'", "''") for w in words) + "')"


def _classify_sql(ocr: bool) -> str:
    v = D.VOCABULARY
    bare = "" if ocr else "WHEN true THEN 'standard_variable/suffix_prefix'"
    return f"""
WITH {D.ANNOTATIONS_SQL}, t AS (SELECT DISTINCT upper(p_w) AS term, content FROM annotations, (SELECT DISTINCT unnest(string_split(p_type || ' ' || p_name, ' ')) AS p_w FROM part UNION SELECT unnest(['AE', 'SUPPXY', 'NOTSUBMITTEDX', 'PROMO', 'FAX', 'QZ', 'SMALL'])))
SELECT term, content, CASE WHEN term IN {_SQL_LIST(v["blacklist"])} THEN 'blacklist/none' WHEN contains(term, 'NOT') AND contains(term, 'SUBMITTED') THEN 'not_submitted/none'
  WHEN regexp_matches(upper(content), '\\b' || term || '\\s*\\(') THEN 'dataset_name/exact' WHEN term IN {_SQL_LIST(v["dataset"])} THEN 'dataset_name/exact' WHEN term IN {_SQL_LIST(v["variable"])} THEN 'standard_variable/exact'
  {bare} WHEN starts_with(term, 'STA') OR ends_with(term, 'ED') THEN 'standard_variable/suffix_prefix' WHEN starts_with(term, 'SUPP') OR starts_with(term, 'FA') OR starts_with(term, 'PRO') THEN 'dataset_name/suffix_prefix'
  {"WHEN regexp_matches(content, '\\bSUPP[A-Z]{2,8}\\b') THEN 'supp_variable/supp'" if ocr else ""} ELSE 'unknown/none' END AS class FROM t"""


def _terms(spark, sf_dir):
    words = D.read(spark, sf_dir, "part").select(F.explode(F.split(F.upper(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("term")).union(spark.createDataFrame([(w,) for w in ("AE", "SUPPXY", "NOTSUBMITTEDX", "PROMO", "FAX", "QZ", "SMALL")], "term string")).distinct()
    # the query asks for every word beside every distinct text; which side is sent around is left to the sizes
    return D.annotations(spark, sf_dir).select("content").distinct().crossJoin(words)


@query(_classify_sql(False))
def classify_terms(spark, sf_dir):
    c = C.classify(F.col("term"), F.col("content"), _vocabulary())
    return _terms(spark, sf_dir).select("term", "content", F.concat_ws("/", c["category"], c["match_level"]).alias("class"))


@query(_classify_sql(True))
def classify_terms_ocr(spark, sf_dir):
    c = C.classify(F.col("term"), F.col("content"), _vocabulary(), "ocr")
    return _terms(spark, sf_dir).select("term", "content", F.concat_ws("/", c["category"], c["match_level"]).alias("class"))


@query("""
WITH t AS (SELECT l_partkey AS k, ['dataset_name', 'standard_variable', 'SUPPAE', 'supp_variable', 'unknown', 'SUPPDM'][CAST(l_suppkey % 6 + 1 AS INTEGER)] AS category, ['exact', 'suffix_prefix', 'supp', 'none'][CAST(l_orderkey % 4 + 1 AS INTEGER)] AS level,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)
SELECT k, category, level FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE level WHEN 'exact' THEN 3 WHEN 'suffix_prefix' THEN 2 WHEN 'supp' THEN 1 ELSE 0 END DESC,
  CASE category WHEN 'dataset_name' THEN 3 WHEN 'not_submitted' THEN 3 WHEN 'standard_variable' THEN 2 WHEN 'supp_variable' THEN 1 ELSE 0 END DESC, (category <> 'unknown')::INT DESC, seq DESC) = 1""")
def category_fold(spark, sf_dir):
    pick = lambda words, c: F.get(F.array(*map(F.lit, words)), (F.col(c) % len(words)).cast("int"))
    category, level = pick(["dataset_name", "standard_variable", "SUPPAE", "supp_variable", "unknown", "SUPPDM"], "l_suppkey"), pick(["exact", "suffix_prefix", "supp", "none"], "l_orderkey")
    rows = D.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), category.alias("category"), level.alias("level"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    c, m = C.fold(F.col("category"), F.col("level"), F.col("seq"))
    return rows.groupBy("k").agg(c.alias("category"), m.alias("level"))


def _structural(spark, sf_dir):
    texts = I.clean_annotations(D.annotations(spark, sf_dir))
    return texts, I.occurrences(texts, _vocabulary())


#: What each annotation's template holds: pairs, tokens outside of values, and both names of a SUPP pair. DuckDB's patterns have no look-ahead.
_OCCURRENCES = f"""
pairs AS (
  SELECT doc_id, page, seq, content, regexp_extract(content, ' when ([A-Z]+)=', 1) AS v, regexp_extract(content, '=([A-Z]+)$', 1) AS x FROM texts WHERE contains(content, ' when ')
  UNION ALL SELECT doc_id, page, seq, content, regexp_extract(content, '^([A-Z]+)/', 1), regexp_extract(content, '=(.*);', 1) FROM texts WHERE contains(content, 'DONE; next')
  UNION ALL SELECT doc_id, page, seq, content, regexp_extract(content, '/([A-Z]+)=', 1), regexp_extract(content, '=(.*);', 1) FROM texts WHERE contains(content, 'DONE; next')
  UNION ALL SELECT doc_id, page, seq, content, 'QNAM', regexp_extract(content, '=([A-Z]+) in', 1) FROM texts WHERE starts_with(content, 'QNAM=')),
m AS (SELECT doc_id, page, seq, content, regexp_replace(content, '(=\\s*)[A-Z0-9](?:[A-Z0-9\\s/\\-]{{0,79}}([A-Z0-9/\\-]))?', '\\1_\\2', 'g') AS masked FROM texts),
tokens AS (SELECT doc_id, page, seq, content, unnest(regexp_extract_all(masked, '\\b([A-Z][A-Z0-9]{{1,7}})\\b', 1)) AS term FROM m),
parts AS (SELECT doc_id, page, seq, content, unnest([regexp_extract(content, '([A-Z]+) in SUPP', 1), regexp_extract(content, ' in (SUPP[A-Z]+)', 1)]) AS term FROM texts WHERE contains(content, ' in SUPP')),
occ AS (
  SELECT doc_id, page, seq, content, v AS lhs, v || '=' || x AS term, v || '=' || x AS raw FROM pairs WHERE v NOT IN ('SMALL', 'LARGE')
  UNION ALL SELECT doc_id, page, seq, content, term, term, content FROM tokens WHERE term NOT IN ('SMALL', 'LARGE') AND NOT list_contains({_STOP}, term)
  UNION ALL SELECT doc_id, page, seq, content, term, term, content FROM parts WHERE term NOT IN ('SMALL', 'LARGE'))"""


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL}, {_OCCURRENCES},
c AS (SELECT *, CASE WHEN regexp_matches(upper(content), '\\b' || lhs || '\\s*\\(') OR lhs IN {_SQL_LIST(D.VOCABULARY["dataset"])} THEN 3 WHEN lhs IN {_SQL_LIST(D.VOCABULARY["variable"])} THEN 2 ELSE 1 END AS class FROM occ),
r AS (SELECT doc_id, term, string_agg(raw, ' | ' ORDER BY s) AS raw_texts FROM (SELECT doc_id, term, raw, min(seq) AS s FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT doc_id, term, list_sort(list(DISTINCT page)) AS pages, max(class) AS class FROM c GROUP BY 1, 2)
SELECT doc_id, term, array_to_string(pages, ',') AS page_string, CAST(len(pages) AS INTEGER) AS page_count, CASE class WHEN 3 THEN 'dataset_name' ELSE 'standard_variable' END AS category, CASE class WHEN 1 THEN 'suffix_prefix' ELSE 'exact' END AS match_level, raw_texts FROM g JOIN r USING (doc_id, term)""")
def term_index(spark, sf_dir):
    texts, found = _structural(spark, sf_dir)
    return I.term_index(found).select("doc_id", "term", "page_string", "page_count", "category", "match_level", F.array_join("raw_texts", " | ").alias("raw_texts"))


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL},
pairs AS (
  SELECT doc_id, page, regexp_extract(content, ' when ([A-Z]+)=', 1) AS v, regexp_extract(content, '=([A-Z]+)$', 1) AS x FROM texts WHERE contains(content, ' when ')
  UNION ALL SELECT doc_id, page, regexp_extract(content, '^([A-Z]+)/', 1), regexp_extract(content, '=(.*);', 1) FROM texts WHERE contains(content, 'DONE; next')
  UNION ALL SELECT doc_id, page, regexp_extract(content, '/([A-Z]+)=', 1), regexp_extract(content, '=(.*);', 1) FROM texts WHERE contains(content, 'DONE; next')
  UNION ALL SELECT doc_id, page, 'QNAM', regexp_extract(content, '=([A-Z]+) in', 1) FROM texts WHERE starts_with(content, 'QNAM=')),
m AS (SELECT doc_id, page, content, regexp_replace(content, '(=\\s*)[A-Z0-9](?:[A-Z0-9\\s/\\-]{{0,79}}([A-Z0-9/\\-]))?', '\\1_\\2', 'g') AS masked FROM texts),
tokens AS (SELECT doc_id, page, unnest(regexp_extract_all(masked, '\\b([A-Z][A-Z0-9]{{1,7}})\\b', 1)) AS term FROM m),
parts AS (SELECT doc_id, page, unnest([regexp_extract(content, '([A-Z]+) in SUPP', 1), regexp_extract(content, ' in (SUPP[A-Z]+)', 1)]) AS term FROM texts WHERE contains(content, ' in SUPP')),
terms AS (
  SELECT doc_id, page, v || '=' || x AS term FROM pairs WHERE v NOT IN ('SMALL', 'LARGE')
  UNION SELECT doc_id, page, term FROM tokens WHERE term NOT IN ('SMALL', 'LARGE') AND NOT list_contains({_STOP}, term) UNION SELECT doc_id, page, term FROM parts WHERE term NOT IN ('SMALL', 'LARGE'))
SELECT doc_id, term, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, CAST(count(*) AS INTEGER) AS page_count FROM terms GROUP BY 1, 2""")
def term_index_pages(spark, sf_dir):
    return I.term_index(_structural(spark, sf_dir)[1]).select("doc_id", "term", F.col("page_string").alias("pages"), "page_count")


#: level * 10 + rank of the category, as folded: the largest counts.
_OCR_CLASS = """CASE WHEN regexp_matches(upper(content), '\\b' || lhs || '\\s*\\(') OR lhs IN {dataset} THEN 33 WHEN lhs IN {variable} THEN 32 WHEN starts_with(lhs, 'STA') OR ends_with(lhs, 'ED') THEN 22
  WHEN starts_with(lhs, 'SUPP') OR starts_with(lhs, 'FA') OR starts_with(lhs, 'PRO') THEN 23 WHEN regexp_matches(content, '\\bSUPP[A-Z]{{2,8}}\\b') THEN 11 ELSE 0 END""".format(dataset=_SQL_LIST(D.VOCABULARY["dataset"]), variable=_SQL_LIST(D.VOCABULARY["variable"]))


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL}, {_OCCURRENCES},
more AS (SELECT doc_id, page, seq, content, lhs, term, contains(term, '=') AS is_pair FROM occ UNION ALL SELECT doc_id, page, seq, content, 'QNAM', 'QNAM', false FROM texts WHERE starts_with(content, 'QNAM=')),
c AS (SELECT *, {_OCR_CLASS} AS class, lhs IN {_SQL_LIST(D.VOCABULARY["dataset"])} AS known,
  regexp_matches(upper(content), '\\b' || lhs || '\\s*[=:;,(]') OR regexp_matches(upper(content), '\\b' || lhs || '\\s+(?:WHEN|IF|THEN)\\b') OR len(regexp_extract_all(content, '\\S+')) <= 2 AS strong FROM more),
d AS (SELECT * REPLACE (CASE WHEN NOT is_pair AND class % 10 = 3 AND NOT known AND NOT starts_with(lhs, 'SUPP') AND NOT regexp_matches(upper(content), '\\b' || lhs || '\\s*[=(]') THEN 0 ELSE class END AS class) FROM c),
k AS (SELECT * FROM d WHERE is_pair OR strong OR NOT (class = 0 OR (class % 10 = 2 AND length(lhs) <= 3 AND NOT known) OR (class // 10 = 2 AND length(lhs) <= 2 AND NOT known) OR (class % 10 = 3 AND length(lhs) <= 2 AND NOT known))),
r AS (SELECT doc_id, term, string_agg(content, ' | ' ORDER BY s) AS raw_texts FROM (SELECT doc_id, term, content, min(seq) AS s FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT doc_id, term, list_sort(list(DISTINCT page)) AS pages, max(class) AS class FROM k GROUP BY 1, 2)
SELECT doc_id, term, array_to_string(pages, ',') AS page_string, CAST(len(pages) AS INTEGER) AS page_count, CASE class % 10 WHEN 3 THEN 'dataset_name' WHEN 2 THEN 'standard_variable' WHEN 1 THEN 'supp_variable' ELSE 'unknown' END AS category,
  CASE class // 10 WHEN 3 THEN 'exact' WHEN 2 THEN 'suffix_prefix' WHEN 1 THEN 'supp' ELSE 'none' END AS match_level, raw_texts FROM g JOIN r USING (doc_id, term)""")
def term_index_ocr(spark, sf_dir):
    texts = I.clean_annotations(D.annotations(spark, sf_dir))
    return I.term_index(I.occurrences(texts, _vocabulary(), "ocr")).select("doc_id", "term", "page_string", "page_count", "category", "match_level", F.array_join("raw_texts", " | ").alias("raw_texts"))


@query("""
WITH f AS (SELECT l_partkey % 97 AS term, l_suppkey % 25 AS page, 'raw ' || (l_orderkey % 5) AS raw, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
r AS (SELECT term, string_agg(raw, ' | ' ORDER BY s) AS raw_texts FROM (SELECT term, raw, min(seq) AS s FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT 'd' AS doc_id, CAST(term AS VARCHAR) AS term, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages, CAST(count(DISTINCT page) AS INTEGER) AS page_count, any_value(raw_texts) AS raw_texts FROM f JOIN r USING (term) GROUP BY term""")
def term_index_rows(spark, sf_dir):
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = D.read(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), (F.col("l_partkey") % 97).cast("string").alias("term"), (F.col("l_suppkey") % 25).alias("page"), F.concat(F.lit("raw "), (F.col("l_orderkey") % 5).cast("string")).alias("raw"), seq.alias("seq"), F.lit(0).alias("ord"), F.lit("unknown").alias("category"), F.lit("none").alias("match_level"))
    out = I.term_index(rows)
    return out.select("doc_id", "term", F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",").alias("pages"), "page_count", "raw_texts").withColumn("raw_texts", F.array_join("raw_texts", " | "))


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL}, t AS (SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(content, '\\b([A-Z]{{1,3}})\\b', 1)) AS domain FROM texts)
SELECT doc_id, domain, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, CAST(count(*) AS INTEGER) AS page_count FROM t WHERE domain IN ('AE', 'DM', 'VS', 'RED') GROUP BY 1, 2""")
def domain_index(spark, sf_dir):
    texts = I.clean_annotations(D.annotations(spark, sf_dir))
    none = spark.createDataFrame([], "doc_id string, page int, domain string")
    return I.domain_index(texts, none, ["AE", "DM", "VS", "RED"]).select("doc_id", "domain", F.col("page_string").alias("pages"), "page_count")


@query("""
WITH t AS (SELECT source AS doc_id, trim(text) AS t FROM documents),
w AS (SELECT doc_id, length(t) AS chars, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS words FROM t),
a AS (SELECT doc_id, round(avg(chars), 6) AS avg_chars, round(avg(words), 6) AS avg_words, round(avg(CASE WHEN chars > 50 THEN 1.0 ELSE 0.0 END), 6) AS text_share FROM w GROUP BY 1)
SELECT *, avg_chars < 180 OR avg_words < 25 OR text_share < 0.3 AS is_flattened FROM a""")
def text_layer_stats(spark, sf_dir):
    docs = D.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return I.text_layer(docs).select("doc_id", *[F.round(c, 6).alias(c) for c in ("avg_chars", "avg_words", "text_share")], "is_flattened")


@query(f"""
WITH {D.ANNOTATIONS_SQL}, {D.CLEAN_SQL}, c AS (SELECT doc_id, page, CASE WHEN CAST(doc_id AS INTEGER) % 3 = 0 AND page % 2 = 0 THEN '' ELSE content END AS content FROM cleaned),
a AS (SELECT doc_id, count(*) AS total_annots, count(*) FILTER (WHERE content <> '') AS readable_annots, count(*) FILTER (WHERE content <> '' AND NOT contains(upper(content), 'NOT SUBMITTED')) AS non_special_readable, count(DISTINCT page) FILTER (WHERE content <> '') AS pages_with_readable FROM c GROUP BY 1)
SELECT *, round(readable_annots / total_annots, 6) AS readable_ratio, CASE WHEN readable_annots = 0 THEN 'annotation_flattened' WHEN readable_annots / total_annots >= 0.8 AND non_special_readable >= 5 THEN 'msg2_readable' ELSE 'partial_weak_annotation' END AS type_key FROM a""")
def annotation_profile(spark, sf_dir):
    rows = D.annotations(spark, sf_dir)
    hidden = (F.col("doc_id").cast("int") % 3 == 0) & (F.col("page") % 2 == 0)
    return I.annotation_profile(rows.withColumn("content", F.when(~hidden, F.col("content")))).withColumn("readable_ratio", F.round("readable_ratio", 6))


@query(f"""WITH {D.ANNOTATIONS_SQL}, c AS (SELECT doc_id, CASE WHEN CAST(doc_id AS INTEGER) % 3 = 0 THEN 'flat' WHEN CAST(doc_id AS INTEGER) % 3 = 1 AND page % 2 = 0 THEN 'weak' ELSE 'whole' END AS kind FROM annotations),
d AS (SELECT doc_id, CASE WHEN CAST(doc_id AS INTEGER) % 3 = 0 THEN 'annotation_flattened' WHEN count(*) FILTER (WHERE kind = 'weak') * 5 > count(*) THEN 'partial_weak_annotation' ELSE 'msg2_readable' END AS type_key FROM c GROUP BY 1)
SELECT doc_id, type_key, CASE type_key WHEN 'annotation_flattened' THEN 'ocr' WHEN 'msg2_readable' THEN 'structural' ELSE 'structural,ocr' END AS parsers FROM d""")
def parser_routing(spark, sf_dir):
    third = F.col("doc_id").cast("int") % 3
    hidden = (third == 0) | ((third == 1) & (F.col("page") % 2 == 0))
    kinds = I.annotation_profile(D.annotations(spark, sf_dir).withColumn("content", F.when(~hidden, F.col("content"))))
    return kinds.select("doc_id", "type_key", F.array_join(I.recommended_parsers(F.col("type_key")), ",").alias("parsers"))


@query(f"WITH {D.ANNOTATIONS_SQL}, c AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN '' ELSE content END AS content FROM annotations) SELECT doc_id, count(*) FILTER (WHERE content <> '') AS with_content, count(*) AS annotations, round(count(*) FILTER (WHERE content <> '') / count(*), 6) AS coverage FROM c WHERE page <= 10 GROUP BY 1")
def annotation_coverage(spark, sf_dir):
    rows = D.annotations(spark, sf_dir)
    return I.annotation_coverage(rows.withColumn("content", F.when(F.col("page") % 3 != 0, F.col("content")))).withColumn("coverage", F.round("coverage", 6))


# --- two parsers

_SIDES_SQL = """
l AS (SELECT upper('t' || (o_custkey % 900) || CASE WHEN o_custkey % 90 = 0 THEN '' ELSE '' END) AS v, o_orderkey AS seq, [CAST(o_orderkey % 3 AS INTEGER), CAST(o_custkey % 3 AS INTEGER)] AS pages, CASE WHEN o_custkey % 4 = 0 THEN 'not_submitted' ELSE 'unknown' END AS category, 'a' || (o_orderkey % 2) AS raw FROM orders WHERE o_custkey % 5 <> 0),
r AS (SELECT upper('T' || (o_custkey % 900)) AS v, o_orderkey AS seq, list_distinct([CAST(o_orderkey % 3 AS INTEGER), CAST(o_custkey % 3 AS INTEGER)]) || CASE WHEN o_custkey % 8 = 0 THEN [CAST(o_custkey % 3 AS INTEGER)] ELSE [] END AS pages, 'unknown' AS category, 'a' || (o_custkey % 2) AS raw FROM orders WHERE o_custkey % 7 <> 0),
ll AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY v ORDER BY seq DESC) = 1), rl AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY v ORDER BY seq DESC) = 1),
j AS (SELECT coalesce(ll.v, rl.v) AS Variable, ll.v IS NOT NULL AS hl, rl.v IS NOT NULL AS hr, coalesce(ll.pages, []) AS lp, coalesce(rl.pages, []) AS rp, ll.category AS lc, ll.raw AS lr, rl.raw AS rr, coalesce(ll.category, '') = 'not_submitted' AS bag FROM ll FULL JOIN rl ON ll.v = rl.v),
k AS (SELECT *, list_sort(list_distinct(lp)) = list_sort(list_distinct(rp)) AS same_set, list_sort(lp) = list_sort(rp) AS same_bag FROM j),
q AS (SELECT *, CASE WHEN hl AND hr AND same_set AND (NOT bag OR same_bag) THEN 'consensus' WHEN hl AND hr THEN 'page_mismatch' WHEN hl THEN 'pymupdf_only' ELSE 'opencv_only' END AS status,
  array_to_string(CASE WHEN hl AND hr THEN list_sort(list_distinct(lp || rp)) WHEN hl THEN list_sort(lp) ELSE list_sort(rp) END, ',') AS PageString,
  CAST(CASE WHEN hl AND hr THEN len(list_distinct(lp || rp)) WHEN hl THEN len(lp) ELSE len(rp) END AS INTEGER) AS PageCount,
  CASE WHEN hl THEN lc ELSE 'unknown' END AS Category, CASE WHEN hl AND hr AND lr <> rr THEN lr || ' | ' || rr WHEN hl THEN lr ELSE rr END AS RawTexts,
  array_to_string(list_sort(lp), ',') AS PyMuPDF_Pages, array_to_string(list_sort(rp), ',') AS OpenCV_Pages FROM k)"""


def _sides(spark, sf_dir) -> R.Reconciliation:
    o = D.read(spark, sf_dir, "orders")
    both = F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int"))
    name = lambda p: F.concat(F.lit(p), (F.col("o_custkey") % 900).cast("string")).alias("variable")
    raw = lambda c: F.array(F.concat(F.lit("a"), (F.col(c) % 2).cast("string"))).alias("raw_texts")
    left = o.where("o_custkey % 5 <> 0").select(name("t"), F.col("o_orderkey").alias("seq"), both.alias("pages"), F.when(F.col("o_custkey") % 4 == 0, "not_submitted").otherwise("unknown").alias("category"), raw("o_orderkey"))
    more = F.when(F.col("o_custkey") % 8 == 0, F.array((F.col("o_custkey") % 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    right = o.where("o_custkey % 7 <> 0").select(name("T"), F.col("o_orderkey").alias("seq"), F.concat(F.array_distinct(both), more).alias("pages"), F.lit("unknown").alias("category"), raw("o_custkey"))
    return R.reconcile(left, right)


@query(f"WITH {_SIDES_SQL} SELECT Variable, PageString, PageCount, PyMuPDF_Pages, OpenCV_Pages, Category, RawTexts FROM q WHERE status = 'consensus'")
def parser_consensus(spark, sf_dir):
    return _sides(spark, sf_dir).consensus


@query(f"""WITH {_SIDES_SQL} SELECT Variable, PageString, PageCount, PyMuPDF_Pages, OpenCV_Pages, Category, RawTexts, CAST(len(lp) AS INTEGER) AS PyMuPDF_PageCount, CAST(len(rp) AS INTEGER) AS OpenCV_PageCount,
  CASE WHEN bag AND same_set THEN 'occurrence_count_mismatch' WHEN bag AND NOT same_bag THEN 'page_or_occurrence_mismatch' ELSE 'page_set_mismatch' END AS MismatchReason FROM q WHERE status = 'page_mismatch'""")
def parser_mismatch_reason(spark, sf_dir):
    return _sides(spark, sf_dir).page_mismatch


@query(f"WITH {_SIDES_SQL} SELECT Variable, PageString AS Pages, PageCount, Category, RawTexts FROM q WHERE status = 'pymupdf_only'")
def parser_only_left(spark, sf_dir):
    return _sides(spark, sf_dir).only("pymupdf")


@query(f"WITH {_SIDES_SQL} SELECT Variable, PageString AS Pages, PageCount, Category, RawTexts FROM q WHERE status = 'opencv_only'")
def parser_only_right(spark, sf_dir):
    return _sides(spark, sf_dir).only("opencv")


@query(f"WITH {_SIDES_SQL} SELECT count(*) FILTER (WHERE status = 'consensus') AS consensus_count, count(*) FILTER (WHERE status = 'page_mismatch') AS page_mismatch_count, count(*) FILTER (WHERE status = 'pymupdf_only') AS pymupdf_only_count, count(*) FILTER (WHERE status = 'opencv_only') AS opencv_only_count, count(*) FILTER (WHERE hl) AS total_pymupdf, count(*) FILTER (WHERE hr) AS total_opencv FROM q")
def parser_summary(spark, sf_dir):
    return _sides(spark, sf_dir).summary


@query("""WITH a AS (SELECT DISTINCT upper(p_brand || p_size % 7) AS n FROM part), b AS (SELECT DISTINCT upper(p_brand || p_size % 11) AS n FROM part)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (n)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (n)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (n)) AS right_only""")
def parser_name_overlap(spark, sf_dir):
    p = D.read(spark, sf_dir, "part")
    side = lambda n: p.select(F.concat("p_brand", (F.col("p_size") % n).cast("string")).alias("variable"))
    return R.name_overlap(side(7), side(11))


# --- boxes and readings


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 50 AS x, l_suppkey % 50 AS y, CAST(24 + l_quantity AS BIGINT) AS w, CAST(10 + l_linenumber * 4 AS BIGINT) AS h, l_partkey, l_suppkey FROM lineitem),
p AS (SELECT a.k, a.n AS an, b.n AS bn, a.l_partkey AS ap, b.l_partkey AS bp, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM b a JOIN b b ON a.k = b.k AND a.n < b.n)
SELECT k, an, bn, ap, bp, round(CAST(i AS DOUBLE) / (s - i), 6) AS iou FROM p""")
def iou_pairs(spark, sf_dir):
    rect = F.struct((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"), (24 + F.col("l_quantity")).cast("long").alias("w"), (10 + F.col("l_linenumber") * 4).cast("long").alias("h"))
    b = D.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rect.alias("rect"))
    pairs = b.alias("a").join(b.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.select(F.col("a.l_orderkey").alias("k"), F.col("a.l_linenumber").alias("an"), F.col("b.l_linenumber").alias("bn"), F.col("a.l_partkey").alias("ap"), F.col("b.l_partkey").alias("bp"), F.round(B.iou(F.col("a.rect"), F.col("b.rect")), 6).alias("iou"))


_ACCEPT_SQL = f"""
WITH {D.BOXES_SQL}, m AS (SELECT *, 900000 AS page_area, 0.5e0 * w * h + 200 AS area, 4 AS corners, border_density / 4 AS dark_ratio FROM boxes),
c AS (SELECT *, CASE WHEN source = 'color' THEN 0.50e0 * colored_ratio + 0.35e0 * fill_ratio + 0.15e0 * least(border_density * 8.0e0, 1.0e0) ELSE 0.65e0 * least(border_density * 6.0e0, 1.0e0) + 0.20e0 * least(fill_ratio * 1.8e0, 1.0e0) + 0.15e0 * least(dark_ratio * 10.0e0, 1.0e0) END AS conf FROM m),
k AS (SELECT * FROM c WHERE area >= 120 AND w >= 24 AND h >= 10 AND w * h <= page_area * 0.18 AND NOT (w <= 26 AND h <= 26 AND area < 320) AND greatest(w, h) / least(w, h) <= 35 AND
  CASE WHEN source = 'color' THEN fill_ratio >= 0.35 AND colored_ratio >= 0.40 AND conf >= 0.42 ELSE border_density >= 0.08 AND fill_ratio >= 0.08 AND dark_ratio >= 0.015 AND conf >= 0.34 END)"""


def _accepted(spark, sf_dir):
    b = D.boxes(spark, sf_dir)
    measured = b.select("*", F.lit(900000).alias("page_area"), (F.lit(0.5) * F.col("rect.w") * F.col("rect.h") + 200).alias("area"), F.lit(4).alias("corners"), (F.col("border_density") / 4).alias("dark_ratio"))
    return B.accept(measured)


@query(_ACCEPT_SQL + "SELECT page, box_seq, CASE WHEN source = 'color' THEN CASE WHEN border_density >= 0.12 THEN 'solid_border' WHEN border_density >= 0.05 THEN 'dashed_border' ELSE 'colored_bg' END WHEN border_density >= 0.12 THEN 'border_only' ELSE 'dashed_border' END AS type, CAST(round(CAST(CAST(conf AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE) AS confidence FROM k")
def box_accept(spark, sf_dir):
    return _accepted(spark, sf_dir).select("page", "box_seq", "type", "confidence")


@query(_ACCEPT_SQL + "SELECT page, count(*) AS boxes, count(*) FILTER (WHERE source = 'color' AND border_density >= 0.12) AS solid_border, count(*) FILTER (WHERE (source = 'color' AND border_density >= 0.05 AND border_density < 0.12) OR (source <> 'color' AND border_density < 0.12)) AS dashed_border, count(*) FILTER (WHERE source = 'color' AND border_density < 0.05) AS colored_bg, count(*) FILTER (WHERE source <> 'color' AND border_density >= 0.12) AS border_only FROM k GROUP BY 1")
def boxes_per_page(spark, sf_dir):
    return B.per_page(_accepted(spark, sf_dir), ["page"])


@query(f"WITH {D.BOXES_SQL} SELECT page, box_seq FROM boxes QUALIFY row_number() OVER (PARTITION BY page ORDER BY fill_ratio DESC, box_seq) <= 38")
def box_topn(spark, sf_dir):
    return B.first_of(D.boxes(spark, sf_dir), ["page"], [F.desc("fill_ratio"), F.col("box_seq")], 38).select("page", "box_seq")


@query(f"WITH {D.BOXES_SQL} SELECT page, box_seq FROM boxes WHERE fill_ratio < 0.5 AND NOT (h <= 14 AND w >= 180 AND w / greatest(1, h) >= 9.5 AND border_density < 0.30) QUALIFY row_number() OVER (PARTITION BY page ORDER BY box_seq) <= 8")
def budget_rows(spark, sf_dir):
    return B.first_of(B.readable(D.boxes(spark, sf_dir)).where("fill_ratio < 0.5"), ["page"], [F.col("box_seq")], B.EASYOCR_BUDGET).select("page", "box_seq")


@query(f"""
WITH {D.BOXES_SQL}, many AS (SELECT page FROM boxes WHERE source = 'color' AND fill_ratio > 0.85 GROUP BY 1 HAVING count(*) >= 22),
edges AS (SELECT page, box_seq, source FROM boxes WHERE source = 'border' AND page NOT IN (SELECT page FROM many) QUALIFY row_number() OVER (PARTITION BY page ORDER BY w * h DESC, box_seq) <= 180)
SELECT page, box_seq, source FROM boxes WHERE source = 'color' UNION ALL SELECT * FROM edges""")
def contours_tried(spark, sf_dir):
    rows = D.boxes(spark, sf_dir).withColumn("area", F.col("rect.w") * F.col("rect.h"))
    return G.contours(rows, rows.where("fill_ratio > 0.85"), ["page"]).select("page", "box_seq", "source")


@query(f"""
WITH RECURSIVE {D.BOXES_SQL}, o AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY fill_ratio DESC, box_seq) AS INTEGER) AS place, box_seq, fill_ratio AS confidence, {{{{'x': x, 'y': y, 'w': w, 'h': h}}}} AS rect FROM boxes),
f AS (
  SELECT page, 1 AS place, [{{{{'place': place, 'rect': rect}}}}] AS kept FROM o WHERE place = 1
  UNION ALL SELECT o.page, o.place, CASE WHEN len(list_filter(f.kept, lambda k: _I / CAST(k.rect.w * k.rect.h + o.rect.w * o.rect.h - _I AS DOUBLE) > 0.45)) > 0 THEN f.kept ELSE list_append(f.kept, {{{{'place': o.place, 'rect': o.rect}}}}) END
  FROM f JOIN o ON o.page = f.page AND o.place = f.place + 1),
last AS (SELECT page, kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY place DESC) = 1),
k AS (SELECT page, unnest(kept[1:38]) AS k, unnest(range(1, least(len(kept), 38) + 1)) AS kept_seq FROM last)
SELECT k.page, CAST(kept_seq AS INTEGER) AS kept_seq, o.box_seq, o.confidence FROM k JOIN o ON o.page = k.page AND o.place = k.k.place""".replace("{{", "{").replace("}}", "}").replace("_I", "(greatest(0, least(k.rect.x + k.rect.w, o.rect.x + o.rect.w) - greatest(k.rect.x, o.rect.x)) * greatest(0, least(k.rect.y + k.rect.h, o.rect.y + o.rect.h) - greatest(k.rect.y, o.rect.y)))"))
def nms_boxes(spark, sf_dir):
    return B.suppress(D.boxes(spark, sf_dir).withColumn("confidence", F.col("fill_ratio")), ["page"]).select("page", "kept_seq", "box_seq", "confidence")


_UPPER = r"\b[A-Z][A-Z0-9]{1,7}"
_SCORE_SQL = rf"""
n AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS t FROM readings),
f AS (SELECT *, len(regexp_extract_all(t, '{_UPPER}\b')) AS uppers, len(regexp_extract_all(t, '{_UPPER}\s*(?:\(|=)')) AS labels, len(regexp_extract_all(t, '{_UPPER}(?:/[A-Z][A-Z0-9]{{1,7}})*\s*=')) AS assigns, regexp_matches(t, '\bSUPP[A-Z]{{2,8}}\b') AS supp,
  len(regexp_extract_all(t, '(?i)\b(?:NOT\s+SUBMITTED|NOTSUBMITTED)\b')) AS ns, len(regexp_extract_all(t, '{_UPPER}/[A-Z][A-Z0-9]{{1,7}}\b')) AS slashes, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lowers, len(string_split_regex(t, '\s+')) AS words FROM n),
s AS (SELECT *, CASE WHEN letters > 0 THEN lowers / letters ELSE 0 END AS ratio FROM f),
scored AS (SELECT *, CASE WHEN t = '' THEN -10.0e0 ELSE round(uppers * 2.0e0 + labels * 4.0e0 + assigns * 4.5e0 + CASE WHEN supp THEN 3.0e0 ELSE 0 END + ns * 5.0e0 + slashes * 2.0e0 - ratio * 2.5e0 - CASE WHEN length(t) > 220 THEN least(6.0e0, (length(t) - 220) / 35.0e0) ELSE 0 END - CASE WHEN words > 22 THEN least(5.0e0, (words - 22) / 5.0e0) ELSE 0 END, 2) END AS score FROM s)"""


@query(f"WITH {D.READINGS_SQL}, {_SCORE_SQL} SELECT cand_seq, score FROM scored")
def ocr_score(spark, sf_dir):
    return D.readings(spark, sf_dir).select("cand_seq", O.score(F.col("text")).alias("score"))


@query(f"WITH {D.READINGS_SQL}, {_SCORE_SQL} SELECT cand_seq, t <> '' AND score >= 1.5 AND (ns > 0 OR supp OR assigns > 0 OR regexp_matches(t, '{_UPPER}\\s*\\(') OR (uppers >= 2 AND ratio <= 0.45) OR (uppers = 1 AND ratio <= 0.2 AND length(t) <= 14)) AS passes FROM scored")
def ocr_gate(spark, sf_dir):
    t = F.col("text")
    return D.readings(spark, sf_dir).select("cand_seq", O.gate(t, O.score(t)).alias("passes"))


_KNOWN = ["QNAM", "VSOTEST", "CD"]
_QUALITY_SQL = rf"""
tokens AS (SELECT cand_seq, unnest(regexp_extract_all(t, '\b([A-Z][A-Z0-9]{{1,7}})\s*=', 1)) AS token FROM n),
sums AS (SELECT cand_seq, sum(CASE WHEN token IN ('QNAM', 'VSOTEST', 'CD') THEN 0.2e0 WHEN length(token) <= 4 THEN -0.9e0 ELSE -0.4e0 END) AS s FROM tokens GROUP BY 1),
quality AS (SELECT n.cand_seq, CASE WHEN t = '' THEN -5.0e0 ELSE CASE WHEN regexp_matches(t, '\bQNAM\s*=') THEN 1.0e0 ELSE 0 END - CASE WHEN regexp_matches(t, '\b[A-Z]{{2,6}}\s+[A-Z]{{2,8}}\s*=') THEN 1.2e0 ELSE 0 END - CASE WHEN regexp_matches(t, '\b(?:QONAM|ONAM|INAM|JNAM|QDNAM)\s*=') THEN 1.0e0 ELSE 0 END + coalesce(s, 0) END AS adj FROM n LEFT JOIN sums USING (cand_seq))"""


@query(f"WITH {D.READINGS_SQL}, {_SCORE_SQL}, {_QUALITY_SQL} SELECT cand_seq, round(adj, 6) AS adj FROM quality")
def ocr_quality(spark, sf_dir):
    return D.readings(spark, sf_dir).select("cand_seq", F.round(O.quality(F.col("text"), _KNOWN), 6).alias("adj"))


@query(f"WITH {D.READINGS_SQL}, {_SCORE_SQL}, short AS (SELECT DISTINCT cand_seq FROM (SELECT cand_seq, unnest(regexp_extract_all(t, '\\b([A-Z][A-Z0-9]{{1,7}})\\s*=', 1)) AS token FROM n) WHERE length(token) <= 4 AND token NOT IN ('QNAM', 'VSOTEST', 'CD')) SELECT n.cand_seq, t <> '' AND (short.cand_seq IS NOT NULL OR regexp_matches(t, '\\b[A-Z]{{2,6}}\\s+[A-Z]{{2,8}}\\s*=') OR regexp_matches(t, '\\b(?:QONAM|ONAM|INAM|JNAM|QDNAM)\\s*=') OR (regexp_matches(t, '\\bSUPP[A-Z]{{2,8}}\\b') AND NOT regexp_matches(t, '\\bQNAM\\s*='))) AS second FROM n LEFT JOIN short USING (cand_seq)")
def ocr_second_pass(spark, sf_dir):
    return D.readings(spark, sf_dir).select("cand_seq", O.needs_second_pass(F.col("text"), _KNOWN).alias("second"))


@query(f"""WITH {D.READINGS_SQL}, {_SCORE_SQL}, {_QUALITY_SQL},
r AS (SELECT box, cand_seq, text, score, conf, adj, row_number() OVER (PARTITION BY box ORDER BY score DESC, length(text), cand_seq) AS rank, max(score) OVER (PARTITION BY box) AS top FROM scored JOIN quality USING (cand_seq)),
k AS (SELECT * FROM r WHERE rank = 1 OR (rank = 2 AND top - score <= 1.0))
SELECT box, cand_seq, text, round(score * 10.0e0 + conf + adj, 4) AS total FROM k QUALIFY row_number() OVER (PARTITION BY box ORDER BY round(score * 10.0e0 + conf + adj, 9) DESC, score DESC, conf DESC, length(text), rank) = 1""")
def best_ocr_candidate(spark, sf_dir):
    rows = D.readings(spark, sf_dir).withColumn("score", O.score(F.col("text"))).withColumn("adj", F.round(O.quality(F.col("text"), _KNOWN), 9))
    return B.choose_reading(B.rank_quick(rows, ["box"]), ["box"]).select("box", "cand_seq", "text", F.round("total", 4).alias("total"))


@query(f"""WITH {D.READINGS_SQL}, t AS (SELECT cand_seq, text, 'VSTESTCD=' || upper(text) AS other FROM readings), c AS (SELECT *, replace(other, 'AE', 'QN') AS chosen FROM t)
SELECT cand_seq, chosen, concat_ws(' ## ', trim(chosen), trim(text), CASE WHEN other <> chosen THEN trim(other) END) AS analysed FROM c""")
def ocr_arbitration(spark, sf_dir):
    t, other = F.col("text"), F.concat(F.lit("VSTESTCD="), F.upper("text"))
    easy = O.pick_easyocr(t, other, F.col("conf"), _KNOWN)
    best = O.pick_trocr(easy, F.regexp_replace(other, "AE", "QN"), _KNOWN)
    return D.readings(spark, sf_dir).select("cand_seq", best.alias("chosen"), F.array_join(O.analysis_texts(best, t, other), " ## ").alias("analysed"))


@query(f"WITH {D.READINGS_SQL} SELECT box, round(coalesce(avg(CASE WHEN conf - 0.3e0 >= 0 THEN conf - 0.3e0 END), 0), 6) AS mean_conf FROM readings GROUP BY 1")
def mean_confidence(spark, sf_dir):
    return B.mean_confidence(D.readings(spark, sf_dir).withColumn("conf", F.col("conf") - 0.3), ["box"]).withColumn("mean_conf", F.round("mean_conf", 6))


_TOKENS_SQL = "t AS (SELECT DISTINCT upper(substr(p_name, 1, 4)) || (p_size % 30) AS token FROM part), v AS (SELECT DISTINCT upper(substr(p_name, 1, 4)) || (p_size % 3 * 10) || CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE '' END AS term FROM part)"


def _tokens(spark, sf_dir):
    p = D.read(spark, sf_dir, "part")
    start = F.upper(F.substring("p_name", 1, 4))
    tokens = p.select(F.concat(start, (F.col("p_size") % 30).cast("string")).alias("token"))
    terms = p.select(F.concat(start, (F.col("p_size") % 3 * 10).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "X").otherwise("")).alias("term"))
    return tokens, terms


@query(f"WITH {_TOKENS_SQL}, m AS (SELECT token, term FROM t JOIN v ON abs(length(token) - length(term)) <= 1 AND levenshtein(token, term) <= 1) SELECT token, min(term) AS nearest FROM m GROUP BY 1 HAVING count(*) = 1")
def nearest_unique_term(spark, sf_dir):
    return C.nearest_unique(*_tokens(spark, sf_dir))


@query(f"WITH {_TOKENS_SQL}, c AS (SELECT substr(token, 2) AS token FROM t UNION SELECT token FROM t) SELECT token, string_agg(term, ',' ORDER BY term) AS terms FROM c JOIN v ON substr(term, 2) = token GROUP BY 1")
def leading_char_fix(spark, sf_dir):
    tokens, terms = _tokens(spark, sf_dir)
    lost = tokens.union(tokens.select(F.expr("substring(token, 2)")))
    return C.leading_character(lost, terms).select("token", F.array_join("full", ",").alias("terms"))


#: Beginnings that lost a letter or were split, and what the rules make of each.
_HEADS = {"ACAT=CROHNS": "FACAT=CROHNS", "SORRES/VSORRESU when VSTESTCD=": "VSORRES/VSORRESU when VSTESTCD=", "STERM when DSDECOD=": "DSTERM when DSDECOD=", "ON AM=": "QNAM=", "UOCCUR=Y FORMER ": "SUOCCUR=Y FORMER "}


@query(f"""WITH t AS (SELECT p_partkey, upper(p_brand) || CASE WHEN p_size % 2 = 0 THEN ' in SUPPAE' ELSE '' END AS tail, CAST(p_partkey % 5 + 1 AS INTEGER) AS i FROM part)
SELECT p_partkey, {list(_HEADS)}[i] || tail AS text, {list(_HEADS.values())}[i] || tail AS repaired FROM t""")
def repair_text(spark, sf_dir):
    variables = ["FACAT", "FAOBJ", "FAORRES", "QSCAT", "VSORRES", "VSORRESU", "RSSTAT", "DSTERM", "DSDECOD", "SUOCCUR", "SUSTRTPT", "QNAM", "VSTESTCD"]
    heads = F.get(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 5).cast("int"))
    text = F.concat(heads, F.upper("p_brand"), F.when(F.col("p_size") % 2 == 0, " in SUPPAE").otherwise(""))
    return D.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), repair(text, variables, ["DS", "VS"]).alias("repaired"))


# --- reports

_REPORT_SQL = """
i AS (SELECT 'N' || p_partkey AS n, p_brand AS pages, CAST(p_size AS INTEGER) AS c, ['dataset_name', 'unknown', 'not_submitted', 'standard_variable'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS category FROM part),
rows AS (SELECT CASE category WHEN 'not_submitted' THEN 'NOT SUBMITTED' WHEN 'dataset_name' THEN 'Domain' ELSE 'Variable' END AS Classification, n AS Name, pages AS Pages, c AS PageCount, category AS Category, n || ' | r' AS RawTexts FROM i),
alls AS (SELECT * FROM rows UNION ALL SELECT 'Domain', 'N' || s_suppkey, '1', 1, 'dataset_name', '' FROM supplier WHERE 'N' || s_suppkey NOT IN (SELECT Name FROM rows WHERE Classification = 'Domain'))"""


def _report(spark, sf_dir):
    p = D.read(spark, sf_dir, "part")
    name = F.concat(F.lit("N"), F.col("p_partkey").cast("string"))
    category = F.get(F.array(*map(F.lit, ["dataset_name", "unknown", "not_submitted", "standard_variable"])), (F.col("p_partkey") % 4).cast("int"))
    index = p.select(name.alias("variable"), F.col("p_brand").alias("page_string"), F.col("p_size").cast("int").alias("page_count"), category.alias("category"), F.array(name, F.lit("r")).alias("raw_texts"))
    domains = D.read(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("domain"), F.lit("1").alias("page_string"), F.lit(1).alias("page_count"))
    return index, domains


@query(f"WITH {_REPORT_SQL} SELECT * FROM alls ORDER BY list_position(['Domain', 'Variable', 'NOT SUBMITTED'], Classification), Name LIMIT {report.TABLE_ROWS}")
def report_first_rows(spark, sf_dir):
    return report.first_rows(report.result(*_report(spark, sf_dir)))


@query(f"WITH {_REPORT_SQL} SELECT *, CAST(row_number() OVER (ORDER BY list_position(['Domain', 'Variable', 'NOT SUBMITTED'], Classification), Name) AS INTEGER) AS place FROM alls")
def report_union_sorted(spark, sf_dir):
    rows = report.result(*_report(spark, sf_dir))
    # the place is asked for here to show the order, which the report's own sort gives without a window
    return rows.withColumn("place", F.row_number().over(Window.orderBy(report.class_rank(F.col("Classification")), "Name")))


@query(f"WITH {_REPORT_SQL} SELECT * FROM rows WHERE Category = 'unknown' AND contains(lower(Name), lower('n1'))")
def unmatched_search(spark, sf_dir):
    return report.search(report.unmatched(report.result(_report(spark, sf_dir)[0])), "Name", "n1")


@query(f"WITH {_REPORT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE Category = 'not_submitted') AS not_submitted, count(*) FILTER (WHERE Category = 'unknown') AS unknown FROM alls")
def report_metrics(spark, sf_dir):
    return report.result_metrics(report.result(*_report(spark, sf_dir)))


@query(f"WITH {D.ANNOTATIONS_SQL} SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN '' ELSE content END AS content FROM annotations) WHERE content = '' GROUP BY 1, 2")
def annotations_without_text(spark, sf_dir):
    rows = D.annotations(spark, sf_dir)
    return I.need_ocr(rows.withColumn("content", F.when(F.col("page") % 3 != 0, F.col("content")))).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
