"""Domain tables made from the plain tables by the same rules in Spark and in SQL, so that queries over them can be held against a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- contract and index: page sets by order

SETS_SQL = """
sets AS (
  SELECT l_orderkey AS k, o_orderpriority AS dataset,
    coalesce(list_sort(list_distinct(list(CAST(l_suppkey % 7 AS INTEGER)) FILTER (WHERE l_linenumber <= 3))), []) AS xml,
    coalesce(list_sort(list_distinct(list(CAST(l_suppkey % 7 AS INTEGER)) FILTER (WHERE l_linenumber >= 3))), []) AS pdf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, dataset, xml, pdf: two page sets per order."""
    page = (F.col("l_suppkey") % 7).cast("int")
    pages = lambda keep: F.array_sort(F.collect_set(F.when(keep, page)))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pages(F.col("l_linenumber") <= 3).alias("xml"), pages(F.col("l_linenumber") >= 3).alias("pdf"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("k"), F.col("o_orderpriority").alias("dataset"), "xml", "pdf")


NAME_SQL = """CASE k % 6 WHEN 1 THEN 'V' || k || '.DS.Q' || k || '.X' WHEN 2 THEN 'V' || k || '.DS.Q' || k || '.EQ.1.5'
  WHEN 3 THEN 'V' || k || '.A.QA.' || k || '.B.QB.' || k WHEN 4 THEN 'V' || k || '.B' ELSE 'v' || k END"""

CONTRACT_SQL = SETS_SQL + f""",
contract AS (SELECT k AS pos, dataset, {NAME_SQL} AS variable, xml AS pages FROM sets),
term_rows AS (
  SELECT k * 4 AS seq, 'V' || k AS variable, pdf AS pages, CASE WHEN k % 10 = 0 THEN 'dataset_name' ELSE 'standard_variable' END AS category, 'raw ' || k AS raw FROM sets WHERE k % 6 <> 5
  UNION ALL SELECT k * 4 + 1, 'Q' || k || '=X', xml, 'unknown', 'pair ' || k FROM sets WHERE k % 6 = 1
  UNION ALL SELECT k * 4 + 2, 'qb=' || k, xml, '', 'crit ' || k FROM sets WHERE k % 6 = 3
  UNION ALL SELECT k * 4 + 3, 'V' || k || '.B', xml, 'unknown', 'low ' || k FROM sets WHERE k % 6 = 4
  UNION ALL SELECT k * 4 + 1, 'E' || (k % 50) || '=1', pdf, 'unknown', 'extra ' || (k % 3) FROM sets WHERE k % 6 = 5),
domain_rows AS (SELECT dataset AS domain, pdf AS pages FROM sets WHERE k % 7 = 0 AND dataset <> '1-URGENT' UNION ALL SELECT r_name, [CAST(r_regionkey AS INTEGER)] FROM region)"""


def contract_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contract(pos, dataset, variable, pages), index(seq, variable, pages, category, raw_texts), domains(domain, pages)."""
    s, k = page_sets(spark, sf_dir), F.col("k").cast("string")
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    kind = F.col("k") % 6
    name = F.when(kind == 1, cat("V", k, ".DS.Q", k, ".X")).when(kind == 2, cat("V", k, ".DS.Q", k, ".EQ.1.5")).when(kind == 3, cat("V", k, ".A.QA.", k, ".B.QB.", k)).when(kind == 4, cat("V", k, ".B")).otherwise(cat("v", k))
    contract = s.select(F.col("k").alias("pos"), "dataset", name.alias("variable"), F.col("xml").alias("pages"))

    def rows(keep, at, variable, pages, category, raw):
        return s.where(keep).select((F.col("k") * 4 + at).alias("seq"), variable.alias("variable"), F.col(pages).alias("pages"), category.alias("category"), F.array(raw).alias("raw_texts"))

    index = (
        rows(kind != 5, 0, cat("V", k), "pdf", F.when(F.col("k") % 10 == 0, "dataset_name").otherwise("standard_variable"), cat("raw ", k))
        .union(rows(kind == 1, 1, cat("Q", k, "=X"), "xml", F.lit("unknown"), cat("pair ", k)))
        .union(rows(kind == 3, 2, cat("qb=", k), "xml", F.lit(""), cat("crit ", k)))
        .union(rows(kind == 4, 3, cat("V", k, ".B"), "xml", F.lit("unknown"), cat("low ", k)))
        .union(rows(kind == 5, 1, cat("E", (F.col("k") % 50).cast("string"), "=1"), "pdf", F.lit("unknown"), cat("extra ", (F.col("k") % 3).cast("string"))))
    )
    domains = s.where((F.col("k") % 7 == 0) & (F.col("dataset") != "1-URGENT")).select(F.col("dataset").alias("domain"), F.col("pdf").alias("pages")).union(read(spark, sf_dir, "region").select("r_name", F.array(F.col("r_regionkey").cast("int"))))
    return contract, index, domains


# --- documents: a Define-XML and annotations of each of 50, with the same names in all of them

DOCUMENTS_SQL = """
items AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS doc_id, 'P' || (p_partkey // 50) AS name, p_brand AS dataset, p_size AS s, p_partkey AS k,
  CASE WHEN p_size % 2 = 0 THEN list_sort(list_distinct([p_size, 7])) ELSE [p_size] END AS xml,
  CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END AS seen FROM part),
contract AS (SELECT * FROM items WHERE s % 5 <> 0),
vars AS (SELECT doc_id, name, dataset, s, CASE WHEN s % 2 = 0 THEN list_sort(list_distinct([seen, 7])) ELSE [seen] END AS pages FROM items WHERE s % 7 <> 0),
bags AS (SELECT doc_id, s AS page FROM items WHERE s % 11 = 0)"""


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Define-XML texts (doc_id, value), annotations (doc_id, page, seq, content) and pages (doc_id, page, text)."""
    s, k = F.col("p_size"), F.col("p_partkey")
    doc, name = (k % 50).cast("string").alias("doc_id"), F.concat(F.lit("P"), F.floor(k / 50).cast("string"))
    part = read(spark, sf_dir, "part")
    refs = F.when(s % 5 == 0, "").otherwise(F.concat(F.lit('<d:Origin Label="a > b"><d:PDFPageRef PageRefs="'), s.cast("string"), F.when(s % 2 == 0, " 7").otherwise(""), F.lit('"/></d:Origin>')))
    item = F.concat(F.lit('<ItemDef Label="x > y" OID="IT.'), F.col("p_brand"), F.lit("."), name, F.lit('" Name="'), name, F.lit('">'), refs, F.lit("</ItemDef>"))
    xml = part.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, item.alias("item")))), lambda r: r["item"]), "\n").alias("items"))
    xml = xml.select("doc_id", F.concat(F.lit('<ODM xmlns:d="urn:d"><Study>'), "items", F.lit("</Study></ODM>")).alias("value"))
    seen = F.when(s % 3 == 0, s + 1).otherwise(s).cast("int")
    pages = F.explode(F.when(s % 2 == 0, F.array(seen, F.lit(7))).otherwise(F.array(seen)))
    notes = part.where(s % 7 != 0).select(doc, pages.alias("page"), k.alias("seq"), F.concat(F.lit("see "), name).alias("content"))
    text = part.where(s % 11 == 0).select(doc, s.cast("int").alias("page"), F.lit("Text that is Not  Submitted here").alias("text"))
    return xml, notes, text


# --- annotations: a text per line item

VOCABULARY = {"dataset": ["AE", "DM", "VS", "BOLT", "RING"], "variable": ["GEAR", "WIDGET", "QNAM"], "blacklist": ["SMALL", "LARGE"], "dataset_affixes": ["--", "SUPP--", "FA--", "PRO--"], "variable_affixes": ["--", "'--XFN", "STA--", "--ED"]}

ANNOTATIONS_SQL = """
annotations AS (
  SELECT CAST(l_orderkey % 40 AS VARCHAR) AS doc_id, CAST(l_suppkey % 25 + 1 AS INTEGER) AS page,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
    CASE (l_orderkey + l_linenumber) % 6
      WHEN 0 THEN w[1] || ' when ' || w[2] || '=' || w[3]
      WHEN 1 THEN w[1] || '/' || w[3] || '=' || w[2] || '  DONE; next'
      WHEN 2 THEN 'QNAM=' || w[3] || ' in SUPPAE'
      WHEN 3 THEN substr(w[1], 1, 2) || 'M (Label) and AE | ' || w[2]
      WHEN 4 THEN 'Not Submitted, NOTSUBMITTED ' || w[3]
      ELSE '( x ) ' || w[2] || '  ' || lower(w[1]) || ' ' || w[3] || ' in SUPPVS' END AS content
  FROM lineitem JOIN (SELECT p_partkey, string_split(upper(p_type || ' ' || p_name), ' ') AS w FROM part) ON p_partkey = l_partkey)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, seq, content; seq is a struct that is different on every row and orders them."""
    words = F.split(F.upper(F.concat_ws(" ", "p_type", "p_name")), " ")
    w1, w2, w3 = (F.get(words, F.lit(i)) for i in range(3))
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    content = (
        F.when(kind == 0, cat(w1, " when ", w2, "=", w3))
        .when(kind == 1, cat(w1, "/", w3, "=", w2, "  DONE; next"))
        .when(kind == 2, cat("QNAM=", w3, " in SUPPAE"))
        .when(kind == 3, cat(F.substring(w1, 1, 2), "M (Label) and AE | ", w2))
        .when(kind == 4, cat("Not Submitted, NOTSUBMITTED ", w3))
        .otherwise(cat("( x ) ", w2, "  ", F.lower(w1), " ", w3, " in SUPPVS"))
    )
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select((F.col("l_orderkey") % 40).cast("string").alias("doc_id"), (F.col("l_suppkey") % 25 + 1).cast("int").alias("page"), seq.alias("seq"), content.alias("content"))


CLEAN_SQL = r"""
cleaned AS (
  SELECT doc_id, page, seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(content),
    '\(\s*[A-Za-z\s]{0,3}\s*\)', '', 'g'), '^\(\s*[^)]{0,15}\)\s*', ''), '^\(\s*[^)]{1,15}\s+', ''), '^\(\s*', ''), '\s{2,}', ' ', 'g')) AS content FROM annotations),
texts AS (SELECT * FROM cleaned WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page, content ORDER BY seq) = 1)"""

# --- boxes and readings

BOXES_SQL = """
boxes AS (
  SELECT l_orderkey % 200 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS box_seq,
    l_partkey % 400 AS x, l_suppkey % 300 AS y, CAST(24 + l_quantity AS BIGINT) AS w, CAST(10 + l_linenumber * 4 AS BIGINT) AS h,
    (l_partkey % 90) / 100.0e0 + 0.1e0 AS fill_ratio, (l_suppkey % 80) / 100.0e0 + 0.2e0 AS colored_ratio, (l_orderkey % 25) / 100.0e0 AS border_density,
    CASE WHEN l_linenumber % 3 = 0 THEN 'border' ELSE 'color' END AS source FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = read(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey") % 200)
    order = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rect = F.struct((F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") % 300).alias("y"), (24 + F.col("l_quantity")).cast("long").alias("w"), (10 + F.col("l_linenumber") * 4).cast("long").alias("h"))
    part = lambda c, n, more: ((F.col(c) % n) / F.lit(100.0) + F.lit(more))
    return rows.select(
        "page", F.row_number().over(order).alias("box_seq"), rect.alias("rect"), part("l_partkey", 90, 0.1).alias("fill_ratio"), part("l_suppkey", 80, 0.2).alias("colored_ratio"),
        ((F.col("l_orderkey") % 25) / F.lit(100.0)).alias("border_density"), F.when(F.col("l_linenumber") % 3 == 0, "border").otherwise("color").alias("source"),
    )


READINGS_SQL = r"""
readings AS (
  SELECT o_custkey AS box, CAST(o_orderkey AS BIGINT) AS cand_seq,
    CASE o_orderkey % 5 WHEN 0 THEN 'VS' || o_orderstatus || 'TEST = ' || substr(o_orderpriority, 3) WHEN 1 THEN 'QNAM=AE' || o_orderstatus || ' in SUPPAE'
      WHEN 2 THEN 'the patient was ' || lower(o_orderstatus) || ' and is Not Submitted' WHEN 3 THEN 'AB CD=' || o_orderstatus || ' FAX/FAY (see) ' ELSE o_orderstatus || 'X' END AS text,
    (o_orderkey % 97) / 100.0e0 AS conf FROM orders)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, status = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    cat = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    text = (
        F.when(kind == 0, cat("VS", status, "TEST = ", F.substring("o_orderpriority", 3, 100)))
        .when(kind == 1, cat("QNAM=AE", status, " in SUPPAE"))
        .when(kind == 2, cat("the patient was ", F.lower(status), " and is Not Submitted"))
        .when(kind == 3, cat("AB CD=", status, " FAX/FAY (see) "))
        .otherwise(cat(status, "X"))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("box"), F.col("o_orderkey").cast("long").alias("cand_seq"), text.alias("text"), ((F.col("o_orderkey") % 97) / F.lit(100.0)).alias("conf"))
