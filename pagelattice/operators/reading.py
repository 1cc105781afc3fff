"""From pictures of boxes to one text each: several attempts per box, a choice among them, and a second reading of what looks damaged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions import ocr as O
from pagelattice.operators import boxes as B
from pagelattice.sources.ocr import read_attempts

KEY = ["doc_id", "page", "box_seq"]

#: Below the first a text is noise and taken as read; an unambiguous short token has the second and leads by the third; a reading of body text has more words than the fourth.
NOISE, CLEAR, LEAD, BODY_WORDS = 1.5, 2.0, 0.8, 10
SHORT_TOKEN = r"^[A-Z][A-Z0-9]{1,7}$"
EDGES = "[]|;:,"
#: What a costly reader is tried on, by score, width and height.
LIMITS = {"easyocr": (3.0, 72, 24, B.EASYOCR_BUDGET), "trocr": (3.2, 120, 36, B.TROCR_BUDGET)}


def inset(rect: Column, page_w: Column, page_h: Column, margin: int = 0) -> Column:
    """The part of a box to read: a little smaller than the box, so that text beside it stays out, unless too little would be left; then a margin, within the page."""
    dx, dy = F.floor(rect["w"] * 0.005), F.floor(rect["h"] * 0.06)
    fits = (rect["w"] - dx * 2 >= 10) & (rect["h"] - dy * 2 >= 8)
    dx, dy = F.when(fits, dx).otherwise(0), F.when(fits, dy).otherwise(0)
    left, top = F.greatest(F.lit(0), rect["x"] + dx - margin), F.greatest(F.lit(0), rect["y"] + dy - margin)
    right, bottom = F.least(page_w, rect["x"] + rect["w"] - dx + margin), F.least(page_h, rect["y"] + rect["h"] - dy + margin)
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), (right - left).cast("int").alias("w"), (bottom - top).cast("int").alias("h"))


def tiny(rect: Column) -> Column:
    return (rect["w"] < 70) | (rect["h"] < 24)


def choose_first(attempts: DataFrame, known: list[str], box: list[str] = KEY) -> DataFrame:
    """attempts(box, cand_seq, text, conf from 0 to 100): the text of each box. Boxes of which no attempt has a text are left out.

    Noise, and a short token that leads clearly, are taken as they are; otherwise the best and a near runner-up are weighed with confidence and quality.
    """
    scored = attempts.where(F.coalesce("text", F.lit("")) != "").withColumn("score", O.score(F.col("text")))
    ranked = B.rank_quick(scored, box)
    bare = F.btrim("text", F.lit(EDGES + " "))
    clear = (F.col("score") >= CLEAR) & (F.col("gap") >= LEAD) & bare.rlike(SHORT_TOKEN)
    at_once = F.when(F.col("rank") == 1, F.when(F.col("score") < NOISE, F.col("text")).when(clear, bare))
    ranked = ranked.withColumn("at_once", F.max(at_once).over(Window.partitionBy(*box))).withColumn("adj", O.quality(F.col("text"), known))
    best = B.choose_reading(ranked, box)
    body = (F.col("total") < 0) & (F.size(F.split(F.btrim("text"), r"\s+")) > BODY_WORDS)
    weighed = F.when(body, "").otherwise(O.normalize(F.col("text")))
    return best.select(*box, F.coalesce("at_once", weighed).alias("text"), F.col("at_once").isNull().alias("weighed"))


def choose_second(attempts: DataFrame, known: list[str], box: list[str] = KEY) -> DataFrame:
    """The second reading of each box: best score and quality, then the longer text."""
    text = F.col("text")
    good = attempts.where(F.coalesce("text", F.lit("")) != "").withColumn("_s", O.score(text) + O.quality(text, known))
    return good.groupBy(*box).agg(F.max_by("text", F.struct("_s", F.length("text"), -F.col("cand_seq"))).alias("second"))


def read_chain(boxes: DataFrame, known: list[str], reader: Callable | None = None) -> DataFrame:
    """boxes(doc_id, page, box_seq, rect, picture): doc_id, page, box_seq and text, empty where nothing can be read.

    Only texts that were weighed and look damaged are read again, and the second reading counts if it is better by 0.35. Pictures are read where they are; only those
    of damaged texts are fetched by key.
    """
    boxes = boxes.withColumn("tiny", tiny(F.col("rect")))
    first = choose_first(read_attempts(boxes, "quick", reader), known)
    damaged = first.where(F.col("weighed") & O.needs_second_pass(F.col("text"), known)).select(*KEY)
    second = choose_second(read_attempts(boxes.join(damaged, KEY, "left_semi"), "second", reader), known)
    texts = first.join(second, KEY, "left").select(*KEY, F.when(F.col("second").isNull(), F.col("text")).otherwise(O.pick_second(F.col("text"), F.col("second"), known)).alias("text"))
    return boxes.select(*KEY).join(texts, KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))


def for_costly_reader(read: DataFrame, engine: str, known: list[str], page: list[str], most: int | None = None) -> DataFrame:
    """The boxes (page columns, box_seq, rect, text) that `easyocr` or `trocr` is tried on: low scores, small boxes, damaged texts and those that do not pass the gate; per page the first `most`."""
    least, width, height, budget = LIMITS[engine]
    text, score = F.coalesce("text", F.lit("")), O.score(F.coalesce("text", F.lit("")))
    wanted = (score < least) | (F.col("rect.w") < width) | (F.col("rect.h") < height) | O.needs_second_pass(text, known) | ~O.gate(text, score, 1.8)
    return B.first_of(read.where(wanted), page, [F.col("box_seq")], budget if most is None else most)


def contours(measured: DataFrame, accepted: DataFrame, page: list[str]) -> DataFrame:
    """Which measured contours are tried: all coloured ones, and on pages with few accepted coloured boxes the largest outlines."""
    many = accepted.where("source = 'color'").groupBy(*page).count().where(F.col("count") >= B.FEW_COLORED).select(*page)
    edges = measured.where("source = 'border'").join(many, page, "left_anti")
    return measured.where("source = 'color'").unionByName(B.first_of(edges, page, [F.desc("area"), F.col("box_seq")], B.EDGE_CONTOURS).select(*measured.columns))
