"""Map elements that an image service reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "struct<elements: array<struct<kind: string, category: string, label: string, x: double, y: double, width: double, height: double, confidence: double>>>"
#: Kinds and categories of elements, most of them per image, and pixels within which two are one.
KINDS, CATEGORIES, MOST, APART = ("nature", "building", "icon"), ("green", "water", "mountain", "cafe", "culture", "shop", "building", "transport", "other"), 80, 12


def valid(e: F.Column) -> F.Column:
    """Whether an element has a known kind and category, a short label, and a box within the image; a cafe must be an icon or a building."""
    finite = ~F.isnan(e["x"] + e["y"] + e["width"] + e["height"] + e["confidence"])
    box = (e["x"] >= 0) & (e["y"] >= 0) & (e["x"] < 1) & (e["y"] < 1) & (e["width"] > 0) & (e["height"] > 0) & (e["x"] + e["width"] <= 1.001) & (e["y"] + e["height"] <= 1.001)
    sure = e["confidence"].between(0.8, 1.0)
    return F.coalesce(e["kind"].isin(*KINDS) & e["category"].isin(*CATEGORIES) & (F.length(e["label"]) <= 100) & finite & box & sure & ((e["category"] != "cafe") | e["kind"].isin("icon", "building")), F.lit(False))


def parse(rows: DataFrame, text: str, width: str, height: str) -> DataFrame:
    """Add ``status`` and ``kept``: the valid elements of a JSON column, their centres in pixels; of near ones of a category the first stays.

    The status is ``unavailable``, and nothing is kept, if the text is no such JSON
    or lists more than ``MOST`` elements; else ``analyzed``. A duplicate is one
    within ``APART`` pixels of an element that was kept, so the fold over the few
    elements of an image is in order.
    """
    listed = F.from_json(text, SCHEMA)["elements"]
    fine = listed.isNotNull() & (F.size(listed) <= MOST)
    centre = lambda e, at, side, whole: (e[at] + F.least(e[side], 1 - e[at]) / 2) * F.col(whole)
    kind = "array<struct<kind: string, category: string, label: string, x: double, y: double, confidence: double>>"
    place = lambda e: F.struct(e["kind"].alias("kind"), e["category"].alias("category"), F.trim(e["label"]).alias("label"), centre(e, "x", "width", width).alias("x"), centre(e, "y", "height", height).alias("y"), e["confidence"].alias("confidence"))
    near = lambda k, e: (k["category"] == e["category"]) & (F.sqrt(F.pow(k["x"] - e["x"], 2) + F.pow(k["y"] - e["y"], 2)) < APART)
    placed = F.transform(F.filter(listed, valid), place).cast(kind)
    kept = F.aggregate(placed, F.array().cast(kind), lambda s, e: F.when(F.exists(s, lambda k: near(k, e)), s).otherwise(F.concat(s, F.array(e))))
    return rows.withColumn("status", F.when(fine, "analyzed").otherwise("unavailable")).withColumn("kept", F.when(fine, kept).otherwise(F.array().cast(kind)))
