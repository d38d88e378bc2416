"""Image findings delivered by a classifier: choice, labels, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import text as X

# Thresholds and wording.
THRESHOLD, SHOWN, FALLBACK, COLOURFUL = 0.5, 8, 3, 25.0
RADIOGRAPH, PHOTO = "chest_xray", "skin"
KINDS = {RADIOGRAPH: "chest radiograph", PHOTO: "skin image"}


def mean_saturation(pixels: Column) -> Column:
    """Mean HSV saturation (0-255) of an array of (r, g, b) structs."""
    def saturation(p: Column) -> Column:
        top, bottom = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
        return F.when(top == 0, 0.0).otherwise(F.floor((top - bottom) * 255 / top).cast("double"))

    total = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + saturation(p))
    return F.when(F.size(pixels) > 0, total / F.size(pixels)).otherwise(0.0)


def modality(pixels: Column, stated: Column | None = None) -> Column:
    """The stated modality, else grey images are radiographs."""
    guess = F.when(mean_saturation(pixels) < COLOURFUL, RADIOGRAPH).otherwise(PHOTO)
    if stated is None:
        return guess
    return F.when((X.or_empty(stated) != "") & (stated != "auto"), stated).otherwise(guess)


def ranked(findings: DataFrame) -> DataFrame:
    """(image_id, modality, place, label, probability), most likely first; of a photo the first eight."""
    order = W.partitionBy("image_id").orderBy(F.col("probability").desc(), "label")
    placed = findings.withColumn("label", X.pretty_label(F.col("label"))).withColumn(
        "place", F.row_number().over(order))
    return placed.filter((F.col("modality") != PHOTO) | (F.col("place") <= SHOWN))


def top_findings(findings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Radiographs: findings at the threshold.  Photos: the leading class."""
    r = ranked(findings)
    return r.filter(F.when(F.col("modality") == PHOTO, F.col("place") == 1).otherwise(
        F.col("probability") >= threshold))


def wording(findings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(image_id, summary, block): the findings in words.

    An image has as many findings as its classifier has labels.
    """
    r = ranked(findings).withColumn("_top", F.when(
        F.col("modality") == PHOTO, F.col("place") == 1).otherwise(
        F.col("probability") >= threshold))
    both = r.groupBy("image_id", "modality").agg(
        F.array_sort(F.collect_list(F.struct("place", "label", "probability", "_top"))).alias("f"))
    kind = F.coalesce(*[F.when(F.col("modality") == m, F.lit(k)) for m, k in KINDS.items()])
    top = F.filter("f", lambda x: x["_top"])
    shown = F.when(F.size(top) > 0, top).otherwise(F.slice("f", 1, FALLBACK))
    share = F.array_join(F.transform(
        top, lambda x: F.concat(x["label"], F.lit(" ("), X.percent(x["probability"]), F.lit(")"))), ", ")
    best = F.element_at("f", 1)
    summary = F.when(F.size(top) > 0, F.concat(
        F.lit("Leading "), kind, F.lit(" finding(s): "), share,
        F.lit(". Model screening estimate, not a diagnosis."))).otherwise(F.concat(
            F.lit("No findings reached the reporting threshold. Highest estimate: "), best["label"],
            F.lit(" at "), X.percent(best["probability"]),
            F.lit(". Screening estimate, not a diagnosis.")))
    lines = F.array_join(F.transform(shown, lambda x: F.concat(
        x["label"], F.lit(" "), F.format_string("%.2f", F.bround(x["probability"], 2)))), "; ")
    block = F.concat(
        F.lit("Automated "), kind, F.lit(" analysis (model-estimated probabilities, for reasoning "
        "only, not a diagnosis): "), lines, F.lit(". Values near or below 0.5 are uncertain."))
    return both.select("image_id", summary.alias("summary"), block.alias("block"))
