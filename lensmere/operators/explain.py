"""Explanations: keywords, evidence support, outline, confidence, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import symptoms

# Limits and confidence constants.
ALIGN_KEYS, CONFIDENCE_KEYS, SHOWN_KEYS, SHOWN_PASSAGES = 25, 20, 15, 5
BASE, SLOPE, EMERGENCY_CUT, LOWEST, HIGHEST, NO_KEYS = 0.45, 0.45, 0.1, 0.3, 0.92, 0.5
MAX_SYMPTOMS, MAX_NODES, MAX_EDGE_SIDE = 10, 8, 5


def keywords(texts: DataFrame, top: int = CONFIDENCE_KEYS) -> DataFrame:
    """(query_id, keyword, n, place): most frequent content words, ties by word."""
    counted = texts.select(
        "query_id", F.explode(X.explanation_tokens(F.col("text"))).alias("keyword"),
    ).groupBy("query_id", "keyword").agg(F.count("*").alias("n"))
    order = W.partitionBy("query_id").orderBy(F.col("n").desc(), "keyword")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def keyword_array(texts: DataFrame, top: int) -> DataFrame:
    return keywords(texts, top).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda s: s["keyword"])
        .alias("keys"))


def _normal(c: Column) -> Column:
    return F.lower(X.squeezed(X.or_empty(c)))


def _matched(passages: DataFrame, keys: DataFrame) -> DataFrame:
    """Passages of the queries with the keywords each contains."""
    return passages.join(keys, "query_id").withColumn("_m", X.bind(
        _normal(F.col("text")), lambda t: F.filter("keys", lambda k: F.contains(t, k))))


def alignment(responses: DataFrame, passages: DataFrame) -> DataFrame:
    """Support of a response by its passages, best five per query."""
    m = _matched(passages, keyword_array(responses, ALIGN_KEYS))
    scored = m.withColumn("support", F.round(F.size("_m") / F.size("keys"), 3))
    order = W.partitionBy("query_id").orderBy(F.col("support").desc(), "rank")
    return scored.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= SHOWN_PASSAGES).select(
        "query_id", "place", (F.col("rank") - 1).alias("passage_index"), "source",
        F.array_join(F.slice("_m", 1, SHOWN_KEYS), ",").alias("matched"), "support")


def confidence(responses: DataFrame, passages: DataFrame, level: Column) -> DataFrame:
    """(query_id, confidence) from the share of keywords found in any passage.

    ``level`` is the emergency level of a response row.
    """
    keys = keyword_array(responses, CONFIDENCE_KEYS)
    # A pool has a bounded number of passages per query.
    seen = _matched(passages, keys).groupBy("query_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_m")))).alias("seen"))
    joined = responses.select("query_id", level.alias("_level")).join(
        keys, "query_id", "left").join(seen, "query_id", "left")
    coverage = F.coalesce("seen", F.lit(0)) / F.size("keys")
    base = F.lit(BASE) + F.lit(SLOPE) * coverage
    base = base - F.when(F.col("_level").isin("CRITICAL", "HIGH"), EMERGENCY_CUT).otherwise(0.0)
    value = F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), base)), 3)
    return joined.select("query_id", F.when(F.col("keys").isNull(), NO_KEYS).otherwise(value)
                         .alias("confidence"))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def outline(c: Column) -> Column:
    """Up to six sentences with reasoning markers, else the first four sentences."""
    def weigh(all_sentences: Column) -> Column:
        weighed = F.transform(all_sentences, lambda s, i: F.struct(
            (-sum((F.contains(F.lower(s), F.lit(m)).cast("int") for m in L.REASONING_MARKERS),
                  F.lit(0))).alias("w"), i.alias("i"), X.trimmed(s).alias("s"),
            F.length(s).alias("n")))
        strong = F.filter(weighed, lambda x: (x["w"] < 0) & (x["n"] > 12))
        first = F.transform(F.slice(all_sentences, 1, 4), lambda s: X.trimmed(s))
        return X.bind(F.slice(F.array_sort(strong), 1, 6), lambda best: F.when(
            F.size(best) > 0, F.transform(best, lambda x: x["s"])).otherwise(first))

    picked = X.bind(sentences(X.trimmed(X.or_empty(c))), weigh)
    return F.filter(picked, lambda s: s != "")


def counterfactuals(response: Column, symptom_texts: Column) -> Column:
    """Up to four what-if statements."""
    low = F.lower(X.or_empty(response))

    def among(word: str) -> Column:
        return F.exists(symptom_texts, lambda s: F.contains(F.lower(s), F.lit(word)))

    fever = among("fever") | F.contains(low, F.lit("fever"))
    chest = among("chest") | F.contains(low, F.lit("chest pain"))
    breath = among("breath") | F.contains(low, F.lit("shortness of breath"))
    return F.slice(F.filter(F.array(
        F.when(fever, F.lit(L.COUNTERFACTUAL_FEVER)), F.when(chest, F.lit(L.COUNTERFACTUAL_CHEST)),
        F.when(breath, F.lit(L.COUNTERFACTUAL_BREATH)), F.lit(L.COUNTERFACTUAL_GENERIC)),
        lambda s: s.isNotNull()), 1, 4)


def _alone(pattern: str) -> str:
    """The pattern between word boundaries, for letters of any script."""
    word, non = X.WORD, X.NOT_WORD
    boundary = f"(?:(?<={word})(?={non}|$)|(?<={non}|^)(?={word}))"
    return boundary + pattern + boundary


def condition_candidates(response: Column, passages: Column) -> Column:
    """Sorted candidate conditions of a response and its first passages."""
    cued = F.transform(
        F.regexp_extract_all(X.or_empty(response), F.lit(L.CONDITION_CUE_PATTERN), F.lit(1)),
        lambda s: F.initcap(F.regexp_replace(X.trimmed(s), "[.,;:)]+$", "")))
    cued = F.filter(cued, lambda s: (s != "") & (F.length(s) <= 40))
    phrases = F.flatten(F.transform(F.slice(passages, 1, 3), lambda t: F.regexp_extract_all(
        X.or_empty(t), F.lit(_alone(L.CONDITION_PHRASE_PATTERN)), F.lit(1))))
    phrases = F.filter(F.transform(phrases, lambda s: X.trimmed(s)),
                       lambda s: F.length(s).between(3, 32))
    return F.slice(F.array_sort(F.array_distinct(F.concat(cued, phrases))), 1, MAX_NODES)


def treatment_candidates(passages: Column) -> Column:
    """Sorted capitalised names in medication passages."""
    names = F.flatten(F.transform(passages, lambda t: F.regexp_extract_all(
        X.or_empty(t), F.lit(_alone(L.TREATMENT_NAME_PATTERN)), F.lit(1))))
    kept = F.filter(F.transform(names, lambda s: X.trimmed(s)),
                    lambda s: F.length(s).between(3, 30))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, MAX_NODES)


def graph_nodes(symptoms: Column, conditions: Column, treatments: Column) -> Column:
    """Nodes of the symptom, condition and treatment layers."""
    def layer(values: Column, prefix: str, kind: str) -> Column:
        return F.transform(values, lambda v, i: F.struct(
            F.concat(F.lit(prefix), i.cast("string")).alias("id"), v.alias("label"),
            F.lit(kind).alias("type")))

    return F.concat(
        layer(F.slice(symptoms, 1, MAX_SYMPTOMS), "sym_", "symptom"),
        layer(conditions, "cond_", "condition"), layer(treatments, "treat_", "treatment"))


def graph_edges(symptoms: Column, conditions: Column, treatments: Column) -> Column:
    """Symptom -> condition -> treatment, at most five of each side."""
    def links(a: Column, pa: str, b: Column, pb: str, label: str) -> Column:
        return F.flatten(F.transform(F.slice(a, 1, MAX_EDGE_SIDE), lambda _, i: F.transform(
            F.slice(b, 1, MAX_EDGE_SIDE), lambda _, j: F.struct(
                F.concat(F.lit(pa), i.cast("string")).alias("source"),
                F.concat(F.lit(pb), j.cast("string")).alias("target"),
                F.lit(label).alias("label")))))

    return F.concat(links(symptoms, "sym_", conditions, "cond_", "suggests"),
                    links(conditions, "cond_", treatments, "treat_", "managed_by"))


def package(responses: DataFrame, passages: DataFrame, level: Column, graphs: DataFrame) -> DataFrame:
    """All explanations of a response in one row per query.

    Evidence has at most five entries per query; ``graphs``: (query_id, nodes, edges).
    """
    entries = alignment(responses, passages).groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("place", "passage_index", "source", "matched", "support"))).alias("evidence"))
    entities = symptoms.merge_entities(symptoms.rule_entities(X.squeezed(X.or_empty(F.col("text")))))
    texts = responses.withColumn("_s", F.transform(entities, lambda e: e["text"])).select(
        "query_id", outline(F.col("text")).alias("outline"),
        counterfactuals(F.col("text"), F.col("_s")).alias("counterfactuals"))
    return texts.join(confidence(responses, passages, level), "query_id").join(
        entries, "query_id", "left").join(graphs, "query_id", "left")
