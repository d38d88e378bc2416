"""Interaction log, risk analysis, response scores and clinical checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators.evidence import citations
from lensmere.operators.running import running_count

ANONYMOUS = "anonymous"
SCORE_NAMES = ["relevance", "completeness", "safety", "clarity", "overall"]


def log_columns() -> list:
    q = X.or_empty(F.col("query"))
    return [
        F.substring(F.md5(F.concat("ts", F.lit("_"), F.substring(q, 1, 50))), 1, 12)
        .alias("interaction_id"),
        "ts", F.coalesce("session_id", F.lit(ANONYMOUS)).alias("session_id"),
        F.md5(q).alias("query_hash"), F.length(q).alias("query_length"),
        F.coalesce("confidence", F.lit(0.0)).alias("response_confidence"),
        F.coalesce("emergency", F.lit(False)).alias("emergency_detected"),
        F.coalesce("sources", F.lit(0)).alias("sources_used")]


def interaction_log(df: DataFrame) -> DataFrame:
    """Audit records: (query, ts, session_id, confidence, emergency, sources) to hashes and lengths."""
    return df.select(*log_columns())


def audit_emergencies(query: Column) -> Column:
    """The emergency terms of the audit list found in a query."""
    return X.bind(F.lower(query), lambda low: F.filter(
        F.array(*[F.lit(t) for _, t in L.flatten(L.AUDIT_EMERGENCY_KEYWORDS)]),
        lambda t: F.contains(low, t)))


def suspicious_count(query: Column) -> Column:
    low = F.lower(query)
    return reduce(lambda a, b: a + b, [
        F.contains(low, F.lit(t)).cast("int") for t in L.SUSPICIOUS_INDICATORS])


def session_volume(df: DataFrame, keys: list, order: list, block: Column) -> DataFrame:
    """Running number of queries per session, parallel within a hot session."""
    return running_count(df, keys, order, block, "session_count")


def risks(df: DataFrame, max_queries: int = L.MAX_QUERIES_PER_SESSION) -> DataFrame:
    """Add the risk level, its factors and whether a human must look.

    Needs ``query``, ``confidence`` (missing counts as 0) and ``session_count``.
    """
    prepared = df.withColumn("_e", F.size(audit_emergencies(F.col("query")))).withColumn(
        "_s", suspicious_count(F.col("query")))
    low = F.coalesce("confidence", F.lit(0.0)) < L.MIN_CONFIDENCE
    busy = F.col("session_count") > max_queries
    odd = F.col("_s") >= L.SUSPICIOUS_THRESHOLD
    urgent = F.col("_e") > 0
    level = (F.when(urgent, "critical").when(odd, "high").when(low, "medium").otherwise("low"))
    factors = F.filter(F.array(
        F.when(urgent, F.lit("emergency")), F.when(low, F.lit("low_confidence")),
        F.when(busy, F.lit("high_volume")), F.when(odd, F.lit("suspicious"))),
        lambda f: f.isNotNull())
    return prepared.withColumn("risk_level", level).withColumn(
        "risk_factors", F.array_join(factors, ",")).withColumn(
        "requires_review", urgent | busy | odd).drop("_e", "_s")


def session_summary(df: DataFrame) -> DataFrame:
    """Per session: queries, emergencies, mean confidence, span, status."""
    mean = F.avg(F.coalesce("confidence", F.lit(0.0)))
    return df.groupBy("session_id").agg(
        F.count("*").alias("total_queries"), F.count_if("emergency").alias("emergencies"),
        F.round(mean, 6).alias("average_confidence"),
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        F.when((F.count_if("emergency") == 0) & (F.round(mean, 9) > 0.5), "safe")
        .otherwise("needs_review").alias("status"))


def response_scores(df: DataFrame) -> DataFrame:
    """Scores of a response described by flags.

    Needs booleans error, has_summary, has_conditions, has_actions,
    has_disclaimer and confidence, sources_used.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)).cast("double")

    confidence = F.coalesce("confidence", F.lit(0.0))
    summary, conditions, actions = map(flag, ("has_summary", "has_conditions", "has_actions"))
    content = (summary + conditions + actions) / 3.0
    sourced = F.least(F.coalesce("sources_used", F.lit(0)) / 3.0, F.lit(1.0))
    failed = F.coalesce("error", F.lit(False))

    def unless_failed(value: Column) -> Column:
        return F.when(failed, 0.0).otherwise(value)

    relevance = unless_failed(content * 0.5 + confidence * 0.3 + sourced * 0.2)
    completeness = unless_failed((summary + conditions + actions + flag("has_disclaimer")) / 4.0)
    safety = F.when(confidence > 0.8, 0.8).otherwise(1.0)
    clarity = unless_failed((F.greatest(conditions, actions) + summary) / 2.0)
    scored = df.select(
        "*", relevance.alias("relevance"), completeness.alias("completeness"),
        safety.alias("safety"), clarity.alias("clarity"))
    four = F.col("relevance") + F.col("completeness") + F.col("safety") + F.col("clarity")
    if "has_truth" in df.columns:
        accuracy = F.when(F.col("has_truth"), 0.5)
        overall = F.when(F.col("has_truth"), (four + 0.5) / 5.0).otherwise(four / 4.0)
        return scored.withColumn("accuracy", accuracy).withColumn("overall", overall)
    return scored.withColumn("overall", four / 4.0)


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Mean and population deviation of every score."""
    return scored.agg(
        F.count("*").alias("total"),
        *[F.round(F.avg(n), 6).alias(f"avg_{n}") for n in SCORE_NAMES],
        *[F.round(F.stddev_pop(n), 6).alias(f"std_{n}") for n in SCORE_NAMES])


def source_alignment(responses: DataFrame, passages: DataFrame) -> DataFrame:
    """How many response words occur among the longer words of the passages."""
    said = responses.select(
        "query_id", F.explode(X.words(F.lower("text"))).alias("word")).groupBy(
        "query_id", "word").agg(F.count("*").alias("n"))
    known = passages.select(
        "query_id", F.explode(F.array_distinct(X.words(F.lower("text")))).alias("word")
    ).filter(F.length("word") > 4).distinct()
    common = said.join(known, ["query_id", "word"], "left_semi").groupBy("query_id").agg(
        F.sum("n").alias("common"))
    n = F.coalesce("common", F.lit(0))
    return responses.select("query_id").join(common, "query_id", "left").select(
        "query_id", n.alias("common"),
        F.when(n > 10, "excellent").when(n > 5, "good").otherwise("moderate").alias("alignment"))


def interactions(df: DataFrame, passages: DataFrame, block: Column, max_queries: int = L.MAX_QUERIES_PER_SESSION) -> DataFrame:
    """One record per interaction: its log, its risks, the scores of its response, citations and validation.

    ``df``: (query_id, query, text, ts, session_id, confidence, sources) with the
    flags of ``response_scores``; ``passages``: (query_id, rank, text, source).
    Within a session interactions are counted by ``ts`` and id; ``block`` rises
    with that order.  A row without a response text scores as it is flagged.
    """
    known = df.withColumn("session_id", F.coalesce("session_id", F.lit(ANONYMOUS))).withColumn(
        "emergency", F.size(audit_emergencies(X.or_empty(F.col("query")))) > 0).withColumn("sources_used", F.col("sources"))
    scored = response_scores(risks(session_volume(known, ["session_id"], ["ts", "query_id"], block), max_queries))
    record = scored.select("query_id", *log_columns(), "session_count", "risk_level", "risk_factors", "requires_review",
                           *[F.round(n, 6).alias(n) for n in SCORE_NAMES])
    cited = citations(passages).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda c: c["citation"]).alias("citations"))  # five at most
    return record.join(source_alignment(df, passages), "query_id").join(cited, "query_id", "left")


def fallback(df: DataFrame) -> DataFrame:
    """What is recorded where no answer could be made: an error that asks for a review and scores nothing."""
    return df.withColumn("error", F.lit(True)).withColumn("confidence", F.lit(0.0)).withColumn("sources", F.lit(0))


def clinical_checks(df: DataFrame) -> DataFrame:
    """Combine single checks: block on conflicts, override on severe or restricted."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    severe = F.coalesce(F.col("interaction_severity"), F.lit("none")) == "severe"
    return df.withColumn(
        "block", flag("allergy_conflict") | flag("contraindicated")).withColumn(
        "requires_override", severe | flag("formulary_restricted") | flag("prior_authorisation"))


def draft_references(passages: DataFrame, limit: int = 3, chars: int = 400) -> DataFrame:
    """(query_id, references): the block a medication draft is based on."""
    from lensmere.operators.evidence import _ordered_text
    piece = F.concat(
        F.lit("[Ref "), (F.col("rank") - 1).cast("string"), F.lit("] "),
        F.substring(X.or_empty(F.col("text")), 1, chars))
    return _ordered_text(passages.filter(F.col("rank") <= limit).select(
        "query_id", "rank", piece.alias("piece")), "references", "\n\n")


def json_block(c: Column) -> Column:
    """From the first brace to the last, as text."""
    return X.non_empty(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def parse_draft(c: Column) -> dict:
    """Columns of a medication draft; missing fields get their defaults."""
    block = json_block(c)

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.get_json_object(block, f"$.{name}"), F.lit(default))

    checks = "[" + ",".join(f'"{x}"' for x in L.DRAFT_CHECKS) + "]"
    return {
        "status": F.lit("DRAFT"), "candidate_drugs": field("candidate_drugs", "[]"),
        "checks_to_run": field("checks_to_run", checks), "sources": field("sources", "[]"),
    }
