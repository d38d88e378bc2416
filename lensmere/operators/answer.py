"""From the newest message of each conversation to the prompt of its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lensmere.functions import text as X
from lensmere.operators import conversation, evidence, gates, routing, symptoms, tree
from lensmere.operators.corpus import union
from lensmere.operators.models import Embedder, no_hypotheticals
from lensmere.operators.pools import join_pool


def newest(log: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of the last user message per conversation."""
    return log.filter("role = 'user'").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


def screened(log: DataFrame, embedder: Embedder | None = None, name: str = "assistant") -> DataFrame:
    """The newest messages with scope, classes and the query to search with.

    Short messages are searched together with the user's message before.
    """
    asked = gates.scope(newest(log), in_conversation=F.col("turn") > 0, name=name,
                        embedder=embedder)
    query = conversation.fold_follow_ups(log).select("conv_id", "turn", "query")
    c = F.col("text")
    return asked.join(query, ["conv_id", "turn"]).select(
        "*", gates.complexity(c).alias("complexity"), gates.query_type(c).alias("query_type"),
        F.array_join(gates.specialties(c), ",").alias("specialties"))


def searched(messages: DataFrame) -> DataFrame:
    """Messages that get evidence."""
    return messages.filter((F.col("kind") == "medical") & (F.col("complexity") != "greeting"))


def answer_context(log: DataFrame, docs: DataFrame, embedder: Embedder,
                   nodes: DataFrame | None = None, modality: DataFrame | None = None,
                   hypothetical=no_hypotheticals, template: str = evidence.PROMPT_TEMPLATE) -> DataFrame:
    """One row per conversation: scope, classes, experts, passages and prompt.

    ``docs``: (doc_id, text, source); ``nodes``: embedded summary nodes;
    ``modality``: (conv_id, modality) of an attached image.  Messages outside
    the scope have no prompt.
    """
    # One row per conversation, read by every step below.
    messages = screened(log, embedder).persist()
    open_ = searched(messages)
    asked = open_.select(F.col("conv_id").alias("query_id"), F.col("query").alias("text"))
    if modality is None:
        with_image = asked.withColumn("modality", F.lit(None).cast("string"))
    else:
        with_image = asked.join(modality.withColumnRenamed("conv_id", "query_id"), "query_id", "left")
    routed = routing.gate(with_image, embedder).persist()
    generated = hypothetical(F.col("query"))
    leaf = routed.withColumn("query", F.when(
        X.or_empty(generated) != "", F.concat("query", F.lit("\n"), generated)).otherwise(F.col("query")))
    # A few rows per conversation, read for the passages and for their count.
    pool = routing.gather(leaf, docs, embedder).persist()
    texts = join_pool(pool, docs.select("doc_id", "text", "source"), asked, routing.POOLED)
    found = texts.select(
        "query_id", F.col("place").alias("rank"), "text", "source", F.lit(1).alias("tier"))
    if nodes is not None:
        top = tree.overview(asked, nodes, embedder).select(
            "query_id", (F.col("rank") - 1_000).alias("rank"), "text",
            F.lit("knowledge tree").alias("source"), F.lit(0).alias("tier"))
        found = union([found, top])
    blocks = evidence.evidence_block(found, routing.directive(routed))
    counts = found.groupBy("query_id").agg(F.count("*").alias("passages"))
    remembered = conversation.memory(log, current=newest(log))
    named = evidence.symptom_line(symptoms.merge_entities(symptoms.rule_entities(F.col("text"))))
    joined = (
        messages.join(blocks.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
        .join(counts.withColumnRenamed("query_id", "conv_id"), "conv_id", "left")
        .join(remembered, "conv_id", "left"))
    prompt = X.template(template, {
        "EVIDENCE_BLOCK": F.col("evidence"), "USER_QUESTION": F.col("text"), "SYMPTOM_LINE": named,
        "CONVERSATION_MEMORY": F.col("memory")})
    return joined.select(
        "conv_id", "turn", "kind", "confidence", "reason", "complexity", "query_type", "specialties",
        F.coalesce("passages", F.lit(0)).alias("passages"),
        F.when(F.col("kind") == "medical", prompt).alias("prompt"))


def retrieve_by_intent(messages: DataFrame, docs: DataFrame, embedder: Embedder,
                       medication_category: str, k: int = 3, min_score: float = 0.2) -> DataFrame:
    """Evidence by intent: medication questions prefer one category.

    Medication questions without a hit in the category, and all other
    questions, get the best passages overall.
    """
    from lensmere.operators import dense

    vectors = docs.select("doc_id", "category", embedder(F.col("text")).alias("embedding"))
    asked = messages.select(
        "query_id", gates.intent(F.col("text")).alias("intent"),
        embedder(F.col("text")).alias("embedding"))
    overall = dense.search(asked, vectors, k, min_score).withColumn("found_by", F.lit("all"))
    medication = asked.filter("intent = 'medication'")
    special = dense.search_category(medication, vectors, medication_category, k, min_score).select(
        "query_id", "doc_id", "score", "rank", F.lit("category").alias("found_by"))
    rest = overall.join(special.select("query_id").distinct(), "query_id", "left_anti")
    return special.unionByName(rest)
