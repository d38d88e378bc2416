"""Assembling evidence: budgets, blocks, source lists, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import text as X

# Sizes of evidence.
BLOCK_PASSAGES, SNIPPET_CHARS, BUDGET_CHARS, UNION_KEY_CHARS = 10, 400, 2000, 60
POOL_KEY_CHARS = 120
PROMPT_TOKENS, PROMPT_REFERENCES, PROMPT_SHARE = 1800, 3, 0.8
PROMPT_KEEP = ["MEDICAL LITERATURE CONTEXT:", "Question:"]
PROMPT_NOTE = "\n\n[Note: Prompt truncated to fit context window]\n"
PROMPT_TEMPLATE = (
    "CONVERSATION MEMORY:\n{CONVERSATION_MEMORY}\n\nBACKGROUND EVIDENCE:\n{EVIDENCE_BLOCK}\n\n"
    "{SYMPTOM_LINE}\n\nUser question:\n{USER_QUESTION}"
)
OVERVIEW_PREFIX = "Topic overview — "


def _ordered_text(pieces: DataFrame, name: str, sep: str) -> DataFrame:
    """(query_id, name): pieces of a query joined by rank.  Pools are bounded by k."""
    return pieces.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda s: s["piece"]), sep)
        .alias(name))


def fill_budget(items: DataFrame, budget: int = BUDGET_CHARS) -> DataFrame:
    """Texts in rank order up to a character budget; the last one is cut."""
    upto = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    used = items.filter(X.or_empty(F.col("text")) != "").withColumn(
        "_before", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)))
    taken = used.filter(F.col("_before") < budget).select(
        "query_id", "rank",
        F.substring(F.col("text"), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))
        .alias("piece"))
    return _ordered_text(taken, "evidence", " ")


def covered(text: Column, subtopics: Column) -> Column:
    """How many subtopics (arrays of synonyms) have a synonym inside the text."""
    return X.bind(F.lower(X.or_empty(text)), lambda low: F.size(F.filter(
        subtopics, lambda synonyms: F.exists(synonyms, lambda s: F.contains(low, s)))))


def union_by_prefix(first: DataFrame, second: DataFrame, chars: int = UNION_KEY_CHARS) -> DataFrame:
    """First list before second, one item per text beginning."""
    both = first.select("query_id", "rank", "text", F.lit(0).alias("tier")).unionByName(
        second.select("query_id", "rank", "text", F.lit(1).alias("tier")))
    keyed = both.withColumn("_k", F.substring(X.or_empty(F.col("text")), 1, chars)).filter("_k <> ''")
    one = W.partitionBy("query_id", "_k").orderBy("tier", "rank")
    kept = keyed.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    order = W.partitionBy("query_id").orderBy("tier", "rank")
    return kept.withColumn("place", F.row_number().over(order)).select(
        "query_id", F.col("place").alias("rank"), "tier", "text")


def evidence_block(passages: DataFrame, directive: DataFrame | None = None,
                   findings: DataFrame | None = None, limit: int = BLOCK_PASSAGES,
                   chars: int = SNIPPET_CHARS) -> DataFrame:
    """(query_id, evidence): snippet lines, repeated snippets once, directive in front."""
    s = passages.filter(F.col("rank") <= limit).select(
        "query_id", "rank", X.snippet(X.or_empty(F.col("text")), chars).alias("snippet"))
    one = W.partitionBy("query_id", F.lower("snippet")).orderBy("rank")
    # Empty snippets are dropped after the window: before it, the filter would be
    # pushed to the corpus and the snippet computed for every document.
    lines = s.withColumn("_n", F.row_number().over(one)).filter(
        "_n = 1 AND snippet <> ''").select("query_id", "rank", F.concat(F.lit("- "), "snippet").alias("piece"))
    block = _ordered_text(lines, "evidence", "\n")
    for extra, column in ((findings, "findings"), (directive, "directive")):
        if extra is not None:
            both = block.join(extra.select("query_id", column), "query_id", "left")
            block = both.select("query_id", F.when(
                X.trimmed(X.or_empty(F.col(column))) != "",
                X.trimmed(F.concat(X.trimmed(column), F.lit("\n"), "evidence")),
            ).otherwise(F.col("evidence")).alias("evidence"))
    return block


def reference_list(passages: DataFrame, limit: int = BLOCK_PASSAGES) -> DataFrame:
    """(query_id, sources): the distinct source and category pairs in rank order."""
    p = passages.filter(F.col("rank") <= limit).select(
        "query_id", "rank", F.coalesce(X.non_empty(F.col("source")), F.lit("Unknown"))
        .alias("name"), X.or_empty(F.col("category")).alias("cat"))
    one = W.partitionBy("query_id", "name", "cat").orderBy("rank")
    lines = p.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(
        "query_id", "rank",
        F.concat(F.lit("• "), "name", F.when(
            F.col("cat") != "", F.concat(F.lit(" — "), "cat")).otherwise("")).alias("piece"))
    return _ordered_text(lines, "sources", "\n")


def literature(passages: DataFrame, chars: int = SNIPPET_CHARS) -> DataFrame:
    """(query_id, literature): numbered references with the start of each text."""
    piece = F.concat(
        F.lit("\nRef["), (F.col("rank") - 1).cast("string"), F.lit("]: "),
        F.coalesce("source", F.lit("Unknown source")), F.lit(" ("),
        F.coalesce("category", F.lit("General")), F.lit("): "),
        F.substring(X.or_empty(F.col("text")), 1, chars), F.lit("...\n"))
    return _ordered_text(passages.select("query_id", "rank", piece.alias("piece")),
                         "literature", "\n")


def citations(passages: DataFrame, limit: int = 5) -> DataFrame:
    return passages.filter(F.col("rank") <= limit).select(
        "query_id", "rank", F.concat(
            F.lit("Reference ["), (F.col("rank") - 1).cast("string"), F.lit("]: "),
            F.coalesce("source", F.lit("Unknown"))).alias("citation"))


def query_sources(passages: DataFrame) -> DataFrame:
    """(query_id, sources): sorted distinct sources of a bounded pool."""
    return passages.filter(X.or_empty(F.col("source")) != "").groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def symptom_line(entities: Column) -> Column:
    """A line naming the first five symptoms, or nothing."""
    names = F.transform(F.slice(entities, 1, 5), lambda e: e["text"])
    return F.when(F.size(entities) > 0, F.concat(
        F.lit("Symptoms noted: "), F.array_join(names, ", "))).otherwise("")


def truncate_prompt(prompt: Column, max_tokens: int = PROMPT_TOKENS) -> Column:
    """Shorten a long prompt line by line, keeping the important lines.

    Lines with a key phrase stay, the first references stay, other lines stay
    while the text so far is below a share of the limit.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(0).alias("chars"),
        F.lit(0).alias("references"))

    def step(state: Column, line: Column) -> Column:
        key = reduce(lambda a, b: a | b, [F.contains(line, F.lit(k)) for k in PROMPT_KEEP])
        reference = (~key) & F.contains(line, F.lit("Ref[")) & (
            state["references"] < PROMPT_REFERENCES)
        room = F.floor(F.greatest(state["chars"] - 1, F.lit(0)) / 4) < max_tokens * PROMPT_SHARE
        return F.when(key | reference | room, F.struct(
            F.array_append(state["kept"], line).alias("kept"),
            (state["chars"] + F.length(line) + 1).alias("chars"),
            (state["references"] + reference.cast("int")).alias("references"),
        )).otherwise(state)

    kept = F.array_join(F.aggregate(F.split(prompt, "\n"), start, step)["kept"], "\n")
    fitted = X.bind(kept, lambda t: F.when(
        F.floor(F.length(t) / 4) > max_tokens, F.substring(t, F.lit(1), F.lit(max_tokens * 4))
    ).otherwise(t))
    return F.when(F.floor(F.length(prompt) / 4) <= max_tokens, prompt).otherwise(
        F.concat(fitted, F.lit(PROMPT_NOTE)))


def overview_hits(nodes: DataFrame) -> DataFrame:
    """Summary-tree hits in the shape of passages."""
    return nodes.select(
        "query_id", "rank", "score", "doc_id",
        F.concat(F.lit(OVERVIEW_PREFIX), X.or_empty(F.col("title")), F.lit(": "),
                 X.or_empty(F.col("text"))).alias("text"),
        F.concat(F.lit("raptor_level_"), F.coalesce("level", F.lit(1)).cast("string"))
        .alias("category"), F.lit("").alias("url"), F.lit("overview").alias("type"))
