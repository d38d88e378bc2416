"""Putting corpora together and keeping them up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import text as X


def union(parts: list) -> DataFrame:
    """All rows of all corpora; columns a corpus lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def new_rows(candidates: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose key is not present yet."""
    return candidates.join(existing.select(key), key, "left_anti")


def append_new(existing: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    return union([existing, new_rows(candidates, existing, key)])


def last_rows(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Checkpoint view: the last row per key wins."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def attach_context(chunks: DataFrame, contexts: DataFrame, key: str = "id") -> DataFrame:
    """Generated contexts next to the chunks, empty where none exists."""
    return chunks.join(contexts.select(key, F.col("ctx")), key, "left").withColumn(
        "context", X.or_empty(F.col("ctx"))).drop("ctx")


def category_statistics(chunks: DataFrame) -> DataFrame:
    """Counts per category, per type and in total, in one pass."""
    named = chunks.select(
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("type", F.lit("unknown")).alias("type"))
    sets = named.groupingSets([["category"], ["type"], []], "category", "type").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"))
    return sets.select(
        F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "type").otherwise("total")
        .alias("dimension"),
        F.coalesce("category", "type", F.lit("")).alias("value"), "n")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values, one per row, in order."""
    return df.select(column).filter(X.or_empty(F.col(column)) != "").distinct().orderBy(column)


def concept_rows(lines: DataFrame) -> DataFrame:
    """Rows of a concept file worth keeping: complete, English."""
    term = F.trim("term")
    return lines.filter(
        (X.or_empty(F.col("rxcui")) != "") & (X.or_empty(term) != "")
        & (F.upper("lat") == "ENG")).withColumn("term", term)


def term_type_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rxcui", "tty").agg(F.count("*").alias("n"))


def concepts(rows: DataFrame, max_synonyms: int = 30, max_concepts: int | None = None) -> DataFrame:
    """One chunk per concept: preferred name, synonyms, term types.

    The preferred name is the first RXNORM term marked preferred (by ``seq``),
    else the smallest term.  Synonyms are limited before they are gathered, so
    a concept with very many terms never becomes one huge group.
    """
    kept = rows
    if max_concepts is not None:
        some = rows.select("rxcui").distinct().orderBy("rxcui").limit(max_concepts)
        kept = rows.join(some, "rxcui", "left_semi")
    official = (F.upper("sab") == "RXNORM") & (F.upper("ispref") == "Y")
    names = kept.groupBy("rxcui").agg(
        F.coalesce(F.min_by("term", F.when(official, F.col("seq"))), F.min("term"))
        .alias("preferred"))
    order = W.partitionBy("rxcui").orderBy("term")
    synonyms = (
        kept.select("rxcui", "term").distinct()
        .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_synonyms)
        .groupBy("rxcui").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("syn"))
    )
    # The term types of a concept file are a small fixed set.
    types = term_type_histogram(kept).groupBy("rxcui").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("tty", "n"))),
        lambda s: F.concat(s["tty"], F.lit(":"), s["n"].cast("string"))), ", ").alias("tty"))
    text = F.concat(
        F.lit("RxNorm concept RXCUI "), F.col("rxcui"), F.lit(": "), F.col("preferred"),
        F.lit(".\nSynonyms: "), F.col("syn"), F.lit(".\nTTY counts: "), F.col("tty"), F.lit("."))
    return names.join(synonyms, "rxcui").join(types, "rxcui").select(
        F.concat(F.lit("rxnorm_"), F.col("rxcui")).alias("id"), "rxcui", "preferred",
        text.alias("text"), X.token_estimate(text, 1).alias("token_count"))


def drug_documents(records: DataFrame, file: Column | None = None) -> DataFrame:
    """Drug records of either naming brought to the document columns."""
    def first(*names: str, default: str = "") -> Column:
        present = [X.non_empty(F.col(n)) for n in names if n in records.columns]
        return F.coalesce(*present, F.lit(default))

    text = X.squeezed(first("content", "text"))
    return records.select(
        text.alias("text"), first("source", default="Drug Database").alias("source"),
        F.lit("Medications").alias("category"),
        (file if file is not None else F.lit("")).alias("file"),
        first("url").alias("url"), first("type", default="medication_info").alias("type"),
        first("name", "drug_name").alias("drug_name"),
        first("category", "drug_category").alias("drug_category"),
    ).filter(F.col("text") != "")


def tuning_examples(chunks: DataFrame, tag: str, system: str, instruction: str) -> DataFrame:
    """Instruction examples from QA chunks, answers as JSON text."""
    q, a = X.or_empty(F.col("question")), X.or_empty(F.col("answer"))
    text = X.or_empty(F.col("text"))
    parts = {c: X.or_empty(F.col(c)) for c in ("source", "category", "file", "url")}
    any_part = reduce(lambda x, y: x | y, [p != "" for p in parts.values()])
    citation = F.struct(*[p.alias(c) for c, p in parts.items()])
    output = F.to_json(F.struct(
        a.alias("answer"), F.lit("medium").alias("confidence"),
        F.when(any_part, F.array(citation)).otherwise(F.slice(F.array(citation), 1, 0))
        .alias("citations")))
    question = F.concat(F.lit("Question: "), q)
    return chunks.filter((q != "") & (a != "")).select(
        "id", F.lit(instruction).alias("instruction"),
        F.when(text != "", F.concat(question, F.lit("\nContext: "), F.substring(text, 1, 1500)))
        .otherwise(question).alias("input"),
        output.alias("output"), F.lit(system).alias("system"), F.lit(tag).alias("tag"))


def chat_messages(examples: DataFrame) -> DataFrame:
    """(id, position, role, content): the messages of each example."""
    user = X.trimmed(F.concat("instruction", F.lit("\n\n"), "input"))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content")))
    return examples.select("id", F.posexplode(messages).alias("position", "m")).select(
        "id", "position", "m.role", "m.content")
