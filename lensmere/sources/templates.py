"""Sentences made from structured knowledge records.

Records come as tables; each function adds ``text``.  The formats are fixed
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sentence(template: str) -> Column:
    """Fill {column} slots of a template from the row."""
    pieces = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if part:
            pieces.append(F.coalesce(F.col(part).cast("string"), F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*pieces)


# The sentence formats.
DRUG = ("{name} is a {category} used for {indication}. Typical dosage: {dosage}. "
        "Contraindications: {contraindications}. Common side effects: {side_effects}.")
DIAGNOSIS = ("{condition}: Diagnostic criteria - {criteria} Differential diagnosis includes: "
             "{differential}. Treatment approach: {treatment}")
TREATMENT = ("Treatment for {condition}: First-line therapy is {first_line}. "
             "Alternative options include {alternative}. Supportive care: {supportive}")
SYMPTOM = ("{symptom}: Urgent considerations include {urgent}. Common causes are {common}. "
           "Initial workup should include: {workup}")
INTERACTION = ("Drug interaction: {drug1} and {drug2} - Severity: {severity}. Effect: {effect}. "
               "Management: {management}")


def drug_texts(records: DataFrame) -> DataFrame:
    return records.withColumn("text", sentence(DRUG))


def diagnosis_texts(records: DataFrame) -> DataFrame:
    return records.withColumn("text", sentence(DIAGNOSIS))


def treatment_texts(records: DataFrame) -> DataFrame:
    return records.withColumn("text", sentence(TREATMENT))


def symptom_texts(records: DataFrame) -> DataFrame:
    """urgent and common are arrays."""
    joined = records.withColumn("urgent", F.array_join("urgent", ", ")).withColumn(
        "common", F.array_join("common", ", "))
    return joined.withColumn("text", sentence(SYMPTOM))


def interaction_texts(records: DataFrame) -> DataFrame:
    return records.withColumn("text", sentence(INTERACTION))


def rendered(records: DataFrame, template: str) -> DataFrame:
    """Texts of any other kind (guidelines, protocols, education) from a given template."""
    return records.withColumn("text", sentence(template))


def integrated_chunks(parts: list) -> DataFrame:
    """Knowledge tables as chunks with running ids; missing optional fields are null."""
    from lensmere.operators.corpus import union
    from lensmere.operators.running import running_count
    from lensmere.functions import text as X

    rows = union([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    numbered = running_count(
        rows, [], ["_part", "seq"], F.struct("_part", F.floor(F.col("seq") / 10_000)), "_no")
    return numbered.select(
        F.concat(F.lit("enhanced_"), F.lpad((F.col("_no") - 1).cast("string"), 6, "0")).alias("id"),
        "text", "source", "category", F.lit("N/A").alias("url"), "type",
        X.word_count(F.col("text")).alias("token_count"),
        *[F.col(c) for c in ("drug_name", "drug_category", "condition_name") if c in rows.columns])
