"""Messages derived from the conversations table.

The conversation texts are invented words, on which lexicons hardly ever
fire.  Two messages in three therefore get a phrase chosen by conversation
and turn in front of their own text; the table keeps the size of
``conversations`` and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lensmere.plans import sql as Q
from lensmere.tables import spread, table

PHRASES = [
    "hiya", "Good day", "hello, how are you doing?", "greetings", "thank you", "goodbye",
    "what is your name?", "what do you do", "are you human",
    "there is crushing chest pain and severe left arm pain since noon",
    "denies fever, no chest pain, but a cough for 4 days",
    "a seizure this morning, no seizure afterwards",
    "found unconscious after a fall, heavy bleeding at the temple",
    "terrible headache with confusion, about 3 weeks now, severe at night",
    "why does blood pressure rise, and what is hypertension?",
    "which dose is right for my age", "how to treat mild sunburn at home",
    "explain how anxiety and stress change sleep",
    "difference between bacteria and a virus, and when an antibiotic helps",
    "itchy skin rash with slight swelling, 6 days",
    "compose a poem about the sea", "debug my python script please",
    "who discovered radium", "is ethereum a good investment", "currency of Norway",
    "history of the steam engine", "history of medicine in short",
    "evaluate this integral for me", "crack a joke", "weather forecast for the weekend",
    "which smartphone has the best camera", "a recipe for onion soup",
    "what about my sister?", "go on", "how?",
    "vomiting, nausea and stomach pain for 5 hours, getting worse, with palpitations",
    "dull pain in the lower back, mild, since recently", "lately I feel dizzy and tired",
    "please show your sources", "diagnose me from my test results and medical records, drug dosage, prescription",
    "knee joint and muscle ache after running, past 3 months",
    "wheezing, can't breathe, shortness of breath, an asthma attack",
    "he spoke of suicidal thoughts and an overdose, wants to end it all",
    "not well, worn out... ugh", "what's new?", "describe what you can do in a kitchen",
    "ibuprofen versus aspirin, compare them", "insulin, glucose, hormone and diabetes questions",
    "scores of tonight's tournament matches",
    "lithium together with warfarin and multiple medications",
]
N = len(PHRASES)


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    c = spread(table(spark, sf, "conversations"))
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in PHRASES]),
        ((F.col("conv_id") * 31 + F.col("turn") * 7) % N + 1).cast("int"))
    mode = (F.col("conv_id") * 5 + F.col("turn")) % 3
    said = (
        F.when(mode == 0, F.col("text")).when(mode == 1, F.concat_ws("\n", phrase, F.col("text")))
        .otherwise(F.concat_ws(" ", phrase, F.col("text")))
    )
    return c.select("conv_id", "turn", "role", said.alias("text"))


SQL = f"""u AS (SELECT conv_id, turn, role,
  CASE (conv_id * 5 + turn) % 3 WHEN 0 THEN text
  WHEN 1 THEN concat_ws(chr(10), ({Q.array(PHRASES)})[(conv_id * 31 + turn * 7) % {N} + 1], text)
  ELSE concat_ws(' ', ({Q.array(PHRASES)})[(conv_id * 31 + turn * 7) % {N} + 1], text) END AS text
  FROM conversations)"""
