"""Scope gate, query classes, intent, specialties and token budgets.

All are column expressions: a whole table of messages is classified in one
projection, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import terms as vocabularies
from lensmere.operators.models import Embedder, embed_constants

GAP = X.NOT_WORD


def gap_pattern(before: str, longest: int, after: str) -> str:
    """``before`` and ``after`` as whole words, at most ``longest`` characters apart."""
    gap = f"(?:{GAP}|{GAP}[^\\n]{{0,{longest - 2}}}{GAP})"
    return X.whole_words(f"(?:{before}){gap}(?:{after})")


def out_of_scope_patterns() -> list:
    """(reason, pattern) in order of precedence."""
    return [
        (reason, gap_pattern(first, gap, second) if gap is not None
         else X.word_start(first) if reason in L.OPEN_ENDED_RULES else X.whole_words(first))
        for reason, first, gap, second in L.OUT_OF_SCOPE_RULES
    ]


HISTORY = X.word_start(L.HISTORY_PATTERN) + f"(?!{L.HISTORY_MEDICAL_TOPICS})"


def default_vocabulary() -> list:
    return sorted({term for _, term in L.flatten(L.SYMPTOM_KEYWORDS) if len(term) >= 4})


def scope(df: DataFrame, text: str = "text", has_image: Column | None = None,
          in_conversation: Column | None = None, name: str = "assistant",
          vocabulary: list | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Add ``kind``, ``confidence`` and ``reason``.

    ``vocabulary`` has the beginnings of medical words (``terms.vocabulary`` reads
    them from a table); by default the longer terms of the symptom lexicon.

    kind is greeting, thanks, farewell, identity, out_of_scope or medical; the
    first rule that applies decides.  Without an embedder ambiguous messages
    are let through.
    """
    has_image = F.lit(False) if has_image is None else has_image
    in_conversation = F.lit(False) if in_conversation is None else in_conversation
    prepared = df.withColumn("_t", X.trimmed(X.or_empty(F.col(text)))).withColumn(
        "_low", F.lower("_t")).withColumn("_n", X.word_count(F.col("_low")))
    t, low, n = F.col("_t"), F.col("_low"), F.col("_n")

    def whole(pattern: str) -> Column:
        return t.rlike("(?i)^(?:" + pattern.replace("{name}", name) + ")$")

    identity = low.rlike(L.IDENTITY_PATTERN.replace("{name}", name)) | low.rlike(
        f"(?:{L.IDENTITY_PATTERN_WORD_END})(?:$|{X.NOT_WORD})")
    rules = [
        (has_image, "medical", 1.0, "image attached"),
        (t == "", "greeting", 1.0, "empty input"),
        ((n <= 7) & whole(L.HOW_ARE_YOU_PATTERN), "greeting", 1.0, "how-are-you"),
        ((n <= 7) & whole(L.GREETING_PATTERN), "greeting", 1.0, "greeting"),
        ((n <= 7) & whole(L.THANKS_PATTERN), "thanks", 1.0, "thanks"),
        ((n <= 7) & whole(L.FAREWELL_PATTERN), "farewell", 1.0, "farewell"),
        ((n <= 10) & identity, "identity", 1.0, "identity"),
        (vocabularies.any_word_start(low, vocabulary if vocabulary is not None else default_vocabulary()),
         "medical", 1.0, "medical vocabulary"),
    ]
    for reason, pattern in out_of_scope_patterns():
        hit = low.rlike(pattern)
        if reason == "trivia":
            hit = hit | low.rlike(HISTORY)
        rules.append((hit, "out_of_scope", 0.95, f"non-medical pattern: {reason}"))
    continues = low.rlike(f"^(?:{L.CONTINUATION_PATTERN})(?:$|{X.NOT_WORD})")
    rules.append((in_conversation & ((n <= 12) | continues), "medical", 0.6,
                  "conversational continuation"))

    rules.append((F.lit(False), "out_of_scope", 0.7, "embedding margin"))
    rules.append((F.lit(True), "medical", 0.5, "default lenient"))
    margin_rule, lenient_rule = len(rules) - 1, len(rules)

    # Only the number of the first rule that applies is computed from the text.
    number = F.lit(lenient_rule)
    for i, (hit, *_) in reversed(list(enumerate(rules, start=1))):
        number = F.when(hit, F.lit(i)).otherwise(number)
    staged = prepared.withColumn("_rule", number)
    rule = F.col("_rule")
    if embedder is not None:
        staged = staged.withColumn("_open", (rule == lenient_rule) & (n >= 4))
        # Only undecided messages carry text into the embedder.
        staged = staged.withColumn("_vector", embedder(F.when(F.col("_open"), F.col(text))))
        staged = staged.withColumn(
            "_medical", F.round(nearest_anchor(L.MEDICAL_ANCHORS)(F.col("_vector")), 6)
        ).withColumn("_other", F.round(nearest_anchor(L.OTHER_ANCHORS)(F.col("_vector")), 6))
        refused = (
            F.col("_open")
            & (F.round(F.col("_other") - F.col("_medical"), 6) > L.ANCHOR_MARGIN)
            & (F.col("_medical") < L.ANCHOR_MEDICAL_CEILING)
        )
        rule = F.when(refused, F.lit(margin_rule)).otherwise(rule)

    def of_rule(position: int) -> Column:
        return F.element_at(F.array(*[F.lit(r[position]) for r in rules]), rule)

    return staged.select(
        *df.columns, of_rule(1).alias("kind"), of_rule(2).alias("confidence"),
        of_rule(3).alias("reason"))


def nearest_anchor(texts: list):
    """Highest similarity of a vector to a few fixed texts, as an Arrow function."""
    anchors = embed_constants(texts)

    @F.arrow_udf(T.DoubleType())
    def nearest(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 1))
        if matrix.shape[1] != anchors.shape[1]:
            return pa.array(np.zeros(len(vectors)))
        return pa.array((matrix @ anchors.T).max(axis=1))

    return nearest


def specialties(c: Column) -> Column:
    """Names of the specialties with a keyword in the text, in lexicon order."""
    low = F.lower(c)
    return F.filter(
        F.array(*[F.when(X.contains_any(low, terms), F.lit(name))
                  for name, terms in L.SPECIALTIES.items()]),
        lambda s: s.isNotNull(),
    )


def query_type(c: Column, symptom_count: Column | None = None) -> Column:
    default = F.lit("general")
    if symptom_count is not None:
        default = F.when(symptom_count > 0, F.lit("differential_diagnosis")).otherwise(default)
    return X.first_rule(F.lower(c), L.QUERY_TYPE_RULES, default)


def intent(c: Column) -> Column:
    return X.first_rule(F.lower(X.or_empty(c)), L.INTENT_RULES, F.lit("qa"))


def complexity(c: Column) -> Column:
    low = X.trimmed(F.lower(c))
    n = X.word_count(c)
    fact = F.lit(False)
    for prefix in L.COMPLEXITY_FACT_PREFIXES:
        fact = fact | F.startswith(low, F.lit(prefix))
    questions = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    multipart = (n > 25) | (questions > 1) | X.contains_any(low, L.COMPLEXITY_MULTIPART)
    tail = F.when(multipart, F.lit("complex_medical")).otherwise(F.lit("explanation"))
    return (
        F.when((n <= 4) & low.rlike(X.whole_words(L.COMPLEXITY_GREETING)), F.lit("greeting"))
        .when(fact & (n < 10), F.lit("simple_fact"))
        .otherwise(X.first_rule(low, L.COMPLEXITY_RULES, tail))
    )


def token_budget(c: Column, kind: Column, context_length: Column) -> Column:
    base = F.lit(L.TOKEN_BASE_DEFAULT)
    for name, tokens in L.TOKEN_BASE.items():
        base = F.when(kind == name, F.lit(tokens)).otherwise(base)
    n = X.word_count(c)
    factor = F.lit(L.TOKEN_LENGTH_LONG)
    for below, value in reversed(L.TOKEN_LENGTH_STEPS):
        factor = F.when(n < below, F.lit(value)).otherwise(factor)
    # Longer context than the step earns the same factor, whatever its length.
    above, boost = L.TOKEN_CONTEXT_STEP
    factor = factor * F.when(context_length > above, F.lit(boost)).otherwise(F.lit(1.0))
    return F.greatest(
        F.lit(L.TOKEN_MIN), F.least(F.floor(base * factor), F.lit(L.TOKEN_MAX))).cast("int")


def is_smalltalk(c: Column) -> Column:
    t = F.lower(X.trimmed(X.or_empty(c)))
    short = (X.word_count(t) <= 3) & ~X.contains_any(t, L.SHORT_QUERY_MEDICAL_WORDS)
    return (F.length(t) <= 2) | t.rlike(L.SMALLTALK_PATTERN) | short


def is_identity(c: Column, name: str = "assistant") -> Column:
    t = F.lower(X.trimmed(X.or_empty(c)))
    phrases = L.IDENTITY_PHRASES + [f"what is {name}", f"who is {name}"]
    return X.contains_any(t, phrases)


def is_healthcare(c: Column) -> Column:
    t = F.lower(X.or_empty(c))
    return X.contains_any(t, L.HEALTHCARE_TERMS) | ~X.contains_any(
        t, L.NON_HEALTHCARE_MARKERS)


def greeting_tone(c: Column) -> Column:
    t = F.lower(X.trimmed(X.or_empty(c)))
    playful = X.contains_any(t, L.TONE_PLAYFUL) | (
        F.contains(t, F.lit("?")) & F.contains(t, F.lit("up")))
    friendly = X.contains_any(t, L.TONE_FRIENDLY) | (
        F.contains(t, F.lit("!")) & (X.word_count(t) <= 4))
    tired = X.contains_any(t, L.TONE_TIRED)
    return (
        F.when(playful, "playful").when(tired, "tired").when(friendly, "friendly")
        .otherwise("plain")
    )


def asks_for_sources(c: Column) -> Column:
    return X.contains_any(F.lower(X.trimmed(X.or_empty(c))), L.SOURCE_REQUEST_PHRASES)


def interaction_flags(c: Column) -> Column:
    low = F.lower(X.or_empty(c))
    return F.filter(F.array(*[F.lit(f) for f in L.DRUG_INTERACTION_FLAGS]),
                    lambda f: F.contains(low, f))


def disclaimer(kind: Column, specialty_names: Column) -> Column:
    d = L.DISCLAIMERS
    heart_or_brain = F.array_contains(specialty_names, "cardiology") | F.array_contains(
        specialty_names, "neurology")
    tail = (
        F.when(kind == "differential_diagnosis", d["differential_diagnosis"])
        .when(kind == "treatment_planning", d["treatment_planning"])
        .when(kind == "drug_information", d["drug_information"])
        .when(heart_or_brain, d["cardio_neuro"])
        .otherwise(d["default"])
    )
    return F.concat(F.lit(L.DISCLAIMER_BASE), tail)


def retrieval_arm(complexity_class: Column, experts_enabled: bool = True,
                  hybrid_enabled: bool = True) -> Column:
    """Which search a message gets."""
    arm = "experts" if experts_enabled else ("hybrid" if hybrid_enabled else "dense")
    return F.when(complexity_class == "greeting", F.lit("none")).otherwise(F.lit(arm))
