"""Symptoms, durations, severity and emergencies found by lexicon.

Matching happens inside each row: the lexicon is a constant array, so a table
of messages needs neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lensmere.functions import lexicons as L
from lensmere.functions import text as X


def lexicon_array(lexicon: dict) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(category).alias("category"),
                 F.lit(term).alias("term"))
        for i, (category, term) in enumerate(L.flatten(lexicon))
    ])


def lexicon_hits(low: Column, lexicon: dict) -> Column:
    """Entries of the lexicon found inside the lower-cased text, in lexicon order."""
    return F.filter(lexicon_array(lexicon), lambda e: F.contains(low, e["term"]))


def rule_entities(c: Column) -> Column:
    """One entity per symptom keyword, at its first position."""
    return X.bind(F.lower(c), lambda low: F.transform(
        lexicon_hits(low, L.SYMPTOM_KEYWORDS),
        lambda e: F.struct(
            e["no"].alias("no"), e["term"].alias("text"), e["category"].alias("category"),
            F.concat(F.lit("SYMPTOM_"), F.upper(e["category"])).alias("label"),
            (F.instr(low, e["term"]) - 1).alias("start"),
            (F.instr(low, e["term"]) - 1 + F.length(e["term"])).alias("stop"),
        ),
    ))


def merge_entities(entities: Column) -> Column:
    """Drop an entity that starts within 5 of a kept one whose text it contains.

    Kept entities come out ordered by start.  Entities of a named-entity model
    go in front of the rule entities before the call.
    """

    def step(kept: Column, e: Column) -> Column:
        repeated = F.exists(
            kept,
            lambda x: (F.abs(x["start"] - e["start"]) < 5)
            & F.contains(F.lower(e["text"]), F.lower(x["text"])),
        )
        return F.when(repeated, kept).otherwise(F.array_append(kept, e))

    kept = X.bind(entities, lambda es: F.aggregate(es, F.slice(es, 1, 0), step))
    by_start = F.array_sort(F.transform(
        kept, lambda e: F.struct(e["start"].alias("start"), e["no"].alias("no"), e.alias("e"))))
    return F.transform(by_start, lambda s: s["e"])


def _mentions(c: Column, number: int, pattern: str) -> Column:
    """Matches of one pattern with what lies before each of them."""
    both = F.struct(
        F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(0)).alias("found"),
        F.split(c, "(?i)" + pattern).alias("pieces"),
    )

    def total(texts: Column) -> Column:
        return F.aggregate(texts, F.lit(0), lambda s, p: s + F.length(p))

    def mention(m: Column, i: Column, b: Column) -> Column:
        start = total(F.slice(b["pieces"], 1, i + 1)) + total(F.slice(b["found"], 1, i))
        return F.struct(
            F.lit(number).alias("pattern"), m.alias("text"), start.alias("start"),
            (start + F.length(m)).alias("stop"))

    return X.bind(both, lambda b: F.transform(b["found"], lambda m, i: mention(m, i, b)))


def durations(c: Column) -> Column:
    """Every duration phrase with its offsets, pattern by pattern."""
    return X.bind(c, lambda t: F.concat(
        *[_mentions(t, i, p) for i, p in enumerate(L.DURATION_PATTERNS)]))


def severities(c: Column) -> Column:
    return X.bind(F.lower(c), lambda low: F.transform(
        lexicon_hits(low, L.SEVERITY_KEYWORDS),
        lambda e: F.struct(e["term"].alias("text"), e["category"].alias("severity"),
                           (F.instr(low, e["term"]) - 1).alias("start")),
    ))


def normal_category(text: Column, category: Column) -> Column:
    return X.first_rule(
        F.lower(text), L.NORMALIZE_RULES,
        F.when(X.or_empty(category) != "", category).otherwise(F.lit("other")))


def extraction(df: DataFrame, text: str = "text") -> DataFrame:
    """The whole record: cleaned text, merged entities, durations, severities."""
    clean = df.withColumn("cleaned_text", X.squeezed(X.or_empty(F.col(text))))
    c = F.col("cleaned_text")
    return clean.select(
        "*", merge_entities(rule_entities(c)).alias("symptoms"),
        durations(c).alias("durations"), severities(c).alias("severities"),
    ).withColumn("entities_count", F.size("symptoms"))


def _affirmed(low: Column, term: Column) -> Column:
    """Occurrences of the term that no negation word precedes closely."""

    def count(pieces: Column) -> Column:
        # Four pieces back reach further than the window: terms have 4+ characters.
        def affirmed(i: Column) -> Column:
            near = F.slice(pieces, F.greatest(F.lit(1), i - 3), F.least(i, F.lit(4)))
            before = F.aggregate(
                F.slice(near, 2, 4), F.element_at(near, 1),
                lambda text, piece: F.concat(text, term, piece))
            tail = F.right(before, F.lit(L.NEGATION_WINDOW_CHARS))
            return ~X.bind(X.words(tail), lambda seen: F.exists(
                F.slice(
                    seen, F.greatest(F.lit(1), F.size(seen) - L.NEGATION_WINDOW_TOKENS + 1),
                    F.lit(L.NEGATION_WINDOW_TOKENS)),
                lambda w: w.isin(L.NEGATIONS)))

        positions = F.sequence(F.lit(1), F.size(pieces) - 1)
        return F.when(F.size(pieces) < 2, F.lit(0)).otherwise(
            F.size(F.filter(positions, affirmed)))

    return X.bind(F.split(low, F.concat(F.lit("\\Q"), term, F.lit("\\E"))), count)


def emergencies(c: Column) -> Column:
    """Array of (category, term, hits, weight) for terms with an affirmed occurrence."""
    weight_10, weight_7 = L.EMERGENCY_WEIGHT_10, L.EMERGENCY_WEIGHT_7
    counted = X.bind(F.lower(c), lambda low: F.transform(
        lexicon_hits(low, L.EMERGENCY_KEYWORDS),
        lambda e: F.struct(
            e["category"].alias("category"), e["term"].alias("term"),
            _affirmed(low, e["term"]).alias("hits"),
            F.when(e["term"].isin(weight_10), 10).when(e["term"].isin(weight_7), 7)
            .otherwise(L.EMERGENCY_WEIGHT_OTHER).alias("weight"),
        ),
    ))
    return F.filter(counted, lambda e: e["hits"] > 0)


def severity_score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda s, e: s + e["hits"] * e["weight"])


def emergency_level(score: Column) -> Column:
    level = F.lit("LOW")
    for at_least, name in reversed(L.EMERGENCY_LEVELS):
        level = F.when(score >= at_least, F.lit(name)).otherwise(level)
    return level
