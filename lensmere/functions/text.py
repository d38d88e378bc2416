"""Text expressions, all built from Spark's own functions.

Whitespace and word characters follow Unicode, spelled out as character
classes so that every engine reads them alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lensmere.functions import lexicons as L

# The characters that separate words, and those that form them.
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]"
)
NOT_WS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
INDEX_TOKEN = WORD + r"{2,}"
KEYWORD_QUERY_TOKEN = r"[a-z][a-z\-']+"
EXPLANATION_TOKEN = r"[a-z0-9][a-z0-9\-]{2,}"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeezed(c: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{NOT_WS}+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_empty(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    Inside a lambda an outer expression is evaluated again for every element;
    binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(c: Column, terms: list) -> Column:
    """One pass over the text for all terms."""
    if len(terms) == 1:
        return F.contains(c, F.lit(terms[0]))
    return c.rlike("|".join(re.escape(t) for t in terms))


def first_rule(c: Column, rules: list, default: Column) -> Column:
    """The label of the first (label, terms) rule with a term inside the text."""
    out = default
    for label, terms in reversed(rules):
        out = F.when(contains_any(c, terms), F.lit(label)).otherwise(out)
    return out


def whole_words(pattern: str) -> str:
    """A search pattern that matches only between non-word characters."""
    return f"(?:^|{NOT_WORD})(?:{pattern})(?:$|{NOT_WORD})"


def word_start(pattern: str) -> str:
    return f"(?:^|{NOT_WORD})(?:{pattern})"


def clean_markup(c: Column) -> Column:
    """Collapse whitespace, drop tags, drop unusual characters - in this order."""
    flat = squeezed(c)
    bare = F.regexp_replace(flat, "<[^>]+>", "")
    return F.regexp_replace(bare, r"""[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}.,;:!?()\-'"]""", "")


def token_estimate(c: Column, at_least: int = 0) -> Column:
    """About four characters per token."""
    return F.greatest(F.lit(at_least), F.floor(F.length(c) / F.lit(4)).cast("int"))


def index_tokens(c: Column, stopwords: list | None = None) -> Column:
    """Lower-cased tokens of two or more word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(c), F.lit(INDEX_TOKEN), F.lit(0))
    stop = L.INDEX_STOPWORDS if stopwords is None else stopwords
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def keyword_query(c: Column) -> Column:
    """Question text reduced to its content words, or the question itself."""
    found = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(KEYWORD_QUERY_TOKEN), F.lit(0))
    kept = F.filter(
        found, lambda t: ~t.isin(L.KEYWORD_QUERY_STOPWORDS) & (F.length(t) > 2)
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(or_empty(c))


def explanation_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(
        F.lower(squeezed(or_empty(c))), F.lit(EXPLANATION_TOKEN), F.lit(0)
    )
    return F.filter(
        found, lambda t: ~t.isin(L.EXPLANATION_STOPWORDS) & ~t.rlike("^[0-9]+$")
    )


def contextual_text(context: Column, source: Column, category: Column, question: Column,
                    text: Column) -> Column:
    """Where a passage comes from, followed by the passage."""
    head = F.concat_ws(" | ", *[non_empty(c) for c in (context, source, category, question)])
    return F.when(head != "", F.concat(head, F.lit(" . "), or_empty(text))).otherwise(
        or_empty(text)
    )


def contextual_embedding_text(context: Column, text: Column) -> Column:
    """Generated context in front of the passage, stray separators stripped."""
    joined = F.concat(context, F.lit(" | "), or_empty(text))
    return F.when(
        or_empty(context) != "", F.regexp_replace(joined, r"^[ |]+|[ |]+$", "")
    ).otherwise(or_empty(text))


def snippet(c: Column, limit: int = 400) -> Column:
    """At most ``limit`` characters, ending at a sentence if one ends late enough."""
    def ended(head: Column) -> Column:
        flipped = F.reverse(head)

        def last(mark: str) -> Column:
            at = F.instr(flipped, " " + mark)
            return F.when(at > 0, F.length(head) - at - 1).otherwise(F.lit(-1))

        return bind(F.greatest(last("."), last("?"), last("!")), lambda cut: F.when(
            (F.length(c) > limit) & (cut >= limit // 3),
            F.substring(head, F.lit(1), cut + 1)).otherwise(head))

    return bind(trimmed(F.substring(c, 1, limit)), ended)


def split_prompt(c: Column, marker: str) -> Column:
    """A prompt cut at a marker into its system and its user part."""
    at = F.instr(c, marker)
    return F.when(at > 0, F.struct(
        trimmed(F.substring(c, F.lit(1), at - 1)).alias("system"),
        trimmed(F.substring(c, at, F.length(c))).alias("user"),
    )).otherwise(F.struct(F.lit("").alias("system"), c.alias("user")))


def percent(c: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def shortened(c: Column, limit: Column | int) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.concat(
        F.regexp_replace(F.substring(c, F.lit(1), limit), f"{WS}+$", ""), F.lit("...")
    )
    return F.when(F.length(c) > limit, cut).otherwise(c)


def strip_filler_closer(c: Column) -> Column:
    """Drop a formulaic last sentence if eight words or more remain."""
    body = F.regexp_replace(or_empty(c), f"{WS}+$", "")
    start = F.length(
        F.regexp_extract(body, rf"(?s)^(.*[.!?]{WS}+)", 1)
    )
    last = F.lower(F.substring(body, start + 1, F.length(body)))
    kept = F.regexp_replace(F.substring(body, F.lit(1), start), f"{WS}+$", "")
    return F.when(
        contains_any(last, L.FILLER_CLOSERS) & (word_count(kept) >= 8), kept
    ).otherwise(or_empty(c))


def json_text_field(c: Column, keys: list) -> Column:
    """First non-blank string among the keys of a JSON object, else null."""
    picked = [
        non_empty(trimmed(F.get_json_object(c, f"$.{key}"))) for key in keys
    ]
    return F.when(c.rlike(r"(?s)^\s*\{.*\}\s*$"), F.coalesce(*picked))


def light_cleanup(c: Column) -> Column:
    """Cleanup of a streamed reply that keeps its markdown and line breaks."""
    text = trimmed(or_empty(c))
    text = F.coalesce(
        json_text_field(text, L.REPLY_KEYS), text
    )
    text = F.regexp_replace(
        text, L.REPLY_FIELD, ""
    )
    text = F.regexp_replace(text, L.REPLY_HEADER, "")
    text = trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    quoted = (F.length(text) > 1) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    text = F.when(
        quoted, trimmed(F.substring(text, F.lit(2), F.length(text) - 2))
    ).otherwise(text)
    return F.regexp_replace(text, "!+", ".")


def heavy_cleanup(c: Column, collapse_repeats: bool = True) -> Column:
    """Flatten a structured reply to one line of plain prose."""
    raw = trimmed(or_empty(c))
    text = F.regexp_replace(raw, L.HEAVY_FIELD, "")
    text = F.regexp_replace(text, L.HEAVY_ANY_FIELD, "")
    text = F.coalesce(
        json_text_field(
            text,
            L.REPLY_KEYS_LONG,
        ),
        text,
    )
    text = F.regexp_replace(
        text,
        L.HEAVY_HEADER,
        "",
    )
    text = F.regexp_replace(text, L.CODE_BLOCK, "")
    text = F.regexp_replace(text, L.BOLD, "$1")
    text = F.regexp_replace(text, L.ITALIC, "$1")
    text = squeezed(text)
    text = F.regexp_replace(text, '^"+|"+$', "")
    if collapse_repeats:
        text = F.regexp_replace(
            text, L.REPEATED_PHRASE, "$1 "
        )
    return F.when(text == "", F.substring(squeezed(raw), 1, 2000)).otherwise(text)


def labelled_line(c: Column, label: str) -> Column:
    """What follows ``LABEL:`` up to the end of the line, or null."""
    found = trimmed(F.regexp_extract(c, rf"(?i){label}\s*:\s*([^\n]+)", 1))
    return non_empty(found)


def hypothetical_specific(c: Column) -> Column:
    """The concrete line of a generated hypothetical, or the whole prose."""
    labelled = labelled_line(c, "SPECIFIC")
    labelled = F.when(F.length(labelled) > 15, F.substring(labelled, 1, 400))
    plain = F.regexp_replace(or_empty(c), L.HYPOTHETICAL_LABELS, " ")
    plain = F.regexp_replace(plain, L.PROMPT_ECHO, "")
    plain = F.regexp_replace(plain, L.OPENING_FILLER, "")
    plain = squeezed(plain)
    return F.coalesce(labelled, F.when(F.length(plain) > 25, F.substring(plain, 1, 400)))


def hypothetical_broad(c: Column) -> Column:
    labelled = labelled_line(c, "BROAD")
    return F.when(F.length(labelled) > 15, F.substring(labelled, 1, 400))


def summary_title(c: Column) -> Column:
    return F.substring(or_empty(labelled_line(c, "TITLE")), 1, 80)


def summary_body(c: Column) -> Column:
    body = non_empty(F.regexp_extract(c, r"(?is)OVERVIEW\s*:\s*(.+)", 1))
    return F.substring(squeezed(F.coalesce(body, c)), 1, 1500)


def generated_context(c: Column) -> Column:
    """Post-processing of a generated passage context."""
    flat = F.translate(trimmed(or_empty(c)), "\n", " ")
    return F.substring(
        F.when(
            F.contains(flat, F.lit("</think>")),
            trimmed(F.substring_index(flat, "</think>", -1)),
        ).otherwise(flat),
        1, 240,
    )


def pretty_label(c: Column) -> Column:
    known = F.lit(None).cast("string")
    for raw, label in L.FINDING_LABELS.items():
        known = F.when(c == raw, F.lit(label)).otherwise(known)
    return F.coalesce(known, F.initcap(trimmed(F.translate(c, "_", " "))))


def template(text: str, values: dict) -> Column:
    """Fill {NAME} slots of a template; missing values become empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), or_empty(value))
    return out


def data_url_bytes(c: Column) -> Column:
    """Decode base64, with or without a data URL in front."""
    payload = F.when(F.startswith(c, F.lit("data:")), F.split_part(c, F.lit(","), F.lit(2)))
    return F.try_to_binary(F.coalesce(payload, c), F.lit("base64"))


def hash32(c: Column) -> Column:
    """First 32 bits of the MD5 as a non-negative integer."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
