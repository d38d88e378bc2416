"""Terms of a vocabulary found in texts: one automaton per worker instead of an alternation per lexicon.

A vocabulary is a table with a column ``term``, given by path, or a list.  The automaton (a trie with fail
links) reads every text once, whatever the number of terms, and reports all occurrences, overlapping ones
too, with their offsets in characters.  Texts are lower-cased by Spark before, so offsets are those of the
lower-cased text and agree with its other functions.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Characters of the terms that one automaton holds; a larger vocabulary takes a pass per block of so many.
BLOCK_CHARS = 32 << 20

HITS = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@functools.lru_cache(maxsize=8)
def _automaton(terms: tuple):
    """Built at the first text a worker meets, kept for the following ones."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for no, term in enumerate(terms):
        if term and term not in machine:
            machine.add_word(term, (no, len(term)))
    machine.make_automaton()
    return machine if len(machine) else None


def _word(c: str) -> bool:
    """Letters, digits and the underscore, as the text functions have them: no marks."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _scan(machine, text: str):
    if machine is None or not text:
        return
    for end, (no, size) in machine.iter(text):
        yield end + 1 - size, no, end + 1


def occurrences(low: Column, terms: list, word_start: bool = False) -> Column:
    """Array of (no, start, stop) of every occurrence, by start, then by the term's number.

    With ``word_start`` only those at the beginning of a word, as for vocabularies of word beginnings.  Terms
    are numbered as given; of equal ones the first counts; empty ones occur nowhere.  A null text has none.
    """
    held = tuple(terms)

    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        machine = _automaton(held)
        no, start, stop, bounds = [], [], [], [0]
        for text in texts.to_pylist():
            hits = sorted(_scan(machine, text))
            if word_start:
                hits = [h for h in hits if not h[0] or not _word(text[h[0] - 1])]
            for a, n, b in hits:
                start.append(a)
                no.append(n)
                stop.append(b)
            bounds.append(len(no))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (no, start, stop)], ["no", "start", "stop"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)

    return found(low)


def any_word_start(low: Column, terms: list) -> Column:
    """Does a word of the text begin with one of the terms?  Stops at the first that does."""
    held = tuple(terms)

    @F.arrow_udf(T.BooleanType())
    def has(texts: pa.Array) -> pa.Array:
        machine = _automaton(held)
        return pa.array([any(not a or not _word(text[a - 1]) for a, _, _ in _scan(machine, text)) for text in texts.to_pylist()], pa.bool_())

    return has(low)


def vocabulary(spark: SparkSession, path: str, column: str = "term") -> list:
    """The terms of a table, lower-cased, distinct and in order; for vocabularies of one block."""
    blocks = list(blocks_of(spark.read.parquet(path).select(F.col(column).alias("term"))))
    if len(blocks) > 1:
        raise ValueError(f"{path} takes {len(blocks)} blocks; use mentions()")
    return blocks[0] if blocks else []


def blocks_of(terms: DataFrame, chars: int = BLOCK_CHARS):
    """Lists of terms of a bounded size each, one after the other."""
    own = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct()
    size = own.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    n = math.ceil(size / chars)
    for b in range(n):
        block = own.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == b).toArrow()["term"].to_pylist()
        if block:
            yield sorted(block)


def mentions(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", word_start: bool = False,
             chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, term, start, stop): every occurrence of every term of a table (term) in the texts.

    Nothing is joined: texts are read once per block of terms, and a text's occurrences leave the task as
    rows, so a term that is in every text is no burden.
    """
    low = texts.select(key, F.lower(text).alias("low"))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for block in blocks_of(terms, chars):
        part = low.mapInArrow(_rows(texts.sparkSession.sparkContext.broadcast(tuple(block)), word_start), f"{key} {kind}, term string, start int, stop int")
        out = part if out is None else out.union(part)
    if out is None:
        return low.select(key, F.lit("").alias("term"), F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    return out


def _rows(shared, word_start: bool):
    def run(batches):
        held = shared.value
        machine = _automaton(held)
        for batch in batches:
            row, no, start, stop = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, n, b in sorted(_scan(machine, text)):
                    if not word_start or not a or not _word(text[a - 1]):
                        row.append(i)
                        no.append(n)
                        start.append(a)
                        stop.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array([held[n] for n in no], pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                names=[batch.schema.names[0], "term", "start", "stop"])

    return run
