"""Knowledge graphs from passages: symptoms, the conditions they suggest, the treatments that manage these.

A query's graph comes from its own text and its passages; the graph of a corpus merges what all passages
say, with ids made from type and name and weights that count the passages behind a node or an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lensmere.functions import text as X
from lensmere.operators import explain, symptoms

#: Categories whose passages name treatments.
MEDICATION_CATEGORIES = ("medications",)


def symptom_names(text: Column) -> Column:
    entities = symptoms.merge_entities(symptoms.rule_entities(X.squeezed(X.or_empty(text))))
    return F.transform(entities, lambda e: e["text"])


def _medication(category: Column, categories) -> Column:
    return F.lower(X.or_empty(category)).isin([c.lower() for c in categories])


def of_queries(responses: DataFrame, passages: DataFrame, categories=MEDICATION_CATEGORIES) -> DataFrame:
    """(query_id, nodes, edges): one graph per query.

    ``responses``: (query_id, text); ``passages``: (query_id, rank, text, category).  Conditions are those the
    response considers and the phrases of its first three passages, treatments the names in passages of a
    medication category.  A query has a bounded number of passages.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", _medication(F.col("category"), categories).alias("drugs"))))
    gathered = passages.groupBy("query_id").agg(ordered.alias("_p"))
    none = F.array().cast("array<string>")
    both = responses.select("query_id", "text").join(gathered, "query_id", "left").select(
        "query_id", symptom_names(F.col("text")).alias("s"),
        explain.condition_candidates(F.col("text"), F.coalesce(F.transform("_p", lambda p: p["text"]), none)).alias("c"),
        explain.treatment_candidates(F.coalesce(F.transform(F.filter("_p", lambda p: p["drugs"]), lambda p: p["text"]), none)).alias("t"))
    return both.select("query_id", explain.graph_nodes(F.col("s"), F.col("c"), F.col("t")).alias("nodes"),
                       explain.graph_edges(F.col("s"), F.col("c"), F.col("t")).alias("edges"))


def node_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.md5(F.lower(label)), 1, 12))


def _layers(passages: DataFrame, categories) -> DataFrame:
    """(s, c, t) of each passage on its own."""
    one = F.array(F.col("text"))
    drugs = F.when(_medication(F.col("category"), categories), one).otherwise(F.array().cast("array<string>"))
    return passages.select(symptom_names(F.col("text")).alias("s"), explain.condition_candidates(F.lit(""), one).alias("c"),
                           explain.treatment_candidates(drugs).alias("t"))


def nodes(passages: DataFrame, categories=MEDICATION_CATEGORIES) -> DataFrame:
    """(id, type, label, passages) over a corpus of (text, category).

    Names that differ in case only are one node, labelled by the first spelling.  Counted inside the tasks
    before the shuffle, so a name that a third of all passages hold is no burden.
    """
    def layer(column: str, most: int, kind: str) -> Column:
        return F.transform(F.slice(column, 1, most), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("label")))

    every = F.concat(layer("s", explain.MAX_SYMPTOMS, "symptom"), layer("c", explain.MAX_NODES, "condition"), layer("t", explain.MAX_NODES, "treatment"))
    # A passage counts once for a node, whatever its spellings: they are one array's neighbours, so no shuffle is needed.
    once = _layers(passages, categories).select(F.array_sort(F.transform(every, lambda n: F.struct(
        node_id(n["type"], n["label"]).alias("id"), n["type"].alias("type"), n["label"].alias("label")))).alias("ns"))
    first = F.transform("ns", lambda n, i: F.struct(n.alias("n"), ((i == 0) | (F.get("ns", i - 1)["id"] != n["id"])).cast("long").alias("new")))
    return once.select(F.explode(first).alias("x")).groupBy("x.n.id", "x.n.type").agg(
        F.min("x.n.label").alias("label"), F.sum("x.new").alias("passages"))


def edges(passages: DataFrame, categories=MEDICATION_CATEGORIES) -> DataFrame:
    """(source, target, label, weight) over a corpus: how many passages name both ends.

    A passage links its first five names of each side, as a query's graph does.
    """
    def links(a: str, a_kind: str, b: str, b_kind: str, label: str) -> Column:
        return F.flatten(F.transform(F.slice(a, 1, explain.MAX_EDGE_SIDE), lambda x: F.transform(F.slice(b, 1, explain.MAX_EDGE_SIDE), lambda y: F.struct(
            node_id(F.lit(a_kind), x).alias("source"), node_id(F.lit(b_kind), y).alias("target"), F.lit(label).alias("label")))))

    every = F.concat(links("s", "symptom", "c", "condition", "suggests"), links("c", "condition", "t", "treatment", "managed_by"))
    return _layers(passages, categories).select(F.explode(F.array_distinct(every)).alias("e")).groupBy(
        "e.source", "e.target", "e.label").agg(F.count("*").alias("weight"))


def around(edge_table: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each start (id): what a corpus suggests for it."""
    order = W.partitionBy("source").orderBy(F.col("weight").desc(), "target")
    found = edge_table.join(starts.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
