"""Expert gate and evidence pooled over expert lenses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lensmere.functions import lexicons as L
from lensmere.functions import text as X
from lensmere.operators import fusion
from lensmere.operators.models import Embedder, embed_constants

PER_EXPERT, POOLED = 4, 12


def prototype_similarity(texts: list):
    """Similarities of a vector to a few fixed texts, as one array per row."""
    prototypes = embed_constants(texts)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def similar(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        scores = flat.reshape(len(vectors), prototypes.shape[1]) @ prototypes.T
        offsets = pa.array(range(0, scores.size + 1, scores.shape[1]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))

    return similar


def gate(queries: DataFrame, embedder: Embedder, roster: list = L.EXPERTS,
         top_k: int = L.GATE_TOP_K, temperature: float = L.GATE_TEMPERATURE,
         floor: float = L.GATE_FLOOR) -> DataFrame:
    """Choose experts per query: (query_id, position, expert, lens, weight).

    ``queries``: (query_id, text, modality).  The roster is short and fixed, so
    a query's whole gate is computed within its row; nothing is shuffled.
    """
    q = X.trimmed(X.or_empty(F.col("text")))
    q = F.when(q == "", F.lit(L.GATE_EMPTY_QUERY)).otherwise(q)
    sims = prototype_similarity([e[2] for e in roster])
    default = next((i for i, e in enumerate(roster) if e[5]), None)
    base = queries.withColumn("_q", q).withColumn("_sims", sims(embedder(F.col("_q"))))

    def boosted(low: Column) -> Column:
        scores = []
        for i, (_, _, _, keywords, modality, _) in enumerate(roster):
            score = F.round(F.get("_sims", F.lit(i)), 6)
            if keywords:
                score = score + F.when(
                    X.contains_any(low, keywords), L.GATE_KEYWORD_BOOST).otherwise(0.0)
            if modality:
                score = score + F.when(
                    F.col("modality") == modality, L.GATE_MODALITY_BOOST).otherwise(0.0)
            scores.append(score)
        return F.array(*scores)

    def softmax_weights(scores: Column) -> Column:
        spread = F.lit(max(1e-6, temperature))
        powers = X.bind(F.array_max(scores), lambda top: F.transform(
            scores, lambda s: F.exp((s - top) / spread)))
        return X.bind(powers, lambda ps: X.bind(
            F.aggregate(ps, F.lit(0.0), lambda a, x: a + x),
            lambda total: F.transform(ps, lambda x: F.round(x / total, 9))))

    def by_weight(weights: Column) -> Column:
        """Places in the roster, heaviest first; ties keep the roster's order."""
        keyed = F.transform(weights, lambda w, i: F.struct((-w).alias("w"), i.alias("i")))
        return F.transform(F.array_sort(keyed), lambda s: s["i"])

    def chosen(weights: Column, order: Column) -> Column:
        fallback = F.lit(default) if default is not None else F.element_at(order, 1)
        strong = F.filter(F.slice(order, 1, top_k), lambda i: F.get(weights, i) >= floor)
        return X.bind(strong, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(fallback)))

    def with_modality(picked: Column) -> Column:
        out = picked
        for i, expert in enumerate(roster):
            if expert[4]:
                missing = (F.col("modality") == expert[4]) & ~F.array_contains(picked, F.lit(i))
                out = F.when(
                    missing, F.concat(F.array(F.lit(i)), F.slice(picked, 1, top_k - 1))
                ).otherwise(out)
        return out

    def shares(weights: Column, picked: Column) -> Column:
        total = F.aggregate(picked, F.lit(0.0), lambda a, i: a + F.get(weights, i))
        return X.bind(total, lambda t: F.transform(picked, lambda i: F.struct(
            i.alias("i"), F.round(F.get(weights, i) / t, 3).alias("weight"))))

    def route(weights: Column) -> Column:
        picked = X.bind(by_weight(weights), lambda order: chosen(weights, order))
        return X.bind(X.bind(picked, with_modality), lambda p: shares(weights, p))

    routed = X.bind(
        X.bind(X.bind(F.lower("_q"), boosted), softmax_weights), route)
    names = F.array(*[F.lit(e[0]) for e in roster])
    lenses = F.array(*[F.lit(e[1]) for e in roster])
    return base.select(
        "query_id", F.col("text").alias("query"), F.posexplode(routed).alias("position", "_r"),
    ).select(
        "query_id", "query", "position", F.get(names, F.col("_r.i")).alias("expert"),
        F.get(lenses, F.col("_r.i")).alias("lens"), F.col("_r.weight").alias("weight"),
    )


def lens_queries(routed: DataFrame) -> DataFrame:
    """One reformulated query per chosen expert."""
    return routed.select(
        "query_id", "position", "expert",
        F.replace("lens", F.lit("{q}"), F.col("query")).alias("text"))


def gather(routed: DataFrame, docs: DataFrame, embedder: Embedder,
           per_expert: int = PER_EXPERT, pooled: int = POOLED,
           order: str = "score") -> DataFrame:
    """Evidence of all chosen experts, first occurrence kept, best ``pooled`` per query.

    ``order='score'`` sorts by dense similarity (documents only the lexical
    arm found count as 0); ``order='fused'`` keeps the fused order.
    """
    lenses = lens_queries(routed)
    # One search answers all lenses of all queries.
    # It reads them several times, hence persist: one short row per query and expert.
    keyed = lenses.withColumn("lens_id", F.concat_ws("#", "query_id", "position")).persist()
    hits = fusion.top(fusion.hybrid(
        keyed.select(F.col("lens_id").alias("query_id"), "text"), docs, embedder, per_expert,
    ), per_expert)
    back = hits.withColumnRenamed("query_id", "lens_id").join(
        keyed.select("lens_id", "query_id", "position", "expert"), "lens_id")
    first = W.partitionBy("query_id", "doc_id").orderBy("position", "rank")
    unique = back.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    by = F.col("score").desc() if order == "score" else F.col("fused").desc()
    best = W.partitionBy("query_id").orderBy(by, "position", "rank")
    return (
        unique.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= pooled)
        .select("query_id", "doc_id", "expert", "position", "rank", "score", "place")
    )


def directive(routed: DataFrame) -> DataFrame:
    """(query_id, directive): the chosen experts and their shares in words."""
    part = F.concat("expert", F.lit(" ("), X.percent(F.col("weight")), F.lit(")"))
    return routed.select("query_id", "position", part.alias("part")).groupBy("query_id").agg(
        F.concat(
            F.lit(L.DIRECTIVE_HEAD),
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("position", "part"))),
                lambda s: s["part"]), ", "),
            F.lit(L.DIRECTIVE_TAIL),
        ).alias("directive"))


def softmax(df: DataFrame, by: str, score: str, temperature: float) -> DataFrame:
    """Softmax weights of scores within a key."""
    w = W.partitionBy(by)
    shifted = F.exp((F.col(score) - F.max(score).over(w)) / F.lit(temperature))
    return df.withColumn("_e", shifted).withColumn(
        "weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")
