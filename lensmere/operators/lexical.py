"""Term statistics and BM25 search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lensmere.functions import text as X
from lensmere.operators.dense import SCORE_DIGITS, merge, rank
from lensmere.operators.running import running_count
from lensmere.operators.topk import BestPerQuery
from lensmere.session import SENT_AFTER, free_memory, staged
from lensmere.tables import even_keys, exists

# BM25 and vocabulary parameters.
K1, B, VOCABULARY_CAP = 1.5, 0.75, 200_000

# (query, term) pairs that may travel to every task; more go through a join.
MAX_BROADCAST_PAIRS = 2_000_000
BLOCK_ENTRIES = 4_000_000
# Queries whose best rows a scan keeps in order at a time; more go through cells.
MAX_SCANNED_QUERIES = 4_096
# Terms of a vocabulary that may travel to every task.
MAX_VOCABULARY = 500_000
# (query, term) pairs and queries of a block, documents and their postings of a share: a cell is one of each.
CELL_PAIRS, BLOCK_QUERIES, CELL_DOCS, CELL_POSTINGS = 1_000_000, 32_768, 65_536, 4_000_000
# Cells per core at least, and the bytes in a shuffle of a posting and of a row that is found.
CELLS_A_CORE, POSTING_BYTES, FOUND_BYTES = 2, 5, 15
# Documents of a cell that are scored first and then at a time, with at most so many postings; queries whose
# best are put in order at a time.
FIRST_DOCS, NEXT_DOCS, NEXT_POSTINGS, CELL_QUERIES = 2_048, 16_384, 800_000, 4_096
# Terms that are looked up for the documents in question only: so many at most, each in that share of the
# documents at least, and together below that share of what the query's last place needs.
SHARED_TERMS, SHARED_LEAST, SHARED_WEIGHT = 256, 1 / 256, 0.5
# (query, term) pairs of documents that a task spreads out at a time; each takes some 40 bytes.
BLOCK_PRODUCTS = 1_000_000
# Characters of a term that make its block where terms are numbered.
BEGINNING = 3


def tokens(docs: DataFrame, stopwords: list | None = None) -> DataFrame:
    """(doc_id, tokens) with stop words removed."""
    return docs.select("doc_id", X.index_tokens(X.or_empty(F.col("text")), stopwords)
                       .alias("tokens"))


def postings(toks: DataFrame) -> DataFrame:
    """(doc_id, term, tf); counted per task before the shuffle."""
    return (
        toks.select("doc_id", F.explode("tokens").alias("term"))
        .groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    )


def document_frequency(toks: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and occurrences overall.

    Each document gives its tokens and, marked, its distinct tokens, so both
    counts come from one scan and one shuffle.
    """
    marked = F.concat(
        F.transform("tokens", lambda t: F.struct(t.alias("t"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct("tokens"),
                    lambda t: F.struct(t.alias("t"), F.lit(1).alias("d"))))
    return toks.select(F.explode(marked).alias("m")).select(
        F.col("m.t").alias("term"), F.col("m.d").cast("bigint").alias("d"),
    ).groupBy("term").agg(
        F.sum("d").alias("df"), F.sum(F.lit(1) - F.col("d")).alias("cf"))


def capped_vocabulary(df: DataFrame, cap: int = VOCABULARY_CAP) -> DataFrame:
    """The most frequent terms; ties by term.

    A histogram of the counts tells which count the cap falls into.  All terms
    above it stay; of those with exactly that count the first by term do, for
    which they are numbered in blocks of equal beginnings.  No task sees more
    than its share, whatever the cap.
    """
    histogram = df.groupBy("cf").agg(F.count("*").alias("_n"))  # a row per distinct count
    before = F.sum("_n").over(W.orderBy(F.col("cf").desc()).rowsBetween(W.unboundedPreceding, -1))
    room = histogram.withColumn("_room", F.lit(cap) - F.coalesce(before, F.lit(0))).filter(F.col("_room") > 0)
    marked = df.join(room, "cf")
    ties = running_count(marked.filter(F.col("_n") > F.col("_room")), [], ["term"], F.substring("term", 1, BEGINNING), "_place")
    return marked.filter(F.col("_n") <= F.col("_room")).unionByName(
        ties.filter(F.col("_place") <= F.col("_room")).drop("_place")).select(df.columns)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: documents and mean length (1 when all are empty)."""
    mean = F.avg(F.size("tokens"))
    return toks.agg(
        F.count("*").alias("n_docs"),
        F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mean).alias("avgdl"),
    )


def term_table(toks: DataFrame) -> DataFrame:
    """(term, df, cf, idf)."""
    n = toks.agg(F.count("*").alias("n")).scalar()
    return document_frequency(toks).withColumn("idf", idf(n, F.col("df")))


def query_terms(queries: DataFrame, stopwords: list | None = None) -> DataFrame:
    """Distinct terms per query; repeats in a query do not count twice."""
    return queries.select(
        "query_id",
        F.explode(F.array_distinct(X.index_tokens(X.or_empty(F.col("text")), stopwords)))
        .alias("term"),
    )


def search(queries: DataFrame, docs: DataFrame, k: int = 50,
           stopwords: list | None = None, vocabulary: DataFrame | None = None,
           max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """Best k documents per query by BM25: (query_id, doc_id, score, rank).

    While the queries and their terms are few enough to travel to every task,
    documents are scored where they are read and a task passes on k rows per
    query.  A scan sorts what it keeps again for every block of documents, and
    blocks shrink as queries grow, so its time grows with the square of both.
    A larger set of queries meets the documents in cells of a block of
    queries and a share of the documents, each scored by one task.
    ``vocabulary`` restricts the index to the given terms.
    """
    toks = tokens(docs, stopwords)
    wanted = query_terms(queries, stopwords)
    # Rows of one id are documents of their own, in the scan and in the join.
    if vocabulary is not None:
        few = vocabulary.select("term").limit(MAX_VOCABULARY + 1).toArrow()
        if few.num_rows <= MAX_VOCABULARY:
            toks = _restricted(toks, few["term"].combine_chunks().cast(pa.string()))
            kept = toks.sparkSession.createDataFrame(few) if few.num_rows else vocabulary.select("term")
        else:
            kept = vocabulary.select("term")
            exploded = _numbered(toks).select("_row", "doc_id", F.posexplode_outer("tokens").alias("at", "term"))
            known = exploded.join(kept.withColumn("known", F.lit(True)), "term", "left")
            toks = known.groupBy("_row", "doc_id").agg(
                F.collect_list(F.when(F.col("known"), F.col("term"))).alias("tokens")).drop("_row")
        wanted = wanted.join(kept, "term", "left_semi").select("query_id", "term")
    # Pairs come to the driver only if they may travel.
    few = wanted.select("query_id").distinct().limit(MAX_SCANNED_QUERIES + 1).count() <= MAX_SCANNED_QUERIES
    pairs = wanted.limit(max_pairs + 1).toArrow() if few else None
    if pairs is None or pairs.num_rows > max_pairs:
        # Each cell has its queries' best already, so they are put in order after the shuffle only.
        return merge(_scores_by_cells(wanted, toks, k).repartition("query_id"), k)
    return merge(_scores_by_scan(pairs, toks, k, docs, queries), k)


def _numbered(toks: DataFrame) -> DataFrame:
    return toks.withColumn("_row", F.monotonically_increasing_id())


def _restricted(toks: DataFrame, terms: pa.Array) -> DataFrame:
    """Tokens of a bounded vocabulary only, where the documents are read."""
    shared = toks.sparkSession.sparkContext.broadcast(terms)

    def keep(batches):
        for batch in batches:
            column = batch.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            known = pc.is_in(flat, value_set=shared.value)
            row = np.repeat(np.arange(len(lengths)), lengths)[known.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(np.bincount(row, minlength=len(lengths)))
            tokens_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat.filter(known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens_], names=["doc_id", "tokens"])

    kind = toks.schema["doc_id"].dataType.simpleString()
    return toks.select("doc_id", "tokens").mapInArrow(keep, f"doc_id {kind}, tokens array<string>")


def _scores_by_cells(wanted: DataFrame, toks: DataFrame, k: int) -> DataFrame:
    """Best k documents per query and cell.

    The driver sees counts and, while they are few, the terms that queries ask for; these travel as numbers.
    Texts are read once: what a document has of the terms is written, and both the counts of documents and the
    cells read that.
    """
    spark = toks.sparkSession
    few = wanted.select("term").distinct().limit(MAX_VOCABULARY + 1).toArrow()
    terms = None
    if 0 < few.num_rows <= MAX_VOCABULARY:
        terms = few["term"].combine_chunks().cast(pa.string())
        numbers = spark.createDataFrame(pa.table({"term": terms, "_number": pa.array(np.arange(len(terms), dtype=np.int32))}))
        wanted = wanted.join(numbers, "term").select("query_id", F.col("_number").alias("term"))
    del few
    counted = staged(_counted(toks, terms), "terms")
    stats = counted.agg(F.count("*").alias("docs"), F.sum("length").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    asked_for = wanted.agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    n_docs, postings_, queries = stats["docs"], stats["postings"] or 0, asked_for["queries"] + 1
    avgdl = ((stats["length"] or 0) / n_docs if n_docs else 0.0) or 1.0
    blocks = max(1, -(-asked_for["pairs"] // CELL_PAIRS), -(-queries // BLOCK_QUERIES))
    shares = max(1, -(-n_docs // CELL_DOCS), -(-postings_ // CELL_POSTINGS))
    # Documents go out once per block and a query's best once per share; the cheaper grows.
    while blocks * shares < CELLS_A_CORE * spark.sparkContext.defaultParallelism:
        if blocks * postings_ * POSTING_BYTES < shares * queries * k * FOUND_BYTES:
            blocks += 1
        else:
            shares += 1
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = wanted.join(df, "term").select("query_id", "term", idf(F.lit(n_docs), F.col("df")).alias("idf"))
    n = blocks * shares
    keys = F.array(*[F.lit(x) for x in even_keys(spark, n)])

    def dealt(table: DataFrame, block: Column, own: int, other: int, cell: Column, columns: list) -> DataFrame:
        return table.withColumn("_b", F.pmod(block, F.lit(own)).cast("int")).withColumn(
            "_o", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(
            F.get(keys, cell).alias("cell"), *columns).repartition(n, "cell").groupBy("cell")

    # A query's terms stay together; a document's block is that of its id and words, as ids may repeat.
    asked = dealt(weighted, F.xxhash64("query_id"), blocks, shares, F.col("_b") * shares + F.col("_o"), ["query_id", "term", "idf"])
    rows = dealt(counted, F.xxhash64("doc_id", "terms", "tf"), shares, blocks, F.col("_o") * shares + F.col("_b"), ["doc_id", "terms", "tf", "length"])
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((wanted, "query_id"), (toks, "doc_id"))]
    return asked.cogroup(rows).applyInArrow(_cell_scorer(k, avgdl), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def _counted(toks: DataFrame, terms: pa.Array | None) -> DataFrame:
    """(doc_id, terms, tf, length): the distinct terms of a document, by their places in ``terms`` if given, which leaves out others."""
    shared = None if terms is None else toks.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        for batch in batches:
            column = batch.column("tokens")
            known = pc.unique(column.flatten()).drop_null() if shared is None else shared.value
            row, term, tf, lengths = _per_document(column, known)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))]).astype(np.int32))
            term = known.take(pa.array(term)) if shared is None else pa.array(term.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(offsets, term),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))), pa.array(lengths.astype(np.int64)),
            ], names=["doc_id", "terms", "tf", "length"])
        free_memory()

    kind = toks.schema["doc_id"].dataType.simpleString()
    return toks.select("doc_id", "tokens").mapInArrow(
        count, f"doc_id {kind}, terms array<{'string' if terms is None else 'int'}>, tf array<int>, length bigint")


def _cell_scorer(k: int, avgdl: float):
    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        found = _best_of_tables(asked, docs, k, avgdl)
        free_memory(SENT_AFTER)
        return found

    return run


def _best_of_tables(asked: pa.Table, docs: pa.Table, k: int, avgdl: float) -> pa.Table:
    """(query_id, doc_id, score) of the best k documents of each query; a few documents at a time are scored."""
    doc_ids, query_ids = docs.column("doc_id").combine_chunks(), asked.column("query_id").combine_chunks()
    # Rows by id, so that a place stands for its id, whatever its type.
    order = pc.sort_indices(doc_ids)
    ids = query_ids.dictionary_encode(null_encoding="encode")
    names = asked.column("term").combine_chunks().dictionary_encode()
    terms, n_queries = names.dictionary, len(ids.dictionary)
    weight = np.zeros(len(terms))
    pairs = ids.indices.to_numpy(), names.indices.to_numpy()
    weight[pairs[1]] = asked.column("idf").to_numpy()
    by = np.argsort(pairs[0], kind="stable")
    pairs = pairs[0][by], pairs[1][by]
    lengths = docs.column("length").to_numpy()[order.to_numpy()]
    sizes = pc.list_value_length(docs.column("terms")).combine_chunks().take(order).to_numpy().astype(np.int64)
    upto = np.cumsum(sizes)
    best = [BestPerQuery(k) for _ in range(0, n_queries, CELL_QUERIES)]
    floor, first = np.zeros(n_queries), 0
    while n_queries and first < len(doc_ids):
        before = upto[first - 1] if first else 0
        last = min(first + (NEXT_DOCS if first else FIRST_DOCS), int(np.searchsorted(upto, before + NEXT_POSTINGS, side="right")))
        last = min(max(first + 1, last), len(doc_ids))
        some = docs.select(["terms", "tf"]).take(order.slice(first, last - first))
        held, counts = (some.column(c).combine_chunks().flatten() for c in ("terms", "tf"))
        term = pc.fill_null(pc.index_in(held, value_set=terms), -1).to_numpy(zero_copy_only=False)
        known = term >= 0
        row = np.repeat(np.arange(last - first, dtype=np.int32), sizes[first:last])[known]
        term, tf = term[known], counts.to_numpy()[known]
        del some, held, counts, known
        weights = weight[term]
        weights *= tf
        weights *= K1 + 1.0
        weights /= tf + (K1 * (1.0 - B + B * lengths[first:last] / avgdl))[row]
        postings_ = _by_term((row, term, weights), last - first, len(terms))
        del row, term, tf, weights
        for at, query, place, scores in _best_of_queries(postings_, last - first, pairs, n_queries, k, floor):
            own = best[at // CELL_QUERIES]
            own.add(query, place + first, scores)
            count = np.bincount(own.query)
            full = np.flatnonzero(count >= k)
            floor[at + full] = own.scores[np.cumsum(count)[full] - 1]
        del postings_
        first = last
    found = [pa.table({
        "query_id": ids.dictionary.take(pa.array(own.query + i * CELL_QUERIES)), "doc_id": doc_ids.take(order.take(pa.array(own.ids))),
        "score": pa.array(own.scores)}) for i, own in enumerate(best) if own.ids is not None]
    return pa.concat_tables(found) if found else pa.table({"query_id": query_ids.slice(0, 0), "doc_id": doc_ids.slice(0, 0), "score": pa.array([], pa.float64())})


def _by_term(postings_: tuple, n: int, n_terms: int) -> tuple:
    """Documents and weights of each term, its greatest weight, and the terms that many documents hold as a matrix.

    ``postings_``: (document, term, weight) of n documents.
    """
    row, term, weight = postings_
    by = np.argsort(term, kind="stable")
    row, weight = row[by].astype(np.int64), weight[by]
    starts = np.searchsorted(term[by], np.arange(n_terms + 1))
    sizes = np.diff(starts)
    held = sizes > 0
    most = np.zeros(n_terms)
    if held.any():
        most[held] = np.maximum.reduceat(weight, starts[:-1][held])
    shared = np.argsort(-sizes, kind="stable")[:SHARED_TERMS]
    shared = shared[sizes[shared] >= max(1, SHARED_LEAST * n)]
    column = np.full(n_terms, -1)
    column[shared] = np.arange(len(shared))
    matrix = np.zeros((n, len(shared)))
    for t in shared.tolist():
        a, z = starts[t:t + 2]
        matrix[row[a:z], column[t]] = weight[a:z]
    rows, weights = ([x[a:z] for a, z in zip(starts[:-1].tolist(), starts[1:].tolist())] for x in (row, weight))
    return rows, weights, most, column, matrix


def _best_of_queries(by_term: tuple, n: int, pairs: tuple, n_queries: int, k: int, floor: np.ndarray):
    """(first query, queries from there, documents, scores) of the best k of n documents, a few queries at a time.

    ``pairs``: (query, term) by query, where a pair that is given twice counts twice.  ``floor`` has the score that a
    document must reach for each query, 0 where all may count.  Weights of a query's terms that many documents hold
    are not summed as long as these terms' greatest weights together stay well below the floor: a document that lacks
    all other terms cannot reach it, so they are looked up only for documents that with them could.  All scores are
    whole sums in double precision.
    """
    rows, weights, most, column, matrix = by_term
    for first in range(0, n_queries, CELL_QUERIES):
        m = min(CELL_QUERIES, n_queries - first)
        a, z = np.searchsorted(pairs[0], (first, first + m))
        query, term = pairs[0][a:z] - first, pairs[1][a:z]
        held = most[term] > 0
        query, term = query[held], term[held]
        low = floor[first:first + m]
        # A query's terms by their greatest weights: the first of the shared ones can wait.
        by = np.lexsort((most[term], query))
        query, term = query[by], term[by]
        later = column[term] >= 0
        bound = np.where(later, most[term], 0.0)
        upto = np.concatenate([[0.0], np.cumsum(bound)])
        later &= upto[1:] - upto[np.searchsorted(query, np.arange(m))][query] <= SHARED_WEIGHT * low[query]
        rest = np.bincount(query[later], bound[later], m)
        # Scores are rounded, so less by half a unit may do; sums in another order differ by far less than that.
        bar = np.maximum(low - rest * (1 + 1e-9) - 10.0 ** -SCORE_DIGITS, np.finfo(np.float64).tiny).tolist()
        now_from, later_from = (np.searchsorted(query[x], np.arange(m + 1)).tolist() for x in (~later, later))
        now, columns = term[~later].tolist(), column[term[later]]
        found = []
        for q in range(m):
            own = now[now_from[q]:now_from[q + 1]]
            if not own:
                continue
            sums = np.bincount(np.concatenate([rows[t] for t in own]), np.concatenate([weights[t] for t in own]), n)
            place = (sums >= bar[q]).nonzero()[0]
            scores = sums[place]
            a, z = later_from[q:q + 2]
            if a < z:
                scores += matrix[place[:, None], columns[a:z]].sum(axis=1)
            scores = np.floor(scores * 10.0 ** SCORE_DIGITS + 0.5) / 10.0 ** SCORE_DIGITS
            last = low[q]
            if len(scores) > k:
                last = max(last, np.partition(scores, len(scores) - k)[len(scores) - k])
            keep = ((scores >= last) & (scores != 0)).nonzero()[0]
            if len(keep) > k:  # of those with the last score the first
                above = scores[keep] > last
                keep = np.concatenate([keep[above], keep[~above][:k - above.sum()]])
            if len(keep):
                found.append((np.full(len(keep), q), place[keep], scores[keep]))
        if found:
            yield first, *(np.concatenate(x) for x in zip(*found))


def _best_of_cell(postings_: tuple, n: int, pairs: tuple, n_queries: int, n_terms: int, k: int, floor: np.ndarray | None = None) -> tuple:
    """(query, document, score) of the best k of n documents for each query, by their numbers.

    ``postings_``: (document, term, weight); ``pairs`` and ``floor`` as in :func:`_best_of_queries`.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    floor = np.zeros(n_queries) if floor is None else floor
    for first, *found in _best_of_queries(_by_term(postings_, n, n_terms), n, pairs, n_queries, k, floor):
        best = BestPerQuery(k)
        best.add(*found)
        out.append((best.query + first, best.ids, best.scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def _add_scores(best: BestPerQuery, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                by_term: np.ndarray, starts: np.ndarray, n_queries: int) -> None:
    """Offer the scores of (row, term, weight) triples; ``by_term`` lists the queries of each term."""
    fans = starts[terms + 1] - starts[terms]
    step = max(1, BLOCK_ENTRIES // max(1, n_queries))
    for whole, end in _fan_blocks(rows, fans, len(ids)):
        for first in range(whole, end, step):
            last = min(end, first + step)
            a, b = np.searchsorted(rows, (first, last))
            row, term, weight, fan = rows[a:b] - first, terms[a:b], weights[a:b], fans[a:b]
            offset = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            query = by_term[np.repeat(starts[term], fan) + offset]
            n = last - first
            scores = np.bincount(
                query * n + np.repeat(row, fan), weights=np.repeat(weight, fan),
                minlength=n_queries * n,
            ).reshape(n_queries, n)
            scores = np.floor(scores * 10.0 ** SCORE_DIGITS + 0.5) / 10.0 ** SCORE_DIGITS
            best.add_matrix(0, ids[first:last], scores, scores != 0)


def _per_document(tokens_column: pa.Array, terms: pa.Array):
    """(row, term, tf) triples of the wanted terms, and the length of every row."""
    lengths = pc.fill_null(pc.list_value_length(tokens_column), 0).to_numpy(
        zero_copy_only=False)
    codes = pc.fill_null(pc.index_in(tokens_column.flatten(), value_set=terms), -1).to_numpy(
        zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    hit = codes >= 0
    keys, tf = np.unique(rows[hit] * len(terms) + codes[hit], return_counts=True)
    return keys // len(terms), keys % len(terms), tf, lengths


def _fan_blocks(rows: np.ndarray, fans: np.ndarray, n: int, most: int = BLOCK_PRODUCTS) -> list:
    """Ranges of the n documents that meet about ``most`` (query, term) pairs each, or are one document.

    How many pairs a document meets depends on its words, so a number of documents bounds nothing.
    """
    upto = np.cumsum(np.bincount(rows, weights=fans, minlength=n)) if n else np.empty(0)
    out, first = [], 0
    while first < n:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + most, side="right")))
        out.append((first, min(last, n)))
        first = last
    return out


def _term_counts(toks: DataFrame, terms: list) -> dict:
    """Document counts of the wanted terms, with totals under the null term."""
    shared = toks.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        value_set = pa.array(shared.value, pa.string())
        df = np.zeros(len(value_set), dtype=np.int64)
        n_docs = total = 0
        for batch in batches:
            _, term, _, lengths = _per_document(batch.column(0), value_set)
            df += np.bincount(term, minlength=len(value_set))
            n_docs += len(lengths)
            total += int(lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array([None] + value_set.take(pa.array(seen)).to_pylist(), pa.string()),
            pa.array([n_docs] + df[seen].tolist(), pa.int64()),
            pa.array([total] + [0] * len(seen), pa.int64()),
        ], ["term", "df", "total"])

    counted = (
        toks.select("tokens").mapInArrow(count, "term string, df bigint, total bigint")
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    )
    # At most one row per wanted term, which is already bounded.
    return {r["term"]: (r["df"], r["total"]) for r in counted.collect()}


def _scores_by_scan(pairs: pa.Table, toks: DataFrame, k: int, docs: DataFrame,
                    queries: DataFrame) -> DataFrame:
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    spark = toks.sparkSession
    query_ids = sorted(set(pairs["query_id"].to_pylist()))
    id_column = pa.array(query_ids, pairs["query_id"].type)
    terms = sorted(set(pairs["term"].to_pylist()))
    if not terms:
        return spark.createDataFrame([], out)
    counts = _term_counts(toks, terms)
    n_docs, total = counts.get(None, (0, 0))
    avgdl = (total / n_docs if n_docs else 0.0) or 1.0
    df = np.array([counts.get(t, (0, 0))[0] for t in terms], dtype=np.float64)
    weights = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    query_at = {q: i for i, q in enumerate(query_ids)}
    term_at = {t: i for i, t in enumerate(terms)}
    # Queries of each term, one after the other.
    pair_term = np.array([term_at[t] for t in pairs["term"].to_pylist()])
    pair_query = np.array([query_at[q] for q in pairs["query_id"].to_pylist()])
    order = np.lexsort((pair_query, pair_term))
    by_term = pair_query[order]
    starts = np.searchsorted(pair_term[order], np.arange(len(terms) + 1))
    shared = spark.sparkContext.broadcast(
        (id_column, terms, weights, by_term, starts, float(avgdl)))

    def scan(batches):
        query_ids, terms, weights, by_term, starts, avgdl = shared.value
        value_set = pa.array(terms, pa.string())
        best = BestPerQuery(k)
        id_type = None
        step = max(1, BLOCK_ENTRIES // len(query_ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                id_type = batch.schema.field("doc_id").type
                rows, terms_, tf, lengths = _per_document(batch.column("tokens"), value_set)
                weight_ = weights[terms_] * tf * (K1 + 1.0) / (
                    tf + K1 * (1.0 - B + B * lengths[rows] / avgdl))
                _add_scores(best, batch.column("doc_id").to_numpy(zero_copy_only=False), rows, terms_, weight_, by_term,
                            starts, len(query_ids))
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(best.query)), pa.array(best.ids, id_type),
                 pa.array(best.scores)],
                ["query_id", "doc_id", "score"],
            )

    return toks.mapInArrow(scan, out)


# --- index tables ---------------------------------------------------------

def write_index(docs: DataFrame, folder: str, stopwords: list | None = None) -> None:
    """Postings sorted by term, the term table and the corpus statistics."""
    toks = tokens(docs, stopwords)
    terms = term_table(toks)
    rows = postings(toks).join(
        toks.select("doc_id", F.size("tokens").alias("len")), "doc_id")
    (rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .write.mode("overwrite").parquet(f"{folder}/postings"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    fingerprint = F.sum(F.xxhash64("doc_id", F.array_join("tokens", " ")).cast("decimal(38,0)"))
    stats = corpus_stats(toks).withColumn(
        "fingerprint", toks.agg(fingerprint.alias("f")).scalar().cast("string"))
    stats.write.mode("overwrite").parquet(f"{folder}/stats")


def index_is_current(docs: DataFrame, folder: str, stopwords: list | None = None) -> bool:
    """True when the written index was built from exactly these documents."""
    spark = docs.sparkSession
    toks = tokens(docs, stopwords)
    fingerprint = F.sum(F.xxhash64("doc_id", F.array_join("tokens", " ")).cast("decimal(38,0)"))
    now = toks.agg(F.count("*").alias("n"), fingerprint.cast("string").alias("f")).first()
    if not exists(spark, f"{folder}/stats"):
        return False
    then = spark.read.parquet(f"{folder}/stats").first()
    return then is not None and (then["n_docs"], then["fingerprint"]) == (now["n"], now["f"])


def search_index(queries: DataFrame, folder: str, k: int = 50,
                 stopwords: list | None = None) -> DataFrame:
    """BM25 over a written index; row groups of unwanted terms are skipped."""
    spark = queries.sparkSession
    stats = spark.read.parquet(f"{folder}/stats")
    avgdl = stats.select("avgdl").scalar()
    wanted = query_terms(queries, stopwords).join(
        spark.read.parquet(f"{folder}/terms").select("term", "idf"), "term")
    rows = spark.read.parquet(f"{folder}/postings")
    weight = (
        F.col("idf") * F.col("tf") * (K1 + 1.0)
        / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / avgdl))
    )
    scored = (
        wanted.join(rows, "term").groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(weight), SCORE_DIGITS).alias("score"))
        .filter(F.col("score") != 0)
    )
    return rank(scored, k)
