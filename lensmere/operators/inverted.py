"""A stored BM25 index: searched by its terms' buckets, kept up to date by what changed.

Layout below one folder:

* ``postings/generation=g/bucket=b``: one row per term and block of documents, with the entries
  (doc_id, print, tf, len, copies) and, for skipping, their number, greatest tf and least length;
* ``documents/generation=g``: a log of (doc_id, print, copies added or removed, len, buckets touched);
* ``manifest/version=v``: the generation that holds each bucket; ``state/version=v``: one row of totals,
  written last.  A reader takes the newest complete version, so it never meets a half-written index.

Counts of documents per term are sums over the blocks of the current buckets, so nothing else has to be
kept in step.  A row is known by its id and the hash of its text; equal rows are one with several copies.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lensmere.functions import text as X
from lensmere.operators.dense import SCORE_DIGITS, merge
from lensmere.operators.lexical import B, K1, idf, query_terms
from lensmere.tables import exists

BUCKETS = 64
#: Documents of a block, on average; a block's entries of one term are one row.
BLOCK_DOCS = 1_024
#: Blocks of the greatest bounds that are scored first, for the score that others must reach.
FIRST_BLOCKS = 2
#: Blocks that one task cuts into terms and writes.
TASK_BLOCKS = 16
#: Query terms up to this number travel to the postings.
MAX_TERMS = 500_000
#: Scores are rounded before ranking, so a bound must be missed by more than that.
SLACK = 1e-5


def weight(idf_: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    """The BM25 weight of one term in one document; it rises with tf and falls with the length."""
    return idf_ * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / avgdl))


def _rows_of(block: int, docs: pa.Table, kept: pa.Table | None = None) -> pa.RecordBatch:
    """The rows of one block, a row per term, of (doc_id, print, copies, tokens) and of entries kept as they were."""
    column = docs.column("tokens").combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = column.flatten().dictionary_encode()
    # One occurrence after another: its row and its term, counted.
    n = max(1, len(lengths))
    key, tf = np.unique(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    at = pa.array(key % n)
    made = pa.table({
        "term": codes.dictionary.take(pa.array(key // n)).cast(pa.string()), "doc_id": docs.column("doc_id").take(at), "print": docs.column("print").take(at),
        "tf": pa.array(tf.astype(np.int32)), "len": pa.array(lengths[key % n].astype(np.int32)), "copies": docs.column("copies").take(at)})
    if kept is not None:
        made = pa.concat_tables([made, kept.select(made.column_names).cast(made.schema)])
    terms = made.column("term").combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    made = made.take(pa.array(np.argsort(code, kind="stable")))
    counts = np.bincount(code, minlength=len(terms.dictionary))
    starts = np.cumsum(counts) - counts
    entries = pa.StructArray.from_arrays([made.column(c).combine_chunks() for c in ENTRY], names=ENTRY)
    over = (lambda f, c: f.reduceat(made.column(c).to_numpy(), starts)) if len(starts) else (lambda f, c: np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [terms.dictionary, pa.array(np.full(len(starts), block, np.int32)), pa.array(over(np.add, "copies").astype(np.int64)),
         pa.array(over(np.maximum, "tf").astype(np.int32)), pa.array(over(np.minimum, "len").astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(np.append(starts, made.num_rows).astype(np.int32)), entries)],
        names=["term", "block", "n", "max_tf", "min_len", "entries"])


ENTRY = ["doc_id", "print", "tf", "len", "copies"]


def _row_schema(kind: str) -> str:
    return f"term string, block int, n long, max_tf int, min_len int, entries array<struct<doc_id:{kind},print:long,tf:int,len:int,copies:long>>"


def _blocked(batches):
    """Rows of documents that come block by block: what a term has in a block is put together here, not in a shuffle."""
    parts, now = [], None
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is not None and now != block[a]:
                yield _rows_of(now, pa.Table.from_batches(parts))
                parts = []
            now = int(block[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield _rows_of(now, pa.Table.from_batches(parts))


def _tokens(docs: DataFrame, stopwords: list | None) -> DataFrame:
    return docs.select("block", "doc_id", "print", "copies", X.index_tokens(X.or_empty(F.col("text")), stopwords).alias("tokens"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "print"), F.lit(blocks)).cast("int")


def _by_block(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, print, copies, text) with a block in one task; equal rows are one.  The texts are shuffled, not their postings."""
    return (docs.withColumn("block", _block(blocks)).repartition(max(1, -(-blocks // TASK_BLOCKS)), "block")
            .groupBy("block", "doc_id", "print").agg(F.count("*").alias("copies"), F.first("text").alias("text")).sortWithinPartitions("block"))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_postings(rows: DataFrame, folder: str, generation: int, buckets: int) -> None:
    # Each task writes its blocks' rows into the buckets, so postings are not shuffled.  Terms in order inside a
    # bucket's files, so that their statistics tell which row groups hold a term.
    (rows.withColumn("bucket", _bucket("term", buckets)).sortWithinPartitions("bucket", "term", "block")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings/generation={generation}"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(X.or_empty(F.col("text"))).alias("print"), "text")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, print, copies): the rows of a corpus, counted without its texts being shuffled."""
    return _keyed(docs).groupBy("doc_id", "print").agg(F.count("*").alias("copies"))


def _mark(copies: Column) -> Column:
    """Sums to the same value for the same rows in any order, and can be added to."""
    return F.sum(copies * (F.xxhash64("doc_id", "print") % 1_000_000_007)).cast("decimal(38,0)")


def _versions(spark: SparkSession, folder: str) -> list:
    """Complete versions, newest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = sorted((int(n.split("=")[1]) for n in names if n.startswith("version=")), reverse=True)
    return [v for v in found if exists(spark, f"{folder}/state/version={v}/_SUCCESS")]


def state(spark: SparkSession, folder: str) -> dict | None:
    """Totals and parameters of the current version, or None where there is no index."""
    for version in _versions(spark, folder)[:1]:
        return spark.read.parquet(f"{folder}/state/version={version}").first().asDict()
    return None


def _write_state(spark: SparkSession, folder: str, values: dict) -> None:
    schema = ("version int, n_docs long, total_len long, fingerprint string, buckets int, blocks int, stopwords string")
    spark.createDataFrame([tuple(values[c.split()[0]] for c in schema.split(", "))], schema).coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/state/version={values['version']}")


def build(docs: DataFrame, folder: str, stopwords: list | None = None, buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> None:
    """A new index of (doc_id, text); an older one in the folder stays readable until this is complete."""
    spark = docs.sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    n = docs.count()
    blocks = max(1, -(-n // block_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _tokens(_by_block(_keyed(docs), blocks), stopwords).mapInArrow(_blocked, _row_schema(kind))
    _write_postings(rows, folder, version, buckets)
    whole = _keyed(docs).withColumn("copies", F.lit(1).cast("long"))
    _log(whole, stopwords, buckets, F.lit(1)).write.mode("overwrite").parquet(f"{folder}/documents/generation={version}")
    _publish(spark, folder, version, None, blocks, buckets, stopwords, None)


def _log(docs: DataFrame, stopwords: list | None, buckets: int, sign: Column) -> DataFrame:
    toks = X.index_tokens(X.or_empty(F.col("text")), stopwords)
    return docs.select("doc_id", "print", toks.alias("t"), "copies").select(
        "doc_id", "print", (F.col("copies") * sign).alias("change"), F.size("t").cast("long").alias("len"),
        F.array_distinct(F.transform("t", lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))).alias("buckets"))


def _publish(spark, folder: str, version: int, before: dict | None, blocks: int, buckets: int, stopwords: list | None, touched: list | None) -> None:
    """Manifest and totals of a new version, from the log's newest part and the version before."""
    written = spark.read.parquet(f"{folder}/documents/generation={version}")
    change = written.agg(F.sum("change").alias("n"), F.sum(F.col("change") * F.col("len")).alias("len"), _mark(F.col("change")).alias("f")).first()
    own = spark.createDataFrame([], "bucket int")
    if exists(spark, f"{folder}/postings/generation={version}/bucket=*"):
        own = spark.read.parquet(f"{folder}/postings/generation={version}").select("bucket").distinct()
    manifest = own.select("bucket", F.lit(version).alias("generation"))
    if before is not None:
        kept = spark.read.parquet(f"{folder}/manifest/version={before['version']}")
        manifest = manifest.union(kept.filter(~F.col("bucket").isin(touched) if touched else F.lit(True)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    old = before or {"n_docs": 0, "total_len": 0, "fingerprint": "0"}
    _write_state(spark, folder, {
        "version": version, "n_docs": old["n_docs"] + int(change["n"] or 0), "total_len": old["total_len"] + int(change["len"] or 0),
        "fingerprint": str(int(old["fingerprint"]) + int(change["f"] or 0)), "buckets": buckets, "blocks": blocks, "stopwords": json.dumps(stopwords)})


def is_current(docs: DataFrame, folder: str) -> bool:
    """Was the index made from exactly these rows?  One scan, no tokenising."""
    now = state(docs.sparkSession, folder)
    if now is None:
        return False
    found = _rows(docs).agg(F.sum("copies").alias("n"), _mark(F.col("copies")).alias("f")).first()
    return (int(found["n"] or 0), str(int(found["f"] or 0))) == (now["n_docs"], now["fingerprint"])


def changes(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, print, copies, was): rows whose number of copies differs from the index; a changed text is two of them."""
    spark = docs.sparkSession
    was = spark.read.parquet(f"{folder}/documents").groupBy("doc_id", "print").agg(F.sum("change").alias("was")).filter("was <> 0")
    now = _rows(docs).withColumnsRenamed({"doc_id": "d", "print": "p"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))
    both = was.join(now, same, "full")
    return both.select(F.when(F.col("p").isNull(), F.col("doc_id")).otherwise(F.col("d")).alias("doc_id"), F.coalesce("p", "print").alias("print"),
                       F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("was", F.lit(0)).alias("was")).filter("copies <> was")


def refresh(docs: DataFrame, folder: str) -> dict:
    """Bring the index up to these rows; returns the numbers of rows changed and buckets rewritten.

    Only rows that came are tokenised, and only buckets that hold a term of a row that came or went are
    written anew, as a new generation; the others stay as they are.
    """
    spark = docs.sparkSession
    before = state(spark, folder)
    if before is None:
        build(docs, folder)
        return {"rows": docs.count(), "buckets": state(spark, folder)["buckets"]}
    version, stopwords = before["version"] + 1, json.loads(before["stopwords"])
    changes(docs, folder).write.mode("overwrite").parquet(f"{folder}/changes/version={version}")
    diff = spark.read.parquet(f"{folder}/changes/version={version}")
    n = diff.count()
    if not n:
        return {"rows": 0, "buckets": 0}
    keys = diff.withColumnsRenamed({"doc_id": "d", "print": "p"})

    def same(df):
        return df["doc_id"].eqNullSafe(keys["d"]) & (df["print"] == keys["p"])

    keyed = _keyed(docs)
    came = (keyed.join(keys.filter("copies > 0"), same(keyed)).select("doc_id", "print", "text", "copies", "was")
            .withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "print").orderBy(F.lit(1)))).filter("_n = 1").drop("_n"))
    log = spark.read.parquet(f"{folder}/documents")
    gone = (log.join(keys.filter("copies = 0"), same(log)).groupBy("doc_id", "print")
            .agg(F.max(-F.col("was")).alias("change"), F.max("len").alias("len"), F.first("buckets").alias("buckets")))
    fresh = _log(came.withColumn("copies", F.col("copies") - F.col("was")), stopwords, before["buckets"], F.lit(1))
    fresh.unionByName(gone).write.mode("overwrite").parquet(f"{folder}/documents/generation={version}")
    # At most one row per bucket.
    touched = [r[0] for r in spark.read.parquet(f"{folder}/documents/generation={version}").select(F.explode("buckets").alias("b")).distinct().collect()]
    # What came and, without copies or words, what went: a block's old entries of these rows go, the new ones come.
    none = F.array().cast("array<string>")
    blocks = before["blocks"]
    changed = _tokens(came.withColumn("block", _block(blocks)), stopwords).unionByName(diff.filter("copies = 0").select(
        _block(blocks).alias("block"), "doc_id", "print", F.lit(0).cast("long").alias("copies"), none.alias("tokens")))
    kind = changed.schema["doc_id"].dataType.simpleString()
    old = _current(spark, folder, before, touched)
    if old is None:
        rows = changed.repartition(max(1, -(-blocks // TASK_BLOCKS)), "block").sortWithinPartitions("block").mapInArrow(_blocked, _row_schema(kind))
    else:
        rows = old.select("block", "term", "entries").groupBy("block").cogroup(changed.groupBy("block")).applyInArrow(_renewed, _row_schema(kind))
    _write_postings(rows, folder, version, before["buckets"])
    _publish(spark, folder, version, before, before["blocks"], before["buckets"], stopwords, touched)
    return {"rows": n, "buckets": len(touched)}


def _flat(rows: pa.Table) -> pa.Table:
    """One row per entry, with its term."""
    lists = rows.column("entries").combine_chunks()
    at = pa.array(np.repeat(np.arange(rows.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    entries = lists.flatten()
    return pa.table({"term": rows.column("term").take(at)} | {c: entries.field(c) for c in ENTRY})


def _renewed(old: pa.Table, changed: pa.Table) -> pa.Table:
    """The rows of one block after some of its documents came, went or got another number of copies."""
    block = (old if old.num_rows else changed).column("block")[0].as_py()
    kept = _flat(old)
    if changed.num_rows:
        # A row is known by id and print; ids may be null.
        gone = set(zip(changed.column("doc_id").to_pylist(), changed.column("print").to_pylist()))
        near = pc.is_in(kept.column("print"), value_set=changed.column("print").combine_chunks())
        at = np.flatnonzero(near.to_numpy())
        some = kept.take(pa.array(at))
        stay = np.ones(kept.num_rows, bool)
        stay[at] = [key not in gone for key in zip(some.column("doc_id").to_pylist(), some.column("print").to_pylist())]
        kept = kept.filter(pa.array(stay))
    return pa.Table.from_batches([_rows_of(block, changed.filter(pc.greater(changed.column("copies"), 0)), kept)])


def _current(spark: SparkSession, folder: str, now: dict, buckets: list) -> DataFrame | None:
    """The postings of some buckets in the generations that hold them now."""
    manifest = spark.read.parquet(f"{folder}/manifest/version={now['version']}").filter(F.col("bucket").isin(buckets or [-1])).collect()
    if not manifest:
        return None
    paths = [f"{folder}/postings/generation={r['generation']}/bucket={r['bucket']}" for r in manifest]
    return spark.read.option("basePath", f"{folder}/postings").parquet(*paths)


def _scorer(k: int, avgdl: float):
    """Scores of the open (query, term) pairs of one block in its rows; the best k rows of each query."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        flat = _flat(rows)
        ids = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        terms = asked.column("term").combine_chunks().dictionary_encode()
        names = terms.dictionary
        if not len(ids) or not flat.num_rows:
            return pa.table({"query_id": ids.dictionary.slice(0, 0), "doc_id": flat.column("doc_id").slice(0, 0),
                             "score": pa.array([], pa.float64()), "copies": flat.column("copies").slice(0, 0)})
        # Documents in the order of their ids, so that of equal scores the first is the one to keep.
        docs = flat.select(["doc_id", "print", "copies"]).group_by(["doc_id", "print"]).aggregate([("copies", "max")]).sort_by([("doc_id", "ascending"), ("print", "ascending")])
        number = {key: i for i, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("print").to_pylist()))}
        row = np.fromiter((number[key] for key in zip(flat.column("doc_id").to_pylist(), flat.column("print").to_pylist())), np.int64, flat.num_rows)
        code = pc.fill_null(pc.index_in(flat.column("term").combine_chunks(), value_set=names), -1).to_numpy(zero_copy_only=False)
        tf, length = flat.column("tf").to_numpy().astype(np.float64), flat.column("len").to_numpy().astype(np.float64)
        weight_ = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / avgdl))
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(names) + 1))
        row, weight_ = row[order], weight_[order]
        query, term, idf_ = (ids.indices.to_numpy(), terms.indices.to_numpy(), asked.column("idf").to_numpy())
        by_query = np.lexsort((term, query))
        cuts = np.searchsorted(query[by_query], np.arange(len(ids.dictionary) + 1))
        out_query, out_row, out_score = [], [], []
        for q in range(len(ids.dictionary)):
            scores = np.zeros(docs.num_rows)
            for at in by_query[cuts[q]:cuts[q + 1]]:
                a, b = starts[term[at]], starts[term[at] + 1]
                scores[row[a:b]] += idf_[at] * weight_[a:b]  # a document is met once in a term
            scores = np.floor(scores * 10.0 ** SCORE_DIGITS + 0.5) / 10.0 ** SCORE_DIGITS
            hit = np.flatnonzero(scores)
            if len(hit) > k:
                hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - k)[len(hit) - k]]
                hit = hit[np.argsort(-scores[hit], kind="stable")[:k]]
            out_query.append(np.full(len(hit), q)), out_row.append(hit), out_score.append(scores[hit])
        at = pa.array(np.concatenate(out_row))
        return pa.table({"query_id": ids.dictionary.take(pa.array(np.concatenate(out_query))), "doc_id": docs.column("doc_id").take(at),
                         "score": pa.array(np.concatenate(out_score)), "copies": docs.column("copies_max").take(at)})

    return run


def search(queries: DataFrame, folder: str, k: int = 50, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """Best k rows per query by BM25 over the stored index: (query_id, doc_id, score, rank).

    Reads the buckets of the queries' terms only.  The blocks that promise most for a query are scored
    first; their k-th score is a floor, and blocks whose bound stays below it are never opened.  No cap:
    what may reach the floor is scored, so the result is that of a scan of the texts.
    """
    spark = queries.sparkSession
    now = state(spark, folder)
    if now is None:
        raise FileNotFoundError(f"no index in {folder}")
    wanted = query_terms(queries, json.loads(now["stopwords"])).withColumn("bucket", _bucket("term", now["buckets"]))
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most one row per bucket
    rows = _current(spark, folder, now, buckets)
    if rows is None:
        kind = spark.read.parquet(f"{folder}/documents").schema["doc_id"].dataType.simpleString()
        return queries.select("query_id").limit(0).selectExpr("query_id", f"cast(null as {kind}) as doc_id", "0d as score", "0 as rank")
    mean = now["total_len"] / now["n_docs"] if now["total_len"] else 1.0
    avgdl = F.lit(mean)
    terms = wanted.select("bucket", "term").distinct()
    # The terms travel to the postings while they are few; the postings of other terms are never shuffled then.
    small = F.broadcast(terms) if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS else terms
    heads = rows.select("bucket", "term", "block", "n", "max_tf", "min_len").join(small, ["bucket", "term"], "left_semi")
    weights = heads.groupBy("term").agg(idf(F.lit(now["n_docs"]), F.sum("n")).alias("idf"))
    asked = wanted.join(weights, "term").select("query_id", "bucket", "term", "idf")
    bound = weight(F.col("idf"), F.col("max_tf"), F.col("min_len"), avgdl)
    bounds = asked.join(heads, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum(bound).alias("bound"))

    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (rows.select("entries.doc_id"), "doc_id"))}
    found_schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id'][6:-1]}, score double, copies long"

    def scored(pairs: DataFrame) -> DataFrame:
        """The best k rows of each query and block of the pairs; a block's rows of the asked terms meet in one task."""
        open_ = asked.join(pairs, "query_id").select("block", "query_id", "term", "idf")
        of_terms = rows.select("bucket", "term", "block", "entries").join(small, ["bucket", "term"], "left_semi")
        opened_ = of_terms.join(pairs.select("block").distinct(), "block", "left_semi").select("block", "term", "entries")
        return opened_.groupBy("block").cogroup(open_.groupBy("block")).applyInArrow(_scorer(k, mean), found_schema)

    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    first = scored(bounds.withColumn("n", place).filter(F.col("n") <= first_blocks).select("query_id", "block"))
    floor = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("query_id", F.col("score").alias("floor"))
    rest = (bounds.withColumn("n", place).filter(F.col("n") > first_blocks).join(floor, "query_id", "left")
            .filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select("query_id", "block"))
    found = first.unionByName(scored(rest))
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long")).cast("int"))))
    return merge(repeated.select("query_id", "doc_id", "score"), k)


def opened(queries: DataFrame, folder: str, k: int = 50, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, list]:
    """The search and the buckets it reads, for inspection."""
    now = state(queries.sparkSession, folder)
    wanted = query_terms(queries, json.loads(now["stopwords"])).select(_bucket("term", now["buckets"]).alias("b")).distinct()
    return search(queries, folder, k, first_blocks), sorted(r[0] for r in wanted.collect())
