"""Readers: QA XML, JSON records, concept files, chunk files, images.

Every format can be read from files, or parsed from a text column when the
documents already sit in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lensmere.functions import text as X
from lensmere.tables import CHUNK_SCHEMA, exists

# Field names in order of preference, concept file columns.
QUESTION_FIELDS = ["question", "q", "Question", "QUESTION"]
ANSWER_FIELDS = ["answer", "a", "final_decision", "long_answer", "LongAnswer", "LONG_ANSWER"]
CONTEXT_FIELDS = [
    "context", "contexts", "abstract", "abstracts", "passages", "evidence", "article", "docs",
]
ITEM_FIELDS = ["text", "abstract", "content"]
CONCEPT_COLUMNS = 18
CONCEPT_POSITIONS = {"rxcui": 0, "lat": 1, "ispref": 6, "sab": 11, "tty": 12, "term": 14}
QA_SCHEMA = "Question string, Answer string"


# --- QA XML ---------------------------------------------------------------

def _qa_documents(pairs: DataFrame, source: str, url_prefix: str) -> DataFrame:
    q, a = X.clean_markup(F.col("q")), X.clean_markup(F.col("a"))
    clean = pairs.withColumn("question", q).withColumn("answer", a).filter(
        (X.or_empty(F.col("question")) != "") & (X.or_empty(F.col("answer")) != ""))
    return clean.drop("q", "a").select(
        "*", F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer").alias("text"),
        F.lit(source).alias("source"), F.lit("QA_pair").alias("type"),
        F.concat(F.lit(url_prefix), "category", F.lit("/"), "file").alias("url"))


def read_qa_directory(spark: SparkSession, folder: str, source: str = "QA",
                      url_prefix: str = "") -> DataFrame:
    """All QA pairs of ``<folder>/*_QA/*.xml``; the directory is the category."""
    pairs = (
        spark.read.format("xml").option("rowTag", "QAPair").option("mode", "PERMISSIVE")
        .schema(QA_SCHEMA).load(f"{folder}/*_QA/*.xml")
        .select(F.col("Question").alias("q"), F.col("Answer").alias("a"),
                F.col("_metadata.file_path").alias("path")))
    parts = F.split("path", "/")
    return _qa_documents(
        pairs.withColumn("category", F.element_at(parts, -2)).withColumn(
            "file", F.element_at(parts, -1)).drop("path"), source, url_prefix)


def parse_qa_xml(docs: DataFrame, source: str = "QA", url_prefix: str = "") -> DataFrame:
    """QA pairs at any depth of the XML in column ``xml``; needs category and file."""
    pair = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<QAPair\b.*?</QAPair>"), F.lit(0)))
    rows = docs.withColumn("_pair", pair).withColumn(
        "_p", F.from_xml("_pair", QA_SCHEMA, {"rowTag": "QAPair"}))
    flat = rows.withColumn("q", F.col("_p.Question")).withColumn("a", F.col("_p.Answer"))
    return _qa_documents(flat.drop("xml", "_pair", "_p"), source, url_prefix)


# --- JSON records ---------------------------------------------------------

def parse_json_records(docs: DataFrame, column: str = "json") -> DataFrame:
    """One row per record object, as JSON text in ``record``.

    The text is an array of objects, an object of objects, or one object per
    line; malformed lines are skipped.
    """
    # A first line that is complete while more follow means one record per line;
    # the parser itself stops silently after the first value.
    first, rest = F.regexp_extract(column, r"(?s)^\s*([^\n]*)(.*)$", 1), F.regexp_extract(
        column, r"(?s)^\s*([^\n]*)(.*)$", 2)
    by_line = F.try_parse_json(first).isNotNull() & (F.trim(F.translate(rest, "\n", " ")) != "")
    whole = docs.withColumn("_v", F.try_parse_json(column)).withColumn(
        "_kind", F.when(by_line | F.col("_v").isNull(), "lines").when(
            F.col(column).rlike(r"^\s*\["), "array").when(
            F.col(column).rlike(r"^\s*\{"), "object").otherwise("lines"))
    keep = [c for c in docs.columns if c != column]
    items = F.when(F.col("_kind") == "array", F.transform(
        F.try_variant_get("_v", "$", "array<variant>"), lambda v: F.to_json(v))).when(
        F.col("_kind") == "object", F.transform(
            F.map_values(F.try_variant_get("_v", "$", "map<string,variant>")),
            lambda v: F.to_json(v))).otherwise(F.transform(
                F.split(column, "\n"), lambda s: F.to_json(F.try_parse_json(F.trim(s)))))
    return whole.select(*keep, F.explode(items).alias("record")).filter(
        F.startswith("record", F.lit("{")))


def read_json_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Records of JSON files as JSON text.

    ``lines`` is splittable and meant for large files; ``document`` reads files
    that hold one array or one object of records.
    """
    if layout == "lines":
        lines = spark.read.text(path).select(F.to_json(F.try_parse_json(F.trim("value")))
                                             .alias("record"))
        return lines.filter(F.startswith("record", F.lit("{")))
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return parse_json_records(whole)


def _first_present(record: Column, names: list) -> Column:
    """Value of the first key that is present, even if it is empty."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.array_contains(keys, name),
                     X.or_empty(F.get_json_object(record, f"$.{name}"))).otherwise(out)
    return out


def record_fields(records: DataFrame) -> DataFrame:
    """question, answer and context of JSON records, by order of preference."""
    r = F.col("record")
    raw = _first_present(r, CONTEXT_FIELDS)

    def item_text(item: Column) -> Column:
        inner = F.coalesce(*[X.non_empty(F.get_json_object(item, f"$.{n}")) for n in ITEM_FIELDS])
        return F.when(F.startswith(item, F.lit("{")), inner).when(
            F.startswith(item, F.lit('"')), F.from_json(
                F.concat(F.lit('{"s":'), item, F.lit("}")), "s string")["s"])

    parts = F.transform(F.from_json(raw, "array<variant>"), lambda v: item_text(F.to_json(v)))
    context = F.when(F.startswith(raw, F.lit("[")), F.array_join(
        F.filter(parts, lambda p: p.isNotNull()), " \n")).otherwise(raw)
    return records.select(
        "*", X.squeezed(X.or_empty(_first_present(r, QUESTION_FIELDS))).alias("question"),
        X.squeezed(X.or_empty(_first_present(r, ANSWER_FIELDS))).alias("answer"),
        X.squeezed(X.or_empty(context)).alias("context"))


# --- concept files --------------------------------------------------------

def parse_concept_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns of a pipe-delimited concept file by position; short lines are skipped."""
    keep = [c for c in lines.columns if c != column]
    parts = lines.withColumn("_p", F.split(column, r"\|")).filter(F.size("_p") >= CONCEPT_COLUMNS)
    return parts.select(*keep, *[
        F.get("_p", F.lit(i)).alias(name) for name, i in CONCEPT_POSITIONS.items()])


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """A concept file with ``seq`` rising in file order."""
    return parse_concept_lines(spark.read.text(path).withColumn(
        "seq", F.monotonically_increasing_id()))


# --- chunk files, drug files, images --------------------------------------

def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of JSON-lines files; malformed lines are dropped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_chunk_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column."""
    parsed = F.from_json(column, CHUNK_SCHEMA, {"mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != column]
    rows = lines.filter(F.try_parse_json(column).isNotNull()).select(*keep, parsed.alias("_c"))
    return rows.select(*keep, "_c.*")


def read_drug_files(spark: SparkSession, paths: list) -> DataFrame | None:
    """JSON arrays of drug records from those paths that exist.

    A path that is there but cannot be read is an error, never a gap.  An array
    is one document, so a file of it is read by one task: split large ones.
    """
    from lensmere.operators.corpus import drug_documents, union

    parts = []
    for path in paths:
        if exists(spark, path):
            records = spark.read.option("multiLine", "true").json(path)
            parts.append(drug_documents(records, F.lit(path.rsplit("/", 1)[-1])))
    return union(parts) if parts else None


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
