"""The batch jobs one after the other on a small directory."""

from lensmere.jobs import build
from lensmere.operators import inverted, vectorstore
from lensmere.sources import writers


def test_chain(spark, tmp_path):
    qa = tmp_path / "in" / "heart_QA"
    qa.mkdir(parents=True)
    for i in range(12):
        pairs = "".join(f"<QAPair><Question>what is item {i} {j} about</Question>"
                        f"<Answer>{'word%d ' % (j % 3) * 400}</Answer></QAPair>" for j in range(3))
        (qa / f"{i}.xml").write_text(f"<D>{pairs}</D>")
    out = str(tmp_path / "corpus")
    build.main(["chunk", "--input", str(tmp_path / "in"), "--output", out])
    chunks = spark.read.parquet(f"{out}/chunks")
    n = chunks.count()
    ids = sorted(r.id for r in chunks.select("id").collect())
    assert ids == [f"chunk_{i:06d}" for i in range(n)] and n > 36
    vectors = str(tmp_path / "vectors")
    build.main(["index", "--input", f"{out}/chunks", "--output", vectors])
    build.main(["index", "--input", f"{out}/chunks", "--output", vectors, "--append"])
    assert spark.read.parquet(f"{vectors}/vectors").count() == n
    words = str(tmp_path / "words")
    build.main(["lexical", "--input", f"{out}/chunks", "--output", words])
    before = spark.read.parquet(f"{words}/postings").inputFiles()
    build.main(["lexical", "--input", f"{out}/chunks", "--output", words])
    assert spark.read.parquet(f"{words}/postings").inputFiles() == before
    nodes = str(tmp_path / "tree")
    build.main(["tree", "--input", f"{out}/chunks", "--output", nodes, "--vectors", vectors,
                "--topics", "5", "--domains", "2"])
    assert spark.read.parquet(f"{nodes}/nodes").filter("level = 1").count() >= 1
    assert spark.read.parquet(f"{nodes}/index/vectors").count() == spark.read.parquet(f"{nodes}/nodes").count()
    ctx = str(tmp_path / "ctx")
    for _ in range(2):
        build.main(["contexts", "--input", f"{out}/chunks", "--output", ctx])
    assert spark.read.parquet(ctx).count() == n
    both = str(tmp_path / "both")
    for _ in range(2):
        build.main(["reembed", "--input", f"{out}/chunks", "--contexts", ctx, "--output", both])
    assert vectorstore.vectors(spark, f"{both}/vectors").count() == n
    assert inverted.state(spark, f"{both}/lexical")["version"] == 1
    codes = str(tmp_path / "codes")
    build.main(["shrink", "--input", vectors, "--output", codes, "-k", "3", "--sample", "20"])
    assert spark.read.parquet(f"{codes}/codes").count() == n
    # Applied, the codes stand in the index's place and open like it.
    shrunk = str(tmp_path / "shrunk")
    build.main(["shrink", "--input", vectors, "--output", shrunk, "-k", "3", "--sample", "20", "--min-recall", "0", "--apply"])
    opened = writers.open_vector_index(spark, vectors, chunks)
    assert opened.count() == n and opened.columns == ["id", "embedding"]
    assert spark.read.json(f"{vectors}/config").first().total_chunks == n


def test_evaluation_report(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from lensmere.jobs import evaluate
    from lensmere.plans.measures import _qa

    chunks = str(tmp_path / "chunks")
    _qa(spark, sf).withColumn("id", F.col("id").cast("string")).write.parquet(chunks)
    evaluate.main(["--input", chunks, "--output", str(tmp_path / "r"), "--n", "20", "-k", "5"])
    metrics = {r.condition: r for r in spark.read.json(str(tmp_path / "r" / "metrics")).collect()}
    assert set(metrics) == {"dense_raw", "dense_rr", "hybrid_raw", "hybrid_rr"}
    assert all(0 <= m.recall_1 <= m.recall_5 <= m.recall_k <= 1 for m in metrics.values())
    gap = spark.read.json(str(tmp_path / "r" / "gap")).first()
    assert gap.low <= gap.point <= gap.high
