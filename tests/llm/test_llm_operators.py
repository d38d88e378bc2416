"""Operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from lensmere.llm import chat, html_main, minhash, mixing, pieces, pq, quality, shared, spans, token_edits, topk_segments  # noqa: E402
from lensmere.session import ship  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def invented(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ","]) for _ in range(n))


# Components


def test_components(spark):
    rng = random.Random(4)
    links = [(f"{rng.randint(0, 300):03}", f"{rng.randint(0, 300):03}") for _ in range(200)]
    links += [(f"x{i:03}", f"x{i + 1:03}") for i in range(40)] + [(None, "y"), ("z", "z")]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a string, b string")).collect()}
    real = [(a, b) for a, b in links if a and a != b]
    nodes = {x for link in real for x in link}
    assert got == plain.components(nodes, real)


def test_components_of_nothing(spark):
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. MinHash


def near(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("band", F.lit("x"))
    return minhash.near_duplicates(df, **options)


def test_minhash_against_all_pairs(spark):
    rng = random.Random(1)
    texts, k = {}, 0
    for _ in range(25):
        base = invented(rng, rng.choice([2, 4, 30, 60, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            texts[k] = " ".join(own)
            k += 1
    # A large group whose members are near one another to varying degrees.
    base = invented(rng, 80).split()
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(["p", "q", "r"])
        texts[k] = " ".join(own)
        k += 1
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component, r.kept) for r in near(spark, list(texts.items()), words=words, percent=percent, block_bytes=4096).collect()}
        want = plain.near_duplicates(texts, words, percent)
        assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_minhash_odd_rows(spark):
    long = "word " * 30000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (None, "a b c"), (None, None), (7, long), (8, long),
            (9, "one two three"), (9, "one two three"), (9, "four five six"), (10, "four five six")]
    got = sorted(((r.doc_id, r.n_shingles, r.component, r.kept) for r in near(spark, rows, words=3, percent=85).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, 6, False),
            (None, 0, None, True), (7, 2, 7, True), (8, 2, 7, False), (9, 1, 9, True), (9, 1, 9, True), (9, 1, 9, True), (10, 1, 9, False)]
    assert got == sorted(want, key=str)
    assert near(spark, []).count() == 0


# 2. Chat


def test_spans_read_back():
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<a \\ <| b\n"), ("", ""), ("sys\ntem\\", "<"), ("assistant", ""), ("assistant", "|x")]
    text, found, rewrites = chat.spans(turns, chat.marked_turns)
    assert not rewrites and chat.read_turns(text) == turns and text == chat.marked_turns(turns)
    assert [text[a:b] for a, b, _, _ in found] == [chat.marked_turns([t]) for t in turns]
    assert [chat.unescape(text[c:d]) for _, _, c, d in found] == [t if r == "assistant" else "" for r, t in turns]


def test_template_that_rewrites_history():
    def forgetful(turns):
        return f"({len(turns)} turns)" + "".join(t for _, t in turns)

    assert chat.spans([("user", "a"), ("assistant", "b")], forgetful)[2]

    def final_mark(turns):
        return "".join(f"[{r}]{t}" for r, t in turns) + ("" if turns and turns[-1][0] == "user" else "$")

    assert chat.spans([("user", "a"), ("assistant", "b"), ("user", "c")], final_mark)[2]


def test_chat_windows_and_odd_rows(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} <|x") for t in range(150)]
    rows += [(2, 0, None, None), (2, None, "user", "first"), (2, 0, "assistant", "tie"), (None, 0, "assistant", "orphan"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("conv", F.lit("c"))
    parts = chat.formatted(df, window=16)
    assert parts.where("conv = 1").count() == 10 and parts.where("rewrites").count() == 0
    got = {r.conv: r for r in chat.digested(parts).collect()}
    assert set(got) == {1, 2, 3, None}
    by = {1: [(r, t) for _, _, r, t in rows[:150]], 2: [("user", "first"), ("", ""), ("assistant", "tie")], None: [("assistant", "orphan")], 3: [("user", "x")] * 2}
    for k, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].formatted_chars == len(chat.marked_turns(turns))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digested(chat.formatted(df.limit(0))).count() == 0


# 3. Mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == [187.5, 75.0, 37.5]
    assert mixing.targets([("a", 10), ("b", 100), ("c", 100)]) == pytest.approx([30, 120, 60])
    assert mixing.targets([("a", 0), (None, 0)]) == [0.0, 0.0] and mixing.targets([]) == []


def test_tree_deals_each_block_once():
    quotas = np.array([7, 0, 1, 100, 33], np.int64)
    for shards in (1, 2, 5, 16):
        parts = [mixing.shard_counts(quotas, shards, s, 9) for s in range(shards)]
        assert (sum(n for _, n in parts) == quotas).all()
        sizes = [int(n.sum()) for _, n in parts]
        assert max(sizes) - min(sizes) <= math.ceil(math.log2(shards)) + 1
        for i, q in enumerate(quotas):
            taken = sorted(x for first, n in parts for x in range(first[i], first[i] + n[i]))
            assert taken == list(range(q))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 20, 60]), rng.choice(["a", "b", "c", "c", "c", "c", "c", "é", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "x y", "c"), (7, "same text", "c"), (7, "same text", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("z")).withColumn("target", F.lit(1)).withColumn("mix_size", F.lit(2))
    options = {"block_words": 500, "shard_words": 5000}
    got = mixing.planned(df, **options).collect()
    assert len(got) == len(rows) and got[0].size == "z"
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and len(r.mix_copies) <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + len(r.mix_copies) * r.mix_size
        target[r.source] = r.mix_target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == mixing.targets([(s, sizes[s]) for s in order])
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    again = {(r.doc_id, r.text, str(r.mix_copies)) for r in mixing.planned(df.repartition(7), **options).collect()}
    assert again == {(r.doc_id, r.text, str(r.mix_copies)) for r in got}
    copies = mixing.mixed(df, **options)
    assert copies.count() == sum(len(r.mix_copies) for r in got)
    assert copies.select("mix_shard").distinct().count() == math.ceil(sum(sizes.values()) / 5000)
    assert mixing.planned(df.limit(0)).count() == 0
    assert mixing.planned(df.where("text is null")).first().mix_copies == []


# 4. Vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.05
    x[90:200] = x[90] + rng.normal(size=(110, 16)) * 0.25
    x[200:210] = x[200]
    x[210] = 3 * x[200]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16),
             (None, [float(v) for v in x[200]]), (1006, [1.0] + [0.0] * 15), (1007, [1.0]), (200, [float(v) for v in x[200]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(0)).withColumn("code", F.lit(""))
    got = pq.near_vectors(df, lists=6).collect()
    usable = [(k, np.pad(np.array(v, np.float64), (0, 16 - len(v)))) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([v for _, v in usable])
    c = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= 0.9
    np.fill_diagonal(c, False)
    roots = plain.components(range(len(usable)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(c))])
    lowest = {}
    for i, (k, _) in enumerate(usable):
        if k is not None:
            lowest[roots[i]] = min(k, lowest.get(roots[i], k))
    want = [(k, int(c[i].sum()), lowest[roots[i]]) for i, (k, _) in enumerate(usable)] + [(k, 0, k) for k in range(1000, 1006)]
    assert sorted(((r.vec_id, r.n_links, r.component) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.vec_id == r.component) for r in got)
    assert pq.near_vectors(df.limit(0)).count() == 0
    assert pq.near_vectors(df.where("vec_id = 1002")).first().n_links == 0


def test_recall_of_the_index(spark, sf):
    """On the embeddings table every link of a brute-force comparison is found."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    base = np.array([r.embedding for r in rows], np.float64)
    noisy = base + np.random.default_rng(2).normal(size=base.shape) * 0.03
    both = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, noisy)))]
    got = pq.near_vectors(spark.createDataFrame(both, "vec_id long, embedding array<double>"))
    m = np.concatenate((base, noisy))
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = int((m @ m.T >= 0.9).sum() - len(m))
    assert want > 100 and got.agg(F.sum("n_links")).first()[0] >= 0.9 * want


# 5. Token counts


def test_edits_against_full_encoding():
    counter = token_edits.Counter(token_edits.default_ranks())
    full = lambda t: len(counter.encoding.encode_ordinary(t))
    rng = random.Random(8)
    bits = ["a", "b", " ", "  ", "'", "s", "'ll", "1", "22", "\n", "\t", ".", "!!", "é", "中", "😀", "'re", "word", " the", "　"]
    for _ in range(150):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 600)))
        doc = token_edits.Document(t, counter)
        for _ in range(8):
            a = rng.randint(0, len(t))
            b = min(len(t), a + rng.choice([0, 0, 1, 3, 20, 300]))
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 10, 400])))
            t = t[:a] + new + t[b:]
            doc.edit(a, b, new)
            assert (doc.tokens, doc.chars, doc.text()) == (full(t), len(t), t)


def test_edits_read_little_again():
    counter = token_edits.Counter(token_edits.default_ranks())
    doc = token_edits.Document("some words here " * 20000, counter)
    doc.edit(100_000, 100_004, "other")
    assert doc.reread < 300 and doc.tokens == len(counter.encoding.encode_ordinary(doc.text()))
    spaces = token_edits.Document("a" + " " * 5000 + "b", counter)
    spaces.edit(2500, 2501, "x")
    assert spaces.tokens == len(counter.encoding.encode_ordinary(spaces.text()))


def test_edit_columns(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (None, ""), (1, "one two")], "doc_id long, text string").withColumn("key", F.lit(0))
    edits = F.expr("array(struct(0L as start, 3L as stop, 'three' as new), null, struct(99L as start, null as stop, null as new))")
    got = sorted((tuple(r) for r in token_edits.edited_counts(df, edits).collect()), key=str)
    assert [g[:4] for g in got] == sorted([(1, 2, 2, 9), (1, 2, 2, 9), (2, 0, 1, 5), (None, 0, 1, 5)], key=str)
    assert token_edits.edited_counts(df.limit(0), edits).count() == 0
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint,new:string>>")
    assert [r.reread_chars for r in token_edits.edited_counts(df, none).collect()] == [0] * 4


# 6. SentencePiece


def test_pieces_against_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = pieces.Pieces(pieces.default_model())
    rng = random.Random(5)
    bits = [" ", "a", "b", "e", "t", "h", "▁", "\n", "é", "😀", "\x00", "1", "the", "and ", "==", "----", "    ", "안", "\t", "ing", "\r\n", "ﷺ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "\n", "a" * 4000, "ab" * 2000, " " * 777, "<s></s><unk><0x0A>", "".join(rng.choice("abetihn=-_") for _ in range(5000))]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text)
        assert ids.tolist() == want and own.decode(ids) == library.decode(want) and own.decimal(ids).decode() == ",".join(map(str, want))


def test_pieces_columns(spark):
    df = spark.createDataFrame([(1, "hello  world"), (None, None), (2, ""), (1, "hello  world")], "doc_id long, text string").withColumn("key", F.lit(0))
    got = pieces.decoded(pieces.encoded(df)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "hello  world"), (None, ""), (2, ""), (1, "hello  world")]
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.ids_sha256 == empty for r in pieces.digested(df).collect()] == [False, True, True, False]
    assert pieces.digested(df.limit(0)).count() == 0


# 7. Substrings


def test_substrings_against_plain(spark):
    rng = random.Random(6)
    passage = [invented(rng, 60) + "." for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [invented(rng, rng.choice([3, 40, 120])) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(passage))
        rows.append((i, rng.choice(["\n", ". ", " "]).join(parts)))
    rows += [(200, None), (201, ""), (202, passage[0]), (203, passage[0].upper()), (None, passage[1] + " tail."), (204, "x. " * 60), (205, " ".join(["long"] * 70)),
             (206, "Said \"yes.\" Then (no!) and\r\nso on."), (207, rows[5][1]), (5, rows[5][1]), (5, "other text of that id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("removed_words", F.lit("old"))
    got = spans.without_repeats(df).collect()
    want = plain.without_repeats(rows)
    assert sorted(((r.doc_id, r.text, r.removed_words) for r in got), key=str) == sorted(((k, *w) for (k, _), w in zip(rows, want)), key=str)
    assert sum(w[1] for w in want) > 1000
    assert spans.without_repeats(df.limit(0)).count() == 0


# 8. HTML


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name, here</h1></header>
<div id=cookie-notice>We use cookies, yes.</div><nav><a href=/>Home</a></nav><script>var x = "</p><p>no";</script>
<div class="wrap"><article><header><h1>T&eacute;st &lt;1&gt;</h1></header><section><p>One, two<br>three&nbsp;<b>four</b> <i>five<p>Six, seven, eight
</section><ul><li>a<li>b</ul><!-- <p>not this</p> --><div class="ad">Buy, buy, buy now, it is cheap</div><form><p>Name, mail</p></form>
<table><tr><td>x<td>y</table><div id="comments"><p>Nice, nice, nice, nice, nice text</p></div></article></div>
<aside>Side, side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "Tést <1>\nOne, two three four five\nSix, seven, eight\na\nb\nx\ny"


def test_main_text_without_article():
    body = "".join(f"<p>Paragraph {i}, which is long enough, says one thing or another about the matter.</p>" for i in range(5))
    links = "".join(f"<p><a href=x>Some other page, which has a long name too</a>, {i}</p>" for i in range(9))
    page = f"<body><div>{links}</div><div class=main-text>{body}</div></body>"
    assert html_main.main_text(page) == "\n".join(f"Paragraph {i}, which is long enough, says one thing or another about the matter." for i in range(5))


def test_odd_pages(spark):
    pages = [None, "", "<", "<p", "plain & simple", "<script>x", "<div>" * 20000 + "deep", "a<b", '<a href="x', "<!-- open", "<p>1 < 2</p>", "&#x41;&amp;amp;"]
    want = ["", "", "<", "", "plain & simple", "", "deep", "a", "", "", "1 < 2", "A&amp;"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("main_text", F.lit("old"))
    assert [r.main_text for r in html_main.extracted(df).orderBy("page_id").collect()] == want
    assert html_main.extracted(df.limit(0)).count() == 0
    assert len(html_main.main_text("<p>" + "word, " * 200000)) == 1199999


# 9. Search


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_search_against_all_pairs(spark, scale):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(400, 20)), rng.integers(-2, 3, size=(100, 20)))) * scale
    x[450:] = x[450]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (None, x[0].tolist()), (903, []), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("v", F.lit(0))
    q = topk_segments.quantised(df)
    got = topk_segments.top_k(q.where("vec_id % 50 = 0"), q, 5, block=4).collect()
    whole = {i: [math.floor(256 * c) for c in v] for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole.items() if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_search_small_sides(spark):
    few = spark.createDataFrame([(0, [1, 2]), (1, [1, 1])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk_segments.top_k(few, few, 5).orderBy("query_id").collect()] == [(0, 1, 1, 3), (1, 1, 0, 3)]
    assert topk_segments.top_k(few.limit(0), few).count() == 0 and topk_segments.top_k(few, few.limit(0)).count() == 0


# 10. Quality


def test_model_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").limit(40)
    trusted = [(r.text, r.lang) for r in docs.collect()] + [("", "en"), (None, None), ("kurz", None)]
    model = quality.Table(*quality.fitted(spark.createDataFrame(trusted, "text string, lang string"), order=4))
    score = plain.kneser_ney(trusted, order=4)
    texts = [(t[:500], lang) for t, lang in trusted[:6]] + [("kurz und", None), ("$$$ ###", "en"), ("anything", "xx"), ("the of", "de")]
    got = model.log_perplexity([t for t, _ in texts], [x for _, x in texts], 4)
    assert got == pytest.approx([score(t, x) for t, x in texts], rel=1e-4)
    assert model.log_perplexity(["", "a"], ["en", "en"], 4)[0] is None and model.log_perplexity([], [], 4) == []


def test_held_out_quality(spark):
    """Accuracy on labelled documents whose labels the model never saw."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    out = quality.classified(docs, seen).join(labels.where("doc_id % 3 = 0 and toxic = 0"), "doc_id").collect()
    good, bad = [r.accepted for r in out if r.quality == 1], [r.accepted for r in out if r.quality == 0]
    assert len(good) > 50 and sum(good) >= 0.9 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some plain text here", "en"), (2, None, "en"), (3, "", None), (None, "more text", None), (1, "some plain text here", "en")],
                                 "doc_id long, text string, lang string").withColumn("threshold", F.lit("old")).withColumn("share", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs, labels).collect()
    assert sorted((str(r.doc_id), r.accepted) for r in got) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", True)]
    assert quality.classified(docs.limit(0), labels.limit(0)).count() == 0
