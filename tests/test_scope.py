"""Labelled messages: every kind must be recognised."""

from pyspark.sql import functions as F

from lensmere.operators import gates

CASES = [
    ("", "greeting", False), ("hiya", "greeting", False), ("Good afternoon!", "greeting", False),
    ("how are you doing", "greeting", False),
    ("okay, many thanks", "thanks", False), ("thx doc", "thanks", False),
    ("see you later", "farewell", False), ("ok, goodbye", "farewell", False),
    ("what's your name", "identity", False), ("please introduce yourself", "identity", False),
    ("since Sunday there is a burning pain under my ribs", "medical", False),
    ("my blood pressure was 155 over 95 this morning", "medical", False),
    ("which fever is too high for a toddler?", "medical", False),
    ("give me the history of medicine, please", "medical", False),
    ("would that be normal?", "medical", True), ("since last week", "medical", True),
    ("debug this javascript for me", "out_of_scope", False),
    ("compose a short poem for my aunt", "out_of_scope", False),
    ("who founded that city", "out_of_scope", False),
    ("who fought in the world wars", "out_of_scope", False),
    ("history of the roman empire", "out_of_scope", False),
    ("which anime should we watch", "out_of_scope", False),
    ("results of the hockey final", "out_of_scope", False),
    ("is now the time to buy ethereum", "out_of_scope", False),
    ("cheap hotels near the beach", "out_of_scope", False),
    ("what gpu fits my case", "out_of_scope", False),
    ("how to bake sourdough", "out_of_scope", False),
]


def test_kinds(spark):
    rows = [(i, t, k, c) for i, (t, k, c) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string, expected string, going boolean")
    got = gates.scope(df, in_conversation=df.going).collect()
    wrong = [(r.text, r.expected, r.kind, r.reason) for r in got if r.kind != r.expected]
    assert not wrong


def test_image_and_own_vocabulary(spark):
    df = spark.createDataFrame([("crack a joke",), ("flights in May",)], "text string")
    assert {r.kind for r in gates.scope(df, has_image=F.lit(True)).collect()} == {"medical"}
    kinds = {r.text: r.kind for r in gates.scope(df, vocabulary=["joke"]).collect()}
    assert kinds["crack a joke"] == "medical"


def test_medical_history_is_excepted_where_it_stands(spark):
    df = spark.createDataFrame([("history of medicine",), ("history of medicine and history of chess",)], "text string")
    got = {r.text: r.kind for r in gates.scope(df, vocabulary=["zzz"]).collect()}
    assert list(got.values()) == ["medical", "out_of_scope"]
