"""The store of conversations: events in many batches, repeated batches, a plain replay."""

import random

import pytest

from lensmere.session import ship
from lensmere.streaming import conversations

KIND = "conv_id long, seq long, action string, role string, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def plain(events):
    store = {}
    for conv, seq, action, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        text = (text or "") if action == "rename" else (text or "").strip()
        if action == "delete":
            store.pop(conv, None)
        elif action == "rename":
            if conv in store:
                store[conv] = [(text or "Untitled")[:80], store[conv][1], seq]
        else:
            new = conv not in store
            item = store.setdefault(conv, [(text or "New chat")[:80] if action == "create" else "New chat", 0, seq])
            item[2] = seq
            if action == "append":
                item[1] += 1
                if role == "user" and item[0] in ("", "New chat") and text:
                    item[0] = text[:60]
            assert new or item
    return sorted((k, *v) for k, v in store.items())


def test_batches_and_repeats(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.randrange(12), i, rng.choice(["append"] * 6 + ["rename", "rename", "delete", "create"]), rng.choice(["user", "assistant"]),
               rng.choice([None, "", "  ", "New chat", " hello there ", "word " * 40])) for i in range(300)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for n in range(0, 300, 60):
        spark.createDataFrame(events[n:n + 60], KIND).coalesce(1).write.mode("append").parquet(source)

        def run():
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
            conversations.keep(stream, out, checkpoint).awaitTermination()
            return sorted(map(tuple, conversations.listing(spark, out).collect()))

        assert run() == plain(events[:n + 60])
    # The last batch was written, and its end was not noted: it is run again and replaces itself.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == plain(events)
