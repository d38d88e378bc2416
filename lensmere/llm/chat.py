"""Chat formatting by incremental rendering of a template that is only called, never read.

Successive prefixes of a conversation are rendered.  Where an output continues the one before, the
difference is the span of the turn; where it does not, the template rewrites its history, and the
conversation is marked and gets no loss mask.  The text within an assistant's span is found by rendering
the turn once more around a marker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns rendered together.  A longer conversation goes on in further windows, each after the last turn of
#: the one before, so that work grows with its length.  What they give together is held against whole prefixes.
WINDOW = 64
MARKER = "\ue000"
_START, _END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!\|))*+)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: every turn between markers, control strings inside escaped."""
    return "".join(f"{_START}{escape(r).replace(chr(10), chr(92) + chr(10))}\n{escape(t)}{_END}\n" for r, t in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text written by :func:`marked_turns`."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def spans(turns: list[Turn], template: Template, before: list[Turn] = (), learned: str = "assistant") -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(text, a span and a mask per turn, whether history is rewritten) of turns that follow ``before``.

    Positions count from the start of the text; a mask is empty for other roles than ``learned``.
    """
    so_far = list(before)
    last = template(so_far) if so_far else ""
    base = len(last)
    found = []
    for role, text in turns:
        so_far.append((role, text))
        now = template(so_far)
        if not now.startswith(last):
            return template(list(before) + list(turns)), [], True
        start = stop = len(last)
        if role == learned and text:
            marker = MARKER
            while marker in now or marker in role:
                marker += MARKER
            probe = template([*so_far[:-1], (role, marker)])
            head = probe.find(marker, len(last))
            tail = len(probe) - head - len(marker)
            if head < 0 or probe[:head] != now[:head] or len(now) - tail < head or tail and probe[-tail:] != now[-tail:]:
                return template(list(before) + list(turns)), [], True
            start, stop = head, len(now) - tail
        found.append((len(last) - base, len(now) - base, start - base, stop - base))
        last = now
    return last[base:], found, False


def _windows(batches: Iterator[pa.RecordBatch], size: int):
    """Consecutive turns of one conversation, up to ``size``: (key, number of the window, turns, turns before)."""
    key, turns, number, before = None, [], 0, []
    for batch in batches:
        for k, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if turns and (k != key or len(turns) == size):
                yield key, number, turns, before
                number, before = (number + 1, turns[-1:]) if k == key else (0, [])
                turns = []
            key = k
            turns.append((r, t))
    if turns:
        yield key, number, turns, before


def _conversations(windows, template: Template):
    """(key, number, text, turns, spans, rewrites) of every part.

    The parts so far are held against the template's text of all turns so far after 1, 2, 4, 8 ... windows and
    after the last.  Where they differ, or a window rewrites, the conversation does and is one part.
    """
    key, parts, turns, text, rewrites = None, [], [], "", False

    def done():
        if len(parts) > 1 and (rewrites or template(turns) != text):
            yield key, 0, template(turns), turns, [], True
        else:
            yield from parts

    for k, number, own, before in windows:
        if number == 0:
            yield from done()
            key, parts, turns, text, rewrites = k, [], [], "", False
        turns.extend(own)
        if not rewrites:
            whole, found, rewrites = spans(own, template, before)
            text += whole
            parts.append((k, number, whole, own, found, rewrites))
            if number and not rewrites and number + 1 & number == 0:
                rewrites = template(turns) != text
        else:
            parts.append(None)  # not given out, the conversation is one part
    yield from done()


def formatted(conversations: DataFrame, template: Template = marked_turns, window: int = WINDOW, conv: str = "conv_id",
              turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, formatted, turns, rewrites), parts of a conversation in order within one partition.

    ``turns`` holds (role, start, stop, loss_start, loss_stop) in code points of the part.  A conversation
    of up to ``window`` turns has one part, and so has one whose history is rewritten.  Turns are ordered by number, then role, then text; a null
    number comes first.  A null role or text is an empty one, rows with a null conversation form one.
    Repeated rows are turns each.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                F.coalesce(F.col(text), F.lit("")).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), *(
        T.StructField(c, T.LongType()) for c in ("start", "stop", "loss_start", "loss_stop"))]))
    schema = T.StructType([rows.schema["conv"], T.StructField("part", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("turns", span), T.StructField("rewrites", T.BooleanType())])
    names = [f.name for f in schema]

    def run(batches):
        import pyspark.sql.pandas.types as kinds

        arrow = kinds.to_arrow_schema(schema)
        out: list[list] = [[] for _ in names]
        held = 0
        for key, number, whole, turns, found, rewrites in _conversations(_windows(batches, window), template):
            row = key, number, whole, [dict(zip(("role", "start", "stop", "loss_start", "loss_stop"), (r, *s)))
                                       for (r, _), s in zip(turns, found)], rewrites
            for column, value in zip(out, row):
                column.append(value)
            held += len(whole)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
                out, held = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, schema)


def digested(parts: DataFrame) -> DataFrame:
    """A row per conversation, read back from the output of :func:`formatted` with the default template.

    Returns conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  Parts of a conversation
    must follow each other in one partition, as they leave :func:`formatted`; digests run along with them.
    """
    schema = T.StructType([parts.schema["conv"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
                           T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        import pyspark.sql.pandas.types as kinds

        arrow = kinds.to_arrow_schema(schema)
        key, state = None, None

        def done():
            n, all_turns, chars, loss, size = state
            return key, n, all_turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            rows = []
            for k, whole, masks in zip(*(batch.column(c).to_pylist() for c in ("conv", "formatted", "turns"))):
                if state is None or k != key:
                    if state is not None:
                        rows.append(done())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, t in read_turns(whole):
                    state[0] += 1
                    state[1].update(f"{r}\n{t}\n".encode())
                for m in masks:
                    learned = unescape(whole[m["loss_start"]:m["loss_stop"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(whole)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), arrow)], schema=arrow)

    return parts.mapInArrow(run, schema)
