"""Token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: leaves hold their characters and tokens, inner
nodes the sums below them.  An edit finds the leaves it touches by descending on character sums, splits
only that region and some context into pre-tokens again, encodes what is new, and updates the sums above.
The context grows until the new cuts fall in with the old ones, so counts equal those of a full encoding.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters on either side of an edit that are split again at first; doubled while cuts disagree.
CONTEXT = 32
#: Pre-tokens that a leaf of the tree holds.
LEAF = 64
#: A worker keeps the token counts of so many short pre-tokens; it starts anew beyond that.
REMEMBERED = 500_000
REMEMBERED_CHARS = 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# Fixed value: the public pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Known(dict):
    """Token counts by pre-token, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], encoding: tiktoken.Encoding) -> None:
        super().__init__()
        self.ranks, self.encode = ranks, encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = 1 if piece.encode() in self.ranks else len(self.encode(piece))
        if len(piece) <= REMEMBERED_CHARS:
            self[piece] = n
        return n


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known = _Known(ranks, self.encoding)

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return list(map(self.known.__getitem__, pieces))


class Document:
    """A text with its pre-tokens in a tree of sums; ``reread`` counts the characters that edits encoded anew."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        self.reread = 0
        pieces = counter.split(text)
        self.leaves = list(_leaves(pieces, list(map(len, pieces)), counter.counts(pieces))) or [("", [], [])]
        self._grow()

    def _grow(self) -> None:
        """Build the sums above the leaves anew."""
        n = len(self.leaves)
        self.size = size = 1 << (n - 1).bit_length()
        rest = [0] * (size - n)
        self.chars_at = [0] * size + [len(leaf[0]) for leaf in self.leaves] + rest
        self.tokens_at = [0] * size + [sum(leaf[2]) for leaf in self.leaves] + rest
        for sums in (self.chars_at, self.tokens_at):
            for node in range(size - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self.tokens_at[1]

    @property
    def chars(self) -> int:
        return self.chars_at[1]

    def _leaf(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at ``place``, characters before it)."""
        node, before, sums = 1, 0, self.chars_at
        while node < self.size:
            node *= 2
            if place - before >= sums[node] and sums[node + 1]:
                before += sums[node]
                node += 1
        return node - self.size, before

    def _put(self, leaf: int, text: str, chars: list[int], tokens: list[int]) -> None:
        """Replace a leaf and update the sums above it."""
        self.leaves[leaf] = text, chars, tokens
        node = self.size + leaf
        for sums, now in ((self.chars_at, len(text)), (self.tokens_at, sum(tokens))):
            change, at = now - sums[node], node
            while change and at:
                sums[at] += change
                at //= 2

    def text(self, start: int = 0, stop: int | None = None) -> str:
        stop = self.chars if stop is None else stop
        if start >= stop:
            return ""
        first, before = self._leaf(start)
        out, at = [], before
        for leaf in range(first, len(self.leaves)):
            if at >= stop:
                break
            out.append(self.leaves[leaf][0])
            at += len(out[-1])
        return "".join(out)[start - before:stop - before]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``stop``."""
        n = self.chars
        start, stop = min(start, n), min(max(start, stop), n)
        reach = CONTEXT
        while True:
            first, before, k, low = self._cut(max(0, start - reach), True)
            last, after, m, high = self._cut(min(n, stop + reach), False)
            # One piece of text holds what is split: the region up to its last cut, and what a split may look at.
            region = self.text(low, start) + new + self.text(stop, high)
            pieces = self._split(region, self.text(high, min(n, high + CONTEXT)), high == n)
            if pieces is not None:
                break
            reach *= 2
        self.reread += len(region)
        head, tail = self.leaves[first], self.leaves[last]
        text = head[0][:low - before] + region + tail[0][high - after:]
        chars = head[1][:k] + list(map(len, pieces)) + tail[1][m:]
        tokens = head[2][:k] + self.counter.counts(pieces) + tail[2][m:]
        if len(chars) <= 4 * LEAF:
            self._put(first, text, chars, tokens)
            for leaf in range(first + 1, last + 1):
                self._put(leaf, "", [], [])
        else:
            ends = list(itertools.accumulate(chars, initial=0))
            self.leaves[first:last + 1] = _leaves([text[a:b] for a, b in itertools.pairwise(ends)], chars, tokens)
            self._grow()

    def _cut(self, place: int, down: bool) -> tuple[int, int, int, int]:
        """The last cut at or before a place, or the first at or after it: (leaf, characters before the leaf,
        pre-tokens of the leaf before the cut, the cut)."""
        leaf, before = self._leaf(place if down else max(0, place - 1))
        ends = list(itertools.accumulate(self.leaves[leaf][1], initial=before))
        i = bisect.bisect_right(ends, place) - 1 if down else min(bisect.bisect_left(ends, place), len(ends) - 1)
        return leaf, before, i, ends[i]

    def _split(self, region: str, right: str, ends: bool) -> list[str] | None:
        """Pre-tokens of the region, or None where it doesn't end at a cut.

        The pattern starts afresh at every cut and looks at most two characters beyond a pre-token.  So the
        cut on the left holds, being further than that before the edit, and where the region's end is a cut
        again, all that follows is cut as before.
        """
        pieces = self.counter.split(region + right)
        at, size = 0, len(region)
        for i, p in enumerate(pieces):
            if at >= size:
                return pieces[:i] if at == size else None
            at += len(p)
        return pieces if at == size and ends else None


def _leaves(pieces: list[str], chars: list[int], tokens: list[int]):
    for i in range(0, len(pieces), LEAF):
        yield "".join(pieces[i:i + LEAF]), chars[i:i + LEAF], tokens[i:i + LEAF]


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def edited_counts(docs: DataFrame, edits: Column, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(key, n_tokens, n_tokens_edited, n_chars_edited, reread_chars) for every row.

    ``edits`` is an array of (start, stop, new): one after another, each in code points of the text as it
    is by then, puts ``new`` in the place of the characters from ``start`` up to ``stop``.  Places beyond
    the end mean the end.  ``reread_chars`` counts the characters that edits had split and encoded anew.

    A null text is an empty one; null edits, and nulls within one, change nothing or stand for 0 and an
    empty text.  Repeated rows are counted each; an empty table gives an empty result.  Other columns are
    not read.
    """
    path = ranks or default_ranks()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), edits.cast("array<struct<start:bigint,stop:bigint,new:string>>").alias("edits"))

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            out = []
            for t, own in zip(batch.column("text"), batch.column("edits")):
                doc = Document(t.as_py() or "", counter)
                before = doc.tokens
                for e in own.as_py() or ():
                    if e is not None:
                        start = max(0, e["start"] or 0)
                        doc.edit(start, max(start, e["stop"] or 0), e["new"] or "")
                out.append((before, doc.tokens, doc.chars, doc.reread))
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["key", "n_tokens", "n_tokens_edited", "n_chars_edited", "reread_chars"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["key"], *(
        T.StructField(c, T.LongType()) for c in ("n_tokens", "n_tokens_edited", "n_chars_edited", "reread_chars"))]))
    return out.withColumnRenamed("key", key)
