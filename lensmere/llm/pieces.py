"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch's distinct words stand as one flat array of symbols.  In each round every word finds its best
pair (highest score, leftmost at a tie), and all words merge theirs at once; a word also merges further
occurrences of that pair as long as no pair that the merges create could have come before them.  The
arrays are compacted until no pair is left.  Ids become text again through flat arrays of piece bytes.

Covers BPE models with the identity normaliser, a dummy prefix and kept white space.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from lensmere.llm import flat, shared

SPACE = "▁"
#: A worker keeps the ids of so many short words; it starts anew beyond that.
REMEMBERED = 300_000
REMEMBERED_CHARS = 24
#: Symbols that one call of the merge rounds takes at a time; a longer word makes a call of its own.
ROUND_SYMBOLS = 1 << 19
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces as arrays: pair table, scores, bytes."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not covered")
        self.unknown = model.unk_id()
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.bytes = np.array([byte.get(b, self.unknown) for b in range(256)], np.int64)
        own = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("pieces that cross words are not covered")
        # Symbols: an id, or beyond the ids a character that is no piece itself.
        self.symbols = dict(own)
        for p in own:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        self.n = n
        pairs: dict[tuple[int, int], int] = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(list(pairs.values()), np.int64)[order], 0)
        score = np.array([model.get_score(i) for i in range(n)])
        # Rank 0 is the highest score; equal scores share a rank.
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.worst = np.int64(n + 1)
        # What decoding writes: bytes of each id, and whether it is a raw byte.
        out = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i)
               else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
               for i, p in enumerate(pieces)]
        self.out_at = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        digits = [f"{i},".encode() for i in range(n)]
        self.digits_at = np.concatenate(([0], np.cumsum([len(x) for x in digits])))
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        # The symbol of every code point; characters that stand in no longer piece part words for good.
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.parts_lines = not any("\n" in p and len(p) > 1 for p in own)
        # Remembered words: after a space (without it), and at the start of a line.
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.spaced.clear()
        self.bare.clear()
        self.ids, self.ids_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    # Encoding

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; the worst rank where they make no piece."""
        key = (left << 32) | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        merged = self.merged[at]
        return np.where(hit, self.rank[merged], self.worst), merged

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols after all merges, their words, and the first character of each."""
        done = []
        first = np.arange(len(symbols))
        rank = np.full(len(symbols), self.worst)
        merged = np.zeros(len(symbols), np.int64)
        if len(symbols):
            at = np.flatnonzero(word[:-1] == word[1:])
            rank[at], merged[at] = self._pairs(symbols[at], symbols[at + 1])
        while len(symbols) > 1:
            starts = np.flatnonzero(np.concatenate(([True], word[:-1] != word[1:])))
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            live = best < self.worst
            if not live.all():
                gone = np.repeat(~live, lengths)
                done.append((symbols[gone], word[gone], first[gone]))
                symbols, word, first, rank, merged = (x[~gone] for x in (symbols, word, first, rank, merged))
                lengths, best = lengths[live], best[live]
                if not len(symbols):
                    break
            of = np.repeat(np.arange(len(lengths)), lengths)
            hits = np.flatnonzero(rank == best[of])
            own = of[hits]
            # In each word: the leftmost hit, and those after it with the same pair that don't overlap.
            lead = np.concatenate(([True], own[1:] != own[:-1]))
            leader = hits[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            ok = (symbols[hits] == symbols[leader]) & (symbols[hits + 1] == symbols[leader + 1])
            if (~ok).any():  # another pair of the same rank ends the round for its word
                stop = np.cumsum(~ok)
                base = stop[np.flatnonzero(lead)][np.cumsum(lead) - 1]
                ok &= stop == base
                hits, own, lead = hits[ok], own[ok], lead[ok]
            run = np.concatenate(([True], (hits[1:] != hits[:-1] + 1)))
            start = np.flatnonzero(run)
            place = np.arange(len(hits)) - start[np.cumsum(run) - 1]
            take = place % 2 == 0
            hits, own, lead = hits[take], own[take], lead[take]
            if not lead.all():
                new = merged[hits]
                n = len(symbols)
                size = np.append(np.cumsum(lengths), 0)
                begin = size[own] - lengths[own]
                before = hits - 1
                has = before >= begin
                left = symbols[np.maximum(before, 0)].copy()
                joined = np.concatenate(([False], hits[1:] == hits[:-1] + 2))
                left[joined] = new[np.flatnonzero(joined) - 1]
                worse = has & (self._pairs(left, new)[0] <= best[own])
                after = hits + 2
                has = after < size[own]
                worse |= has & (self._pairs(new, symbols[np.minimum(after, n - 1)])[0] <= best[own])
                # A merge that makes such a pair is the last one of its word in this round.
                seen = np.cumsum(worse) - worse
                base = seen[np.flatnonzero(lead)][np.cumsum(lead) - 1]
                keep = seen == base
                hits = hits[keep]
            symbols[hits] = merged[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, word, first, rank, merged = (x[stay] for x in (symbols, word, first, rank, merged))
            # Only pairs on either side of a merge are new.
            at = hits - np.arange(len(hits))
            near = np.zeros(len(symbols), bool)
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            at = np.flatnonzero(near)
            rank[at] = self.worst
            at = at[at < len(symbols) - 1]
            at = at[word[at] == word[at + 1]]
            rank[at], merged[at] = self._pairs(symbols[at], symbols[at + 1])
        done.append((symbols, word, first))
        symbols, word, first = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(first, kind="stable")
        return symbols[order], word[order], first[order]

    def _learn(self, new: list[str]) -> np.ndarray:
        """Append the ids of new words; their numbers."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        parts, counts = [self.ids], [np.diff(self.ids_at)]
        start = 0
        while start < len(new):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + ROUND_SYMBOLS, "right")))
            text = "".join(new[start:stop])
            symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
            symbols, word, first = self.merge(symbols, np.repeat(np.arange(stop - start), sizes[start:stop]))
            odd = np.flatnonzero((symbols < 0) | (symbols >= self.n))
            if len(odd):  # characters outside the vocabulary: their bytes
                raw = [text[i].encode() for i in first[odd]]
                times = np.ones(len(symbols), np.int64)
                times[odd] = [len(x) for x in raw]
                at = np.cumsum(times) - times
                symbols, word = np.repeat(symbols, times), np.repeat(word, times)
                for i, x in zip(at[odd], raw):
                    symbols[i:i + len(x)] = self.bytes[np.frombuffer(x, np.uint8)]
            parts.append(symbols)
            counts.append(np.bincount(word, minlength=stop - start))
            start = stop
        base = len(self.ids_at) - 1
        self.ids = np.concatenate(parts)
        self.ids_at = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.arange(base, base + len(new))

    def _numbers(self, known: dict[str, int], words: list[str], prefix: str) -> np.ndarray:
        new = list(set(words).difference(known))
        long = []
        if new:
            numbers = self._learn([prefix + w for w in new] if prefix else new)
            known.update(zip(new, numbers.tolist()))
            long = [w for w in new if len(w) > REMEMBERED_CHARS]
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in long:
            del known[w]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if len(self.ids_at) > REMEMBERED:
            self._forget()
        spaced, bare = [], []
        at, texts_at = [0], [0]  # where bare words stand among the spaced ones, and where texts begin
        for text in texts:
            if text:
                text = SPACE + text.replace(" ", SPACE)
                for i, line in enumerate(text.split("\n") if self.parts_lines else (text,)):
                    if i:
                        bare.append("\n")
                        at.append(len(spaced) + len(bare) - 1)
                    if not line:
                        continue
                    if SPACE * 2 in line or line[-1] == SPACE:
                        head = line.split(SPACE, 1)[0]
                        units = _WORD.findall(line)
                        if head:
                            bare.append(head)
                            at.append(len(spaced) + len(bare) - 1)
                        for u in units:
                            bare.append(u)
                            at.append(len(spaced) + len(bare) - 1)
                        continue
                    parts = line.split(SPACE)
                    if parts[0]:
                        bare.append(parts[0])
                        at.append(len(spaced) + len(bare) - 1)
                    del parts[0]
                    spaced += parts
            texts_at.append(len(spaced) + len(bare))
        is_bare = np.zeros(len(spaced) + len(bare), bool)
        is_bare[at[1:]] = True
        numbers = np.empty(len(is_bare), np.int64)
        numbers[is_bare] = self._numbers(self.bare, bare, "")
        numbers[~is_bare] = self._numbers(self.spaced, spaced, SPACE)
        sizes = self.ids_at[numbers + 1] - self.ids_at[numbers]
        ids = _gather(self.ids, self.ids_at, numbers)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[texts_at]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids, as the library's decode gives it."""
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        raw = _gather(self.out, self.out_at, ids)
        skip = 0
        if not self.is_byte[ids[0]] and ids[0] != self.unknown and len(raw) and raw[0] == 32:
            skip = 1
        return raw[skip:].tobytes().decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(self.digits, self.digits_at, ids).tobytes()[:-1]


def _gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The slices flat[at[r]:at[r + 1]] one after another."""
    n = at[rows + 1] - at[rows]
    ends = np.cumsum(n)
    if not len(rows):
        return flat[:0]
    index = np.repeat(at[rows] - ends + n, n)
    index += np.arange(ends[-1])
    return flat[index]


def _forget() -> None:
    """Drop the words that this worker remembers."""
    for known in _known.values():
        known._forget()


_known: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _known:
        _known[path] = Pieces(path)
    return _known[path]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, ids) for every row: the ids of the whole text without begin or end ids.

    A null text is an empty one and has no ids.  Keys are carried as they are, null or repeated; an
    empty table gives an empty result.  Other columns are not read.
    """
    path = model or default_model()

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for keys, texts in _groups(batch):
                ids = pieces.encode(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(shared.tidy(run, _forget), T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.withColumnRenamed("key", key)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None) -> DataFrame:
    """The rows with ``text``, what their ids decode to; null ids give a null text."""
    path = model or default_model()
    rows = rows.drop(text)

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            texts = [None if x.as_py() is None else pieces.decode(np.asarray(x.values, np.int64)) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(shared.tidy(run, _forget), T.StructType([*rows.schema, T.StructField(text, T.StringType())]))


def _groups(batch: pa.RecordBatch):
    """(keys, texts) of parts of a batch."""
    for part in flat.slices(batch, "text"):
        yield part.column("key"), part.column("text").to_pylist()


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded, decoded from the ids, and both digested.

    Nulls, repeats and empty tables as in :func:`encoded`; an empty text gives the digests of nothing.
    """
    path = model or default_model()

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for keys, texts in _groups(batch):
                ids = pieces.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(pieces.decimal(x)).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(shared.tidy(run, _forget), T.StructType([
        rows.schema["key"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())]))
    return out.withColumnRenamed("key", key)
