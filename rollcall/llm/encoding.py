"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

A streaming transducer. The vocabulary's pattern cuts a text lazily into pieces; inside a piece the encoder reads one
byte after the other and keeps, for the last `lookahead` positions, the last token of the encoding of the text up to
there. That token is the longest vocabulary entry ending there that is compatible with the token before it (two
tokens are compatible if the merge list turns their joined bytes into just these two). A token is stable, and emitted,
once every position that later tokens can reach back to descends from it. `lookahead` is the length of the longest
token, computed from the merge list, so memory is constant in the length of the piece. Short pieces repeat; each
worker keeps a bounded cache of their ids.

Decoding turns ids to bytes and feeds them to an incremental UTF-8 state machine.

Defined results: null and empty texts give an empty array; strings of special tokens are ordinary text; texts of any
length are read whole; repeated rows are encoded each; extra columns are passed by. The vocabulary's bytes travel with
the task (a file of fixed size, under 1 MB), so executors need no path to it.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Folder of the public vocabulary files; every function takes another one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into pieces for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 17
SHORT = 64


class Transducer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        #: A token reaches back no further than this, so no later byte changes what all positions in this window agree on.
        self.lookahead = max(map(len, self.ranks))
        self.split = regex.compile(pattern).finditer
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merge list applied to a few bytes: lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        """Whether `token` may follow `before` (-1: the piece's start)."""
        if token not in self._whole:
            self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        if not self._whole[token] or before < 0:
            return self._whole[token]
        pair = before, token
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > 4 * CACHE:
                self._pairs.clear()
            known = self._pairs[pair] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one piece, fed byte by byte; each as soon as it is stable."""
        window = bytearray()  # the bytes of positions base .. base + len(window)
        base, at = 0, 0
        last: dict[int, tuple[int, int]] = {0: (-1, -1)}  # position: last token, position before it
        for byte in data:
            window.append(byte)
            at += 1
            for start in range(max(base, at - self.lookahead), at):
                token = self.ranks.get(bytes(window[start - base :]))
                if token is not None and start in last and self._fits(last[start][0], token):
                    last[at] = token, start
                    break
            if at - base >= 4 * self.lookahead:
                stable = self._common(last, at)
                if stable > base:
                    yield from self._path(last, base, stable)
                    token = last[stable][0]
                    last = {p: v for p, v in last.items() if p >= stable}
                    last[stable] = token, -1
                    del window[: stable - base]
                    base = stable
        yield from self._path(last, base, at)

    def _common(self, last: dict[int, tuple[int, int]], at: int) -> int:
        """The latest position that every position still in reach descends from."""
        heads = {p for p in range(at - self.lookahead + 1, at + 1) if p in last}
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(last[top][1])
        return heads.pop()

    @staticmethod
    def _path(last: dict[int, tuple[int, int]], base: int, to: int) -> list[int]:
        out = []
        while to > base:
            token, to = last[to]
            out.append(token)
        return out[::-1]

    def pieces(self, text: str) -> Iterator[int]:
        """Ids of a text, one by one."""
        cache = self._cache
        for m in self.split(text):
            piece = m[0]
            if len(piece) > SHORT:
                yield from self.stream(piece.encode())
                continue
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode()
                whole = self.ranks.get(raw)
                ids = (whole,) if whole is not None and self._fits(-1, whole) else tuple(self.stream(raw))
                if len(cache) >= CACHE:
                    cache.clear()
                cache[piece] = ids
            yield from ids

    def encode(self, text: str | None) -> list[int]:
        return list(self.pieces(text)) if text else []

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, as soon as whole characters are there; bytes that are no UTF-8 give U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if part := machine.decode(self.bytes_of[int(i)]):
                yield part
        if part := machine.decode(b"", final=True):
            yield part


_loaded: dict[tuple[int, str], Transducer] = {}


def transducer(vocabulary: bytes, pattern: str = PATTERN) -> Transducer:
    """One transducer per vocabulary and Python worker."""
    key = hash(vocabulary), pattern
    if key not in _loaded:
        _loaded[key] = Transducer(vocabulary, pattern)
    return _loaded[key]


def read_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    return Path(folder, name).read_bytes()


def encode_column(column: str, vocabulary: bytes):
    """Column of ids (ARRAY<INT>) of a text column."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        encode = transducer(vocabulary).encode
        return pd.Series([encode(t) for t in texts])

    return ids(F.col(column))


def count_column(column: str, vocabulary: bytes):
    """Column of the number of tokens of a text column; nothing but the count comes back from Python."""

    @F.pandas_udf(IntegerType())
    def counts(texts: pd.Series) -> pd.Series:
        pieces = transducer(vocabulary).pieces
        return pd.Series([sum(1 for _ in pieces(t)) if t else 0 for t in texts], dtype="int32")

    return counts(F.col(column))


def decode_column(column: str, vocabulary: bytes):
    """Column of the text of a column of ids; null for null."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        decode = transducer(vocabulary).decode
        return ids.map(lambda x: "".join(decode(x)), na_action="ignore")

    return texts(F.col(column))


def encode_documents(documents: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, ids) of every document. No shuffle: rows are spread once more only if there are fewer splits than cores."""
    rows = spread(documents.select("doc_id", "text"))
    return rows.select("doc_id", encode_column("text", vocabulary or read_vocabulary()).alias("ids"))


def spread(df: DataFrame, least_bytes: int = 1 << 20) -> DataFrame:
    """df over all cores when a small file would leave most of them idle; a table with more splits than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
