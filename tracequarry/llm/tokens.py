"""Problem 8: token ids of whole texts with a public byte-level BPE.

Monoid tree reduction. A text is halved down to leaves of ``LEAF`` characters, every
leaf is encoded, and neighbours are joined by encoding a window around their border
anew. The window grows outwards to the nearest *sync point* on either side; tokens
outside it provably stay as they are:

the splitting pattern's pieces are an optional space and a run of letters, of digits
or of other marks, or a run of white space, or an apostrophe with s, t, re, ve, m, ll
or d. So every scan, whatever came before, has a border where white space follows
something else, where a run of letters or of digits ends, and where letters or digits
follow a mark other than an apostrophe. Merges never cross such a border. Without any
sync point the window grows to the ends of both halves, which is still right.

Defined results: null and empty texts have the ids ``[]``; special-token strings in a
text are ordinary text; ids of a text are those of the direct encoding.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
LEAF = 16_384
#: Splitting pattern of the tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where every scan has a border between pieces.
SYNC = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


class Tokenizer:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.leaf = leaf

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        return self._tree(text, 0, len(text))

    def decode(self, ids) -> str:
        """Concatenation up the tree: bytes of the tokens in order."""
        return self.encoding.decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")

    def _tree(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.encoding.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._tree(text, low, middle), self._tree(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, stop = self._sync_before(text, low, middle), self._sync_after(text, middle, high)
        keep = len(left) - self._count(reversed(left), len(text[start:middle].encode()))
        skip = self._count(right, len(text[middle:stop].encode()))
        return left[:keep] + self.encoding.encode_ordinary(text[start:stop]) + right[skip:]

    def _count(self, tokens, n_bytes: int) -> int:
        """How many tokens hold the next n_bytes; a sync point is a border of tokens."""
        n = 0
        for token in tokens:
            if n_bytes <= 0:
                break
            n_bytes -= int(self.lengths[token])
            n += 1
        if n_bytes:
            raise AssertionError("a sync point is no border of tokens")
        return n

    @staticmethod
    def _sync_before(text: str, low: int, middle: int) -> int:
        """The last sync point p with low < p < middle (both characters inside the left half), or low."""
        width = 64
        while True:
            begin = max(low, middle - width)
            found = [m.start() for m in SYNC.finditer(text, begin, middle) if begin < m.start() < middle]
            if found:
                return found[-1]
            if begin == low:
                return low
            width *= 4

    @staticmethod
    def _sync_after(text: str, middle: int, high: int) -> int:
        """The first sync point p with middle < p < high, or high."""
        width = 64
        while True:
            end = min(high, middle + width)
            for m in SYNC.finditer(text, middle, end):
                if middle < m.start() < end:
                    return m.start()
            if end == high:
                return high
            width *= 4


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, leaf: int = LEAF) -> Tokenizer:
    """One per Python worker, of a file that was shipped."""
    return Tokenizer(SparkFiles.get(path), leaf)


def vocabulary(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    return f"{tokenizers}/{name}.tiktoken"


def shipped(spark: SparkSession, tokenizers: str = TOKENIZERS) -> str:
    """Gives the executors the driver's vocabulary file (half a MB), as they may not have that folder; returns its name."""
    path = vocabulary(tokenizers)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def ids_column(text: str, path: str, leaf: int = LEAF) -> Column:
    """The ids of a text column, as a vectorised UDF."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(path, leaf)
        for texts in batches:
            yield pd.Series([np.asarray(own.encode(t), dtype=np.int32) for t in texts], index=texts.index, dtype=object)

    return encode(F.col(text))


def document_ids(documents: DataFrame, tokenizers: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """p8_ids: (doc_id, ids) of every document."""
    return documents.select("doc_id", ids_column("text", shipped(documents.sparkSession, tokenizers), leaf).alias("ids"))


def decoded_documents(documents: DataFrame, tokenizers: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, restored): whether decoding the ids gives the text back (null counts as empty)."""
    path = shipped(documents.sparkSession, tokenizers)

    @F.pandas_udf(T.StructType([T.StructField("n_tokens", T.IntegerType()), T.StructField("restored", T.BooleanType())]))
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, leaf)
        for texts in batches:
            ids = [own.encode(t) for t in texts]
            yield pd.DataFrame({"n_tokens": np.array([len(x) for x in ids], dtype=np.int32), "restored": [own.decode(x) == (t or "") for x, t in zip(ids, texts)]}, index=texts.index)

    return documents.select("doc_id", check(F.col("text")).alias("r")).select("doc_id", "r.n_tokens", "r.restored")
