"""Problem 8: token ids of whole texts by a public byte-level tokenizer, as a tree reduction over text halves.

A node of the tree holds the pieces (pre-tokens) of its span and their ids. Two neighbours are joined by scanning a
window over their border again, from the last piece of the left that can't depend on the right, until a
boundary of the scan falls on one of the right's. From there on the right's own scan holds, because the pattern never looks
back: that is the proof that the tokens outside the window are final. The join is associative, so halves may be
encoded in any order, and decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strandwork.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind the end of a piece that may decide it: a contraction needs two more, ``\s+(?!\S)`` two.
LOOK_AHEAD = 3
_CACHE = 200_000
#: rows whose ids are held at a time
_SLICE = 512


class Node:
    """The pieces of a span: their ends as offsets in the whole text, and the ids of each."""

    __slots__ = ("ends", "ids")

    def __init__(self, ends: list[int], ids: list[list[int]]):
        self.ends, self.ids = ends, ids


class TreeEncoder:
    """Encodes texts with the ranks of a vocabulary file; ``leaf_chars`` is the longest span that is encoded in one go."""

    def __init__(self, vocabulary: str = VOCABULARY, leaf_chars: int = 512, window: int = 32):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._core = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._scan = regex.compile(PATTERN).finditer
        self._known: dict[str, list[int]] = {}
        self.leaf_chars, self.window = max(1, leaf_chars), max(1, window)

    def _piece(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            ids = self._core._core_bpe.encode_single_piece(piece.encode("utf-8", "replace"))
            if len(piece) < 40:
                if len(self._known) >= _CACHE:
                    self._known.clear()
                self._known[piece] = ids
        return ids

    def leaf(self, text: str, start: int, end: int) -> Node:
        ends, ids = [], []
        for m in self._scan(text, start, end):
            ends.append(m.end())
            ids.append(self._piece(m.group()))
        return Node(ends, ids)

    def join(self, text: str, left: Node, right: Node, start: int, middle: int, end: int) -> Node:
        """The node of ``text[start:end]`` from those of its two parts."""
        final = bisect_right(left.ends, middle - LOOK_AHEAD)
        restart = left.ends[final - 1] if final else start
        width = self.window
        while True:
            stop = min(end, middle + width)
            certain = stop if stop == end else stop - LOOK_AHEAD
            ends, pieces, met = [], [], -1
            for m in self._scan(text, restart, stop):
                e = m.end()
                if e > certain:
                    break
                ends.append(e)
                pieces.append(m.group())
                if e >= middle:
                    at = bisect_left(right.ends, e)
                    if e == middle or (at < len(right.ends) and right.ends[at] == e):
                        met = e
                        break
            if met >= 0 or stop == end:
                break
            width *= 2
        rest = bisect_right(right.ends, met) if met >= 0 else len(right.ends)
        return Node(left.ends[:final] + ends + right.ends[rest:], left.ids[:final] + [self._piece(p) for p in pieces] + right.ids[rest:])

    def node(self, text: str, start: int, end: int) -> Node:
        if end - start <= self.leaf_chars:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.node(text, start, middle), self.node(text, middle, end), start, middle, end)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null and empty texts. A blank text is text like any other."""
        if not text:
            return []
        return [i for ids in self.node(text, 0, len(text)).ids for i in ids]

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids, bytes concatenated up the tree; bytes that end within a character become U+FFFD."""

        def span(a: int, b: int) -> bytes:
            if b - a <= self.leaf_chars:
                return b"".join(self._core.decode_single_token_bytes(i) for i in ids[a:b])
            return span(a, (a + b) // 2) + span((a + b) // 2, b)

        return span(0, len(ids)).decode("utf-8", "replace") if ids else ""


@lru_cache(maxsize=4)
def encoder(vocabulary: str, leaf_chars: int) -> TreeEncoder:
    """One per worker process."""
    return TreeEncoder(vocabulary, leaf_chars)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, leaf_chars: int = 512) -> DataFrame:
    """Add ``out``, the ids of column ``text`` as a list of integers; rows stay as they are, whatever else they hold.

    Null and empty texts give an empty list; repeated rows are encoded alike. Nothing is shuffled: a task reads
    its rows in Arrow batches, holds the ids of a few hundred at a time, and a very long text costs memory in proportion to itself only. An existing column ``out`` is replaced.
    """
    source = df.drop(out) if out != text else df
    schema = StructType([*source.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, leaf_chars).encode
        for whole in batches:
            for k in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(k, _SLICE)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                ids = pa.array([encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the text of a column of ids; null and empty lists give an empty text."""
    source = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary, 512).decode
        for batch in batches:
            texts = pa.array([decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(out, StringType())]))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and characters per source and language."""
    docs = encode_texts(table(spark, folder, "documents").select("source", "lang", "text"))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"), F.sum(F.length("text")).alias("chars"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
ORACLE_SQL: dict[str, str] = {}
