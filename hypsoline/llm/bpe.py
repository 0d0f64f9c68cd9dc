"""Byte-level BPE with tiktoken over a local rank file.

Long texts are split before the library sees them, at places where the split pattern always ends one
match and starts another, so the ids are those of the whole text. A piece is at most about `PIECE`
characters unless it holds no such place. That such places are where a space follows a non-space is a
property of patterns in which white space begins or is a match; splittable() says whether a pattern is
known to be one, and texts are encoded whole under any other.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, map_arrow, unused

PIECE = 1 << 16
RUN = 1 << 12
#: The code points of Unicode's White_Space, which `\s` of the split pattern stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = regex.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = regex.compile(f"[{SPACE}]{{{RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken Encoding of a rank file; kept once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut after a non-space that a space follows. No match of the pattern holds such a pair, and what it
    looks ahead for stays in its piece, so the matches of the pieces are the matches of the text."""
    start = 0
    while len(text) - start > size:
        edge = _EDGE.search(text, start + size)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


#: The published forms of the split pattern in which no match has a space after a non-space.
SPLITTABLE = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)


def splittable(pattern: str) -> bool:
    return pattern in SPLITTABLE


def encode_text(text: str, rank_file: str, pattern: str) -> list[int]:
    """Ids of the whole text. A run of very many spaces would exhaust the library's stack, so its match, which is
    the run less its last character before a non-space, is encoded as one piece here."""
    enc = encoding(rank_file, pattern)
    if len(text) < RUN or not splittable(pattern):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        start = 0
        for run in _RUN.finditer(piece):
            end = run.end() - (run.end() < len(piece))
            if run.start() > start:
                ids += enc.encode_ordinary(piece[start : run.start()])
            ids += enc._encode_single_piece(piece[run.start() : end])
            start = end
        if start < len(piece):
            ids += enc.encode_ordinary(piece[start:])
    return ids


def decode_ids(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes; they need not be well-formed UTF-8 unless the ids are those of a whole text."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def _map(df: DataFrame, source: Column, outputs: list[T.StructField], one) -> DataFrame:
    """Adds `outputs`, the tuple one(x) of each value of `source`, some rows at a time; input columns of their names are replaced."""
    kinds = [to_arrow_type(f.dataType) for f in outputs]

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for at in range(0, rows.num_rows, 256):
            made = [one(x) for x in arrays[0].slice(at, 256).to_pylist()]
            yield rows.slice(at, 256), [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]

    names = {f.name.lower() for f in outputs}
    return map_arrow(df, [c for c in df.columns if c.lower() not in names], [source], outputs, make)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, array<int>: the ids of each whole text, special tokens never recognised.

    Null and empty texts give an empty array. Bytes that are not UTF-8 count as U+FFFD. Repeated rows are each
    encoded; an empty table stays empty; an input column named as `out` is replaced, every other one kept.
    """

    def one(b: bytes | None) -> tuple[list[int]]:
        return (encode_text(b.decode("utf-8", "replace"), rank_file, pattern) if b else [],)

    return _map(df, col(text).cast("binary"), [T.StructField(out, T.ArrayType(T.IntegerType()))], one)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, binary: the bytes of each row's ids; null ids, and null items in them, give no bytes.

    An id outside the rank file raises an error. Columns are treated as in encode().
    """

    def one(x: list[int] | None) -> tuple[bytes]:
        return (decode_ids([i for i in x if i is not None], rank_file, pattern) if x else b"",)

    return _map(df, col(ids), [T.StructField(out, T.BinaryType())], one)


def coded(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass: the ids of each whole text, and the bytes of these ids."""

    def one(b: bytes | None) -> tuple[list[int], bytes]:
        found = encode_text(b.decode("utf-8", "replace"), rank_file, pattern) if b else []
        return found, decode_ids(found, rank_file, pattern) if found else b""

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]
    return _map(df, col(text).cast("binary"), fields, one)


def op1(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The digests of the contract, from the ids and the bytes that they decode to."""
    return coded(docs.select("doc_id", "text"), rank_file, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def checked(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """docs with ids and round_trip boolean: whether the decoded ids are the text's own bytes (null: none). Null and empty
    texts have no ids; repeated rows agree; an empty table stays empty; input columns of these names are replaced."""
    (raw,) = unused(docs, "_decoded")
    same = col(raw) == F.coalesce(col("text").cast("binary"), F.lit("").cast("binary"))
    return coded(docs, rank_file, pattern, decoded=raw).withColumn("round_trip", same).drop(raw)
