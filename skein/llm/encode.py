"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it again.

The tiktoken library encodes with a local rank file. Texts are first split at boundaries that no token crosses: the pattern of
these tokenizers never lets a token run from a character that is no white space into white space, so a text may be cut before
every white-space run that follows another character, and the pieces' ids joined give the ids of the whole. Long texts thus
don't reach the library whole, but for stretches without white space (it takes time in proportion to these), and the ids of short pieces are remembered per Python process, which makes most
of the corpus a dictionary lookup.

Texts travel as bytes. A text that isn't valid UTF-8 is encoded as it stands: its valid stretches as text, the bytes between them as
single bytes, so that decoding gives back the very same bytes.

Cases: a null text and an empty text have the empty list of ids. Special tokens are never produced; their strings are ordinary
text. Rows with equal ids or texts are encoded one by one. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the 50k byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as Unicode defines it, which is what the pattern's \s means.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Remembered pieces of one Python process, and the characters of the longest.
MEMO, MEMO_CHARS = 400_000, 48

_encoders: dict[str, Callable[[bytes | None], bytes]] = {}

#: Bytes that are not valid UTF-8, as decoding leaves them.
_INVALID = re.compile("([\udc80-\udcff]+)")


def default_ranks() -> str:
    """Path of byte_bpe_50k's ranks where the public tokenizers are installed."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(path: str) -> Callable[[bytes | None], bytes]:
    """A function from a text's bytes to its ids as little-endian int32; one per Python process and rank file."""
    if path in _encoders:
        return _encoders[path]
    import tiktoken

    ranks = read_ranks(path)
    encode = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    memo: dict[str, bytes] = {}
    pieces = _PIECE.findall

    def of_piece(piece: str) -> bytes:
        ids = np.array(encode(piece), dtype="<i4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(memo) >= MEMO:
                memo.clear()
            memo[piece] = ids
        return ids

    def of_text(text: str) -> bytes:
        get = memo.get
        return b"".join([get(p) or of_piece(p) for p in pieces(text)])

    def of_bytes(raw: bytes | None) -> bytes:
        if not raw:
            return b""
        try:
            return of_text(raw.decode())
        except UnicodeDecodeError:
            # invalid bytes come out as lone surrogates, which no valid text holds
            parts = _INVALID.split(raw.decode(errors="surrogateescape"))
            invalid = (np.array([ranks[bytes([ord(c) - 0xDC00])] for c in p], dtype="<i4").tobytes() if i % 2 else of_text(p) for i, p in enumerate(parts))
            return b"".join(invalid)

    _encoders[path] = of_bytes
    return of_bytes


def encode_batch(texts: pa.Array, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of a batch of texts (binary or null)."""
    of_bytes = _encoder(ranks)
    ids = [of_bytes(t) for t in texts.to_pylist()]
    offsets = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(ids), dtype="<i4")


def encode(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """Columns: the key, and ids (array of int)."""
    path = ranks or default_ranks()
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, ids = encode_batch(b.column(1), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["key", "ids"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = narrow.mapInArrow(run, f"key {kind.simpleString()}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def decode(df: DataFrame, key: str, ids: str, ranks: str | None = None) -> DataFrame:
    """Columns: the key, and text (binary): the bytes of the ids joined. A null list gives null, an unknown id an error."""
    path = ranks or default_ranks()
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        for b in batches:
            texts = [None if x is None else b"".join([tokens[i] for i in x]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["key", "text"])

    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind.simpleString()}, text binary")
    return out.select(F.col("key").alias(key), "text")
