"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file (operator 11).

The library stops with an error on very long runs of white space, because its
pattern looks ahead there, and long texts make long lists. So a text of over
``BLOCK`` characters is cut first, only where no match of the pattern can reach
over and none looks ahead:

* between a character that is no white space and one that is: matches end there;
* in a run of white space of ``BLOCK`` characters or more that something follows,
  before its last character, which the pattern leaves to what follows.

Such a run is one match by itself; it goes to a second encoding whose pattern is
white space alone. A long run of other characters is not cut: the library merges it
in about linear time. Decoding joins the raw bytes of the ids, whether or not
they form whole characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block, about; texts of up to so many are encoded in one call.
BLOCK = 20_000
#: Characters or ids after which a batch of results is passed on.
HELD = 4_000_000
EDGE = regex.compile(r"(?<=\S)(?=\s)")


class Codec:
    """``content`` is that of a rank file: a token in base 64 and its rank on each line. ``pattern`` splits at white space as the module says."""

    def __init__(self, content: str, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, content.splitlines()) if token}
        self.whole, self.white = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("whole", pattern), ("white", r"\s+")))

    def encode(self, text: str, block: int = BLOCK) -> np.ndarray:
        if len(text) <= block:
            return np.array(self.whole.encode_ordinary(text), np.int32)
        return np.concatenate([np.array((self.white if white else self.whole).encode_ordinary(part), np.int32) for part, white in blocks(text, block)])

    def decode(self, ids: list[int]) -> bytes:
        return self.whole.decode_bytes(ids)


def blocks(text: str, block: int) -> Iterator[tuple[str, bool]]:
    """Parts that encode as they do within the text, and whether a part is a long run of white space."""
    at = 0
    for run in regex.finditer(r"\s{%d,}" % block, text):
        yield from ((part, False) for part in _cut(text, at, run.start(), block))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from ((part, False) for part in _cut(text, at, len(text), block))


def _cut(text: str, at: int, end: int, block: int) -> Iterator[str]:
    while end - at > block and (edge := EDGE.search(text, at + block, end)):
        yield text[at : edge.start()]
        at = edge.start()
    if end > at:
        yield text[at:end]


def encode(docs: DataFrame, content: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with its text replaced by ``out``, the array of its ids.

    ``content`` is the content of a rank file, ``pattern`` what splits a text before
    merging. Special tokens do not exist: their strings are ordinary text. Null and
    empty texts give no ids; repeated rows give repeated results; the other columns
    pass, but one named ``out`` is replaced; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), out.lower())]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>"
    shared = docs.sparkSession.sparkContext.broadcast((content, pattern))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            texts, row, at, done, held = batch.column("text"), batch.column("row"), 0, [], 0
            for i in range(batch.num_rows):
                done.append(codec.encode(texts[i].as_py() or ""))
                held += len(done[-1])
                if held >= HELD or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, done)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done)))
                    yield pa.RecordBatch.from_arrays([row.slice(at, i + 1 - at), ids], names=["row", "ids"])
                    at, done, held = i + 1, [], 0

    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in others], F.col("ids").alias(out))


def decode(tokens: DataFrame, content: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` and a binary column ``out``: the bytes of its ids, one after the other.

    Null and empty arrays give no bytes; a null id, or one that the rank file lacks, raises
    an error, because its bytes are unknown. A column named ``out`` is replaced; repeated rows and
    empty tables pass.
    """
    others = [c for c in tokens.columns if c.lower() != out.lower()]
    rows = tokens.select(F.col(ids_col).alias("ids"), F.struct(F.lit(0).alias("_"), *others).alias("row"))
    shared = tokens.sparkSession.sparkContext.broadcast((content, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            ids, row, at, done, held = batch.column("ids"), batch.column("row"), 0, [], 0
            for i in range(batch.num_rows):
                value = ids[i].values
                if value is not None and value.null_count:
                    raise ValueError("an id is null")
                done.append(codec.decode(value.to_numpy().tolist()) if value is not None else b"")
                held += len(done[-1])
                if held >= HELD or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([row.slice(at, i + 1 - at), pa.array(done, pa.binary())], names=["row", "decoded"])
                    at, done, held = i + 1, [], 0

    schema = f"row {rows.schema['row'].dataType.simpleString()}, decoded binary"
    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in others], F.col("decoded").alias(out))
