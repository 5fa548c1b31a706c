"""Byte-level BPE with a given rank file: encoding by overlapping chunks, decoding by concatenation of bytes.

Texts longer than a chunk are cut into overlapping chunks that are pre-tokenised apart from each other, on whatever
executors are free.  A chunk begins and ends inside pre-tokens, so its first and last boundaries may be wrong; the
chunks of a text are stitched where the boundaries of the next chunk meet those known to be right.  From such a place
on the next chunk is right too, as the pattern never looks back.  Then each pre-token is encoded by itself.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, materialise

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: The longest part of the pattern that looks ahead: an apostrophe and two letters.
AHEAD = 3
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 300_000
#: Characters whose ids are sent on together.
SENT = 2_000_000


class _Ids(dict):
    """Pre-token -> the bytes of its ids as 32-bit numbers, which take less room than lists; forgets everything when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids = _Ids(encoding._encode_single_piece)
        # the library's \s is Unicode's White_Space, this module's also holds four control characters
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def encode_pieces(self, pieces) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids.__getitem__, pieces)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def verify(self, ids: np.ndarray, text: str) -> np.ndarray:
        """The ids, decoded to see that they are those of the text."""
        if self.decode(ids.tolist()) != text.encode("utf-8", "surrogatepass"):
            raise ValueError("ids do not decode to their text")
        return ids

    def ends(self, chunk: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(chunk)]


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One for a worker process: it is built from the files where the worker runs."""
    return Codec(path, pattern)


def stitch(text: str, starts: list[int], stops: list[int], ends: list[list[int]], again) -> list[int]:
    """The true pre-token ends of text.

    Chunk k covers text[starts[k]:stops[k]]; ends[k] are the ends found in it, as places in the text.  `again` finds
    the ends in a piece of text: used from the last true end where chunks don't resynchronise inside their overlap.
    """
    true: list[int] = []
    at = 0  # the last true boundary

    def accept(found: list[int], stop: int) -> None:
        nonlocal at
        sure = stop if stop == len(text) else stop - AHEAD
        for x in found:
            if x > at:
                if x > sure or (x == stop and stop < len(text)):
                    break
                true.append(x)
                at = x

    for start, stop, found in zip(starts, stops, ends):
        if start == 0 or start == at:
            accept(found, stop)
            continue
        here = {start, *found}
        k = next((i for i in range(len(true) - 1, -1, -1) if true[i] < start), -1) + 1
        meet = next((x for x in true[k:] if x in here), None)
        if meet is None:
            accept([at + x for x in again(text[at:stop])], stop)
        else:
            del true[true.index(meet, k) + 1 :]
            at = meet
            accept(found, stop)
    return true


def cut(length: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    starts = list(range(0, max(length - overlap, 1), chunk))
    return starts, [min(s + chunk + overlap, length) for s in starts]


def encode_long(c: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """What the distributed path does, in one place."""
    starts, stops = cut(len(text), chunk, overlap)
    ends = [[s + x for x in c.ends(text[s:e])] for s, e in zip(starts, stops)]
    true = stitch(text, starts, stops, ends, c.ends)
    return c.encode_pieces(text[a:b] for a, b in zip([0, *true], true))


def _ids_column(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i == len(sizes) - 1:
            yield begin, i + 1
            begin, total = i + 1, 0


def encode(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, verified: bool = False) -> DataFrame:
    """df with a column more: the ids of the whole text (array of int).  Null and empty texts have no ids.

    verified: each row's ids are decoded where they are made, and ids that do not give the text's bytes are an error;
    so no decoded bytes travel and no second Python worker runs.  Every row is kept, repeated rows too; an empty table stays empty; a table that already has ids_col is refused.
    """
    if ids_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has {ids_col}")
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    length = F.coalesce(F.length(col(text_col)), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            for a, b in _portions([len(x) for x in texts], SENT):
                part = batch.slice(a, b - a)
                ids = _ids_column([c.verify(c.encode(x), x) if verified else c.encode(x) for x in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    whole = df.where(length <= chunk + overlap).mapInArrow(short, schema)

    key, at = fresh(df, "row_", "at_")
    # the keys are written down before they are used: a task that runs again must not deal out others
    long = materialise(df.where(length > chunk + overlap).withColumn(key, F.monotonically_increasing_id()))
    pieces_ddl = f"`{key}` long, `{at}` long, piece string"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text once through, piece by piece, so the work grows with its length."""
        for batch in batches:
            for name, text in zip(batch.column(key).to_pylist(), batch.column("text_").to_pylist()):
                starts, stops = cut(len(text), chunk, overlap)
                for a, b in _portions([chunk] * len(starts), SENT):
                    own = [text[x:y] for x, y in zip(starts[a:b], stops[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a), pa.int64()), pa.array(range(a, b), pa.int64()), pa.array(own, pa.string())], names=[key, at, "piece"])

    pieces = long.select(key, col(text_col).alias("text_")).mapInArrow(parts, pieces_ddl)

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            found = [np.array(c.ends(x), np.int32) for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids_column(found)], names=[key, at, "piece", "ends"])

    def join_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path, pattern)
        pdf = pdf.sort_values(at)
        texts = pdf["piece"].tolist()
        text = "".join([*(x[:chunk] for x in texts[:-1]), texts[-1]])
        starts = [int(x) * chunk for x in pdf[at]]
        stops = [s + len(x) for s, x in zip(starts, texts)]
        true = stitch(text, starts, stops, [[s + int(x) for x in e] for s, e in zip(starts, pdf["ends"])], c.ends)
        ids = c.encode_pieces(text[a:b] for a, b in zip([0, *true], true))
        return pd.DataFrame({key: [pdf[key].iloc[0]], ids_col: [c.verify(ids, text) if verified else ids]})

    found = pieces.repartition(F.col(key), F.col(at)).mapInArrow(boundaries, f"{pieces_ddl}, ends array<int>")
    stitched = found.groupBy(key).applyInPandas(join_chunks, f"`{key}` long, `{ids_col}` array<int>")
    return whole.unionByName(long.join(stitched, key).drop(key))


def decode(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with a column more: the bytes that the ids stand for (null ids: no bytes).  Ids without a token are an error."""
    if bytes_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has {bytes_col}")
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(ids_col)
            counts = [len(x) if x.is_valid else 0 for x in lists]
            for a, b in _portions(counts, SENT):
                part = batch.slice(a, b - a)
                out = [c.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, bytes_col])

    return df.mapInArrow(run, schema)
