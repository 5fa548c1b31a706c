"""Exact dedup through a cuckoo-filter index of live digests.

The filter holds a 16-bit fingerprint and a record number in one of two rows of four slots.  A look-up compares
fingerprints; where one agrees, and only there, the record's content digest (SHA-256 of the normalised text) is
compared.  No other table of the digests is kept, so what the filter does not hit is new.  A table that overflows is
resized and filled again from the stored keys.  Deletion frees slot and record, so a digest whose documents have all
gone comes back as new.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, keep_named, materialise

#: Digests are dealt into so many buckets by their first bytes; an index never holds more than a bucket and 4096 keys.
BUCKETS, SMALL = 1 << 16, 4096


class CuckooIndex:
    """Live digests (bytes, 24 or more, uniformly spread but for the first two bytes) with a value each.

    Fingerprint and rows come from bytes behind the first four, which may name a bucket and so be equal for all keys.
    """

    SLOTS = 4

    def __init__(self, rows: int = 64, kicks: int = 200):
        self.kicks = kicks
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.looked = self.verified = self.false_hits = self.resizes = 0
        self._clear(max(2, 1 << (rows - 1).bit_length()))

    def _clear(self, rows: int) -> None:
        self.rows = rows
        self.marks = array("H", bytes(2 * rows * self.SLOTS))
        self.records = array("q", bytes(8 * rows * self.SLOTS))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    @property
    def load(self) -> float:
        return len(self) / len(self.marks)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[12:14], "big") or 1
        one = int.from_bytes(digest[4:12], "big") & (self.rows - 1)
        return mark, one, self._other(one, mark)

    def _other(self, row: int, mark: int) -> int:
        return row ^ ((mark * 0x5BD1E995 >> 7) & (self.rows - 1))

    def _slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1: fingerprints decide, and those that agree are verified by the stored key."""
        self.looked += 1
        mark, one, two = self._places(digest)
        hit = False
        for row in (one, two) if one != two else (one,):
            for at in range(row * self.SLOTS, (row + 1) * self.SLOTS):
                if self.marks[at] == mark:
                    hit = True
                    if self.keys[self.records[at]] == digest:
                        self.verified += 1
                        return at
        self.false_hits += hit
        return -1

    def find(self, digest: bytes):
        """The digest's value, or None if it is not live."""
        at = self._slot(digest)
        return None if at < 0 else self.values[self.records[at]]

    def insert(self, digest: bytes, value) -> bool:
        """Add a digest, or give a live one a new value; true if it is new."""
        at = self._slot(digest)
        if at >= 0:
            self.values[self.records[at]] = value
            return False
        if self.free:
            record = self.free.pop()
            self.keys[record], self.values[record] = digest, value
        else:
            record = len(self.keys)
            self.keys.append(digest)
            self.values.append(value)
        if not self._put(record):
            self._grow()
        return True

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; false if it is not live."""
        at = self._slot(digest)
        if at < 0:
            return False
        record = self.records[at]
        self.marks[at] = 0
        self.keys[record] = self.values[record] = None
        self.free.append(record)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)

    def _empty(self, row: int) -> int:
        for at in range(row * self.SLOTS, (row + 1) * self.SLOTS):
            if not self.marks[at]:
                return at
        return -1

    def _put(self, record: int) -> bool:
        mark, row, two = self._places(self.keys[record])
        at = self._empty(row)
        if at < 0:
            at = self._empty(two)
        kick = 0
        while at < 0:
            if kick == self.kicks:
                return False  # one record is in hand: the caller fills a larger table from the stored keys
            victim = row * self.SLOTS + kick % self.SLOTS
            mark, self.marks[victim] = self.marks[victim], mark
            record, self.records[victim] = self.records[victim], record
            row = self._other(row, mark)
            at = self._empty(row)
            kick += 1
        self.marks[at], self.records[at] = mark, record
        return True

    def _grow(self) -> None:
        rows = self.rows
        while True:
            rows *= 2
            self.resizes += 1
            self._clear(rows)
            if all(self._put(r) for r, k in enumerate(self.keys) if k is not None):
                return


SCHEMA = pa.schema([("digest", pa.binary()), ("keep", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
_DDL = "digest binary, keep long, row long, n long"


def _better(a: tuple, b: tuple) -> bool:
    """Whether (id, row) a stays rather than b: the larger id, null last; of one id the smaller row."""
    if a[0] == b[0]:
        return a[1] < b[1]
    return b[0] is None or (a[0] is not None and a[0] > b[0])


def _merge(index: CuckooIndex, digest: bytes, keep, row: int, n: int) -> None:
    known = index.find(digest)
    if known is not None:
        keep, row = (keep, row) if _better((keep, row), known) else known[:2]
        n += known[2]
    index.insert(digest, (keep, row, n))


def _batches(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    items = index.items()
    while rows := [x for _, x in zip(range(20_000), items)]:
        columns = [[d for d, _ in rows], *([v[k] for _, v in rows] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def index_partials(most: int):
    """Of a partition's (digest, keep, row, n): one row a digest; what is gathered is passed on at `most` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                _merge(index, *x)
            if len(index) >= most:
                yield from _batches(index)
                index = CuckooIndex()
        yield from _batches(index)

    return run


def index_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, digests in any order: an index ends with its bucket, once it holds SMALL keys."""
    index, last = CuckooIndex(), None
    for batch in batches:
        for bucket, *x in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last:
                if len(index) >= SMALL:
                    yield from _batches(index)
                    index = CuckooIndex()
                last = bucket
            _merge(index, *x)
    yield from _batches(index)


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(col(text_col), F.lit(""))), 256))


def _bucket(digest: str) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int")


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the largest
    id stays, null ids last; of rows that repeat id and text one stays.  group_size counts them all.  An empty table
    gives an empty table.
    Digests are merged by a cuckoo index in each input partition first, so a hot group reaches its bucket as one row a
    partition; the verdicts are joined back by digest (an equi-join whose hot side adaptive execution may split).
    """
    rows = df.select(col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"))
    light = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    partial = light.select("digest", F.col("doc_id").alias("keep"), "row", F.lit(1).cast("long").alias("n")).mapInArrow(index_partials(most), _DDL)
    dealt = partial.select(_bucket("digest").alias("bucket"), "*").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    merged = dealt.mapInArrow(index_buckets, _DDL).withColumnRenamed("row", "kept_row")
    kept = F.col("row") == F.col("kept_row")
    return light.join(merged, "digest").select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and kind: live digests go in, departures take documents off, arrivals add theirs."""
    index, last = CuckooIndex(), None
    admitted: dict[bytes, tuple] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(d, n, admitted.get(d)) for d, n in index.items()]
        for a in range(0, len(rows), 20_000):
            part = rows[a : a + 20_000]
            keep = [x[2] or (None, None) for x in part]
            columns = [pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64()), pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "admitted", "row"])

    for batch in batches:
        for bucket, kind, digest, keep, row, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last:
                yield from out()
                index, last = CuckooIndex(), bucket
                admitted = {}
            live = index.find(digest)
            if kind == 1:
                if live is not None and live <= n:
                    index.delete(digest)
                elif live is not None:
                    index.insert(digest, live - n)
                continue
            if kind == 2 and (live is None or digest in admitted):
                best = admitted.get(digest)
                if best is None or _better((keep, row), best):
                    admitted[digest] = (keep, row)
            index.insert(digest, (live or 0) + n)
    yield from out()


def update_index(live: DataFrame, arrivals: DataFrame, departures: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, admitted): the live digests after a change, and the arrivals that are new, as (doc_id, digest).

    live: (digest, n), n documents hold it; empty at first.  departures leave first: each takes one document off its
    text's digest, and a digest without documents is deleted.  Of arrivals whose digest is not live then, one stands for
    each digest: the largest id, null last.  Departures of digests that are not live change nothing.  Null texts count as
    empty; repeated rows are documents each; empty tables change nothing.
    """
    light = lambda df: df.select(_digest(text_col).alias("digest"), col(id_col).cast("long").alias("keep"), F.monotonically_increasing_id().alias("row"))
    none = F.lit(None).cast("long")
    best = F.min_by(F.struct("keep", "row"), F.struct(F.col("keep").isNull(), -F.col("keep"), F.col("row")))
    come = materialise(light(arrivals)).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("kind"), "digest", "best.keep", "best.row", "n")
    go = light(departures).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("kind"), "digest", none.alias("keep"), none.alias("row"), "n")
    rows = live.select(F.lit(0).alias("kind"), "digest", none.alias("keep"), none.alias("row"), F.col("n").cast("long").alias("n")).unionByName(go).unionByName(come)
    dealt = rows.select(_bucket("digest").alias("bucket"), "*").repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")
    after = materialise(dealt.mapInArrow(_changed, "digest binary, n long, admitted long, row long"))
    return after.select("digest", "n"), after.where("row is not null").select(F.col("admitted").alias("doc_id"), "digest")


def drop_exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One of df's rows for each text, all columns as they are: the largest id, also where ids repeat or are null.

    Null texts count as empty.  An empty table gives an empty table.
    """
    name = lambda digest, doc_id: F.concat_ws(":", digest, doc_id.cast("long"))
    kept = exact_duplicates(df, id_col=id_col, text_col=text_col).where("kept").select(name(F.col("text_sha256"), F.col("doc_id")))
    digest = F.sha2(ascii_lower(F.coalesce(col(text_col), F.lit(""))), 256)
    return keep_named(df, name(digest, col(id_col)), kept, text_col)
