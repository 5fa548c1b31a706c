"""Removal of long repeated byte strings, within and across documents.

A string of `length` bytes is represented by its anchor: the smallest hash among its runs of GRAM bytes, the first one
on ties.  Equal strings have equal anchors at equal places, so they can only meet among occurrences of one anchor.
Each occurrence owns the strings that chose it, which start in one run, and their bytes are its segment.

1. Anchors that occur once need no more: their strings are unique.
2. Occurrences are collapsed by (anchor, segment), told by 128 bits of hash together.  A segment that occurs twice
   repeats as a whole.
3. What remains are segments that occur once under an anchor that has others.  They are sorted by what follows the
   anchor, and by what precedes it read backwards, over the whole cluster; neighbours tell how far each one agrees with
   any other, and no string that reaches beyond can repeat.  So each is cut to what it can share.
4. Cut segments with equal bytes are collapsed.  An anchor's strings are dealt out by where the anchor stands in them,
   RANGE places together; the bytes that all of a range's strings span are its core, and strings of equal cores are
   told apart by the few bytes around it.  With the core as one symbol, a suffix order, built by linear grouping, brings
   equal strings together.  It decides every string of step 3.
5. The repeated strings' places go back to the documents, whose other bytes are kept.

A hot anchor's segments are spread by the sorts of step 3, and what all share is one row in step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise_alone
from .grouping import suffix_array

GRAM = 24
#: Bytes that are worked on together; places in a block and anchors' hashes share 64 bits.
BLOCK, PLACE = 1 << 20, 22
#: Places of the anchor whose strings are ordered together.
RANGE = 16
#: Symbols whose suffixes are ordered together.  Strings of one core that have more than a piece are ordered by two pieces.
ORDERED, PIECE = 1 << 17, 1 << 20
#: The longest strings that `meta` has room for.
LONGEST = 1000

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1


@lru_cache(4)
def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, odd, np.uint64)
    up[0] = 1
    down = np.full(n, pow(odd, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(2)
def _symbols(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Hash of any stretch of a buffer in constant time (polynomials modulo 2**64, then mixed)."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        size = 1 << max(12, n.bit_length())
        up, self.down = _powers(_ODD[which], size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_symbols(which)[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from minima towards both ends of blocks of w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, _WORD, np.uint64)]).reshape(-1, w)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[:n], from_left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of documents data[start:stop] laid end to end: (document, anchor hash, segment hash, first string's start in the
    document, strings owned, anchor's place in the segment)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    w = length - GRAM + 1
    n = len(data) - GRAM + 1
    one = Hashes(data, 0)
    places = np.arange(n)
    h = one.of(places, places + GRAM)
    v = (h & np.uint64(_WORD ^ ((1 << PLACE) - 1))) | places.astype(np.uint64)
    anchor = (_sliding_min(v, w) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), np.maximum(stops - starts - length + 1, 0))
    first = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts, stops)]) if len(starts) else np.zeros(0, np.int64)
    if not len(first):
        return none
    chosen = anchor[first]
    cut = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
    lo, owner, at = first[cut], doc[cut], chosen[cut]
    count = np.diff(np.append(cut, len(first)))
    two = Hashes(data, 1)
    g = two.of(lo, lo + count - 1 + length) ^ (((at - lo).astype(np.uint64) << np.uint64(20)) + count.astype(np.uint64)) * np.uint64(_ODD[0])
    return owner, h[at], g, lo - starts[owner], count, at - lo


def _blocks(values: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, stops, row, shift) of whole documents, or of parts of long ones that overlap by length - 1."""
    row = 0
    rows = len(offsets) - 1
    while row < rows:
        end = row + 1
        while end < rows and offsets[end + 1] - offsets[row] <= BLOCK:
            end += 1
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= BLOCK:
            yield values[a:b], offsets[row:end] - a, offsets[row + 1 : end + 1] - a, np.arange(row, end), np.zeros(end - row, np.int64)
        else:
            for s in range(a, max(b - length + 1, a + 1), BLOCK):
                part = values[s : min(s + BLOCK + length - 1, b)]
                yield part, np.array([0]), np.array([len(part)]), np.array([row]), np.array([s - a])
        row = end


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), o


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _buffers(batch.column("text_"))
            for data, starts, stops, row, shift in _blocks(values, offsets, length):
                owner, h, g, lo, count, at = anchors(data, starts, stops, length)
                if len(owner):
                    which = pa.array(row[owner])
                    meta = (lo + shift[owner] << 20) | (count << 10) | at
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("mark_").take(which), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(meta)], names=["doc_id", "mark_", "h", "g", "meta"])

    return run


#: An occurrence's `meta` holds where its first string starts, how many it owns, and the anchor's place in the segment.


def _cut(length: int):
    """Segments' bytes out of whole texts: before the anchor, read backwards, and from the anchor on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, wanted in zip(batch.column("text_").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                for x in wanted:
                    lo, count, at = x["meta"] >> 20, x["meta"] >> 10 & 1023, x["meta"] & 1023
                    for k, v in enumerate((x["h"], x["g"], x["n"], text[lo : lo + at][::-1], text[lo + at : lo + count - 1 + length])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["h", "g", "n", "before", "after"])

    return run


def repeated_starts(segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment of symbols (from 0) the places whose string of `length` starts anywhere else in these too."""
    lengths = [len(x) for x in segments]
    m = len(segments)
    # each segment ends with a symbol of its own, the last one with the smallest
    symbols = np.empty(sum(lengths) + m, np.int64)
    stops = np.cumsum(np.array(lengths) + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[stops] = False
    symbols[inside] = np.concatenate(segments) + m
    symbols[stops] = np.arange(m - 1, -1, -1)
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    left = np.repeat(stops, np.array(lengths) + 1) - np.arange(len(symbols))  # symbols up to the segment's end
    order = order[left[order] >= length]  # suffixes that hold a whole string; those between begin with no such string
    out = np.zeros(len(symbols), bool)
    if len(order) > 1:
        view = np.lib.stride_tricks.sliding_window_view(symbols, length)
        for a in range(0, len(order) - 1, 4096):
            x, y = order[a : a + 4096], order[a + 1 : a + 4097]
            same = (view[x[: len(y)]] == view[y]).all(1)
            out[x[: len(y)][same]] = True
            out[y[same]] = True
    begins = stops - np.array(lengths)
    return [np.flatnonzero(out[b : b + n]) for b, n in zip(begins.tolist(), lengths)]


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes that strings of `length` from these places cover."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > length)
    first, last = places[np.concatenate([[0], gap + 1])], places[np.append(gap, len(places) - 1)]
    return list(zip(first.tolist(), (last + length).tolist()))


def _shared(x: bytes, y: bytes) -> int:
    """How many bytes x and y begin with in common."""
    m = min(len(x), len(y))
    return m - ((int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")).bit_length() + 7) // 8


#: Where a row stands among those of its task, of which the first and the last have a neighbour in another.
INNER, FIRST, LAST, ONLY = range(4)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, g, x) sorted by (h, x): how many bytes of x a neighbour of one h begins with too; x of the task's ends."""
    part = TaskContext.get().partitionId()
    last, reach, edge = None, 0, FIRST

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["h", "g", "reach", "part", "edge", "x"])

    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None:
                common = _shared(last[2], row[2]) if last[0] == row[0] else 0
                rows.append((last[0], last[1], max(reach, common), part, edge, last[2] if edge else None))
                reach, edge = common, INNER
            last = row
        yield out(rows)
    if last is not None:
        yield out([(last[0], last[1], reach, part, ONLY if edge else LAST, last[2])])


def _reach(segments: DataFrame, column: str) -> DataFrame:
    """(h, g, reach): how many bytes of `column` each segment shares with another one of its anchor, at its beginning.

    The rows are sorted over the whole cluster; the segment's hash is a part of the order, so that equal bytes don't
    make a hot partition.  The ends of the tasks, two rows each, meet on the driver.
    """
    ranged = segments.select("h", "g", F.col(column).alias("x")).repartitionByRange("h", "x", "g").sortWithinPartitions("h", "x", "g")
    found = materialise_alone(ranged.mapInArrow(_neighbours, "h long, g long, reach int, part int, edge int, x binary"))
    ends = sorted(found.where(F.col("edge") != INNER).collect(), key=lambda r: (r.part, r.edge != FIRST))
    more = []
    for one, two in zip(ends, ends[1:]):
        if one.part != two.part and one.h == two.h:
            common = _shared(bytes(one.x), bytes(two.x))
            more += [(one.h, one.g, common), (two.h, two.g, common)]
    extra = segments.sparkSession.createDataFrame(more, "h long, g long, more int").groupBy("h", "g").agg(F.max("more").alias("more"))
    return found.join(F.broadcast(extra), ["h", "g"], "left").select("h", "g", F.greatest("reach", F.coalesce("more", F.lit(0))).alias("reach"))


def repeated_in_pieces(segments: list[np.ndarray], length: int, piece: int) -> list[np.ndarray]:
    """repeated_starts of any number of segments in bounded memory: of pieces of them, each two are ordered together."""
    pieces: list[list[int]] = [[]]
    size = 0
    for i, x in enumerate(segments):
        if size + len(x) > piece and pieces[-1]:
            pieces.append([])
            size = 0
        pieces[-1].append(i)
        size += len(x)
    out = [np.zeros(0, np.int64)] * len(segments)
    for some in [pieces[0]] if len(pieces) == 1 else ([*a, *b] for a, b in combinations(pieces, 2)):
        for i, found in zip(some, repeated_starts([segments[i] for i in some], length)):
            out[i] = np.union1d(out[i], found) if len(out[i]) else found
    return out


def by_core(rows: list[tuple], length: int) -> list[dict]:
    """rows: (before, after, copies) of one anchor.  A table for each range and core that more than one string may have:
    (bytes before the core, bytes behind it) -> [copies, (row, places of the anchor in its first string)...]."""
    cores: dict[tuple, dict] = {}
    for row, (before, after, copies) in enumerate(rows):
        least, most = max(0, length - len(after)), min(len(before), length - GRAM)
        for base in range(least // RANGE * RANGE, most + 1, RANGE):
            p, q = max(base, least), min(base + RANGE - 1, most)  # strings with p to q bytes before the anchor
            rest = length - base - RANGE + 1
            own = cores.setdefault((base, before[:base], after[:rest]), {}).setdefault((before[base:q][::-1], after[rest : length - p]), [0])
            own[0] += copies
            own.append((row, q))
    return [x for x in cores.values() if len(x) > 1 or next(iter(x.values()))[0] > 1]


def repeated_spans(anchors: list[list[tuple]], length: int, piece: int = PIECE) -> list[list[list[tuple[int, int]]]]:
    """For each row (before, after, copies) of each anchor the spans of its bytes that strings which repeat cover.

    Strings repeat only inside their anchor's rows; a row of several copies is there twice.
    """
    starts: list[list[list[int]]] = [[[] for _ in rows] for rows in anchors]

    def settle(tables: list[tuple[int, dict]]) -> None:
        found = [(k, core, edges, own) for core, (k, table) in enumerate(tables) for edges, own in table.items()]
        symbols = [np.concatenate([np.frombuffer(x, np.uint8).astype(np.int64), [256 + core], np.frombuffer(y, np.uint8)]) for _, core, (x, y), _ in found]
        twice = [i for i, x in enumerate(found) if x[3][0] > 1]
        places = repeated_in_pieces(symbols + [symbols[i] for i in twice], RANGE, piece)
        for (k, _, _, own), at in zip(found, places):
            for row, q in own[1:]:
                first = len(anchors[k][row][0]) - q
                starts[k][row] += (at + first).tolist()

    waiting: list[tuple[int, dict]] = []
    size = 0
    for k, rows in enumerate(anchors):
        for table in by_core(rows, length):
            waiting.append((k, table))
            size += 2 * sum(len(x) + len(y) + 1 for x, y in table)
            if size >= ORDERED:
                settle(waiting)
                waiting, size = [], 0
    if waiting:
        settle(waiting)
    return [[_runs(np.unique(np.array(x, np.int64)), length) for x in rows] for rows in starts]


def _order(length: int, piece: int):
    """Cut segments (h, before, after, copies) sorted by anchor: out come the spans that repeat, of whole anchors."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        anchors: list[list[tuple]] = []
        for i, row in enumerate(rows):
            if not i or rows[i - 1][0] != row[0]:
                anchors.append([])
            anchors[-1].append(row)
        found = repeated_spans([[r[1:] for r in own] for own in anchors], length, piece)
        out = [(*row[:3], a, b) for own, spans in zip(anchors, found) for row, of in zip(own, spans) for a, b in of]
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["h", "before", "after", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ORDERED and rows[-1][0] != row[0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1]) + len(row[2])
        if rows:
            yield flush(rows)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests, kept = [], [], [], []
        for text, found in zip(batch.column("text_").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            at = gone = n = 0
            parts = []
            for s in sorted((x["a"], x["b"]) for x in found or ()):
                a, b = s
                if n and a <= at:  # overlaps or touches the last one
                    if b > at:
                        gone += b - at
                        at = b
                    continue
                parts.append(text[at:a])
                gone += b - a
                n += 1
                at = b
            parts.append(text[at:])
            rest = b"".join(parts)
            removed.append(gone)
            spans.append(n)
            kept.append(rest)
            digests.append(hashlib.sha256(rest).hexdigest())
        names = [n for n in batch.schema.names if n not in ("text_", "spans")]
        columns = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, piece: int = PIECE) -> DataFrame:
    """A row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Removed is each byte that a string of `length` bytes (more than GRAM, at most LONGEST) covers which also starts
    elsewhere in df.  Null texts count as empty; texts shorter than `length` lose nothing.  Rows that repeat id and text
    are occurrences each, and lose what they share.  Null ids stand.  An empty table gives an empty table.
    """
    if not GRAM < length <= LONGEST:
        raise ValueError(f"length must be more than {GRAM} and at most {LONGEST}")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    base = df.select(col(id_col).cast("long").alias("doc_id"), text.alias("text_")).withColumn("mark_", F.xxhash64("text_"))
    found = base.where(F.octet_length("text_") >= length).mapInArrow(_find(length), "doc_id long, mark_ long, h long, g long, meta long")

    # tables that a hot anchor is joined with are written down first: then the join's hot partitions can be split
    again = materialise_alone(found.groupBy("h").agg(F.count(F.lit(1)).alias("n_h")).where("n_h > 1").select("h"))
    shared = materialise_alone(found.join(again, "h"))
    classes = materialise_alone(shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark_", "meta")).alias("one")))
    mixed = materialise_alone(classes.groupBy("h").agg(F.count(F.lit(1)).alias("segments"), F.min("n").alias("fewest")).where("segments > 1 and fewest = 1").select("h"))
    open_ = classes.join(mixed, "h").select("h", "g", "n", "one.*")

    by_document = open_.groupBy("doc_id", "mark_").agg(F.collect_list(F.struct("h", "g", "n", "meta")).alias("wanted"))
    texts = base.join(by_document.withColumnsRenamed({"doc_id": "id_", "mark_": "own_"}), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark_") == F.col("own_")))
    cut = texts.select("text_", "wanted").mapInArrow(_cut(length), "h long, g long, n long, before binary, after binary")
    segments = materialise_alone(cut.dropDuplicates(["h", "g"]))  # rows that repeat id and text bring a segment twice
    right, left = _reach(segments, "after"), _reach(segments, "before")
    both = segments.join(right.withColumnRenamed("reach", "r"), ["h", "g"]).join(left.withColumnRenamed("reach", "k"), ["h", "g"]).where(F.col("r") + F.col("k") >= length)
    rest = materialise_alone(both.select("h", "g", "n", F.length("before").alias("at"), F.expr("substring(before, 1, k)").alias("before"), F.expr("substring(after, 1, r)").alias("after")))
    alike = rest.groupBy("h", "before", "after").agg(F.count(F.lit(1)).alias("copies"))
    # so many tasks as set: ordering costs seconds a megabyte, and adaptive execution would merge partitions by their size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = alike.repartition(tasks, "h").sortWithinPartitions("h", "before", "after").mapInArrow(_order(length, piece), "h long, before binary, after binary, a int, b int")
    ordered = materialise_alone(ordered)
    shift = F.col("at") - F.length("before")
    single = rest.where("n = 1").join(ordered, ["h", "before", "after"]).select("h", "g", (F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b"))
    whole = classes.where("n > 1").select("h", "g", F.lit(0).alias("a"), (F.shiftright(F.col("one.meta"), 10).bitwiseAND(F.lit(1023)) + (length - 1)).cast("int").alias("b"))
    verdicts = materialise_alone(whole.unionByName(single))

    spans = shared.join(verdicts, ["h", "g"]).select("doc_id", "mark_", (F.shiftright("meta", 20) + F.col("a")).alias("a"), (F.shiftright("meta", 20) + F.col("b")).alias("b"))
    of_document = spans.groupBy("doc_id", "mark_").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnsRenamed({"doc_id": "id_", "mark_": "own_"})
    both = base.join(of_document, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark_") == F.col("own_")), "left").select("doc_id", "text_", "spans")
    return both.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
