"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Equal fingerprints are collapsed first.  The distinct ones are dealt into blocks of one population count each; two
blocks whose counts differ by more than the radius can't hold a link and never meet.  The others meet once, in one
task a pair of blocks, which compares tiles by exclusive-or and bit counts and passes on a spanning forest of the
links that it finds, so that a group of thousands of near copies yields links in proportion to its size.

The near-duplicate stage takes such links for candidates only: blocks hold shingle sets of like size, and what the
candidates connect is verified by the exact Jaccard similarity of the shingle sets before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, keep_named, materialise
from .graph import components

#: Fingerprints in a block, and the sides of a tile.
BLOCK, TILE_ROWS, TILE_COLUMNS = 32_768, 32, 4096
#: Shingles whose bits are counted together.
COUNTED = 8192
#: Shingles of a candidate group that are verified together; larger groups are cut into pieces that meet in pairs.
PIECE = 1_000_000
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (fewer words: of all), A-Z lower-cased, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is 20 and 09-0D
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    stops = ends[words - 1 :].tolist()
    starts = [0, *(ends[: len(w) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself, each other lane another permutation of the 64-bit numbers."""
    if lane == 0:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """lanes words of 64 bits; a bit is 1 if it is set in over half of the hashes.  No hashes: zero."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        m = _mixed(h, lane)
        counts = np.zeros(64, np.int64)
        for a in range(0, len(m), COUNTED):
            part = np.ascontiguousarray(m[a : a + COUNTED]).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(counts * 2 > len(m), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(df: DataFrame, *, text_col: str = "text", out: str = "fingerprint", words: int = 5, lanes: int = 1) -> DataFrame:
    """df with its fingerprint (array of `lanes` longs, which hold the bits of unsigned numbers) in column `out`."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(x.as_py(), words), lanes).view(np.int64) for x in batch.column(text_col)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * lanes), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of all fingerprints at most radius bits apart.  Shapes (n, lanes) and (m, lanes)."""
    one, two = np.sort(np.bitwise_count(left).sum(1)), np.sort(np.bitwise_count(right).sum(1))
    if not len(one) or not len(two) or int(one[0]) - int(two[-1]) > radius or int(two[0]) - int(one[-1]) > radius:
        return
    columns = [np.ascontiguousarray(right[:, lane]) for lane in range(right.shape[1])]
    shape = min(TILE_ROWS, len(left)), min(TILE_COLUMNS, len(right))
    differ, bits = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    whole = 2 if radius <= 48 else 3  # lanes that are compared for all pairs: 64 bits of unrelated texts are 32 apart
    for a in range(0, len(left), TILE_ROWS):
        x = left[a : a + TILE_ROWS]
        for b in range(0, len(right), TILE_COLUMNS):
            wide = min(TILE_COLUMNS, len(right) - b)
            d, n = differ[: len(x), :wide], bits[: len(x), :wide]
            np.bitwise_xor(x[:, :1], columns[0][None, b : b + wide], out=d)
            np.bitwise_count(d, out=n)
            for lane in range(1, min(whole, len(columns))):  # the other lanes for those pairs that these leave
                np.bitwise_xor(x[:, lane : lane + 1], columns[lane][None, b : b + wide], out=d)
                n += np.bitwise_count(d)
            near = n <= radius
            if near.any():
                i, j = near.nonzero()
                if len(columns) > whole:
                    apart = n[i, j].astype(np.int64)
                    for lane in range(whole, len(columns)):
                        apart += np.bitwise_count(x[i, lane] ^ columns[lane][j + b])
                    i, j = i[apart <= radius], j[apart <= radius]
                yield i + a, j + b


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Of the links between two blocks (or inside one), as many as connect what all of them connect."""
    shift = 0 if same else len(left)
    parent = np.arange(len(left) + (0 if same else len(right)))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for i, j in close_pairs(left, right, radius):
        j = j + shift
        # most of a large group's links join what is joined already: those go at once, by their labels
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        open_ = parent[i] != parent[j]
        for x, y in zip(i[open_].tolist(), j[open_].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y - shift))
    return out


def hex_name(words: Column) -> Column:
    """The fingerprint as lower-case hex, 16 digits a lane."""
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def numbered(names: DataFrame) -> DataFrame:
    """names, written down, with a long `label` each: what links and components work with."""
    return materialise(names.withColumn("label", F.monotonically_increasing_id()))


def near_links(names: DataFrame, radius: int, lanes: int, *, by: Column | None = None, reach: int | None = None) -> DataFrame:
    """names: distinct (label, words).  Returns links (a, b) between labels that connect what all close pairs connect.

    by: an int of few values; names whose values differ by more than reach need not meet.  By default the bits that
    are 1 and the radius.  Neighbouring values share a block until it is full; a value of many names has several.
    """
    bits = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.bit_count(w))
    reach = radius if reach is None else reach
    counted = names.select("label", "words", (bits if by is None else by).cast("int").alias("p"))
    sizes = {r[0]: r[1] for r in counted.groupBy("p").count().collect()}  # 64 * lanes + 1 rows at most, or by's values
    if not sizes:
        return names.select(F.col("label").alias("a"), F.col("label").alias("b")).limit(0)
    first, pieces, held = {}, {}, {}  # of each value its first block and how many; of each block its values
    at, room = -1, 0
    for p in sorted(sizes):
        if sizes[p] > room:
            at += 1
            pieces[p] = -(-sizes[p] // BLOCK)
            room = 0 if pieces[p] > 1 else BLOCK - sizes[p]
        else:
            pieces[p] = 1
            room -= sizes[p]
        first[p] = at
        for k in range(pieces[p]):
            held.setdefault(at + k, []).append(p)
        at += pieces[p] - 1
    lo = {k: min(first[q] for q in sizes if any(abs(p - q) <= reach for p in ps)) for k, ps in held.items()}
    hi = {k: max(first[q] + pieces[q] - 1 for q in sizes if any(abs(p - q) <= reach for p in ps)) for k, ps in held.items()}
    spark = names.sparkSession
    layout = spark.createDataFrame([(p, first[p], pieces[p]) for p in sizes], "p int, first long, pieces long")
    spans = spark.createDataFrame([(k, lo[k], hi[k]) for k in held], "block long, lo long, hi long")
    dealt = counted.join(F.broadcast(layout), "p").withColumn("block", F.col("first") + F.pmod(F.xxhash64("label"), F.col("pieces")))
    list_ = F.collect_list(F.struct("label", "words"))
    blocks = dealt.groupBy("block").agg(F.flatten(list_["words"]).alias("flat"), list_["label"].alias("labels")).join(F.broadcast(spans), "block")
    as_left = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", "hi")).alias("j"), F.lit(0).alias("side"), "flat", "labels")
    as_right = blocks.select(F.explode(F.sequence("lo", "block")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "flat", "labels").where("i < j")

    def meet(table: pa.Table) -> pa.Table:
        sides = table["side"].to_pylist()
        words = {s: np.asarray(f.values, np.int64).view(np.uint64).reshape(-1, lanes) for s, f in zip(sides, table["flat"])}
        labels = {s: np.asarray(f.values, np.int64) for s, f in zip(sides, table["labels"])}
        other = 1 if 1 in words else 0
        found = np.array(spanning_links(words[0], words[other], radius, other == 0), np.int64).reshape(-1, 2)
        return pa.table({"a": labels[0][found[:, 0]], "b": labels[other][found[:, 1]]})

    return as_left.unionByName(as_right).groupBy("i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 48, lanes: int = 4) -> DataFrame:
    """A row for each row of df: doc_id, fingerprint (hex), component_id.

    Documents link when their fingerprints differ in at most radius bits; component_id is the smallest id reachable.
    Null and empty texts, and texts without a word, have fingerprint zero and link like any other.  Null ids count for
    no component's name (a component of null ids only has a null name).  Repeated rows each keep their row; an empty
    table gives an empty table.

    With shingles of five words, 256 bits and a radius of 48, texts whose shingle sets have a Jaccard similarity of 0.8
    are expected 39 bits apart (deviation 6), unrelated texts 128 bits (deviation 8).
    """
    base = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text_"))
    marked = with_fingerprints(base, text_col="text_", out="words", words=words, lanes=lanes)
    docs = materialise(marked.select("doc_id", hex_name(F.col("words")).alias("fingerprint"), "words"))
    names = numbered(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")))
    found = components(near_links(names.select("label", "words"), radius, lanes))
    rooted = names.join(found, names["label"] == found["node"], "left").select("fingerprint", "least", F.coalesce("root", "label").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    verdict = rooted.join(of_root, "root").select("fingerprint", "component_id")
    return docs.select("doc_id", "fingerprint").join(verdict, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _row_name(id_col: str, text_col: str) -> Column:
    return F.concat_ws(":", F.sha2(F.coalesce(col(text_col), F.lit("")), 256), col(id_col).cast("long"))


def _with_sets(df: DataFrame, words: int, lanes: int) -> DataFrame:
    """df: (doc_id, row, text_).  Without the text; name: of its set of shingles; fingerprint of the set; the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, sizes = [], [], []
            for x in batch.column("text_"):
                h = np.unique(shingle_hashes(x.as_py(), words))
                names.append(xxhash.xxh3_128_hexdigest(h.tobytes(), SEED))
                found.append(fingerprint(h, lanes).view(np.int64))
                sizes.append(len(h))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * lanes), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(names, pa.string()), lists, pa.array(sizes, pa.int64())], names=["doc_id", "row", "name", "words", "n"])

    return df.select("doc_id", "row", "text_").mapInArrow(run, "doc_id long, row string, name string, words array<long>, n long")


def verified_roots(left: list[np.ndarray], right: list[np.ndarray] | None, left_bits: np.ndarray, right_bits: np.ndarray | None, radius: int, least: float) -> np.ndarray:
    """Of all sets (left, then right) the first one that links of Jaccard similarity `least` or more reach.

    Links are between left and right, or without right inside left; only pairs at most radius bits apart are looked at,
    and pairs that verified links connect already need no look.
    """
    sets = left + (right or [])
    shift = 0 if right is None else len(left)
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    own = [ids[b - n : b] for b, n in zip(ends.tolist(), size.tolist())]
    here = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    label = np.arange(len(sets))
    for i, j in close_pairs(left_bits, left_bits if right_bits is None else right_bits, radius):
        j = j + shift
        fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-6)
        i, j = i[fits], j[fits]
        for x in np.unique(i).tolist():
            others = j[i == x]
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            here[own[x]] = True
            common = np.array([np.count_nonzero(here[own[y]]) for y in others.tolist()], np.int64)
            here[own[x]] = False
            linked = others[common >= least * (size[x] + size[others] - common) - 1e-9]
            if len(linked):
                joined = np.unique(label[np.append(linked, x)])
                label[np.isin(label, joined)] = joined[0]
    return label


def _verified_links(df: DataFrame, members: DataFrame, words: int, radius: int, lanes: int, least: float) -> DataFrame:
    """members: (row, label, words, n, root), root the candidate group; df: (row, text_).  Links (a, b) of labels that
    connect what the verified candidates of each group connect."""
    weight = members.groupBy("root").agg(F.ceil(F.sum("n") / PIECE).cast("long").alias("pieces"))
    placed = members.join(weight, "root").withColumn("piece", F.pmod(F.xxhash64("label"), F.col("pieces")))
    texts = df.join(placed.select("row", "label", "words", "root", "piece", "pieces"), "row").select("root", "piece", "pieces", "label", "words", "text_")
    spots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda k: F.struct(F.least("piece", k).alias("i"), F.greatest("piece", k).alias("j"), (k < F.col("piece")).cast("int").alias("side")))
    dealt = texts.withColumn("at", F.explode(spots)).select("root", "at.i", "at.j", "at.side", "label", "words", "text_")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "label")

    def settle(sides: list[dict]) -> tuple[list[int], list[int]]:
        names, sets, bits = zip(*(([*s], [x for x, _ in s.values()], np.array([w for _, w in s.values()], np.int64).view(np.uint64).reshape(-1, lanes)) for s in sides))
        both = len(sides[1]) > 0
        label = verified_roots(sets[0], sets[1] if both else None, bits[0], bits[1] if both else None, radius, least)
        all_ = names[0] + names[1]
        moved = (label != np.arange(len(label))).nonzero()[0].tolist()
        return [all_[k] for k in moved], [all_[label[k]] for k in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, a, b = None, [{}, {}], [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j")))
            for k, (key, side, label) in enumerate(zip(keys, batch.column("side").to_pylist(), batch.column("label").to_pylist())):
                if key != at:
                    if at is not None and (at[1] == at[2] or sides[1]):
                        for out, more in zip((a, b), settle(sides)):
                            out += more
                    at, sides = key, [{}, {}]
                if label not in sides[side]:  # rows may repeat
                    sides[side][label] = np.unique(shingle_hashes(batch.column("text_")[k].as_py(), words)), batch.column("words")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        if at is not None and (at[1] == at[2] or sides[1]):
            a, b = settle(sides)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 76, lanes: int = 4) -> DataFrame:
    """A row for each row of df: doc_id, row (of its text's digest and id), first_row (of its group), component_id.

    Documents link when their sets of shingles have a Jaccard similarity of `least` or more, exactly (sets of 64-bit
    hashes); texts without a word link to each other.  The group's first row is the one of the smallest id (null last),
    then of the smallest digest; component_id is its id.

    Fingerprints of the sets only propose the pairs: at 0.8 two sets are expected 39 bits of 256 apart (deviation 6), at
    worst 48 (sets of four and five shingles), unrelated sets 128 (deviation 8).  Sets whose sizes alone exclude
    `least`, and unequal sets too small for it, never meet.
    """
    base = df.select(col(id_col).cast("long").alias("doc_id"), _row_name(id_col, text_col).alias("row"), col(text_col).alias("text_"))
    docs = materialise(_with_sets(base, words, lanes))
    place = F.struct(F.col("doc_id").isNull().alias("null_"), "doc_id", "row")
    names = numbered(docs.groupBy("name").agg(F.min(place).alias("least"), F.first("words").alias("words"), F.first("n").alias("n")))
    large = names.where(F.col("n") >= int(np.ceil(least / max(1 - least, 1e-9) - 1e-6)))  # n of n + 1 is the most that unequal sets share
    like = F.floor(F.log(F.col("n")) / F.lit(-float(np.log(least)) * (1 + 1e-9)))
    found = components(near_links(large.select("label", "words", "n"), radius, lanes, by=like, reach=1))
    members = materialise(large.join(found, large["label"] == found["node"]).select(F.col("least.row").alias("row"), "label", "words", "n", "root"))
    true = components(_verified_links(base.select("row", "text_"), members, words, radius, lanes, least))
    rooted = names.join(true, names["label"] == true["node"], "left").select("name", "least", F.coalesce("root", "label").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("first"))
    verdict = rooted.join(of_root, "root").select("name", F.col("first.row").alias("first_row"), F.col("first.doc_id").alias("component_id"))
    return docs.select("doc_id", "row", "name").join(verdict, "name").select("doc_id", "row", "first_row", "component_id")


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The first row of each group of `similar` documents, all columns as they are, also where ids repeat or are null."""
    first = similar(df, id_col=id_col, text_col=text_col, **how).select("first_row").distinct()
    return keep_named(df, _row_name(id_col, text_col), first, text_col)
