"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Two permutations give all signature coordinates: the first scatters the shingles over 2**32 places,
the second, shifted by one more place for each coordinate, orders them. Bands of coordinates name
buckets. Documents with equal sets are collapsed first. Each document meets the smallest of its buckets,
and confirmed links make parts of buckets. Buckets that then still hold several parts are settled
whole, in tiles: those outside of the largest part are compared with all others there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as T
from spanloom.llm.components import components
from spanloom.llm.tables import keep_keys, map_batches, order_of, row_key, sized, unique_rows
from spanloom.session import staged

SHINGLE, SHARE = 2, 80
#: A pair of documents at the limit of 0.8 shares no band with probability (1 - 0.8**5)**30 < 7e-6.
BANDS, BAND_ROWS = 30, 5
#: Smallest documents of its buckets that every document meets first.
FIRST_CENTRES = 1
#: Shingles of a part of a bucket: two parts are compared in one task.
TILE_NAMES = 1 << 19
#: Documents of a tile that are compared with the others, that others are compared with, or both.
LEFT, RIGHT, BOTH = 1, 2, 3
#: Bytes kept of each shingle's name when two sets are compared.
NAME_BYTES = 6

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def shingle_sets(buf: np.ndarray, cut: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of every row, and each row's range of them."""
    buf = LOWER[buf]
    starts, ends, rows = T.word_spans(buf, cut, T.IS_SPACE)
    names = T.span_names(buf, starts, ends)
    count = np.diff(rows)
    blocks = T.BlockNames(names, 0xD1342543DE82EF95)
    sets, sizes = [], np.zeros(len(count), dtype=np.int64)
    at = np.arange(len(names))
    whole = blocks.name(at[: max(len(names) - size + 1, 0)], at[: max(len(names) - size + 1, 0)] + size)
    for i in range(len(count)):
        lo, hi = rows[i], rows[i + 1]
        if hi - lo >= size:
            own = np.unique(whole[lo : hi - size + 1])
        elif hi > lo:
            own = blocks.name(rows[i : i + 1], rows[i + 1 : i + 2])
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=T.U64)
    return flat, np.append(0, np.cumsum(sizes))


def circulant_bands(names: np.ndarray, ends: np.ndarray, bands: int = BANDS, width: int = BAND_ROWS) -> np.ndarray:
    """Names of all bands (rows by bands) of non-empty sets, which stand one after the other."""
    place = _mix32((T.mix(names) >> T.U64(32)).astype(np.uint32))
    heads = ends[:-1]
    out = np.zeros((len(heads), bands), dtype=T.U64)
    for band in range(bands):
        name = np.full(len(heads), T.U64(band + 1))
        for k in range(band * width, (band + 1) * width):
            least = np.minimum.reduceat(_mix32(place - np.uint32(k)), heads)
            name = T.mix(name * T.U64(0x9E3779B97F4A7C15) ^ least.astype(T.U64))
        out[:, band] = name
    return out


def signatures(documents: DataFrame, size: int = SHINGLE, bands: int = BANDS, width: int = BAND_ROWS) -> DataFrame:
    """``(id, n, s1, s2, bands)``: set size, 128 bits that stand for the set, names of its buckets."""
    kind = documents.schema["id"].dataType.simpleString()

    def rows_of(batch):
        data, offsets = T.text_bytes(batch.column("text"))
        for a, z in T.chunks(offsets):
            names, ends = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], size)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            sums = [np.zeros(z - a, dtype=T.U64) for _ in range(2)]
            lists = np.zeros((z - a, bands), dtype=T.U64)
            if len(full):
                own = np.append(ends[full], ends[-1])
                for k in range(2):
                    sums[k][full] = np.add.reduceat(T.mix(names + T.U64(k * 0x632BE59BD9B4E019)), own[:-1])
                lists[full] = circulant_bands(names, own, bands, width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, z - a),
                    pa.array(n),
                    *[pa.array(s.view(np.int64)) for s in sums],
                    pa.ListArray.from_arrays(np.arange(0, (z - a) * bands + 1, bands, dtype=np.int32), lists.reshape(-1).view(np.int64)),
                ],
                ["id", "n", "s1", "s2", "bands"],
            )

    return map_batches(documents, rows_of, f"id {kind}, n bigint, s1 bigint, s2 bigint, bands array<bigint>")


def _packed_sets(documents: DataFrame, size: int) -> DataFrame:
    """``(id, items)``: the sorted names of a set, ``NAME_BYTES`` each."""
    kind = documents.schema["id"].dataType.simpleString()

    def rows_of(batch):
        data, offsets = T.text_bytes(batch.column("text"))
        for a, z in T.chunks(offsets):
            names, ends = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], size)
            raw = np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]).tobytes()
            step = (ends * NAME_BYTES).tolist()
            items = pa.array([raw[p:q] for p, q in zip(step, step[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, z - a), items], ["id", "items"])

    return map_batches(documents, rows_of, f"id {kind}, items binary")


def _numbers(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // NAME_BYTES, 8), dtype=np.uint8)
    wide[:, :NAME_BYTES] = raw.reshape(-1, NAME_BYTES)
    return wide.view("<u8").reshape(-1)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs ``(a, b)`` of which the full sets meet the limit, written."""
    pairs = staged(pairs, "pairs")
    kind = pairs.schema["a"].dataType.simpleString()
    own = [sets.toDF(c, f"items_{c}") for c in ("a", "b")]

    def rows_of(batch):
        sides = [T.text_bytes(batch.column(f"items_{c}")) for c in ("a", "b")]
        (one, one_at), (two, two_at) = sides
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = _numbers(one[one_at[i] : one_at[i + 1]]), _numbers(two[two_at[i] : two_at[i + 1]])
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = shared > 0 and 100 * shared >= share * (len(x) + len(y) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(own[0], "a").join(own[1], "b").select("a", "b", "items_a", "items_b")
    return staged(map_batches(joined, rows_of, f"a {kind}, b {kind}"), "links")


def _bucket_links(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between documents of one bucket that nothing is known to join so far, written.

    ``members`` has ``(key, id, n, component)``, where equal components stand for documents that links
    join already. In a bucket, documents outside of its largest component are compared with all others,
    whole sets with whole sets, inside one task and without a row for a pair. A large bucket is cut into
    tiles: its documents into ``across`` parts and those outside of the largest component into ``down``
    parts, and every two parts meet once. One link of a document to each other component is enough.
    """
    members = staged(members, "labelled-members")
    by_part = members.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("names"))
    largest = F.max(F.struct("rows", "component", "names"))
    open_ = by_part.groupBy("key").agg(largest.alias("main"), F.sum("names").alias("names"), F.count("*").alias("parts")).where("parts > 1")

    def parts(names):
        return F.ceil(names / TILE_NAMES).cast("int")

    open_ = staged(
        open_.select("key", F.col("main.component").alias("main"), parts(F.col("names")).alias("across"), parts(F.col("names") - F.col("main.names")).alias("down")),
        "open-buckets",
    )
    rows = members.join(open_, "key").withColumn("outside", F.col("component") != F.col("main"))
    one = (F.col("across") == 1) & (F.col("down") == 1)
    at = [F.pmod(F.xxhash64("id", F.lit(c)), F.col(c)).cast("int") for c in ("across", "down")]
    every = [F.sequence(F.lit(0), F.col(c) - 1) for c in ("across", "down")]
    place = [F.col("key"), F.col("id"), F.xxhash64("component").alias("part")]
    tiles = rows.where(one).select(*place, F.lit(0).alias("t"), F.lit(0).alias("d"), F.when(F.col("outside"), BOTH).otherwise(RIGHT).alias("side"))
    tiles = tiles.unionByName(rows.where(~one).select(*place, at[0].alias("t"), F.explode(every[1]).alias("d"), F.lit(RIGHT).alias("side")))
    tiles = tiles.unionByName(rows.where(~one & F.col("outside")).select(*place, F.explode(every[0]).alias("t"), at[1].alias("d"), F.lit(LEFT).alias("side")))
    kind = members.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, part = table["side"].to_numpy(), table["part"].to_numpy()
        raw, at = T.text_bytes(table["items"])
        names = np.unique(_numbers(raw), return_inverse=True)[1]
        at //= NAME_BYTES
        size = np.diff(at)
        right = np.flatnonzero(side != LEFT)
        marked, ones, others = np.zeros(len(names) + 1, dtype=bool), [], []
        if len(right):
            inside = np.repeat(side != LEFT, size)
            theirs, heads = names[inside], np.cumsum(size[right]) - size[right]
            for i in np.flatnonzero(side != RIGHT).tolist():
                own = names[at[i] : at[i + 1]]
                marked[own] = True
                shared = np.add.reduceat(marked[theirs], heads, dtype=np.int64)
                marked[own] = False
                hit = right[(100 * shared >= share * (size[i] + size[right] - shared)) & (part[right] != part[i])]
                hit = hit[np.unique(part[hit], return_index=True)[1]]
                ones.append(np.full(len(hit), i))
                others.append(hit)
        pick = [pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in (ones, others)]
        return pa.table([table["id"].take(p) for p in pick], ["a", "b"])

    compared = tiles.join(sets, "id").groupBy("key", "t", "d").applyInArrow(run, f"a {kind}, b {kind}")
    return staged(compared.distinct(), "bucket-links")


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE, share: int = SHARE, bands: int = BANDS, width: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component)`` of every document.

    A document's set holds its distinct shingles of ``size`` words (``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased), a shorter text as a whole. Documents are linked if their sets share at least
    ``share`` percent of their union; ``component`` is the smallest id that links reach. Null, empty
    and blank texts have an empty set and no links. Of rows that share an id one is used (see
    :func:`tables.unique_rows`), rows without id are left out, other columns play no part. A linked
    pair can be missed only if no band agrees (see ``BANDS``) and no other links join the two.
    """
    docs = unique_rows(documents, id_col, text_col).toDF("id", "text")
    sig = staged(signatures(docs, size, bands, width), "signatures")
    full = sig.where("n > 0")
    first = staged(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "equal-sets")
    reps = staged(full.select("id", "n", "s1", "s2").join(first, ["s1", "s2", "n"]).select("id", "rep"), "representatives")

    buckets = keep_keys(full, first.select(F.col("rep").alias("id")), ["id"]).select("id", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
    shared = staged(shared.drop("last"), "shared-buckets")
    inside = staged(buckets.join(sized(shared), "key"), "bucket-members")
    sets = staged(_packed_sets(keep_keys(docs, staged(inside.select("id").distinct(), "bucket-ids"), ["id"]), size), "sets")

    nearest = inside.where("id > centre").groupBy("id").agg(F.array_sort(F.collect_set("centre")).alias("centres"))
    nearest = nearest.select(F.col("id").alias("a"), F.explode(F.slice("centres", 1, FIRST_CENTRES)).alias("b"))
    links = confirmed(nearest, sets, share)
    # What two links join is one part of a bucket; parts need not be whole components.
    upper = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("c"))
    part = links.groupBy("a").agg(F.min("b").alias("b")).join(upper, "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("component"))
    members = inside.join(staged(part, "bucket-parts"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    found = components(links.unionByName(_bucket_links(members, sets, share)))
    label = found.select(F.col("id").alias("rep"), "component")
    named = reps.join(label, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    return sig.select("id", F.col("n").alias("n_shingles")).join(named, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component")
    )


def duplicate_report(documents: DataFrame) -> DataFrame:
    """Set size, component and whether the document stays, one row per document."""
    return near_duplicates(documents).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``documents`` without those that are linked to one of a smaller id by shingles of ``size`` words.

    Every row is judged by its own text, also rows that share an id; of a group all rows of its smallest
    id stay. Rows without id stay.
    """
    keyed = documents.withColumn("__row", row_key(documents, id_col, text_col))
    found = near_duplicates(keyed, size, id_col="__row", text_col=text_col)
    gone = found.where(order_of(found, "id", "id") > order_of(found, "id", "component")).select(F.col("id").alias("__row"))
    return keyed.join(sized(staged(gone, "duplicates")), "__row", "left_anti").select(*documents.columns)
