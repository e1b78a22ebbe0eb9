"""Near-duplicate texts by set similarity of character sequences, exactly (problem 2).

Texts are folded, exact copies become one class, and each class is a set of three-character sequences. A similarity of t bounds
the sizes of a pair (a row's size band) and forces it to share one of the rarest sequences of each side (prefix filter under
one fixed order), so rows meet only in tiles of one sequence and neighbouring sizes. Within a tile, positions and the bit
counts of hashed bitmap signatures bound the overlap from above before sorted arrays are intersected exactly. The order comes
from a histogram of all sequences in hash buckets of a fixed number; any order gives the exact result, a rare-first one a fast one.
Tiles of sequences that occur very often are cut into blocks, and the blocks compared two by two in different tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import fold, gram_sets, histogram, hot_join, mixed_hash, strings
from sedgewren.session import small, written

ORDER_BITS = 20
WORDS = 3


def _bucket(value: np.ndarray) -> np.ndarray:
    return (mixed_hash(value) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least common elements of sets of sizes a and b with similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def bitmap_bound(sig_a: np.ndarray, sig_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: a bit set in one signature only stands for at least one element of that set only."""
    only_a = np.bitwise_count(sig_a & ~sig_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(sig_b & ~sig_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, folded): every row with its folded text's class, the smallest id of that text. NULL folds to ''."""
    kind = rows.schema[id_col].dataType.simpleString()

    def folded(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fold(x) for x in strings(b.column(1))], pa.string())], names=["id", "folded"])

    return rows.select(id_col, text_col).mapInArrow(folded, f"id {kind}, folded string")


def near_classes(texts: DataFrame, order: np.ndarray, t: float = 0.7, n: int = 3, block: int = 50_000) -> DataFrame:
    """(a, b) class pairs, a < b, whose sets of ``n``-character sequences have at least ``t`` of their union in common.

    ``texts`` has (class_id, folded) with one row for each distinct text; ``order`` is ``sequence_counts`` of them. Texts below
    ``n`` characters have no sequence and no pair. The result is exact. A text is sent once to each task that holds some of its
    tiles. The tile of a sequence that occurs more than ``block`` times is cut into blocks, each two of which are a tile.
    """
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(order)
    groups = max(8, int(order.sum() // 2_500_000))
    kind = texts.schema["class_id"].dataType.simpleString()

    def postings(batches):
        for b in batches:
            value, of, size = gram_sets(strings(b.column("folded")), n)
            if not len(value):
                continue
            bucket = _bucket(value)
            often = common.value[bucket]
            # the order: by count, then by bucket, then by value (the sort is stable)
            rank = np.minimum(often, (1 << 24) - 1).astype(np.uint64) << np.uint64(ORDER_BITS) | bucket.astype(np.uint64)
            by = np.argsort(of.astype(np.uint64) << np.uint64(44) | rank, kind="stable") if len(size) < 1 << 20 else np.lexsort((rank, of))
            value, often = value[by], often[by]
            pos = np.arange(len(value)) - np.concatenate([[0], np.cumsum(size)[:-1]])[of]
            sig = _signatures(value, of, len(size))
            keep = pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[of]
            yield from _sent(b.column("class_id"), sig, size, value[keep], of[keep], pos[keep], often[keep], block, groups, t)

    sent = texts.select("class_id", "folded").mapInArrow(postings, f"grp int, id {kind}, blob binary")
    pairs = sent.repartition(groups, "grp").mapInArrow(lambda batches: _tiles(batches, t), f"a {kind}, b {kind}").distinct()
    pairs = written(pairs)
    # only texts of candidate pairs are sent to be compared
    wanted = texts.join(small(pairs.select(F.explode(F.array("a", "b")).alias("class_id"))), "class_id", "left_semi")
    left = wanted.select(F.col("class_id").alias("a"), F.col("folded").alias("fa"))
    right = wanted.select(F.col("class_id").alias("b"), F.col("folded").alias("fb"))

    def exact(batches):
        for b in batches:
            ok = _similar(strings(b.column("fa")), strings(b.column("fb")), t, n)
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(exact, f"a {kind}, b {kind}")


def sequence_counts(folded: DataFrame, n: int = 3) -> np.ndarray:
    """Occurrences of ``n``-character sequences by hash bucket, over all rows of the one-column frame."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        value, _, _ = gram_sets(strings(batch.column(0)), n)
        return np.bincount(_bucket(value), minlength=1 << ORDER_BITS)[None]

    return np.minimum(histogram(folded, count, ORDER_BITS)[0], (1 << 31) - 1).astype(np.int32)


def _sent(ids, sig, size, value, of, pos, often, block, groups, t):
    """One row for each text and group of tiles; frequent sequences have a tile for each two blocks of texts."""
    parts = -(-often.astype(np.int64) // block)
    parts[parts < 1] = 1
    again = np.repeat(np.arange(len(value)), parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (mixed_hash(sig[:, 0] ^ sig[:, 1], 5)[of[again]] >> np.uint64(11)).astype(np.int64) % parts[again]
    low, high = np.minimum(own, other), np.maximum(own, other)
    side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.int8)
    tile = mixed_hash(value[again] ^ mixed_hash((low << 20 | high).astype(np.uint64), 3), 4)
    group = (tile >> np.uint64(33)).astype(np.int64) % groups
    text = of[again]
    by = np.lexsort((group, text))
    text, group = text[by], group[by]
    body = np.empty(len(text), POSTING)
    place, whole = pos[again][by], size[text]
    # the smaller of two alike sets shares one of still fewer of its rarest sequences
    first = place < whole - np.ceil(2 * t / (1 + t) * whole - 1e-9).astype(np.int64) + 1
    body["tile"] = tile[by].astype(np.uint32)
    body["rest"] = np.minimum(whole - place, MOST) << 3 | first << 2 | side[by]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (group[1:] != group[:-1])]))
    who = text[new]
    head = np.empty(len(new), HEAD)
    head["size"], head["sig"] = size[who], sig[who]
    # each row's bytes: its head, then its postings
    bounds = np.concatenate([new, [len(text)]])
    ends = np.cumsum(HEAD.itemsize + np.diff(bounds) * POSTING.itemsize)
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[(starts[:, None] + np.arange(HEAD.itemsize)).ravel()] = head.view(np.uint8)
    free = np.ones(len(out), bool)
    free[(starts[:, None] + np.arange(HEAD.itemsize)).ravel()] = False
    out[free] = body.view(np.uint8)
    blob = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.concatenate([starts, ends[-1:]]).astype(np.int32)), pa.py_buffer(out)])
    yield pa.record_batch([pa.array(group[new].astype(np.int32)), ids.take(pa.array(who)), blob], names=["grp", "id", "blob"])


def _signatures(value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Hashed bitmaps of ``64 * WORDS`` bits."""
    bit = (mixed_hash(value, 9) >> np.uint64(40)).astype(np.int64) % (64 * WORDS)
    flat = np.zeros(n * WORDS * 64, np.uint8)
    flat[of * (64 * WORDS) + bit] = 1
    return np.packbits(flat, bitorder="little").view(np.uint64).reshape(n, WORDS)


HEAD = np.dtype([("size", "<i4"), ("sig", "<u8", (WORDS,))])
POSTING = np.dtype([("tile", "<u4"), ("rest", "<u2")])
#: A rest length of this many or more is not used as a bound.
MOST = (1 << 13) - 1


def _opened(blobs: list[bytes]):
    """Sizes and signatures of the rows, and text, tile, rest length, side and index mark of their postings."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    starts = np.cumsum(lengths) - lengths
    heads = (starts[:, None] + np.arange(HEAD.itemsize)).ravel()
    head = flat[heads].view(HEAD)
    free = np.ones(len(flat), bool)
    free[heads] = False
    body = flat[free].view(POSTING)
    text = np.repeat(np.arange(len(blobs)), (lengths - HEAD.itemsize) // POSTING.itemsize)
    rest = (body["rest"] >> 3).astype(np.int32)
    rest[rest == MOST] = np.iinfo(np.int32).max
    return head["size"].astype(np.int32), np.ascontiguousarray(head["sig"]), text, body["tile"], rest, (body["rest"] & 3).astype(np.int8), (body["rest"] & 4) > 0


def _tiles(batches, t: float, at_once: int = 2_000_000):
    """Candidate pairs of all tiles of a task, each pair once."""
    held = [pa.Table.from_batches([b]) for b in batches]
    if not held or not sum(h.num_rows for h in held):
        return
    x = pa.concat_tables(held)
    ids = x["id"].combine_chunks()
    size, sig, text, tile, left, side, index = _opened(x["blob"].to_pylist())
    del x, held
    order = np.lexsort((size[text], tile))
    text, tile, left, side, index = text[order].astype(np.int32), tile[order].astype(np.int64), left[order], side[order], index[order]
    size = size[text]
    need_of = least_overlap(np.arange(2 * int(size.max()) + 1), 0, t).astype(np.int32)
    # rows of a tile are sorted by size: row r meets the rows after it up to size / t
    end = np.searchsorted(tile * (1 << 31) + size, tile * (1 << 31) + np.floor(size / t + 1e-9).astype(np.int64), side="right")
    begin = np.arange(len(text)) + 1
    number = np.where(index, np.maximum(end - begin, 0), 0)
    upto = np.cumsum(number)
    at, found = 0, []
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, side="right")))
        m = number[at:to]
        r = np.repeat(np.arange(at, to, dtype=np.int32), m)
        s = np.arange(len(r), dtype=np.int32) - np.repeat((np.cumsum(m) - m - begin[at:to]).astype(np.int32), m)
        at = to
        need = need_of[size[r] + size[s]]
        ok = np.flatnonzero((left[r] >= need) & (left[s] >= need))
        r, s, need = r[ok], s[ok], need[ok]
        ok = (side[r] == 0) | (side[r] != side[s])
        ok &= bitmap_bound(sig[text[r]], sig[text[s]], size[r], size[s]) >= need
        a, b = text[r[ok]].astype(np.int64), text[s[ok]].astype(np.int64)
        found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        if sum(map(len, found)) > 4 * at_once:
            found = [np.unique(np.concatenate(found))]
    pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    for k in range(0, len(pair), 100_000):
        a, b = ids.take(pa.array(pair[k : k + 100_000] >> 32)), ids.take(pa.array(pair[k : k + 100_000] & ((1 << 32) - 1)))
        yield pa.record_batch([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], names=["a", "b"]).filter(pc.not_equal(a, b))


def _similar(left: list[str], right: list[str], t: float, n: int) -> np.ndarray:
    """Exact test by intersection of sorted arrays, all pairs of a batch at once."""
    va, oa, na = gram_sets(left, n)
    vb, ob, nb = gram_sets(right, n)
    both = np.concatenate([va, vb])
    of = np.concatenate([oa, ob])
    order = np.lexsort((both, of))
    both, of = both[order], of[order]
    same = (both[1:] == both[:-1]) & (of[1:] == of[:-1])
    common = np.bincount(of[1:][same], minlength=len(left)) if len(both) > 1 else np.zeros(len(left), np.int64)
    union = na + nb - common
    return (union > 0) & (common >= t * union - 1e-9)


def near_pairs(rows: DataFrame, id_col: str = "id", text_col: str = "question", t: float = 0.7, n: int = 3, most_copies: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of rows alike by at least ``t``, each judged by itself.

    Copies of one text are similar to each other and to the same rows; up to ``most_copies`` rows of a text are written out
    in all pairs, a larger group only against its smallest id (``near_groups`` has every row's class). Texts that fold to
    fewer than ``n`` characters have no pair. Empty input gives no rows; other columns are ignored.
    """
    members, texts, order = _classes(rows, id_col, text_col, n)
    pairs = written(near_classes(texts, order, t, n))
    repeated = members.where("copies > 1")
    # only classes of several rows are joined: any other class is its own row
    m = repeated.where((F.col("copies") <= most_copies) | (F.col("id") == F.col("class_id"))).select("class_id", "id")
    between = pairs.join(m.select(F.col("class_id").alias("a"), F.col("id").alias("x")), "a", "left").join(m.select(F.col("class_id").alias("b"), F.col("id").alias("y")), "b", "left")
    between = between.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    small = repeated.where(F.col("copies") <= most_copies)
    within = small.select("class_id", F.col("id").alias("x")).join(small.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y")
    star = repeated.where((F.col("copies") > most_copies) & (F.col("id") != F.col("class_id"))).select(F.col("class_id").alias("x"), F.col("id").alias("y"))
    return between.unionByName(within).unionByName(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _classes(rows: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Every row with class id and number of copies; one row for each class with its text; counts of all sequences."""
    folded = written(classes(rows, id_col, text_col).where(F.length("folded") >= n))
    order = sequence_counts(folded.select("folded"), n)
    keyed = folded.select("id", F.xxhash64("folded").alias("h"), F.hash("folded").alias("g"))
    counted = keyed.groupBy("h", "g").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    several = hot_join(keyed, written(counted.where("copies > 1")), ["h", "g"], "copies").select("id", "class_id", "copies")
    members = written(several.unionByName(counted.where("copies = 1").select(F.col("class_id").alias("id"), "class_id", "copies")))
    copies = small(members.where("id <> class_id").select("id"))
    texts = folded.join(copies, "id", "left_anti").select(F.col("id").alias("class_id"), "folded")
    return members, texts, order


def near_groups(rows: DataFrame, id_col: str = "id", text_col: str = "question", t: float = 0.7, n: int = 3) -> DataFrame:
    """(id, class_id, copies, links): every row with its text's class and the number of other texts that are alike.

    Rows whose text folds to fewer than ``n`` characters are their own class and have no links.
    """
    members, texts, order = _classes(rows, id_col, text_col, n)
    pairs = near_classes(texts, order, t, n)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    full = rows.select(F.col(id_col).alias("id")).join(members, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return full.join(links, "class_id", "left").select("id", "class_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
