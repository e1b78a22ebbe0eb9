"""Same or nearly the same texts across splits (problem 6).

The texts of the evaluation splits are cut into shards, and each shard is kept as a compressed full-text index: the
Burrows-Wheeler transform with the text that each suffix belongs to. Texts alike enough share one of the rarest two-character
sequences of either side, under one order for all texts; a text goes to the shards that its rarest sequences belong to, so it
is not sent to every shard. Training texts stream through their shards, and backward search locates these sequences. Of each pair
that is alike, backward search of the training text in the evaluation text gives all maximal matches, which are merged into spans;
common sequences are counted, and the similarity is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import _packed, code_points, fold, gram_sets, hot_join, mixed_hash, strings
from sedgewren.llm.near_pairs import ORDER_BITS, _bucket, _signatures, bitmap_bound, least_overlap, sequence_counts
from sedgewren.session import small, written

N = 2


def suffix_array(points: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling."""
    _, rank = np.unique(points, return_inverse=True)
    rank, k, n = rank.astype(np.int64), 1, len(points)
    while n:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        step = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or k > n:
            return order
        k *= 2
    return np.empty(0, np.int64)


class TextIndex:
    """Full-text index of a list of texts, each followed by a separator.

    With ``apart`` the letters of a text are marked with its number, so that a pattern marked likewise is searched in that text only.
    """

    def __init__(self, texts: list[str] | None = None, packed: dict | None = None, apart: bool = False):
        if packed is None:
            points, offsets = code_points([t + "\0" for t in texts])
            if apart:
                points = points.astype(np.uint64) | np.repeat(np.arange(len(texts)), np.diff(offsets)).astype(np.uint64) << np.uint64(21)
            order = suffix_array(points)
            self.bwt = points[order - 1]
            self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))[order]
        else:
            self.bwt = np.frombuffer(_raw(packed["bwt"]), np.uint32)
            self.owner = np.frombuffer(_raw(packed["owner"]), np.int32)
        n = len(self.bwt)
        # occurrences of each character in the transform, in order: rank is a search in them
        self.letters, code = np.unique(self.bwt, return_inverse=True)
        place = np.argsort(code, kind="stable")
        self.key = code[place].astype(np.int64) * (n + 1) + place
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.letters)))])
        self.n = n

    def pack(self) -> dict:
        return {"bwt": _packed(self.bwt.astype(np.uint32)), "owner": _packed(self.owner)}

    def back(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns at once; an empty interval has low >= high."""
        code = np.searchsorted(self.letters, letter)
        known = (code < len(self.letters)) & (self.letters[np.minimum(code, len(self.letters) - 1)] == letter)
        code = np.where(known, code, 0).astype(np.int64)
        base = code * (self.n + 1)
        lo = np.searchsorted(self.key, base + low)
        hi = np.searchsorted(self.key, base + high)
        return np.where(known, lo, 0), np.where(known, hi, 0)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one list."""
    return pa.array([column.to_pylist()], pa.list_(pa.field("element", column.type)))


def _raw(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _rarest(texts: list[str], often: np.ndarray, shards: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, texts and shards of the rarest sequences of each text, of which alike texts share one; and all sizes."""
    value, of, size = gram_sets(texts, N)
    bucket = _bucket(value)
    order = np.lexsort((value, often[bucket].astype(np.int64) << ORDER_BITS | bucket, of))
    value, of = value[order], of[order]
    pos = np.arange(len(value)) - (np.cumsum(size) - size)[of]
    keep = pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[of]
    value, of = value[keep], of[keep]
    return value, of, (mixed_hash(value, 3) % np.uint64(shards)).astype(np.int32), size


def _candidates(index: TextIndex, sizes: np.ndarray, known: np.ndarray, texts: list[str], often: np.ndarray, shards: int, shard: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, indexed text) pairs that share one of the text's rarest sequences of this shard and whose sizes and bitmaps allow the
    similarity."""
    value, of, at, size = _rarest(texts, often, shards, t)
    value, of = value[at == shard], of[at == shard]
    if not len(value) or not index.n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mask = np.uint64((1 << 21) - 1)
    low, high = np.zeros(len(value), np.int64), np.full(len(value), index.n, np.int64)
    for k in range(N):
        low, high = index.back(((value >> np.uint64(21 * k)) & mask).astype(index.letters.dtype), low, high)
    count = np.maximum(high - low, 0)
    every, own, _ = gram_sets(texts, N)
    mine = _signatures(every, own, len(texts))
    kept, begin = [], 0
    upto = np.cumsum(count)
    while begin < len(count):  # about a million located places at a time
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 1_000_000, side="right")))
        c = count[begin:end]
        row = np.repeat(of[begin:end], c)
        doc = index.owner[np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[begin:end], c)].astype(np.int64)
        begin = end
        pair = np.unique(row * (1 << 32) + doc)
        row, doc = pair >> 32, pair & ((1 << 32) - 1)
        a, b = size[row], sizes[doc]
        ok = (b >= t * a - 1e-9) & (a >= t * b - 1e-9)
        row, doc, a, b, pair = row[ok], doc[ok], a[ok], b[ok], pair[ok]
        kept.append(pair[bitmap_bound(mine[row], known[doc], a, b) >= least_overlap(a, b, t)])
    pair = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
    return pair >> 32, pair & ((1 << 32) - 1)


def maximal_matches(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, begin, end) of every maximal match of ``N`` or more characters of each left text in the right text of its pair.

    Backward search in an index of the right texts, all pairs at once: from an end the match is extended to the left as far as it
    occurs. The next match has to hold the character at which that ended; it reaches as far to the right as backward search
    of the reversed text in an index of the reversed right texts goes. Steps are in proportion to the lengths of the matches.
    """
    points, offsets = code_points(left)
    base, length = offsets[:-1], np.diff(offsets)
    mark = np.arange(len(left)).astype(np.uint64) << np.uint64(21)
    ahead, behind = TextIndex([x[::-1] for x in right], apart=True), TextIndex(right, apart=True)

    def reach(index: TextIndex, who: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Where the text of each of ``who`` stops to occur when it is read from ``at`` to the left (-1) or to the right (1)."""
        place, low, high = at.copy(), np.zeros(len(who), np.int64), np.full(len(who), index.n, np.int64)
        more = lambda x: place[x] > 0 if step < 0 else place[x] < length[who[x]]
        live = np.arange(len(who))
        live = live[more(live)]
        while len(live):
            letter = points[base[who[live]] + place[live] - (step < 0)].astype(np.uint64) | mark[who[live]]
            lo, hi = index.back(letter, low[live], high[live])
            ok = hi > lo
            live, lo, hi = live[ok], lo[ok], hi[ok]
            place[live] += step
            low[live], high[live] = lo, hi
            live = live[more(live)]
        return place

    out = ([], [], [])
    who, end = np.flatnonzero(length), length[length > 0]
    while len(who):
        begin = reach(behind, who, end, -1)
        good = end - begin >= N
        for column, x in zip(out, (who[good], begin[good], end[good])):
            column.append(x)
        go = begin > 0
        who, begin = who[go], begin[go]
        # the character before does not occur in front of this match: the next one ends as far right as it goes from there
        end = reach(ahead, who, begin - 1, 1)
        end = np.where(end < begin, begin - 1, end)
        who, end = who[end > 0], end[end > 0]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def overlap_spans(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the length of the longest maximal match, and the characters of the left text in the merged spans of all of them."""
    pair, begin, end = maximal_matches(left, right)
    longest, covered = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    np.maximum.at(longest, pair, end - begin)
    order = np.lexsort((begin, pair))
    pair, begin, end = pair[order], begin[order], end[order]
    # ends of maximal matches rise with their begins, so a span adds what lies beyond the one before
    before = np.zeros(len(pair), np.int64)
    before[1:] = np.where(pair[1:] == pair[:-1], end[:-1], 0)
    np.add.at(covered, pair, end - np.maximum(begin, before))
    return longest, covered


def cross_split_pairs(
    rows: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    split_col: str = "split",
    train: str = "train",
    evaluation: tuple[str, ...] = ("dev", "test"),
    t: float = 0.7,
    min_chars: int = 8,
    shard_texts: int = 20000,
    train_part: int = 50000,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct texts (train_class, eval_class, common, longest, covered) alike by ``t``, and every row's class.

    The second frame has (id, side, c, copies): side 0 is train, 1 evaluation, ``c`` the class, which is the smallest id of a side's
    rows of one folded text. Folded texts below ``min_chars`` characters take no part. A shard has about ``shard_texts`` texts; one
    that holds more, for a sequence that is frequent even as the rarest of its texts, is cut. A task gets at most about ``train_part``
    training texts of a shard. NULL texts, NULL splits and other splits take no part. Empty input gives no rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()

    def folded(batches):
        for b in batches:
            yield pa.record_batch([b.column("id"), b.column("side"), pa.array([fold(x) for x in strings(b.column("text"))], pa.string())], names=["id", "side", "folded"])

    side = F.when(F.col(split_col) == train, 0).when(F.col(split_col).isin(*evaluation), 1)
    taken = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), side.alias("side")).where("side IS NOT NULL AND text IS NOT NULL")
    every = written(taken.mapInArrow(folded, f"id {kind}, side int, folded string").where(F.length("folded") >= min_chars))
    texts = written(every.groupBy("side", "folded").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("copies")))
    # only texts of several rows are joined: any other row is its own class
    several = texts.where("copies > 1").select("side", "folded", "c", "copies")
    members = hot_join(every, several, ["side", "folded"], "copies").select("id", "side", "c", "copies")
    single = texts.where("copies = 1").select(F.col("c").alias("id"), "side", "c", "copies")
    members = written(members.unionByName(single))
    order = sequence_counts(texts.select("folded"), N)
    held = texts.where("side = 1").count()
    shards = max(1, -(-held // shard_texts))
    often = spark.sparkContext.broadcast(order)

    def routed(batches):
        for b in batches:
            f = strings(b.column("folded"))
            _, of, at, size = _rarest(f, often.value, shards, t)
            pair = np.unique(of.astype(np.int64) << 32 | at)
            of, at = pair >> 32, (pair & ((1 << 32) - 1)).astype(np.int32)
            yield pa.record_batch([b.column("side").take(pa.array(of)), pa.array(at), b.column("c").take(pa.array(of)), b.column("folded").take(pa.array(of)), pa.array(size[of].astype(np.int32))], names=["side", "shard", "c", "folded", "size"])

    sent = written(texts.select("side", "c", "folded").mapInArrow(routed, f"side int, shard int, c {kind}, folded string, size int"))
    result = f"train_class {kind}, eval_class {kind}, common int, longest int, covered int"
    cells = sent.groupBy("shard").agg(F.ceil(F.count_if(F.col("side") == 1) / shard_texts).cast("int").alias("subs"), F.ceil(F.count_if(F.col("side") == 0) / train_part).cast("int").alias("parts"))
    cells = small(written(cells.where("subs > 0 AND parts > 0")))
    sent = sent.join(cells, "shard").withColumn("n", F.xxhash64("folded"))

    def build(x: pa.Table) -> pa.Table:
        index = TextIndex(strings(x["folded"]))
        p = index.pack()
        return pa.table({"shard": x["shard"][:1], "sub": x["sub"][:1], "parts": x["parts"][:1], "bwt": pa.array([p["bwt"]], pa.binary()), "owner": pa.array([p["owner"]], pa.binary()), "ids": _one(x["c"]), "size": _one(x["size"]), "texts": _one(x["folded"])})

    cut = sent.where("side = 1").withColumn("sub", F.pmod("n", "subs").cast("int")).select("shard", "sub", "parts", "c", "size", "folded")
    index = written(cut.groupBy("shard", "sub").applyInArrow(build, f"shard int, sub int, parts int, bwt binary, owner binary, ids array<{kind}>, size array<int>, texts array<string>"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    stream = sent.where("side = 0").withColumn("part", F.pmod("n", "parts").cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))

    def search(key, x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        own, ids = [], []
        if x.num_rows and y.num_rows:
            index = TextIndex(packed={"bwt": x["bwt"][0].as_py(), "owner": x["owner"][0].as_py()})
            sizes, known = np.array(x["size"][0].as_py(), np.int64), x["texts"][0].as_py()
            value, of, _ = gram_sets(known, N)
            bitmaps = _signatures(value, of, len(known))
            texts, names, held = strings(y["folded"]), y["c"].combine_chunks(), x["ids"].combine_chunks().flatten()
            for at in range(0, len(texts), 5000):
                part = texts[at : at + 5000]
                found = list(_verified(part, known, *_candidates(index, sizes, bitmaps, part, often.value, shards, key[0].as_py(), t), t))
                if found:
                    p, q, common = map(np.array, zip(*found))
                    own.append(names.take(pa.array(p + at)))
                    ids.append(held.take(pa.array(q)))
                    out.append(np.stack([common, *overlap_spans([part[i] for i in p], [known[i] for i in q])], 1))
        one = lambda x, k: pa.chunked_array(x, k) if x else pa.array([], k)
        numbers = np.concatenate(out).astype(np.int32) if out else np.zeros((0, 3), np.int32)
        kind = y.schema.field("c").type
        return pa.table({"train_class": one(own, kind), "eval_class": one(ids, kind), "common": numbers[:, 0], "longest": numbers[:, 1], "covered": numbers[:, 2]})

    keys = ["shard", "sub", "part"]
    found = index.groupBy(*keys).cogroup(stream.select(*keys, "c", "folded").groupBy(*keys)).applyInArrow(search, result)
    # texts may meet in several shards
    return (found.dropDuplicates(["train_class", "eval_class"]) if shards > 1 else found), members


def _verified(texts: list[str], known: list[str], p: np.ndarray, q: np.ndarray, t: float, at_once: int = 100_000):
    """Pairs whose similarity is at least t, with the number of common sequences, by merging sorted sets."""
    for at in range(0, len(p), at_once):
        x, y = p[at : at + at_once], q[at : at + at_once]
        va, oa, na = gram_sets([texts[i] for i in x], N)
        vb, ob, nb = gram_sets([known[i] for i in y], N)
        of, both = np.concatenate([oa, ob]), np.concatenate([va, vb])
        order = np.lexsort((both, of))
        of, both = of[order], both[order]
        same = (both[1:] == both[:-1]) & (of[1:] == of[:-1])
        common = np.bincount(of[1:][same], minlength=len(x))
        ok = np.flatnonzero(common >= t * (na + nb - common) - 1e-9)
        yield from zip(x[ok].tolist(), y[ok].tolist(), common[ok].tolist())


def cross_split_overlaps(rows: DataFrame, id_col: str = "row_id", block_rows: int = 1000, **params) -> DataFrame:
    """(row_a, row_b, longest, covered), row_a < row_b: every pair of rows across the splits that is alike.

    Rows of a class are cut by hash into blocks of about ``block_rows``; a pair of classes is written out block by block, so
    that no join key holds more than about ``block_rows`` rows of either side, however many copies a text has.
    """
    pairs, members = cross_split_pairs(rows, id_col, **params)
    members = members.withColumn("blocks", F.ceil(F.col("copies") / block_rows).cast("int"))
    blocks = members.where("id = c").select("side", "c", "blocks")
    # most classes are one block, which needs no hash
    cut = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    block = members.withColumn("block", cut)
    sides = [("train_class", "train_block", "x"), ("eval_class", "eval_block", "y")]
    for side, (c, at, _) in enumerate(sides):
        own = blocks.where(F.col("side") == side).select(F.col("c").alias(c), "blocks")
        pairs = pairs.join(own, c).withColumn(at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = written(pairs)
    key = ["train_class", "eval_class", "train_block", "eval_block"]
    left, right = (
        pairs.select(*key, *(["longest", "covered"] if side == 0 else [])).join(block.where(F.col("side") == side).select(F.col("c").alias(c), F.col("block").alias(at), F.col("id").alias(to)), [c, at])
        for side, (c, at, to) in enumerate(sides)
    )
    return left.join(right, key).select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), "longest", "covered")


def overlap_members(rows: DataFrame, id_col: str = "row_id", **params) -> DataFrame:
    """(row_id, side, class_id, copies, links): every row that takes part, its text's class on its side, the number of its copies there,
    and how many different texts of the other side are alike."""
    pairs, members = cross_split_pairs(rows, id_col, **params)
    pairs = written(pairs)
    ends = [pairs.select(F.lit(s).alias("side"), F.col(f"{n}_class").alias("c")) for s, n in enumerate(("train", "eval"))]
    links = ends[0].unionByName(ends[1]).groupBy("side", "c").agg(F.count(F.lit(1)).alias("links"))
    counted = members.where("id = c").select("side", "c", "copies").join(links, ["side", "c"])
    linked = hot_join(members.drop("copies"), counted, ["side", "c"], "copies")
    lone = members.join(small(written(counted.select("side", "c"))), ["side", "c"], "left_anti").withColumn("links", F.lit(0).cast("long"))
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias("row_id"), F.when(F.col("side") == 0, "train").otherwise("evaluation").alias("side"), F.col("c").alias("class_id"), "copies", "links")


def overlap_report(rows: DataFrame, id_col: str = "row_id", split_col: str = "split", source_col: str = "source", label_col: str = "label", **params) -> DataFrame:
    """Per evaluation split and source: rows, rows that also stand in train, and of those how many with another label there.

    NULL sources are reported as a source of their own; labels differ if they are not equal, NULL being a value.
    """
    pairs, members = cross_split_pairs(rows, id_col, split_col=split_col, **params)
    info = rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"), F.col(label_col).alias("label"))
    labelled = members.join(info.select("id", "label"), "id")
    # labels of a class are gathered as a set, which is as small as the set of labels
    train = labelled.where("side = 0").groupBy("c").agg(F.collect_set(F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("labels"))
    per_class = pairs.join(train.withColumnRenamed("c", "train_class"), "train_class").groupBy("eval_class").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"), F.max("longest").alias("longest"))
    hit = members.where("side = 1").join(per_class.withColumnRenamed("eval_class", "c"), "c").select("id", "labels", "longest")
    evaluated = info.where(F.col("split").isNotNull() & (F.col("split") != params.get("train", "train")))
    other = F.exists("labels", lambda x: x != F.coalesce(F.col("label").cast("string"), F.lit("")))
    return evaluated.join(hit, "id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("longest").alias("overlapping"),
        F.count_if(other).alias("other_label"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest_match"),
    )
