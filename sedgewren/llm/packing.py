"""Filling containers of fixed capacity (problem 8) by non-negative least squares over a histogram of lengths.

Items longer than the capacity are cut into pieces of the full capacity and a rest. All other lengths are counted by an
exact histogram, whose size is bounded by the capacity. Strategies are shallow combinations of lengths that fill a window of
lengths exactly (up to ``depth`` items); how often each is repeated is the non-negative least-squares solution of the counts,
rounded down. Lengths that are left over are packed greedily, largest first into the fullest container that takes them. The plan
is a list of (count, lengths) of bounded size; items get their containers by their number within their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.session import written


def strategies(lengths: np.ndarray, capacity: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` of the given lengths, ascending, that come nearest below the capacity.

    For each length, and each pair of lengths with a step of the window, the best third is taken; so there are at most a few
    per length and the problem stays small.
    """
    have = np.sort(lengths)
    found = {(int(x),) for x in have}

    def fitting(rest: int) -> int | None:
        at = int(np.searchsorted(have, rest, side="right")) - 1
        return int(have[at]) if at >= 0 else None

    window = have[np.unique(np.linspace(0, len(have) - 1, min(len(have), 48)).astype(int))] if len(have) else have
    for x in have.tolist():
        y = fitting(capacity - x)
        if y is not None and depth >= 2:
            found.add(tuple(sorted((x, y))))
        if depth >= 3:
            for y in window.tolist():
                z = fitting(capacity - x - y) if x + y < capacity else None
                if z is not None and capacity - x - y - z <= max(1, capacity // 256):
                    found.add(tuple(sorted((x, y, z))))
    return sorted(found, key=lambda s: (capacity - sum(s), len(s), s))


def solve_nnls(columns: list[np.ndarray], rows: list[np.ndarray], counts: np.ndarray, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of A x = counts with sparse 0/1/2/3 columns, by accelerated projected gradient steps.

    ``weight`` is the weight of each row; a strategy's unused space is charged through its ridge in ``columns``.
    """
    which, row = np.concatenate(columns), np.concatenate(rows)
    n, m = int(which.max()) + 1, len(counts)
    w2 = weight**2
    # a bound of the largest eigenvalue of A'WA by its largest absolute row sum
    per_row = np.bincount(row, minlength=m)
    bound = float(np.bincount(which, weights=(w2 * per_row)[row], minlength=n).max()) + 1e-9
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        r = np.bincount(row, weights=y[which], minlength=m) - counts
        g = np.bincount(which, weights=(w2 * r)[row], minlength=n)
        nx = np.maximum(0, y - g / bound)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def packing_plan(counts: dict[int, int], capacity: int, depth: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that use every counted length exactly as often as it occurs, each within the capacity."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    plan: list[tuple[int, tuple[int, ...]]] = []
    if not left:
        return plan
    lengths = np.array(sorted(left))
    place = {int(x): i for i, x in enumerate(lengths)}
    good = [s for s in strategies(lengths, capacity, depth) if len(s) > 1 and sum(s) >= 0.9 * capacity]
    if good:
        rows = [np.array([place[x] for x in s]) for s in good]
        columns = [np.full(len(s), i) for i, s in enumerate(good)]
        weight = np.sqrt(lengths / capacity)  # long items are the hard ones to place later
        x = solve_nnls(columns, rows, np.array([left[int(v)] for v in lengths], float), weight)
        for i in np.argsort([capacity - sum(s) for s in good], kind="stable"):
            s = good[i]
            need = {v: s.count(v) for v in set(s)}
            n = min(int(np.floor(x[i])), *(left[v] // k for v, k in need.items()))
            if n > 0:
                plan.append((n, s))
                for v, k in need.items():
                    left[v] -= k * n
    plan += _greedy(left, capacity)
    return plan


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit of what remains, by counts: a container starts with the longest length and takes the longest that fits."""
    plan: list[tuple[int, tuple[int, ...]]] = []
    have = np.array(sorted(k for k, v in left.items() if v > 0))
    count = np.array([left[int(k)] for k in have], np.int64)
    while len(have):
        used, take, rest = np.zeros(len(have), np.int64), [], capacity
        while True:
            at = int(np.searchsorted(have, rest, side="right")) - 1
            while at >= 0 and used[at] >= count[at]:
                at -= 1
            if at < 0:
                break
            k = int(min(count[at] - used[at], rest // have[at])) if have[at] else int(count[at] - used[at])
            used[at] += k
            take += [int(have[at])] * k
            rest -= k * int(have[at])
        mine = used > 0
        n = int((count[mine] // used[mine]).min())
        plan.append((n, tuple(take)))
        count -= n * used
        keep = count > 0
        have, count = have[keep], count[keep]
    return plan


def packed(sized: DataFrame, capacity: int, kind: str, depth: int = 3) -> DataFrame:
    """(container_kind, capacity, container, key, piece, pieces, tokens) of every item or piece of an item.

    ``sized`` has (key, tokens). An item within the capacity is one piece; a longer one is cut into full pieces and a rest.
    NULL tokens count as 0; items of 0 tokens get their own container -1, which takes no space. Containers are numbered from 0.
    """
    spark = sized.sparkSession
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint")
    cut = sized.select("key", tokens.alias("all"), F.greatest(F.lit(1), F.ceil(tokens / capacity)).cast("int").alias("pieces"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(1), "pieces")))
    cut = cut.withColumn("tokens", F.least(F.lit(capacity).cast("bigint"), F.col("all") - (F.col("piece") - 1) * capacity)).select("key", "piece", "pieces", "tokens")
    # the histogram has at most ``capacity`` rows
    counts = {r["tokens"]: r["count"] for r in cut.where("tokens > 0").groupBy("tokens").count().collect()}
    plan = packing_plan(counts, capacity, depth)
    slots, first, number = [], {}, 0
    for n, s in plan:
        for v in sorted(set(s)):
            k = s.count(v)
            start = first.get(v, 0)
            slots.append((v, start, start + n * k, k, number))
            first[v] = start + n * k
        number += n
    # slots of a length are sorted: an item's place is found by binary search in its length's arrays
    per: dict[int, list] = {}
    for v, lo, hi, k, c in slots:
        per.setdefault(v, []).append((lo, k, c))
    rows = [(v, [x[0] for x in a], [x[1] for x in a], [x[2] for x in a]) for v, a in per.items()]
    table = spark.createDataFrame(pa.table({"tokens": pa.array([r[0] for r in rows], pa.int64()), "lo": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "each": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "at": pa.array([r[3] for r in rows], pa.list_(pa.int64()))}))
    numbered = _numbered(cut.where("tokens > 0"), max(64, -(-max(counts.values(), default=0) // 500_000))).join(F.broadcast(table), "tokens")
    steps = [1 << k for k in reversed(range(max((len(x) for _, x, _, _ in rows), default=1).bit_length()))]
    further = lambda at, p: F.when((at + p < F.size("lo")) & (F.get("lo", at + p) <= F.col("n")), at + p).otherwise(at)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
    placed = numbered.withColumn("f", found).withColumn("container", F.expr("at[f] + (n - lo[f]) div each[f]"))
    whole = placed.select("container", "key", "piece", "pieces", "tokens").unionByName(cut.where("tokens <= 0").select(F.lit(-1).cast("bigint").alias("container"), "key", "piece", "pieces", "tokens"))
    return whole.select(F.lit(kind).alias("container_kind"), F.lit(capacity).alias("capacity"), "container", "key", "piece", "pieces", "tokens")


def _numbered(pieces: DataFrame, spread: int) -> DataFrame:
    """Number the pieces of each length from 0 without bringing one length into one task.

    Pieces of a length are spread over ``spread`` parts by key; parts are numbered each, after what earlier parts hold.
    """
    p = pieces.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(spread)).cast("int"))
    sizes = p.groupBy("tokens", "part").count()
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("tokens", "part", "offset")
    within = F.row_number().over(Window.partitionBy("tokens", "part").orderBy("key", "piece")) - 1
    return p.withColumn("w", within).join(offset, ["tokens", "part"]).withColumn("n", F.col("offset") + F.col("w")).drop("part", "w", "offset")


def packing_report(found: DataFrame) -> DataFrame:
    """Containers used and share of their space filled, by kind; containers -1 hold nothing and don't count."""
    real = found.where("container >= 0")
    return real.groupBy("container_kind", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    )


def packed_all(sized: DataFrame, sizes: DataFrame, depth: int = 3) -> DataFrame:
    """``packed`` for every row of ``sizes`` (container_kind, capacity), a small table."""
    sized, out = written(sized), None
    for r in sorted(sizes.collect(), key=lambda r: r["capacity"]):
        part = packed(sized, int(r["capacity"]), r["container_kind"], depth)
        out = part if out is None else out.unionByName(part)
    return out
