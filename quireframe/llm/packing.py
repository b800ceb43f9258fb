"""Items of varying size in containers of fixed capacity, by a grouping genetic algorithm on islands.

Items are hashed into blocks of bounded size; every block evolves on several islands. A child takes over well-filled
bins of one parent as they are and loses the other parent's bins that hold the same items, with its emptiest ones; items
displaced are exchanged for smaller ones of the bins that stay where that fills them better, and the rest is placed where
it fits best. Between epochs each island's elite migrates to the next; the best island's solution stands.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.session import cut, parallelism

_SOLVED = "block long, island int, bins_used int, fitness double, id array<long>, piece array<int>, size array<int>, elite array<array<int>>"
#: The share of a bin that must be taken for it not to be opened once more.
WELL = 0.998


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[int], free: list[int]) -> None:
    """Places the items of ``order`` into ``bins`` (bin by item, in place), where least room is left; ``free`` by bin."""
    slots: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(free):
        slots[f].append(b)
        mask |= 1 << f
    for i in order:
        s = sizes[i]
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = slots[r].pop()
            if not slots[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        r -= s
        free[b] = r
        bins[i] = b
        slots[r].append(b)
        mask |= 1 << r


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean of the squared fill: it grows as bins get fuller and fewer."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float(np.square(fill).sum() / max(1, len(fill)))


def exchange(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Items of bins changed for displaced ones that fill the bin better, the smaller ones in turn displaced; ``bins`` in place.

    One item gives way to a larger one or to two, two items give way to one. As every change fills a bin further, it
    ends. What is still displaced is smaller and easier to place.
    """
    waiting = sorted((sizes[i], i) for i in loose)

    def take(size: int) -> int:
        return waiting.pop(bisect.bisect_left(waiting, (size, -1)))[1]

    def largest(most: int) -> int:
        """The size of the largest item that waits and is no larger, or -1."""
        k = bisect.bisect_left(waiting, (most + 1, -1))
        return waiting[k - 1][0] if k else -1

    for inside in bins:
        free = capacity - sum(sizes[i] for i in inside)
        while free > 0 and waiting:
            best, plan = 0, None
            for x in inside:
                room = sizes[x] + free
                one = largest(room)
                if one - sizes[x] > best:
                    best, plan = one - sizes[x], ((x,), (one,))
                if best < free and len(waiting) > 1:
                    # two for one: the largest two that fit together, by two pointers
                    lo, hi = 0, len(waiting) - 1
                    while lo < hi and best < free:
                        both = waiting[lo][0] + waiting[hi][0]
                        if both > room:
                            hi -= 1
                        else:
                            if both - sizes[x] > best:
                                best, plan = both - sizes[x], ((x,), (waiting[lo][0], waiting[hi][0]))
                            lo += 1
                if best == free:
                    break
            if best < free:
                for x, y in itertools.combinations(inside, 2):
                    one = largest(sizes[x] + sizes[y] + free)
                    if one - sizes[x] - sizes[y] > best:
                        best, plan = one - sizes[x] - sizes[y], ((x, y), (one,))
                        if best == free:
                            break
            if plan is None:
                break
            out, come = plan
            fresh = [take(c) for c in come]
            for x in out:
                inside.remove(x)
                bisect.insort(waiting, (sizes[x], x))
            inside += fresh
            free -= best
    return [i for _, i in waiting]


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two solutions: some of ``b``'s well-filled bins injected into ``a``, what they displace placed anew."""
    load = np.bincount(b, weights=sizes)
    well = np.flatnonzero(load >= np.quantile(load, 0.5))
    injected = rng.choice(well, max(1, len(well) // 3), replace=False)
    taken = np.isin(b, injected)
    weak = np.argsort(np.bincount(a, weights=sizes))[: max(2, int(a.max() + 1) // 25)]  # its emptiest bins are broken up too
    hit = np.zeros(int(a.max()) + 1, dtype=bool)
    hit[a[taken]] = True
    hit[weak] = True
    kept = ~hit[a] & ~taken
    bins: dict[int, list[int]] = {}
    for i in np.flatnonzero(taken).tolist():
        bins.setdefault(-1 - int(b[i]), []).append(i)
    for i in np.flatnonzero(kept).tolist():
        bins.setdefault(int(a[i]), []).append(i)
    plain, inside = sizes.tolist(), list(bins.values())
    loose = exchange(inside, np.flatnonzero(~kept & ~taken).tolist(), plain, capacity)
    out = [0] * len(plain)
    for k, items in enumerate(inside):
        for i in items:
            out[i] = k
    free = [capacity - sum(plain[i] for i in items) for items in inside]
    best_fit(sorted(loose, key=lambda i: (-plain[i], i)), plain, capacity, out, free)
    return np.array(out, dtype=np.int64)


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, rng: np.random.Generator, members: int = 10) -> list[np.ndarray]:
    """The population after some generations, best first; a new one begins with best-fit solutions in several orders.

    It ends when a solution has as few bins as any could have. Of equal solutions one stays.
    """
    plain = sizes.tolist()
    bound = -(-int(sizes.sum()) // capacity)
    while len(population) < members and (len(population) == 0 or min(int(p.max()) + 1 for p in population) > bound):
        noise = 1.0 if not population else rng.uniform(0.6, 1.0, len(sizes))
        bins, free = [0] * len(plain), []
        best_fit(np.argsort(-sizes * noise, kind="stable").tolist(), plain, capacity, bins, free)
        population.append(np.array(bins, dtype=np.int64))
    rank = lambda p: (int(p.max()) + 1, -fitness(p, sizes, capacity))
    ranked = sorted(((rank(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    for g in range(generations):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        i, j = np.minimum(rng.integers(0, len(ranked), 2), rng.integers(0, len(ranked), 2))  # the better ones more often
        if i == j:
            j = (j + 1) % len(ranked)
        child = cross(ranked[i][2], ranked[j][2], sizes, capacity, rng)
        at = rank(child)
        if all(at != r for r, _, _ in ranked):
            ranked = sorted([*ranked, (at, members + g, child)], key=lambda x: x[:2])[:members]
    return [p for _, _, p in ranked]


def _solved(small: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, generations: int, elites: int, seed: int) -> DataFrame:
    """The best solution of each block of ``small`` (block, id, piece, size): block, id, piece, size, bin as arrays."""

    def row(key: tuple, items: tuple, s: np.ndarray, ranked: list[np.ndarray]) -> pd.DataFrame:
        best = ranked[0]
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins_used": [int(best.max()) + 1], "fitness": [fitness(best, s, capacity)], "id": [items[0]], "piece": [items[1]], "size": [s.tolist()], "elite": [[p.tolist() for p in ranked[:elites]]]})

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        s = pdf["size"].to_numpy(dtype=np.int64)
        ranked = evolve(s, capacity, [], generations, np.random.default_rng([seed, int(key[0]), int(key[1])]))
        return row(key, (pdf["id"].tolist(), pdf["piece"].tolist()), s, ranked)

    def go_on(epoch: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bins_used", "fitness", "origin"], ascending=[True, False, True], kind="stable")
            first = pdf.iloc[0]
            s = np.array(first["size"], dtype=np.int64)
            met = [np.array(p, dtype=np.int64) for of in pdf["elite"] for p in of]
            return row(key, (first["id"], first["piece"]), s, evolve(s, capacity, met, generations, np.random.default_rng([seed, int(key[0]), int(key[1]), epoch])))

        return run

    # Blocks are few rows but much work: their number, not their bytes, decides how many tasks they are spread over.
    groups = blocks * islands
    tasks = max(min(groups, parallelism(small.sparkSession)), groups // 256)
    solved = small.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(begin, _SOLVED)
    for epoch in range(1, epochs):
        # an island's elite stays and goes to the next one
        met = solved.withColumnRenamed("island", "origin").withColumn("island", F.explode(F.array_distinct(F.array("origin", (F.col("origin") + 1) % islands))))
        solved = met.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(go_on(epoch), _SOLVED)
    best = solved.groupBy("block").agg(F.max_by(F.struct("id", "piece", "size", F.get("elite", F.lit(0)).alias("bin")), F.struct(-F.col("bins_used"), "fitness", -F.col("island"))).alias("s"))
    return best.select("block", F.explode(F.arrays_zip("s.id", "s.piece", "s.size", "s.bin")).alias("x")).select("block", "x.id", "x.piece", "x.size", "x.bin")


def pack(df: DataFrame, item: str, size: str, capacity: int, block: int = 2500, islands: int = 4, epochs: int = 3, generations: int = 40, elites: int = 3, seed: int = 1) -> DataFrame:
    """``item, piece, size, container``: every piece of every item with the container it goes into.

    An item larger than ``capacity`` is split into full pieces and a rest; no other is split. A null size is left
    out, an item of size 0 goes anywhere. Rows count as they stand, so a repeated row takes its room again. An empty
    table gives no rows; other columns are ignored. ``item`` must be an integer column. A block has about ``block``
    items however many there are in all, and the result depends on the items and ``seed`` alone.

    Each block leaves a few bins with room. Those of all blocks that aren't well filled are opened once more and their
    items packed in blocks of their own, so that room is lost once in many blocks instead of in each.
    """
    sizes = df.where(F.col(size).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(size).cast("long").alias("n"))
    pieces = sizes.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0).cast("long")))).alias("k"))
    pieces = cut(pieces.select("id", F.col("k").cast("int").alias("piece"), F.least(F.col("n") - F.col("k") * capacity, F.lit(capacity)).cast("int").alias("size")))
    whole = F.col("size") == capacity

    def solved(rows: DataFrame, tag: int) -> DataFrame:
        blocks = max(1, -(-rows.count() // block))
        return _solved(rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + tag)), F.lit(blocks))), blocks, capacity, islands, epochs, generations, elites, seed + tag)

    first = solved(pieces.where(~whole).select("id", "piece", "size"), 0)
    filled = first.groupBy("block", "bin").agg(F.sum("size").alias("n"), F.collect_list(F.struct("id", "piece", "size")).alias("held"))  # a bin's items
    first = cut(filled.withColumn("well", F.col("n") >= WELL * capacity).select("block", "bin", "well", F.explode("held").alias("x")).select("block", "bin", "well", "x.*"))
    again = solved(first.where(~F.col("well")).select("id", "piece", "size"), 1)
    of = lambda kind, *parts: F.concat_ws("-", F.lit(kind), *parts).alias("container")
    out = first.where("well").select("id", "piece", "size", of("shared", "block", "bin")).unionByName(again.select("id", "piece", "size", of("rest", "block", "bin")))
    return out.unionByName(pieces.where(whole).select("id", "piece", "size", of("own", "id", "piece"))).select(F.col("id").alias(item), "piece", "size", "container")
