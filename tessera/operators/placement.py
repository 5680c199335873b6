"""Whole blocks placed into folds, largest first, each into the fold that lacks most; one rule for every size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import hash_slot, running_sum
from tessera.persist import cut


def greedy_counts(sizes: Iterable[tuple[int, int]], lack: dict[str, float]) -> list[tuple[int, list[int]]]:
    """How many blocks of each size each fold gets: ``(size, counts in the order of lack)``.

    ``sizes`` is ``(size, number of blocks)``. Blocks go one by one, largest first, to the fold that lacks most then,
    the first of equals. A run of equal blocks takes the highest of the levels that the folds go down by, so a run is
    one step, however long; ``lack`` is left as it is.
    """
    names = list(lack)
    level = [float(lack[s]) for s in names]
    out = []
    for size, many in sorted(sizes, reverse=True):
        got = [0] * len(names)
        left = many
        if size > 0 and left > 4 * len(names):
            # Levels above the line are taken by all folds; the line is the lowest that no more than all blocks reach.
            low, high = min(level) - size * (left + 1), max(level)
            for _ in range(200):
                mid = (low + high) / 2
                if mid in (low, high):
                    break
                if sum(max(0, -(-(v - mid) // size)) for v in level) <= left:
                    high = mid
                else:
                    low = mid
            got = [int(max(0, -(-(v - high) // size))) for v in level]
            level = [v - g * size for v, g in zip(level, got)]
            left -= sum(got)
        for _ in range(left):
            best = max(range(len(names)), key=level.__getitem__)
            level[best] -= size
            got[best] += 1
        out.append((size, got))
    return out


def place(blocks: DataFrame, key: list[str], n: str, lack: dict[str, float], seed: int = 42) -> DataFrame:
    """``(*key, n, fold)`` of each block, ``n`` its rows and ``lack`` what each fold is short of.

    Largest first, equal ones in hash order, each into the fold that lacks most. The driver sees the number of blocks
    of each size only: sizes are different whole numbers that sum to the rows at most, so there are at most the root
    of twice the rows of them. Blocks are ranked within their size by running sums, so a size that most blocks have is
    spread. An empty table gives an empty result.
    """
    blocks = cut(blocks.select(*key, n), "blocks")
    hist = [(r[0], r[1]) for r in blocks.groupBy(n).agg(F.count("*")).collect()]
    names = list(lack)
    cuts = []
    for size, got in greedy_counts(hist, lack):
        at, ends = 0, []
        for g in got:
            at += g
            ends.append(at)
        cuts.append((size, ends))
    kind = blocks.schema[n].dataType.simpleString()
    ends = blocks.sparkSession.createDataFrame(cuts, f"_size {kind}, _ends array<bigint>")
    h = F.xxhash64(*key, F.lit(seed))
    ranked = running_sum(blocks.withColumn("_h", h), [n], {"_rank": F.lit(1).cast("bigint")}, hash_slot(F.col("_h")), ["_h", *key])
    fold: Column = F.coalesce(*[F.when(F.col("_rank") < F.element_at("_ends", i + 1), s) for i, s in enumerate(names)])
    return ranked.join(ends, ranked[n] == ends["_size"]).select(*key, n, fold.alias("fold"))
