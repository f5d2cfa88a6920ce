"""Mixing overlapping sources to target weights by a min-cost flow.

Documents that belong to the same set of sources form a pattern.  A flow routes
each pattern's words to the quotas of its sources; the k-th copy of a pattern
costs (2k - 1), so a quota is met with as few repeats as can be.  The flow sees
patterns and sources only, never documents.  Each pattern then takes its whole
copies and, for what is left, its documents in seeded order up to the last one,
of which only the words still needed count.

The order is by md5 of seed and id, so reruns agree on any partitioning.  To
find where it ends, sizes are summed over 4096 ranges of the hash and only the
documents of the range at the end are ordered among themselves.

Null and empty texts have size 0 and are never taken; a null source is a source
of its own, last in order; repeated rows count as documents of their own.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size.

    The excess of those that stop is reshared by weight: in ascending order of
    what a unit of weight may still hold, each stops that can't hold its share.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    out = [0.0] * len(sizes)
    left, weight = float(total), float(sum(weights))
    for at, i in enumerate(order):
        unit = left / weight
        if unit * weights[i] <= most * sizes[i]:
            for j in order[at:]:
                out[j] = unit * weights[j]
            break
        out[i] = float(most * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def min_cost_flow(n: int, arcs: Sequence[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximal flow.

    Repeatedly augments along a cheapest path of the residual graph.
    """
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), room.append(r), cost.append(k)
    while True:
        far, via, queued = [math.inf] * n, [-1] * n, [False] * n
        far[start] = 0
        queue = deque([start])
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                if room[e] and far[x] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if via[end] < 0:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def routed(patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], most: int) -> list[int]:
    """Words to take of each pattern (its sources, its size) to meet the quotas."""
    p, s = len(patterns), len(quotas)
    start, end, arcs = p + s, p + s + 1, []
    for i, (_, size) in enumerate(patterns):
        arcs += [(start, i, size, 2 * k - 1) for k in range(1, most + 1)]
    copies = len(arcs)
    for i, (sources, size) in enumerate(patterns):
        arcs += [(i, p + j, most * size, 0) for j in sources]
    arcs += [(p + j, end, q, 0) for j, q in enumerate(quotas)]
    flow = min_cost_flow(p + s + 2, arcs, start, end)[:copies]
    return [sum(flow[most * i : most * (i + 1)]) for i in range(p)]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    sources: str | F.Column = "source",
    keep: Sequence[str] = (),
    most_patterns: int = 10_000,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, sources`` of every document.

    Columns named in ``keep`` are passed on.

    ``sources`` is a column with a document's source or its array of sources.
    Sources by code point, null last, have the weights in turn and share
    ``total`` times all words; ``source_size`` and ``target`` are those of a
    document's first source.  ``copies`` is ``taken`` in whole copies, rounded.
    The driver solves the flow over a row for each source and each pattern of
    sources, and every task gets its shares; more than ``most_patterns``
    patterns raise an error.
    """
    spark = docs.sparkSession
    of = F.col(sources) if isinstance(sources, str) else sources
    is_array = docs.select(of).schema[0].dataType.typeName() == "array"
    of = F.array_sort(F.array_distinct(of)) if is_array else F.array(of)
    of = F.when(F.coalesce(F.size(of), F.lit(0)) > 0, of).otherwise(F.array(F.lit(None).cast("string")))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), of.cast("array<string>").alias("sources"), *keep)
    rows = rows.withColumn("at", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = stored(rows, "mix")
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of sources; group rare sources or raise most_patterns")
    patterns = sorted(((tuple(r["sources"]), r["size"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [sum(n for p, n in patterns if s in p) for s in names]
    turn = [weights[i % len(weights)] for i in range(len(names))]
    goal = targets(sizes, turn, total * sum(n for _, n in patterns), most)
    take = routed([(tuple(number[s] for s in p), n) for p, n in patterns], [math.floor(g) for g in goal], most)
    plan = []
    for (p, n), words in zip(patterns, take):
        whole, rest = divmod(words, n) if n else (0, 0)
        plan.append(([*p], sizes[number[p[0]]], goal[number[p[0]]], whole, rest))
    schema = "sources array<string>, source_size long, target double, whole long, rest long"
    plan = spark.createDataFrame(plan, schema)

    # At most ``most_patterns`` rows go to all tasks, so no source is gathered for a join.
    inside, decided = rows.join(F.broadcast(plan), "sources").withColumn("base", F.lit(0).cast("long")), []
    # The hash range in which each pattern's seeded order ends, and the range within it: what is left to sort is
    # one in 16 million of a source.
    for digit in (1, 4):
        inside = inside.withColumn("range", F.conv(F.substring("at", digit, 3), 16, 10).cast("int"))
        sums = inside.groupBy("sources", "range", "rest", "base").agg(F.sum("size").alias("words"))
        before = F.col("base") + F.sum("words").over(Window.partitionBy("sources").orderBy("range")) - F.col("words")
        last = sums.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        last = last.select("sources", F.col("range").alias("last"), "before")
        found = inside.join(F.broadcast(last), "sources", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
        part = F.when(F.col("range") < F.col("last"), F.col("size")).otherwise(0)
        decided.append(found.filter(F.col("range") != F.col("last")).withColumn("part", part).drop("base", "range", "last", "before"))
        inside = found.filter(F.col("range") == F.col("last")).drop("base", "range", "last").withColumnRenamed("before", "base")
    order = Window.partitionBy("sources").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    ending = inside.withColumn("part", F.least("size", F.greatest(F.col("rest") - before, F.lit(0)))).drop("base")
    rows = ending.unionByName(decided[0]).unionByName(decided[1])
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", "taken", copies.alias("copies"), "sources", *keep)
