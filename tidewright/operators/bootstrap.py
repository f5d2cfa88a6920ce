"""Bootstraps of long samples as Spark jobs: draws are rows or weights, never whole matrices.

Every random number is a hash of the seed, the draw and a place, so no task needs
what another has drawn, a retried task draws the same, and results don't depend on
how rows are dealt.

* Additive statistics: a draw's blocks are rows, each joined with the sums over the
  block that begins there; a draw is one grouped sum.
* Rank statistics: each row gets its multiplicity in each draw from the hashes of
  the places where a block could begin that covers it (their number of blocks is
  Poisson, as usual for weights that are drawn apart).  Rows lie in ranges of the
  score; a range reports its weights and its area for each draw, and areas of
  neighbouring ranges combine as the ranks of a merge do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import PART, ROW, cut, positions

DIGITS = 12  # hexadecimal digits of a hash that make a random number


def hashed(*parts: Column | str) -> Column:
    """A random whole number below ``16 ** DIGITS`` from the md5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def hashed_sql(*parts: str) -> str:
    """The same in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, {DIGITS}) AS BIGINT)"


def drawn(groups: DataFrame, keys: Sequence[str], number: str, draws: int, seed: str) -> DataFrame:
    """For each row of ``groups`` (keys, ``n``) ``number`` random places below ``n`` in each draw: keys, draw, ``i``, place."""
    rows = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.expr(number).cast("int"))))
    return rows.withColumn("place", hashed(seed, *[F.col(k) for k in keys], F.col("draw"), F.col("i")) % F.col("n"))


def drawn_sql(groups: str, keys: Sequence[str], number: str, draws: int, seed: str) -> str:
    """SQL of :func:`drawn` from a query with keys and ``n``."""
    place = hashed_sql(f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys], "CAST(draw AS VARCHAR)", "CAST(i AS VARCHAR)")
    return f"""SELECT *, {place} % n AS place FROM (SELECT *, unnest(range(1, CAST({number} AS BIGINT) + 1)) AS i
      FROM (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM ({groups})))"""


def block_sums(rows: DataFrame, keys: Sequence[str], values: Sequence[str], block: int) -> DataFrame:
    """Sums over the ``block`` rows that begin at each position, past the end those at the start.

    ``rows``: keys, ``position`` from 0, ``n`` rows of the key, values.  With fewer rows than a block the block is the key.
    """
    again = rows.filter(F.col("position") < block - 1).withColumn("position", F.col("position") + F.col("n"))
    both = rows.unionByName(again)
    # Overlapping stretches of positions, so that no task has to hold a whole key.
    stretch = max(4 * block, 1024)
    own = F.expr(f"position div {stretch}")
    both = both.withColumn("stretch", F.explode(F.array_distinct(F.array(own, F.greatest(F.expr(f"(position - {block - 1}) div {stretch}"), F.lit(0).cast("long"))))))
    w = Window.partitionBy(*keys, "stretch").orderBy("position").rowsBetween(0, block - 1)
    summed = both.select(*keys, "position", "n", own.alias("_own"), "stretch", *[F.sum(v).over(w).alias(v) for v in values])
    return summed.filter((F.col("stretch") == F.col("_own")) & (F.col("position") < F.col("n"))).drop("stretch", "_own")


def block_draws(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], block: int, draws: int, seed: str) -> DataFrame:
    """``keys, draw`` and the sums of the values over a circular block bootstrap of each key's rows.

    A draw takes as many whole blocks as cover the key.  Keys shorter than a block
    are drawn in blocks of all their rows.
    """
    keys = list(keys)
    rows = positions(df.select(*keys, *order, *values), keys, order)
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    short = n.filter(F.col("n") < block)
    sums = block_sums(rows.join(n.filter(F.col("n") >= block), keys), keys, values, block).drop("n")
    whole = rows.join(short, keys).groupBy(*keys, "n").agg(*[F.sum(v).alias(v) for v in values])
    whole = whole.withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    starts = drawn(n, keys, f"ceil(n / least(n, {block}))", draws, seed).withColumnRenamed("place", "position").drop("n", "i")
    return starts.join(sums.unionByName(whole), [*keys, "position"]).groupBy(*keys, "draw").agg(*[F.sum(v).alias(v) for v in values])


def cluster_draws(df: DataFrame, keys: Sequence[str], cluster: str, values: Sequence[str], draws: int, seed: str) -> DataFrame:
    """``keys, draw`` and the sums of the values over as many whole clusters, drawn with replacement, as a key has."""
    keys = list(keys)
    sums = positions(df.groupBy(*keys, cluster).agg(*[F.sum(v).alias(v) for v in values]), keys, [cluster])
    picked = drawn(sums.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", draws, seed).withColumnRenamed("place", "position")
    return picked.join(sums, [*keys, "position"]).groupBy(*keys, "draw").agg(*[F.sum(v).alias(v) for v in values])


def intervals(draws: DataFrame, keys: Sequence[str], statistics: Sequence[str], level: float = 0.95) -> DataFrame:
    """``<statistic>_low, <statistic>_high`` by percentiles of the draws, and ``<statistic>_p``, twice the lesser share on either side of 0."""
    tail = (1 - level) / 2
    out = [F.count("*").alias("draws")]
    for s in statistics:
        out += [F.percentile(s, F.lit(tail)).alias(f"{s}_low"), F.percentile(s, F.lit(1 - tail)).alias(f"{s}_high")]
        below, above = (F.avg((c).cast("double")) for c in (F.col(s) <= 0, F.col(s) >= 0))
        out.append(F.least(F.lit(1.0), 2 * F.least(below, above)).alias(f"{s}_p"))
    return draws.groupBy(*keys).agg(*out)


def intervals_sql(draws: str, keys: Sequence[str], statistics: Sequence[str], level: float = 0.95) -> str:
    """SQL of :func:`intervals` over a table of draws."""
    tail = (1 - level) / 2
    out = ["count(*) AS draws"]
    for s in statistics:
        out += [f"quantile_cont({s}, {tail}) AS {s}_low", f"quantile_cont({s}, {1 - tail}) AS {s}_high"]
        out.append(f"least(1.0, 2 * least(avg(CAST({s} <= 0 AS DOUBLE)), avg(CAST({s} >= 0 AS DOUBLE)))) AS {s}_p")
    return f"SELECT {', '.join([*keys, *out])} FROM {draws} GROUP BY {', '.join(keys) or 'ALL'}"


# ---- rank statistics by weights ----------------------------------------------


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    m = np.uint64
    x = (x ^ (x >> m(31))) * m(0x7FB5D329728EA185)
    x = (x ^ (x >> m(27))) * m(0x81DADEF4BC2DD44D)
    return x ^ (x >> m(33))


def multiplicities(position: np.ndarray, n: int, block: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each row stands in each draw: a row of the result for each draw."""
    block = max(1, min(block, n))
    mean, steps, total = 1 / block, [], 0.0
    term = np.exp(-mean)
    for k in range(1, 8):
        total += term
        steps.append(np.uint64(min(total, 1.0) * (1 << 53)))
        term *= mean / k
    salt = scrambled(scrambled(draws.astype(np.uint64) + np.uint64(1)) ^ np.uint64(seed % (1 << 63)))
    out = np.zeros((len(draws), len(position)), np.int32)
    for back in range(block):
        u = scrambled(((position - back) % n).astype(np.uint64)[None, :] ^ salt[:, None]) >> np.uint64(11)
        for s in steps:
            more = u >= s
            if not more.any():
                break
            out += more
    return out


AREAS = "draw int, pos double, neg double, area double, error double, first double, first_pos double, first_neg double, last double, last_pos double, last_neg double"


def _areas(frame: pd.DataFrame, keys: list[str], block: int, draws: int, seed: int, chunk: int = 64) -> pd.DataFrame:
    """A range's weights, area and summed squared errors for each draw."""
    frame = frame.sort_values(ROW, ignore_index=True)
    y, score, position = (frame[c].to_numpy() for c in ("_y", "_score", "_position"))
    _, starts = np.unique(score, return_index=True)  # rows are in order of the score
    out = []
    for at in range(0, draws, chunk):
        every = np.arange(at, min(at + chunk, draws))
        w = multiplicities(position, int(frame["_n"].iloc[0]), block, every, seed).astype(np.float64)
        pos, neg = (np.add.reduceat(w * k, starts, 1) for k in (y, 1 - y))
        area = (pos * (np.cumsum(neg, 1) - neg / 2)).sum(1)
        one = {"draw": every, "pos": pos.sum(1), "neg": neg.sum(1), "area": area, "error": w @ (score - y) ** 2}
        one |= {"first": score[0], "first_pos": pos[:, 0], "first_neg": neg[:, 0], "last": score[-1], "last_pos": pos[:, -1], "last_neg": neg[:, -1]}
        out.append(pd.DataFrame(one))
    out = pd.concat(out, ignore_index=True)
    out.insert(0, PART, frame[PART].iloc[0])
    for k in reversed(keys):
        out.insert(0, k, frame[k].iloc[0])
    return out


def _merged(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The whole area of each draw from those of its ranges in order."""
    frame = frame.sort_values([PART, "draw"])
    parts = [p.reset_index(drop=True) for _, p in frame.groupby(PART)]
    now = parts[0]
    pos, neg, area, error = (now[c].to_numpy(float) for c in ("pos", "neg", "area", "error"))
    last, last_pos, last_neg = now["last"].iloc[0], now["last_pos"].to_numpy(float), now["last_neg"].to_numpy(float)
    for p in parts[1:]:
        area = area + p["area"].to_numpy() + p["pos"].to_numpy() * neg
        if p["first"].iloc[0] == last:  # one tie over two ranges: pairs across count half
            area = area + (last_pos * p["first_neg"].to_numpy() - p["first_pos"].to_numpy() * last_neg) / 2
        goes_on = p["first"].iloc[0] == last == p["last"].iloc[0]
        last_pos = p["last_pos"].to_numpy() + (last_pos if goes_on else 0)
        last_neg = p["last_neg"].to_numpy() + (last_neg if goes_on else 0)
        last = p["last"].iloc[0]
        pos, neg, error = pos + p["pos"].to_numpy(), neg + p["neg"].to_numpy(), error + p["error"].to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        out = pd.DataFrame({"draw": now["draw"], "auc": area / (pos * neg), "brier": error / (pos + neg)})
    for k in reversed(keys):
        out.insert(0, k, frame[k].iloc[0])
    return out


def area_draws(df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, score: str, block: int, draws: int, seed: int, ranges: int | None = None) -> DataFrame:
    """``keys, draw, auc, brier`` of a score against 0/1 labels over block-bootstrap draws.

    Rows have their place by ``order``, which makes the blocks; the same order and
    seed give other scores the same draws.  The area is null where a draw lacks a class.
    """
    keys = list(keys)
    rows = positions(df.select(*keys, *order, F.col(y).cast("double").alias("_y"), F.col(score).cast("double").alias("_score")), keys, order, "_position", ranges)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = cut(rows.join(n, keys) if keys else rows.join(n), keys, ["_score", "_position"], ranges)
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    found = rows.groupBy(*keys, PART).applyInPandas(partial(_areas, keys=keys, block=block, draws=draws, seed=seed), f"{types}{PART} int, {AREAS}")
    merged = found.withColumn("_chunk", F.expr("draw div 256")).groupBy(*keys, "_chunk")
    out = merged.applyInPandas(partial(_merged, keys=keys), f"{types}draw int, auc double, brier double")
    return out.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))
