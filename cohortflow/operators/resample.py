"""Bootstrap over experimental units: one array of multiplicities per unit serves all replicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.hashing import digest_int, seeded_digest
from cohortflow.functions.numeric import finite
from cohortflow.operators.evaluate import spearman
from cohortflow.operators.scan import shuffled_position
from cohortflow.session import stage

#: Multiplicities (cells x replicates) of one feature that a task holds, two bytes each; wider features take the expanded form.
HELD = 1 << 25


def unit_index(units: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Dense 0-based index of the units of each key under a digest order."""
    digested = units.select(*keys, unit).distinct().withColumn("_digest", F.md5(F.col(unit)))
    placed = shuffled_position(digested, keys, "_digest", [unit])
    return placed.select(*keys, unit, (F.col("position") - 1).alias("unit_index"))


def _picks(index: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """Slot ``s`` of replicate ``r`` picks unit ``hash(seed, r, s) mod n``: as many slots as units.

    Each unit row generates its own slot for every replicate, so the slots are spread like the units.
    """
    if keys:
        sized = index.join(index.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    else:
        sized = index.withColumn("_n", index.agg(F.count("*")).scalar())
    slots = sized.select(
        *keys, F.col("unit_index").alias("_slot"), "_n",
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    )
    pick = digest_int(seeded_digest(seed, F.col("replicate").cast("string"), F.col("_slot").cast("string")), 1, 15) % F.col("_n")
    return slots.select(*keys, pick.alias("unit_index"), "replicate")


def draws(index: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """How often each replicate draws each unit, with replacement: a row for each pair that occurs."""
    return _picks(index, keys, replicates, seed).groupBy(*keys, "unit_index", "replicate").agg(F.count("*").alias("times"))


def multiplicities(units: DataFrame, keys: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """``times`` per unit: how often each replicate draws it, two bytes a replicate. Units never drawn are absent.

    Replicates are collected by unit before the shuffle, so its rows are those of units, not of units and replicates.
    """
    index = stage(unit_index(units, keys, unit), "unit-index")
    lists = _picks(index, keys, replicates, seed).groupBy(*keys, "unit_index").agg(F.collect_list("replicate").alias("picked"))
    listed = index.join(lists, [*keys, "unit_index"]).select(*keys, unit, "picked")
    held = max(1, (1 << 20) // replicates)
    schema = ", ".join([*(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in (*keys, unit)), "times binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, held):
                part = batch.slice(start, held)
                picked = part.column("picked")
                row = np.repeat(np.arange(part.num_rows), picked.value_lengths().to_numpy(zero_copy_only=False))
                counts = np.bincount(row * replicates + picked.flatten().to_numpy(), minlength=part.num_rows * replicates)
                rows = counts.astype(np.uint16).reshape(-1, replicates)  # draws of one unit by one replicate are one on average
                packed = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "times"])

    return listed.mapInArrow(run, schema)


def drawn_units(units: DataFrame, keys: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """Per unit, the array of (replicate, times) that drew it; at most ``replicates`` entries."""
    index = stage(unit_index(units, keys, unit), "unit-index")
    picked = draws(index, keys, replicates, seed)
    packed = picked.groupBy(*keys, "unit_index").agg(F.collect_list(F.struct("replicate", "times")).alias("drawn"))
    return index.join(packed, [*keys, "unit_index"]).select(*keys, unit, "drawn")


def unit_statistics(cells: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Per unit and feature: counts, centred sums and extremes of truth and prediction.

    Centred on the feature mean of the whole data so that replicate variances do not cancel.
    """
    ok = finite(F.col("y_true")) & finite(F.col("y_pred"))
    valid = cells.where(ok)
    centre = valid.groupBy(*keys, "feature").agg(F.avg("y_true").alias("_mt"), F.avg("y_pred").alias("_mp"))
    t, p, gap = F.col("y_true") - F.col("_mt"), F.col("y_pred") - F.col("_mp"), F.col("y_true") - F.col("y_pred")
    return valid.join(centre, [*keys, "feature"]).groupBy(*keys, unit, "feature").agg(
        F.count("*").alias("n"), F.sum(t).alias("st"), F.sum(p).alias("sp"),
        F.sum(t * t).alias("stt"), F.sum(p * p).alias("spp"), F.sum(t * p).alias("stp"),
        F.sum(gap * gap).alias("sse"), F.sum(F.abs(gap)).alias("sae"),
        F.min(t).alias("tlo"), F.max(t).alias("thi"), F.min(p).alias("plo"), F.max(p).alias("phi"),
    )


def replicate_features(stats: DataFrame, drawn: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Weighted statistics and per-feature pcc and r2 of every replicate."""
    sums = ["n", "st", "sp", "stt", "spp", "stp", "sse", "sae"]
    exploded = stats.join(drawn, [*keys, unit]).select(
        *keys, "feature", *sums, "tlo", "thi", "plo", "phi", F.explode("drawn").alias("d")
    )
    per = exploded.groupBy(*keys, F.col("d.replicate").alias("replicate"), "feature").agg(
        *[F.sum(F.col(c) * F.col("d.times")).alias(c) for c in sums],
        F.min("tlo").alias("tlo"), F.max("thi").alias("thi"), F.min("plo").alias("plo"), F.max("phi").alias("phi"),
    )
    n = F.col("n")
    vt = F.col("stt") - F.col("st") * F.col("st") / n
    vp = F.col("spp") - F.col("sp") * F.col("sp") / n
    cov = F.col("stp") - F.col("st") * F.col("sp") / n
    varies_t, varies_p = F.col("thi") > F.col("tlo"), F.col("phi") > F.col("plo")
    both = (n >= 2) & varies_t & varies_p & (vt > 0) & (vp > 0)
    return per.select(
        *keys, "replicate", "feature", "n", "sse", "sae",
        F.when(both, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vt * vp)))).alias("pcc"),
        F.when((n >= 2) & varies_t & (vt > 1e-15), 1 - F.col("sse") / vt).alias("r2"),
        both.alias("_defined"),
    )


def replicate_spearman(cells: DataFrame, drawn: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Spearman needs ranks, so drawn cells carry their multiplicity as a weight."""
    weighted = cells.join(drawn, [*keys, unit]).select(
        *keys, "feature", "y_true", "y_pred", F.explode("drawn").alias("d")
    ).select(*keys, "feature", "y_true", "y_pred", "d.replicate", "d.times")
    return spearman(weighted, [*keys, "replicate", "feature"], weight="times", label="bootstrap-ranks")


def held_features(cells: DataFrame, times: DataFrame, keys: list[str], unit: str, replicates: int) -> DataFrame:
    """Per replicate and feature: n, sse, sae, pcc, spearman and r2, from the cells of a feature and their multiplicities.

    Cells meet the array of their unit once and are shuffled once by feature, whatever the number of replicates. Moments
    are one matrix product; ranks are running totals over the distinct values, all replicates side by side.
    """
    by = [*keys, "feature"]
    rows = cells.join(times, [*keys, unit]).select(*by, F.col("y_true").cast("double").alias("_t"), F.col("y_pred").cast("double").alias("_p"), "times")
    schema = ", ".join([
        *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by),
        "replicate int, n double, sse double, sae double, pcc double, spearman double, r2 double",
    ])

    def run(group: pa.Table) -> pa.Table:
        t, p = group["_t"].to_numpy(), group["_p"].to_numpy()
        drawn = np.frombuffer(b"".join(group["times"].to_pylist()), np.uint16).reshape(len(t), replicates)
        gap, x, y = t - p, t - t.mean(), p - p.mean()
        moments = np.stack([np.ones(len(t)), x, y, x * x, y * y, x * y, gap * gap, np.abs(gap)])
        sides = []
        for values in (t, p):
            order = np.argsort(values, kind="stable")
            new = np.r_[True, np.diff(values[order]) > 0]
            place = np.empty(len(t), np.int64)
            place[order] = np.cumsum(new) - 1
            sides.append((order, np.flatnonzero(new), place))
        found = []
        step = max(1, (1 << 20) // len(t))
        for start in range(0, replicates, step):
            w = drawn[:, start : start + step].astype(float)
            n, st, sp, stt, spp, stp, sse, sae = moments @ w
            ranks, squares, varies = [], [], []
            for order, starts, place in sides:
                same = np.add.reduceat(w[order], starts, axis=0)
                rank = np.cumsum(same, axis=0) - (same - 1) / 2
                seen = same > 0
                varies.append(seen.argmax(axis=0) < len(same) - 1 - seen[::-1].argmax(axis=0))
                squares.append((same * rank * rank).sum(axis=0))
                ranks.append(rank[place])
            with np.errstate(all="ignore"):
                vt, vp, cov = stt - st * st / n, spp - sp * sp / n, stp - st * sp / n
                both = (n >= 2) & varies[0] & varies[1] & (vt > 0) & (vp > 0)
                pcc = np.where(both, np.clip(cov / np.sqrt(vt * vp), -1, 1), np.nan)
                middle = (n + 1) / 2  # average ranks always sum to n (n + 1) / 2
                rt, rp = (s / n - middle * middle for s in squares)
                rho = ((w * ranks[0] * ranks[1]).sum(axis=0) / n - middle * middle) / np.sqrt(rt * rp)
                rho = np.where(both & (rt > 0) & (rp > 0), rho, np.nan)
                r2 = np.where((n >= 2) & varies[0] & (vt > 1e-15), 1 - sse / vt, np.nan)
            found.append(np.stack([np.arange(start, start + len(n)), n, sse, sae, pcc, rho, r2])[:, n > 0])
        table = np.concatenate(found, axis=1)
        first = group.slice(0, 1).select(by).take(pa.array(np.zeros(table.shape[1], np.int64)))
        scores = [pa.array(table[0].astype(np.int32)), *(pa.array(v, from_pandas=True) for v in table[1:])]
        return pa.table([*first.columns, *scores], names=[*by, "replicate", "n", "sse", "sae", "pcc", "spearman", "r2"])

    return rows.groupBy(*by).applyInArrow(run, schema)


def expanded_features(cells: DataFrame, keys: list[str], unit: str, replicates: int, seed: int, features: DataFrame) -> DataFrame:
    """The same scores for ``features`` of any size, with a row for each cell and replicate that draws it."""
    drawn = stage(drawn_units(cells, keys, unit, replicates, seed), "bootstrap-draws")
    cells = cells.join(features, [*keys, "feature"], "left_semi")
    feats = replicate_features(unit_statistics(cells, keys, unit), drawn, keys, unit)
    rho = replicate_spearman(cells, drawn, keys, unit)
    joined = feats.join(rho, [*keys, "replicate", "feature"], "left")
    return joined.withColumn("spearman", F.when(F.col("_defined"), F.col("spearman")))


def bootstrap_metrics(cells: DataFrame, keys: list[str], unit: str, replicates: int, seed: int, held: int = HELD) -> DataFrame:
    """Replicate-level mse, mae and macro pcc, spearman, r2.

    Features of up to ``held`` multiplicities are scored one task each; larger ones in the expanded form, with equal results.
    """
    by = [*keys, "feature"]
    valid = cells.where(finite(F.col("y_true")) & finite(F.col("y_pred")))
    wide = stage(valid.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") * replicates > held).select(*by), "wide-features")
    times = multiplicities(cells, keys, unit, replicates, seed)
    columns = [*by, "replicate", "n", "sse", "sae", "pcc", "spearman", "r2"]
    if wide.isEmpty():
        scores = held_features(valid, times, keys, unit, replicates)
    else:
        narrow = held_features(valid.join(wide, by, "left_anti"), times, keys, unit, replicates)
        rest = expanded_features(cells, keys, unit, replicates, seed, wide).select(*columns)
        scores = narrow.select(*columns).unionByName(rest)
    return scores.groupBy(*keys, "replicate").agg(
        (F.sum("sse") / F.sum("n")).alias("mse"), (F.sum("sae") / F.sum("n")).alias("mae"),
        F.avg("pcc").alias("pcc"), F.avg("spearman").alias("spearman"), F.avg("r2").alias("r2"),
    )


def percentile_interval(replicate_table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """2.5 / 97.5 percentiles per metric; NULL below two finite replicates. One row per replicate
    enters each group, so the group size is the replicate count."""
    long = replicate_table.unpivot(keys, metrics, "metric", "value").where(finite(F.col("value")) | F.col("value").isNull())
    enough = F.col("_k") >= 2
    return (
        long.groupBy(*keys, "metric")
        .agg(
            F.count("value").alias("_k"),
            F.percentile("value", F.lit(0.025)).alias("low"),
            F.percentile("value", F.lit(0.975)).alias("high"),
        )
        .select(*keys, "metric", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), F.col("_k").alias("n_finite"))
    )


def bootstrap_ci(cells: DataFrame, keys: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """Percentile intervals of the unit bootstrap with the number of units behind them."""
    metrics = bootstrap_metrics(cells, keys, unit, replicates, seed)
    ci = percentile_interval(metrics, keys, ["mse", "mae", "pcc", "spearman", "r2"])
    units = cells.groupBy(*keys).agg(F.count_distinct(unit).alias("n_units"))
    return ci.join(units, keys).withColumn("n_replicates", F.lit(replicates).cast("bigint"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
