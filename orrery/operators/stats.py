"""Statistics of measurements."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.shared import kept

# The generator's seed, the number of draws, and which of them, in order, bound the interval.
BOOTSTRAP_SEED, DRAWS, LOW, HIGH = 91017, 2000, 49, 1949
SKETCH, ERROR, GRID, MOST = 800, 0.006, 500, 100_000  # size of a sketch, its error of rank, values asked of it, rows of a bracket that are sorted


def phase_rollup(rows: DataFrame, phase: str, elapsed: str, order: list[str] | None = None) -> DataFrame:
    """Total and number for each phase, with its place in ``order`` (by name if there is none)."""
    out = rows.groupBy(F.col(phase).alias("phase")).agg(F.sum(elapsed).alias("elapsed_ms"), F.count("*").alias("invocations"))
    if order is not None:
        out = out.withColumn("place", F.array_position(F.array(*[F.lit(x) for x in order]), F.col("phase")))
    return out


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], most: int = MOST) -> DataFrame:
    """Of each group, the values at some ranks (from 1) of its sorted rows, a column each; ranks: name -> rank, of the group's count.
    Nulls are left out; numbers alone (NaN is the largest), exactly.

    A mergeable quantile sketch of each group brackets every rank between two values; a pass counts what lies below and inside
    the bracket, which proves it (a bracket that misses its rank is widened), and what lies inside is sketched again, until
    brackets hold ``most`` rows or one value. Only these are sorted. A pass shuffles one sketch a group and task, some
    kilobytes, however many rows there are."""
    keys = [f"_by_{k}" for k in range(len(by))]
    plain = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v"), F.col(value).cast("double").alias("_d"))
    if (plain.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= most:  # groups that a task can sort whole
        counts = plain.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
        upto, n = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")), F.sum("_c").over(Window.partitionBy(*keys))
        own = counts.select(*keys, "_v", upto.alias("_to"), n.alias("_n")).groupBy(*keys).agg(*[F.min(F.when((F.col("_to") >= rank(F.col("_n"))) & (rank(F.col("_n")) >= 1), F.col("_v"))).alias(name) for name, rank in ranks.items()])
        return own.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *ranks)
    sketch = lambda: F.kll_sketch_agg_double(F.when(~F.isnan("_d"), F.col("_d")), F.lit(SKETCH)).alias("_s")
    groups = plain.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.isnan("_d")).alias("_nan"), sketch())
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).cast("long").alias("_t")) for name, rank in ranks.items()]))
    state = groups.select(*keys, asked.alias("_q"), (F.col("_n") - F.col("_nan")).alias("_m"), "_n", "_s").select(*keys, "_q.*", "_m", "_n", "_s")
    infinite = F.lit(float("-inf")), F.lit(float("nan"))
    state = kept(state.where((F.col("_t") >= 1) & (F.col("_t") <= F.col("_n"))).withColumns({"_lo": infinite[0], "_hi": infinite[1], "_below": F.lit(0).cast("long"), "_in": F.col("_n"), "_e": F.lit(ERROR)}))

    def same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        right = b.withColumnsRenamed({c: f"{c}_r" for c in on})
        return a.join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on], F.lit(True))).drop(*[f"{c}_r" for c in on])

    held = (F.col("_d") >= F.col("_lo")) & (F.col("_d") <= F.col("_hi"))
    wide = (F.col("_in") > most) & ~F.col("_lo").eqNullSafe(F.col("_hi")) & (F.col("_e") < 1)  # from 1 on nothing is cut off
    first = True
    while not state.where(wide).isEmpty():
        if not first:  # what lies inside is sketched
            inner = same(plain, state.where(wide).select(*keys, "_name", "_lo", "_hi"), keys).where(held)
            again = inner.groupBy(*keys, "_name").agg(sketch(), F.count_if(~F.isnan("_d")).alias("_m"))
            state = same(state.where(wide).drop("_s", "_m"), again, [*keys, "_name"]).unionByName(state.where(~wide))
        share = (F.col("_t") - F.col("_below")) / F.greatest(F.col("_m"), F.lit(1))
        at = lambda x: F.element_at("_grid", F.col(x) + 1)
        grid = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
        tried = state.withColumns({"_f": F.floor(F.least(F.greatest((share - F.col("_e")) * GRID, F.lit(0.0)), F.lit(float(GRID)))).cast("int"), "_g": F.ceil(F.least(F.greatest((share + F.col("_e")) * GRID, F.lit(0.0)), F.lit(float(GRID)))).cast("int"), "_grid": F.when(wide & (F.col("_m") > 0), grid)})
        none = F.col("_t") - F.col("_below") > F.col("_m")  # beyond all numbers stands NaN
        lo = F.when(~wide | (F.col("_f") <= 0), F.col("_lo")).when(none, F.lit(float("nan"))).otherwise(at("_f"))
        hi = F.when(~wide | none | (F.col("_g") >= GRID), F.col("_hi")).otherwise(at("_g"))
        tried = kept(tried.withColumns({"_l": lo, "_h": hi}).drop("_f", "_g", "_grid"))
        inside = (F.col("_d") >= F.col("_l")) & (F.col("_d") <= F.col("_h"))
        counted = same(plain, tried.where(wide).select(*keys, "_name", "_l", "_h"), keys).groupBy(*keys, "_name").agg(F.count_if(F.col("_d") < F.col("_l")).alias("_b"), F.count_if(inside).alias("_c"))
        both = same(tried.where(wide), counted, [*keys, "_name"])
        good = (F.col("_b") < F.col("_t")) & (F.col("_t") <= F.col("_b") + F.col("_c")) & ((F.col("_c") < F.col("_in")) | F.col("_l").eqNullSafe(F.col("_h")))
        moved = both.withColumns({"_ok": good}).withColumns({"_lo": F.when(F.col("_ok"), F.col("_l")).otherwise(F.col("_lo")), "_hi": F.when(F.col("_ok"), F.col("_h")).otherwise(F.col("_hi")), "_below": F.when(F.col("_ok"), F.col("_b")).otherwise(F.col("_below")), "_in": F.when(F.col("_ok"), F.col("_c")).otherwise(F.col("_in")), "_e": F.when(F.col("_ok"), F.col("_e")).otherwise(F.col("_e") * 2)})
        state = kept(moved.drop("_b", "_c", "_ok", "_l", "_h").unionByName(tried.where(~wide).drop("_l", "_h")))
        first = False
    inner = same(plain, state.select(*keys, "_name", "_lo", "_hi", "_below", "_t"), keys).where(held)
    counts = inner.groupBy(*keys, "_name", "_v", "_below", "_t").agg(F.count("*").alias("_c"))  # ``most`` values a group and rank
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v"))
    found = counts.withColumn("_to", upto).where(F.col("_to") >= F.col("_t")).groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *ranks)


def percentiles(rows: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles of each group: the least value that so many per cent of the rows don't exceed."""
    return at_ranks(rows, by, value, {f"p{p}": lambda n, p=p: F.greatest(F.ceil(n * p / 100), F.lit(1)) for p in percents})


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """sorted[n // 2] of each group."""
    return at_ranks(rows, [by], value, {"upper_median": lambda n: F.floor(n / 2) + 1})


def median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value of each group, or the mean of the two in the middle."""
    both = at_ranks(rows, by, value, {"_low": lambda n: F.floor((n - 1) / 2) + 1, "_high": lambda n: F.floor(n / 2) + 1})
    return both.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def median_change(rows: DataFrame, side: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """1 - median(candidate) / median(reference); side is true for the candidate."""
    by = by or []
    both = median(rows.withColumn("_side", side), [*by, "_side"], value, "_m")
    a, b = F.max(F.when(~F.col("_side"), F.col("_m"))), F.max(F.when(F.col("_side"), F.col("_m")))
    return both.groupBy(*by).agg((F.lit(1.0) - b / a).alias("change"))


def draws(n: int) -> np.ndarray:
    """DRAWS rows of n places each, drawn with replacement by Python's generator so that they repeat anywhere."""
    rng = random.Random(BOOTSTRAP_SEED)
    return np.array([rng.choices(range(n), k=n) for _ in range(DRAWS)], np.int64)


def change_interval(reference: list[float], candidate: list[float]) -> tuple[float, float, float]:
    """Relative change of medians, and the bounds of its paired bootstrap interval."""
    a, b = np.asarray(reference, float), np.asarray(candidate, float)
    places = draws(len(a))
    drawn = np.sort(1 - np.median(b[places], axis=1) / np.median(a[places], axis=1))
    return float(1 - np.median(b) / np.median(a)), float(drawn[LOW]), float(drawn[HIGH])


@lru_cache(maxsize=16)
def _places(n: int, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last`` of draws(n), by the same stream."""
    rng, size = random.Random(BOOTSTRAP_SEED), range(n)
    return np.array([own for k in range(last) if (own := rng.choices(size, k=n)) and k >= first], np.int64)


@lru_cache(maxsize=16)
def _times(n: int, first: int, last: int) -> np.ndarray:
    """How often each of n places (a row) is drawn in each of the draws ``first`` to ``last`` (a column)."""
    out = np.zeros((n, last - first), np.min_scalar_type(n))
    np.add.at(out, (_places(n, first, last).T, np.arange(last - first)), 1)
    return out


def _drawn_medians(values: np.ndarray, first: int, last: int) -> np.ndarray:
    """np.median(values[draws], axis=1): values are sorted once, and the counts of what each draw took are added up in that order."""
    n, times = len(values), _times(len(values), first, last)
    if np.isnan(values).any():
        return np.median(values[_places(n, first, last)], axis=1)
    order = np.argsort(values)
    upto, own = np.cumsum(times[order], axis=0, dtype=times.dtype), values[order]
    low, high = (own[(upto <= k).sum(0, dtype=times.dtype)] for k in ((n - 1) // 2, n // 2))
    return low if n % 2 else (low + high) / 2


def change_draws(a: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
    """Relative changes of medians of the draws ``first`` to ``last`` of paired samples, the same whichever task asks for them."""
    return 1 - _drawn_medians(b, first, last) / _drawn_medians(a, first, last)


def bootstrap(samples: DataFrame, block: int | None = None) -> DataFrame:
    """scenario, change, low and high of each scenario's paired samples (scenario, side, n, seconds). A row is a scenario's pairs, a few
    dozens. Where scenarios are fewer than tasks, their draws are dealt in blocks (of ``block``; 250 by default), so that one scenario
    keeps several tasks busy; many take all draws in one task each, and no draw is shuffled. A sample without its other side is an error."""
    own = samples.groupBy("scenario", "n").agg(*[F.max(F.when(F.col("side") == s, F.col("seconds"))).alias(s) for s in ("reference", "candidate")])
    wrong = F.raise_error(F.concat("scenario", F.lit(": samples don't come in pairs"))).cast("double")
    own = own.withColumns({s: F.coalesce(s, wrong) for s in ("reference", "candidate")})
    pairs = own.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("n", "reference", "candidate"))).alias("_p"))
    pairs = kept(pairs.select("scenario", F.col("_p.reference").alias("a"), F.col("_p.candidate").alias("b")))
    n, tasks = pairs.count(), 2 * samples.sparkSession.sparkContext.defaultParallelism
    block = block or (DRAWS if n >= tasks else 250)
    parts = max(tasks, min(4096, n // 4096))
    blocks = pairs.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1), F.lit(block)))).repartition(parts, "scenario", "first")

    def draw(frames):
        for frame in frames:
            out = []
            for a, b, first in zip(frame["a"], frame["b"], frame["first"]):
                a, b = np.asarray(a, float), np.asarray(b, float)
                drawn = np.sort(change_draws(a, b, first, min(first + block, DRAWS)))
                out.append((float(1 - np.median(b) / np.median(a)), drawn if block < DRAWS else drawn[[LOW, HIGH]]))
            yield pd.DataFrame({"scenario": frame["scenario"], "change": [x for x, _ in out], "drawn": [x for _, x in out]})

    drawn = blocks.mapInPandas(draw, "scenario string, change double, drawn array<double>")
    if block >= DRAWS:
        return drawn.select("scenario", "change", F.element_at("drawn", 1).alias("low"), F.element_at("drawn", 2).alias("high"))
    drawn = drawn.groupBy("scenario").agg(F.first("change").alias("change"), F.array_sort(F.flatten(F.collect_list("drawn"))).alias("_d"))
    return drawn.select("scenario", "change", F.element_at("_d", LOW + 1).alias("low"), F.element_at("_d", HIGH + 1).alias("high"))  # DRAWS numbers each


def medians(samples: DataFrame) -> DataFrame:
    """Median seconds and resident bytes of each scenario and side."""
    return _medians(kept(samples.select("scenario", "side", "seconds", "rss_bytes")))


def _medians(samples: DataFrame) -> DataFrame:
    both = ["scenario", "side"]
    return median(samples, both, "seconds", "seconds").join(median(samples, both, "rss_bytes", "rss_bytes"), both)


def resident_bytes(value: Column, system: Column) -> Column:
    """Peak resident memory as the system's tool told it, in bytes: macOS counts bytes, others kibibytes."""
    return F.when(F.lower(system) == "darwin", value).otherwise(value * 1024).cast("long")


def sample_order(pairs: DataFrame) -> DataFrame:
    """n, turn (0 or 1) and side of each measurement of pairs (n): of every two pairs one begins with the reference, the next with the
    candidate, so a drift of the machine falls on both alike."""
    turn = F.explode(F.array(F.lit(0), F.lit(1)))
    side = F.when((F.col("turn") + F.col("n") % 2) % 2 == 0, "reference").otherwise("candidate")
    return pairs.select("n", turn.alias("turn")).withColumn("side", side)


def report(samples: DataFrame) -> DataFrame:
    """One row a scenario: medians of both sides in milliseconds and MiB, and the change with its interval in per cent."""
    samples = kept(samples.select("scenario", "side", "n", "seconds", "rss_bytes"))  # read several times, made once
    mid = _medians(samples)
    of = lambda side, c, unit: F.max(F.when(F.col("side") == side, F.col(c) * unit))
    sides = [of(s, c, unit).alias(f"{s}_{name}") for c, unit, name in (("seconds", 1000.0, "ms"), ("rss_bytes", 1 / (1 << 20), "mib")) for s in ("reference", "candidate")]
    change = bootstrap(samples.select("scenario", "side", "n", "seconds"))
    return mid.groupBy("scenario").agg(*sides).join(change.select("scenario", *[(F.col(c) * 100).alias(f"{c}_percent") for c in ("change", "low", "high")]), "scenario")


def report_lines(rows: list) -> list[str]:
    """report() as a table of text."""
    heads = ["scenario", "reference_ms", "candidate_ms", "change_percent", "low_percent", "high_percent", "reference_mib", "candidate_mib"]
    cells = [heads, *[[r["scenario"], *[f"{r[h]:.1f}" for h in heads[1:]]] for r in rows]]
    widths = [max(len(c[k]) for c in cells) for k in range(len(heads))]
    return ["  ".join(x.ljust(w) if k == 0 else x.rjust(w) for k, (x, w) in enumerate(zip(c, widths))) for c in cells]
