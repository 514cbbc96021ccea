"""The bin summary computed a second way, and a comparison that misses nothing on either side.

An audit is worth only what its second path does not share with the first. Here values of
a bin come sorted past a small running state (``sorted_statistics``): the group's size is
known from a header row that sorts first, so every order statistic is picked when its rank
goes by, moments are merged piece by piece, and a bin of any length needs the memory of one
batch. Bins are found by searching the edges, slopes come from sums of products. Nothing is
taken from ``orderstats``, ``bins`` or ``bincounts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerances of an audit by the class of a metric.
TOLERANCES = {"count": 0.0, "fraction": 1e-6, "numeric": 1e-6, "percent": 1e-4}
RANKS = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}
STATISTICS = ["n", "mean", "sd", "min", "max", *RANKS, "iqr", "trimmed_mean_20pct", "cv", "log_mean", "log_sd"]


class _Moments:
    """Count, mean and squared deviations of values that come in pieces."""

    def __init__(self):
        self.n, self.mean, self.squares = 0, 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        if len(x):
            n, mean = len(x), float(x.mean())
            gap, total = mean - self.mean, self.n + n
            self.squares += float(((x - mean) ** 2).sum()) + gap * gap * self.n * n / total
            self.mean += gap * n / total
            self.n = total

    def sd(self) -> float | None:
        return None if not self.n else 0.0 if self.n == 1 else (self.squares / (self.n - 1)) ** 0.5


class _Group:
    """The state of one group while its sorted values pass."""

    def __init__(self, size: int, logs: bool):
        self.size, self.logs, self.seen = size, logs, 0
        self.all, self.kept, self.logged = _Moments(), _Moments(), _Moments()
        cut = int(size * 0.1) if size >= 4 else 0
        self.inner = (cut, size - cut)
        self.at = {i: None for p in RANKS.values() for i in self._ends(p)} | {0: None, size - 1: None}

    def _ends(self, p: float) -> tuple[int, int]:
        low = int(np.floor((self.size - 1) * p))
        return low, min(low + 1, self.size - 1)

    def add(self, x: np.ndarray) -> None:
        a, b = self.seen, self.seen + len(x)
        for i in self.at:
            if a <= i < b:
                self.at[i] = float(x[i - a])
        self.all.add(x)
        self.kept.add(x[max(self.inner[0] - a, 0):max(self.inner[1] - a, 0)])
        if self.logs:
            self.logged.add(np.log(x[x > 0]))
        self.seen = b

    def result(self) -> list[float | None]:
        ranks = {}
        for name, p in RANKS.items():
            low, high = self._ends(p)
            ranks[name] = self.at[low] + (self.at[high] - self.at[low]) * ((self.size - 1) * p - low)
        mean, sd = self.all.mean, self.all.sd()
        return [float(self.size), mean, sd, self.at[0], self.at[self.size - 1], *ranks.values(), ranks["p75"] - ranks["p25"], self.kept.mean,
                sd / mean if mean > 1e-10 else None, float(np.exp(self.logged.mean)) if self.logged.n else None, self.logged.sd()]


def sorted_statistics(values: DataFrame, groups: list[str], log_prefixes: tuple[str, ...] = ("fft_",), feature: str = "feature", value: str = "value") -> DataFrame:
    """(groups, STATISTICS) of present values; ``feature`` is one of the groups and decides about log statistics."""
    known = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    headers = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")).withColumn("_v", F.lit(None).cast("double"))
    both = known.withColumn("_size", F.lit(None).cast("long")).unionByName(headers)
    dealt = both.repartition(*groups).sortWithinPartitions(*groups, F.col("_v").asc_nulls_first())
    n, place = len(groups), groups.index(feature)
    schema = T.StructType([*[known.schema[g] for g in groups], *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, done = None, None, []
        for batch in batches:
            x, sizes = batch["_v"].to_numpy(zero_copy_only=False), batch["_size"]
            heads = np.flatnonzero(np.asarray(sizes.is_valid())).tolist()
            if (first := heads[0] if heads else len(x)) > 0:
                group.add(x[:first])
            for a, b in zip(heads, [*heads[1:], len(x)]):
                if group is not None:
                    done.append([*key, *group.result()])
                key = [batch[i][a].as_py() for i in range(n)]
                group = _Group(sizes[a].as_py(), str(key[place]).startswith(log_prefixes))
                group.add(x[a + 1:b])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)
                done = []
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*key, *group.result()], target)], schema=target)

    return dealt.select(*groups, "_v", "_size").mapInArrow(run, schema)


def _bin_number(hours: Column, edges: list[float]) -> Column:
    """Index of the half-open bin by counting the edges passed; null outside."""
    passed = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= hours))
    return F.when((passed >= 1) & (passed < len(edges)), passed - 1)


def recomputed_bins(rows: DataFrame, keys: list[str], variables: list[str], edges: list[float], usable: str = "usable", masks: dict[str, str] | None = None,
                    support: str = "support_hours", hours: str = "hours", min_hours: float = 1.0) -> DataFrame:
    """(keys, bin_id, feature, metric, value): statistics, counts and hours of every bin with epochs, and slopes (bin_id -1)."""
    masks = masks or {}
    placed = rows.withColumn("bin_id", _bin_number(F.col(hours), edges)).where("bin_id IS NOT NULL")
    fields = placed.groupBy(*keys, "bin_id").agg(
        F.sum(F.lit(1.0)).alias("n_total_epochs"), F.sum(F.col(usable).cast("double")).alias("n_usable_epochs"),
        F.sum(support).alias("observed_hours"), F.sum(F.col(support) * F.col(usable).cast("double")).alias("clean_hours"))
    width = F.get(F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])]), F.col("bin_id"))
    fields = fields.withColumns({"clean_of_expected": F.col("clean_hours") / width, "clean_of_observed": F.coalesce(F.try_divide("clean_hours", "observed_hours"), F.lit(0.0))})
    each = F.array(*[F.struct(F.lit(v).alias("feature"), F.when(F.col(masks[v]) if v in masks else F.lit(True), F.col(v).cast("double")).alias("value")) for v in variables])
    stats = sorted_statistics(placed.where(F.col(usable)).select(*keys, "bin_id", F.inline(each)), [*keys, "bin_id", "feature"])
    enough = fields.where(F.col("clean_hours") >= min_hours).select(*keys, "bin_id")
    stats = stats.join(enough, [*keys, "bin_id"])
    middle = F.get(F.array(*[F.lit((a + b) / 2.0) for a, b in zip(edges, edges[1:])]), F.col("bin_id"))
    x, y = F.col("_x"), F.col("median")
    sums = stats.withColumn("_x", middle).where("median IS NOT NULL").groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"), F.sum(x * y).alias("_sxy"), F.sum(x * x).alias("_sxx"))
    slope = (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / (F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
    long = lambda df, names: F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    slopes = sums.where("_n >= 2").select(*keys, F.lit(-1).alias("bin_id"), "feature", F.lit("slope").alias("metric"), slope.alias("value"))
    names = ["n_total_epochs", "n_usable_epochs", "observed_hours", "clean_hours", "clean_of_expected", "clean_of_observed"]
    out = stats.select(*keys, "bin_id", "feature", long(stats, STATISTICS)).unionByName(fields.select(*keys, "bin_id", F.lit("").alias("feature"), long(fields, names))).unionByName(slopes)
    return out.where("value IS NOT NULL")


def tolerance_of(metric: Column, classes: dict[str, str]) -> Column:
    out = F.lit(TOLERANCES["numeric"])
    for name, cls in classes.items():
        out = F.when(metric == name, F.lit(TOLERANCES[cls])).otherwise(out)
    return out


def audit(exported: DataFrame, recomputed: DataFrame, ids: list[str], classes: dict[str, str] | None = None) -> DataFrame:
    """(ids, metric, exported, recomputed, status): match, mismatch, only_exported or only_recomputed.

    Both sides hold (ids, metric, value) with values present; ids are never null.
    """
    left = exported.select(*ids, "metric", F.col("value").alias("exported"))
    right = recomputed.select(*ids, "metric", F.col("value").alias("recomputed"))
    both = left.join(right, [*ids, "metric"], "full_outer")
    a, b = F.col("exported"), F.col("recomputed")
    near = F.abs(a - b) <= tolerance_of(F.col("metric"), classes or {}) * F.greatest(F.lit(1.0), F.abs(b))
    return both.withColumn("status", F.when(b.isNull(), "only_exported").when(a.isNull(), "only_recomputed").when(near, "match").otherwise("mismatch"))
