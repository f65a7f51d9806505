"""Outcome labels of several horizons and their transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.windows import gauss_rank, ordinal, pct_rank, zscore


def transform(value: Column | str, by: list[str], how: str) -> Column:
    """raw, zscore, rank or gaussrank of a label within its cohort."""
    made = {"raw": lambda: F.col(value) if isinstance(value, str) else value, "zscore": lambda: zscore(value, by, guard=True), "rank": lambda: pct_rank(value, by), "gaussrank": lambda: gauss_rank(value, by)}
    if how not in made:
        raise ValueError(f"no label transform {how!r}")
    return made[how]()


def discounted(df: DataFrame, by: list[str], period: str, value: str, rate: float = 0.85) -> DataFrame:
    """(by, total): later periods count for less, by their order."""
    n = ordinal(by, F.col(period)) - 1
    return df.withColumn("_d", F.pow(F.lit(rate), n) * F.col(value)).groupBy(*by).agg(F.sum("_d").alias("total"))


def stack_horizons(df: DataFrame, cohort: str, through: int, most: int = 5) -> DataFrame:
    """Each row once for every horizon that its cohort has completed, with the horizon in ``_h``."""
    done = F.least(F.lit(most), F.lit(through) - F.col(cohort))
    return df.withColumn("_h", F.explode(F.when(done >= 1, F.sequence(F.lit(1), done)).otherwise(F.array().cast("array<int>"))))


def horizon(policy: str | None, years_known: int, most: int = 5) -> int | str:
    """Training horizon that a policy picks for a cohort of which so many years are known; "multi" stands for every completed one."""
    known = max(1, min(most, years_known))
    if policy in (None, "full"):
        return most
    if policy == "multi":
        return "multi"
    if policy == "match":
        return known
    if policy == "short3":  # one or two years are noise: three are learnt from instead
        return 3 if known <= 2 else most
    if policy == "match3":
        return max(3, known)
    if policy.isdigit():
        return max(1, min(most, int(policy)))
    raise ValueError(f"no horizon policy {policy!r}")


def horizon_column(policy: str, years_known: Column, most: int = 5) -> Column:
    """The same for a column of known years; 0 stands for "multi"."""
    known = F.greatest(F.lit(1), F.least(F.lit(most), years_known))
    cases = [(k, horizon(policy, k, most)) for k in range(1, most + 1)]
    out = F.when(F.lit(False), 0)
    for k, h in cases:
        out = out.when(known == k, 0 if h == "multi" else h)
    return out


def weighted_periods(values: Column, weights: list[float], best: int | None = None) -> Column:
    """Weighted sum over an array of period values, in order or over the best few."""
    v = F.filter(values, lambda x: x.isNotNull())
    v = v if best is None else F.slice(F.sort_array(v, asc=False), 1, best)
    return F.aggregate(F.zip_with(v, F.array(*map(F.lit, weights)), lambda x, w: F.coalesce(x * w, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def tiers(value: Column | str, cuts: list[tuple[float, str]], rest: str) -> Column:
    """First tier whose least value is reached; missing values have none."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.when(v.isNull(), None)
    for least, name in cuts:
        out = out.when(v >= least, name)
    return out.otherwise(rest)


def known_by_step(df: DataFrame, entity: str, period: str, value: str, done: Column, steps: list[int]) -> DataFrame:
    """(step, outcomes, total, new): what each step of an expanding context knows: labels of entities whose horizon is done by then.

    done: the period in which an entity's label is complete. Entities are counted once, at that period, and
    steps add them up; nothing of a later period enters.
    """
    own = df.groupBy(entity, done.alias("_done")).agg(F.sum(F.when(F.col(period) <= done, F.col(value))).alias("_v"))
    each = own.groupBy("_done").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    known = each.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).filter("_done <= step")
    return known.groupBy("step").agg(F.sum("_n").alias("outcomes"), F.sum("_s").alias("total"), F.sum(F.when(F.col("_done") == F.col("step"), F.col("_n")).otherwise(0)).alias("new"))


def fold_target(value: Column | str, by: list[str], how: str) -> Column:
    """Target of a fold: missing counts as none and values are held to 0..40; log, sqrt, rank, or log in its cohort's deviations."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(40.0), F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(0.0))))
    if how == "log":
        return F.log1p(x)
    if how == "sqrt":
        return F.sqrt(x)
    if how == "rank":
        return pct_rank(x, by)
    if how == "zclass":
        w = Window.partitionBy(*by)
        sd = F.coalesce(F.nullif(F.stddev_pop(F.log1p(x)).over(w), F.lit(0.0)), F.lit(1.0))
        return (F.log1p(x) - F.avg(F.log1p(x)).over(w)) / sd
    raise ValueError(f"no fold target {how!r}")
