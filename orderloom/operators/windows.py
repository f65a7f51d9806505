"""Ordered and ranked operators within a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import clip, col, sdiv
from orderloom.functions.numbers import norm_ppf, with_ppf
from orderloom.operators.lineage import cut, kept


def average_rank(x: Column | str, by: list[str], descending: bool = False) -> Column:
    """Rank from 1 with ties at their mean; NULL stays NULL and takes no rank."""
    x = col(x)
    order = F.desc_nulls_last(x) if descending else F.asc_nulls_last(x)
    ordered = Window.partitionBy(*by).orderBy(order)
    first = F.rank().over(ordered)
    same = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))  # equal values, in the same sort
    return F.when(x.isNotNull(), first + (same - 1) / 2.0)


def pct_rank(x: Column | str, by: list[str], descending: bool = False) -> Column:
    """Average rank over the number of present values."""
    return average_rank(x, by, descending) / F.count(col(x)).over(Window.partitionBy(*by))


def zscore(x: Column | str, by: list[str], guard: bool = False) -> Column:
    """Distance from the cohort's mean in sample deviations. guard: a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.nullif(F.stddev_samp(col(x)).over(w), F.lit(0.0))
    return sdiv(col(x) - F.avg(col(x)).over(w), F.coalesce(sd, F.lit(1.0)) if guard else sd)


def gauss_rank(x: Column | str, by: list[str], low: float = 0.01, high: float = 0.99) -> Column:
    n = F.count(col(x)).over(Window.partitionBy(*by))
    return norm_ppf(clip((average_rank(x, by) - 0.5) / n, low, high))


def _bytes(df: DataFrame) -> int:
    """Bytes that a plan reads, by the sizes of its tables; one of unknown size, made of rows at hand, counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def ranked(df: DataFrame, by: list[str], columns: dict[str, Column | str], *, counts: bool = False, most_bytes: int = 1 << 28, parts: int | None = None) -> DataFrame:
    """df with the average rank of each column within its cohort; counts: and of its present values, as ``{name}_n``.

    Plans that read up to most_bytes (0: none) are ranked by windows over cohorts. Beyond it a
    cohort may be larger than a task: its values are dealt to up to parts ranges (by the rows, if None), cut at values of a
    sample, windows run over ranges, and the rows of the ranges below are added. Values keep their
    type and its order throughout, whatever can be ordered, and equal ones share a range, so the
    ranks are the same. df is computed once, and cuts and sizes of all columns come from two passes.
    """
    if most_bytes and _bytes(df) <= most_bytes:
        out = {}
        for name, x in columns.items():
            out[name] = average_rank(x, by)
            if counts:
                out[f"{name}_n"] = F.count(col(x)).over(Window.partitionBy(*by))
        return df.withColumns(out)
    return _ranked_in_ranges(df, by, {n: col(x) for n, x in columns.items()}, counts, parts) if columns else df


#: Bytes of a table that goes to all tasks, rows of the sample that ranges are cut at, and rows that a range should hold.
MOST_SENT = 64 << 20
SAMPLED = 200_000
RANGE_ROWS = 500_000


def _ranked_in_ranges(df: DataFrame, by: list[str], columns: dict[str, Column], counts: bool, parts: int | None) -> DataFrame:
    keys = {f"__k{i}": k for i, k in enumerate(by)}
    each = range(len(columns))
    held = {f"__x{i}": x for i, x in enumerate(columns.values())}
    rows = kept(df.withColumns(held | ({"__row": F.monotonically_increasing_id()} if len(columns) > 1 else {})))
    n = rows.count()
    parts = parts or min(256, max(16, -(-n // RANGE_ROWS)))
    side = lambda d: d.select(*(F.col(k).alias(n) for n, k in keys.items()), *(c for c in d.columns if c not in by))
    same = [F.col(k).eqNullSafe(F.col(n)) for n, k in keys.items()]
    # the tables beside the rows are small (a row for each cohort) and go to all tasks: a join on the cohort would put a hot one into one task
    sample = rows.sample(min(1.0, SAMPLED / max(1, n)), seed=7)
    held = sample.groupBy(*by).agg(*(F.array_sort(F.collect_list(f"__x{i}")).alias(f"__s{i}") for i in each))  # of SAMPLED values or so in all
    at = lambda s: F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(s, (F.size(s) * i / parts).cast("int")))
    cuts = cut(held.select(*by, *(F.array_distinct(F.filter(at(f"__s{i}"), lambda c: c.isNotNull())).alias(f"__c{i}") for i in each)))

    def sent(d: DataFrame) -> DataFrame:
        much = d.agg(F.sum(F.octet_length(F.to_json(F.struct(*(c for c in d.columns if c not in by)))) + 64)).first()[0] or 0
        return F.broadcast(side(d)) if much <= MOST_SENT else side(d)

    def part(i: int) -> Column:
        return F.coalesce(F.size(F.filter(f"__c{i}", lambda c: c < F.col(f"__x{i}"))), F.lit(0))

    dealt = rows.join(sent(cuts), same, "left").select(*by, F.explode(F.array(*(F.when(F.col(f"__x{i}").isNotNull(), F.struct(F.lit(i).alias("i"), part(i).alias("p"))) for i in each))).alias("__e")).filter("__e is not null")
    sizes = dealt.groupBy(*by, "__e").agg(F.count("*").alias("__size"))
    up = Window.partitionBy(*by, "__e.i").orderBy("__e.p")  # a cohort's ranges, of which there are parts at most
    below = sizes.select(*by, F.col("__e.i").alias("__i"), F.struct(F.col("__e.p").alias("p"), (F.sum("__size").over(up) - F.col("__size")).alias("b")).alias("__b"), F.col("__size"))
    maps = below.groupBy(*by, "__i").agg(F.map_from_entries(F.collect_list("__b")).alias("m"), F.sum("__size").alias("n"))
    wide = maps.groupBy(*by).agg(*(F.first(F.when(F.col("__i") == i, F.struct("m", "n")), ignorenulls=True).alias(f"__m{i}") for i in each))
    known = cut(cuts.join(side(wide), same, "full").select(*(F.coalesce(k, n).alias(k) for n, k in keys.items()), *(c for i in each for c in (f"__c{i}", f"__m{i}"))))

    def placed(d: DataFrame, i: int, name: str) -> DataFrame:
        d = d.join(sent(known.select(*by, f"__c{i}", f"__m{i}")), same, "left").withColumns({"__part": part(i), "__below": F.try_element_at(f"__m{i}.m", part(i))})
        d = d.drop(*keys, f"__c{i}", f"__m{i}").repartition(*by, "__part")
        return d.withColumn(name, average_rank(f"__x{i}", [*by, "__part"]) + F.col("__below")).drop(f"__x{i}", "__part", "__below")

    if counts:
        # a row without a value is in part 0, which may hold no value: the count goes by the cohort alone
        rows = rows.join(sent(known.select(*by, *(F.coalesce(f"__m{i}.n", F.lit(0)).alias(f"{name}_n") for i, name in enumerate(columns)))), same, "left").drop(*keys)
        rows = rows.withColumns({f"{name}_n": F.coalesce(f"{name}_n", F.lit(0)) for name in columns})
    if len(columns) == 1:
        return placed(rows, 0, *columns)
    # a range takes its column alone, and whole rows are sent once, to meet their ranks
    out = rows.drop(*(f"__x{i}" for i in each))
    for i, name in enumerate(columns):
        told = placed(rows.select("__row", *by, f"__x{i}").filter(F.col(f"__x{i}").isNotNull()), i, name)
        out = out.join(told.select("__row", name).hint("merge"), "__row", "left")
    return out.drop("__row")


def looked_up(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """df with the other columns of known, which has a row for each ``on`` and is computed (``kept``, ``cut``); up to MOST_SENT bytes of it go to all tasks, so that a hot key stays spread."""
    keys = {f"__k{i}": k for i, k in enumerate(on)}
    much = known.agg(F.sum(F.octet_length(F.to_json(F.struct(*known.columns))) + 64)).first()[0] or 0
    side = known.select(*(F.col(k).alias(n) for n, k in keys.items()), *(c for c in known.columns if c not in on))
    return df.join(F.broadcast(side) if much <= MOST_SENT else side, [F.col(k).eqNullSafe(F.col(n)) for n, k in keys.items()], "left").drop(*keys)


def cuts_of(df: DataFrame, x: str, parts: int) -> list:
    """Up to parts - 1 rising values of x, of a sample of SAMPLED rows or so: where to cut ranges, which results must not depend on."""
    some = df.sample(min(1.0, SAMPLED / max(1, df.count())), seed=7)
    return sorted(set(some.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000)).first()[0] or []))


def range_of(x: Column | str, cuts: list) -> Column:
    """How many of the rising cuts lie below x, by halving."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(col(x) <= F.lit(cuts[m]), range_of(x, cuts[:m])).otherwise(F.lit(m + 1) + range_of(x, cuts[m + 1 :]))


def with_below(counts: DataFrame, by: list[str], x: str, columns: list[str], cuts: list, sizes: DataFrame | None = None) -> DataFrame:
    """counts, a row for each value x of a cohort, with ``{c}_below`` and ``{c}_all``: the sums of each column over the cohort's smaller values and over all of them.

    Windows run over a cohort's ranges of values between the cuts, and what the ranges below hold is
    added; so results do not depend on the cuts. sizes: rows with by, x and the columns to take the
    ranges' sums from, if not from counts.
    """
    at = range_of(x, cuts)
    held = (counts if sizes is None else sizes).groupBy(*by, at.alias("__p")).agg(*(F.sum(c).alias(c) for c in columns))
    whole = Window.partitionBy(*by)  # a cohort's ranges, one more than there are cuts at most
    known = cut(held.select(*by, "__p", *(v for c in columns for v in ((F.sum(c).over(whole.orderBy("__p")) - F.col(c)).alias(f"{c}_below"), F.sum(c).over(whole).alias(f"{c}_all")))))
    own = Window.partitionBy(*by, "__p").orderBy(x)
    rows = looked_up(counts.withColumn("__p", at), known, [*by, "__p"])
    parts = -(-(counts if sizes is None else sizes).count() // RANGE_ROWS)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # a task's share stays as it is
        rows = rows.repartition(parts, *by, "__p")
    return rows.withColumns({f"{c}_below": F.col(f"{c}_below") + F.sum(c).over(own) - F.col(c) for c in columns}).drop("__p")


def with_pct_ranks(df: DataFrame, by: list[str], columns: dict[str, Column | str], **how) -> DataFrame:
    """df with percentile ranks, the average rank over the number of present values; see ``ranked``."""
    df = ranked(df, by, columns, counts=True, **how)
    return df.withColumns({n: F.col(n) / F.col(f"{n}_n") for n in columns}).drop(*(f"{n}_n" for n in columns))


def with_gauss_rank(df: DataFrame, by: list[str], x: Column | str, name: str, low: float = 0.01, high: float = 0.99, **how) -> DataFrame:
    """df with the normal quantile of the rank, (rank - 1/2) / n held to low .. high; see ``ranked``."""
    df = ranked(df, by, {"_g": x}, counts=True, **how)
    df = df.withColumn("_p", clip((F.col("_g") - 0.5) / F.col("_g_n"), low, high))
    return with_ppf(df, "_p", name).drop("_g", "_g_n", "_p")


def with_bins(df: DataFrame, by: list[str], x: Column | str, k: int, name: str, **how) -> DataFrame:
    """df with min(floor(percentile rank * k), k - 1); see ``ranked``."""
    df = with_pct_ranks(df, by, {name: x}, **how)
    return df.withColumn(name, F.least(F.floor(F.col(name) * k), F.lit(k - 1)).cast("int"))


def with_zscores(df: DataFrame, by: list[str], columns: dict[str, Column | str], guard: bool = False) -> DataFrame:
    """df with distances from the cohort's means in sample deviations, from one aggregate for all columns; the cohorts' table is joined back, so a hot cohort stays spread where that table is small enough to be sent."""
    keys = {f"__k{i}": k for i, k in enumerate(by)}
    known = df.groupBy(*(F.col(k).alias(n) for n, k in keys.items())).agg(*(f(col(x)).alias(f"__{m}{i}") for i, x in enumerate(columns.values()) for m, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = df.join(known, [F.col(k).eqNullSafe(F.col(n)) for n, k in keys.items()], "left")
    made = {}
    for i, (name, x) in enumerate(columns.items()):
        sd = F.nullif(F.col(f"__s{i}"), F.lit(0.0))
        made[name] = sdiv(col(x) - F.col(f"__m{i}"), F.coalesce(sd, F.lit(1.0)) if guard else sd)
    return out.withColumns(made).drop(*keys, *(f"__{m}{i}" for i in range(len(columns)) for m in "ms"))


def bins(x: Column | str, by: list[str], k: int) -> Column:
    return F.least(F.floor(pct_rank(x, by) * k), F.lit(k - 1)).cast("int")


def ordinal(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", ordinal(by, *order)).filter(F.col("rank") <= k)


def before(by: list[str], *order: Column, last: int | None = None) -> Window:
    """Frame of all earlier rows, or of the last few before this one."""
    start = Window.unboundedPreceding if last is None else -last
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(start, -1)


def until_now(by: list[str], *order: Column) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def leave_one_out(x: Column | str, by: list[str], weight: Column | float = 1.0) -> Column:
    """Weighted mean of the others of a group."""
    w = Window.partitionBy(*by)
    own = F.lit(weight) if isinstance(weight, (int, float)) else weight
    own = F.when(col(x).isNotNull(), own).otherwise(0.0)
    return sdiv(F.sum(own * F.coalesce(col(x), F.lit(0.0))).over(w) - own * F.coalesce(col(x), F.lit(0.0)), F.sum(own).over(w) - own)


def changes(x: Column | str, by: list[str], *order: Column) -> Column:
    """1 where a value differs from the row before."""
    before_ = F.lag(col(x)).over(Window.partitionBy(*by).orderBy(*order))
    return F.when(before_.isNotNull() & ~before_.eqNullSafe(col(x)), 1).otherwise(0)


def islands(df: DataFrame, x: str, by: list[str], *order: Column) -> DataFrame:
    """df with the number of the run of equal values that a row is in."""
    return df.withColumn("_c", changes(x, by, *order)).withColumn("island", F.sum("_c").over(until_now(by, *order))).drop("_c")


def share(x: Column | str, by: list[str]) -> Column:
    return sdiv(col(x), F.sum(col(x)).over(Window.partitionBy(*by)))


def rising_prefix(df: DataFrame, x: str, by: list[str], *order: Column) -> DataFrame:
    """Rows up to the first one that does not exceed all before it."""
    top = F.max(x).over(before(by, *order))
    broken = F.max((F.col(x) <= F.coalesce(top, F.col(x) - 1)).cast("int")).over(until_now(by, *order))
    return df.withColumn("_b", broken).filter("_b = 0").drop("_b")
