"""Seeded resampling: every draw is a hash of a row's key, so runs repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr
from orderloom.operators.lineage import cut, kept
from orderloom.operators.windows import average_rank, looked_up


def number(*keys: Column | str, seed: int = 0) -> Column:
    """A whole number of 52 bits from MD5 of keys and seed, which any engine can repeat."""
    text = F.concat_ws("|", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on keys and seed only."""
    return number(*keys, seed=seed) / float(1 << 52)


def folds(key: str, k: int, seed: int = 0) -> Column:
    return F.pmod(number(key, seed=seed), F.lit(k)).cast("int")


def bootstrap(df: DataFrame, by: str, key: str, x: str, y: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """(replicate, mean_rho): Poisson bootstrap of rows, then the mean rank correlation over cohorts.

    Each row's weight in each replicate is Poisson(1) by inversion, so nothing is collected.
    """
    u = draw(key, "replicate", seed=seed)
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015]
    n = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_n", n).filter("_n > 0")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    ranks = rows.select("replicate", by, average_rank(x, ["replicate", by]).alias("_x"), average_rank(y, ["replicate", by]).alias("_y"))
    return ranks.groupBy("replicate", by).agg(corr("_x", "_y").alias("rho")).groupBy("replicate").agg(F.avg("rho").alias("mean_rho"))


def permuted(df: DataFrame, by: list[str], key: str, value: str, seed: int = 0) -> DataFrame:
    """df with the value of another row of its cohort, by two orders, one of them random."""
    a = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    b = df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(draw(key, seed=seed), key)).alias("_i"), F.col(value).alias("_v"))
    return a.join(b, [*by, "_i"]).drop("_i", value).withColumnRenamed("_v", value)


def with_next(df: DataFrame, by: list[str], key: str, row: Column, many: int, seed: int = 0) -> DataFrame:
    """df with ``_row`` (row, a struct) and ``_next``, those of up to ``many`` next rows of a random order of the cohort.

    A row's place is a draw, so draws are dealt evenly to as many ranges as a shuffle has parts, and a
    window holds a cohort's share of one. What follows a range's last rows are the first ones of the
    ranges after it, which stand behind its own rows in the window. df is read twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({"_d": draw(key, seed=seed), "_row": row}).withColumn("_p", F.floor(F.col("_d") * parts))
    within = Window.partitionBy(*by, "_p").orderBy("_d", key)
    along = Window.partitionBy(*by).orderBy("_p", "_d", key)  # at most ``many`` rows of each range
    heads = rows.select(*by, "_p", "_d", key, "_row", F.row_number().over(within).alias("_n")).filter(F.col("_n") <= many)
    firsts = heads.withColumns({"_to": F.lag("_p").over(along), "_them": F.collect_list(F.struct("_d", key, "_row")).over(along.rowsBetween(0, many - 1))}).filter("_n = 1 and _to is not null")
    behind = firsts.select(*by, F.col("_to").alias("_p"), F.inline("_them")).withColumn("_own", F.lit(False))
    both = rows.withColumn("_own", F.lit(True)).unionByName(behind, allowMissingColumns=True)
    found = F.filter(F.array(*(F.lead("_row", i).over(within) for i in range(1, many + 1))), lambda x: x.isNotNull())
    return both.withColumn("_next", found).filter("_own").select(*df.columns, "_row", "_next")


def mixup(df: DataFrame, by: list[str], key: str, columns: list[str], seed: int = 0) -> DataFrame:
    """Synthetic rows: each row mixed with the next one of a random order of its cohort. df is computed once and kept."""
    share = draw(key, seed=seed + 1)
    rows = with_next(kept(df), by, key, F.struct(*columns), 1, seed)
    return rows.withColumns({c: share * F.col(c) + (1 - share) * F.coalesce(F.get("_next", F.lit(0))[c], F.col(c)) for c in columns}).select(*df.columns)


def jitter(df: DataFrame, key: str, columns: list[str], scale: float, seed: int = 0) -> DataFrame:
    return df.withColumns({c: F.col(c) + scale * (draw(key, F.lit(c), seed=seed) - 0.5) for c in columns})


def normal(*keys: Column | str, seed: int = 0) -> Column:
    """A draw from the normal distribution that depends on keys and seed only."""
    u, v = draw(*keys, seed=seed), draw(*keys, seed=seed + 1_000_003)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(6.283185307179586 * v)


def _share(key: str, seed: int) -> Column:
    """A weight around a half: the median of three uniform draws, which is the beta distribution of 2 and 2."""
    three = F.array_sort(F.array(*(draw(key, seed=seed + i) for i in range(3))))
    return F.get(three, F.lit(1))


def class_mixup(df: DataFrame, by: list[str], key: str, columns: list[str], label: str, reach: int = 25, seed: int = 0) -> DataFrame:
    """Each row mixed with one whose label's rank within the cohort is at most ``reach`` away."""
    w = Window.partitionBy(*by).orderBy(label, key)
    rows = df.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*by)), "_s": _share(key, seed)})
    step = F.floor(draw(key, seed=seed + 7) * (2 * reach + 1)) - reach
    rows = rows.withColumn("_to", F.greatest(F.lit(1), F.least(F.col("_n"), F.col("_r") + step)))
    other = rows.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_r").alias("_to"), F.struct(*columns, label).alias("_o"))
    joined = rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [rows["_to"] == other["_to"]]).drop(other["_to"])
    mixed = {c: F.col("_s") * F.col(c) + (1 - F.col("_s")) * F.col(f"_o.{c}") for c in [*columns, label]}
    return joined.withColumns(mixed).select(*df.columns)


def smote(df: DataFrame, by: list[str], key: str, columns: list[str], label: str, tries: int = 8, seed: int = 0) -> DataFrame:
    """Each row moved a random share of the way towards the nearest of ``tries`` random rows of its cohort.

    Distances are over features in the cohort's deviations, a missing one counting as the mean. The
    tries are the next rows of a random order (``with_next``), so work grows with the rows and not with
    their square. df is computed once and kept.
    """
    df = kept(df)
    known = cut(df.groupBy(*by).agg(*(v for i, c in enumerate(columns) for v in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_d{i}")))))
    z = [F.coalesce((F.col(c) - F.col(f"_m{i}")) / F.coalesce(F.nullif(F.col(f"_d{i}"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for i, c in enumerate(columns)]
    rows = looked_up(df, known, by).withColumn("_z", F.array(*z)).select(*df.columns, "_z")
    rows = with_next(rows, by, key, F.struct(F.col("_z").alias("z"), F.struct(*columns, label).alias("v")), tries, seed)
    far = lambda x: F.aggregate(F.zip_with(x["z"], F.col("_z"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    near = F.array_min(F.transform("_next", lambda x, i: F.struct(far(x).alias("d"), i.alias("i"), x["v"].alias("v"))))
    rows = rows.withColumns({"_near": near, "_s": draw(key, seed=seed + 1)})
    moved = {c: F.col(c) + F.coalesce(F.col("_s") * (F.col(f"_near.v.{c}") - F.col(c)), F.lit(0.0)) for c in [*columns, label]}
    return rows.withColumns(moved).select(*df.columns)


def label_noise(df: DataFrame, by: list[str], key: str, label: str, strength: float = 0.1, seed: int = 0) -> DataFrame:
    """Labels with normal noise of a share of the cohort's deviation; features stay."""
    sd = F.coalesce(F.stddev_pop(label).over(Window.partitionBy(*by)), F.lit(0.0))
    return df.withColumn(label, F.col(label) + strength * sd * normal(key, seed=seed))
