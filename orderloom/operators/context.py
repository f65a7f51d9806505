"""What surrounds a person in a season: team mates, conference, age curve, role, opponents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import row_mean, sdiv
from orderloom.operators.stats import wmean, wmean_se


def team_mates(df: DataFrame, team: list[str], person: str, weight: str, level: str, load: str, parts: dict[str, str]) -> DataFrame:
    """df with the weighted means, the best and the shares of the others of a team, in one pass over the team.

    level: a rating; load: a share of use; parts: name to column of what is shared out. A missing
    weight counts as none.
    """
    w = Window.partitionBy(*team)
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))

    def others(c: str) -> Column:
        here = F.when(F.col(c).isNotNull(), own).otherwise(0.0)
        value = here * F.coalesce(F.col(c), F.lit(0.0))
        return sdiv(F.sum(value).over(w) - value, F.sum(here).over(w) - here)

    positive = own * F.greatest(F.coalesce(F.col(level), F.lit(0.0)), F.lit(0.0))
    place = F.row_number().over(w.orderBy(F.desc_nulls_last(level), person))
    rows = df.withColumns({"_place": place, "_positive": positive})
    top = lambda n: F.max(F.when(F.col("_place") == n, F.col(level))).over(w)
    rows = rows.withColumns({f"_top{n}": top(n) for n in (1, 2, 3)})
    first, second = F.col("_place") == 1, F.col("_place") == 2
    out = {
        f"t_mates_{level}": others(level), f"t_mates_{load}": others(load), "t_mates_best": F.when(first, F.col("_top2")).otherwise(F.col("_top1")),
        "t_mates_top2": F.when(first, F.col("_top2") + F.col("_top3")).when(second, F.col("_top1") + F.col("_top3")).otherwise(F.col("_top1") + F.col("_top2")) / 2,
        f"t_{level}_share": sdiv(F.col("_positive"), F.sum("_positive").over(w)), "t_talent_conc": sdiv(F.sum(F.col("_positive") * F.col("_positive")).over(w), F.sum("_positive").over(w) * F.sum("_positive").over(w)),
        "t_team_sum": 5 * sdiv(F.sum("_positive").over(w), F.sum(own).over(w)), "t_team_n": F.count("*").over(w), **{f"t_{n}_share": sdiv(F.col(c), F.sum(c).over(w)) for n, c in parts.items()},
    }
    return rows.withColumns(out).drop("_place", "_positive", "_top1", "_top2", "_top3")


def conference(teams: DataFrame, conf: str, team: str, year: str, level: str, weight: str) -> DataFrame:
    """(conf, year, same, prior): a conference's weighted level in a year, and what its teams of that year had the year before."""
    same = teams.groupBy(conf, year).agg(wmean(level, weight).alias("same"))
    old = teams.select(team, (F.col(year) + 1).alias(year), F.col(level).alias("_l"), F.col(weight).alias("_w"))
    prior = teams.select(team, year, conf).join(old, [team, year]).groupBy(conf, year).agg(wmean("_l", "_w").alias("prior"))
    return same.join(prior, [conf, year], "left")


def age_curves(df: DataFrame, year: str, age: str, stat: str, degree: int = 3) -> DataFrame:
    """df with ``resid`` and ``z`` of a stat about a polynomial of age that was fitted on the years before each row's own.

    Moments are summed once a year; the driver adds years up and solves one small system for each.
    Ages are held to the 0.5th to 99.5th percentile of what the fit saw, which one grouped selection
    gives for all years; curves come to the rows as a table of one row a year.
    """
    from orderloom.operators.selection import quantiles

    middle = 20.0
    x, y = F.col(age).cast("double") - middle, F.col(stat).cast("double")
    rows = df.filter(F.col(age).isNotNull() & F.col(stat).isNotNull())
    powers = [F.sum(F.pow(x, F.lit(i))).alias(f"x{i}") for i in range(2 * degree + 1)]
    cross = [F.sum(F.pow(x, F.lit(i)) * y).alias(f"y{i}") for i in range(degree + 1)]
    sums = sorted(rows.groupBy(year).agg(*powers, *cross, F.sum(y * y).alias("yy")).collect(), key=lambda r: r[year])
    every = rows.select(F.col(age).alias("_age"), F.explode(F.filter(F.lit([r[year] for r in sums]), lambda t: t > F.col(year))).alias("_now")) if len(sums) > 1 else None
    bounds = {r["_now"]: (r["q0"], r["q1"]) for r in quantiles(every, ["_now"], "_age", [0.005, 0.995]).collect()} if every is not None else {}
    models = []
    for now in (r[year] for r in sums):
        old = [r for r in sums if r[year] < now]
        n = sum(r["x0"] for r in old)
        if n <= degree + 1:
            continue
        a = np.array([[sum(r[f"x{i + j}"] for r in old) for j in range(degree + 1)] for i in range(degree + 1)])
        b = np.array([sum(r[f"y{i}"] for r in old) for i in range(degree + 1)])
        c = np.linalg.lstsq(a, b, rcond=None)[0]
        rest = max(0.0, sum(r["yy"] for r in old) - 2 * c @ b + c @ a @ c)
        models.append((int(now), c.tolist()[::-1], float(np.sqrt(rest / (n - 1))), *map(float, bounds[now])))
    known = df.sparkSession.createDataFrame(models, "_year long, _c array<double>, _sd double, _low double, _high double")
    at = F.greatest("_low", F.least(F.col("_high"), F.col(age).cast("double"))) - middle
    curve = F.aggregate("_c", F.lit(0.0), lambda total, k: total * at + k)
    out = df.join(F.broadcast(known), F.col(year) == F.col("_year"), "left").withColumn("resid", F.when(F.col(age).isNotNull(), F.col(stat) - curve))
    return out.withColumn("z", sdiv("resid", "_sd")).drop("_year", "_c", "_sd", "_low", "_high")


def rarity(role: str, year: str) -> Column:
    """Share of a year's persons that have a role."""
    return F.count("*").over(Window.partitionBy(year, role)) / F.count("*").over(Window.partitionBy(year))


def opponent_splits(games: DataFrame, by: list[str], opponent: str, stat: str, weight: str) -> DataFrame:
    """(by, n, mean and error of a stat against strong, weak and all but strong opponents, and the difference of the first and the last).

    Strong are the upper quarter of opponents' levels, weak the lower half; levels that are not known take no part.
    """
    q = games.agg(F.percentile(opponent, F.array(F.lit(0.75), F.lit(0.5))).alias("q")).first()["q"] or (0.0, 0.0)
    known = games.filter(F.col(opponent).isNotNull())
    parts = {"top": F.col(opponent) >= q[0], "bot": F.col(opponent) < q[1], "rest": F.col(opponent) < q[0]}
    aggs = []
    for name, here in parts.items():
        x, w = F.when(here, F.col(stat)), F.when(here & (F.col(weight) > 0), F.col(weight))
        n = F.count(F.when(F.col(stat).isNotNull(), w))
        aggs += [wmean(x, w).alias(f"{name}_mean"), F.when(n > 1, wmean_se(x, w)).alias(f"{name}_se"), n.alias(f"{name}_n")]
    out = known.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    return out.withColumns({"top_minus_rest": F.col("top_mean") - F.col("rest_mean"), "top_minus_rest_se": F.sqrt(F.col("top_se") * F.col("top_se") + F.col("rest_se") * F.col("rest_se"))})


def talent(df: DataFrame, columns: list[str]) -> Column:
    """Mean of what is known of several levels, each in its deviations over all rows; statistics are one row, as literals."""
    got = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_samp, "s")))).first()
    return row_mean(*((F.col(c) - F.lit(got[f"m{i}"])) / F.lit(got[f"s{i}"] or None) for i, c in enumerate(columns)))


def ratio_splits(games: DataFrame, season: str, by: list[str], opponent: str, top: str, bottom: str) -> DataFrame:
    """(season, by, and of strong, weak and all but strong opponents: ratio of two sums, its error and games; first minus last with its error).

    Strong are the upper quarter of a season's opponents' levels, weak the lower half; unknown levels
    take no part. The error is the delta method's for two counts. Quantiles are exact and come from
    sorted parts, so that a season of a third of all rows is many tasks.
    """
    from orderloom.operators.selection import quantiles

    known = games.filter(F.col(opponent).isNotNull())
    ends = quantiles(known, [season], opponent, [0.75, 0.5]).select(F.col(season).alias("_season"), "q0", "q1")
    rows = known.join(ends, F.col(season).eqNullSafe(F.col("_season")))
    level = F.col(opponent)
    parts = {"top": level >= F.col("q0"), "bot": level < F.col("q1"), "rest": level < F.col("q0")}
    sums = [f.alias(f"_{n}{k}") for n, here in parts.items() for k, f in (("a", F.sum(F.when(here, F.col(top)))), ("b", F.sum(F.when(here, F.col(bottom)))), ("n", F.count_if(here)))]
    out = rows.groupBy(season, *by).agg(*sums)
    made: dict[str, Column] = {}
    for n in parts:
        a, b = F.coalesce(F.col(f"_{n}a").cast("double"), F.lit(0.0)), F.coalesce(F.col(f"_{n}b").cast("double"), F.lit(0.0))
        made |= {f"{n}_ratio": F.when(b > 0, a / b), f"{n}_se": F.when(b > 0, F.abs(a / b) * F.sqrt(1 / F.greatest(a, F.lit(1.0)) + 1 / b)), f"{n}_n": F.col(f"_{n}n")}
    out = out.withColumns(made)
    return out.select(season, *by, *made, (F.col("top_ratio") - F.col("rest_ratio")).alias("top_minus_rest"), F.sqrt(F.col("top_se") * F.col("top_se") + F.col("rest_se") * F.col("rest_se")).alias("top_minus_rest_se"))
