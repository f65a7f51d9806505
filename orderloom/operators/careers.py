"""What led to a person's last season: growth, latent shares, the last line abroad, how a rate moves with use.

Sums of persons and of years are built by aggregates that combine before any shuffle, so a person
with a third of all rows is many tasks. Only one row a person and season, or a year and role,
meets in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import clip, sdiv
from orderloom.operators import selection, stats, windows
from orderloom.operators.lineage import cut


def until(seasons: DataFrame, persons: DataFrame, who: str, year: str, cutoff: str, span: int | None = None) -> DataFrame:
    """Seasons of each person up to the cutoff, or the last ``span`` years before it and its own; persons are unique."""
    rows = seasons.join(persons.select(who, cutoff), who).filter(F.col(year) <= F.col(cutoff))
    return rows if span is None else rows.filter(F.col(year) >= F.col(cutoff) - span)


def development(seasons: DataFrame, persons: DataFrame, who: str, year: str, cutoff: str, measures: list[str], weight: str, worth: float = 2.0) -> DataFrame:
    """(who, cutoff, n, and of each measure: slope, population, shrunk, first, gain, bend).

    seasons: one row of a person and year; persons: (who, cutoff), unique. slope: weighted least
    squares on the year, from two seasons with the measure and a weight on; population: the mean
    slope of persons with an earlier cutoff; shrunk: n / (n + worth) of the own slope and the rest
    of the population's, NULL without either; first: the value of the first season; gain: last
    minus first, of two seasons on; bend: the last year's change less that of the year before. A
    missing or negative weight counts as none. Persons without a season up to the cutoff are absent.
    """
    w = Window.partitionBy(who)
    rows = until(seasons, persons, who, year, cutoff).withColumns({"_f": F.row_number().over(w.orderBy(year)), "_l": F.row_number().over(w.orderBy(F.desc(year)))})
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    at = lambda place, k, m: F.max(F.when(F.col(place) == k, F.col(m)))
    aggs: dict[str, Column] = {"n": F.count("*")}
    for m in measures:
        here = F.when(F.col(m).isNotNull() & (own > 0), own)
        slope, _ = stats.wls(F.col(year) - F.col(cutoff), F.col(m), here)  # years from the cutoff: small numbers
        aggs[f"{m}_slope"] = F.when(F.count(here) >= 2, slope)
        aggs[f"{m}_first"] = at("_f", 1, m)
        aggs[f"{m}_gain"] = F.when(F.count("*") >= 2, at("_l", 1, m) - at("_f", 1, m))
        aggs[f"{m}_bend"] = at("_l", 1, m) - 2 * at("_l", 2, m) + at("_l", 3, m)
    out = rows.groupBy(who, cutoff).agg(*(c.alias(n) for n, c in aggs.items()))
    earlier = windows.before([], F.col(cutoff))  # one row a year
    means = out.groupBy(cutoff).agg(*(f(f"{m}_slope").alias(f"{m}_{f.__name__}") for m in measures for f in (F.sum, F.count)))
    means = means.select(cutoff, *(sdiv(F.sum(f"{m}_sum").over(earlier), F.sum(f"{m}_count").over(earlier)).alias(f"{m}_population") for m in measures))
    n = F.col("n").cast("double")
    joined = out.join(means, out[cutoff].eqNullSafe(means[cutoff]), "left").drop(means[cutoff])
    return joined.withColumns({f"{m}_shrunk": n / (n + worth) * F.col(f"{m}_slope") + worth / (n + worth) * F.col(f"{m}_population") for m in measures})


def share_priors(seasons: DataFrame, asked: DataFrame, role: str, year: str, made: str, tried: str, least: int = 20, enough: int = 30, most: float = 500.0) -> DataFrame:
    """(year, role, mean, worth, n): a beta prior of a share for each asked year and role, from seasons before that year alone.

    Method of moments over seasons with ``least`` tries: the binomial noise that tries explain goes
    from the variance; what the prior is worth lies in 2 to ``most``, and is ``most`` where no
    variance is left. The row with a NULL role is that of all seasons, those without a role too. A
    role of fewer than ``enough`` seasons has no row. asked: (year, role) in any number.
    """
    q = seasons.filter(F.col(tried) >= least).select(year, role, (F.col(made) / F.col(tried)).alias("_p"), (1 / F.col(tried)).alias("_i"))
    cells = q.groupBy(year, role).agg(F.count("*").alias("_n"), F.sum("_p").alias("_s"), F.sum(F.col("_p") * F.col("_p")).alias("_ss"), F.sum("_i").alias("_si"))
    sums = ["_n", "_s", "_ss", "_si"]
    none = [F.lit(0).cast("long").alias("_n"), *(F.lit(0.0).alias(c) for c in sums[1:])]
    cells = cells.unionByName(asked.select(year, role).distinct().select(year, role, *none))  # years that are asked for but have no season
    add = [F.sum(c).alias(c) for c in sums]
    roles = cells.filter(F.col(role).isNotNull()).groupBy(year, role).agg(*add)
    every = cells.groupBy(year).agg(*add).withColumn(role, F.lit(None).cast(seasons.schema[role].dataType))
    both = roles.unionByName(every)
    past = both.select(year, role, *(F.sum(c).over(windows.before([role], F.col(year))).alias(c) for c in sums))
    n, mean = F.col("_n"), F.col("_s") / F.col("_n")
    left = (F.col("_ss") - F.col("_s") * mean) / (n - 1) - mean * (1 - mean) * F.col("_si") / n
    worth = clip(F.when(left > 0, mean * (1 - mean) / left - 1).otherwise(most), 2.0, most)
    return past.filter(n >= enough).select(year, role, mean.alias("mean"), worth.alias("worth"), n.alias("n"))


def latent_shares(seasons: DataFrame, persons: DataFrame, who: str, year: str, cutoff: str, role: str, made: str, tried: str, **limits) -> DataFrame:
    """(who, cutoff, role, made, tried, mean, worth, from_role, share): career shares drawn to the prior of the own role.

    persons: (who, cutoff, role), unique. Where the role is unknown or too rare the prior is that of
    all; without one, or without a try, the share is NULL. from_role says which prior it was.
    """
    total = until(seasons, persons, who, year, cutoff).groupBy(who).agg(F.sum(made).alias(made), F.sum(tried).alias(tried))
    asked = persons.select(F.col(cutoff).alias(year), role)
    priors = share_priors(seasons, asked, role, year, made, tried, **limits).withColumnRenamed(year, cutoff)
    own = priors.filter(F.col(role).isNotNull()).select(cutoff, role, F.col("mean").alias("_m"), F.col("worth").alias("_w"))
    every = priors.filter(F.col(role).isNull()).select(cutoff, F.col("mean").alias("_am"), F.col("worth").alias("_aw"))
    x = persons.select(who, cutoff, role).join(total, who).join(own, [cutoff, role], "left").join(every, cutoff, "left")
    x = x.withColumns({"mean": F.coalesce("_m", "_am"), "worth": F.coalesce("_w", "_aw"), "from_role": F.col("_m").isNotNull()})
    share = F.when(F.col(tried) > 0, sdiv(F.col(made) + F.col("mean") * F.col("worth"), F.col(tried) + F.col("worth")))
    return x.select(who, cutoff, role, made, tried, "mean", "worth", "from_role", share.alias("share"))


def last_lines(seasons: DataFrame, persons: DataFrame, who: str, year: str, cutoff: str, league: str, level: str, games: str, minutes: str, rates: dict[str, str], span: int = 2) -> DataFrame:
    """(who, cutoff, season, gap, leagues, main, main_level, top, top_level, games, per_game, and of each rate: main, top, all).

    The last season in the ``span`` years up to the cutoff: its main league is that of most minutes
    (then of the higher level), its top league that of the highest level (then of most minutes);
    what still ties goes to the later name. Lines of one league and season, a move between clubs,
    are summed first. rates: name to column, a unit being 36 minutes. Persons without a line have none.
    """
    lines = until(seasons, persons, who, year, cutoff, span).groupBy(who, cutoff, year, league).agg(F.max(level).alias("_level"), F.coalesce(F.sum(games), F.lit(0)).alias("_g"), F.coalesce(F.sum(minutes), F.lit(0.0)).alias("_mp"), *(F.sum(c).alias(n) for n, c in rates.items()))
    line = F.struct(F.col(league).alias("league"), F.col("_level").alias("level"), F.col("_g").alias("g"), F.col("_mp").alias("mp"), *rates)
    season = lines.groupBy(who, cutoff, year).agg(
        F.count("*").alias("leagues"), F.sum("_g").alias("games"), F.sum("_mp").alias("_mp"), *(F.sum(n).alias(n) for n in rates),
        F.max_by(line, F.struct("_mp", "_level", league)).alias("_main"), F.max_by(line, F.struct("_level", "_mp", league)).alias("_top"),
    )
    last = season.groupBy(who, cutoff).agg(F.max_by(F.struct(*(c for c in season.columns if c not in (who, cutoff))), year).alias("_s")).select(who, cutoff, "_s.*")
    of = lambda n, part="": 36 * sdiv(F.col(f"{part}{n}"), F.col(f"{part}mp" if part else "_mp"))
    return last.select(
        who, cutoff, F.col(year).alias("season"), (F.col(cutoff) - F.col(year)).alias("gap"), "leagues", F.col("_main.league").alias("main"), F.col("_main.level").alias("main_level"), F.col("_top.league").alias("top"), F.col("_top.level").alias("top_level"),
        "games", sdiv("_mp", "games").alias("per_game"), *(c for n in rates for c in (of(n, "_main.").alias(f"main_{n}"), of(n, "_top.").alias(f"top_{n}"), of(n).alias(f"all_{n}"))),
    )


def elasticity(games: DataFrame, by: list[str], who: str, rate: str, use: str, controls: list[str], weight: str, *, worth: float = 30.0, fewest: int = 6, regular: tuple[int, float] = (15, 12.0)) -> DataFrame:
    """(by, who, n, slope, error, population, shrunk): how a rate moves with use within a person, with controls, by weighted least squares.

    Missing controls count as zero. Persons of fewer than ``fewest`` games have no slope. population:
    the mean, by games, of the slopes of regulars (games, mean weight) of the same ``by``, each held
    to their 1st and 99th percentile. shrunk: the own slope seen n times and a population's worth ``worth`` games.
    """
    known = games.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in controls})
    fit = stats.wls_fit(known, [*by, who], rate, [use, *controls], weight)
    fit = cut(fit.select(*by, who, "n", *(F.when(F.col("n") >= fewest, F.get(c, F.lit(1))).alias(a) for c, a in (("coefficients", "slope"), ("errors", "error")))))  # one row a person, read again for the population
    played = games.groupBy(*by, who).agg(F.count("*").alias("_games"), F.avg(weight).alias("_mean"))
    regulars = fit.join(played.filter((F.col("_games") >= regular[0]) & (F.col("_mean") >= regular[1])).select(*by, who), [*by, who], "left_semi").filter("slope is not null")
    ends = selection.quantiles(regulars, by, "slope", [0.01, 0.99]).select(*by, "q0", "q1")
    held = F.least(F.greatest("slope", "q0"), F.col("q1"))
    population = regulars.join(ends, by).groupBy(*by).agg(stats.wmean(held, "n").alias("population"))
    x, n = fit.join(population, by, "left"), F.col("n").cast("double")
    return x.withColumn("shrunk", n / (n + worth) * F.col("slope") + worth / (n + worth) * F.col("population"))


def mates_over_games(box: DataFrame, game: list[str], who: str, minutes: str, rating: str, parts: list[str]) -> DataFrame:
    """(who, games, minutes, mates_rating, mates_known, and a share of each part): the others over the games that a person played.

    box: lines of a person in a side's game; several lines count as one, with the highest rating, so a
    game that holds a third of all lines is as many rows as persons once they have combined. Each
    game's sums less the own ones are added over the person's games: no pairs of persons are made. mates_rating: the
    mean rating of the others by minutes; mates_known: the part of their minutes with a rating; the
    shares are the person's part of the side's. Lines without minutes do not count as played.
    """
    m = F.col(minutes).cast("double")
    rows = box.filter(m > 0).groupBy(*game, who).agg(F.sum(m).alias("_m"), F.max(rating).alias("_rating"), *(F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in parts)).filter(" and ".join(f"`{g}` is not null" for g in game))
    rows = rows.withColumns({"_k": F.when(F.col("_rating").isNotNull(), F.col("_m")).otherwise(0.0), "_r": F.coalesce(F.col("_m") * F.col("_rating"), F.lit(0.0))})
    side = Window.partitionBy(*game)
    j = rows.withColumns({f"_t{c}": F.sum(c).over(side) for c in ("_m", "_k", "_r", *parts)})
    others = lambda c: F.sum(F.col(f"_t{c}") - F.col(c))
    return j.groupBy(who).agg(
        F.count("*").alias("games"), F.sum("_m").alias("minutes"), F.when(others("_k") > 0, sdiv(others("_r"), others("_k"))).alias("mates_rating"), F.when(others("_m") > 0, sdiv(others("_k"), others("_m"))).alias("mates_known"),
        *(sdiv(F.sum(p), F.sum(f"_t{p}")).alias(f"{p}_share") for p in parts),
    )


def compared_values(texts: DataFrame, names: DataFrame, values: DataFrame, text_key: str, name_key: str, person: str, year: str, value: str, cutoff: str) -> DataFrame:
    """texts with ``compared`` and ``compared_value``: the one person of the name that a text mentions and their mean value in years before the cutoff.

    names: (name_key, person); a name of several persons is nobody's. Without a name, a person or a
    year before the cutoff the value is NULL.
    """
    one = names.filter(F.col(name_key).isNotNull()).groupBy(F.col(name_key).alias("_name")).agg(F.min(person).alias("compared"), F.max(person).alias("_most")).filter(F.col("compared") == F.col("_most")).drop("_most")
    named = texts.join(one, F.col(text_key) == F.col("_name"), "left").drop("_name")
    asked = named.filter(F.col("compared").isNotNull()).select("compared", F.col(cutoff).alias("_now")).distinct()
    yearly = values.groupBy(F.col(person).alias("compared"), F.col(year).alias("_year")).agg(F.sum(value).alias("_v"))
    mean = asked.join(yearly, "compared").filter(F.col("_year") < F.col("_now")).groupBy("compared", "_now").agg(F.avg("_v").alias("compared_value"))
    j = named.join(mean.withColumnRenamed("compared", "_who"), (F.col("compared") == F.col("_who")) & (F.col(cutoff) == F.col("_now")), "left")
    return j.drop("_who", "_now")


def identities(persons: DataFrame, records: DataFrame, who: str, cutoff: str, record: str, first: str, *, days: int = 366, years: int = 8) -> DataFrame:
    """(who, record): records of a person by name, told apart by birth date.

    persons: who, cutoff, ``name``, ``last``, ``birth``; records: record, ``name``, ``reversed`` (last
    name first), ``last``, ``birth`` and the first year. A name holds in either order. With a birth date
    known on both sides they are to be within ``days``; a person without one takes records whose
    first year is 0 to ``years`` before the cutoff. A person of known birth whom that leaves
    without a record takes those of the same last name and birth date. Missing names match nothing.
    """
    p = persons.select(who, cutoff, F.col("name").alias("_name"), F.col("last").alias("_plast"), F.col("birth").alias("_pbirth"))
    forms = records.select(record, first, "birth", "last", F.explode(F.array_distinct(F.array("name", "reversed"))).alias("_name")).filter("_name is not null")
    near = F.when(F.col("_pbirth").isNull(), F.col(cutoff) - F.col(first)).otherwise(F.abs(F.date_diff("_pbirth", "birth")))
    fits = F.when(F.col("_pbirth").isNull(), (near >= 0) & (near <= years)).otherwise(F.col("birth").isNull() | (near <= days))
    by_name = p.join(forms, "_name").filter(fits).select(who, record).distinct()
    alone = p.filter(F.col("_pbirth").isNotNull()).join(by_name.select(who).distinct(), who, "left_anti")
    same = records.select(record, F.col("last").alias("_plast"), F.col("birth").alias("_pbirth"))
    return by_name.unionByName(alone.join(same, ["_plast", "_pbirth"]).select(who, record).distinct())


def youth_events(links: DataFrame, persons: DataFrame, events: DataFrame, who: str, cutoff: str, record: str, totals: list[str], ages: dict[str, tuple[list[int], bool | None]], games: str = "g", minutes: str = "mp", world: int = 4) -> DataFrame:
    """(who, ids, events, max_level, first_year, last_year, flags of ages, best_rank, totals, best of a game, the last event's line).

    events: one row of a record and competition: record, ``competition``, ``year``, ``level``, ``age``,
    ``rank``, ``listed``, games, minutes and totals (pts among them). Rosters hold people who did not
    take part: someone did with a game played, or, in a competition where nobody has one, if listed.
    Only years before the cutoff count. ages: name of a flag to the ages it stands for and whether the
    level is the world's, below it or either (None). The last event is that of the last year, then the
    highest level, then the later competition. Persons who took part in nothing are absent.
    """
    played = F.coalesce(F.col(games), F.lit(0)) > 0
    counted = events.groupBy("competition").agg(F.bool_or(played).alias("_counted"))
    part = events.join(counted, events["competition"].eqNullSafe(counted["competition"])).drop(counted["competition"]).filter(played | (~F.col("_counted") & F.coalesce("listed", F.lit(False))))
    rows = links.select(who, record).join(part, record).join(persons.select(who, cutoff), who).filter(F.col("year") < F.col(cutoff))
    flag = {n: F.col("age").isin(a) & (F.lit(True) if top is None else (F.col("level") == world) if top else (F.col("level") < world)) for n, (a, top) in ages.items()}
    own = F.when(played, F.struct(F.col("level").alias("last_level"), F.col("age").alias("last_age"), F.col(games).alias("last_gp"), sdiv(minutes, games).alias("last_mpg"), sdiv("pts", games).alias("last_ppg"), (36 * sdiv("pts", minutes)).alias("last_pts_36")))
    out = rows.groupBy(who).agg(
        F.count_distinct(record).alias("ids"), F.count_distinct("competition").alias("events"), F.max("level").alias("max_level"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min("rank").alias("best_rank"),
        *(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flag.items()), *(F.sum(F.when(played, F.col(c))).alias(c) for c in [games, minutes, *totals]),
        F.max(F.when(played, sdiv("pts", games))).alias("best_ppg"), F.max_by(own, F.when(played, F.struct("year", "level", "competition", record))).alias("_own"),
    )
    return out.select(*(c for c in out.columns if c != "_own"), "_own.*")
