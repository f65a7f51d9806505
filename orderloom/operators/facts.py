"""Facts of games and persons and what is derived from them: rates, possessions, physical ratios, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.keys import made_attempted
from orderloom.functions.nulls import col, row_count, row_mean, sdiv
from orderloom.operators.stats import wmean

COUNTS = ("pts", "fga", "fgm", "tpa", "tpm", "fta", "ftm", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf")
TEAM_SUMS = ("minutes", "pts", "fga", "fgm", "fta", "oreb", "ast", "tov")
GAME_MINUTES = 200.0  # of five players
PLAUSIBLE_MINUTES = (190.0, 300.0)


def possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    return fga - oreb + tov + 0.44 * fta


def mean_of_sides(own: Column, other: Column, fallback: Column) -> Column:
    """Mean of what both sides' boxes say, of the one that is there, or a fallback."""
    return F.coalesce(row_mean(own, other), fallback)


def true_shooting(pts: Column, fga: Column, fta: Column) -> Column:
    tried = fga + 0.44 * fta
    return F.when(tried > 0, pts / (2 * tried))


def effective_goals(fgm: Column, tpm: Column, fga: Column) -> Column:
    return F.when(fga > 0, (fgm + 0.5 * tpm) / fga)


def usage(load: Column, team_load: Column, minutes: Column, team_minutes: Column) -> Column:
    return F.when((minutes > 0) & (team_load > 0), 100 * load * (team_minutes / 5) / (minutes * team_load))


def assist_share(ast: Column, fgm: Column, team_fgm: Column, minutes: Column, team_minutes: Column) -> Column:
    others = minutes / (team_minutes / 5) * team_fgm - fgm
    return F.when(others > 0, 100 * ast / others)


def game_score(c: dict[str, Column]) -> Column:
    """The published weights of a box line."""
    return (
        c["pts"] + 0.4 * c["fgm"] - 0.7 * c["fga"] - 0.4 * (c["fta"] - c["ftm"]) + 0.7 * c["oreb"] + 0.3 * c["dreb"] + c["stl"] + 0.7 * c["ast"] + 0.7 * c["blk"] - 0.4 * c["pf"] - c["tov"]
    )


def player_game(box: DataFrame, team_box: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per player and game with rates, possessions, side and the margin.

    box: season, game_id, athlete_id, team_id, opp_team_id, side ("home" or other), dnp, minutes,
    team_score, opp_score and COUNTS. team_box: game_id, team_id, fga, oreb, tov, fta, a row for each
    team of a game. schedule: game_id, neutral. Rows that repeat a player in a game must not be there.
    """
    n = {c: F.col(c).cast("double") for c in COUNTS}
    played = ~F.coalesce("dnp", F.lit(False)) & F.coalesce(F.col("minutes") > 0, F.lit(False))
    team = Window.partitionBy("game_id", "team_id")
    rows = box.withColumns({**n, "played": played}).withColumn("gs", game_score({k: F.col(k) for k in COUNTS}))
    rows = rows.withColumn("gs36", F.when(F.col("played"), F.col("gs") / F.col("minutes") * 36))
    level = rows.filter("played and minutes >= 1").groupBy("season").agg(wmean("gs36", "minutes").alias("_level"))  # one row a season, from the box alone
    sums = {f"tm_{c}": F.sum(F.when(F.col("played"), F.col(c))).over(team) for c in TEAM_SUMS}
    rows = rows.withColumns(sums)
    low, high = PLAUSIBLE_MINUTES
    rows = rows.withColumn("tm_min", F.when(F.col("tm_minutes").between(low, high), F.col("tm_minutes")).otherwise(GAME_MINUTES))
    poss = team_box.select("game_id", "team_id", possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta")).alias("poss"))
    # both sides come by one join on the game, so that wide rows are sent once and not by each key in turn
    sides = poss.filter("team_id is not null").groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("team_id", "poss"))).alias("_sides"))
    rows = rows.join(sides, "game_id", "left").withColumns({"_own": F.try_element_at("_sides", "team_id"), "_opp": F.try_element_at("_sides", "opp_team_id")}).drop("_sides")
    rows = rows.join(schedule.select("game_id", "neutral"), "game_id", "left")
    c = {k: F.col(k) for k in COUNTS}
    load = c["fga"] + 0.44 * c["fta"] + c["tov"]
    team_load = F.col("tm_fga") + 0.44 * F.col("tm_fta") + F.col("tm_tov")
    minutes = F.when(F.col("played"), F.col("minutes"))
    rows = rows.withColumns({
        "tm_poss": mean_of_sides(F.col("_own"), F.col("_opp"), possessions(F.col("tm_fga"), F.col("tm_oreb"), F.col("tm_tov"), F.col("tm_fta"))),
        "home": F.when(F.coalesce("neutral", F.lit(False)), 0).when(F.col("side") == "home", 1).otherwise(-1),
        "ts": true_shooting(c["pts"], c["fga"], c["fta"]), "efg": effective_goals(c["fgm"], c["tpm"], c["fga"]), "poss_share": F.when(team_load > 0, load / team_load),
        "usg": usage(load, team_load, minutes, F.col("tm_min")), "ast_pct": assist_share(c["ast"], c["fgm"], F.col("tm_fgm"), minutes, F.col("tm_min")),
        "tov_pct": F.when(load > 0, 100 * c["tov"] / load), "margin": (F.col("team_score") - F.col("opp_score")).cast("double"),
    })
    rows = rows.join(F.broadcast(level), "season", "left").withColumn("gbpm", F.col("gs36") - F.col("_level"))
    return rows.drop("_own", "_opp", "_level", "neutral")


def league_scores(df: DataFrame, by: list[str], columns: list[str], prefix: str = "iz_") -> DataFrame:
    """df with each column's distance from its league and season's mean in sample deviations; none where nothing varies."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"{prefix}{c}": sdiv(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))) for c in columns})


def young(df: DataFrame, age: str, columns: list[str], at: float = 22.0) -> DataFrame:
    """df with each column times the years that a person lacks to an age."""
    lack = F.when(F.col(age).isNotNull(), F.greatest(at - F.col(age), F.lit(0.0)))
    return df.withColumns({c.replace("iz_", "iz_young_x_"): F.col(c) * lack for c in columns})


def physique(df: DataFrame, height: str, wing: str, reach: str, weight: str, fat: str, standing: str, running: str) -> DataFrame:
    """df with ratios and masses of a person's measures; a height of 0 is none."""
    h = F.nullif(F.col(height).cast("double"), F.lit(0.0))
    w, f = F.col(weight), F.col(fat)
    out = {
        "wing_minus_height": F.col(wing) - F.col(height), "reach_minus_height": F.col(reach) - F.col(height), "wing_ratio": F.col(wing) / h, "reach_ratio": F.col(reach) / h, "weight_per_inch": w / h,
        "bmi_like": 703 * w / (h * h), "lean_mass": w * (1 - f / 100), "fat_mass": w * f / 100, "lean_ratio": w * (1 - f / 100) / h, "run_up_gain": F.col(running) - F.col(standing),
        "max_touch": F.col(reach) + F.col(running), "standing_touch": F.col(reach) + F.col(standing), "measures": row_count(height, wing, reach, weight, fat), "drills": row_count(standing, running),
    }
    return df.withColumns(out)


def with_train_scores(df: DataFrame, train: Column, columns: list[str], prefix: str = "z_") -> DataFrame:
    """df with distances from the training rows' means in their deviations (1 where they do not vary): one row of statistics, as literals."""
    own = df.filter(train).agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_samp, "s")))).first()
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(own[f"m{i}"])) / F.lit(own[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def interactions(df: DataFrame, train: Column, free: str, threes: str, volume: str, projected: str, age: str) -> DataFrame:
    """df with products and sums of shooting measures and of age, in training deviations."""
    z = with_train_scores(df, train, [free, volume, projected, age], "_z")
    shoot = F.col(f"_z{free}") + F.col(f"_z{volume}")
    out = {
        "x_free_volume": F.col(free) * F.col(volume), "x_projected_volume": F.col(projected) * F.col(volume), "x_free_gap": F.col(free) - F.col(threes), "x_shoot": shoot + F.col(f"_z{projected}"),
        "x_age_shoot": -F.col(f"_z{age}") * shoot, "x_old_shooter": (F.coalesce((F.col(age) >= 21.5) & (F.col(free) >= 0.78) & (F.col(volume) >= 4), F.lit(False))).cast("double"),
    }
    return z.withColumns(out).drop(*(f"_z{c}" for c in (free, volume, projected, age)))


def joined_text(columns: list[str], least: int = 40, between: str = " ") -> Column:
    """Texts in a row, or NULL if they are together no longer than ``least`` characters."""
    out = F.concat_ws(between, *map(F.col, columns))
    return F.when(F.length(out) > least, out)


def shrunk_share(made: Column | str, tried: Column | str, level: float, worth: float) -> Column:
    """A share pulled to a level that is worth some tries."""
    return sdiv(col(made) + level * worth, col(tried) + worth)


def combine(df: DataFrame, measures: dict[str, str], shots: list[str]) -> DataFrame:
    """df with all columns of a day of measuring: ratios to height, masses, jumps, counts and the pooled share of shooting drills.

    measures: columns of height, wing, reach, weight, fat, hand_length, hand_width, standing, running,
    lane, shuttle, sprint and bench. shots: cells as ``12-25``; cells of another form count as none
    taken, and without a try the share is NULL. A height of 0 is none.
    """
    m = {k: F.col(c).cast("double") for k, c in measures.items()}
    out = physique(df, *(measures[k] for k in ("height", "wing", "reach", "weight", "fat", "standing", "running")))
    h = F.nullif(m["height"], F.lit(0.0))
    cells = [made_attempted(c) for c in shots]
    made, tried = (sum((F.coalesce(c[i], F.lit(0.0)) for c in cells), F.lit(0.0)) for i in (0, 1))
    body, drills = ("height", "wing", "reach", "weight", "fat", "hand_length", "hand_width"), ("standing", "running", "lane", "shuttle", "sprint", "bench")
    return out.withColumns({
        "hand_length_ratio": m["hand_length"] / h, "hand_width_ratio": m["hand_width"] / h, "shoot_pct": sdiv(made, tried),
        "measures": row_count(*(measures[k] for k in body)), "drills": row_count(*(measures[k] for k in drills)),
    })


def box_rates(columns: list[str], prefix: str, games: str = "g", minutes: str = "mp") -> dict[str, Column]:
    """Columns of what totals give by game, by 36 minutes and by try; a total that is not among ``columns`` has no rate.

    Totals: pts, trb, orb, ast, stl, blk, tov, pir, fg, fga, fg3, fg3a, ft, fta.
    """
    x = lambda n: F.col(n).cast("double")
    g, per36 = x(games), lambda v: 36 * sdiv(v, x(minutes))
    out = {"gp": g, "mpg": sdiv(x(minutes), g)}
    for n in ("pts", "trb", "ast", "stl", "blk", "tov", "pir"):
        out |= {f"{n}_pg": sdiv(x(n), g), f"{n}_36": per36(x(n))} if n in columns else {}
    out |= {f"{n}_36": per36(x(n)) for n in ("orb", "fga", "fg3a", "fta") if n in columns}
    shares = {"fg_pct": ("fg", "fga"), "fg3_pct": ("fg3", "fg3a"), "ft_pct": ("ft", "fta"), "fg3a_rate": ("fg3a", "fga"), "fta_rate": ("fta", "fga"), "ast_tov": ("ast", "tov")}
    out |= {n: sdiv(x(a), x(b)) for n, (a, b) in shares.items() if a in columns and b in columns}
    if {"pts", "fga", "fta"} <= set(columns):
        out["ts"] = true_shooting(x("pts"), x("fga"), x("fta"))
    if {"fg", "fg3", "fga"} <= set(columns):
        out["efg"] = sdiv(x("fg") + 0.5 * x("fg3"), x("fga"))
    if {"pts", "trb", "ast", "stl", "blk", "tov", "fg", "fga", "ft", "fta"} <= set(columns):
        eff = sum((x(n) for n in ("pts", "trb", "ast", "stl", "blk", "fg", "ft")), F.lit(0.0)) - x("fga") - x("fta") - x("tov")
        out |= {"eff_pg": sdiv(eff, g), "eff_36": per36(eff)}
    return {f"{prefix}{n}": c for n, c in out.items()}
