"""Aggregates in closed form: every fit is one pass of sums that combine before the shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr, col, sdiv
from orderloom.operators.lineage import cut, cut_by, kept, ship
from orderloom.operators.windows import cuts_of, looked_up, ranked, with_below


def wmean(x: Column | str, w: Column | str) -> Column:
    x, w = col(x), col(w)
    return sdiv(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def wmean_se(x: Column | str, w: Column | str) -> Column:
    """Standard error of a weighted mean: sqrt(sum w^2 (x - m)^2) / sum w, expanded into sums."""
    x, w = col(x), col(w)
    own = F.when(x.isNotNull(), w)
    m = wmean(x, w)
    square = F.sum(own * own * x * x) - 2 * m * F.sum(own * own * x) + m * m * F.sum(own * own)
    return sdiv(F.sqrt(F.greatest(square, F.lit(0.0))), F.sum(own))


def ratio(a: Column | str, b: Column | str) -> Column:
    return sdiv(F.sum(col(a)), F.sum(col(b)))


def hhi(x: Column | str) -> Column:
    return sdiv(F.sum(col(x) * col(x)), F.sum(col(x)) * F.sum(col(x)))


def wls(x: Column | str, y: Column | str, w: Column | float = 1.0) -> tuple[Column, Column]:
    """(slope, intercept) of weighted least squares from five sums."""
    x, y = col(x), col(y)
    w = F.when(x.isNotNull() & y.isNotNull(), F.lit(w) if isinstance(w, (int, float)) else w)
    sw, sx, sy, sxy, sxx = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * y), F.sum(w * x * x)
    slope = sdiv(sw * sxy - sx * sy, sw * sxx - sx * sx)
    return slope, sdiv(sy - slope * sx, sw)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): rank correlation of rows where both are present."""
    rows = ranked(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_u"), F.col(y).alias("_v")), by, {"_x": "_u", "_y": "_v"})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), corr("_x", "_y").alias("rho"))


def beta_prior(p: Column | str, sample: bool = True) -> tuple[Column, Column]:
    """(a, b) of a beta distribution by the method of moments. sample: which variance, of n - 1 or of n."""
    m, v = F.avg(col(p)), (F.var_samp if sample else F.var_pop)(col(p))
    size = sdiv(m * (1 - m), v) - 1
    return F.when((v > 0) & (size > 0), m * size), F.when((v > 0) & (size > 0), (1 - m) * size)


def polyfit(df: DataFrame, x: str, y: str, degree: int, weight: str | None = None) -> tuple[list[float], float]:
    """(coefficients from the constant up, residual deviation) by moments; the driver solves one small system."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & w.isNotNull())
    xs = [F.sum(w * F.pow(F.col(x), F.lit(k))).alias(f"x{k}") for k in range(2 * degree + 1)]
    ys = [F.sum(w * F.pow(F.col(x), F.lit(k)) * F.col(y)).alias(f"y{k}") for k in range(degree + 1)]
    s = rows.agg(*xs, *ys, F.sum(w * F.col(y) * F.col(y)).alias("yy")).first()
    if s["x0"] is None:
        return [], float("nan")
    a = np.array([[s[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    b = np.array([s[f"y{i}"] for i in range(degree + 1)])
    c = np.linalg.lstsq(a, b, rcond=None)[0]
    return c.tolist(), float(np.sqrt(max(0.0, (s["yy"] - 2 * c @ b + c @ a @ c) / s["x0"])))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, distinct): one pass over df, then unpivoted."""
    wide = df.agg(*(F.struct((F.count(c) / F.count(F.lit(1))).alias("p"), F.count_distinct(c).alias("d")).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.p").alias("present"), F.col(f"{c}.d").alias("distinct")) for c in columns)))
    return wide.select(rows.alias("r")).select("r.*")


#: Ranges that a column's values are dealt to in ``screen``.
SCREEN_RANGES = 64


def screen(df: DataFrame, columns: list[str], target: str, by: str) -> DataFrame:
    """(column, n, rho): rank correlations with a target (a number) within cohorts, weighted by their sizes.

    Each column counts the rows where it and the target are present. Values are counted before they
    are sent, and ranks belong to distinct values: those of the columns are looked up by the rows, which
    then are added up for each value of the target, so no task holds a cohort or all rows of a value.
    df is read five times.
    """
    each = range(len(columns))
    rows = df.select(F.col(by).alias("g"), F.col(target).alias("t"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).filter("t is not null")
    # ranks less their mean, which are multiples of a half
    rank = lambda n: F.col(f"{n}_below") + (F.col(n) - F.col(f"{n}_all")) / 2.0
    long = rows.select("g", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("x")) for i in each)))).filter("x is not null")
    counts = kept(long.groupBy("g", "i", "x").agg(F.count("*").alias("n")))
    ranks = kept(with_below(counts, ["g", "i"], "x", ["n"], cuts_of(counts, "x", SCREEN_RANGES)).select("g", "i", "x", rank("n").alias("r"), "n"))
    spreads = cut(ranks.groupBy("g", "i").agg(F.sum(F.col("n") * F.col("r") * F.col("r")).alias("xx")))
    met = rows
    for i in each:
        met = looked_up(met, ranks.filter(F.col("i") == i).select("g", F.col("x").alias(f"c{i}"), F.col("r").alias(f"r{i}")), ["g", f"c{i}"])
    told = met.groupBy("g", "t").agg(*(v for i in each for v in (F.count(f"r{i}").alias(f"n{i}"), F.coalesce(F.sum(f"r{i}"), F.lit(0.0)).alias(f"x{i}"))))
    sizes = rows.select("g", "t", *(F.col(f"c{i}").isNotNull().cast("long").alias(f"n{i}") for i in each))
    placed = with_below(told, ["g"], "t", [f"n{i}" for i in each], cuts_of(rows.select("t"), "t", SCREEN_RANGES), sizes)
    sums = placed.groupBy("g").agg(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.sum(f"n{i}").alias("n"), F.sum(F.col(f"x{i}") * rank(f"n{i}")).alias("xy"), F.sum(F.col(f"n{i}") * rank(f"n{i}") * rank(f"n{i}")).alias("yy")).alias(f"s{i}") for i, c in enumerate(columns)))
    both = looked_up(sums.select("g", F.inline(F.array(*(f"s{i}" for i in each)))), spreads, ["g", "i"])
    rho = F.try_divide(F.col("xy"), F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0)))
    known = both.withColumn("rho", rho).filter("rho is not null")
    return known.groupBy("column").agg(F.sum("n").alias("n"), sdiv(F.sum(F.col("n") * F.col("rho")), F.sum("n")).alias("rho"))


def global_rank(df: DataFrame, x: str, parts: int = 64) -> DataFrame:
    """(x, rank): average rank of each distinct value over all rows, without one window over the table.

    Values are dealt to ranges by approximate quantiles (at most parts doubles, on the driver); a
    range's own order and the counts of the ranges below give the exact rank.
    """
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(x, cuts, 1000)).first()[0] or [])) if cuts else []
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(x))) if bounds else F.lit(0)
    counts = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n")).withColumn("_r", at)
    totals = counts.groupBy("_r").agg(F.sum("_n").alias("_t"))  # parts rows at most
    below = totals.withColumn("_o", F.sum("_t").over(Window.partitionBy(F.lit(1)).orderBy("_r")) - F.col("_t")).select("_r", "_o")
    own = F.sum("_n").over(Window.partitionBy("_r").orderBy(x))
    return counts.join(F.broadcast(below), "_r").select(x, (F.col("_o") + own - (F.col("_n") - 1) / 2.0).alias("rank"))


#: Pairs of sides that a block of ``_blocks`` should hold.
BLOCK_PAIRS = 250_000


def _blocks(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(j, ua, ub, ia, ib, n) and the number of dealings: the matrix of (a, b, n), a row for each ordered pair, in packed blocks.

    Sides are dealt by a hash, so a block holds the pairs of a deal of a and the deal ``j`` of b: its
    sides and, as bytes, their places and counts. Blocks stay in parts by ``j``, so that a round
    sends a number for each side to them and pairs are never sent again.
    """
    ship(pairs.sparkSession)
    k = max(1, math.ceil(math.sqrt(pairs.count() / BLOCK_PAIRS)))
    kind = pairs.schema["a"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        out = {"j": t["j"][:1]}
        for c in "ab":
            known, at = np.unique(t[c].to_numpy(), return_inverse=True)
            out |= {f"u{c}": pa.array([known.tolist()], pa.list_(t[c].type)), f"i{c}": pa.array([at.astype(np.int32).tobytes()], pa.binary())}
        return pa.table(out | {"n": pa.array([t["n"].to_numpy().astype(np.float64).tobytes()], pa.binary())}).select(["j", "ua", "ub", "ia", "ib", "n"])

    dealt = pairs.select(_deal("a", k).alias("i"), _deal("b", k).alias("j"), "a", "b", "n")
    packed = dealt.groupBy("i", "j").applyInArrow(pack, f"j int, ua array<{kind}>, ub array<{kind}>, ia binary, ib binary, n binary")
    # no fewer parts than a shuffle has, or a join would send the blocks to the other side's parts
    return cut_by(packed, "j", max(k, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), k


def _deal(c: str, k: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")


def _of_opponents(blocks: tuple[DataFrame, int], x: DataFrame) -> DataFrame:
    """(a, _np): the sum of the numbers (a, p) of a side's opponents, each as often as they met."""
    rows, k = blocks
    kind = x.schema["a"].dataType.simpleString()
    sent = x.groupBy(_deal("a", k).alias("j")).agg(F.array_sort(F.collect_list(F.struct("a", "p"))).alias("s")).select("j", F.col("s.a").alias("sa"), F.col("s.p").alias("sp"))

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ua, ub, sa, sp = (batch.column(c)[r].values for c in ("ua", "ub", "sa", "sp"))
                ia, ib, n = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("ia", np.int32), ("ib", np.int32), ("n", np.float64)))
                known, own = sa.to_numpy(zero_copy_only=False), ub.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                p = np.where(known[at] == own, sp.to_numpy(zero_copy_only=False)[at], 0.0)
                yield pa.RecordBatch.from_arrays([ua, pa.array(np.bincount(ia, n * p[ib], len(ua)))], ["a", "_np"])

    return rows.join(sent, "j").select("ua", "ub", "ia", "ib", "n", "sa", "sp").mapInArrow(multiply, f"a {kind}, _np double").groupBy("a").agg(F.sum("_np").alias("_np"))


def iterated_ratings(games: DataFrame, a: str, b: str, margin: str, rounds: int = 50, every: int = 10) -> DataFrame:
    """(a, r): a side's mean margin plus its opponents' ratings, over rounds; the mean is zero after each.

    Games with a side missing do not count. Pairs are counted once and held in packed blocks, see
    ``_blocks``.
    """
    g = games.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(margin).alias("m")).filter("a is not null and b is not null")
    pairs = kept(g.groupBy("a", "b").agg(F.sum("m").alias("m"), F.count("*").alias("n")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("m")).alias("m"), "n"))
    blocks, sides = _blocks(both), cut(both.groupBy("a").agg(F.sum("m").alias("m"), F.sum("n").alias("n")))
    r = sides.select("a", F.lit(0.0).alias("r"))
    for i in range(1, rounds + 1):
        r = cut(sides.join(_of_opponents(blocks, r.select("a", F.col("r").alias("p"))), "a").select("a", ((F.col("m") + F.col("_np")) / F.col("n")).alias("r")))
        if i % every == 0 or i == rounds:
            # every side has a game, so taking a constant off all ratings takes the same off the next round's: the mean may go every few rounds
            r = r.withColumn("r", F.col("r") - F.lit(r.agg(F.avg("r")).first()[0]))
    return r


def wls_fit(df: DataFrame, by: list[str], y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """(by, n, coefficients, errors): weighted least squares of each group with an intercept, which comes first.

    Groups are reduced to their means and then to moments about them by aggregates that combine
    before a shuffle; small systems are solved many at a time in Arrow batches. NULL where a group has no more rows than coefficients, or columns
    that depend on one another.
    """
    ship(df.sparkSession)
    p = len(xs)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, w.alias("_w"), F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)))
    rows = rows.filter(" and ".join(f"{c} is not null" for c in ("_w", "_y", *(f"_x{i}" for i in range(p)))) + " and _w > 0")
    values = [*(f"_x{i}" for i in range(p)), "_y"]
    means = rows.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(*((F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m{c}") for c in values))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    rows = rows.join(means, same or [F.lit(True)]).drop(*(f"_b{i}" for i in range(len(by))))  # a join splits a hot group
    centred = {c: F.col(c) - F.col(f"_m{c}") for c in values}
    cells = [F.sum(F.col("_w") * centred[a] * centred[b]) for i, a in enumerate(values) for b in values[i:]]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("_sw"), F.array(*(F.first(f"_m{c}") for c in values)).alias("_mean"), F.array(*cells).alias("_cell"))
    plain = sums.toDF(*(f"c{i}" for i in range(len(sums.columns))))
    k = len(by)
    kinds = ", ".join(f"`{b}` {sums.schema[b].dataType.simpleString()}" for b in by)

    def solve(batches):
        upper = np.triu_indices(p + 1)
        for batch in batches:
            n, sw = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
            means, cell = (np.stack(batch.column(k + j).to_numpy(zero_copy_only=False)) for j in (2, 3))
            m = np.zeros((len(n), p + 1, p + 1))
            m[:, upper[0], upper[1]] = cell
            m = m + np.triu(m, 1).transpose(0, 2, 1)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", m)[:, :p], 1e-300))
            a = m[:, :p, :p] / scale[:, :, None] / scale[:, None, :]  # correlations: their conditioning is that of the columns
            good = (n > p + 1) & (np.linalg.cond(np.where(np.isfinite(a), a, 0)) < 1e10) if p else n > 1
            back = np.zeros_like(a)
            back[good] = np.linalg.inv(a[good])
            back = back / scale[:, :, None] / scale[:, None, :]
            slope = np.einsum("nij,nj->ni", back, m[:, :p, p])
            start = means[:, p] - np.einsum("ni,ni->n", slope, means[:, :p])
            rest = np.maximum(m[:, p, p] - np.einsum("ni,ni->n", slope, m[:, :p, p]), 0)
            s2 = rest / np.maximum(n - p - 1, 1)
            error = np.sqrt(np.maximum(np.einsum("nii->ni", back), 0) * s2[:, None])
            first = np.sqrt((1 / sw + np.einsum("ni,nij,nj->n", means[:, :p], back, means[:, :p])) * s2)
            both = [np.column_stack((start, slope)), np.column_stack((first, error))]
            lists = [pa.array([r.tolist() if g else None for r, g in zip(x, good, strict=True)], pa.list_(pa.float64())) for x in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k + 1)), *lists], [*by, "n", "coefficients", "errors"])

    return plain.mapInArrow(solve, f"{kinds}, n long, coefficients array<double>, errors array<double>")


def ridge_ratings(games: DataFrame, home: str, away: str, margin: str, neutral: str, ridge: float = 1.0, least_games: int = 10, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """(team, r, games): ratings of margin = r_home - r_away + advantage by ridge least squares, with mean 0.

    The normal equations are solved by conjugate gradients: a step multiplies by counts of pairs,
    which are held in packed blocks (see ``_blocks``), whatever the number of teams; the home
    advantage is one number beside. Games with a side missing do not count.
    Teams with fewer games than ``least_games`` are left out at the end.
    """
    g = games.filter(F.col(margin).isNotNull()).select(F.col(home).alias("a"), F.col(away).alias("b"), F.col(margin).cast("double").alias("m"), F.when(F.coalesce(F.col(neutral), F.lit(False)), 0.0).otherwise(1.0).alias("h")).filter("a is not null and b is not null")
    pairs = kept(g.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("h").alias("h"), F.sum(F.col("h") * F.col("m")).alias("hm")))
    advantage = pairs.agg(F.sum("hm").alias("s"), F.sum("h").alias("n")).first()
    both = pairs.select("a", "b", "n", "m", "h").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", (-F.col("m")).alias("m"), (-F.col("h")).alias("h")))
    blocks, team = _blocks(both), cut(both.groupBy("a").agg(F.sum("n").alias("games"), F.sum("m").alias("s"), F.sum("h").alias("h")))
    # unknowns: a rating for each team (columns r, g, p) and the advantage (numbers); A is symmetric and positive
    state = team.select("a", "games", "h", F.lit(0.0).alias("r"), F.col("s").alias("g"), F.col("s").alias("p"))
    r0, g0 = 0.0, advantage["s"] or 0.0
    p0, weight0 = g0, (advantage["n"] or 0.0) + ridge
    size = (state.agg(F.sum(F.col("g") * F.col("g"))).first()[0] or 0.0) + g0 * g0
    start = size
    for _ in range(rounds):
        if size <= tolerance * tolerance * max(start, 1e-300):
            break
        # a round is computed once: the sums after it read what was kept
        state = cut(state.join(_of_opponents(blocks, state.select("a", "p")), "a").withColumn("q", (F.col("games") + ridge) * F.col("p") - F.col("_np") + F.col("h") * p0).drop("_np"))
        got = state.agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("h") * F.col("p")).alias("hp")).first()
        q0 = got["hp"] + weight0 * p0
        step = size / (got["pq"] + p0 * q0)
        r0, g0 = r0 + step * p0, g0 - step * q0
        state = state.withColumns({"r": F.col("r") + step * F.col("p"), "g": F.col("g") - step * F.col("q")}).drop("q")
        then = state.agg(F.sum(F.col("g") * F.col("g"))).first()[0] + g0 * g0
        state = state.withColumn("p", F.col("g") + (then / size) * F.col("p"))
        p0, size = g0 + then / size * p0, then
    last = state.filter(F.col("games") >= least_games)
    middle = last.agg(F.avg("r")).first()[0] or 0.0
    return last.select(F.col("a").alias("team"), (F.col("r") - middle).alias("r"), "games")


def by_group(df: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """Any function of a group's rows as an Arrow table; each group goes to one task, so give only groups of bounded size.

    What sums, ranks and windows can say should be said with those.
    """
    ship(df.sparkSession)
    return df.groupBy(*by).applyInArrow(work, schema)


def by_group_in_parts(df: DataFrame, by: list[str], partial, state: str, final, schema: str, *, part_rows: int = 1 << 16) -> DataFrame:
    """Any function of a group's rows that can be put together from parts, for groups of any size.

    partial: Arrow table of some of a group's rows to an Arrow table of (by, state columns), small;
    final: all of a group's states to its rows. A group of more than ``part_rows`` rows is dealt to
    as many parts, each of which is a task's; what meets in one task are states. state and schema
    name the columns that partial and final return.
    """
    ship(df.sparkSession)
    n = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > part_rows)
    large = n.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.ceil(F.col("_n") / part_rows).alias("_parts"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    dealt = df.join(large, same, "left").drop(*(f"_k{i}" for i in range(len(by))))
    # by the row's content: a random number would be drawn anew if a task is lost (rows equal in every column stay together, so give an id along where there are many)
    dealt = dealt.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*df.columns), F.col("_parts")))).drop("_parts")
    names = df.columns

    def work(t: pa.Table) -> pa.Table:
        return partial(t.select(names))

    return dealt.groupBy(*by, "_part").applyInArrow(work, state).groupBy(*by).applyInArrow(final, schema)


def transposed(df: DataFrame, key: str, columns: list[str], values: list) -> DataFrame:
    """(column, one column for each listed key): a report's rows and columns exchanged."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select(key, "e.*")
    return long.groupBy("column").pivot(key, values).agg(F.first("v"))


def beside(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column], by: list[str]) -> DataFrame:
    """Rows of two tables with the same place in their groups' orders, side by side; a place that only one has is filled with NULL."""
    place = lambda d, order: d.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return place(a, order_a).join(place(b, order_b), [*by, "_place"], "full").withColumnRenamed("_place", "place")
