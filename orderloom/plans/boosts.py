"""Boosted models of cohorts: values with monotone features and recency, quantiles, chances, expected development."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import boosting, models
from orderloom.plans.base import MEMBERS, SUPPLIER_YEARS, Book, member_values, pct_sql, rounded, supplier_years
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql

FEATURES = ["balance", "nation"]
EDGES = [[float(x) for x in range(-500, 9501, 1000)], [4.0, 9.0, 14.0, 19.0]]
COHORTS = [1996, 1997, 1998]


def stumps_sql(objective: str, features: list[str], edges: list[list[float]], *, rounds: int, signs: tuple[int, ...], rate: float, least: float, penalty: float = 1.0, alpha: float = 0.5, at: str = "") -> str:
    """CTEs from ``{at}z`` (rid, model, y, w, features; w NULL: a row to be scored only) to ``{at}out`` (rid, model, f)."""
    base = {"squared": "sum(w * y) / sum(w)", "logistic": "ln(greatest(sum(w * y) / sum(w), 1e-6) / greatest(1 - sum(w * y) / sum(w), 1e-6))", "quantile": f"quantile_disc(y, {alpha})"}[objective]
    g = {"squared": "w * (f - y)", "logistic": "w * (1 / (1 + exp(-f)) - y)", "quantile": f"w * CASE WHEN f >= y THEN {1 - alpha} ELSE {-alpha} END"}[objective]
    h = "w / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f)))" if objective == "logistic" else "w"
    bins = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + {' + '.join(f'({c} > {e})::INT' for e in own)} END AS b{j}" for j, (c, own) in enumerate(zip(features, edges, strict=True)))
    cuts = " UNION ALL ".join(f"SELECT {j} AS feature, unnest(range(1, {len(e) + 2})) AS cut, {s} AS sign" for j, (e, s) in enumerate(zip(edges, signs, strict=True)))
    out = [
        f"{at}base AS (SELECT model, {base} AS f FROM {at}z WHERE w > 0 GROUP BY 1)", f"{at}f0 AS (SELECT z.rid, z.model, y, w, {bins}, f FROM {at}z z JOIN {at}base USING (model))",
        f"{at}cuts AS (SELECT * FROM ({cuts}), (SELECT unnest([true, false]) AS m))",
    ]
    worth = lambda a, b, w: f"-(2 * {a} * {w} + ({b} + {penalty}) * {w} * {w})"
    for r in range(rounds):
        own = " UNION ALL ".join(f"SELECT model, {j} AS feature, b{j} AS bin, g, h, w FROM {at}g{r}" for j in range(len(features)))
        side = " ".join(f"WHEN {j} THEN b{j}" for j in range(len(features)))
        leaf = f"quantile_disc(y - f, {alpha})" if objective == "quantile" else f"-sum(g) / (sum(h) + {penalty})"
        out += [
            f"{at}g{r} AS (SELECT *, {g} AS g, {h} AS h FROM {at}f{r} WHERE w > 0)", f"{at}h{r} AS (SELECT model, feature, bin, sum(g) AS g, sum(h) AS h, sum(w) AS w FROM ({own}) GROUP BY ALL)",
            f"{at}c{r} AS (SELECT model, feature, cut, m, sign, " + ", ".join(f"coalesce(sum({x}) FILTER (CASE WHEN bin = 0 THEN m ELSE bin <= cut END), 0) AS l{x}, coalesce(sum({x}) FILTER (NOT CASE WHEN bin = 0 THEN m ELSE bin <= cut END), 0) AS r{x}" for x in "ghw") + f" FROM {at}h{r} JOIN {at}cuts USING (feature) GROUP BY ALL)",
            f"{at}d{r} AS (SELECT *, -lg / (lh + {penalty}) AS a, -rg / (rh + {penalty}) AS b, -(lg + rg) / (lh + rh + {penalty}) AS p FROM {at}c{r} WHERE lw >= {least} AND rw >= {least})",
            f"{at}e{r} AS (SELECT *, {worth('(lg + rg)', '(lh + rh)', 'p')} AS parent, {worth('lg', 'lh', 'a')} + {worth('rg', 'rh', 'b')} - ({worth('(lg + rg)', '(lh + rh)', 'p')}) AS gain FROM {at}d{r} WHERE sign * (b - a) >= 0)",
            f"{at}t{r} AS (SELECT model, feature, cut, m FROM (SELECT *, max(gain) OVER (PARTITION BY model) AS top FROM {at}e{r}) WHERE top > 1e-9 * greatest(1, abs(parent)) AND gain >= top * (1 - 1e-9) QUALIFY row_number() OVER (PARTITION BY model ORDER BY feature, cut, m DESC) = 1)",
            f"{at}s{r} AS (SELECT x.*, feature, CASE WHEN feature IS NULL THEN false WHEN (CASE feature {side} END) = 0 THEN NOT m ELSE (CASE feature {side} END) > cut END AS side FROM {at}f{r} x LEFT JOIN {at}t{r} USING (model))",
            f"{at}v{r} AS (SELECT model, side, {leaf} AS v FROM (SELECT *, {g} AS g, {h} AS h FROM {at}s{r}) WHERE w > 0 AND feature IS NOT NULL GROUP BY 1, 2)",
            f"{at}f{r + 1} AS (SELECT s.rid, s.model, y, w, {', '.join(f'b{j}' for j in range(len(features)))}, f + {rate} * coalesce(v, 0) AS f FROM {at}s{r} s LEFT JOIN {at}v{r} USING (model, side))",
        ]
    return ", ".join([*out, f"{at}out AS (SELECT rid, model, f FROM {at}f{rounds} WHERE w IS NULL)"])


def _members(spark, d):
    """(cohort, entity, value, balance, nation), some features missing."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    x = member_values(spark, d).join(c, F.col("entity") == F.col("c_custkey"))
    return x.select("cohort", "entity", "value", F.when(F.col("entity") % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("entity") % 5 != 0, F.col("c_nationkey").cast("double")).alias("nation"))


_X = f"{MEMBERS}, x AS (SELECT cohort, entity, value, CASE WHEN entity % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN entity % 5 <> 0 THEN c_nationkey::DOUBLE END AS nation FROM v JOIN customer ON entity = c_custkey)"


def _z(y: str, weight: str) -> str:
    """Rows of the cohorts before each one as training rows, its own rows to be scored."""
    models_ = f"(SELECT unnest({COHORTS}) AS model)"
    return f"z AS (SELECT entity AS rid, model, {y} AS y, {weight} AS w, balance, nation FROM x, {models_} WHERE cohort < model AND value IS NOT NULL UNION ALL SELECT entity, cohort, NULL, NULL, balance, nation FROM x WHERE cohort IN ({', '.join(map(str, COHORTS))}))"


@book.query(f"WITH {_X}, {_z('value', 'pow(0.5, (model - 1 - cohort) / 2.0)')}, {stumps_sql('squared', FEATURES, EDGES, rounds=3, signs=(1, 0), rate=0.3, least=8)} SELECT model AS cohort, rid AS entity, round(f, 2) AS score FROM out")
def boosted_values(spark, d):
    """Each cohort scored by trees grown on the cohorts before it, weights halved each two years, never lower for a larger balance."""
    x = _members(spark, d)
    fits = boosting.causal_fits(x, FEATURES, "value", "cohort", COHORTS, half_life=2.0, monotone={"balance": 1}, edges=EDGES, rounds=3, depth=1, rate=0.3)
    return rounded(boosting.scored(x.filter(F.col("cohort").isin(COHORTS)), fits, "cohort").select("cohort", "entity", "score"), 2)


@book.query(f"WITH {_X}, {_z('value', '1.0')}, {stumps_sql('quantile', FEATURES, EDGES, rounds=2, signs=(0, -1), rate=0.5, least=8, alpha=0.8)} SELECT model AS cohort, rid AS entity, round(f, 2) AS score FROM out")
def boosted_quantile(spark, d):
    """M3: the value that four of five stay below."""
    x = _members(spark, d)
    fits = boosting.causal_fits(x, FEATURES, "value", "cohort", COHORTS, objective="quantile", alpha=0.8, monotone={"nation": -1}, edges=EDGES, rounds=2, depth=1, rate=0.5)
    return rounded(boosting.scored(x.filter(F.col("cohort").isin(COHORTS)), fits, "cohort").select("cohort", "entity", "score"), 2)


@book.query(f"""WITH {_X}, {_z('(value > 150000)::INT', '1.0')}, {stumps_sql('logistic', FEATURES, EDGES, rounds=3, signs=(0, 0), rate=0.3, least=8)},
vz AS (SELECT entity AS rid, model, value AS y, 1.0 AS w, balance, nation FROM x, (SELECT unnest({COHORTS}) AS model) WHERE cohort < model UNION ALL SELECT entity, cohort, NULL, NULL, balance, nation FROM x WHERE cohort IN ({', '.join(map(str, COHORTS))})),
{stumps_sql('squared', FEATURES, EDGES, rounds=3, signs=(0, 0), rate=0.3, least=8, at='v')}, j AS (SELECT o.model AS cohort, rid AS entity, 1 / (1 + exp(-o.f)) AS chance, round(vout.f, 6) AS value FROM out o JOIN vout USING (rid, model))
SELECT cohort, entity, round(chance, 6) AS chance, round(chance * ({pct_sql('value', 'cohort')}), 6) AS score FROM j""")
def boosted_hurdle(spark, d):
    """M9: the chance of a large value by a boosted classifier, times the rank of the expected one."""
    from orderloom.operators import windows

    x = _members(spark, d).withColumn("played", (F.col("value") > 150000).cast("double"))
    own = x.filter(F.col("cohort").isin(COHORTS))
    how = {"edges": EDGES, "rounds": 3, "depth": 1, "rate": 0.3}
    chance = boosting.causal_fits(x, FEATURES, "played", "cohort", COHORTS, objective="logistic", **how)
    value = boosting.causal_fits(x, FEATURES, "value", "cohort", COHORTS, **how)
    both = boosting.scored(boosting.scored(own, chance, "cohort", "chance"), value, "cohort", "expected").withColumn("expected", F.round("expected", 6))
    ranked = windows.with_pct_ranks(both, ["cohort"], {"pct": "expected"})
    return rounded(ranked.select("cohort", "entity", "chance", (F.col("chance") * F.col("pct")).alias("score")))


@book.query()
def boosted_deep_fit(spark, d):
    """M3 with trees of three levels and bins at quantiles, every cohort behind the training ones."""
    x = _members(spark, d)
    own = boosting.fit(x.filter("cohort <= 1996"), FEATURES, "value", monotone={"balance": 1}, rounds=6, depth=3, rate=0.3)
    return rounded(x.filter("cohort > 1996").select("cohort", "entity", own.column().alias("score")), 2)


# -- expected development --------------------------------------------------------------------

PROFILE = ["qty", "lines"]
PROFILE_EDGES = [[float(x) for x in range(200, 3001, 200)], [float(x) for x in range(10, 131, 10)]]
YEARS = [1997, 1998]
_DEVELOPMENT = {"rounds": 2, "depth": 1, "rate": 0.5, "least": 8.0}


def _development_sql() -> str:
    how = {"rounds": 2, "signs": (0, 0), "rate": 0.5, "least": 8.0}
    years = f"(SELECT unnest({YEARS}) AS model)"
    parts, cols = [], []
    for at, target, gap in (("a", "qty", 1), ("b", "revenue", 1), ("c", "qty", 2)):
        train = f"SELECT s.supp AS rid, model, n.{target} - s.{target} AS y, 1.0 AS w, s.qty::DOUBLE AS qty, s.lines::DOUBLE AS lines FROM s JOIN s n ON n.supp = s.supp AND n.year = s.year + {gap}, {years} WHERE s.year + {gap} <= model"
        own = f"SELECT supp, year, NULL, NULL, qty::DOUBLE, lines::DOUBLE FROM s WHERE year IN ({', '.join(map(str, YEARS))})"
        if at == "a":  # the season before, for the surprise
            own += f" UNION ALL SELECT s.supp + 1000000000, s.year, NULL, NULL, p.qty::DOUBLE, p.lines::DOUBLE FROM s JOIN s p ON p.supp = s.supp AND p.year = s.year - 1 WHERE s.year IN ({', '.join(map(str, YEARS))})"
        parts.append(f"{at}z AS ({train} UNION ALL {own}), {stumps_sql('squared', PROFILE, PROFILE_EDGES, at=at, **how)}")
        cols.append(f"round({at}out.f, 2)")
    return f"""WITH {SUPPLIER_YEARS}, {', '.join(parts)}
SELECT s.supp, s.year, {cols[0]} AS dv_qty, {cols[1]} AS dv_revenue, {cols[2]} AS dv_qty2, round(qty + aout.f, 2) AS dv_qty_next, round(s.qty - p.qty - e.f, 2) AS dv_surprise
FROM s JOIN aout ON aout.rid = s.supp AND aout.model = s.year JOIN bout ON bout.rid = s.supp AND bout.model = s.year JOIN cout ON cout.rid = s.supp AND cout.model = s.year
LEFT JOIN (SELECT supp, year, qty FROM s) p ON p.supp = s.supp AND p.year = s.year - 1 LEFT JOIN aout e ON e.rid = s.supp + 1000000000 AND e.model = s.year""".replace("round(qty + aout.f", "round(s.qty + aout.f")


@book.query(_development_sql())
def expected_development(spark, d):
    """For each year and target a fit on the changes known by then; what is expected next, two years on, and how the last change differs from what was expected."""
    s = supplier_years(spark, d)
    out = models.expected_changes(s, "supp", "year", PROFILE, {"dv_qty": "qty", "dv_revenue": "revenue"}, {"dv_qty2": "qty"}, "qty", YEARS, edges=PROFILE_EDGES, **_DEVELOPMENT)
    return rounded(out.select("supp", "year", "dv_qty", "dv_revenue", "dv_qty2", (F.col("qty") + F.col("dv_qty")).alias("dv_qty_next"), F.col("surprise").alias("dv_surprise")), 2)
