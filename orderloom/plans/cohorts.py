"""Cohort ranking, labels, metrics and rules."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr, row_median
from orderloom.functions.numbers import shrink
from orderloom.operators import labels, metrics, rules, sampling, stats, windows
from orderloom.operators.lineage import kept
from orderloom.operators.pit import best_periods, first_periods
from orderloom.plans.base import MEMBERS, Book, member_values, pct_sql, rank_sql, rounded
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    return member_values(spark, d).join(c, F.col("entity") == F.col("c_custkey")).drop("c_custkey")


SCORED = f"WITH {MEMBERS}, x AS (SELECT v.*, c_acctbal, c_nationkey FROM v JOIN customer ON entity = c_custkey)"
#: Balances as a score, keys as a baseline order, and a board that lists some members.
BOARD = "CASE WHEN entity % 3 <> 0 THEN entity % 60 + 1.0 END"


@book.query(f"""{SCORED},
r AS (SELECT cohort, value, {rank_sql('value', 'cohort')} AS rv, {rank_sql('c_acctbal', 'cohort')} AS rs, {rank_sql('entity', 'cohort', True)} AS rb,
  row_number() OVER (PARTITION BY cohort ORDER BY c_acctbal DESC, entity) AS ko, row_number() OVER (PARTITION BY cohort ORDER BY entity) AS kt,
  row_number() OVER (PARTITION BY cohort ORDER BY value DESC, entity) AS kb FROM x),
g AS (SELECT cohort, count(*) AS n, corr(rs, rv) AS rho, corr(rb, rv) AS rho_base, sum(value) FILTER (ko <= 14) AS o, sum(value) FILTER (kt <= 14) AS t, sum(value) FILTER (kb <= 14) AS b FROM r GROUP BY cohort)
SELECT cohort, n, round(rho, 6) AS rho, round(rho_base, 6) AS rho_base, round(CASE WHEN b > t THEN 100 * (o - t) / (b - t) ELSE 0 END, 6) AS captured FROM g""")
def flagship_order_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a baseline and a challenger order, and value captured in the top 14."""
    x = _scored(spark, d).withColumn("order", -F.col("entity"))
    r = windows.ranked(x, ["cohort"], {"rv": "value", "rs": "c_acctbal", "rb": "order"})
    g = r.groupBy("cohort").agg(F.count("*").alias("n"), corr("rs", "rv").alias("rho"), corr("rb", "rv").alias("rho_base"))
    for name, order in (("o", F.desc("c_acctbal")), ("t", F.desc("order")), ("b", F.desc("value"))):  # limits before the shuffle
        top = windows.top_k(x, ["cohort"], [order, F.col("entity")], 14).groupBy("cohort").agg(F.sum("value").alias(name))
        g = g.join(top, "cohort")
    return rounded(g.select("cohort", "n", "rho", "rho_base", F.when(F.col("b") > F.col("t"), 100 * (F.col("o") - F.col("t")) / (F.col("b") - F.col("t"))).otherwise(0.0).alias("captured")))


@book.query(f"WITH {MEMBERS} SELECT cohort, entity, round({pct_sql('value', 'cohort')}, 6) AS pct FROM v")
def pct_rank_avg(spark, d):
    return rounded(windows.with_pct_ranks(member_values(spark, d), ["cohort"], {"pct": "value"}).select("cohort", "entity", "pct"))


@book.query(f"WITH {MEMBERS} SELECT cohort, entity, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z FROM v WINDOW w AS (PARTITION BY cohort)")
def class_zscore(spark, d):
    return rounded(windows.with_zscores(member_values(spark, d), ["cohort"], {"z": "value"}).select("cohort", "entity", "z"))


@book.query("""SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, round((s_acctbal - avg(s_acctbal) OVER w) / coalesce(nullif(stddev_samp(s_acctbal) OVER w, 0), 1), 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def league_zscore(spark, d):
    return rounded(windows.with_zscores(table(spark, d, "supplier"), ["s_nationkey"], {"z": "s_acctbal"}, guard=True).select("s_suppkey", "s_nationkey", "z"))


@book.query(f"WITH {MEMBERS}, p AS (SELECT *, {pct_sql('value', 'cohort')} AS pct FROM v) SELECT cohort, entity, least(floor(pct * 5), 4)::BIGINT AS bin FROM p")
def quantile_bins(spark, d):
    return rounded(windows.with_bins(member_values(spark, d), ["cohort"], "value", 5, "bin").select("cohort", "entity", "bin"))


def _ppf_sql(p: str) -> str:
    from orderloom.functions import numbers as n

    poly = lambda x, c: f"({'(' * len(c[1:])}{c[0]!r}" + "".join(f" * {x} + {k!r})" for k in c[1:]) + ")"
    q, r = f"({p} - 0.5::DOUBLE)", f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{poly(x, n.TAIL)} / {poly(x, n.TAIL_BELOW)}"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {n.TAIL_FROM} THEN {tail(lo)} WHEN {p} > 1 - {n.TAIL_FROM} THEN -({tail(hi)}) ELSE {q} * {poly(r, n.CENTRE)} / {poly(r, n.CENTRE_BELOW)} END"


@book.query(f"WITH {MEMBERS}, p AS (SELECT *, greatest(0.01, least(0.99, (({rank_sql('value', 'cohort')}) - 0.5) / count(value) OVER (PARTITION BY cohort)))::DOUBLE AS q FROM v) SELECT cohort, entity, round({_ppf_sql('q')}, 6) AS g FROM p")
def gauss_rank(spark, d):
    return rounded(windows.with_gauss_rank(member_values(spark, d), ["cohort"], "value", "g").select("cohort", "entity", "g"))


@book.query(f"WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v WHERE cohort <= 2000) SELECT entity, round(sum(value), 4) AS total, count(*) AS n FROM n WHERE k <= 3 GROUP BY entity")
def first_k_periods_sum(spark, d):
    return rounded(first_periods(member_values(spark, d), ["entity"], "cohort", "value", 3, through=2000), 4)


@book.query(f"WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, cohort) AS k FROM v) SELECT entity, round(avg(value), 4) AS best FROM n WHERE k <= 2 GROUP BY entity")
def best_k_mean(spark, d):
    return rounded(best_periods(member_values(spark, d), ["entity"], "cohort", "value", 2), 4)


@book.query(f"WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) - 1 AS k FROM v) SELECT entity, round(sum(value * pow(0.85::DOUBLE, k)), 4) AS total FROM n GROUP BY entity")
def discounted_sum(spark, d):
    return rounded(labels.discounted(member_values(spark, d), ["entity"], "cohort", "value"), 4)


for _how, _sql in {
    "rank": pct_sql("value", "cohort"),
    "zscore": "(value - avg(value) OVER (PARTITION BY cohort)) / coalesce(nullif(stddev_samp(value) OVER (PARTITION BY cohort), 0), 1)",
}.items():

    def _label(spark, d, how=_how):
        return rounded(member_values(spark, d).select("cohort", "entity", labels.transform("value", ["cohort"], how).alias("label")))

    book.query(f"WITH {MEMBERS} SELECT cohort, entity, round({_sql}, 6) AS label FROM v", f"label_{_how}")(_label)


@book.query(f"WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) - 1 AS k FROM v), t AS (SELECT entity, min(cohort) AS debut, round(sum(value * pow(0.85::DOUBLE, k)), 4) AS total FROM n GROUP BY entity) SELECT entity, debut, round({_ppf_sql('greatest(0.01, least(0.99, ((' + rank_sql('total', 'debut') + ') - 0.5) / count(total) OVER (PARTITION BY debut)))::DOUBLE')}, 6) AS label FROM t")
def label_disc85_gaussrank(spark, d):
    v = member_values(spark, d)
    t = labels.discounted(v, ["entity"], "cohort", "value").withColumn("total", F.round("total", 4)).join(v.groupBy("entity").agg(F.min("cohort").alias("debut")), "entity")
    return rounded(t.select("entity", "debut", labels.transform("total", ["debut"], "gaussrank").alias("label")))


for _h in range(1, 6):

    def _horizon(spark, d, h=_h):
        return rounded(first_periods(member_values(spark, d), ["entity"], "cohort", "value", h), 4)

    book.query(f"WITH {MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cohort) AS k FROM v) SELECT entity, round(sum(value), 4) AS total, count(*) AS n FROM n WHERE k <= {_h} GROUP BY entity", f"horizon_target_h{_h}")(_horizon)


@book.query(f"WITH {MEMBERS} SELECT cohort, entity, h AS horizon, count(*) OVER (PARTITION BY cohort, h) AS members FROM v, (SELECT unnest(range(1, 6)) AS h) WHERE h <= 2001 - cohort")
def horizon_stack(spark, d):
    s = labels.stack_horizons(member_values(spark, d), "cohort", 2001).withColumnRenamed("_h", "horizon")
    from pyspark.sql import Window

    return rounded(s.select("cohort", "entity", "horizon", F.count("*").over(Window.partitionBy("cohort", "horizon")).alias("members")))


@book.query(f"WITH {MEMBERS}, t AS (SELECT entity, avg(value) AS m FROM v GROUP BY entity) SELECT CASE WHEN m >= 400000 THEN 'star' WHEN m >= 250000 THEN 'starter' WHEN m >= 100000 THEN 'rotation' ELSE 'fringe' END AS tier, count(*) AS n FROM t GROUP BY 1")
def outcome_tiers(spark, d):
    t = member_values(spark, d).groupBy("entity").agg(F.avg("value").alias("m"))
    return t.select(labels.tiers("m", [(400_000, "star"), (250_000, "starter"), (100_000, "rotation")], "fringe").alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@book.query(f"""WITH {MEMBERS}, l AS (SELECT entity, list(value ORDER BY value DESC) AS vs FROM v GROUP BY entity) SELECT entity, round(vs[1] + coalesce(0.5 * vs[2], 0), 4) AS label FROM l""")
def genome_label_top2(spark, d):
    l = member_values(spark, d).groupBy("entity").agg(F.collect_list("value").alias("vs"))  # noqa: E741  one value per year
    return rounded(l.select("entity", labels.weighted_periods(F.col("vs"), [1.0, 0.5], best=2).alias("label")), 4)


@book.query(f"""{SCORED},
r AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY c_acctbal DESC, entity) AS o, row_number() OVER (PARTITION BY cohort ORDER BY -entity DESC, entity) AS t, row_number() OVER (PARTITION BY cohort ORDER BY value DESC, entity) AS b FROM x),
g AS (SELECT cohort, sum(CASE WHEN o <= 20 THEN value ELSE 0 END) AS so, sum(CASE WHEN t <= 20 THEN value ELSE 0 END) AS st, sum(CASE WHEN b <= 20 THEN value ELSE 0 END) AS sb,
 sum(CASE WHEN o <= 20 THEN greatest(value, 0) / log2(o + 1) ELSE 0 END) AS g, sum(CASE WHEN b <= 20 THEN greatest(value, 0) / log2(b + 1) ELSE 0 END) AS gb,
 count(*) FILTER (o <= 20 AND b <= 20) AS hits, sum((1.0 - o) * value) AS co, sum((1.0 - b) * value) AS cb FROM r GROUP BY cohort)
SELECT cohort, round(CASE WHEN sb > st THEN 100 * (so - st) / (sb - st) ELSE 0 END, 6) AS captured, round(g / greatest(gb, 1e-9), 6) AS ndcg, hits, round(co / nullif(cb, 0), 6) AS slot_cost FROM g""")
def order_metrics_at_20(spark, d):
    """E2, E3, E5, E6 from three ordinals."""
    return rounded(metrics.order_metrics(_scored(spark, d), "cohort", "value", F.col("c_acctbal"), -F.col("entity"), "entity", 20))


@book.query(f"""{SCORED},
r AS (SELECT cohort, {rank_sql('value', 'cohort')} AS rv, {rank_sql('c_acctbal', 'cohort')} AS rs, {rank_sql('entity', 'cohort', True)} AS rb FROM x),
e AS (SELECT cohort, corr(rs, rv) - corr(rb, rv) AS gain FROM r GROUP BY cohort),
l AS (SELECT *, row_number() OVER (ORDER BY cohort DESC) AS k FROM e)
SELECT round(avg(gain), 6) AS mean_gain, count(*) FILTER (gain > 0) AS wins, count(*) AS n, avg(gain) >= 0.0 AND count(*) FILTER (gain > 0) >= 4 AND min(gain) FILTER (k <= 2) >= 0 AS passed FROM l""")
def fold_gate(spark, d):
    x = _scored(spark, d)
    r = windows.ranked(x, ["cohort"], {"rv": "value", "rs": "c_acctbal", "rb": -F.col("entity")})
    e = r.groupBy("cohort").agg((corr("rs", "rv") - corr("rb", "rv")).alias("gain"))
    return rounded(metrics.fold_gate(e, "gain", "cohort", 0.0, 4))


@book.query(f"{SCORED}, r AS (SELECT cohort, {rank_sql('value', 'cohort')} AS a, {rank_sql('c_acctbal', 'cohort')} AS b FROM x) SELECT cohort, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY cohort")
def spearman_by_cohort(spark, d):
    return rounded(stats.spearman(_scored(spark, d), "value", "c_acctbal", ["cohort"]))


@book.query(f"{SCORED}, p AS (SELECT cohort, entity, {pct_sql('value', 'cohort')} AS a, {pct_sql('c_acctbal', 'cohort')} AS b FROM x) SELECT cohort, entity, round((0.7 * a + 0.3 * b) / 1.0, 6) AS score FROM p")
def blend_ranks(spark, d):
    return rounded(windows.with_pct_ranks(_scored(spark, d), ["cohort"], {"a": "value", "b": "c_acctbal"}).select("cohort", "entity", (0.7 * F.col("a") + 0.3 * F.col("b")).alias("score")))


@book.query(f"{SCORED}, y AS (SELECT *, {BOARD} AS board, -coalesce({BOARD}, 61.0) AS nb FROM x), p AS (SELECT cohort, entity, board, {pct_sql('c_acctbal', 'cohort')} AS a, {pct_sql('nb', 'cohort')} AS b FROM y) SELECT cohort, entity, round(0.6 * a + 0.4 * b, 6) AS filled, round(CASE WHEN board IS NULL THEN a ELSE 0.6 * a + 0.4 * b END, 6) AS skipped FROM p")
def consensus_blend(spark, d):
    x = _scored(spark, d).withColumn("board", F.when(F.col("entity") % 3 != 0, F.col("entity") % 60 + 1.0))
    return rounded(x.select("cohort", "entity", rules.consensus("c_acctbal", "board", 0.4, ["cohort"]).alias("filled"), rules.consensus("c_acctbal", "board", 0.4, ["cohort"], skip=True).alias("skipped")))


@book.query(f"{SCORED}, y AS (SELECT *, CASE WHEN c_nationkey < 8 THEN value END AS other FROM x), p AS (SELECT cohort, entity, c_nationkey, other, {pct_sql('c_acctbal', 'cohort')} AS a, {pct_sql('other', 'cohort')} AS b FROM y) SELECT cohort, entity, round(CASE WHEN c_nationkey < 8 AND other IS NOT NULL THEN 0.5 * a + 0.5 * b ELSE a END, 6) AS score FROM p")
def population_blend(spark, d):
    x = _scored(spark, d).withColumn("other", F.when(F.col("c_nationkey") < 8, F.col("value")))
    return rounded(x.select("cohort", "entity", rules.special("c_acctbal", "other", 0.5, F.col("c_nationkey") < 8, ["cohort"]).alias("score")))


@book.query(f"{SCORED}, y AS (SELECT *, CASE WHEN entity % 4 <> 0 THEN c_nationkey::DOUBLE END AS age FROM x), z AS (SELECT *, coalesce(age, median(age) OVER (PARTITION BY cohort)) AS filled, -coalesce(age, median(age) OVER ()) AS young FROM y) SELECT cohort, entity, round(0.9 * ({pct_sql('value', 'cohort')}) - 0.1 * ({pct_sql('filled', 'cohort')}), 6) + 0.0 AS score, round(0.8 * ({pct_sql('value', 'cohort')}) + 0.2 * ({pct_sql('young', 'cohort')}), 6) + 0.0 AS youth FROM z")
def tilt_median_fill(spark, d):
    x = _scored(spark, d).withColumn("age", F.when(F.col("entity") % 4 != 0, F.col("c_nationkey").cast("double")))
    x = rules.apply(x, {"score": "tilt(value,age,-0.1)", "youth": "youth(value,age,0.2)"}, ["cohort"])
    return rounded(x.select("cohort", "entity", "score", "youth"))


@book.query(f"{SCORED}, r AS (SELECT cohort, entity, {rank_sql('value', 'cohort', True)} AS a, {rank_sql('c_acctbal', 'cohort', True)} AS b, {rank_sql('c_nationkey', 'cohort', True)} AS c FROM x) SELECT cohort, entity, round(list_sort([a, b, c])[2], 6) AS med FROM r")
def median_rank(spark, d):
    x = _scored(spark, d)
    r = windows.ranked(x, ["cohort"], {n: -F.col(c) for c, n in (("value", "a"), ("c_acctbal", "b"), ("c_nationkey", "c"))})
    return rounded(r.select("cohort", "entity", row_median("a", "b", "c").alias("med")))


@book.query(f"{SCORED}, p AS (SELECT cohort, entity, c_nationkey, {pct_sql('value', 'cohort')} AS a, {pct_sql('c_acctbal', 'cohort')} AS b FROM x) SELECT cohort, entity, round(CASE WHEN c_nationkey < 10 THEN a ELSE b END, 6) AS score FROM p")
def route_horizon(spark, d):
    x = _scored(spark, d).withColumn("young", F.col("c_nationkey") < 10)
    return rounded(rules.apply(x, {"score": "route(young,rank(value),rank(c_acctbal))"}, ["cohort"]).select("cohort", "entity", "score"))


@book.query(f"{SCORED}, y AS (SELECT *, CASE WHEN entity % 5 <> 0 THEN c_acctbal END AS part FROM x), p AS (SELECT cohort, entity, {pct_sql('value', 'cohort')} AS a, {pct_sql('part', 'cohort')} AS b FROM y) SELECT cohort, entity, round(0.4 * coalesce(a, 0.5) + 0.6 * coalesce(b, 0.5), 6) AS score FROM p")
def stack_linear(spark, d):
    x = _scored(spark, d).withColumn("part", F.when(F.col("entity") % 5 != 0, F.col("c_acctbal")))
    return rounded(rules.apply(x, {"score": "stack(0.4:value,0.6:part)"}, ["cohort"]).select("cohort", "entity", "score"))


@book.query(f"""{SCORED}, p AS (SELECT *, {pct_sql('value', 'cohort')} AS a, {pct_sql('c_acctbal', 'cohort')} AS b FROM x), m AS (SELECT *, round((0.7 * a + 0.3 * b) / 1.0, 9) AS bl FROM p)
SELECT cohort, entity, round(greatest({pct_sql('bl', 'cohort')}, b), 6) AS score FROM m""")
def rule_parse_nested(spark, d):
    x = rules.apply(_scored(spark, d), {"_bl": "blend(value:0.7,c_acctbal:0.3)"}, ["cohort"]).withColumn("bl", F.round("_bl", 9))
    return rounded(rules.apply(x, {"score": "max(rank(bl),rank(c_acctbal))"}, ["cohort"]).select("cohort", "entity", "score"))


CONFIGS = ("own", "key", "nation", "mixed")
COVERS = rules.Covers(age="age", board="board", other="other", member="member", tilts=("games", "age"))
BASES = ("one own", "blend all", "median all", "blend own key", "blend best 3", "median best 3")


def _sweep_table(spark: SparkSession, d: str) -> DataFrame:
    """Four configs' scores of each member, and what overlays lean on."""
    e, n = F.col("entity"), F.col("c_nationkey")
    return _scored(spark, d).select(
        "cohort", "entity", "value", F.col("c_acctbal").alias("own"), (-e).cast("double").alias("key"), n.cast("double").alias("nation"), sampling.draw("entity", "cohort").alias("mixed"),
        F.when(e % 4 != 0, n.cast("double")).alias("age"), F.when(e % 3 != 0, e % 60 + 1.0).alias("board"), F.when(n < 8, F.col("c_acctbal")).alias("other"), (n < 8).alias("member"), (e % 17).cast("double").alias("games"),
    )


SWEEP = f"""{SCORED}, t AS (SELECT cohort, entity, value, c_acctbal AS own, (-entity)::DOUBLE AS key, c_nationkey::DOUBLE AS nation, ('0x' || substr(md5(entity || '|' || cohort || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mixed,
 CASE WHEN entity % 4 <> 0 THEN c_nationkey::DOUBLE END AS age, {BOARD} AS board, CASE WHEN c_nationkey < 8 THEN c_acctbal END AS other, c_nationkey < 8 AS member, (entity % 17)::DOUBLE AS games FROM x)"""


def _sweep_rules() -> dict[str, str]:
    pure = rules.pure_rules(list(CONFIGS), list(CONFIGS), COVERS)
    return pure | {k: v for n in BASES for k, v in rules.overlays(n, pure[n], COVERS).items()}


def _sweep_sql() -> str:
    """The same rules: ranks of configs and covers, then ranks of the bases, then one row for each rule."""
    of = lambda names, end="": " + ".join(f"{n}{end}" for n in names)
    score = {f"one {c}": f"{c}_p" for c in CONFIGS} | {"blend all": f"({of(CONFIGS, '_p')}) / 4", "median all": f"-list_median([{', '.join(f'{c}_d' for c in CONFIGS)}])"}
    score |= {f"blend {a} {b}": f"({a}_p + {b}_p) / 2" for i, a in enumerate(CONFIGS) for b in CONFIGS[i + 1 :]}
    for k in (3, 4):
        score |= {f"blend best {k}": f"({of(CONFIGS[:k], '_p')}) / {k}", f"median best {k}": f"-list_median([{', '.join(f'{c}_d' for c in CONFIGS[:k])}])"}
    for i, n in enumerate(BASES):
        own = f"b{i}_p"
        score |= {f"special {a} on {n}": f"CASE WHEN member AND other IS NOT NULL THEN (1 - {a}) * {own} + {a} * other_p ELSE {own} END" for a in (0.3, 0.5, 0.7, 1.0)}
        score |= {f"youth {b} on {n}": f"(1 - {b}) * {own} + {b} * young_p" for b in (0.1, 0.2, 0.3)}
        score |= {f"tilt {c} {b} on {n}": f"(1 - {abs(b)}) * {own} + ({b}) * {c}_m" for c in COVERS.tilts for b in (-0.15, -0.08, 0.08, 0.15)}
        score |= {f"consensus {w} on {n}": f"(1 - {w}) * {own} + {w} * board_p" for w in (0.3, 0.4, 0.5, 0.6, 0.7)}
        score |= {f"listed {w} on {n}": f"CASE WHEN board IS NULL THEN {own} ELSE (1 - {w}) * {own} + {w} * board_p END" for w in (0.5, 0.6)}
    wide = lambda x: f"round(({x})::DOUBLE, 9)"
    bases = ", ".join(f"{wide(score[n])} AS b{i}" for i, n in enumerate(BASES))
    long = ", ".join(f"struct_pack(rule := '{n}', s := {wide(x)})" for n, x in score.items())
    return f"""{SWEEP}, f AS (SELECT *, coalesce(age, median(age) OVER (PARTITION BY cohort)) AS age_f, games AS games_f, -coalesce(age, median(age) OVER ()) AS young, -coalesce(board, 61.0) AS board_f FROM t),
p AS (SELECT *, {rank_sql("value", "cohort")} AS rv, {", ".join(f"{pct_sql(c, 'cohort')} AS {c}_p, {rank_sql(c, 'cohort', True)} AS {c}_d" for c in CONFIGS)}, {pct_sql("other", "cohort")} AS other_p,
 {pct_sql("young", "cohort")} AS young_p, {pct_sql("age_f", "cohort")} AS age_m, {pct_sql("games_f", "cohort")} AS games_m, {pct_sql("board_f", "cohort")} AS board_p FROM f),
b AS (SELECT *, {bases} FROM p), q AS (SELECT *, {", ".join(f"{pct_sql(f'b{i}', 'cohort')} AS b{i}_p" for i in range(len(BASES)))} FROM b),
l AS (SELECT cohort, rv, unnest([{long}]) AS e FROM q), s AS (SELECT cohort, rv, e.rule AS rule, e.s AS s FROM l), r AS (SELECT cohort, rule, rv, {rank_sql("s", "cohort, rule")} AS rs FROM s),
c AS (SELECT rule, cohort, corr(rs, rv) AS rho FROM r GROUP BY 1, 2) SELECT rule, round(avg(rho), 6) AS mean_rho, count(*) FILTER (rho > 0) AS wins, count(rho) AS n FROM c GROUP BY 1"""


@book.query(_sweep_sql())
def rule_sweep(spark, d):
    """Q15: some 150 rules, their ranks by range or window, in one job."""
    made = _sweep_rules()
    names = {f"r{i}": n for i, n in enumerate(made)}
    got = rules.sweep(kept(_sweep_table(spark, d)), {k: made[n] for k, n in names.items()}, "cohort", "value")
    return rounded(got.replace(names, subset=["rule"]))


@book.query(f"""{SCORED}, p AS (SELECT cohort, value, {pct_sql('c_acctbal', 'cohort')} AS a, {pct_sql('entity', 'cohort')} AS b FROM x), g AS (SELECT *, w / 10.0::DOUBLE AS weight FROM p, (SELECT unnest(range(0, 11)) AS w)),
s AS (SELECT cohort, weight, value, round(weight * a + (1 - weight) * b, 9) AS s FROM g), r AS (SELECT cohort, weight, {rank_sql('s', 'cohort, weight')} AS rs, {rank_sql('value', 'cohort, weight')} AS rv FROM s),
c AS (SELECT cohort, weight, corr(rs, rv) AS rho FROM r GROUP BY 1, 2) SELECT round(weight, 6) AS weight, round(avg(rho), 5) AS mean_rho FROM c GROUP BY weight""")
def weight_grid_best(spark, d):
    g = rules.weight_grid(_scored(spark, d), "c_acctbal", "entity", "cohort", "value")
    return g.select(F.round("weight", 6).alias("weight"), F.round("mean_rho", 5).alias("mean_rho"))


_GREEDY = ("c_acctbal", "c_nationkey", "entity")


def _greedy_sql() -> str:
    """Every sequence of up to three picks with its mean correlation, then the path that greed takes."""
    ids = {c: f"p{i}" for i, c in enumerate(_GREEDY)}
    every = [s for k in (1, 2, 3) for s in itertools.product(_GREEDY, repeat=k)]
    blend = lambda s: f"round(({' + '.join(['0.0::DOUBLE', *(f'{ids[c]} * {s.count(c)}' for c in dict.fromkeys(s))])}) / {len(s)}, 9)"
    long = ", ".join(f"struct_pack(k := {len(s)}, a := '{s[0]}', b := {repr(s[1]) if len(s) > 1 else 'NULL::VARCHAR'}, c := {repr(s[2]) if len(s) > 2 else 'NULL::VARCHAR'}, s := {blend(s)})" for s in every)
    best = lambda k, picked, where: f"(SELECT {picked} AS f, rho FROM m WHERE k = {k}{where} ORDER BY rho DESC, f LIMIT 1)"
    return f"""{SCORED}, p AS (SELECT cohort, {rank_sql("value", "cohort")} AS rv, {", ".join(f"{pct_sql(c, 'cohort')} AS {i}" for c, i in ids.items())} FROM x), l AS (SELECT cohort, rv, unnest([{long}]) AS e FROM p),
s AS (SELECT cohort, rv, e.k AS k, e.a AS a, e.b AS b, e.c AS c, e.s AS s FROM l), r AS (SELECT *, {rank_sql("s", "cohort, k, a, b, c")} AS rs FROM s), h AS (SELECT k, a, b, c, cohort, corr(rs, rv) AS rho FROM r GROUP BY ALL),
m AS (SELECT k, a, b, c, round(avg(rho), 12) AS rho FROM h GROUP BY ALL), s1 AS {best(1, "a", "")}, s2 AS {best(2, "b", " AND a = (SELECT f FROM s1)")}, s3 AS {best(3, "c", " AND a = (SELECT f FROM s1) AND b = (SELECT f FROM s2)")}
SELECT 1::BIGINT AS step, f AS feature FROM s1 UNION ALL SELECT 2, s2.f FROM s1, s2 WHERE s2.rho > s1.rho + 1e-6 UNION ALL SELECT 3, s3.f FROM s1, s2, s3 WHERE s2.rho > s1.rho + 1e-6 AND s3.rho > s2.rho + 1e-6"""


@book.query(_greedy_sql())
def greedy_blend(spark, d):
    """Q12: greedy forward selection, which ends when no column helps."""
    chosen = rules.greedy(_scored(spark, d), list(_GREEDY), "cohort", "value", rounds=3)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "step long, feature string")


@book.query(f"""WITH {MEMBERS}, g AS (SELECT c_nationkey, entity, avg(value) AS m, count(*) AS n FROM v JOIN customer ON entity = c_custkey GROUP BY 1, 2), p AS (SELECT *, avg(m) OVER (PARTITION BY c_nationkey) AS prior FROM g)
SELECT entity, round(n / (n + 3.0) * m + 3.0 / (n + 3.0) * prior, 4) AS shrunk FROM p""")
def eb_shrink(spark, d):
    from pyspark.sql import Window

    g = _scored(spark, d).groupBy("c_nationkey", "entity").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    p = g.withColumn("prior", F.avg("m").over(Window.partitionBy("c_nationkey")))
    return rounded(p.select("entity", shrink(F.col("m"), F.col("n"), F.col("prior"), 3.0).alias("shrunk")), 4)


@book.query(f"{SCORED} SELECT cohort, entity, round((sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), 4) AS loo FROM x WINDOW w AS (PARTITION BY cohort, c_nationkey)")
def loo_mean(spark, d):
    return rounded(_scored(spark, d).select("cohort", "entity", windows.leave_one_out("value", ["cohort", "c_nationkey"]).alias("loo")), 4)


@book.query(f"""{SCORED}, r AS (SELECT cohort, entity, value, row_number() OVER (PARTITION BY cohort ORDER BY value DESC, entity) AS k FROM x) SELECT cohort, round(max(value) FILTER (k = 1), 4) AS v1, round(max(value) FILTER (k = 2), 4) AS v2, round(max(value) FILTER (k = 3), 4) AS v3 FROM r GROUP BY cohort""")
def topk_pivot(spark, d):
    t = windows.top_k(member_values(spark, d), ["cohort"], [F.desc("value"), F.col("entity")], 3)
    p = t.groupBy("cohort").pivot("rank", [1, 2, 3]).agg(F.max("value"))
    return rounded(p.withColumnsRenamed({"1": "v1", "2": "v2", "3": "v3"}), 4)


@book.query(f"""{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort, c_nationkey ORDER BY value DESC, entity) AS k FROM x),
t AS (SELECT cohort, c_nationkey, max(value) FILTER (k = 1) AS a, max(value) FILTER (k = 2) AS b FROM r GROUP BY 1, 2) SELECT cohort, entity, round(CASE WHEN k = 1 THEN b ELSE a END, 4) AS best_other FROM r JOIN t USING (cohort, c_nationkey)""")
def best_excluding_me(spark, d):
    from pyspark.sql import Window

    k = windows.ordinal(["cohort", "c_nationkey"], F.desc("value"), F.col("entity"))
    r = _scored(spark, d).withColumn("k", k)
    w = Window.partitionBy("cohort", "c_nationkey")
    best = lambda n: F.max(F.when(F.col("k") == n, F.col("value"))).over(w)
    return rounded(r.select("cohort", "entity", F.when(F.col("k") == 1, best(2)).otherwise(best(1)).alias("best_other")), 4)


@book.query(f"""WITH {MEMBERS} SELECT a.cohort, a.entity, round(max(b.value), 4) AS best_left FROM v a LEFT JOIN v b ON a.cohort = b.cohort AND b.entity > a.entity AND b.entity <= a.entity + 200 GROUP BY 1, 2""")
def best_remaining_choice(spark, d):
    """The best value still on the board after each pick, by one window frame."""
    from pyspark.sql import Window

    w = Window.partitionBy("cohort").orderBy("entity").rangeBetween(1, 200)
    return rounded(member_values(spark, d).select("cohort", "entity", F.max("value").over(w).alias("best_left")), 4)


@book.query(f"""{SCORED}, r AS (SELECT cohort, c_nationkey, value, max(value) OVER (PARTITION BY cohort ORDER BY entity RANGE BETWEEN 1 FOLLOWING AND 200 FOLLOWING) AS best FROM x),
c AS (SELECT c_nationkey, CASE WHEN best IS NULL OR value >= best THEN 'best' WHEN value >= 0.5 * best THEN 'fair' ELSE 'miss' END AS verdict FROM r)
SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, count(*) FILTER (verdict = 'best') AS best, count(*) FILTER (verdict = 'fair') AS fair, count(*) FILTER (verdict = 'miss') AS miss FROM c GROUP BY 1""")
def team_cards_summary(spark, d):
    from pyspark.sql import Window

    best = F.max("value").over(Window.partitionBy("cohort").orderBy("entity").rangeBetween(1, 200))
    v = _scored(spark, d).withColumn("b", best)
    c = v.withColumn("verdict", F.when(F.col("b").isNull() | (F.col("value") >= F.col("b")), "best").when(F.col("value") >= 0.5 * F.col("b"), "fair").otherwise("miss"))
    n = lambda k: F.count_if(F.col("verdict") == k).alias(k)
    return rounded(c.groupBy("c_nationkey").agg(F.count("*").alias("n"), n("best"), n("fair"), n("miss")))
