"""Predictions of many configurations, stacks and searches over them, model compositions, generators and blind scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions.numbers import shrink
from orderloom.operators import guards, labels, models, rules, sampling, specs, windows
from orderloom.operators.lineage import kept
from orderloom.plans.base import MEMBERS, Book, member_values, pct_sql, rank_sql, rounded
from orderloom.plans.cohorts import CONFIGS, COVERS, SWEEP, _ppf_sql, _sweep_table
from orderloom.plans.features import ROWS, _draw_sql, _rows
from orderloom.sources.readers import table

book = Book()
QUERIES, ORACLE = book.queries, book.sql
FEATURES = ["c_acctbal", "c_nationkey"]


# -- predictions, stacks, searches ---------------------------------------------------------


@book.query(f"""{ROWS} SELECT cohort, entity, round(c_acctbal, 4) AS one, (-entity)::DOUBLE AS two, round(CASE WHEN entity % 3 = 0 THEN 0.5 ELSE 0.2 END::DOUBLE, 6) AS one_top, round(CASE WHEN entity % 2 = 0 THEN 0.1 ELSE 0.3 END::DOUBLE, 6) AS one_low,
round(0.4 + 2 * CASE WHEN entity % 3 = 0 THEN 0.5 ELSE 0.2 END::DOUBLE, 6) AS one_bin, NULL::DOUBLE AS two_top, NULL::DOUBLE AS two_low, NULL::DOUBLE AS two_bin FROM x""")
def wide_predictions(spark, d):
    """Q1: long predictions of configs and their members, one row for each of a cohort's members."""
    x, e = kept(_rows(spark, d)), F.col("entity")
    none = F.lit(None).cast("double")
    p = lambda config, member, score, *shares: x.select("cohort", "entity", F.lit(config).alias("config"), F.lit(member).alias("member"), score.cast("double").alias("score"), *(s.cast("double").alias(f"p{i}") for i, s in enumerate(shares)))
    low, top = F.when(e % 2 == 0, 0.1).otherwise(0.3), F.when(e % 3 == 0, 0.5).otherwise(0.2)
    long = p("one", -1, F.col("c_acctbal"), none, none, none).unionByName(p("one", 0, F.lit(1.0), none, none, none)).unionByName(p("one", 1, F.lit(2.0), low, F.lit(0.4), top)).unionByName(p("one", 2, F.lit(3.0), top, top, low)).unionByName(p("two", -1, -e, none, none, none))
    return rounded(rules.wide(long, "cohort", "entity", ["one", "two"], 3), 6)


ALPHAS = [round(10 ** (-2 + 5 * i / 19), 9) for i in range(20)]


@book.query(f"""{SWEEP}, r AS (SELECT cohort, {pct_sql('own', 'cohort')} AS a, {pct_sql('mixed', 'cohort')} AS b, greatest(0.01, least(0.99, (({rank_sql('value', 'cohort')}) - 0.5) / count(value) OVER (PARTITION BY cohort)))::DOUBLE AS q FROM t),
g AS (SELECT a, b, {_ppf_sql('q')} AS y FROM r), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM g), c AS (SELECT a - ma AS a, b - mb AS b, y - my AS y, n FROM g, m),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM c), p AS (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha),
f AS (SELECT alpha, aa + alpha AS p, ab AS q, bb + alpha AS r, (aa + alpha) * (bb + alpha) - ab * ab AS d, ay, by_ FROM s, p), w AS (SELECT *, (r * ay - q * by_) / d AS wa, (p * by_ - q * ay) / d AS wb FROM f),
e AS (SELECT alpha, any_value(wa) AS wa, any_value(wb) AS wb, round(sum(((y - wa * a - wb * b) / (1 - (r * a * a - 2 * q * a * b + p * b * b) / d - 1.0 / n)) ** 2), 9) AS e FROM c, w GROUP BY 1), z AS (SELECT * FROM e ORDER BY e, alpha LIMIT 1)
SELECT 'own' AS feature, round(wa, 6) AS weight, round(alpha, 6) AS alpha FROM z UNION ALL SELECT 'mixed', round(wb, 6), round(alpha, 6) FROM z""")
def stack_fit(spark, d):
    """Q10: ridge over ranks, its penalty chosen among twenty by leaving rows out."""
    x = windows.with_pct_ranks(_sweep_table(spark, d), ["cohort"], {"a": "own", "b": "mixed"})
    x = windows.with_gauss_rank(x, ["cohort"], "value", "y")
    weights, alpha = models.fit_stack(x, ["a", "b"], "y", ALPHAS)
    return rounded(spark.createDataFrame([(n, weights[c], alpha) for n, c in (("own", "a"), ("mixed", "b"))], "feature string, weight double, alpha double"))


@book.query()
def exhaustive_sweep(spark, d):
    """Q15: every rule, overlays on the best three, and whether a rule's gain is robust."""
    got = rules.exhaustive(kept(_sweep_table(spark, d)), list(CONFIGS), "cohort", "value", COVERS)
    return rounded(spark.createDataFrame([(j.rule, j.mean_rho, j.gain, j.wins, j.robust) for j in got], "rule string, mean_rho double, gain double, wins long, robust boolean"))


@book.query()
def sparse_blend_search(spark, d):
    """Q13: a Parzen-estimator search over weights on all cohorts but the last two; one job a round."""
    x, known = rules.prepared(_sweep_table(spark, d).filter("cohort < 2000").select("cohort", "value", *CONFIGS), list(CONFIGS), "cohort", "value")
    weights, value = specs.parzen_weights(rules.blend_fitness(x, "cohort", "value", known=known), list(CONFIGS), 80, seed=0)
    return rounded(spark.createDataFrame([(c, weights[c], value) for c in CONFIGS], "config string, weight double, fitness double"))


POLICIES = ("full", "match", "match3", "short3", "multi", "4")


@book.query(f"WITH {MEMBERS}, c AS (SELECT DISTINCT cohort, greatest(1, least(5, 2001 - cohort)) AS k FROM v) SELECT cohort, 5::BIGINT AS h_full, k::BIGINT AS h_match, greatest(3, k)::BIGINT AS h_match3, CASE WHEN k <= 2 THEN 3 ELSE 5 END::BIGINT AS h_short3, 0::BIGINT AS h_multi, 4::BIGINT AS h_4 FROM c")
def horizon_policies(spark, d):
    """The training horizon of each cohort under each policy; 0 stands for every completed one."""
    c = member_values(spark, d).select("cohort").distinct()
    return rounded(c.select("cohort", *(labels.horizon_column(p, F.lit(2001) - F.col("cohort")).alias(f"h_{p}") for p in POLICIES)))


@book.query(f"WITH {MEMBERS}, e AS (SELECT entity, min(cohort) AS first FROM v GROUP BY 1), o AS (SELECT v.entity, first + 2 AS done, sum(value) FILTER (cohort <= first + 2) AS y FROM v JOIN e USING (entity) GROUP BY 1, 2), s AS (SELECT unnest(range(1996, 2003)) AS step) SELECT step, count(*) AS outcomes, round(sum(y), 2) AS total, count(*) FILTER (done = step) AS new FROM o JOIN s ON done <= step GROUP BY 1")
def expanding_context(spark, d):
    """R-4: each step adds the outcomes that were completed by it."""
    v = member_values(spark, d)
    v = v.join(v.groupBy("entity").agg(F.min("cohort").alias("first")), "entity")
    return rounded(labels.known_by_step(v, "entity", "cohort", "value", F.col("first") + 2, list(range(1996, 2003))), 2)


GENOMES = {"front": {"hw": "front"}, "best": {"hw": "top2", "clip": "clip40"}, "damped": {"hw": "disc70", "clip": "log1p"}}


@book.query("""WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50)::DOUBLE END AS c FROM customer), z AS (SELECT *, coalesce(c, 0) AS c0, a + 0.7 * b + 0.7 * 0.7 * coalesce(c, 0) AS l FROM x)
SELECT c_custkey, round(a + 0.8 * b + 0.6 * c0, 6) AS front, round(greatest(-40, least(40, (a + b + c0 - least(a, b, c0)) / 2)), 6) AS best, round(sign(l) * ln(1 + abs(l)), 6) AS damped FROM z""")
def genome_labels(spark, d):
    """Labels that genomes describe."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 50).cast("double")).alias("c"))
    return rounded(c.select("c_custkey", *(specs.Genome().changed(**g).label_column(["a", "b", "c"]).alias(n) for n, g in GENOMES.items())))


# -- fits of a train table by SQL ------------------------------------------------------------


def _fit_sql(name: str, train: str, label: str) -> str:
    """A ridge of two standardised features as one row: means, deviations, weights and the label's mean."""
    return f"""{name}_m AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2, avg({label}) AS my FROM {train}),
{name}_s AS (SELECT any_value(m1) AS m1, any_value(s1) AS s1, any_value(m2) AS m2, any_value(s2) AS s2, any_value(my) AS my, sum(((c_acctbal - m1) / s1) ** 2) + 1 AS aa, sum((c_acctbal - m1) / s1 * (c_nationkey - m2) / s2) AS ab, sum(((c_nationkey - m2) / s2) ** 2) + 1 AS bb,
 sum((c_acctbal - m1) / s1 * ({label} - my)) AS ay, sum((c_nationkey - m2) / s2 * ({label} - my)) AS by_ FROM {train}, {name}_m),
{name} AS (SELECT m1, s1, m2, s2, my, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS w1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS w2 FROM {name}_s)"""


def _says(name: str) -> str:
    return f"({name}.my + {name}.w1 * (c_acctbal - {name}.m1) / {name}.s1 + {name}.w2 * (c_nationkey - {name}.m2) / {name}.s2)"


SPLIT = f"{ROWS}, tr AS (SELECT *, (value > 200000)::INT::DOUBLE AS played, value / (entity % 3 + 1) AS later FROM x WHERE cohort <= 1998), te AS (SELECT * FROM x WHERE cohort > 1998)"


def _split(spark, d):
    x = kept(_rows(spark, d))  # fits read it many times
    train = x.filter("cohort <= 1998").withColumn("played", (F.col("value") > 200000).cast("double")).withColumn("later", F.col("value") / (F.col("entity") % 3 + 1))
    return train, x.filter("cohort > 1998")


def _shown(df):
    return rounded(df.select("cohort", "entity", "score"))


@book.query(f"{SPLIT}, {_fit_sql('f', 'tr', 'value')}, {_fit_sql('g', 'tr', 'played')}, p AS (SELECT te.*, round({_says('f')}, 9) AS s, {_says('g')} AS c FROM te, f, g) SELECT cohort, entity, round(greatest(0, least(1, c)) * ({pct_sql('s', 'cohort')}), 6) AS score FROM p")
def hurdle_scores(spark, d):
    """M9: chance of an outcome times the rank of its size."""
    train, test = _split(spark, d)
    return _shown(models.hurdle(train, test, FEATURES, "played", "value", ["cohort"]))


@book.query(f"{SPLIT}, {_fit_sql('f', 'tr', 'value')}, {_fit_sql('g', 'tr', 'later')}, p AS (SELECT te.*, round({_says('f')}, 9) AS s, round({_says('g')}, 9) AS c FROM te, f, g) SELECT cohort, entity, round(0.6 * ({pct_sql('s', 'cohort')}) + 0.4 * ({pct_sql('c', 'cohort')}), 6) AS score FROM p")
def period_sum_scores(spark, d):
    """M9: a model for each period's label, their ranks weighted."""
    train, test = _split(spark, d)
    return _shown(models.period_sum(train, test, FEATURES, [("value", 0.6), ("later", 0.4)], ["cohort"], ["cohort", "entity"]))


_BAGS = [f"b{i} AS (SELECT * FROM tr WHERE {_draw_sql(i, 'entity')} < 0.8), {_fit_sql(f'f{i}', f'b{i}', 'value')}" for i in range(3)]


@book.query(f"{SPLIT}, {', '.join(_BAGS)}, p AS (SELECT te.*, {', '.join(f'round({_says(f'f{i}')}, 9) AS s{i}' for i in range(3))} FROM te, f0, f1, f2) SELECT cohort, entity, round(({' + '.join(f'({pct_sql(f's{i}', 'cohort')})' for i in range(3))}) / 3, 6) AS score FROM p")
def bagged_scores(spark, d):
    """M9: ranks of three models of seeded subsets."""
    train, test = _split(spark, d)
    return _shown(models.bagged(train, test, FEATURES, "value", "entity", ["cohort"], ["cohort", "entity"]))


_FOLD = "(('0x' || substr(md5(entity || '|' || '3'), 1, 13))::BIGINT % 3)"
_PARTS = [f"r{i} AS (SELECT * FROM tr WHERE {_FOLD} <> {i}), {_fit_sql(f'f{i}', f'r{i}', 'value')}" for i in range(3)]


@book.query(f"""{SPLIT}, {', '.join(_PARTS)}, o AS ({' UNION ALL '.join(f'SELECT tr.*, round({_says(f"f{i}")}, 9) AS s, 1 AS g FROM tr, f{i} WHERE {_FOLD} = {i}' for i in range(3))}), k AS (SELECT *, {pct_sql('value', 'g')} - ({pct_sql('s', 'g')}) AS miss FROM o),
{_fit_sql('h', 'k', 'miss')}, {_fit_sql('f', 'tr', 'value')}, p AS (SELECT te.*, round({_says('f')}, 9) AS s, {_says('h')} AS r FROM te, f, h) SELECT cohort, entity, round(({pct_sql('s', 'cohort')}) + r, 5) AS score FROM p""")
def residual_scores(spark, d):
    """M9: what a second model says of the ranks that the first missed out of fold."""
    train, test = _split(spark, d)
    return rounded(models.residual(train, test, FEATURES, "value", "entity", ["cohort"]).select("cohort", "entity", "score"), 5)


@book.query(f"""{SPLIT}, m AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM tr), z AS (SELECT cohort, entity, value, (c_acctbal - m1) / s1 AS a, (c_nationkey - m2) / s2 AS b FROM tr, m),
o AS (SELECT *, {', '.join(f'lead(struct_pack(y := value, a := a, b := b), {i}) OVER w AS n{i}' for i in range(1, 6))} FROM z WINDOW w AS (PARTITION BY cohort ORDER BY {_draw_sql(0, 'entity')}, entity)), u AS (SELECT value, a, b, unnest([n1, n2, n3, n4, n5]) AS n FROM o),
p AS (SELECT sign(value - n.y)::DOUBLE AS y, a - n.a AS a, b - n.b AS b FROM u WHERE n IS NOT NULL), s AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM p)
SELECT cohort, entity, round((bb * ay - ab * by_) / (aa * bb - ab * ab) * (c_acctbal - m1) / s1 + (aa * by_ - ab * ay) / (aa * bb - ab * ab) * (c_nationkey - m2) / s2, 6) AS score FROM te, m, s""")
def pairwise_scores(spark, d):
    """M4: a linear ranker of pairs; each row meets five others."""
    train, test = _split(spark, d)
    return _shown(models.pairwise(train, test, FEATURES, "value", "cohort", "entity"))


@book.query(f"""{ROWS}, n AS (SELECT DISTINCT cohort AS now FROM x), tr AS (SELECT now, x.* FROM x JOIN n ON cohort BETWEEN now - 3 AND now - 1), m AS (SELECT now, avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2, avg(value) AS my FROM tr GROUP BY 1),
z AS (SELECT now, (c_acctbal - m1) / s1 AS a, (c_nationkey - m2) / s2 AS b, value - my AS y FROM tr JOIN m USING (now)), s AS (SELECT now, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM z GROUP BY 1),
f AS (SELECT m.*, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS w1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS w2 FROM m JOIN s USING (now)), o AS (SELECT cohort, entity, my + w1 * (c_acctbal - m1) / s1 + w2 * (c_nationkey - m2) / s2 AS score FROM x JOIN f ON now = cohort), r AS (SELECT *, round(score, 9) AS k FROM o)
SELECT cohort, entity, 0::BIGINT AS member, round(score, 3) AS score FROM o UNION ALL SELECT cohort, entity, -1, round({rank_sql('k', 'cohort')}, 3) FROM r""")
def layer_one_run(spark, d):
    """A configuration read from JSON, its features resolved, each cohort scored by the three before it."""
    x = kept(_rows(spark, d))
    config = specs.Config.read({"name": "last three", "features": ["scores", "-flat", "c_nationkey"], "ctx_last": 3})
    groups = {"scores": ["c_acctbal", "value_flat"], "flat": ["value_flat"]}
    cohorts = [r["cohort"] for r in x.select("cohort").distinct().collect()]
    out = specs.layer_one(x, config, groups, "cohort", "entity", "value", sorted(cohorts))
    return rounded(out.select("cohort", "entity", "member", "score"), 3)


@book.query()
def causal_text_scores(spark, d):
    """A text model for each cohort, of the texts before it."""
    docs = table(spark, d, "documents", ["doc_id", "text"]).join(table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")
    x = docs.withColumns({"cohort": F.col("doc_id") % 3, "y": F.col("quality").cast("double")})
    return rounded(models.causal_text_scores(x, "text", "y", "cohort", [1, 2]).select("doc_id", "cohort", "score"), 4)


# -- generators ----------------------------------------------------------------------------

_Z = [f"coalesce(({c} - avg({c}) OVER (PARTITION BY cohort)) / coalesce(nullif(stddev_pop({c}) OVER (PARTITION BY cohort), 0), 1), 0)" for c in ("c_acctbal", "c_nationkey")]


@book.query(f"""{ROWS}, z AS (SELECT *, {_Z[0]} AS a, {_Z[1]} AS b FROM x), o AS (SELECT *, {', '.join(f'lead(struct_pack(a := a, b := b, p := c_acctbal, q := c_nationkey, y := value), {i}) OVER w AS n{i}' for i in range(1, 9))} FROM z WINDOW w AS (PARTITION BY cohort ORDER BY {_draw_sql(0, 'entity')}, entity)),
u AS (SELECT cohort, entity, a, b, c_acctbal, c_nationkey, value, unnest([{', '.join(f'struct_pack(i := {i}, n := n{i})' for i in range(1, 9))}]) AS e FROM o), k AS (SELECT *, (e.n.a - a) ** 2 + (e.n.b - b) ** 2 AS far FROM u),
f AS (SELECT cohort, entity, any_value(c_acctbal) AS p, any_value(c_nationkey) AS q, any_value(value) AS y, arg_min(e.n, (far, e.i)) FILTER (e.n IS NOT NULL) AS n FROM k GROUP BY 1, 2), s AS (SELECT *, {_draw_sql(1, 'entity')} AS s FROM f)
SELECT cohort, entity, round(p + coalesce(s * (n.p - p), 0), 5) AS c_acctbal, round(q + coalesce(s * (n.q - q), 0), 5) AS c_nationkey, round(y + coalesce(s * (n.y - y), 0), 4) AS value FROM s""")
def smote_rows(spark, d):
    """Rows moved towards the nearest of eight others."""
    x = _rows(spark, d).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    s = sampling.smote(x, ["cohort"], "entity", ["c_acctbal", "c_nationkey"], "value")
    return s.select("cohort", "entity", F.round("c_acctbal", 5).alias("c_acctbal"), F.round("c_nationkey", 5).alias("c_nationkey"), F.round("value", 4).alias("value"))


@book.query(f"""{ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY value, entity) AS r, count(*) OVER (PARTITION BY cohort) AS n, list_sort([{', '.join(_draw_sql(i, 'entity') for i in range(3))}])[2] AS s, floor({_draw_sql(7, 'entity')} * 51)::BIGINT - 25 AS step FROM x)
SELECT a.cohort, a.entity, round(a.s * a.value + (1 - a.s) * b.value, 5) AS value, round(a.s * a.c_acctbal + (1 - a.s) * b.c_acctbal, 5) AS c_acctbal FROM r a JOIN r b ON b.cohort = a.cohort AND b.r = greatest(1, least(a.n, a.r + a.step))""")
def class_mixup_rows(spark, d):
    """Rows mixed with such as have a near label."""
    return rounded(sampling.class_mixup(_rows(spark, d), ["cohort"], "entity", ["c_acctbal"], "value").select("cohort", "entity", "value", "c_acctbal"), 5)


@book.query(f"{ROWS} SELECT cohort, entity, round(value + 0.1 * stddev_pop(value) OVER (PARTITION BY cohort) * sqrt(-2 * ln(1 - {_draw_sql(0, 'entity')})) * cos(6.283185307179586 * {_draw_sql(1_000_003, 'entity')}), 4) AS value FROM x")
def label_noise_rows(spark, d):
    """Noise on labels alone."""
    return rounded(sampling.label_noise(_rows(spark, d), ["cohort"], "entity", "value").select("cohort", "entity", "value"), 4)


# -- blind scoring and fold-local priors -----------------------------------------------------


@book.query(f"{ROWS}, s AS (SELECT entity, c_acctbal AS s, value, entity AS b, 1 AS g FROM x WHERE cohort = 1999), r AS (SELECT {rank_sql('s', 'g')} AS rs, {rank_sql('value', 'g')} AS ry, {rank_sql('b', 'g', True)} AS rb FROM s) SELECT count(*) AS n, round(corr(rs, ry), 6) AS ic, round(corr(rb, ry), 6) AS baseline_ic FROM r")
def blind_scoring(spark, d):
    """Predictions from stripped inputs; what comes back is one row."""
    x = _rows(spark, d).filter("cohort = 1999").withColumn("y_value", F.col("value"))
    inputs, stripped = guards.blind(x, "entity", ["c_acctbal", "c_nationkey", "missing"])
    if stripped != ["y_value"] or inputs.columns != ["entity", "c_acctbal", "c_nationkey"]:
        raise guards.GuardError("outcomes were not stripped")
    return rounded(guards.blind_score(inputs.withColumn("score", F.col("c_acctbal")), x.withColumn("place", F.col("entity")), "entity", "score", "value", "place"))


@book.query(f"{ROWS}, n AS (SELECT entity, cohort, c_acctbal, count(*) OVER (PARTITION BY entity) AS n FROM x), p AS (SELECT avg(c_acctbal) AS p FROM x WHERE cohort <= 1998) SELECT cohort, entity, round(n / (n + 4.0) * c_acctbal + 4.0 / (n + 4.0) * p, 4) AS shr FROM n, p")
def fold_local_priors(spark, d):
    """Priors of the training fold alone, for all rows."""
    from pyspark.sql import Window

    x = _rows(spark, d)
    prior = guards.train_priors(x, F.col("cohort") <= 1998, ["c_acctbal"])
    n = F.count("*").over(Window.partitionBy("entity"))
    return rounded(x.select("cohort", "entity", shrink(F.col("c_acctbal"), n, prior["c_acctbal"], 4.0).alias("shr")), 4)
