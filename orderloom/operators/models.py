"""Models behind one small interface: closed-form ridge by moments, causal fits, MLlib plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.nulls import row_mean
from orderloom.operators.guards import ban_columns
from orderloom.operators.lineage import kept, ship

#: Training vectors of a tile, and test vectors of a block: what a task and a broadcast hold at once.
TILE = 1 << 12
BLOCK = 1 << 14


@dataclass(frozen=True)
class Ridge:
    """Linear model over standardised features; missing features take the mean."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, m, s, w in zip(self.features, self.means, self.sds, self.weights, strict=True):
            out = out + w * (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s
        return out


def fit_ridge(df: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> Ridge:
    """Two aggregates, whatever the number of rows; the driver solves a system of the features' size."""
    ban_columns(features, names=(label,))
    rows = df.filter(F.col(label).isNotNull())
    first = rows.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)), F.avg(label).alias("y")).first()
    means = [first[f"m{i}"] or 0.0 for i in range(len(features))]
    sds = [first[f"s{i}"] or 1.0 for i in range(len(features))]
    z = rows.select(F.col(label).cast("double").alias("y"), *((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(features, means, sds, strict=True))).toDF("y", *(f"z{i}" for i in range(len(features))))
    k = len(features)
    cross = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    s = z.agg(*cross, *(F.sum(F.col(f"z{i}") * (F.col("y") - (first["y"] or 0.0))).alias(f"b{i}") for i in range(k))).first()
    a = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([s[f"b{i}"] or 0.0 for i in range(k)])
    return Ridge(tuple(features), tuple(means), tuple(sds), tuple(np.linalg.solve(a + penalty * np.eye(k), b).tolist()), first["y"] or 0.0)


def causal_scores(df: DataFrame, features: list[str], label: str, cohort: str, lag: int = 1, penalty: float = 1.0) -> DataFrame:
    """df with scores of a ridge that was fitted on cohorts at least lag before each row's own.

    Moments are summed once per cohort; each cohort's model is solved from the running totals.
    """
    ban_columns(features, names=(label,))
    k = len(features)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features] + [F.lit(1.0)]
    y = F.col(label).cast("double")
    known = y.isNotNull()
    sums = [F.sum(F.when(known, x[i] * x[j])).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    rows = sorted(df.groupBy(cohort).agg(*sums, *(F.sum(F.when(known, x[i] * y)).alias(f"b{i}") for i in range(k + 1))).collect(), key=lambda r: r[cohort])
    models: dict[int, list[float]] = {}
    for now in (r[cohort] for r in rows):
        a, b = penalty * np.eye(k + 1), np.zeros(k + 1)
        old = [r for r in rows if r[cohort] <= now - lag]
        for r in old:
            a += np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
            b += np.array([r[f"b{i}"] or 0.0 for i in range(k + 1)])
        if old:
            models[now] = np.linalg.solve(a, b).tolist()
    known = df.sparkSession.createDataFrame([(int(now), [float(v) for v in w]) for now, w in models.items()], "_cohort long, _w array<double>")  # a row for each cohort
    dot = sum((F.get("_w", F.lit(i)) * x[i] for i in range(k + 1)), F.lit(0.0))
    return df.join(F.broadcast(known), F.col(cohort) == F.col("_cohort"), "left").withColumn("score", dot).drop("_cohort", "_w")


def knn(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, k: int = 5, *, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(key, score): mean label of the nearest training vectors, weighted by nearness; exact for any number of rows.

    Test vectors travel in blocks of bounded size; for each block one pass over train keeps every
    tile's k nearest, and a window merges them. Rows with a null key, or a vector that is null,
    empty or holds nulls, take no part; vectors meet those of their own length only.
    """
    from pyspark.sql import Window

    spark = train.sparkSession
    ship(spark)
    given = lambda d: d.filter(F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull())).withColumn("_v", F.transform(vector, lambda x: x.cast("double")))
    train, test = given(train).select(key, "_v", F.col(label).cast("double").alias("_y")), given(test).select(key, "_v")
    kind = train.schema[key].dataType.simpleString()
    blocks = max(1, -(-test.count() // block))
    pairs: DataFrame | None = None
    for i in range(blocks):
        own = test.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(own)
        part = train.mapInArrow(_nearest(sent, k, tile), f"`{key}` {test.schema[key].dataType.simpleString()}, _o {kind}, _y double, _d double")
        pairs = part if pairs is None else pairs.unionByName(part)
    near = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_d", "_o"))).filter(F.col("_n") <= k)
    w = 1 / (F.col("_d") + 1e-9)
    return near.groupBy(key).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("score"))


def _nearest(sent, k: int, tile: int):
    """Batches of (key, vector, label) to each sent vector's k nearest of every tile, with exact distances."""

    def matrices(column):
        sizes = column.value_lengths().to_numpy()
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            yield d, rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]

    def tiles(batches):
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, tile):
                held.append(batch.slice(lo, tile))
                n += held[-1].num_rows
                if n >= tile:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(q, own, x, codes):
        """(rows of q, rows of x, distances); rows of x are in the order of their keys."""
        xx = (x * x).sum(axis=1)
        for lo in range(0, len(q), 256):
            some = q[lo : lo + 256]
            square = (some * some).sum(axis=1)[:, None] + xx - 2 * some @ x.T
            square[own[lo : lo + 256, None] == codes] = np.inf
            # rounding of the expanded square: what may be among the k nearest is measured exactly
            last = np.partition(square, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            far = square > (last + 1e-9 * ((some * some).sum(axis=1) + xx.max()))[:, None]
            for i in range(len(some)):
                j = np.flatnonzero(~far[i] & (codes != own[lo + i]))
                gap = x[j] - some[i]
                d = np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])
                o = np.argsort(d, kind="stable")[:k]
                yield np.full(len(o), lo + i), j[o], d[o]

    def work(batches):
        asked = sent.value
        ids = asked.column(0).combine_chunks() if asked.num_rows else None
        if ids is None:
            return
        by_length = {d: (rows, q) for d, rows, q in matrices(asked.column(1).combine_chunks())}
        values = pc.unique(ids)
        own = pc.index_in(ids, values).to_numpy(zero_copy_only=False)
        for held in tiles(batches):
            held = held.take(pc.sort_indices(held.column(0))).combine_chunks()
            keys, labels = held.column(0).combine_chunks(), held.column(2).combine_chunks()
            codes = pc.fill_null(pc.index_in(keys, values), -1).to_numpy(zero_copy_only=False)
            for d, rows, x in matrices(held.column(1).combine_chunks()):
                if d not in by_length:
                    continue
                mine, q = by_length[d]
                for lo in range(0, len(q), 1024):  # bounded batches out
                    found = list(search(q[lo : lo + 1024], own[mine[lo : lo + 1024]], x, codes[rows]))
                    a, b, s = (np.concatenate([f[c] for f in found]) for c in range(3))
                    at = pa.array(rows[b])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[lo + a])), keys.take(at), labels.take(at), pa.array(s)], [asked.column_names[0], "_o", "_y", "_d"])

    return work


#: Families by name; each takes (train, test, features, label) and returns test with a column ``score``.
FAMILIES: dict[str, Callable[[DataFrame, DataFrame, list[str], str], DataFrame]] = {}


def family(name: str):
    def put(f):
        FAMILIES[name] = f
        return f

    return put


@family("ridge")
def _ridge(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    return test.withColumn("score", fit_ridge(train, features, label).column())


def _mllib(name: str, make: Callable):
    @family(name)
    def fit(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import Imputer, VectorAssembler

        ban_columns(features, names=(label,))
        cast = lambda d: d.withColumns({f"_f{i}": F.col(c).cast("double") for i, c in enumerate(features)})
        own = [f"_f{i}" for i in range(len(features))]
        steps = [Imputer(inputCols=own, outputCols=[f"{c}i" for c in own]), VectorAssembler(inputCols=[f"{c}i" for c in own], outputCol="_v"), make().setFeaturesCol("_v").setLabelCol(label).setPredictionCol("score")]
        model = Pipeline(stages=steps).fit(cast(train.filter(F.col(label).isNotNull())))
        return model.transform(cast(test)).drop("_v", *own, *(f"{c}i" for c in own))

    return fit


def _gbt():
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=20, maxDepth=3, seed=7)


def _trees():
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=30, maxDepth=5, seed=7)


_mllib("gbt", _gbt)
_mllib("forest", _trees)


# -- compositions of families ---------------------------------------------------------------


def hurdle(train: DataFrame, test: DataFrame, features: list[str], played: str, label: str, by: list[str], of: str = "ridge") -> DataFrame:
    """test with ``score``: the chance of a positive outcome (held to 0..1) times the percentile rank of a family's score."""
    from orderloom.operators.windows import with_pct_ranks

    chance = fit_ridge(train.withColumn("_played", F.col(played).cast("double")), features, "_played").column()
    scored = with_pct_ranks(FAMILIES[of](train, test, features, label), by, {"_pct": "score"})
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance)) * F.col("_pct")).drop("_pct")


def residual(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, by: list[str], first: str = "ridge", second: str = "ridge", folds: int = 3, seed: int = 3) -> DataFrame:
    """test with ``score``: a first family's percentile rank plus what a second family says of the rank it missed.

    What the second learns from are ranks of out-of-fold scores, so that the first has not seen them.
    """
    from orderloom.operators import sampling
    from orderloom.operators.windows import with_pct_ranks

    parts, rows = None, train.withColumn("_fold", sampling.folds(key, folds, seed))
    for i in range(folds):
        own = FAMILIES[first](rows.filter(F.col("_fold") != i), rows.filter(F.col("_fold") == i), features, label)
        parts = own if parts is None else parts.unionByName(own)
    missed = with_pct_ranks(parts.withColumn("_all", F.lit(1)), ["_all"], {"_y": label, "_s": "score"}).withColumn("_miss", F.col("_y") - F.col("_s"))
    missed = kept(missed.select(*features, "_miss"))  # a fit reads it twice
    base = with_pct_ranks(FAMILIES[first](train, test, features, label), by, {"_base": "score"}).drop("score")
    return FAMILIES[second](missed, base, features, "_miss").withColumn("score", F.col("_base") + F.col("score")).drop("_base")


def period_sum(train: DataFrame, test: DataFrame, features: list[str], periods: list[tuple[str, float]], by: list[str], key: list[str], of: str = "ridge") -> DataFrame:
    """test with ``score``: weighted percentile ranks of a model for each period's label."""
    from orderloom.operators.windows import with_pct_ranks

    out = test.drop("score")
    for i, (label, _) in enumerate(periods):
        out = FAMILIES[of](train, out, features, label).withColumnRenamed("score", f"_s{i}")
    each = range(len(periods))
    out = with_pct_ranks(out, by, {f"_p{i}": f"_s{i}" for i in each})
    score = sum((weight * F.col(f"_p{i}") for i, (_, weight) in enumerate(periods)), F.lit(0.0))
    return out.withColumn("score", score).drop(*(f"_{c}{i}" for i in each for c in "sp"))


def bagged(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, by: list[str], members: list[str], bags: int = 3, share: float = 0.8, seed: int = 0) -> DataFrame:
    """test with ``score``: mean percentile rank over seeded subsets of the training rows. members: columns that tell a test row."""
    from orderloom.operators import sampling
    from orderloom.operators.windows import with_pct_ranks

    fits = {f"_s{i}": fit_ridge(train.filter(sampling.draw(key, seed=seed + i) < share), features, label).column() for i in range(bags)}
    own = with_pct_ranks(test.withColumns(fits), by, {f"_p{i}": f"_s{i}" for i in range(bags)})
    return own.withColumn("score", row_mean(*(f"_p{i}" for i in range(bags)))).drop(*(f"_{c}{i}" for i in range(bags) for c in "sp"))


def pairwise(train: DataFrame, test: DataFrame, features: list[str], label: str, by: str, key: str, near: int = 5, penalty: float = 1.0, seed: int = 0) -> DataFrame:
    """test with ``score``: a linear ranker that learns from pairs of one cohort which of the two is better.

    Each row meets the next few rows of a random order of its cohort, so pairs grow with the rows and
    not with their square; the differences of features are fitted to the sign of the labels' difference.
    """
    from pyspark.sql import Window

    from orderloom.operators import sampling

    ban_columns(features, names=(label,))
    known = train.filter(F.col(label).isNotNull())
    scale = known.agg(*(F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features))).first()
    means, sds = [scale[f"m{i}"] or 0.0 for i in range(len(features))], [scale[f"s{i}"] or 1.0 for i in range(len(features))]
    z = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, m, s in zip(features, means, sds, strict=True)]
    rows = known.select(by, key, F.col(label).cast("double").alias("_y"), F.array(*z).alias("_z"))
    order = Window.partitionBy(by).orderBy(sampling.draw(key, seed=seed), key)
    ahead = rows.withColumn("_next", F.array(*(F.lead(F.struct("_y", "_z"), i).over(order) for i in range(1, near + 1))))
    pairs = ahead.withColumn("_o", F.explode("_next")).filter("_o is not null").select(F.signum(F.col("_y") - F.col("_o._y")).alias("y"), F.zip_with("_z", "_o._z", lambda a, b: a - b).alias("d"))
    k = len(features)
    d = lambda i: F.get("d", F.lit(i))
    s = pairs.agg(*(F.sum(d(i) * d(j)).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(d(i) * F.col("y")).alias(f"b{i}") for i in range(k))).first()
    a = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    weights = np.linalg.solve(a + penalty * np.eye(k), np.array([s[f"b{i}"] or 0.0 for i in range(k)])).tolist()
    return test.withColumn("score", sum((w * c for w, c in zip(weights, z, strict=True)), F.lit(0.0)))


def fit_stack(df: DataFrame, ranks: list[str], target: str, alphas: list[float]) -> tuple[dict[str, float], float]:
    """(weight of each rank column, penalty): ridge whose penalty has the least squared error when each row is left out.

    Moments give the fit for every penalty; one more pass adds up every row's error over 1 - its leverage,
    for all penalties at once, in Arrow batches.
    """
    import pandas as pd

    ship(df.sparkSession)
    k = len(ranks)
    rows = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(ranks)))
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k))).first()
    n, mean_y, means = first["n"], first["y"], np.array([first[f"m{i}"] for i in range(k)])
    x = [F.col(f"x{i}") - float(means[i]) for i in range(k)]
    y = F.col("y") - mean_y
    s = rows.agg(*(F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * y).alias(f"b{i}") for i in range(k))).first()
    a = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([s[f"b{i}"] for i in range(k)])
    inverses = [np.linalg.inv(a + alpha * np.eye(k)) for alpha in alphas]
    weights = [inverse @ b for inverse in inverses]

    def errors(batches):
        total = np.zeros(len(alphas))
        for batch in batches:
            v = np.column_stack([batch.column(i).to_numpy() for i in range(k + 1)])
            z, t = v[:, 1:] - means, v[:, 0] - mean_y
            for j, (inverse, w) in enumerate(zip(inverses, weights, strict=True)):
                leverage = np.einsum("ni,ij,nj->n", z, inverse, z) + 1 / n
                total[j] += (((t - z @ w) / (1 - leverage)) ** 2).sum()
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"j": np.arange(len(alphas)), "e": total}))

    got = {r["j"]: r["e"] for r in rows.mapInArrow(errors, "j long, e double").groupBy("j").agg(F.sum("e").alias("e")).collect()}
    best = min(range(len(alphas)), key=lambda j: (round(got[j], 9), j))
    return dict(zip(ranks, weights[best].tolist(), strict=True)), alphas[best]


def text_ridge(train: DataFrame, test: DataFrame, text: str, label: str, terms: int = 1 << 12, penalty: float = 1.0) -> DataFrame:
    """test with ``score``: ridge over TF-IDF of one and two words with damped counts, hashed to a fixed number of terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
    from pyspark.ml.regression import LinearRegression

    clean = lambda d: d.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    steps = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern="[^\\p{L}]+"), NGram(n=2, inputCol="_w", outputCol="_w2"), SQLTransformer(statement="SELECT *, concat(_w, _w2) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=terms), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_x"), LinearRegression(featuresCol="_x", labelCol=label, predictionCol="score", regParam=penalty, elasticNetParam=0.0, solver="l-bfgs", maxIter=50),
    ]
    model = Pipeline(stages=steps).fit(clean(train.filter(F.col(label).isNotNull())))
    return model.transform(clean(test)).select(*test.columns, "score")


def causal_text_scores(df: DataFrame, text: str, label: str, cohort: str, cohorts: list[int], lag: int = 1, **how) -> DataFrame:
    """Rows of the listed cohorts with scores of a text model of the cohorts before; a cohort without any stays out. Vocabulary and weights see no later text."""
    out = None
    for now in cohorts:
        train = df.filter(F.col(cohort) <= now - lag)
        if train.filter(F.col(label).isNotNull()).isEmpty():
            continue
        own = text_ridge(train, df.filter(F.col(cohort) == now), text, label, **how)
        out = own if out is None else out.unionByName(own)
    return out


def bin_shares(train: DataFrame, test: DataFrame, features: list[str], bins: str, n: int) -> DataFrame:
    """test with ``p0`` .. shares of outcome bins by a multinomial classifier, and ``expected``, the sum of bin numbers times shares."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ban_columns(features, names=(bins,))
    own = [f"_f{i}" for i in range(len(features))]
    cast = lambda d: d.withColumns({f: F.col(c).cast("double") for f, c in zip(own, features, strict=True)})
    steps = [Imputer(inputCols=own, outputCols=[f"{c}i" for c in own]), VectorAssembler(inputCols=[f"{c}i" for c in own], outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol=bins, probabilityCol="_p", family="multinomial", regParam=0.01)]
    model = Pipeline(stages=steps).fit(cast(train.filter(F.col(bins).isNotNull())))
    out = model.transform(cast(test)).withColumn("_a", vector_to_array("_p"))
    shares = {f"p{i}": F.coalesce(F.get("_a", F.lit(i)), F.lit(0.0)) for i in range(n)}
    out = out.withColumns(shares).withColumn("expected", sum((F.col(f"p{i}") * i for i in range(n)), F.lit(0.0)))
    return out.select(*test.columns, *shares, "expected")


def expected_changes(
    df: DataFrame, key: str, period: str, features: list[str], targets: dict[str, str], later: dict[str, str], surprise_of: str, periods: list[int], *, least_rows: int = 1, **how
) -> DataFrame:
    """Rows of the listed periods with the change that each target is expected to make.

    targets: new column to measure, over one period; later: the same over two. For each period a
    boosted model is fitted on the changes that had ended by then; periods with fewer than
    least_rows of them get NULL. ``surprise`` is the last change of one measure less what was expected of it from
    the row before. how: goes to the boosted fits.
    """
    from orderloom.operators import boosting

    def known(gap: int) -> DataFrame:
        after = df.select(F.col(key).alias("_k"), (F.col(period) - gap).alias("_p"), *(F.col(c).alias(f"_n_{c}") for c in {*targets.values(), *later.values()}))
        return df.join(after, (F.col(key) == F.col("_k")) & (F.col(period) == F.col("_p"))).drop("_k", "_p")

    def fits(gap: int, measure: str) -> dict:
        pairs = known(gap).withColumn("_change", F.col(f"_n_{measure}") - F.col(measure))
        n = {r[period]: r["n"] for r in pairs.groupBy(period).agg(F.count("*").alias("n")).collect()}
        enough = [p for p in periods if sum(c for q, c in n.items() if q + gap <= p) >= least_rows]
        return boosting.causal_fits(pairs, features, "_change", period, enough, lag=gap, **how) if enough else {}

    out = df.filter(F.col(period).isin(periods))
    first: dict = {}
    for name, measure, gap in [*((n, m, 1) for n, m in targets.items()), *((n, m, 2) for n, m in later.items())]:
        own = fits(gap, measure)
        if gap == 1 and measure == surprise_of:
            first = own
        out = boosting.scored(out, own, period, name) if own else out.withColumn(name, F.lit(None).cast("double"))
    before = df.select(F.col(key).alias("_k"), (F.col(period) + 1).alias("_p"), F.col(surprise_of).alias("_was"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(features)))
    if not first:
        return out.withColumn("surprise", F.lit(None).cast("double"))
    then = before.toDF("_k", "_p", "_was", *features).join(out.select(F.col(key).alias("_k"), F.col(period).alias("_p")).distinct(), ["_k", "_p"], "left_semi")
    then = boosting.scored(then, first, "_p", "_expected").select("_k", "_p", "_was", "_expected")
    return out.join(then, (F.col(key) == F.col("_k")) & (F.col(period) == F.col("_p")), "left").withColumn("surprise", F.col(surprise_of) - F.col("_was") - F.col("_expected")).drop("_k", "_p", "_was", "_expected")
