"""Ranking rules over columns of scores, and the small language that names them.

A rule is a name and arguments in brackets, which may be rules themselves:
``blend(a:0.7,b:0.3)``, ``median(a,b,c)``, ``tilt(a,column,-0.1)``, ``youth(a,age,0.1)``,
``stack(0.4:a,0.6:b)``, ``consensus(a,board,0.4)``, ``listed(a,board,0.4)``, ``special(a,other,member,0.5)``,
``upside(a,b,0.5)``, ``floor(a,b,0.5)``, ``route(flag,a,b)``, ``max(a,b)``, ``min(a,b)``, ``rank(a)``.
A plain name is a column. Rules compile to columns level by level: the ranks that a level needs
are taken once, whatever the number of rules that use them, so a sweep over many is one job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.nulls import corr, row_median
from orderloom.operators.lineage import cut, kept
from orderloom.operators.ranks import rank_correlations
from orderloom.operators.windows import looked_up, pct_rank, ranked, with_pct_ranks

TOKEN = re.compile(r"\s*([A-Za-z_]\w*|[-+]?\d+(?:\.\d+)?|[(),:])")
UNLISTED = 61.0  # the place behind a board's end
DIGITS = 9  # to which scores are compared, so that the order of their sums makes no order of members


def blend(parts: list[tuple[Column | str, float]], by: list[str]) -> Column:
    """Weighted mean of within-cohort percentile ranks."""
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for x, w in parts:
        out = out + pct_rank(x, by) * w
    return out / total


def consensus(x: Column | str, board: str, weight: float, by: list[str], unranked: float = UNLISTED, skip: bool = False) -> Column:
    """Blend with an outside board; who it does not list stands behind its end, or keeps the own rank."""
    own, listed = pct_rank(x, by), F.col(board)
    theirs = pct_rank(-F.coalesce(listed, F.lit(unranked)), by)
    mixed = (1 - weight) * own + weight * theirs
    return F.when(listed.isNull(), own).otherwise(mixed) if skip else mixed


def special(x: Column | str, other: str, weight: float, member: Column, by: list[str]) -> Column:
    """Members of a population blend in another rank, which is taken over the whole cohort."""
    own = pct_rank(x, by)
    return F.when(member & F.col(other).isNotNull(), (1 - weight) * own + weight * pct_rank(other, by)).otherwise(own)


@dataclass(frozen=True)
class Node:
    name: str
    args: tuple[tuple[Node | float, float | Node | None], ...] = ()

    @property
    def depth(self) -> int:
        return 1 + max((x.depth for pair in self.args for x in pair if isinstance(x, Node)), default=0) if self.args else 0


def parse(text: str) -> Node:
    """The tree of a rule's text."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        found.append(m[1])
        at = m.end()

    def value(i: int) -> tuple[Node | float, int]:
        if i >= len(found):
            raise ValueError(f"{text!r} ends early")
        t = found[i]
        if re.fullmatch(r"[-+]?\d+(?:\.\d+)?", t):
            return float(t), i + 1
        if not re.match(r"[A-Za-z_]", t):
            raise ValueError(f"unexpected {t!r}")
        if i + 1 >= len(found) or found[i + 1] != "(":
            return Node(t), i + 1
        args, i = [], i + 2
        while True:
            first, i = value(i)
            second = None
            if i < len(found) and found[i] == ":":
                second, i = value(i + 1)
            args.append((first, second))
            if i >= len(found) or found[i] not in ",)":
                raise ValueError(f"{text!r}: a bracket is open")
            if found[i] == ")":
                return Node(t, tuple(args)), i + 1
            i += 1

    node, end = value(0)
    if end != len(found) or not isinstance(node, Node):
        raise ValueError(f"{text!r} is no rule")
    return node


def _combine(name: str, first: list, second: list, pct: Callable[..., Column], place: Callable[[str], Column]) -> Column:
    """The column of one rule whose arguments are column names and numbers."""
    if name == "blend":
        weights = [1.0 if w is None else w for w in second]
        out = F.lit(0.0)
        for a, w in zip(first, weights, strict=True):
            out = out + pct(a) * w
        return out / sum(weights)
    if name == "stack":  # a missing rank counts as the middle
        out = F.lit(0.0)
        for w, x in zip(first, second, strict=True):
            out = out + w * F.coalesce(pct(x), F.lit(0.5))
        return out
    if name == "median":
        return -row_median(*(place(a) for a in first))
    if name == "rank":
        return pct(first[0])
    if name == "tilt":  # a column's gaps take the cohort's median
        return (1 - abs(first[2])) * pct(first[0]) + first[2] * pct(first[1], "median")
    if name == "youth":  # gaps take the median of all; the young come first
        return (1 - first[2]) * pct(first[0]) + first[2] * pct(first[1], "young")
    if name in ("consensus", "listed"):
        mixed = (1 - first[2]) * pct(first[0]) + first[2] * pct(first[1], "board")
        return mixed if name == "consensus" else F.when(F.col(first[1]).isNull(), pct(first[0])).otherwise(mixed)
    if name == "special":
        own = pct(first[0])
        there = F.col(first[2]).cast("boolean") & F.col(first[1]).isNotNull()
        return F.when(there, (1 - first[3]) * own + first[3] * pct(first[1])).otherwise(own)
    if name in ("upside", "floor"):
        return F.col(first[0]) + (first[2] if name == "upside" else -first[2]) * F.col(first[1])
    if name == "route":
        return F.when(F.col(first[0]).cast("boolean"), F.col(first[1])).otherwise(F.col(first[2]))
    if name in ("max", "min"):
        return (F.greatest if name == "max" else F.least)(*map(F.col, first))
    raise ValueError(f"no rule {name!r}")


def apply(df: DataFrame, rules: dict[str, str], by: list[str], **how) -> DataFrame:
    """df with one column for each named rule. how: see ``windows.ranked``."""
    columns = list(df.columns)
    df, scores = _compiled(df, rules, by, {}, how)
    return df.select(*columns, *(x.alias(name) for name, x in scores.items()))


def _compiled(df: DataFrame, rules: dict[str, str], by: list[str], known: dict[tuple[str, str], str], how: dict, start: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """df with all ranks that rules need and with rules that others rest on; and every rule as an expression over it. known: names of ranks that df has. start: df as it was read, if it has gained ranks since."""
    trees, base = {name: parse(text) for name, text in rules.items()}, df if start is None else start
    inner: dict[Node, str] = {}

    def gather(node: Node) -> None:
        for pair in node.args:
            for x in pair:
                if isinstance(x, Node):
                    gather(x)
        if node.args:
            inner.setdefault(node, f"_rule{len(inner)}")

    for tree in trees.values():
        gather(tree)
    given = lambda x: x if not isinstance(x, Node) else inner.get(x, x.name)
    held = dict(known)
    inside = {x for node in inner for pair in node.args for x in pair if isinstance(x, Node)}
    last: dict[str, Column] = {}
    for depth in range(1, max((n.depth for n in inner), default=0) + 1):
        need: dict[tuple[str, str], str] = {}

        def rank(column: str, kind: str, need=need) -> str:
            if (column, kind) not in held:
                need.setdefault((column, kind), f"_rank{len(held) + len(need)}")
            return held.get((column, kind)) or need[column, kind]

        def pct(column: str, kind: str = "plain", rank=rank) -> Column:
            name = rank(column, kind)
            return F.col(name) / F.col(f"{name}_n")

        def place(column: str, rank=rank) -> Column:  # from the top
            name = rank(column, "plain")
            return F.col(f"{name}_n") + 1 - F.col(name)

        made = {}
        for node, name in inner.items():
            if node.depth == depth:
                first, second = ([given(pair[i]) for pair in node.args] for i in (0, 1))
                made[name] = _combine(node.name, first, second, pct, place)
        df = _with_ranks(df, need, by, how, base)
        held |= need
        below = {inner[n] for n in inside if n in inner}
        df = df.withColumns({c: x for c, x in made.items() if c in below})
        last |= {c: x for c, x in made.items() if c not in below}  # nothing is ranked by these, so they need not travel
    return df, {name: last.get(given(tree), F.col(given(tree))) for name, tree in trees.items()}


def _with_ranks(df: DataFrame, need: dict[tuple[str, str], str], by: list[str], how: dict, start: DataFrame | None = None) -> DataFrame:
    """df with the ranks that a level asks for and the numbers of ranked values, named as asked. start: the same rows before the levels below, for medians of its columns."""
    filled = {}
    source = lambda *names: start if start is not None and set(names) <= set(start.columns) else df
    if middle := [c for c, kind in need if kind == "median"]:
        # one row a cohort, so rows stay where they are
        df = looked_up(df, cut(source(*by, *middle).groupBy(*by).agg(*(F.median(c).alias(f"_median{i}") for i, c in enumerate(middle)))), by)
    for (column, kind), name in need.items():
        c = F.col(column).cast("double")
        if kind == "median":
            c = F.coalesce(c, F.col(f"_median{middle.index(column)}"))
        elif kind == "young":
            c = -F.coalesce(c, F.lit(source(column).agg(F.median(column)).first()[0]))
        elif kind == "board":
            c = -F.coalesce(c, F.lit(UNLISTED))
        filled[f"_of{name}"] = F.round(c, DIGITS)
    if not need:
        return df
    return ranked(df.withColumns(filled), by, {n: f"_of{n}" for n in need.values()}, counts=True, **how).drop(*filled, *(f"_median{i}" for i in range(len(middle))))


def prepared(df: DataFrame, columns: list[str], by: str, value: str, **how) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """(df with ranks of columns and of a value, kept; their names): what the rounds of a search have in common."""
    known = {(c, "plain"): f"_known{i}" for i, c in enumerate(columns)}
    return kept(ranked(_with_ranks(df, known, [by], how), [by], {"_v": value}, **how)), known


def rhos(df: DataFrame, rules: dict[str, str], by: str, value: str, known: dict[tuple[str, str], str] | None = None, **how) -> DataFrame:
    """(rule, by, rho): every rule's rank correlation with a value in every cohort. known: with a table of ``prepared``.

    Scores never become rows: tasks sort each rule's and send them on packed, with the value's rank
    beside, and a cohort's rule, or a range of its scores, is ranked in one place.
    """
    placed = df if known is not None else ranked(df, [by], {"_v": value}, **how)  # while rows are narrow
    made, scores = _compiled(placed, rules, [by], known or {}, how, df)
    if made is not df:
        made = kept(made)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if made._jdf.queryExecution().toRdd().getNumPartitions() < parts:
        made = made.repartition(parts)  # few bytes are few tasks, and each row has many scores
    scored = made.select(by, "_v", F.array(*(x.cast("double") for x in scores.values())).alias("_scores"))
    told = rank_correlations(scored, by, "_v", "_scores", len(rules), digits=DIGITS)
    return told.select(F.element_at(F.array(*map(F.lit, rules)), F.col("_rule") + 1).alias("rule"), by, "rho")


def sweep(df: DataFrame, rules: dict[str, str], by: str, value: str, **how) -> DataFrame:
    """(rule, mean_rho, wins, n): every rule's rank correlation with a value over cohorts, in one job."""
    return rhos(df, rules, by, value, **how).groupBy("rule").agg(F.avg("rho").alias("mean_rho"), F.count_if(F.col("rho") > 0).alias("wins"), F.count("rho").alias("n"))


def wide(predictions: DataFrame, by: str, key: str, configs: list[str], bins: int) -> DataFrame:
    """(by, key, one score for each config, and for configs with bins ``{config}_top``, ``_low`` and ``_bin``).

    predictions: by, key, config, member, score and p0 .. p(bins - 1). The score is that of member -1, the
    whole config; shares are those of the config's first member that has any, and its expected bin is the
    sum of bin numbers times shares. Rows of one config, member and key must not repeat.
    """
    shares = [f"p{i}" for i in range(bins)]
    has = sum((F.col(p).isNotNull().cast("int") for p in shares), F.lit(0)) > 0
    some = (F.col("member") >= 0) & has
    expected = sum((F.coalesce(F.col(p), F.lit(0.0)) * i for i, p in enumerate(shares)), F.lit(0.0))
    top = F.coalesce(*(F.col(p) for p in reversed(shares)))
    low = F.coalesce(*(F.col(p) for p in shares))
    out = []
    for c in configs:
        own = F.col("config") == c
        at = F.when(own & some, F.col("member"))  # numbers alone: a minimum of structs would be sorted for
        out += [F.max(F.when(own & (F.col("member") == -1), F.col("score"))).alias(c), *(F.min_by(x, at).alias(f"{c}_{n}") for n, x in (("top", top), ("low", low), ("bin", expected)))]
    rows = predictions.groupBy(by, key).agg(*out)
    return rows.select(by, key, *configs, *(f"{c}_{n}" for c in configs for n in ("top", "low", "bin")))


def weight_grid(df: DataFrame, a: str, b: str, by: str, value: str, steps: int = 10, **how) -> DataFrame:
    """(weight, mean_rho) of blends w * a + (1 - w) * b for a grid of weights."""
    ranks = with_pct_ranks(df.select(by, F.col(a).alias("_u"), F.col(b).alias("_w"), F.col(value).alias("_y")), [by], {"_a": "_u", "_b": "_w"}, **how)
    ranks = ranked(ranks, [by], {"_v": "_y"}, **how).select(by, "_a", "_b", "_v")
    grid = ranks.withColumn("weight", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("weight", F.col("weight") / steps)
    mixed = grid.withColumn("_m", F.round(F.col("weight") * F.col("_a") + (1 - F.col("weight")) * F.col("_b"), 9))
    both = ranked(mixed, [by, "weight"], {"_s": "_m"}, **how)
    return both.groupBy(by, "weight").agg(corr("_s", "_v").alias("rho")).groupBy("weight").agg(F.avg("rho").alias("mean_rho"))


def greedy(df: DataFrame, candidates: list[str], by: str, value: str, rounds: int = 12, least_gain: float = 1e-6, known: dict[tuple[str, str], str] | None = None) -> list[str]:
    """Forward selection with repetition: each round adds the column that helps the blend most, until none does. One job a round."""
    if known is None:
        df, known = prepared(df, candidates, by, value)
    chosen: list[str] = []
    last: float | None = None
    for _ in range(rounds):
        rules = {c: "blend(" + ",".join(f"{x}:{[*chosen, c].count(x)}" for x in dict.fromkeys([*chosen, c])) + ")" for c in candidates}
        got = sweep(df, {f"try_{c}": r for c, r in rules.items()}, by, value, known=known).withColumn("mean_rho", F.round("mean_rho", 12)).orderBy(F.desc("mean_rho"), "rule").first()
        if last is not None and got["mean_rho"] <= last + least_gain:
            break
        chosen.append(got["rule"].removeprefix("try_"))
        last = got["mean_rho"]
    return chosen


def blend_fitness(df: DataFrame, by: str, value: str, spread: float = 0.1, known: dict[tuple[str, str], str] | None = None, **how) -> Callable[[list[dict[str, float]]], list[float]]:
    """A function of some sets of weights: the mean correlation of each blend over cohorts less a share of its deviation, all from one job."""

    def fitness(drawn: list[dict[str, float]]) -> list[float]:
        blends = {f"w{i}": "blend(" + ",".join(f"{c}:{v:.6f}" for c, v in w.items() if v > 0) + ")" for i, w in enumerate(drawn)}
        got = rhos(df, blends, by, value, known, **how).groupBy("rule").agg(F.avg("rho").alias("m"), F.stddev_pop("rho").alias("s")).collect()
        judged = {r["rule"]: r["m"] - spread * r["s"] for r in got if r["m"] is not None}
        return [judged.get(f"w{i}", float("-inf")) for i in range(len(drawn))]

    return fitness


def tuned_blend(df: DataFrame, configs: list[str], by: str, value: str, trials: int, seed: int = 0, **how) -> str | None:
    """The blend that a Parzen search finds on all cohorts but the latest two, which stay for confirmation; None with fewer than four cohorts or two configs."""
    from orderloom.operators.specs import parzen_weights

    cohorts = sorted(r[by] for r in df.select(by).distinct().collect())
    if len(configs) < 2 or len(cohorts) < 4:
        return None
    rows, known = prepared(df.filter(F.col(by) < cohorts[-2]), configs, by, value, **how)
    weights, _ = parzen_weights(blend_fitness(rows, by, value, known=known, **how), configs, trials, seed)
    return "blend(" + ",".join(f"{c}:{w:.6f}" for c, w in weights.items() if w > 0) + ")"


# -- exhaustive sweep ----------------------------------------------------------------------


@dataclass(frozen=True)
class Covers:
    """Columns that overlays may lean on; None where a table has none."""

    age: str | None = None
    board: str | None = None
    other: str | None = None  # a score of a population
    member: str | None = None  # flag of that population
    tilts: tuple[str, ...] = ()
    short: tuple[tuple[str, str, str], ...] = ()  # (config, flag of cohorts with short labels, its twin)
    bins: tuple[tuple[str, str, str, str], ...] = ()  # (config, expected bin, share of the top bin, share of the bottom bin)


def pure_rules(configs: list[str], order: list[str], covers: Covers) -> dict[str, str]:
    """Rules of predictions alone. order: configs from best to worst, for the blends of the best few."""
    out = {f"one {c}": f"rank({c})" for c in configs}
    out |= {f"route {c}": f"route({flag},{twin},{c})" for c, flag, twin in covers.short}
    if len(configs) > 1:
        out["blend all"] = f"blend({','.join(configs)})"
        out["median all"] = f"median({','.join(configs)})"
        out |= {f"blend {a} {b}": f"blend({a},{b})" for i, a in enumerate(configs) for b in configs[i + 1 :]}
        for k in range(3, min(len(order), 8) + 1):
            out[f"blend best {k}"], out[f"median best {k}"] = f"blend({','.join(order[:k])})", f"median({','.join(order[:k])})"
    for c, expected, top, bottom in covers.bins:
        for much in (0.5, 1.0, 2.0, 4.0):
            out[f"upside {c} {much}"], out[f"floor {c} {much}"] = f"upside({expected},{top},{much})", f"floor({expected},{bottom},{much})"
    return out


def overlays(name: str, rule: str, covers: Covers) -> dict[str, str]:
    """Rules that lean a rule towards what was known beside the predictions."""
    out = {}
    if covers.other and covers.member:
        out |= {f"special {a} on {name}": f"special({rule},{covers.other},{covers.member},{a})" for a in (0.3, 0.5, 0.7, 1.0)}
    if covers.age:
        out |= {f"youth {b} on {name}": f"youth({rule},{covers.age},{b})" for b in (0.1, 0.2, 0.3)}
    for c in covers.tilts:
        out |= {f"tilt {c} {b} on {name}": f"tilt({rule},{c},{b})" for b in (-0.15, -0.08, 0.08, 0.15)}
    if covers.board:
        out |= {f"consensus {w} on {name}": f"consensus({rule},{covers.board},{w})" for w in (0.3, 0.4, 0.5, 0.6, 0.7)}
        out |= {f"listed {w} on {name}": f"listed({rule},{covers.board},{w})" for w in (0.5, 0.6)}
    return out


@dataclass(frozen=True)
class Judged:
    rule: str
    text: str
    mean_rho: float
    gain: float  # over the best single config, mean over cohorts
    wins: int
    robust: bool


def exhaustive(df: DataFrame, configs: list[str], by: str, value: str, covers: Covers = Covers(), *, trials: int = 0, **how) -> list[Judged]:
    """All rules from best to worst; a few jobs, each over all rules of its stage. What is collected is one number a rule and cohort.

    trials: of the search for the rule "tuned", which is left out with none.
    """
    rules: dict[str, str] = {}
    found: dict[str, dict] = {}
    given = df
    df, known = prepared(df, configs, by, value, **how)

    def judge(more: dict[str, str]) -> None:
        if not more:
            return
        names = {f"r{len(rules) + i}": n for i, n in enumerate(more)}
        for r in rhos(df, {k: more[n] for k, n in names.items()}, by, value, known, **how).collect():
            if r["rho"] is not None:
                found.setdefault(names[r["rule"]], {})[r[by]] = r["rho"]
        rules.update(more)

    mean = lambda n: sum(found[n].values()) / len(found[n]) if found.get(n) else float("-inf")
    best = lambda names: sorted(names, key=lambda n: (-mean(n), n))
    judge({f"one {c}": f"rank({c})" for c in configs})
    order = [n.removeprefix("one ") for n in best([f"one {c}" for c in configs])]
    pure = pure_rules(configs, order, covers)
    if len(configs) > 1:
        chosen = greedy(df, configs, by, value, known=known)
        pure["greedy"] = "blend(" + ",".join(f"{c}:{chosen.count(c)}" for c in dict.fromkeys(chosen)) + ")"
    if trials and (tuned := tuned_blend(given, configs, by, value, trials, **how)):
        pure["tuned"] = tuned
    judge({n: r for n, r in pure.items() if n not in rules})
    judge({k: v for n in best(list(rules))[:3] for k, v in overlays(n, rules[n], covers).items()} | ({"board alone": f"consensus({configs[0]},{covers.board},1.0)"} if covers.board else {}))
    leaning = [n for n in rules if n.startswith(("consensus", "youth"))]
    if leaning and covers.other and covers.member:
        top = best(leaning)[0]
        judge({f"special {a} on {top}": f"special({rules[top]},{covers.other},{covers.member},{a})" for a in (0.3, 0.5)})
    base = f"one {order[0]}"
    out = []
    for n in best(list(rules)):
        cohorts = sorted(set(found.get(n, {})) & set(found.get(base, {})))
        gains = [found[n][c] - found[base][c] for c in cohorts]
        needed = len(cohorts) if len(cohorts) <= 5 else -(-8 * len(cohorts) // 10)
        gain, wins = (sum(gains) / len(gains) if gains else float("-inf")), sum(g > 0 for g in gains)
        holds = gain >= 0.01 and wins >= needed and all(g > 0 for g in gains[-2:])
        out.append(Judged(n, rules[n], mean(n), gain, wins, n == base or holds))
    return out
