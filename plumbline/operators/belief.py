"""Belief propagation between users, reviews and products, without labels, in log-odds.

A message is one number, the log-odds of fraud. Each round is two sums (per user, per product) joined back and expressions
on the row; the frame is written to the shared folder each round, so the plan stays short.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.behavior import Q, r6
from plumbline.operators.bursts import RZ, SPINE, ZS, burst_z
from plumbline.operators.cliques import LOCAL, at_once, codes
from plumbline.operators.evaluate import DIGITS, _metrics_sql, metrics, percentile_priors
from plumbline.operators.facts import beside, sql
from plumbline.operators.relations import TRAIN, in_train
from plumbline.scratch import counted, cut, forget

EPS, DAMPING, TOLERANCE, MAX_ROUNDS = 0.15, 0.5, 1e-4, 150
CLIP = 1e-6


def priors(r: DataFrame) -> DataFrame:
    """(review_id, u, b, prior_r, prior_u, prior_b): means of percentiles of reviews, of users and of products.

    Reviews: distance from the business's mean, burst z. Users: share of extreme ratings, most reviews a day.
    Products: greatest burst z. Users and products are ranked among their kind, not among reviews. A distance is that of
    a business and rating, a burst that of a business and week, so these are counted and ranked, not reviews.
    """
    z = cut(burst_z(r).select("b", "week", F.round("z", 9).alias("z"), "n"))
    stars = cut(with_distance(r.groupBy("b", "rating").agg(F.count(F.lit(1)).alias("n"))))
    per_day = r.groupBy("u", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rating").isin(1.0, 5.0).cast("int")).alias("e"))
    user = cut(per_day.groupBy("u").agg(F.max("n").cast("double").alias("m"), F.round(F.sum("e") / F.sum("n"), 9).alias("x")))
    product = z.groupBy("b").agg(F.max("z").alias("peak"))
    of = lambda df, c, n: df.select(F.lit(c).alias("kind"), F.col(c).alias("value"), n.alias("c"))
    values = of(stars, "dev", F.col("n")).unionByName(of(z, "z", F.col("n")))
    for df, c in ((user, "m"), (user, "x"), (product, "peak")):
        values = values.unionByName(of(df, c, F.lit(1).cast("bigint")))
    p = cut(percentile_priors(values))
    take = lambda c: p.filter(F.col("kind") == c).select(F.col("value").alias(c), F.col("prior").alias(f"p_{c}"))
    user = user.join(take("m"), "m").join(take("x"), "x").select("u", ((F.col("p_m") + F.col("p_x")) / 2).alias("prior_u"))
    product = product.join(take("peak"), "peak").select("b", F.col("p_peak").alias("prior_b"))
    dev = stars.join(take("dev"), "dev").join(product, "b").select("b", "rating", "p_dev", "prior_b")
    week = z.join(take("z"), "z").select("b", "week", "p_z")
    x = r.select("review_id", "u", "b", "rating", "week").join(dev, ["b", "rating"]).join(week, ["b", "week"]).join(user, "u")
    return x.select("review_id", "u", "b", ((F.col("p_dev") + F.col("p_z")) / 2).alias("prior_r"), "prior_u", "prior_b")


def with_distance(s: DataFrame) -> DataFrame:
    """(b, rating, n) with dev, the distance of the rating from the mean of the business."""
    mean = s.groupBy("b").agg((F.sum(F.col("rating") * F.col("n")) / F.sum("n")).alias("mean"))
    return s.join(mean, "b").select("b", "rating", "n", F.round(F.abs(F.col("rating") - F.col("mean")), 9).alias("dev"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _passed(x: Column) -> Column:
    """What a neighbour concludes from log-odds x: alike with 1 - EPS."""
    e = F.exp(x)
    return F.ln((EPS + (1 - EPS) * e) / ((1 - EPS) + EPS * e))


def _passed_any(x: Column) -> Column:
    """`_passed` for numbers of any size; that one, the SQL's, is not a number from 710 on, which some 1,000 reviews of one
    user come to."""
    e = F.exp(-F.abs(x))
    return F.signum(x) * F.ln(((1 - EPS) + EPS * e) / (EPS + (1 - EPS) * e))


def _damped(old: Column, new: Column) -> Column:
    p = DAMPING * _sigmoid(old) + (1 - DAMPING) * _sigmoid(new)
    return F.ln(p / (1 - p))


def propagated(p: DataFrame, rounds: int | None = None) -> DataFrame:
    """(review_id, belief) after `rounds` Jacobi rounds, or until no belief moves by TOLERANCE, looked at every round.

    To the end, up to LOCAL reviews one task goes through all rounds, so that a round costs no job; else each is a job of its own.
    """
    if rounds:
        return _by_rounds(p, rounds)
    p, n = counted(p.select(F.col("review_id").cast("bigint"), F.col("u").cast("bigint"), F.col("b").cast("bigint"), "prior_r", "prior_u", "prior_b"))
    if n > LOCAL:
        return _by_rounds(p)
    m = p.select("review_id", "u", "b", *[_logit(F.col(f"prior_{x}")).alias(f"l{x}") for x in "rub"])
    return at_once(m, _rounds, "review_id bigint, belief double")


def _rounds(review_id, u, b, lr, lu, lb, rounds: int | None = None) -> list:
    u, b = codes(u), codes(b)
    ur, ru, br, rb = (np.zeros(len(lr)) for _ in range(4))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    belief = sigmoid(lr)

    def passed(x):
        e = np.exp(-np.abs(x))
        return np.sign(x) * np.log(((1 - EPS) + EPS * e) / (EPS + (1 - EPS) * e))

    def damped(old, new):
        q = DAMPING * sigmoid(old) + (1 - DAMPING) * sigmoid(new)
        return np.log(q / (1 - q))

    for _ in range(rounds or MAX_ROUNDS):
        # The four messages are made from those of the round before.
        xu, xb, xr, xs = lu + np.bincount(u, ru)[u] - ru, lb + np.bincount(b, rb)[b] - rb, lr + br, lr + ur
        ur, br, ru, rb = damped(ur, passed(xu)), damped(br, passed(xb)), damped(ru, passed(xr)), damped(rb, passed(xs))
        was, belief = belief, sigmoid(lr + ur + br)
        if rounds is None and np.abs(belief - was).max() < TOLERANCE:
            break
    return [review_id, belief]


def _by_rounds(p: DataFrame, rounds: int | None = None) -> DataFrame:
    """As `propagated`: what a user or product hears is summed per task and per key and joined back; a round is written once,
    and the round before is removed.
    """
    passed = _passed if rounds else _passed_any
    m = p.select("review_id", "u", "b", _logit(F.col("prior_r")).alias("lr"), _logit(F.col("prior_u")).alias("lu"), _logit(F.col("prior_b")).alias("lb"), *[F.lit(0.0).alias(c) for c in ("ur", "ru", "br", "rb")])
    m = cut(m.withColumn("belief", _sigmoid(F.col("lr"))))
    for _ in range(rounds or MAX_ROUNDS):
        x = m.join(m.groupBy("u").agg(F.sum("ru").alias("su")), "u").join(m.groupBy("b").agg(F.sum("rb").alias("sb")), "b").select(
            "review_id", "u", "b", "lr", "lu", "lb", F.col("belief").alias("was"),
            _damped(F.col("ur"), passed(F.col("lu") + F.col("su") - F.col("ru"))).alias("ur"), _damped(F.col("br"), passed(F.col("lb") + F.col("sb") - F.col("rb"))).alias("br"),
            _damped(F.col("ru"), passed(F.col("lr") + F.col("br"))).alias("ru"), _damped(F.col("rb"), passed(F.col("lr") + F.col("ur"))).alias("rb"),
        ).withColumn("belief", _sigmoid(F.col("lr") + F.col("ur") + F.col("br")))
        x = cut(x)
        forget(m)
        m = x
        if rounds is None and (m.agg(F.max(F.abs(F.col("belief") - F.col("was")))).first()[0] or 0.0) < TOLERANCE:
            break
    return m.select("review_id", "belief")


def evaluated(r: DataFrame, b: DataFrame) -> DataFrame:
    """(variant, n, n_pos, auc, ap, recall...) of beliefs: all labelled reviews, held-out ones, and those of reviewers with
    a single review; priors beside them as the base they start from."""
    x = r.select("review_id", "y", "u", in_train(r).alias("train")).join(b, "review_id")
    x = beside(x, "u", F.count(F.lit(1)).alias("un"))
    names = F.filter(F.array(F.lit("all"), F.when(~F.col("train"), "held_out"), F.when(F.col("un") == 1, "cold_start")), lambda v: v.isNotNull())
    x = x.select("y", F.explode(names).alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("score_of"), F.round(F.col(c), DIGITS).alias("score")) for c in b.columns if c != "review_id"])).alias("s")).select("y", "part", "s.*")
    return metrics(x, ["score_of", "part"])


def evaluated_rounds(r: DataFrame, rounds: int | None = None) -> DataFrame:
    p = cut(priors(r))
    return evaluated(r, propagated(p, rounds).join(p.select("review_id", F.col("prior_r").alias("prior")), "review_id"))


QUERIES = {
    "g19_priors": Q(lambda r: priors(r).select("review_id", *[r6(f"prior_{x}").alias(f"prior_{x}") for x in "rub"])),
    "g20_belief_3_rounds": Q(lambda r: propagated(priors(r), 3).select("review_id", r6("belief").alias("belief"))),
    "g20_belief_evaluation_3_rounds": Q(lambda r: evaluated_rounds(r, 3)), "g20_belief_evaluation": Q(evaluated_rounds),
    "g20_belief_converged": Q(lambda r: propagated(priors(r)).select("review_id", r6("belief").alias("belief"))),
}
_P = lambda v: f"0.05::double + (rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2 - 1) / greatest(count(*) over () - 1, 1) * 0.9"
_PRIORS = (
    SPINE, ZS, RZ, "xr as (select review_id, u, b, day, rating, round(abs(rating - avg(rating) over (partition by b)), 9) dev, round(z, 9) z from rz)",
    f"pu as (select u, ({_P('m')} + {_P('x')}) / 2 prior_u from (select u, max(n) m, round(sum(e) / sum(n), 9) x from (select u, day, count(*) n, sum((rating in (1, 5))::int) e from xr group by 1, 2) group by 1))",
    f"pb as (select b, {_P('peak')} prior_b from (select b, max(z) peak from xr group by 1))",
    f"pp as (select * from (select review_id, u, b, ({_P('dev')} + {_P('z')}) / 2 prior_r from xr) join pu using (u) join pb using (b))",
)
_LG = lambda c: f"ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)))"
_SG = lambda x: f"(1 / (1 + exp(-({x}))))"
_PS = lambda x: f"ln((0.15::double + 0.85::double * exp({x})) / (0.85::double + 0.15::double * exp({x})))"


def _round(prev: str) -> str:
    d = lambda o, n: f"ln((0.5::double * {_SG(o)} + 0.5::double * {_SG(n)}) / (1 - (0.5::double * {_SG(o)} + 0.5::double * {_SG(n)})))"
    return f"""select review_id, u, b, lr, lu, lb, {d('ur', 'nur')} ur, {d('br', 'nbr')} br, {d('ru', 'nru')} ru, {d('rb', 'nrb')} rb from (select *, {_PS('lu + su - ru')} nur, {_PS('lb + sb - rb')} nbr, {_PS('lr + br')} nru, {_PS('lr + ur')} nrb
 from (select *, sum(ru) over (partition by u) su, sum(rb) over (partition by b) sb from {prev}))"""


_M3 = (
    *_PRIORS, f"m0 as (select review_id, u, b, {_LG('prior_r')} lr, {_LG('prior_u')} lu, {_LG('prior_b')} lb, 0::double ur, 0::double br, 0::double ru, 0::double rb from pp)",
    f"m1 as ({_round('m0')})", f"m2 as ({_round('m1')})", f"m3 as ({_round('m2')})",
)
_EV = f"""ev as (select y, score_of, round(s, 9) score, unnest(list_filter(['all', case when not train then 'held_out' end, case when un = 1 then 'cold_start' end], lambda v: v is not null)) part from
 (select y, {_SG('lr + ur + br')} belief, prior_r prior, {TRAIN} = 1 train, count(*) over (partition by r.u) un from r join m3 using (review_id) join pp using (review_id)) unpivot (s for score_of in (belief, prior)))"""
SQL = {
    "g19_priors": sql("select review_id, round(prior_r, 6) prior_r, round(prior_u, 6) prior_u, round(prior_b, 6) prior_b from pp", *_PRIORS),
    "g20_belief_3_rounds": sql(f"select review_id, round({_SG('lr + ur + br')}, 6) belief from m3", *_M3),
    "g20_belief_evaluation_3_rounds": sql(_metrics_sql("ev", "score_of, part"), *_M3, _EV),
}
