"""Hand-made goldens, invariants and edge cases of the core."""
import datetime
import math
import random
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.operators import behavior, belief, bursts, cliques, components, evaluate, facts, graphs, hotkeys, models, prefix, relations, textsim, trailing
from plumbline.sources import readers, writers
from plumbline.streaming import weekly

R8 = [(1, 1, 1, 5.0, "2024-01-01", 0), (2, 1, 1, 5.0, "2024-01-01", 1), (3, 2, 1, 5.0, "2024-01-03", 1), (4, 3, 1, 1.0, "2024-01-16", 0), (5, 2, 2, 3.0, "2024-01-20", 0), (6, 4, 2, 3.0, "2024-01-21", 1), (7, 1, 2, 1.0, "2024-02-05", 0), (8, 5, 3, 4.0, "2024-02-06", 0)]
META = "review_id bigint, reviewer_id bigint, business_id bigint, rating double, label int, date string, loaded_at timestamp"


@pytest.fixture
def r8(spark):
    rows = [(*x[:4], datetime.date.fromisoformat(x[4]), x[5]) for x in R8]
    return facts.keyed(spark.createDataFrame(rows, "review_id bigint, u bigint, b bigint, rating double, day date, y int"))


def by(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


def test_goldens(r8):
    b = {r["b"]: r for r in behavior.business_stats(r8).collect()}
    assert (b[1].business_n_reviews, b[1].business_rating_std, b[1].business_singleton_reviewer_ratio) == (4, 2.0, 0.25)
    assert (b[2].business_rating_mean, b[2].business_rating_std, b[3].business_rating_std) == (2.333333, 1.154701, 0.0)
    u = {r["u"]: r for r in behavior.reviewer_stats(r8).collect()}
    assert [u[i].reviewer_avg_rd for i in (1, 2, 3, 4, 5)] == [1.111111, 0.833333, 3.0, 0.666667, 0.0]
    assert [u[i].reviewer_mnr for i in (1, 2)] == [1.0, 0.5] and [u[i].reviewer_bst for i in (1, 2, 3)] == [0.0, 0.392857, 0.0]
    assert [u[i].reviewer_erd for i in (1, 2, 3)] == [0.918296, 1.0, 0.0] and [u[i].reviewer_etg for i in (1, 2)] == [1.0, 0.0]
    assert by(behavior.temporal_position(r8), "review_id", "temporal_position") == {1: 0, 2: 0.333333, 3: 0.666667, 4: 1, 5: 0, 6: 0.5, 7: 1, 8: 0.5}
    z = by(bursts.review_burst(r8), "review_id", "z")
    assert [round(z[i], 6) for i in range(1, 9)] == [1.336306, 1.336306, 1.336306, -0.267261, 1.507557, 1.507557, 0.301511, 0]
    loo = {r["review_id"]: r for r in relations.loo(r8).collect()}
    assert [loo[i].loo_rur for i in range(1, 9)] == [0.5, 0, 0, 0.375, 1, 0.375, 0.5, 0.375] and [loo[i].loo_rsr for i in range(1, 9)] == [1, 0.5, 0.5, 0.375, 1, 0, 0.375, 0.375]
    auc = by(evaluate.metrics(evaluate.signals(r8), ["signal"]), "signal", "auc")
    assert auc["loo_rur"] == 0.066667 and auc["loo_rsr"] == auc["loo_rtr"] == 0.4
    g = {r["relation"]: r for r in relations.group_sizes(r8).collect()}
    assert all((g[x].n_groups, g[x].n_edges) == (5, 8) for x in g)
    assert all(r.max_density == 1.0 for r in relations.fraudar(r8).collect())


def test_entropy_bound_and_thetas(spark):
    c = spark.createDataFrame([(1, i, 2) for i in range(5)], "k int, v int, n int")
    assert abs(behavior.entropy(c, "k").first().h - math.log2(5)) < 1e-12
    assert relations.beta_thetas(2) == [[3, -3, 0.75], [0, 3, -1.5], [0, 0, 0.75]]


def test_empty_facts(spark, r8):
    none = r8.filter("false")
    for f in (behavior.business_stats, behavior.reviewer_stats, bursts.weekly, bursts.peaks, relations.group_sizes, relations.oddball, relations.fraudar, relations.union_edges, relations.enrichment, lambda r: evaluate.metrics(evaluate.signals(r), ["signal"]), lambda r: evaluate.topk(evaluate.signals(r), ["signal"])):
        assert f(none).count() == 0


def test_facts_take_the_last_row_and_drop_what_is_unusable(spark, folder):
    t = datetime.datetime
    folder.write("yelp_nyc_metadata", [
        (1, 5, 7, 1.0, 1, "2020-01-02", t(2020, 1, 3)), (1, 5, 7, 4.0, -1, "1/2/2020", t(2020, 2, 3)),  # the later row holds
        (2, 5, 7, 4.0, 1, "Jan 5, 2020", t(2020, 1, 4)),  # later than the day it was loaded
        (3, 0, 7, 4.0, 1, "2020-01-02", t(2020, 1, 4)), (4, 5, None, 4.0, 1, "2020-01-02", t(2020, 1, 4)), (5, 5, 7, float("nan"), 1, "2020-01-02", t(2020, 1, 4)), (6, 5, 7, 3.0, None, "2020-01-02", t(2020, 1, 4)), (7, 5, 7, 3.0, 1, "", None), (None, 5, 7, 3.0, 1, "2020-01-02", None),
    ], META)
    rows = facts.facts(spark, folder.at).collect()
    assert [(r.review_id, r.rating, str(r.day), r.y) for r in rows] == [(1, 4.0, "2020-01-02", 1)]
    assert facts.facts(spark, folder.at, labelled=False).count() == 2


def test_day_notations(spark):
    d = spark.createDataFrame([("2021-02-03",), ("2021-02-03 04:05:06",), ("2/3/2021",), ("02/03/2021",), ("Feb 3, 2021",), (" 2021-02-03 ",), ("13/1/2021",), ("",), (None,), ("soon",)], "x string")
    got = [str(r.d) for r in d.select(trailing.day_of("x").alias("d")).collect()]
    assert got == ["2021-02-03"] * 6 + ["None"] * 4


def test_rolling_against_brute_force(spark):
    rnd, day0 = random.Random(1), datetime.date(2020, 1, 1)
    rows = [(i, rnd.choice([1, 2, 3]), day0 + datetime.timedelta(rnd.randrange(90)), rnd.choice([1.0, 2.5, None])) for i in range(200)] + [(999, None, day0, 1.0)]
    got = {(r.e, r.day): r for r in trailing.rolling(spark.createDataFrame(rows, "review_id int, e int, day date, rating double"), "e").collect()}
    want = {}
    for e in (1, 2, 3):
        own = [r for r in rows if r[1] == e]
        d, last = min(r[2] for r in own), max(r[2] for r in own)
        while d <= last:
            cell = []
            for p in (7, 30):
                w = [r[3] for r in own if 0 <= (d - r[2]).days < p]
                known = [x for x in w if x is not None]
                cell += [len(w), round(sum(known), 6), round(sum(known) / len(known), 6) if known else None]
            want[e, d] = tuple(cell)
            d += datetime.timedelta(1)
    assert {k: (r.n_7, r.total_7, r.avg_7, r.n_30, r.total_30, r.avg_30) for k, r in got.items()} == want


def test_hot_keys(spark, folder):
    rows = [(i, 1 if i % 3 else i, 0 if i % 2 else 5, "2020-01-01", "x" * (i % 4)) for i in range(300)] + [(1, 1, 5, None, None), (2, None, None, "2020-01-02", "")]
    y = spark.createDataFrame(rows, "review_id bigint, business_id bigint, reviewer_id bigint, date string, text string")
    s = hotkeys.salted(y, "business_id", ["review_id"])
    assert s.count() == len(rows) and s.filter("business_id = 1").select("_salt").distinct().count() > 10 and s.filter("business_id <> 1 and _salt <> 0").count() == 0
    assert by(hotkeys.salted_counts(y, "business_id", ["review_id"]), "business_id", "n_rows")[1] == 201
    folder.write("yelp", rows, "review_id bigint, business_id bigint, reviewer_id bigint, date string, text string")
    assert {(r.key_column, r.key_id) for r in hotkeys.p2_found(spark, folder.at).collect()} == {("business_id", 1), ("reviewer_id", 5)}
    p = {r.key_id: r for r in hotkeys.profile(y, "business_id", "reviewer_id").collect()}
    assert p[1].n_rows == 201 and p[1].n_reviews == 200 and p[1].n_others == 1
    assert hotkeys.profile(y.filter("false"), "business_id", "reviewer_id").count() == 0 and hotkeys.heavy_keys(y.filter("false"), "business_id").count() == 0


@pytest.mark.parametrize("local", [0, 20, components.LOCAL])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rnd = random.Random(3)
    for shape in ("path", "star", "random", "none"):
        e = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)], "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)], "none": []}[shape]
        e = e + ([(None, 3), (5, None), (100, 100)] if e else [])
        got = by(components.components(spark.createDataFrame(e, "src bigint, dst bigint")), "node", "component")
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in e:
            if a is not None and b is not None:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        assert got == {x: find(x) for x in list(root)}


def test_running_sums_and_numbers(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r.s for r in prefix.cumulative(df, ["g"], [F.desc("v"), F.col("i")], {"s": "v"}).collect()}
    want = {}
    for g in "ab":
        t = 0
        for _, v, i in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])):
            t += v
            want[i] = t
    assert got == want
    assert [r.n for r in scratch.numbered(df, ["v", "i"], "n").orderBy("v", "i").collect()] == list(range(1, 301))


def test_general_graphs(spark):
    two = [(a, b) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(5, 10)]
    e = spark.createDataFrame(two, "src bigint, dst bigint")
    for f in (graphs.louvain, graphs.leiden):
        assert f(e.filter("false")).count() == 0
        c = by(f(e), "node", "community")
        assert len({c[i] for i in range(6)}) == 1 and len({c[i] for i in range(10, 16)}) == 1 and c[0] != c[10]
    assert graphs.modularity(e, graphs.louvain(e)) > 0.4
    p = graphs.peeled(spark.createDataFrame(two + [(20, 21), (21, 22)], "src bigint, dst bigint")).collect()
    assert len(p) == 15 and max(r.density for r in p) > 2 and min(r.step for r in p if r.node == 20) == 0
    x = spark.createDataFrame([(i, float(i)) for i in range(6)], "review_id bigint, x double")
    clique = e.filter("src < 6 and dst < 6")
    got = {r.review_id: r for r in relations.neighbors_on_edges(clique, x).collect()}
    assert got[0].mean_loo == 3.0 and got[5].max_loo == 4.0 and got[0].group_size == 6
    assert {(r.ni, r.ei) for r in relations.egonets(clique).collect()} == {(6, 15)}
    none = e.filter("false")
    assert graphs.louvain(none).count() == graphs.peeled(none).count() == relations.egonets(none).count() == 0


def _reviews_of_groups(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randrange(6) if rnd.random() < 0.4 else 100 + rnd.randrange(60), rnd.randrange(12), float(rnd.choice([1, 5, 5])), datetime.date(2024, 1, 1 + rnd.randrange(28))) for i in range(400)]
    return facts.keyed(spark.createDataFrame(rows + [(400, 999, 99, 1.0, datetime.date(2024, 1, 1))], "review_id bigint, u bigint, b bigint, rating double, day date"))


def _no_gain_is_left(e, c):
    """Of edges (src, dst, w) and communities by node: no node gains by a move to a neighbour's, none by a join of two."""
    k, tot, to, between, m = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float), sum(w for _, _, w in e)
    for a, b, w in e:
        for x, y in ((a, b), (b, a)):
            k[x] += w
            tot[c[x]] += w
            to[x, c[y]] += w
            between[c[x], c[y]] += w
    assert all(w - tot[a] * tot[b] / (2 * m) <= 1e-6 for (a, b), w in between.items() if a != b)
    return sum(w for (a, b), w in between.items() if a == b) / (2 * m) - sum(t * t for t in tot.values()) / (4 * m * m)


def test_leiden_by_keys_makes_no_edges(spark):
    r = _reviews_of_groups(spark)
    rows = [(x.src, x.dst, 1.0) for x in relations.union_edges(r).collect()]
    c = by(graphs.by_keys(r, cliques.leiden, graphs._C, lambda: None), "node", "community")
    assert set(c) == {x for a, b, _ in rows for x in (a, b)} and all(min(i for i in c if c[i] == v) == v for v in set(c.values()))
    assert _no_gain_is_left(rows, c) > 0.3
    parts = by(components.components(spark.createDataFrame([(a, b) for a, b, _ in rows if c[a] == c[b]] + [(i, i) for i in c], "src bigint, dst bigint")), "node", "component")
    assert parts == c


def test_louvain_by_keys_makes_no_edges(spark):
    r = _reviews_of_groups(spark)
    for f, e in ((cliques.louvain, relations.union_edges(r).withColumn("w", F.lit(1.0))), (partial(cliques.louvain, weighted=True), relations.weighted_union(r).selectExpr("src", "dst", "weight * 1e4 w"))):
        rows = [(x.src, x.dst, x.w) for x in e.collect()]
        c = by(graphs.by_keys(r, f, graphs._C, lambda: None), "node", "community")
        assert set(c) == {x for a, b, _ in rows for x in (a, b)} and _no_gain_is_left(rows, c) > 0.3


def test_peeling_by_keys_equals_peeling_by_edges(spark):
    r = _reviews_of_groups(spark)
    want = {tuple(x) for x in graphs.peeled(relations.union_edges(r)).collect()}
    assert {tuple(x) for x in graphs.by_keys(r, cliques.peeled, "node bigint, step int, density double, place bigint", lambda: None).collect()} == want


def test_louvain_goes_on_until_no_gain_is_left(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "src bigint, dst bigint").coalesce(1)
    c = graphs.louvain(e)
    q, com = graphs.modularity(e, c), by(c, "node", "community")
    deg, edge = defaultdict(int), defaultdict(int)
    for i in range(300):
        for x in (i, i + 1):
            deg[com[x]] += 1
        a, b = sorted((com[i], com[i + 1]))
        edge[a, b] += 1
    # No two communities gain by joining.
    assert q > 0.885 and all(n / 300 <= deg[a] * deg[b] / (2 * 300 * 300) + 1e-9 for (a, b), n in edge.items() if a != b)


def test_leave_one_out_by_key_and_by_edges_agree(r8):
    key = {r.review_id: (r.rating_mean_loo, r.rating_max_loo) for r in relations.neighbors(r8, "k_rur", ("rating",)).collect()}
    edge = {r.review_id: (r.mean_loo, r.max_loo) for r in relations.neighbors_on_edges(relations.edges(r8, "k_rur"), r8.select("review_id", F.col("rating").alias("x"))).collect()}
    assert key == edge


def test_belief_converges_and_stays_a_probability(r8):
    b = belief.propagated(belief.priors(r8)).collect()
    assert len(b) == 8 and all(0 < r.belief < 1 for r in b)


def test_belief_in_one_task_equals_a_job_a_round(spark, r8, monkeypatch):
    p = scratch.cut(belief.priors(r8))
    want = by(belief._by_rounds(p, 4), "review_id", "belief")
    cols = [list(c) for c in zip(*[(r.review_id, r.u, r.b, *[math.log(x / (1 - x)) for x in (r.prior_r, r.prior_u, r.prior_b)]) for r in p.collect()])]
    ids, got = belief._rounds(*[np.array(c) for c in cols], rounds=4)
    assert dict(zip(ids.tolist(), got.tolist())) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(belief, "_by_rounds", None)  # no job a round, and no overflow by a user of many reviews
    many = spark.range(3000).selectExpr("id review_id", "1L u", "id b", "0.9D prior_r", "0.9D prior_u", "0.9D prior_b")
    assert all(0.9 < x.belief < 1 for x in belief.propagated(many).collect())


def test_text_similarity(spark):
    docs = spark.createDataFrame([(1, "good soup here"), (2, "good soup here"), (3, "bad tea there"), (4, None), (5, "")], "id bigint, text string")
    blocks = spark.createDataFrame([(i, "b", i) for i in range(1, 6)], "id bigint, blk string, author bigint")
    vec = spark.createDataFrame([(1, 7, 1.0), (2, 7, 1.0), (3, 8, 1.0)], "id bigint, h bigint, w double")
    assert by(textsim.max_similarity(vec, blocks), "id", "max_sim") == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    got = {r.gram for r in textsim.grams(docs.filter("id = 3")).collect()}
    assert {" ba", "bad", "ad ", " bad", "bad ", " bad "} <= got
    assert {r.id: r.n_words for r in textsim.stylometry(docs).collect()} == {1: 3, 2: 3, 3: 3, 4: 0, 5: 0}


def test_models_are_fitted_over_the_whole_grid(spark, monkeypatch):
    made, d = [], "/root/testdata/sf0.001"

    def small(cls):  # takes down what is asked for and fits a little of it
        def make(**kw):
            made.append(kw)
            return cls(**kw | {"maxIter": 1})

        return make

    monkeypatch.setattr(models, "GBTClassifier", small(models.GBTClassifier))
    monkeypatch.setattr(models, "MultilayerPerceptronClassifier", small(models.MultilayerPerceptronClassifier))
    models.trees(spark, d), models.classifier_block(spark, d)
    assert [(k["maxIter"], k["maxDepth"], k["stepSize"]) for k in made] == [(300, 5, 0.05)] * 2
    made.clear()
    assert models.wavelet_network(spark, d).count() == 1
    assert [(k["layers"], k["maxIter"]) for k in made] == [([9 * (o + 1), h, 2], 600) for o in (2, 3, 4) for h in (64, 128)]


def test_quantiles(spark):
    import numpy as np

    rnd = random.Random(4)
    rows = [(g, rnd.choice([1.0, 2.0, rnd.random()])) for g in "ab" for _ in range(101)] + [("c", 5.0), ("c", None)]
    qs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.v for r in prefix.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", qs).collect()}
    for g in "abc":
        x = [v for k, v in rows if k == g and v is not None]
        assert [got[g, q] for q in qs] == pytest.approx(list(np.quantile(x, qs)))


def test_hypergeometric_tail():
    for pop, pos, n in ((30, 9, 7), (30, 25, 10), (12, 12, 5), (50, 3, 20)):
        p = [math.comb(pos, k) * math.comb(pop - pos, n - k) / math.comb(pop, n) if n - k <= pop - pos else 0.0 for k in range(n + 1)]
        for k in range(n + 1):
            assert relations._tail(pop, pos, n, k) == pytest.approx(sum(p[k:]), abs=1e-12)
    assert 0 < relations._tail(10**10, 10**9, 10**8, 10**7 + 10_000) < 0.01


def test_edges_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 3)
    rows = [(i, "a" if i < 20 else "b" if i < 25 else f"c{i}") for i in range(30)]
    got = [(r.src, r.dst) for r in relations.edges(spark.createDataFrame(rows, "review_id bigint, k string"), "k").collect()]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a == b}
    assert len(got) == len(want) and set(got) == want


def test_degenerate_columns_and_correlations(spark):
    rnd = random.Random(7)
    rows = [(i, x := rnd.random(), -2.0 * x + 1, 3.0, rnd.random(), None) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, e double")
    assert evaluate.kept_columns(df, ["a", "b", "c", "d", "e"]) == ["a", "d"]
    got = {(r.a, r.b): (r.pearson, r.spearman) for r in evaluate.correlations(df, "id", ["a", "b", "c", "e"]).collect()}
    assert got["a", "b"] == (-1.0, -1.0) and got["a", "c"] == (None, None) and got["a", "e"] == (None, None)


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id bigint, t string")
    assert by(models.text_scores(df, "id", "t", lambda: lambda texts: [len(t) for t in texts]), "id", "score") == {1: 2.0, 2: None, 3: 0.0}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "op/negative_polarity/deceptive_x/fold2").mkdir(parents=True)
    (tmp_path / "op/negative_polarity/deceptive_x/fold2/d_hilt_7.txt").write_text(" Bad stay \n")
    (tmp_path / "op/negative_polarity/deceptive_x/fold2/notes.md").write_text("no")
    r = readers.read_text_archive(spark, str(tmp_path / "op")).collect()
    assert [(x.text.strip(), x.is_fake, x.polarity, x.fold, x.hotel) for x in r] == [("Bad stay", True, "negative", "fold2", "hilt")]
    (tmp_path / "a.csv").write_text('category,rating,label,text_\nBooks,5.0,CG," ""fine"", read "\n')
    assert [(x.text, x.is_fake, x.generator) for x in readers.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()] == [('"fine", read', True, "language_model")]
    assert readers.read_corpora(spark, [str(tmp_path / "none.csv")]).count() == 0
    m = str(tmp_path / "metrics")
    writers.log_metrics(spark, m, "k", {"a": {"b": 1}, "c": 2})
    writers.log_metrics(spark, m, "k", {"a": {"b": 3}})
    assert by(writers.latest_metrics(spark.read.parquet(m)), "path", "value") == {"a.b": "3", "c": "2"}
    new = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "text string, v int")
    assert writers.append_new(new, str(tmp_path / "t"), ["text"]) == 2 and writers.append_new(new, str(tmp_path / "t"), ["text"]) == 0
    made = []
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or new).count() == 3
    assert len(made) == 1


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime
    rows = [("a", t(2024, 1, 1)), ("a", t(2024, 1, 7)), ("a", t(2024, 1, 8)), ("b", t(2024, 1, 3)), (None, t(2024, 1, 3)), ("a", t(2025, 1, 1))]
    df = spark.createDataFrame(rows, "b string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        weekly.run_once(spark, str(tmp_path / "in"), "b string, ts timestamp", "b", "ts", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.b, str(r.week), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.b, str(r.week), r.n) for r in weekly.weekly_counts(df, "b", "ts").collect()}
    assert got == {x for x in want if x[1] < "2024-12"}  # the last week is still open
