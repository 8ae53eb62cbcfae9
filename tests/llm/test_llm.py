"""Problems 1, 3, 4, 5, 7, 8 and 9: brute force, round trips and edge cases on small tables."""
import base64
import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import bpe, neardup, p1, p3, p4, p5, p7, p8, p9, queries, sketch
from tests.compare import differ

REVIEWS = "id bigint, text string, is_fake boolean, polarity string, fold string, hotel string, source_dataset string, generator string, category string, rating double"
YELP = "review_id bigint, reviewer_id bigint, business_id bigint, date string, text string"
VOCAB = [f"w{i}" for i in range(400)] + ["the", "a", "of", "and"] * 5


def corpus(seed, n):
    """Texts of which many are edits or copies of earlier ones, with empty, null, short and very long ones."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        x = rnd.random()
        if out and x < 0.5:
            w = rnd.choice(out).split()
            for _ in range(rnd.randrange(0, 6)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            if x < 0.1:
                rnd.shuffle(w)
            out.append(" ".join(w).upper() if x < 0.2 else ",  ".join(w))
        else:
            out.append(" ".join(rnd.choices(VOCAB, k=rnd.randrange(6, 60))))
    return out + ["", "   ", "one two three", " ".join(rnd.choices(VOCAB, k=30_000))]


def near(texts, least=0.7):
    """{(i, j)} of nearly equal texts, by brute force."""
    bags = {i: Counter(sketch.words(t)) for i, t in texts.items() if len(sketch.words(t)) >= 8}
    out = set()
    for i in bags:
        for j in bags:
            if i < j:
                c = (bags[i] & bags[j]).total()
                if c / (bags[i].total() + bags[j].total() - c) >= least:
                    out.add((i, j))
    return out


def reviews(texts, fold=lambda i: "fold1", source=lambda i: "s", gen=lambda i: "g"):
    return [(i, t, None, None, fold(i), None, source(i), gen(i), None, None) for i, t in texts.items()]


def test_sketch_estimates():
    rnd = random.Random(2)
    a = [f"word{i}" for i in range(200)]
    for keep in (200, 160, 100, 0):
        b = a[:keep] + [f"other{rnd.random()}" for _ in range(200 - keep)]
        s = sketch.sketches([a, b])
        assert abs(sketch.estimate(s[:1], s[1:])[0] - keep / (400 - keep)) < 0.15
    assert sketch.words(None) == [] and sketch.words("İstanbul A_b c1") == ["i̇stanbul", "a", "b", "c1"]


def test_edits_of_long_words_are_found_as_well_as_others():
    rnd, pairs = random.Random(3), []
    for _ in range(500):  # 10 of 14 words: a similarity of 0.71
        short, long = rnd.sample("the a of and to in is it was for on at we my".split(), 9), [f"word{rnd.randrange(10**6)}" for _ in range(5)]
        pairs.append((short + long[:3], short + [long[0], *long[3:]]))
    a, b = sketch.sketches([x for x, _ in pairs]), sketch.sketches([y for _, y in pairs])
    keys = [sketch.band_keys(x, sketch.picks(neardup.BANDS, neardup.ROWS), np.zeros(500)) for x in (a, b)]
    assert (sketch.estimate(a, b) >= neardup.FLOOR).all() and (keys[0] == keys[1]).any(0).mean() > 0.95


def test_unrelated_texts_that_share_bands_are_not_written(spark):
    rnd = random.Random(21)
    texts = {i: " ".join(rnd.choices([f"v{k}" for k in range(70)], k=30)) for i in range(1500)}
    texts |= {2000 + i: f"{texts[i]} more" for i in range(50)}
    df = spark.createDataFrame([(0, 0, i, t) for i, t in texts.items()], "g int, side int, id bigint, text string")
    sk = neardup.sketched(df)
    want = near(texts)
    cand = neardup.candidates(sk, across=False).count()
    assert len(want) >= 50 and cand <= 2 * len(want) and neardup.verified(sk, neardup.candidates(sk, across=False), df).count() >= 0.95 * len(want)


def test_filter_bits_never_rule_out_a_pair_over_the_threshold():
    rnd = random.Random(22)
    for n in (8, 30, 120, 181, 200, 257, 258, 700, 40_000):
        bags, fp = [], np.arange(60, dtype=np.uint64) * np.uint64(2)
        for _ in range(30):  # as dissimilar as the threshold lets be: shorter by 30 %, or as long and with other words
            a, less, common = [f"x{rnd.randrange(10**9)}" for _ in range(n)], -(-7 * n // 10), -(-14 * n // 17)
            bags += [a, a[:less] if rnd.random() < 0.5 else a[:common] + [f"y{rnd.randrange(10**9)}" for _ in range(n - common)]]
        assert all(sketch.bag_similarity(a, b) >= 0.7 for a, b in zip(bags[::2], bags[1::2]))
        _, g, x = neardup._entries(sketch.sketches(bags), fp, np.zeros(60, np.int64))
        x[:, :4] = g.astype("<u4").view(np.uint8).reshape(-1, 4)  # all of a kind in one run
        got = {(a, b) for r in neardup._run_pairs(x, False) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
        assert {(4 * i, 4 * i + 2) for i in range(30)} <= got


def test_p3_equals_brute_force(spark, folder):
    texts = dict(enumerate(corpus(1, 250)))
    copies = {1000 + i: "The same eight words stand here again and again" for i in range(120)}  # a hot group
    folder.write("reviews", reviews(texts) * 2 + [(5000, None, *[None] * 4, "s", None, None, None)], REVIEWS)
    folder.write("yelp", [(i, 1, 1, "2020-01-01", t) for i, t in (texts | copies).items()], YELP)
    got = defaultdict(set)
    for r in p3.found(spark, folder.at).collect():
        got[r.tab].add((r.id_a, r.id_b))
    want, inside = near(texts), {(i, j) for i, j in got["yelp"] if i >= 1000}
    assert got["reviews"] == got["yelp"] - inside <= want
    assert near(texts, 0.8) <= got["reviews"] and len(got["reviews"]) > 0.97 * len(want)  # bands may lose pairs near the threshold
    # Beyond FULL pairs a group of copies is a star around its least record.
    assert inside == {(1000, i) for i in range(1001, 1120)}
    g = [r for r in p3.groups(spark, folder.at).collect() if r.id >= 1000]
    assert len(g) == 120 and {(r.group_id, r.n_copies) for r in g} == {(1000, 120)}


def test_p1(spark, folder):
    texts = dict(enumerate(corpus(4, 150)))
    long = next(t for t in texts.values() if len(sketch.words(t)) >= 8)
    texts |= {500: long.upper(), 501: f"  {long}!", 502: long.replace(" ", "\n")}
    fold = lambda i: (" Fold1", "fold4 ", "FOLD5", None, "fold9")[i % 5]
    folder.write("reviews", reviews(texts, fold) + reviews({0: texts[0]}, fold), REVIEWS)
    folder.write("fold_roles", [("fold1", "train"), ("fold4", "validation"), ("fold5", "test")], "fold string, split_role string")
    side = {i: {0: "t", 1: "e", 2: "e"}.get(i % 5) for i in texts}
    want = {(i, j) for i, j in near(texts) if {side[i], side[j]} == {"t", "e"}}
    assert {(r.id_a, r.id_b) for r in p1.found(spark, folder.at).collect()} == want and want
    rep = p1.report(spark, folder.at).collect()
    eval_ids = {i for p in want for i in p if side[i] == "e"}
    assert sum(r.n_near for r in rep) == len(eval_ids) and sum(r.n_records for r in rep) == sum(v == "e" for v in side.values())
    canon = {i: " ".join(sketch.words(t)) for i, t in texts.items() if len(sketch.words(t)) >= 8}
    train = {c for i, c in canon.items() if side[i] == "t"}
    same = [i for i, c in canon.items() if side[i] == "e" and c in train]
    assert same and sum(r.n_same for r in rep) == len(same)


def test_p1_finds_equal_records_by_the_hash_alone(spark, folder, monkeypatch):
    folder.write("reviews", reviews({1: "These eight words stand on both sides, yes", 2: "these EIGHT words stand on both sides... yes", 3: "too short"}, lambda i: f"fold{i}"), REVIEWS)
    folder.write("fold_roles", [("fold1", "train"), ("fold2", "test"), ("fold3", "test")], "fold string, split_role string")
    monkeypatch.setattr(neardup, "candidates", lambda sk, across: sk.select(sk.fp.alias("a"), sk.fp.alias("b")).filter("false"))
    assert [(r.id_a, r.id_b) for r in p1.found(spark, folder.at).collect()] == [(1, 2)]
    assert sorted((r.n_records, r.n_same, r.n_near, r.n_links) for r in p1.report(spark, folder.at).collect()) == [(2, 1, 1, 1)]


def at_threshold(n):
    """{id: text} of n pairs (i, 10,000 + i), each of 17 words with 14 in common: 14 of 20, a similarity of 0.7."""
    rnd, out = random.Random(23), {}
    for i in range(n):
        w = [f"q{rnd.randrange(10**7)}" for _ in range(20)]
        out |= {i: " ".join(w[:17]), 10_000 + i: " ".join(w[:14] + w[17:])}
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_p1_finds_every_pair_at_the_threshold(spark, folder, monkeypatch, whole):
    monkeypatch.setattr(neardup, "ALL", neardup.ALL if whole else 0)  # compared whole, or by bands
    folder.write("reviews", reviews(at_threshold(400), lambda i: "fold1" if i < 10_000 else "fold2"), REVIEWS)
    folder.write("fold_roles", [("fold1", "train"), ("fold2", "test")], "fold string, split_role string")
    assert {(r.id_a, r.id_b) for r in p1.found(spark, folder.at).collect()} == {(i, 10_000 + i) for i in range(400)}


@pytest.mark.parametrize("whole", [True, False])
def test_p3_finds_every_pair_at_the_threshold(spark, folder, monkeypatch, whole):
    monkeypatch.setattr(neardup, "ALL", neardup.ALL if whole else 0)
    texts = at_threshold(400)
    folder.write("reviews", reviews(texts), REVIEWS)
    folder.write("yelp", [(i, 1, 1, "2020-01-01", t) for i, t in texts.items()], YELP)
    want = {(i, 10_000 + i) for i in range(400)}
    got = p3.found(spark, folder.at).collect()
    assert len(got) == 800 and all({(r.id_a, r.id_b) for r in got if r.tab == t} == want for t in p3.TABS)
    g = p3.groups(spark, folder.at).collect()
    assert len(g) == 1600 and all(r.group_id == r.id % 10_000 and r.n_links == 1 for r in g)


@pytest.mark.parametrize("rows", sorted(neardup.LAYOUTS))
def test_no_layout_loses_pairs_at_the_threshold(rows):
    texts, pick = at_threshold(1000), sketch.picks(neardup.LAYOUTS[rows], rows)
    a, b = (sketch.sketches([texts[i + at].split() for i in range(1000)]) for at in (0, 10_000))
    x, y = (sketch.band_keys(v, pick, np.zeros(1000, np.int64)) for v in (a, b))
    assert (x == y).any(0).all() and (sketch.estimate(a, b) >= neardup.FLOOR).all()


def test_p1_finds_texts_of_ids_that_have_another_text_too(spark, folder):
    one, other = "these eight words stand here on both sides", "zz is the first of nine words of another text"
    rows = [(1, one), (1, other), (2, f"{one} too"), (3, f"{other} too")]
    folder.write("reviews", [(i, t, None, None, "fold1" if i == 1 else "fold2", None, "s", None, None, None) for i, t in rows], REVIEWS)
    folder.write("fold_roles", [("fold1", "train"), ("fold2", "test")], "fold string, split_role string")
    assert {(r.id_a, r.id_b) for r in p1.found(spark, folder.at).collect()} == {(1, 2), (1, 3)}


def test_every_pair_of_copies_follows_from_links_and_classes(spark, folder):
    same = ["the same eight words stand here again and again", "The same, eight words stand here AGAIN and again!"]
    texts = {i: same[i % 2] for i in range(240)}
    folder.write("reviews", reviews(texts, lambda i: f"fold{1 + i // 120}"), REVIEWS)
    folder.write("yelp", [], YELP)
    folder.write("fold_roles", [("fold1", "train"), ("fold2", "test")], "fold string, split_role string")

    def rebuilt(links, rows):
        of = {r.id: r.class_id for r in rows}
        members = defaultdict(list)
        for i, c in of.items():
            members[c].append(i)
        return {(min(x, y), max(x, y)) for a, b in {(of[r.id_a], of[r.id_b]) for r in links} for x in members[a] for y in members[b] if x != y}

    got = p1.found(spark, folder.at).collect()
    assert len(got) < 14400 and rebuilt(got, p1.members(spark, folder.at).collect()) == {(i, j) for i in range(120) for j in range(120, 240)}
    got = p3.found(spark, folder.at).collect()
    assert len(got) == 239 and rebuilt(got, p3.groups(spark, folder.at).collect()) == {(i, j) for i in range(240) for j in range(i + 1, 240)}


@pytest.mark.parametrize("block", [neardup.BLOCK, 40])
def test_p3_query_gives_every_pair_of_copies(spark, folder, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    a, b = "the same eight words stand here again and again", "The same, eight words stand here AGAIN and again, more"
    rows = [(i, a) for i in range(130)] + [(200 + i, b) for i in range(110)]  # 16,900, 14,300 and 12,100 ordered pairs
    rows += [(400, "the same nine words stand here again and again"), (500, "zz is the first of eight other words")]
    rows += [(5, b), (129, b), (209, a), (7, "ZZ is the first of eight other words")]  # records with two texts
    folder.write("reviews", [], REVIEWS)
    folder.write("yelp", [(i, 1, 1, "2020-01-01", t) for i, t in rows * 2], YELP)
    got = [(r.tab, r.id_a, r.id_b) for r in queries.QUERIES["p3_found"](spark, folder.at).collect()]
    want = near({k: t for k, (_, t) in enumerate(rows)})
    want = {("yelp", *sorted((rows[i][0], rows[j][0]))) for i, j in want if rows[i][0] != rows[j][0]}
    assert len(want) == 241 * 240 // 2 + 1 and len(got) == len(set(got)) and set(got) == want


def test_p3_groups_join_through_a_record_with_two_texts(spark, folder):
    one, other = "these eight words stand here on both sides", "zz is the first of nine words of another text"
    folder.write("reviews", [], REVIEWS)
    folder.write("yelp", [(i, 1, 1, "2020-01-01", t) for i, t in [(2, one), (2, other), (1, f"{one} too"), (3, f"{other} too"), (4, "alone " * 9)]], YELP)
    g = p3.groups(spark, folder.at).collect()
    assert sorted((r.id, r.group_id, r.n_links) for r in g) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, name):
    assert differ(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.parametrize("rows", [[], [(1, None, *[None] * 4, "s", None, None, None)]])
def test_empty_tables(spark, folder, rows):
    folder.write("reviews", rows, REVIEWS)
    folder.write("yelp", [(1, None, None, None, None)] if rows else [], YELP)
    folder.write("fold_roles", [("fold1", "train")], "fold string, split_role string")
    folder.write("split_plan", [("train", 0.8), ("test", 0.2)], "split_role string, share double")
    folder.write("documents", [], "doc_id bigint, text string")
    folder.write("graph_speagle", [], "review_id bigint, " + ", ".join(f"{c} double" for c in p5.SCORES))
    for q in (p1.found, p1.report, p3.found, p3.groups, p4.found, p5.found, p5.ranking, p7.ids, p8.found, p8.containers, p9.found, p9.redacted):
        assert q(spark, folder.at).count() == 0
    assert p4.split(spark, folder.at).count() == p4.generator_split(spark, folder.at).count() == len(rows)


def test_p4(spark, folder):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, None, *range(1, 200)]), rnd.choice([None, *range(1, 150)]), None, None) for i in range(160)]
    folder.write("yelp", rows + rows[:5], YELP)
    folder.write("split_plan", [("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_role string, share double")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, u, b, *_ in rows:
        if b is not None:
            x, y = find((0, b)), find((1, u)) if u else find((0, b))
            root[max(x, y)] = min(x, y)
    want = {(find((0, b))[1], b) for _, _, b, *_ in rows if b is not None and find((0, b)) != (0, b)}
    assert {(r.business_a, r.business_b) for r in p4.found(spark, folder.at).collect()} == want
    role = {r.review_id: r.split_role for r in p4.split(spark, folder.at).collect()}
    assert len(role) == 160
    for key in (1, 2):
        seen = defaultdict(set)
        for r in rows:
            if r[key]:
                seen[r[key]].add(role[r[0]])
        assert all(len(v) == 1 for v in seen.values())


@pytest.mark.parametrize("query, tab, key", [(p4.split, "yelp", "review_id"), (p4.generator_split, "reviews", "id")])
def test_p4_shares_of_the_tables(spark, query, tab, key):
    d, n = "/root/testdata/sf0.01", Counter()
    role = {r[key]: r.split_role for r in query(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/{tab}.parquet").select(key).collect():
        n[role[r[key]]] += 1
    want = {r.split_role: r.share for r in spark.read.parquet(f"{d}/split_plan.parquet").collect()}
    print(n, want)
    assert all(abs(n[k] / n.total() - v) < 0.02 for k, v in want.items())


def test_found_come_through_the_operators(spark, folder, monkeypatch):
    folder.write("yelp", [(1, 1, 1, None, None), (2, 1, 2, None, None), (3, 2, 3, None, None)], YELP)
    folder.write("split_plan", [("train", 0.8), ("test", 0.2)], "split_role string, share double")
    ran, differencing = [], p4.differencing
    monkeypatch.setattr(p4, "differencing", lambda *a: ran.append(1) or differencing(*a))
    assert [(r.business_a, r.business_b) for r in p4.found(spark, folder.at).collect()] == [(1, 2)] and ran
    folder.write("graph_speagle", [(i, *[float(i)] * 4) for i in range(100)], "review_id bigint, " + ", ".join(f"{c} double" for c in p5.SCORES))
    order = [r.review_id for r in p5.ranking(spark, folder.at).orderBy("place").collect()]
    assert {r.review_id for r in p5.found(spark, folder.at).collect()} == set(order[:5])


def test_p4_records_without_generator_are_units_of_their_own(spark, folder):
    folder.write("reviews", reviews({i: "x" for i in range(100)}, gen=lambda i: (" A", "a ", None)[i % 3]), REVIEWS)
    folder.write("split_plan", [("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_role string, share double")
    role = {r.id: r.split_role for r in p4.generator_split(spark, folder.at).collect()}
    assert len(role) == 100 and len({role[i] for i in role if i % 3 < 2}) == 1
    n = Counter(role.values())  # 67 rows of one generator, 33 rows that fill up
    assert abs(n["train"] - 80) <= 2 and abs(n["validation"] - 10) <= 2 and abs(n["test"] - 10) <= 2


def test_differencing_uses_every_unit_and_balances():
    rnd = random.Random(8)
    sizes = Counter(rnd.randrange(1, 50) for _ in range(2000))
    bins = p4.differencing(sizes, 10)
    assert sum((Counter(b) for b in bins), Counter()) == sizes
    w = [sum(s * n for s, n in b.items()) for b in bins]
    assert max(w) - min(w) <= 2
    assert p4.differencing({}, 3) == [{}, {}, {}]
    split = Counter()
    for b, k in zip(w, p4.allot(bins, {"train": 0.8, "test": 0.2})):
        split[k] += b
    assert abs(split["train"] / sum(w) - 0.8) < 0.01


def test_p5(spark, folder):
    rnd, nan = random.Random(9), float("nan")
    rows = [(i, *[rnd.choice([None, nan, 0.0, 1.0, rnd.gauss(0, 1), 1e9 * rnd.random()]) if rnd.random() < 0.5 else rnd.gauss(i / 50, 1) for _ in p5.SCORES]) for i in range(400)]
    folder.write("graph_speagle", rows + rows[:20], "review_id bigint, " + ", ".join(f"{c} double" for c in p5.SCORES))
    ok = lambda x: x is not None and x == x
    known = [[r[1 + k] for r in rows if ok(r[1 + k])] for k in range(4)]
    want, vec = set(), {}
    for r in rows:
        larger = [sum(v > r[1 + k] for v in known[k]) if ok(r[1 + k]) else None for k in range(4)]
        vec[r[0]] = sorted(0.5 if n is None else 1 - n / len(known[k]) for k, n in enumerate(larger))
        if all(n is not None and n < 0.05 * len(known[k]) for k, n in enumerate(larger)):
            want.add(r[0])
    assert {r.review_id for r in p5.found(spark, folder.at).collect()} == want
    order = sorted(vec, key=lambda i: ([-x for x in vec[i]], i))
    assert [r.review_id for r in p5.ranking(spark, folder.at).orderBy("place").collect()] == order


TEXTS = ["Hello world, hello!", "", None, "   \n\t ", "naïve café — 日本語 🎉👩‍👩‍👧", "1234567890123456789" * 20, "a" * 5000, "don't we'll I'D", "‮abc\u0000\u0007", "x\r\ny   z  ", " ".join(VOCAB) * 5]


def test_p7_equals_the_library(spark, folder):
    import tiktoken

    folder.write("documents", list(enumerate(TEXTS)), "doc_id bigint, text string")
    path = f"{bpe.vocabulary_folder()}/{bpe.FILE}"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in p7.ids(spark, folder.at).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    rnd, own = random.Random(11), bpe.encoder(path)
    noise = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FFF)])) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    assert own.encode_texts(noise) == [enc.encode_ordinary(t) for t in noise]


def test_p8(spark):
    rnd = random.Random(12)
    sizes = [(i, rnd.choice([0, 1, 7, 12, 12, rnd.randrange(1, 60), rnd.randrange(1, 60), rnd.randrange(60, 300)])) for i in range(600)]
    got = p8.packed(spark.createDataFrame(sizes, "doc_id bigint, size int"), "doc_id", 64).collect()
    whole, fill = defaultdict(int), defaultdict(int)
    for r in got:
        whole[r.doc_id] += r.length
        fill[r.container] += r.length
    assert whole == dict(sizes) and max(fill.values()) <= 64 and len(got) == len({(r.doc_id, r.piece) for r in got})
    assert len(fill) - sum(fill.values()) / 64 < 2  # hardly more than the least number of containers
    assert all(n <= 64 or {r.length for r in got if r.doc_id == i and r.piece < (n - 1) // 64} <= {64} for i, n in sizes)
    assert Counter({r.doc_id for r in got if r.piece}) == Counter({i for i, n in sizes if n > 64})
    assert p8.combination({5: 1, 4: 2, 3: 1}, 8) == {5: 1, 3: 1}


def test_p8_found_is_read_off_the_containers(spark, folder, monkeypatch):
    folder.write("documents", [(1, "soup"), (2, "soup " * 3000), (3, "")], "doc_id bigint, text string")
    ran, plan = [], p8.plan
    monkeypatch.setattr(p8, "plan", lambda *a: ran.append(1) or plan(*a))
    assert [r.doc_id for r in p8.found(spark, folder.at).collect()] == [2] and ran


def test_p9(spark, folder):
    people = ["Ann Loretti", "Bob Marchetti", "Cid Fonseca", "Dan Loretti"]
    rows = []
    for i in range(80):
        n, ssn = people[i % 4], f"{900 + i}-12-{3000 + i}"
        rows += [
            f"guest={n}; nice food", f"Ask for {n}, nobody else", f"My SSN: {ssn} is on file", f"My passport: X{10000000 + i} is on file", f"Write to me at u{i}@x.example. Fine.",
            f"Write to me at u{i} (at) x (dot) example. Fine.", f"Call +1 202 555 {1000 + i} before you go", f"Call 202-555-{1000 + i} before you go", f"We live at {i + 1} Oak Street, Apt {i}B and wait", f"We live at {i + 1} Elm Gasse and wait",
            f"Order no. {ssn} was late", f"Between Oldtown and Newtown {i} times",
        ]
    docs = list(enumerate([*rows, None, "", "  ", "é" * 30_000]))
    folder.write("documents", docs, "doc_id bigint, text string")
    got = defaultdict(set)
    for r in p9.found(spark, folder.at).collect():
        assert r.mention in docs[r.doc_id][1]
        got[r.doc_id].add((r.kind, r.mention))
    i = 12 * 5
    assert got[i] == {("NAME", "Bob Marchetti")} and got[i + 1] == {("NAME", "Bob Marchetti")}
    assert got[i + 2] == {("ID", "905-12-3005")} and got[i + 3] == {("ID", "X10000005")}  # found through the context it shares
    assert got[i + 4] == {("EMAIL", "u5@x.example")} and got[i + 5] == {("EMAIL", "u5 (at) x (dot) example")}
    assert got[i + 6] == {("PHONE", "+1 202 555 1005")} and got[i + 7] == {("PHONE", "202-555-1005")}
    assert got[i + 8] == {("ADDRESS", "6 Oak Street, Apt 5B")} and got[i + 9] == {("ADDRESS", "6 Elm Gasse")}
    assert not got[i + 10] and not got[i + 11]
    red = {r.doc_id: r for r in p9.redacted(spark, folder.at).collect()}
    assert red[i + 8].redacted == "We live at [ADDRESS] and wait" and red[len(rows)].redacted is None and red[len(rows) + 1].redacted == "" and len(red) == len(docs)
