import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import cube, groupsplit, mixing, packing
from sievework.operators.forest import spanning_forest

ROWS = "split_row_id bigint, sample_id string, story_cluster_id string, dimension string, question_type string, gold_letters array<string>, author_id string, source_ref string, u string, w string"


def brute_components(edges):
    parent = {x: x for e in edges for x in e[:2]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_spanning_forest_is_minimal(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, float(rng.randrange(4))) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(90)) if a != b]
    edges += [(200 + i, 201 + i, 1.0) for i in range(40)] + [(300, 300 + i, 2.0) for i in range(1, 40)]  # a chain and a hub
    df = spark.createDataFrame(edges + [(5, 5, 0.0), (None, 1, 0.0)], "u bigint, v bigint, w double")
    component, forest = spanning_forest(df)
    got = {r["vertex"]: r["root"] for r in component.collect()}
    want = brute_components(edges)
    assert got == want
    kept = [(r["u"], r["v"], r["w"]) for r in forest.collect()]
    assert len(kept) == len(want) - len(set(want.values())) and brute_components(kept) == want
    best, parent = 0.0, {x: x for x in want}  # Kruskal

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            best += w
    assert sum(w for *_, w in kept) == best
    empty, none = spanning_forest(df.where("false"))
    assert empty.count() == none.count() == 0


def split_rows(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        author = rng.choice([None, "", "N/A", " au_1 ", "AU_1", f"au_{rng.randrange(300)}", f"au_{rng.randrange(300)}"])
        cluster = rng.choice([None, "unknown", "story_0000", f"story_{rng.randrange(900)}", f"STORY_{rng.randrange(900)} "])
        rows.append((i, f"s{i if i % 7 else max(0, i - 7)}", cluster, rng.choice(["a", " a", "Ｂ", "c", None]), rng.choice(["Q1", "q1 ", "Q2"]), rng.choice([["A"], ["b", "A"], ["A", "B", "B"], [], None]), author, None, "clash", "clash"))
    return rows


def test_related_rows_equal_brute_force_and_share_a_split(spark):
    rows = split_rows()
    df = spark.createDataFrame(rows, ROWS)
    edges, first = [], {}
    for r in rows:
        for field, value in (("s", r[1]), ("c", r[2]), ("a", r[6])):
            v = (value or "").strip().lower()
            if v and v not in ("n/a", "unknown") and v != "story_0000":
                edges.append((first.setdefault((field, v), r[0]), r[0]))
    want = {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    got = {r[0]: r[1] for r in groupsplit.found(df).collect()}
    assert got == want
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille int")
    out = groupsplit.split(df, targets).collect()
    assert len(out) == len(rows)
    per = {}
    for r in out:
        per.setdefault(r["group_row_id"], set()).add(r["split_name"])
    assert all(len(s) == 1 for s in per.values())
    forest = groupsplit.forest_edges(df)
    assert {r["relation"] for r in forest.collect()} <= set(groupsplit.RELATIONS)


def test_split_proportions_and_dimensions(spark):
    rows = [(i, f"s{i}", f"story_{i // 3 if i < 3000 else i}", "abc"[i % 3], "Q1", ["A"], "au_hot" if i >= 5000 else None, None, "", "") for i in range(7000)]
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille int")
    report = {r["split_name"]: r for r in groupsplit.split_report(spark.createDataFrame(rows, ROWS), targets).collect()}
    for r in report.values():
        assert abs(r["permille"] - r["target_permille"]) < 10 and r["dimension_gap"] < 15
    assert groupsplit.kept_together(spark.createDataFrame(rows, ROWS), targets).where("unassigned = 0 AND divided_groups = 0 AND rows = 7000").count() == 1
    empty = groupsplit.split(spark.createDataFrame([], ROWS), targets)
    assert empty.count() == 0 and groupsplit.split_report(spark.createDataFrame([], ROWS), targets).count() == 3
    assert groupsplit.split(spark.createDataFrame(rows[:5], ROWS), targets.where("false")).where("split_name IS NULL").count() == 5


TARGETS = "target_id bigint, field_name string, field_value string, target_permille int, min_rows int"


def test_sample_follows_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        d = rng.choices("abcdx", [60, 25, 10, 4, 1])[0]
        rows.append((i, f"s{i}", None, rng.choice([d, f" {d}", d.upper()]), rng.choice(["Q1", "Ｑ１", "Q2"]), rng.choice([["A"], ["a"], ["B"], ["B", "A"], ["A", "B"]]), None, None, "", ""))
    rows += [(9000 + i, f"s{i}", None, "b", "Q2", ["B"], None, None, "", "") for i in range(50)] + [(9999, None, None, "a", "Q1", ["A"], None, None, "", "")]
    df = spark.createDataFrame(rows, ROWS)
    goal = [("dimension", "a", 250, 1), ("dimension", "b", 250, 1), ("dimension", "c", 250, 1), ("dimension", "x", 50, 5), ("dimension", "gone", 10, 1), ("question_type", "Q1", 500, 1), ("question_type", "Q2", 500, 1), ("gold_letters", "A", 300, 1), ("gold_letters", "B,A", 300, 1), ("gold_letters", "C", 0, 2)]
    targets = spark.createDataFrame([(i, *g) for i, g in enumerate(goal)], TARGETS)
    report = {r["target_id"]: r for r in cube.report(df, targets).collect()}
    assert report[0]["sample_size"] == 300
    for i in (0, 1, 2, 5, 6, 7, 8):
        assert abs(report[i]["residual"]) <= 3, report[i]
    assert report[3]["drawn"] >= 5
    sample = cube.draw_sample(df, targets)
    assert abs(sample.count() - 300) <= 1 and sample.select("sample_id").distinct().count() == sample.count()
    again = cube.draw_sample(df.repartition(7, "dimension"), targets)
    assert {r["sample_id"] for r in again.collect()} == {r["sample_id"] for r in sample.collect()}  # partitions don't decide
    values = {}
    for r in rows:
        if r[1]:
            values.setdefault(("dimension", (r[3] or "").strip().lower()), set()).add(r[1])
    unreachable = {r[0] for r in cube.found(df, targets).collect()}
    assert all(report[t]["missed"] for t in unreachable)
    assert 4 in unreachable and 9 in unreachable and (3 in unreachable) == (len(values["dimension", "x"]) < 15)
    assert cube.found(df.where("false"), targets).count() == len([g for g in goal if g[3] > 0])
    assert cube.draw_sample(df, targets.where("false")).count() == 0


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    x = np.zeros((60, 7))
    x[:, 0] = 1
    x[np.arange(60), 1 + rng.integers(0, 6, 60)] = 1
    p = rng.random(60)
    q = cube._flight(x, p, rng)
    assert np.allclose(x.T @ p, x.T @ q) and ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 7


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            r = min(fits)
            rooms.remove(r)
            rooms.append(r - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_valid_and_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 100])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
    histogram = {s: sizes.count(s) for s in sizes}
    patterns = packing.plan(histogram, capacity)
    packed = {}
    for many, content in patterns:
        assert many > 0 and sum(s * n for s, n in content.items()) <= capacity
        for s, n in content.items():
            packed[s] = packed.get(s, 0) + n * many
    assert packed == histogram
    assert sum(m for m, _ in patterns) <= best_fit(sizes, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(100 + seed)
    sizes = [rng.randint(3, 20) for _ in range(7)]

    def optimum(items):
        if not items:
            return 0
        first, rest, best = items[0], items[1:], len(items)
        for k in range(len(rest) + 1):
            for group in itertools.combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in group) <= 20:
                    best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in group]))
        return best

    left = {s: sizes.count(s) for s in sizes}
    order = sorted(left)
    fixed, items = 0, sorted(sizes, reverse=True)
    for j in sorted(order, reverse=True):
        while left.get(j):
            others = packing._dominating(j, 20 - j, [s for s in order if left[s]], left)
            if others is None:
                break
            for s in (j, *others):
                left[s] -= 1
                items.remove(s)
            fixed += 1
    assert fixed + optimum(sorted(items, reverse=True)) == optimum(sorted(sizes, reverse=True))


DOCS = "doc_id bigint, text string, source string, tokens bigint, k string"


def documents(spark):
    rng = random.Random(9)
    words = "stone river lamp door green seven cloud paper".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), rng.choice(["big_one", "Big-One ", "small", None, "other"]), 0, "clash") for i in range(300)]
    rows += [(900, None, "big_one", 0, ""), (901, "", "small", 0, ""), (902, "lamp " * 900, "small", 0, "")] + [(910 + i, "the same text " * 5, "small", 0, "") for i in range(100)]
    return spark.createDataFrame(rows, DOCS)


def test_packing(spark):
    df = documents(spark)
    limits = spark.createDataFrame([("small", 128), ("large", 512), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    rows = packing.packed(df, limits).collect()
    per, pieces = {}, {}
    for r in rows:
        per[r["container_kind"], r["container"]] = per.get((r["container_kind"], r["container"]), 0) + r["tokens"]
        pieces.setdefault((r["container_kind"], r["doc_id"]), []).append((r["piece"], r["tokens"]))
    capacity = {"small": 128, "large": 512}
    assert all(n <= capacity[k] for (k, _), n in per.items())
    assert len({d for _, d in pieces}) == 401
    for (k, _), p in pieces.items():
        assert sorted(x for x, _ in p) == list(range(len(p)))
        assert len(p) == 1 or all(t == capacity[k] for _, t in sorted(p)[:-1])
    fact = {r["container_kind"]: r for r in packing.facts(df, limits).collect()}
    assert set(fact) == {"small", "large"} and all((r["documents"], r["needlessly_cut"], r["wrongly_cut"], r["overfull_containers"]) == (401, 0, 0, 0) for r in fact.values())
    report = {r["container_kind"]: r for r in packing.report(df, limits).collect()}
    for r in report.values():
        assert r["containers"] <= r["least_containers"] * 1.05 + 1
    assert packing.packed(df.where("false"), limits).count() == packing.packed(df, limits.where("false")).count() == 0


def test_mixing(spark):
    df = documents(spark)
    targets = spark.createDataFrame([("BIG_ONE", 600, 2), ("small", 380, 3), ("nowhere", 20, 5)], "source string, target_permille int, max_repeats int")
    report = {r["source"]: r for r in mixing.report(df, targets).collect()}
    assert report["nowhere"]["tokens"] == 0 and report["nowhere"]["lacking_tokens"] > 0
    for s in ("big_one", "small"):
        assert abs(report[s]["permille"] - report[s]["target_permille"] / 0.98) < 120 and report[s]["most_uses"] <= report[s]["max_repeats"]
    rows = mixing.mixed(df, targets).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    same = [r for r in rows if r["doc_id"] >= 910]
    assert len(same) <= 3 and len({r["doc_id"] for r in same}) <= 1
    assert mixing.mixed(df.where("false"), targets).count() == mixing.mixed(df, targets.where("false")).count() == 0
    assert mixing.report(df.where("false"), targets).where("permille = 0").count() == 3
    assert mixing.caps(df, targets).where("kept").count() == 3


def test_a_scarce_source_changes_no_other(spark):
    """A source of one text is used up to its cap; the others' draws stay as they are."""
    schema = "doc_id bigint, text string, source string"
    many = [(i, f"text number {i} of the large source " * 3, "large") for i in range(4000)]
    targets = spark.createDataFrame([("large", 500, 3), ("scarce", 500, 4)], "source string, target_permille int, max_repeats int")
    with_one = spark.createDataFrame(many + [(9999, "lone text", "scarce")], schema)
    without = spark.createDataFrame(many, schema)
    total = 20_000
    a = {(r["doc_id"], r["repeat_no"]) for r in mixing.mixed(with_one, targets, total).collect()}
    b = {(r["doc_id"], r["repeat_no"]) for r in mixing.mixed(without, targets, total).collect()}
    assert {x for x in a if x[0] != 9999} == b and {x for x in a if x[0] == 9999} == {(9999, n) for n in (1, 2, 3, 4)}
    report = {r["source"]: r for r in mixing.report(with_one, targets, total).collect()}
    assert abs(report["large"]["tokens"] - 10_000) < 1_000 and report["scarce"]["lacking_tokens"] > 9_000


def test_truncated_poisson_has_the_wanted_mean():
    for cap in (1, 3, 10):
        for rate in (0.05, 0.5, 0.9, 2.5):
            if rate < cap:
                cdf = mixing.thresholds(rate, cap)
                u = (np.arange(200_000) + 0.5) / 200_000
                assert abs(sum((c <= u).mean() for c in cdf) - rate) < 1e-3
        assert mixing.thresholds(cap, cap) == [0.0] * cap
