import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import nearjoin, overlap, regions, textsets
from sievework.llm.records import story_and_question
from sievework.llm.regions import similar_pairs

SCHEMA = "_source_line bigint, split_name string, source string, messages array<struct<role: string, content: string>>, k string, region string"


def record(line, text, split="train", source="a"):
    messages = None if text is None else [("system", "s"), ("user", text), ("assistant", "x")]
    return (line, split, source, messages, "clash", "clash")


def story(rng, n=120):
    return "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳") for _ in range(n))


def edited(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice("甲乙丙丁戊己庚辛")
    return "".join(out)


def jaccard(a, b):
    def pieces(t):
        t = textsets.normalise(t)
        return {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set()

    x, y = pieces(a), pieces(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus():
    rng = random.Random(5)
    rows, line = [], 0
    for _ in range(30):
        base = story(rng)
        for changes in (0, 0, 1, 2, 4, 7, 12):
            line += 1
            text = f"请回答。\n故事：{edited(rng, base, changes)}\n选项：\nA. 是"
            rows.append(record(line, text, rng.choice(["train", "dev", "test"])))
    rows += [record(900, None), record(901, ""), record(902, "故事：\n选项："), record(903, "故事：" + "长" * 20000), record(904, "ab", None)]
    return rows


def test_normalise_matches_the_plain_definition():
    import re
    import unicodedata

    for t in ["Ｈｅｌｌｏ，世界！", "été ½ ①", "a_b-c", "ﬁn…", "​", "⼀二", None, ""]:
        plain = re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t or "").lower())
        assert textsets.normalise(t) == plain


def test_cross_split_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]) for r in overlap.found(df).collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[3] and b[3] and {a[1], b[1]} & {"train"} and {a[1], b[1]} & {"dev", "test"}:
            if jaccard(story_and_question(a[3][1][1]), story_and_question(b[3][1][1])) >= 0.7:
                want.add((a[0], b[0]))
    assert got == want and want
    report = overlap.report(df).collect()
    assert sum(r["overlapping_rows"] for r in report) == len({b if rows_split(rows, b) != "train" else a for a, b in want})


def rows_split(rows, line):
    return next(r[1] for r in rows if r[0] == line)


def test_near_pairs_equal_brute_force_and_group(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]) for r in nearjoin.found(df).collect()}
    want = {
        (a[0], b[0])
        for a, b in itertools.combinations(rows, 2)
        if a[3] and b[3] and jaccard(a[3][1][1], b[3][1][1]) >= 0.6
    }
    assert got == want and want
    groups = {r["source_line"]: r["group_line"] for r in nearjoin.groups(df).collect()}
    assert set(groups) == {r[0] for r in rows}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert groups == {line: find(line) for line in parent}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert overlap.found(df).count() == nearjoin.found(df).count() == nearjoin.groups(df).count() == overlap.report(df).count() == 0


@pytest.mark.parametrize("n", [30, 400])
def test_recursive_region_join_is_exact(n):
    rng = np.random.default_rng(n)
    centres = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(max(2, n // 25))]
    sets = []
    for i in range(n):
        c = centres[i % len(centres)].copy()
        change = rng.integers(0, 40)
        c[:change] = rng.integers(0, 2**63, change, dtype=np.uint64)
        sets.append(np.unique(c))
    x, y, _ = similar_pairs(sets, [np.arange(n)], 0.6)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = {
        (a, b)
        for a, b in itertools.combinations(range(n), 2)
        if (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.6 * (len(sets[a]) + len(sets[b]) - c)
    }
    assert got == want and want


def test_story_text_ends_before_the_last_options_label():
    assert story_and_question("x 故事:a 选项：b 选项:c") == "a 选项：b "
    assert story_and_question("no label") == ""
    assert story_and_question("故​事：甲") == "甲"


def test_regions_are_joined_some_at_a_time(spark, monkeypatch):
    """No more characters at once than the bound unless one region has more, and the same pairs with a tiny bound."""
    assert regions.together([0, 2, 3, 5], [4, 4, 30, 3, 3], 99) == [(0, 3)]
    monkeypatch.setattr(regions, "TOGETHER", 20)
    assert regions.together([0, 2, 3, 5, 6], [4, 4, 30, 3, 3, 9], 20) == [(0, 1), (1, 2), (2, 4)]
    rows = [r for r in corpus() if r[0] < 900]
    texts = [(r[0], 0, r[3][1][1]) for r in rows]
    packed, dictionary = regions.packed_texts(spark.createDataFrame(texts, "id bigint, side int, text string"))
    members = regions.routed(packed, dictionary, nearjoin.BANDS, nearjoin.ROWS, cross=False)
    some = spark.createDataFrame(members.collect(), "region bigint, k bigint")
    tiny = {tuple(r) for r in regions.joined(some, packed, dictionary, 0.6, cross=False).collect()}
    monkeypatch.setattr(regions, "TOGETHER", 10**9)
    whole = {tuple(r) for r in regions.joined(some, packed, dictionary, 0.6, cross=False).collect()}
    assert tiny == whole and whole
