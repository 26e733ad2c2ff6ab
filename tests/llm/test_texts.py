import random

import numpy as np
import pytest

from sievework.llm import defects, spans, visual
from sievework.llm.crf import ChainCRF

DOCS = "doc_id bigint, text string, node bigint, at int, h string"


def brute_spans(docs, length):
    out = set()
    for i, t in docs:
        if not t:
            continue
        cover = [False] * len(t)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if any(j != i and u and w in u for j, u in docs):
                cover[s : s + length] = [True] * length
        s = 0
        while s < len(t):
            if cover[s]:
                e = s
                while e < len(t) and cover[e]:
                    e += 1
                out.add((i, s, e - s))
                s = e
            else:
                s += 1
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E30)] + list("ab 😀")
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    a, b = text(700), text(260)
    docs = [
        (1, text(50) + a + text(40)), (2, a[100:400] + text(90)), (3, text(200) + a[250:500] + b), (4, b), (5, b),
        (6, text(149)), (7, None), (8, ""), (9, text(300) + a[:150]), (10, text(20) + a[:149] + text(60)),
        (11, "ab" * 300), (12, "x" + "ab" * 120), (13, b[:100] + "?" + b[101:]), (14, (a[:90] + b[:90]) * 3), (15, a[:90] + b[:90] + text(30)),
    ]
    df = spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in docs], DOCS)
    got = {tuple(r) for r in spans.found(df).collect()}
    assert got == brute_spans(docs, 150) and got
    report = {r["doc_id"]: r for r in spans.report(df).collect()}
    assert len(report) == len(docs) and report[4]["shared_share"] == 1.0 and report[7]["shared_chars"] == 0
    assert spans.found(df.where("false")).count() == 0


def test_rows_of_one_document_are_one_record(spark):
    t = "".join(chr(0x4E00 + (i * 7919) % 3000) for i in range(400))
    twice = spark.createDataFrame([(1, t, 0, 0, ""), (1, t, 0, 0, "")], DOCS)
    assert spans.found(twice).count() == 0


@pytest.mark.parametrize(
    "text,odd,form",
    [
        ("Hello, 世界，“你好”？ Müra é", False, "hello, 世界,“你好”? müra é"),
        ("café", True, "café"),
        ("a​b", True, "ab"),
        ("a b", True, "a b"),
        ("Ａ１", True, "a1"),
        ("А", True, "a"),
        ("Zоé街", True, "zoé街"),
        ("Судя по рассказу, а он", False, "судя по рассказу, а он"),
        ("去ニ层", True, "去二层"),
        ("カメラを動かした", False, "カメラを動かした"),
        ("⼀个", True, "一个"),
        ("⻔卫", True, "门卫"),
        ("Ⅽ", True, "c"),
        ("Straße", False, "strasse"),
        ("……", False, "......"),
        ("", False, ""),
        (None, False, None),
        ("x　y", False, "x y"),
    ],
)
def test_visual_forms(text, odd, form):
    assert visual.disguised(text) is odd
    assert visual.canonical(text) == form
    assert visual.canonical(form) == form
    assert not odd or set(text) - set(visual.QUIET)


def test_no_disguised_character_is_passed_over():
    """Every single character, alone and between letters, that is disguised is outside the quiet ones."""
    quiet = set(visual.QUIET)
    for code in (*range(0x20000, 0x20100), *range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):
        c = chr(code)
        if c in quiet:
            assert not visual.disguised(c) and not visual.disguised(f"a{c}b") and not visual.disguised(f"天{c}地"), hex(code)
    for c in "ŉĲĳĿŀſ\u212a\u212b\u200b\u00ad\u3164\ufe0f\U000e0041Ⅽ𝐀":
        assert c not in quiet
        assert visual.disguised(f"x{c}y"), c
    for c in "²①…，。：　™℃":
        assert not visual.disguised(f"天{c}地"), c


def test_visual_queries(spark):
    m = "_source_line bigint, messages array<struct<role: string, content: string>>, row_id string"
    records = spark.createDataFrame([(1, [("user", "plain"), ("assistant", "​")], "c"), (2, [("user", None)], "c"), (3, None, "c"), (4, [], "c")], m)
    p = "prediction_id bigint, predicted_letters array<string>, value string"
    predictions = spark.createDataFrame([(1, ["A", "Ｂ"], "c"), (2, None, "c"), (3, [], "c"), (4, [None, "A"], "c"), (5, ["A "], "c")], p)
    assert {tuple(r) for r in visual.found(records, predictions).collect()} == {("train_records", 1), ("predictions", 1), ("predictions", 5)}
    forms = {r["row_id"]: r["forms"] for r in visual.letter_forms(predictions).collect()}
    assert forms[1] == ["A", "B"] and forms[2] is None and forms[3] == [] and forms[5] == ["A"]
    assert visual.train_forms(records).count() == 3


QUESTION = "请回答。\n故事：\n甲把旧的雨伞放回门卫室，乙没有看见，于是继续寻找钥匙。\n问题：乙认为雨伞在哪里？\n选项：\nA. 门卫室\nB. 仓库"
ANSWERS = [
    (1, "乙当时不在场，所以看不到。\n\\boxed{A}", None),
    (2, "<think>\n</think>\n\n\\boxed{}", "empty"),
    (3, None, "empty"),
    (4, "乙当时不在场，所以不可能看到甲的举动。先看周三", "truncated"),
    (5, "很抱歉，我无法回答这个问题。请换一个问题吧。", "refusal"),
    (6, "问题：乙认为雨伞在哪里？", "copies_question"),
    (7, "Nach der Erzählung weiß sie nicht, dass der Schirm noch in dem Lager liegt.\n\\boxed{A}", "other_language"),
    (8, "A", None),
    (9, "乙说“抱歉，这件事我不能告诉你”，可见乙在保密。所以答案是B。", None),
    (10, "甲的话是称赞。综上，答案是\n\\boxed{", "truncated"),
    (11, "……", "empty"),
    (12, "乙认为雨伞在哪里？\nA. 门卫室\nB. 仓库", "copies_question"),
    (13, "So 甲 most likely misunderstood what the others said about it.\n\\boxed{A}", "other_language"),
    (14, "抱歉，我不能对这类内容作出判断，希望您能理解。\n\\boxed{}", "refusal"),
]


def test_defects(spark):
    schema = "_source_line bigint, split_name string, source string, messages array<struct<role: string, content: string>>, defect string"
    rows = []
    for copy in range(12):
        for line, a, _ in ANSWERS:
            turn = [("user", "earlier"), ("assistant", "\\boxed{B}"), ("user", QUESTION)]
            rows.append((copy * 100 + line, "train", None, turn + ([("assistant", a)] if a is not None else []), "clash"))
    rows += [(9001, None, None, None, "c"), (9002, None, None, [], "c"), (9003, None, None, [("assistant", "好。\\boxed{A}")], "c"), (9004, None, None, [("user", QUESTION), ("assistant", "长句。" * 5000 + "\\boxed{A}")], "c")]
    df = spark.createDataFrame(rows, schema)
    got = {r[0]: r[1] for r in defects.found(df).collect()}
    for copy in range(12):
        for line, _, want in ANSWERS:
            assert got.get(copy * 100 + line) == want, (line, got.get(copy * 100 + line))
    assert got.get(9001) == got.get(9002) == "empty" and 9003 not in got and 9004 not in got
    assert defects.found(df.where("false")).count() == 0
    assert sum(r["rows"] for r in defects.report(df).collect()) == len(rows)


@pytest.mark.parametrize("answer, final", [
    ("I'm sorry, but I am not able to answer that, and I hope you understand.", False),
    ("He has to choose what I would have taken from the", False),
    ("I can't choose B.", False),
    ("I cannot see another reading, so the answer is B.", True),
    ("The answer is A because nobody saw it.", True),
    ("I pick options A and B.", True),
    ("We choose A here.", True),
    ("所以答案是B。", True),
])
def test_pronoun_and_refusal_are_no_answer(answer, final):
    question = "Story: He put it away.\nOptions:\nA. yes\nB. no"
    assert bool(defects.cues(answer, question)[0][:, 15].any()) is final


def test_the_tags_alone_decide():
    x, size, parts = defects.cues("甲把伞放回了门卫室。乙没有看见这件事。所以答案是B。", QUESTION)
    tags = lambda *t: np.array(t)
    a, r, e, f, u = range(5)
    assert defects.defect(tags(a, a, a), size) is None
    assert defects.defect(tags(a, a, u), size) == "truncated"
    assert defects.defect(tags(a, r, r), size) == "refusal"
    assert defects.defect(tags(f, f, a), size) == "other_language" and defects.defect(tags(a, a, f), size) is None
    assert defects.defect(tags(e, e, e), size) == "copies_question" and defects.defect(tags(e, a, e), size) == "truncated"
    assert defects.defect(tags(e, e, a), size) is None


def _wordings(seed):
    """(answer, defect) of training, and held-out refusals and answers whose wording holds no cue."""
    rng = random.Random(seed)
    who, what = "甲乙丙丁", ["把伞放回了门卫室", "没有看见这件事", "离开后才发生了变化", "以为钥匙还在原处", "隔着门提醒过别人"]
    reason = lambda: "".join(rng.choice(who) + rng.choice(what) + "。" for _ in range(rng.randint(1, 4)))
    decline = ["很抱歉，我无法回答这个问题。", "作为人工智能，我不能对此作出判断。", "对不起，我不会参与这类讨论。"]
    after = ["这类话题不适合由我来谈。", "还望见谅，恕难从命。", "这样的内容我帮不上忙。", "这件事由专业人士来说更合适。"]
    train = [(reason() + f"所以答案是{rng.choice('AB')}。", None) for _ in range(60)] + [(reason() + rng.choice(who) + "以为", "truncated") for _ in range(30)]
    train += [(rng.choice(decline) + "".join(rng.sample(after, 2)), "refusal") for _ in range(40)]
    held = [("".join(rng.sample(after, 2)), "refusal") for _ in range(20)] + [(reason() + "因此应选B。", None) for _ in range(20)] + [(reason() + rng.choice(who) + "后来", "truncated") for _ in range(20)]
    return train, held


def test_held_out_wordings_are_tagged_without_cues():
    train, held = _wordings(5)
    model = defects.train([(a, QUESTION) for a, _ in train])
    items = [defects.cues(a, QUESTION) for a, _ in held]
    assert not any(x[:, 2].any() for x, _, _ in items)  # no refusal cue in any of them
    got = [defects.defect(t, s) for t, (_, s, _) in zip(defects.tagged(model, items), items)]
    for kind in ("refusal", None, "truncated"):
        hits = [g == w for g, (_, w) in zip(got, held) if w == kind]
        assert sum(hits) >= 0.9 * len(hits), kind


def test_long_answers_are_one_chain_and_worded_conclusions_are_answers():
    train, _ = _wordings(6)
    model = defects.train([(a, QUESTION) for a, _ in train])
    long_ = "乙没有看见这件事。" * 3000
    items = [defects.cues(a, QUESTION) for a in (long_ + "所以答案是B。", long_ + "乙以为", "Sorry about the delay, the answer is that Tom feels sad.", "所以答\u200d案\u200b是B。")]
    tags = defects.tagged(model, items)
    assert [len(t) for t in tags] == [len(x) for x, _, _ in items] and len(tags[0]) == 3001
    assert [defects.defect(t, s) for t, (_, s, _) in zip(tags[:2], items[:2])] == [None, "truncated"]
    assert all(x[-1, 15] for x, _, _ in items[2:])


def test_crf_learns_and_generalises():
    """Held-out accuracy on chains whose emissions alone are ambiguous."""
    rng = np.random.default_rng(0)
    move = np.array([[0.9, 0.1, 0.0], [0.0, 0.9, 0.1], [0.1, 0.0, 0.9]])

    def draw(n):
        x, y = np.zeros((n, 12, 4)), np.zeros((n, 12), int)
        for i in range(n):
            s = rng.integers(3)
            for t in range(12):
                s = rng.choice(3, p=move[s]) if t else s
                y[i, t], x[i, t, 0], x[i, t, 1 + (s if rng.random() < 0.6 else rng.integers(3))] = s, 1, 1
        return x, y, np.ones((n, 12), bool)

    model = ChainCRF(4, 3).fit(*draw(300))
    x, y, mask = draw(200)
    alone = (x[:, :, 1:].argmax(-1) == y).mean()
    assert (model.decode(x, mask) == y).mean() > max(0.8, alone + 0.05)
