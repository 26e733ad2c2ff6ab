"""Problem 2: broken prompt and response pairs.

The answer to the last user message is cut into clauses, each clause is tagged as answer, refusal,
echo, foreign or unfinished by a conditional random field, and the tags alone decide on the pair's defect: the characters that
each tag covers, and the tag in which the answer closes (``defect``).

The field is trained here, on at most ``TRAINING`` records (those with the smallest hashes of their line, their last
``TRAINING_CLAUSES`` clauses) whose clauses are labelled by the cues below.  It sees the cues, the clause's hashed character
n-grams and the neighbouring tags.  In half of the training records the wording cue of refusals is hidden, so that the
n-grams and the neighbours have to carry the tag; a refusal in other words, or a clause without a cue of its own ("please ask
another question"), is tagged by them.  All records are tagged with it, each in one pass from its first clause to its last.

Defined results: a record without an assistant message after its last user message (or without messages) is ``empty``; without
a user message its last assistant message is judged without a question, and is neither an echo nor foreign.  Null contents
are empty.  Very long answers are read to their end.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.crf import ChainCRF
from sievework.llm.records import IGNORABLE
from sievework.llm.textsets import code_points

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TRAINING = 1500
TRAINING_CLAUSES = 48
FEATURES, GRAMS = 18, 4096
#: Cells (answers by clauses) that are decoded at once.
CELLS = 100_000

_TAGS = re.compile(r"</?think>", re.I)
_EMPTY_BOX = re.compile(r"\\+boxed\s*\{\s*\}")
_OPEN_BOX = re.compile(r"\\+(?:b|bo|box|boxe|boxed)?\s*\{?\s*$")
_BOX = re.compile(r"\\+boxed\s*\{[^{}\n]*?[A-Za-zＡ-Ｚ0-9一-鿿Ͱ-ӿᎠ-Ᏼ][^{}\n]*\}?")
_CLAUSE = re.compile(r"[^。！？!?；;\n.]*(?:\.(?!\s|$)[^。！？!?；;\n.]*)*(?:[。！？!?；;]+[”’」』\"']*|\.+[”\"']*(?=\s|$)|\n|$)")
_ENDED = re.compile(r"[。！？!?.…}>][”’」』\"')）\s]*$")
_WORD_CHARS = re.compile(r"[^\W_]")
_QUOTED = re.compile(r"“[^”]*(?:”|$)|「[^」]*(?:」|$)|\"[^\"\n]*(?:\"|$)")
_LETTERS = r"[A-ZＡ-ＺΑ-ΩА-ЯᎠ-Ᏼ]"
# A lone I or A is mostly the pronoun or the article: it counts with a stop, another letter or a reason after it, A also right after the cue.
_AFTER = rf"(?=\s*(?:[.,;:!?)\]}}*\"”]|$)|\s+(?:and|or)\s+{_LETTERS}(?![A-Za-z'’])|\s+(?:because|since|as|is)\b)"
_ANSWERS = re.compile(rf"(?:答案|选项|应选|因此选|选择|故选|所以选|应该选|选)(?:应该|应当|应)?(?:是|为|：|:|\s)*{_LETTERS}(?![a-z])")
_ENGLISH_ANSWERS = re.compile(
    rf"\b(?:[Aa]nswers?|[Oo]ptions?|[Cc]hoices?|[Cc]hoose|[Ss]elect|[Pp]ick)\b"
    rf"(?=\s+A(?![A-Za-z'’])|[^.!?\n]{{0,24}}?(?<![A-Za-z])(?:(?![AI]){_LETTERS}(?![A-Za-z])|A{_AFTER})|[^.!?\n]{{0,24}}?(?<![A-Za-z])(?P<i>I){_AFTER})"
)
_TURN = re.compile(r"\b(?:but|so|therefore|hence|thus)\b|但|所以|因此|综上")
#: A conclusion in words: it says what the answer is without a letter.
_WORDED = re.compile(r"(?:答案|结论)(?:应该|应当|应)?(?:是|为)[：:\s]*[^\W\d_]{2,}|\b[Aa]nswer\s+is\s+(?:that\s+)?[a-zA-Z]+\s+\w+")
_BARE = re.compile(rf"^\W*{_LETTERS}(?:\W*(?:和|与|及|and)?\W*{_LETTERS})*\W*$")
_MARK = re.compile(r"^\W*[A-Z]\s*[.．)）、:：]\W*$")
_OPTION = re.compile(r"^\W*[A-Z]\s*[.．)）、:：]\s*\w")
_OPTION_LETTER = re.compile(r"^\s*([A-Z])\s*[.．、)）:：]", re.M)
_FINAL_WORD = re.compile(r"^\W*(?:是|否|无法确定|信息不足|证据不足|无法判断|yes|no|cannot be determined)\W*$", re.I)
# Wordings by which an answer is declined.
_DECLINES = re.compile(
    r"(?:无法|不能|不便|没有办法|没办法|难以|恕我不|恕不|我拒绝|我不会)(?:再)?(?:为您|为你|对|协助|帮助|回答|提供|完成|给出|作出|做出|发表|讨论|处理|判断|评论|参与)"
    r"|超出了?我|(?:作为|身为)一?[个名]?(?:人工智能|语言模型|AI|助手)|(?:抱歉|对不起|不好意思|遗憾)[，,。 ]|请(?:换|咨询|谅解|理解)|希望您?能?理解|欢迎继续提问|其他需要"
    r"|\b(?:I(?:'m| am) (?:sorry|unable|not able)|I (?:can(?:'|’)?t|cannot|can not|won(?:'|’)?t|will not|must decline|have to decline|am unable|do not feel)|as an? (?:AI|language model)|(?:beyond|outside) what I|unable to (?:help|answer|assist)|not able to (?:help|answer)|sorry, but|feel free to ask|please (?:ask|consult|try) (?:another|a|something)|decline to)",
    re.I,
)
# Frequent function words of languages written in Latin letters.
_WORDS = {
    "en": "the a an of to and in is was that it not for on with as he she they who what would could did does so therefore because from by at but be has had which when where about".split(),
    "de": "der die das und nicht ist war dass zu ein eine einen mit von auf den dem im noch immer hat daher weiß sie er wird wurde nach wo was als auch es sich".split(),
    "fr": "le la les de des du et est pas que qui dans un une il elle ne pour sur au aux ce cette encore donc était a été selon où".split(),
    "es": "el la los las de y es no que en un una por con para su al del todavía quiere según estaba sabe más lo se cree está".split(),
    "it": "il lo la gli le di e è non che un una per con del della nel ancora quindi era sono".split(),
    "pt": "o a os as de e é não que um uma por com para do da no na ainda portanto estava".split(),
}
_ENGLISH = set(_WORDS["en"])
_OTHERS = set().union(*(w for k, w in _WORDS.items() if k != "en")) - _ENGLISH - {"a", "no"}
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ'’]+")
_HAN, _KANA, _HANGUL, _CYRILLIC = (
    re.compile(f"[{chr(a)}-{chr(b)}]") for a, b in ((0x4E00, 0x9FFF), (0x3041, 0x30FF), (0xAC00, 0xD7A3), (0x400, 0x4FF))
)
_HAN_RUN = re.compile(f"[{chr(0x4E00)}-{chr(0x9FFF)}]+")
_PLAIN = re.compile(r"[\W_]+")
_LABEL = re.compile(r"(?:问题|题目|Question|故事|Story|选项|Options)[：:]?\s*")
_FOREIGN_SCRIPT = re.compile(f"[{chr(0x3041)}-{chr(0x30FF)}{chr(0xAC00)}-{chr(0xD7A3)}{chr(0x400)}-{chr(0x4FF)}]")


def _language(text: str) -> str:
    """'zh' or 'en' for the question; other scripts by their name."""
    if text and len(_HAN.findall(text)) > 0.4 * len(text) and not _FOREIGN_SCRIPT.search(text):
        return "zh"
    kana, hangul, cyrillic, han = (len(p.findall(text)) for p in (_KANA, _HANGUL, _CYRILLIC, _HAN))
    latin = sum(map(len, _LATIN_WORD.findall(text))) / 3
    best = max((kana * 2, "ja"), (hangul, "ko"), (cyrillic / 2, "ru"), (han, "zh"), (latin, "en"))
    return best[1] if best[0] else ""


def _strange(answer: str, language: str, names: set[str]) -> bool:
    """Whether any clause can be foreign: a quick look at the whole answer."""
    if language not in ("zh", "en") or _FOREIGN_SCRIPT.search(answer) or (language == "en" and _HAN.search(answer)):
        return True
    words = [w for w in _LATIN_WORD.findall(answer) if len(w) > 1 and w not in names]
    if language == "zh":
        return sum(w.lower() not in ("boxed", "think", "text") for w in words) > 1
    return sum(w.lower() in _OTHERS or not w.isascii() for w in words) > 1


def _foreign(clause: str, language: str, names: set[str]) -> float:
    """Share of a clause's letters, names aside, that are not of the question's language."""
    if not language:
        return 0.0
    words = [w for w in _LATIN_WORD.findall(clause) if len(w) > 1 and w not in names and w.lower() not in ("boxed", "think", "text")]
    kana, hangul, cyrillic = (len(p.findall(clause)) for p in (_KANA, _HANGUL, _CYRILLIC))
    cyrillic = cyrillic if cyrillic > 2 else 0
    han = sum(len(run) for run in _HAN_RUN.findall(clause) if run not in names)
    if kana > 0.15 * han and kana > 1:
        kana, han = kana + han, 0
    latin = sum(map(len, words))
    if language == "en":
        low = [w.lower() for w in words]
        other = sum(w in _OTHERS for w in low)
        marks = sum(not w.isascii() for w in words)
        if other + marks > sum(w in _ENGLISH for w in low) and other + marks > 1:
            return 1.0
        total = latin + (kana + hangul + cyrillic + han) * 3
        return (kana + hangul + cyrillic + han) * 3 / total if total else 0.0
    if language == "zh":
        total = han + kana + hangul + cyrillic / 2 + latin / 3
        return (kana + hangul + cyrillic / 2 + latin / 3) / total if total else 0.0
    own = {"ja": kana, "ko": hangul, "ru": cyrillic / 2}.get(language, 0)
    total = han + (kana if language != "ja" else 0) + hangul + cyrillic / 2 + latin / 3 + (kana if language == "ja" else 0)
    return 1 - own / total if total else 0.0


def clauses(answer: str) -> list[str]:
    """An answer's clauses with at least one letter, digit or box; think tags are dropped."""
    out: list[str] = []
    for c in _CLAUSE.findall(_OPEN_BOX.sub("", _EMPTY_BOX.sub("", _TAGS.sub("\n", answer)).rstrip())):
        if not _WORD_CHARS.search(c):
            continue
        if out and _MARK.match(out[-1]):  # an option's letter belongs to its text
            out[-1] += " " + c.strip()
        else:
            out.append(c.strip())
    return out


def _answers(clause: str, letters: set[str]) -> bool:
    """Whether wording outside quotes names a final letter; the parts of the clause that decline don't.

    ``letters`` are the question's option letters: I is a letter only if it is one of them.
    """
    parts = _TURN.split(clause) if _DECLINES.search(clause) else [clause]
    for part in parts:
        if _DECLINES.search(part):
            continue
        if _ANSWERS.search(part) or any(not m["i"] or "I" in letters for m in _ENGLISH_ANSWERS.finditer(part)):
            return True
    return False


def cues(answer: str, question: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features (clauses by cues), the letters of each clause outside boxes, and the clauses.

    The letters of a clause are what it covers: the writing in a box belongs to no language and covers nothing.
    """
    answer = IGNORABLE.sub("", answer)  # what shows nothing hides no wording
    parts = clauses(answer)
    user = IGNORABLE.sub("", question or "")
    plain_user = _PLAIN.sub("", user)
    language = _language(user)
    letters = set(_OPTION_LETTER.findall(user))
    names = set(_LATIN_WORD.findall(user)) - _ENGLISH
    if language == "en":
        names = {n for n in names if n[:1].isupper()}
    elif language == "zh" and _LATIN_WORD.search(answer):  # Chinese names inside other writing
        names |= {run for run in _HAN_RUN.findall(answer) if len(run) < 5 and run in user}
    x = np.zeros((len(parts), FEATURES))
    size = np.zeros(len(parts))
    final = False
    last = len(parts) - 1
    open_box = _OPEN_BOX.search(answer.rstrip()) is not None
    strange = _strange(answer, language, names)
    for i, c in enumerate(parts):
        plain = _PLAIN.sub("", c)
        boxed = _BOX.search(c) is not None
        size[i] = len(_PLAIN.sub("", _BOX.sub("", c))) if boxed else len(plain)
        bare = _QUOTED.sub("", c)
        ended = bool(_ENDED.search(c))
        answers = boxed or _answers(bare, letters) or bool(_BARE.match(c)) or (i == last and bool(_FINAL_WORD.match(c)))
        answers = answers or (ended and _WORDED.search(bare) is not None)
        if len(plain) >= 24:
            pieces = [plain[k : k + 8] for k in range(0, len(plain) - 7, 8)]
            echo = sum(p in plain_user for p in pieces) / len(pieces)
        else:
            echo = float((len(plain) > 3 or _OPTION.match(c) is not None) and plain in plain_user)
        if echo < 1 and (label := _LABEL.match(c)) and len(c) > label.end() + 3 and _PLAIN.sub("", c[label.end() :]) in plain_user:
            echo = 1.0
        foreign = _foreign(c, language, names) if strange else 0.0
        declines = bool(_DECLINES.search(bare))
        answers = answers and echo <= 0.9  # an option repeated from the question is no answer
        final = final or answers
        x[i, :16] = (
            1.0, answers, declines, echo, echo > 0.9, foreign, foreign > 0.6, ended, i == last, i == last and not ended,
            i == last and not final, i == last and open_box and not final, i == 0, len(plain) < 4, min(len(plain), 60) / 60, final,
        )
    total = max(size.sum(), 1)
    x[:, 16] = size[x[:, 6] > 0].sum() > 0.5 * total
    x[:, 17] = size[x[:, 4] > 0].sum() >= 0.7 * total
    return x, size, parts


def gram_columns(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs and fours of characters of each clause: where its run begins, and the columns of all runs."""
    codes, starts = code_points([p.lower() for p in parts])
    wide = codes.astype(np.uint64)
    lengths = np.diff(starts)
    runs, counts = [], np.zeros(len(parts), np.int64)
    for n, salt in ((2, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F)):
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(salt | 1) + wide[k : k + len(h)]
        h = (h * np.uint64(salt) >> np.uint64(64 - GRAMS.bit_length() + 1)).astype(np.int32)
        own = np.maximum(lengths - (n - 1), 0)
        first = np.cumsum(own) - own
        at = np.arange(own.sum()) - np.repeat(first, own) + np.repeat(starts[:-1], own)
        runs.append((np.repeat(np.arange(len(parts)), own), h[at]))
        counts += own
    begin = np.r_[0, np.cumsum(counts)]
    if not runs:
        return begin, np.zeros(0, np.int32)
    clause = np.concatenate([r[0] for r in runs])
    return begin, np.concatenate([r[1] for r in runs])[np.argsort(clause, kind="stable")]


def seed_labels(x: np.ndarray) -> np.ndarray:
    """Labels of training clauses by their cues.

    What follows a final answer belongs to it unless it is foreign; what follows a refusal without an answer belongs to the
    refusal; a last clause without a final answer before it is unfinished, also a foreign one in an answer that is not.
    """
    answers, declines, echo, foreign, last, final = x[:, 1] > 0, x[:, 2] > 0, x[:, 4] > 0, x[:, 6] > 0, x[:, 8] > 0, x[:, 15] > 0
    y = np.full(len(x), ANSWER)
    y[foreign] = FOREIGN
    y[last & ~final & ~(foreign & (x[:, 16] > 0))] = UNFINISHED
    y[echo & ~answers & ~final] = ECHO
    if not final.any():
        y[declines & ~foreign] = REFUSAL
        refused = np.flatnonzero(y == REFUSAL)
        if len(refused):
            y[refused[0] :] = REFUSAL
    return y


def _padded(items: list[np.ndarray], steps: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(items), steps, width)), np.zeros((len(items), steps), bool)
    for i, a in enumerate(items):
        x[i, : len(a)], mask[i, : len(a)] = a, True
    return x, mask


def train(pairs: list[tuple[str, str | None]]) -> ChainCRF:
    """The field for labelled clauses of (answer, question) pairs."""
    model = ChainCRF(FEATURES, len(LABELS), GRAMS)
    seen = [(x[-TRAINING_CLAUSES:], parts[-TRAINING_CLAUSES:], seed_labels(x)[-TRAINING_CLAUSES:]) for a, q in pairs for x, _, parts in [cues(a or "", q)] if len(x)]
    rich = [r for r in seen if r[2].any()]  # sequences of answers only are many and alike
    rows = rich + [r for r in seen if not r[2].any()][: max(200, len(rich))]
    if not rows:
        return model
    steps = max(2, max(len(r[0]) for r in rows))
    x, mask = _padded([r[0] for r in rows], steps, FEATURES)
    x[::2, :, 2] = 0  # the cue is hidden
    y = np.zeros(mask.shape, np.int64)
    for i, r in enumerate(rows):
        y[i, : len(r[2])] = r[2]
    return model.fit(x, y, mask, gram_columns([p for r in rows for p in r[1]]))


def tagged(model: ChainCRF, items: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> list[np.ndarray]:
    """The tags of each answer's clauses; answers of like length are decoded together, each in one pass."""
    tags: list[np.ndarray] = [np.zeros(0, np.int64)] * len(items)
    order = sorted(range(len(items)), key=lambda i: len(items[i][0]))
    while order:
        steps = max(2, len(items[order[-1]][0]))
        part = order[-max(1, CELLS // steps) :]
        del order[-len(part) :]
        x, mask = _padded([items[i][0] for i in part], steps, FEATURES)
        out = model.decode(x, mask, gram_columns([p for i in part for p in items[i][2]]))
        for row, i in zip(out, part):
            tags[i] = row[: len(items[i][0])]
    return tags


def defect(tags: np.ndarray, size: np.ndarray) -> str | None:
    """The pair's defect from its clauses' tags: what they cover, and the one in which the answer closes.

    An answer that closes in a refusal is one.  One that is foreign for more than half of its characters is in another
    language.  One that echoes at least 0.7 of its characters and does not close in an answer copies the question.  Any other
    that does not close in an answer (foreign clauses at the end aside) is truncated.
    """
    covered = np.array([size[tags == k].sum() for k in range(len(LABELS))]) / max(size.sum(), 1)
    own = tags[tags != FOREIGN]
    closes = tags[-1] if tags[-1] in (REFUSAL, UNFINISHED) or not len(own) else own[-1]
    if closes == REFUSAL:
        return "refusal"
    if covered[FOREIGN] > 0.5:
        return "other_language"
    if covered[ECHO] >= 0.7 and closes != ANSWER:
        return "copies_question"
    return None if closes == ANSWER else "truncated"


def judged(records: DataFrame, training: int = TRAINING) -> DataFrame:
    """``(source_line, defect, answer_share, refusal_share, echo_share, foreign_share, unfinished_share)`` of every record."""
    at = F.array_max(F.transform("messages", lambda m, i: F.when(m["role"] == "user", i).otherwise(-1)))
    after = F.filter("messages", lambda m, i: (m["role"] == "assistant") & (i > F.coalesce(at, F.lit(-1))))
    pairs = records.select(
        F.col("_source_line").alias("source_line"),
        F.try_element_at(after, F.lit(1))["content"].alias("answer"),
        F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["content"].alias("question"),
    )
    # a hash threshold from the row count (read from file footers) keeps what reaches the driver near ``training`` rows
    share = min(1.0, 4 * training / max(records.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(7), "source_line"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = pairs.where(drawn).where("answer IS NOT NULL").orderBy(F.xxhash64("source_line"), "source_line").limit(training)
    model = train([(r["answer"], r["question"]) for r in sample.collect()])  # at most ``training`` records

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, answers, questions = (batch.column(c).to_pylist() for c in ("source_line", "answer", "question"))
            kinds: list[str | None] = ["empty"] * len(lines)
            shares = np.zeros((len(lines), len(LABELS)))
            held, rows = [], []
            for i, (a, q) in enumerate(zip(answers, questions)):
                if a and _WORD_CHARS.search(_EMPTY_BOX.sub("", _TAGS.sub("", a))):
                    item = cues(a, q)
                    if len(item[0]):
                        held.append(item)
                        rows.append(i)
            for i, (_, size, _), tags in zip(rows, held, tagged(model, held)):
                kinds[i] = defect(tags, size)
                for k in range(len(LABELS)):
                    shares[i, k] = size[tags == k].sum() / max(size.sum(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.int64()), pa.array(kinds, pa.string()), *(pa.array(np.round(shares[:, k], 6)) for k in range(len(LABELS)))],
                names=["source_line", "defect", *(f"{n}_share" for n in LABELS)],
            )

    return pairs.mapInArrow(tag, "source_line bigint, defect string, " + ", ".join(f"{n}_share double" for n in LABELS))


def found(records: DataFrame) -> DataFrame:
    """p2_found."""
    return judged(records).where("defect IS NOT NULL").select("source_line", "defect")


def report(records: DataFrame) -> DataFrame:
    """Rows per split, source and defect (null: none)."""
    lines = records.select(F.col("_source_line").alias("source_line"), "split_name", "source")
    return lines.join(judged(records).select("source_line", "defect"), "source_line").groupBy("split_name", "source", "defect").agg(F.count("*").alias("rows"))
