"""Problem 6: text that looks the same but is written with other characters.

``canonical`` brings a text to one form: characters that show nothing are removed, every kind of white
space is mapped to a plain space or line break, look-alikes of other scripts are replaced where
they stand in for plain writing, then compatibility composition (NFKC), full case folding and
NFKC once more.

A text is disguised if that form differs from its plain reading, both before case folding.  The plain reading takes away the
differences that are no disguise: ordinary line breaks and tabs, the ideographic space, and characters whose compatibility form
shows otherwise or is ordinary punctuation (see ``plain_difference``).  So a row is reported exactly if bringing it to the one
form changes more than case and plain differences.

Everything works on the distinct values of an Arrow batch.  A regular expression in the JVM passes over texts
made of quiet characters only (``SUSPECT``, derived from the rules below), so Python sees the few that may need work.

Look-alikes are judged by their surroundings: a Greek, Cyrillic, Armenian or Cherokee letter is one if its word
also has Latin letters, or if its word consists of look-alikes only and the text has no other word
truly written in that script.  A kana look-alike is one between Han characters in a text without
real kana around it.

Defined results: null and empty texts stay as they are and are never disguised; an empty array stays empty.  Ordinary
Chinese punctuation, ideographic spaces, tabs, line breaks and composed accents are plain.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗԌԚԜҮаеѕіјорсухԁһԛԝѵү", "ABESIJKMHOPCTYX3GQWYaesijopcyxdhqwvy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺͿαινορυχϲϳγ", "ABEZHIKMNOPTYXFCMJaivopuxcjy"))
ARMENIAN = dict(zip("ՍՏՕԼօոսհցյզ", "USOLonuhgjq"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZRWSVSLCPKdB"))
LATIN_FORMS = dict(zip("ıɑɡɩꞌ", "iagi'"))
# Kana, bopomofo and strokes that look like Han characters.
KANA = dict(zip("ニロカタエトハーミ", "二口力夕工卜八一三"))
# Radicals of the supplement block (without a compatibility mapping) and their characters.
RADICALS = dict(
    zip(
        "⺁⺅⺈⺉⺋⺎⺏⺐⺑⺒⺓⺔⺖⺘⺙⺛⺝⺞⺠⺡⺣⺤⺥⺦⺨⺩⺫⺭⺮⺯⺱⺲⺳⺵⺶⺷⺸⺹⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "厂亻刂刂㔾兀尣尢尣巳幺彑忄扌攵旡月歺民氵灬爫爫丬犭王罒礻竹糸罒罒罒网羊羊羋耂聿肉臼艹艹艹虎衤西西见角角讠贝足车辶辶辶阝钅長镸长门阜阝雨青韦页风飞食食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀",
    )
)
FOREIGN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE


def _chars(spec: str) -> str:
    """The inside of a character class from hexadecimal code points and ranges."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in spec.split())


_SCRIPTS = tuple(
    (f"[{_chars(spec)}]", table)
    for spec, table in (("400-52F", CYRILLIC), ("370-3FF 1F00-1FFF", GREEK), ("530-58F", ARMENIAN), ("13A0-13FF AB70-ABBF", CHEROKEE))
)
_LATIN = "A-Za-z" + _chars("C0-D6 D8-F6 F8-24F 1E00-1EFF")
_OTHER = _chars("251 261 269 370-3FF 400-52F 530-58F 13A0-13FF AB70-ABBF 1F00-1FFF")
_WORD = re.compile(f"[{_LATIN}{_OTHER}{_chars('300-36F')}]+")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_HAS_FOREIGN = re.compile(f"[{_OTHER}{_chars('131')}]")
#: Every code point but surrogates, for classes that are derived from Unicode data.
_EVERY = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


def _runs(chars: str) -> list[tuple[str, str]]:
    """Sorted characters as ranges."""
    out: list[tuple[str, str]] = []
    for c in chars:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _class(chars: str, form: str = "%s") -> str:
    """The inside of a character class of sorted characters."""
    return "".join("-".join(form % (x if form == "%s" else f"{ord(x):X}") for x in ((a,) if a == b else (a, b))) for a, b in _runs(chars))


#: Unicode's default-ignorable characters, and controls that show nothing.
INVISIBLE = "".join(regex.findall(r"\p{Default_Ignorable_Code_Point}|[\p{Cc}--[\t\n\v\f\r\x85]]", _EVERY, regex.V1))
_INVISIBLE = re.compile("[" + "".join(f"{a}-{b}" for a, b in _runs(INVISIBLE)) + "]")
_SPACE = re.compile("[" + _chars("A0 1680 2000-200A 202F 205F") + "]")
_ODD_BREAK = re.compile("[" + _chars("85 2028-2029") + "]")
_BREAK = re.compile("\r\n|[\r\x0b\x0c" + _chars("85 2028-2029") + "]")
_PLAIN_BREAK = re.compile("\r\n|[\r\x0b\x0c]")
_MAY_DIFFER = re.compile("[^" + _chars("0-7E 4E00-9FFF") + "]")
_RADICAL = re.compile("[" + _chars("2E80-2FD5") + "]")
_KANA_LIKE = re.compile("[" + "".join(KANA) + "]")
_KANA_NEAR = re.compile("[" + _chars("3041-3096 30A1-30FA 30FC-30FE FF66-FF9F") + "]")
_HAN = re.compile("[" + _chars("3400-4DBF 4E00-9FFF") + "]")
@lru_cache(8192)
def _compatible(c: str) -> bool:
    """A single character that shows like plain writing and has a compatibility form of its own."""
    kind = unicodedata.decomposition(c).partition(">")[0]
    if kind[:1] != "<" or c in "\u3000\u00b5":
        return False
    if c == "\u017f" or kind[1:] in ("font", "wide", "narrow", "noBreak"):
        return unicodedata.category(c)[0] in "LNZ"
    return kind[1:] == "compat" and (unicodedata.category(c)[0] in "LN" or "\u2f00" <= c <= "\u2fd5")


def _lookalikes(text: str) -> dict[int, str]:
    """Positions of look-alikes and what they stand for."""
    found: dict[int, str] = {}
    if _HAS_FOREIGN.search(text):
        words = [(m.start(), m.group()) for m in _WORD.finditer(text)]
        for at, word in words:
            if not _HAS_FOREIGN.search(word):
                continue
            latin = _HAS_LATIN.search(word) is not None
            for pattern, table in _SCRIPTS:
                own = re.findall(pattern, word)
                if not own:
                    continue
                if not latin:
                    if any(c not in table for c in own) or any(
                        c not in table for _, w in words for c in re.findall(pattern, w)
                    ):
                        continue
                found |= {at + i: table[c] for i, c in enumerate(word) if c in table}
            if latin:
                found |= {at + i: LATIN_FORMS[c] for i, c in enumerate(word) if c in LATIN_FORMS and not (c == "ı" and re.search("[şğçöüİ]", text))}
    if _KANA_LIKE.search(text):
        for m in _KANA_LIKE.finditer(text):
            left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not _KANA_NEAR.match(left) and not _KANA_NEAR.match(right) and (_HAN.match(left) or _HAN.match(right)):
                found[m.start()] = KANA[m.group()]
        kana = [m.start() for m in _KANA_NEAR.finditer(text)]
        if any(k not in found for k in kana):  # a text that is really Japanese
            found = {k: v for k, v in found.items() if k not in kana}
    return found


def plain_difference(c: str) -> bool:
    """A character whose compatibility form is no other writing of the same sight, or is ordinary punctuation."""
    odd = _compatible(c) or _INVISIBLE.match(c) or _SPACE.match(c) or _ODD_BREAK.match(c) or _RADICAL.match(c)
    return not odd and unicodedata.normalize("NFC", c) == c


@lru_cache(8192)
def _plain_form(c: str) -> str:
    return unicodedata.normalize("NFKC", c) if plain_difference(c) else c


def plain_reading(text: str) -> str:
    """The text without its plain differences."""
    if not text.isascii():
        text = _MAY_DIFFER.sub(lambda m: _plain_form(m.group()), text)
    return _PLAIN_BREAK.sub("\n", text).replace("\t", " ")


def composed(text: str) -> str:
    """The one form of a text before case folding."""
    if text.isascii():
        text = _INVISIBLE.sub("", text)
    else:
        text = _SPACE.sub(" ", _INVISIBLE.sub("", text))
        if _RADICAL.search(text):
            text = "".join(RADICALS.get(c, c) for c in text)
        if _HAS_FOREIGN.search(text) or _KANA_LIKE.search(text):
            text = unicodedata.normalize("NFC", text)
            swap = _lookalikes(text)
            text = "".join(swap.get(i, c) for i, c in enumerate(text)) if swap else text
        text = unicodedata.normalize("NFKC", text)
    return _BREAK.sub("\n", text).replace("\t", " ")


def read(text: str | None) -> tuple[str | None, bool]:
    """The one form of a text, and whether it was disguised."""
    if text is None:
        return None, False
    form = composed(text)
    odd = form != plain_reading(text)
    return form.casefold() if form.isascii() else unicodedata.normalize("NFKC", form.casefold()), odd


def canonical(text: str | None) -> str | None:
    """The one form of a text (see the module)."""
    return read(text)[0]


def disguised(text: str | None) -> bool:
    """Whether the one form differs from the plain reading."""
    return read(text)[1]


def _quiet(c: str) -> bool:
    """A character that can't make a text disguised, whatever stands beside it."""
    alone = plain_difference(c) and not _compatible(c) and c not in FOREIGN and c not in LATIN_FORMS and c not in KANA
    joins = unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or "\u1100" <= c <= "\u11ff"
    return alone and not joins


#: What the JVM passes over are texts of these characters only: the quiet ones of the blocks that Chinese and English texts use.
QUIET = "\t\n\r" + "".join(c for a, b in ((0x20, 0x7E), (0xA0, 0x17F), (0x2010, 0x205F), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF)) for c in map(chr, range(a, b + 1)) if _quiet(c))
SUSPECT = "[^" + _class(QUIET, "\\x{%s}") + "]"


def _read_values(values: pd.Series) -> pd.DataFrame:
    """``read`` on the distinct values of a series."""
    codes, known = pd.factorize(values, use_na_sentinel=True)
    forms, odd = zip(*[read(v) for v in known], (None, False))
    return pd.DataFrame({"form": [forms[c] for c in codes], "changed": [odd[c] for c in codes]}, index=values.index)


def _read(c: str) -> Column:
    return F.pandas_udf(_read_values, "form string, changed boolean")(c)


def _suspect(c: Column) -> Column:
    return c.rlike(SUSPECT) & c.isNotNull()


def _train_texts(records: DataFrame) -> DataFrame:
    return records.select(F.col("_source_line").alias("row_id"), F.posexplode("messages").alias("message_no", "m")).select(
        "row_id", "message_no", F.col("m.content").alias("value")
    )


def _letters(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.col("prediction_id").alias("row_id"), F.posexplode("predicted_letters").alias("letter_no", "value"))


def _changed(texts: DataFrame) -> DataFrame:
    """The rows of ``(row_id, value)`` whose one form differs from the plain reading."""
    return texts.where(_suspect(F.col("value"))).where(_read("value")["changed"])


def found(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """p6_found: ``(table_name, row_id)`` of all rows with a value that its one form changes."""
    some = records.where(F.exists("messages", lambda m: _suspect(m["content"])))
    train = _changed(_train_texts(some)).select("row_id").distinct()
    letters = _letters(predictions.where(F.exists("predicted_letters", _suspect)))
    values = _changed(letters.select("value").distinct())  # distinct letters are few
    pred = letters.join(values, "value").select("row_id").distinct()
    return train.select(F.lit("train_records").alias("table_name"), "row_id").union(
        pred.select(F.lit("predictions").alias("table_name"), "row_id")
    )


def train_forms(records: DataFrame) -> DataFrame:
    """``(row_id, message_no, form, changed)``: every message in its one form; ``changed`` marks disguised ones."""
    read_ = _train_texts(records).withColumn("r", _read("value"))
    return read_.select("row_id", F.col("message_no").cast("bigint").alias("message_no"), "r.form", "r.changed")


def letter_forms(predictions: DataFrame) -> DataFrame:
    """``(row_id, forms, changed)``: predicted letters in upper case of their one form, blanks stripped.

    Null letters stay null, empty arrays stay empty.
    """
    letters = _letters(predictions)
    values = letters.select("value").distinct()
    table = values.withColumn("r", _read("value")).select("value", F.upper(F.trim("r.form")).alias("form"), F.col("r.changed").alias("odd"))
    per_row = (
        letters.join(table, "value", "left")
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("letter_no", "form"))).alias("x"), F.max(F.coalesce("odd", F.lit(False))).alias("changed"))
        .select("row_id", F.transform("x", lambda e: e["form"]).alias("forms"), "changed")
    )
    return predictions.select(F.col("prediction_id").alias("row_id"), "predicted_letters").join(per_row, "row_id", "left").select(
        "row_id",
        F.when(F.col("predicted_letters").isNotNull(), F.coalesce("forms", F.array().cast("array<string>"))).alias("forms"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
    )
