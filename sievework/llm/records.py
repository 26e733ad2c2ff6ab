"""Columns of chat records that several operators read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STORY = re.compile(r"(?:故事|Story)[：:]")
_OPTIONS = re.compile(r"(?:选项|Options)[：:]")
IGNORABLE = re.compile("[" + "".join(map(chr, (0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF))) + "]")


def last_content(messages: str, role: str) -> Column:
    """Content of the last message of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def story_and_question(text: str) -> str:
    """From after the first story label to before the last options label; '' without a story label.

    Characters that show nothing don't hide a label.  Without an options label the text goes on
    to its end.
    """
    start = _STORY.search(text)
    if not start:
        text = IGNORABLE.sub("", text)
        start = _STORY.search(text)
        if not start:
            return ""
    end = len(text)
    for m in _OPTIONS.finditer(text, start.end()):
        end = m.start()
    return text[start.end() : end]
