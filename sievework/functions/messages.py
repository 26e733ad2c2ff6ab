"""Chat message arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.letters import option_lines

#: The prompts of the evaluation protocol.
MULTI_PROMPT = (
    "你是一个认真阅读的人,正在回答一道关于心理状态(theory-of-mind)的多选题。请一步步推理角色的心理状态,然后输出最终答案:"
    "把所有正确选项的字母放进同一个 \\boxed{} 中,用英文逗号分隔,例如 \\boxed{A,C}。把最终的 \\boxed{} 放在最后一行。"
)
SINGLE_PROMPT = (
    "你是一个认真阅读的人,正在回答一道关于心理状态(theory-of-mind)的单选题。请一步步推理角色的心理状态,然后输出最终答案,"
    "格式为 \\boxed{X},其中 X 是唯一最合适选项的字母。把最终的 \\boxed{X} 放在最后一行。"
)
ROLES = ("system", "user", "assistant")


def last_content(messages: Column, role: str) -> Column:
    """Content of the last message of a role; '' without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))


def with_last_answer(messages: Column, content: Column) -> Column:
    """The messages with the content of the last assistant message replaced."""
    at = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i).otherwise(-1)))
    return F.transform(
        messages,
        lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, content).otherwise(m["content"]).alias("content")),
    )


def chat_error(messages: Column) -> Column:
    """Why a conversation can't be trained on; null if it can."""
    blank = F.exists(messages, lambda m: m["content"].isNull() | (F.regexp_replace(m["content"], r"(?U)\s+", "") == ""))
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no_messages")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "unknown_role")
        .when(blank, "blank_content")
        .when(~F.exists(messages, lambda m: m["role"] == "assistant"), "no_assistant")
        .when(F.element_at(messages, -1)["role"] != "assistant", "last_not_assistant")
    )


def system_prompt(task_format: Column) -> Column:
    return F.when(F.lower(F.coalesce(task_format, F.lit(""))) == "mcq_single", SINGLE_PROMPT).otherwise(MULTI_PROMPT)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def evaluation_messages(task_format: Column, story: Column, question: Column, options: Column) -> Column:
    """System and user message of a labelled item; the label is no part of it."""
    user = F.concat(
        F.lit("请根据下面的故事回答问题。\n\n故事：\n"), story, F.lit("\n\n问题：\n"), question, F.lit("\n\n选项：\n"), option_lines(options)
    )
    return F.array(_message("system", system_prompt(task_format)), _message("user", user))


def without_labels(messages: Column, task_format: Column) -> Column:
    """A stored conversation as a prompt: assistant and old system messages out, the protocol's prompt in front."""
    kept = F.filter(messages, lambda m: ~m["role"].isin("assistant", "system"))
    return F.concat(F.array(_message("system", system_prompt(task_format))), kept)
