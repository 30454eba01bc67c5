"""Message lists, ``array<struct<role, content>>``, and their renderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelens.functions.text import option_letter

# Prompt wordings. All are defaults of parameters.
TRAINING_SYSTEM = (
    "You are a logical assistant who is good at critical thinking and problem solving. "
    "Given a question out of a provided context, you will be given multiple options out of which you have to pick the right answer.\n"
    "Rationalize your answer step by step, then provide only the final choice letter at the very end after "
    "'#### (Correct option number out of all 4 options)' \n"
    "For example, #### 1"
)
PATCHED_SYSTEM = (
    "You are a logical assistant who is good at critical thinking and problem solving. "
    "Given a question out of a provided context, you will be given multiple options out of which you have to pick the right answer.\n"
    "Rationalize your answer step by step, then provide only the final choice number (out of 1-4) at the very end after ####. "
    "For example, #### 1"
)
EVAL_SYSTEM = (
    "Given a question out of a provided context, you will be given multiple options out of which you have to pick the right answer.\n"
    "Rationalize your answer and then provide only the final choice number (out of 1-4) at the very end after ####. For example, #### 1\n"
)
PRIVILEGE_MESSAGE = ("The correct answer is ", ". Now let me reason through this step by step.")
PRIVILEGE_SUFFIX = ("\nThe correct answer is ", ".")


@dataclass(frozen=True)
class ChatTemplate:
    """How one message is written, and what asks for the next one."""

    before_role: str = "<|"
    before_content: str = "|>\n"
    after_content: str = "\n"
    generation_suffix: str = "<|assistant|>\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def last_content(messages: Column) -> Column:
    """Text of the last message; null for an empty list."""
    return F.get(messages, F.size(messages) - 1)["content"]


def lettered_options(options: Column) -> Column:
    """``A. text`` lines, each closed by a newline."""
    lines = F.transform(options, lambda o, i: F.concat(option_letter(i), F.lit(". "), o, F.lit("\n")))
    return F.array_join(lines, "")


def numbered_options(options: Column) -> Column:
    """``1. text`` lines joined by newlines."""
    lines = F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o))
    return F.array_join(lines, "\n")


def training_messages(context: Column, query: Column, options: Column, system: str) -> Column:
    user = F.concat(
        F.lit("Context: "), context, F.lit("\n\nQuestion: "), query,
        F.lit("\n\nOptions:\n"), lettered_options(options),
    )
    return F.array(message("system", F.lit(system)), message("user", user))


def eval_messages(context: Column, query: Column, options: Column, system: str) -> Column:
    user = F.concat(
        F.lit("Context: "), context, F.lit("\nQuestion: "), query,
        F.lit("\nOptions:\n"), numbered_options(options),
    )
    return F.array(message("system", F.lit(system)), message("user", user))


def patch_system(messages: Column, text: str) -> Column:
    """Put ``text`` in place of the first system message, or in front when there is none."""
    place = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("system")).cast("int")
    head = F.slice(messages, F.lit(1), F.greatest(place - 1, F.lit(0)))
    rest = F.slice(messages, place + 1, F.size(messages))
    return F.concat(head, F.array(message("system", F.lit(text))), rest)


def has_label(label: Column) -> Column:
    return F.coalesce(label != "", F.lit(False))


def with_privilege(messages: Column, label: Column) -> Column:
    """Append the assistant message that gives the answer away; no label, no message."""
    before, after = PRIVILEGE_MESSAGE
    hint = message("assistant", F.concat(F.lit(before), label, F.lit(after)))
    return F.when(has_label(label), F.concat(messages, F.array(hint))).otherwise(messages)


def with_privilege_text(prompt: Column, label: Column) -> Column:
    """The same for a prompt that is plain text."""
    before, after = PRIVILEGE_SUFFIX
    hint = F.concat(prompt, F.lit(before), label, F.lit(after))
    return F.when(has_label(label), hint).otherwise(prompt)


def render(messages: Column, template: ChatTemplate, add_suffix: Column | bool = True) -> Column:
    """One string for a message list, optionally asking for the next message."""
    parts = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(template.before_role), m["role"], F.lit(template.before_content),
            m["content"], F.lit(template.after_content),
        ),
    )
    wanted = F.lit(add_suffix) if isinstance(add_suffix, bool) else add_suffix
    suffix = F.when(wanted, F.lit(template.generation_suffix)).otherwise("")
    return F.concat(F.array_join(parts, ""), suffix)


def apply_template(text: Column, template: str | None) -> Column:
    """Put ``text`` at every ``{}`` of a template; no template leaves it alone."""
    if not template:
        return text
    return F.replace(F.lit(template), F.lit("{}"), text)
