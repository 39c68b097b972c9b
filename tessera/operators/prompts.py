"""Answer prompts by query class, in our own wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import classify

INSTRUCTIONS = {
    "configuration": "Give a complete, commented configuration and say how to apply and check it.",
    "troubleshooting": "Name the likely causes in order, how to confirm each, and the fix.",
    "best_practices": "List the recommended practices with the reason for each and common mistakes.",
    "migration": "Give the steps in order, what changes between versions, and how to go back.",
    "security": "State the risks, the controls that answer them, and the least privileges needed.",
    "networking": "Follow the traffic hop by hop and say where it is allowed or refused.",
    "exam": "Explain the concept briefly, compare the alternatives, and give one worked example.",
    "general": "Answer clearly and concisely.",
}


def joined_context(context: Column) -> Column:
    return F.array_join(context, "\n\n")


def generic(query: Column, context: Column) -> Column:
    return F.concat(F.lit("TASK answer\nUse only this context.\n\n"), joined_context(context), F.lit("\n\nQuestion: "), query)


def for_class(query: Column, context: Column, kind: Column | None = None) -> Column:
    kind = classify(query) if kind is None else kind
    table = F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv])
    text = F.coalesce(F.try_element_at(table, kind), F.lit(INSTRUCTIONS["general"]))
    return F.concat(F.lit("TASK answer\n"), text, F.lit("\n\n"), joined_context(context), F.lit("\n\nQuestion: "), query)
