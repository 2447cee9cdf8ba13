"""Prompt text for a vocabulary.  Vocabularies are some hundred names, so this is driver-side text."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Context:
    schema: str
    known_values: dict[str, list[str]] = field(default_factory=dict)
    examples: list[dict[str, str]] = field(default_factory=list)


#: The settings, and what each does.
SETTINGS = ("direct_qa_baseline", "direct_qa_grounded", "cypher_soft", "cypher_strict")


def answers_directly(setting: str) -> bool:
    return setting in SETTINGS[:2]


def writes_queries(setting: str) -> bool:
    return setting in SETTINGS[2:]


def grounded(setting: str) -> bool:
    return setting in (SETTINGS[1], SETTINGS[3])


def strict(setting: str) -> bool:
    return setting == SETTINGS[3]


def system_prompt(context: Context, setting: str, most_examples: int = 3) -> str:
    """Schema, known values, rules and examples; empty sections are left out."""
    parts = ["You translate questions about a property graph into queries.", "Schema:\n" + context.schema]
    if context.known_values:
        parts.append("Known values:\n" + "\n".join(f"{k}: {', '.join(v)}" for k, v in sorted(context.known_values.items())))
    rules = ["Use only labels, properties and relations of the schema."]
    if strict(setting):
        rules.append("A property with listed values takes one of them.")
    rules.append("Take no hop that the question does not need; for what is absent, negate the pattern.")
    parts.append("Rules:\n" + "\n".join(f"- {r}" for r in rules))
    if context.examples and most_examples:
        parts.append("Examples:\n" + "\n\n".join(f"Q: {e['question']}\nA: {e['query']}" for e in context.examples[:most_examples]))
    return "\n\n".join(parts)


def listing_prompt(labels: list[str], properties: list[str]) -> str:
    """The prompt without a vocabulary: sorted labels and properties, or a line that none are known."""
    lines = lambda names, kind: "\n".join(f"  - {x}" for x in sorted(names)) or f"  (no schema loaded: use any valid {kind})"
    return f"You translate questions about a property graph into queries.\n\nLabels:\n{lines(labels, 'label')}\n\nProperties:\n{lines(properties, 'property')}"


def choose(setting: str, context: Context | None, labels: list[str] = [], properties: list[str] = [], grounding: str = "") -> str:
    """The prompt of a setting: of queries the vocabulary's if there is one, else the listing; of direct answers with the grounding text if grounded."""
    if writes_queries(setting):
        return system_prompt(context, setting) if context else listing_prompt(labels, properties)
    task = "Answer questions about a model with a JSON list alone."
    return f"{task}\n\n{grounding}" if grounded(setting) and grounding else task


def user_prompt(question: str) -> str:
    return f"Question: {question}\nQuery:"


def grounding_text(entities: list[str], kinds: dict[str, str], choices: dict[str, list[str]]) -> str:
    """Entities, then strict, boolean and numeric properties; others are left out."""
    lines = ["Entities: " + ", ".join(sorted(entities))]
    for kind in ("STRICT", "BOOLEAN", "NUMERIC"):
        own = sorted(p for p, k in kinds.items() if k == kind)
        if own:
            lines.append(f"{kind}: " + ", ".join(f"{p} ({', '.join(choices[p])})" if choices.get(p) else p for p in own))
    return "\n".join(lines)


def truncated(text: str, most: int, close: str = "]") -> str:
    """A JSON list cut to a number of characters, after its last whole object."""
    if len(text) <= most:
        return text
    at = text.rfind("},", 0, most)
    return text[:most] if at < 0 else text[: at + 1] + close
