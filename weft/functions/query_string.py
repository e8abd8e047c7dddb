"""The query mini-language of @@: words, "phrases", field:word, field:[vector], AND, OR, NOT and parentheses.

OR binds least, then AND (also implied between neighbours), then NOT.
"""

from __future__ import annotations

import re
from collections.abc import Callable

TOKEN = re.compile(r"\s*(?:(\()|(\))|(\w+):\[([^\]]*)\]|(?:(\w+):)?\"([^\"]*)\"|(?:(\w+):)?([^\s()\":\[\]]+))")


def parse(text: str) -> tuple:
    """("term", field, word), ("phrase", field, words), ("vector", field, numbers), ("and" | "or", [nodes]), ("not", node)."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad query: {text[at:]}")
        at = m.end()
        if m[1] or m[2]:
            found.append(m[1] or m[2])
        elif m[3]:
            found.append(("vector", m[3], [float(x) for x in m[4].split(",") if x.strip()]))
        elif m[6] is not None:
            found.append(("phrase", m[5], m[6]))
        elif m[7] is None and m[8].upper() in ("AND", "OR", "NOT"):
            found.append(m[8].upper())
        else:
            found.append(("term", m[7], m[8]))
    pos = 0

    def peek():
        return found[pos] if pos < len(found) else None

    def take():
        nonlocal pos
        pos += 1
        return found[pos - 1]

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both():
        parts = [negated()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                take()
            parts.append(negated())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negated():
        if peek() == "NOT":
            take()
            return ("not", negated())
        if peek() == "(":
            take()
            node = either()
            if peek() != ")":
                raise ValueError("a parenthesis is open")
            take()
            return node
        if not isinstance(peek(), tuple):
            raise ValueError(f"a word is missing: {text}")
        return take()

    if not found:
        raise ValueError("an empty query")
    node = either()
    if peek() is not None:
        raise ValueError(f"bad query: {text}")
    return node


def has_vector(node: tuple) -> bool:
    return node[0] == "vector" or node[0] in ("and", "or") and any(map(has_vector, node[1])) or node[0] == "not" and has_vector(node[1])


def words(node: tuple) -> list[str]:
    """Words that a match may be highlighted by: those not under NOT."""
    if node[0] in ("term", "phrase"):
        return node[2].split()
    return [w for n in node[1] for w in words(n)] if node[0] in ("and", "or") else []


def compile(node: tuple, leaf: Callable, both: Callable, either: Callable, negated: Callable, fused: Callable):
    """Bottom-up: a conjunction of text and vectors is fused, others are intersected."""
    kind = node[0]
    if kind in ("term", "phrase", "vector"):
        return leaf(node)
    if kind == "not":
        return negated(compile(node[1], leaf, both, either, negated, fused))
    parts = [compile(n, leaf, both, either, negated, fused) for n in node[1]]
    if kind == "or":
        return either(parts)
    mixed = any(map(has_vector, node[1])) and not all(map(has_vector, node[1]))
    return fused(parts) if mixed else both(parts)
