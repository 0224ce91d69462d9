"""Parsing-expression grammars: rules without recursion compiled to atomic regular expressions, and parse trees.

A parsing expression commits to the first choice that matches and never gives back what a repetition took. Atomic groups have
just that meaning, so a rule turns into one compiled pattern and keeps the speed of the matcher; its named nodes become named groups. The one
rule that contains itself, annotations within annotations, is parsed by a stack to any depth and length in linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Node:
    """A node of a parse tree: its rule, its attributes, and its parts (nodes and plain text) in order."""

    rule: str
    parts: list = field(default_factory=list)
    label: str | None = None
    at: float | None = None

    def text(self) -> str:
        """All plain text of the tree, annotations included."""
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)


def seq(*parts: str) -> str:
    return "(?>" + "".join(parts) + ")"


def choice(*parts: str) -> str:
    return "(?>" + "|".join(parts) + ")"


def many(part: str, least: int = 0, most: int | None = None) -> str:
    return f"(?:{part}){{{least},{'' if most is None else most}}}+"


def maybe(part: str) -> str:
    return f"(?:{part})?+"


def text(literal: str) -> str:
    return re.escape(literal)


def node(name: str, part: str) -> str:
    return f"(?P<{name}>{part})"


def ahead(part: str) -> str:
    return f"(?={part})"


def unless(part: str) -> str:
    return f"(?!{part})"


_CLOSING = {"[": "]", "(": ")", "{": "}"}
_BRACKETS = re.compile(r"[\[\](){}\n]")


def annotated(text: str) -> Node:
    """speech <- (annotation / character)*; annotation <- opener (annotation / character but line end)* closer, for three kinds of brackets.

    An opener without closer in its line, and a closer without opener, are characters.
    """
    root = Node("speech")
    stack: list[tuple[str, Node]] = []
    here, last = root, 0

    def drop(least: int) -> None:
        # Openers that nothing closes go back to being text of the node around them.
        nonlocal here
        while len(stack) > least:
            _, around = stack.pop()
            around.parts.extend(here.parts)
            here = around

    for m in _BRACKETS.finditer(text):
        char, at = m.group(), m.start()
        if char in _CLOSING:
            here.parts.append(text[last:at])
            stack.append((_CLOSING[char], here))
            here = Node("annotation", [char])
            last = at + 1
        elif char == "\n":
            if stack:
                here.parts.append(text[last:at])
                drop(0)
                last = at
        else:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == char), None)
            if depth is not None:
                here.parts.append(text[last:at])
                drop(depth + 1)
                here.parts.append(char)
                _, around = stack.pop()
                around.parts.append(here)
                here, last = around, at + 1
    here.parts.append(text[last:])
    drop(0)
    return root


def compiled(rule: str, flags: int = re.IGNORECASE) -> re.Pattern:
    return re.compile(rule, flags)
