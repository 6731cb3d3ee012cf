"""Text that patterns ask for, read from their Java form.

What a pattern has to begin with finds its candidates by equality of prefixes;
a template of text and captures alone is a comparison of strings; any other
template with captures becomes one pattern with back references, so no row
brings a pattern of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ruleloom.functions.re2 import Template

#: A letter of text, as ``re2.literal`` writes it.
LETTER = re.compile(r"\\x([0-9A-F]{2})|\\([^0-9A-Za-z])|([0-9A-Za-z]|[^\x00-\x7F])", re.DOTALL)
REPEATS = ("*", "+", "?", "{")


def letters(java: str, at: int = 0) -> tuple[str, int]:
    """The text that ``java`` has at a place, and where it ends. A letter that
    is repeated isn't part of it."""
    out: list[str] = []
    while m := LETTER.match(java, at):
        if java.startswith(REPEATS, m.end()):
            break
        out.append(chr(int(m[1], 16)) if m[1] else m[2] or m[3])
        at = m.end()
    return "".join(out), at


def has_choice(java: str) -> bool:
    """Is there an alternative outside of all groups?"""
    depth, i, in_class = 0, 0, False
    while i < len(java):
        c = java[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return True
        i += 1
    return False


def prefix(java: str) -> str:
    """What every match begins with, at the beginning of the text; empty if a
    match may stand elsewhere."""
    return letters(java, 2)[0] if java.startswith(r"\A") and not has_choice(java) else ""


def template_prefix(t: Template) -> str:
    return prefix("".join(p if isinstance(p, str) else "(?:)" for p in t.java))


def antichain(prefixes: list[str]) -> list[str]:
    """The prefixes that don't continue another one."""
    out: list[str] = []
    for p in sorted(set(prefixes)):
        if not out or not p.startswith(out[-1]):
            out.append(p)
    return out


@dataclass(frozen=True)
class Plain:
    """Text and captures in order, at the beginning or the end of a text if so marked."""

    parts: tuple[str | int, ...]
    first: bool
    last: bool


def plain(t: Template) -> Plain | None:
    """``t`` as text and captures, if it has nothing else."""
    parts: list[str | int] = []
    first = last = False
    for k, p in enumerate(t.java):
        if isinstance(p, int):
            parts.append(p)
            continue
        if k == 0 and p.startswith(r"\A"):
            first, p = True, p[2:]
        if k == len(t.java) - 1 and p.endswith(r"\z") and not p.endswith(r"\\z"):
            last, p = True, p[:-2]
        text, end = letters(p)
        if end < len(p):
            return None
        parts.append(text)
    return Plain(tuple(parts), first, last)


#: Stands between captures and the text they are compared with.
SEPARATOR = "\U0010ffff"


def backreferring(t: Template) -> str:
    """A pattern for the captures 1 to ``highest``, each followed by
    ``SEPARATOR``, and the text that ``t`` is matched with."""
    body = "".join(p if isinstance(p, str) else rf"(?:\{p})" for p in t.java)
    body = re.sub(r"\\(.)", lambda m: f"(?<={SEPARATOR})" if m[1] == "A" else m[0], body, flags=re.DOTALL)
    return rf"\A{rf'([^{SEPARATOR}]*){SEPARATOR}' * t.highest}(?s:.*?)(?:{body})"
