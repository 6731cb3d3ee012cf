"""RE2 patterns for a Java matcher.

Rules are written in RE2's dialect. ``compile_re2`` checks a pattern by that
dialect, counts its groups and writes an equivalent pattern for
``java.util.regex``, which Spark uses. What one engine reads differently is
spelled out: ``$`` is the end of the text, ``.`` is any character but a line
feed, classes and word edges are ASCII, ``{`` is literal unless it repeats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


class PatternError(ValueError):
    """A pattern that RE2 rejects."""


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    groups: int


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    u: bool = False  # U: swap greediness


WORD = "[0-9A-Za-z_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_EDGE = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

# The dialect's classes, escapes and Unicode categories.
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
CONTROL = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
CATEGORIES = set("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
SCRIPT = re.compile(r"[A-Z][a-z]+(_[A-Z]?[a-z]+)*\Z")
REPEAT = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
MOST = 1000


def literal(code: int) -> str:
    c = chr(code)
    if c.isascii() and c.isalnum() or code > 127:
        return c
    return "\\" + c if 32 < code < 127 else f"\\x{code:02X}"


class _Reader:
    def __init__(self, source: str):
        self.source, self.at, self.groups = source, 0, 0

    def fail(self, what: str) -> PatternError:
        return PatternError(f"error parsing regexp: {what}")

    def peek(self, n: int = 1) -> str:
        return self.source[self.at : self.at + n]

    def alternatives(self, flags: Flags, depth: int) -> tuple[str, int]:
        """Up to the closing bracket or the end; the text and how often its
        parts are repeated at most."""
        if depth > 1000:
            raise self.fail("expression nests too deeply")
        out: list[str] = []
        last: str | None = None  # an atom that may be repeated
        size = most = 1
        repeated = ""

        def push() -> None:
            nonlocal last, repeated
            if last is not None:
                out.append(last)
            last, repeated = None, ""

        while self.at < len(self.source):
            c = self.peek()
            if c == ")":
                break
            if c == "|":
                push()
                out.append("|")
                self.at += 1
                continue
            if c in "*+?" or c == "{" and REPEAT.match(self.source, self.at):
                begin = self.at
                op = c if c != "{" else REPEAT.match(self.source, self.at)[0]  # type: ignore[index]
                self.at += len(op)
                times = 1
                if c == "{":
                    m = REPEAT.fullmatch(op)
                    low = int(m[1])  # type: ignore[index]
                    high = int(m[3]) if m[3] else -1 if m[2] else low  # type: ignore[index]
                    if low > MOST or high > MOST or 0 <= high < low:
                        raise self.fail(f"invalid repeat count: `{op}`")
                    times = max(low, high, 1)
                lazy = self.peek() == "?"
                self.at += lazy
                if repeated:
                    raise self.fail(f"invalid nested repetition operator: `{repeated + self.source[begin : self.at]}`")
                if last is None:
                    raise self.fail(f"missing argument to repetition operator: `{op}`")
                if size * times > MOST:
                    raise self.fail(f"invalid repeat count: `{op}`")
                most = max(most, size * times)
                repeated = self.source[begin : self.at]
                last += op + ("?" if lazy != flags.u else "")
                continue
            push()
            size = 1
            if c == "(":
                if self.peek(2) == "(?":
                    inner, colon = self.group_flags(flags)
                    if not colon:
                        flags = inner
                        continue
                    opening = "(" if colon == "named" else "(?:"
                else:
                    self.at += 1
                    inner, opening = flags, "("
                self.groups += opening == "("
                text, size = self.alternatives(inner, depth + 1)
                if self.peek() != ")":
                    raise self.fail(f"missing closing ): `{self.source}`")
                self.at += 1
                last = f"{opening}{text})"
                most = max(most, size)
            elif c == "[":
                last = self.cased(self.char_class(), flags)
            elif c == ".":
                self.at += 1
                last = r"(?s:.)" if flags.s else r"[^\n]"
            elif c == "^":
                self.at += 1
                last = r"(?:\A|(?<=\n))" if flags.m else r"\A"
            elif c == "$":
                self.at += 1
                last = r"(?=\n|\z)" if flags.m else r"\z"
            elif c == "\\":
                last = self.escape(flags, out)
            else:
                self.at += 1
                last = self.cased(literal(ord(c)), flags)
        push()
        return "".join(out), most

    def cased(self, text: str, flags: Flags) -> str:
        return f"(?iu:{text})" if flags.i else text

    def group_flags(self, flags: Flags) -> tuple[Flags, str]:
        """After ``(?``: the flags, and ``named``, ``:`` or nothing."""
        named = re.compile(r"\(\?P?<([^>]*)>").match(self.source, self.at)
        if named and self.source[self.at + 2 : self.at + 4] not in ("<=", "<!"):
            if not re.fullmatch(r"\w+", named[1], re.ASCII):
                raise self.fail(f"invalid named capture: `{named[0]}`")
            self.at = named.end()
            self.names = getattr(self, "names", set())
            if named[1] in self.names:
                raise self.fail(f"duplicate capture group name: `{named[1]}`")
            self.names.add(named[1])
            return flags, "named"
        m = re.compile(r"\(\?([imsU]*)(-[imsU]+)?([:)])").match(self.source, self.at)
        if not m or m[3] == ")" and not m[1] and not m[2]:
            raise self.fail(f"invalid or unsupported Perl syntax: `{self.source[self.at : self.at + 3]}`")
        self.at = m.end()
        for name in m[1]:
            flags = replace(flags, **{name.lower(): True})
        for name in (m[2] or "")[1:]:
            flags = replace(flags, **{name.lower(): False})
        return flags, ":" if m[3] == ":" else ""

    def escape(self, flags: Flags, out: list[str]) -> str | None:
        c = self.peek(2)[1:]
        if c in ("A", "z"):
            self.at += 2
            return "\\" + c
        if c in ("b", "B"):
            self.at += 2
            return EDGE if c == "b" else NO_EDGE
        if c == "Q":
            end = self.source.find("\\E", self.at)
            text = self.source[self.at + 2 : end if end >= 0 else len(self.source)]
            self.at = end + 2 if end >= 0 else len(self.source)
            if not text:
                return None
            out += [self.cased(literal(ord(x)), flags) for x in text[:-1]]
            return self.cased(literal(ord(text[-1])), flags)
        if c == "E":
            self.at += 2  # an end without a beginning is nothing
            return None
        group = self.class_escape()
        if group is not None:
            return self.cased(f"[{group}]", flags)
        return self.cased(literal(self.character()), flags)

    def class_escape(self) -> str | None:
        """A class by one escape, as the inside of brackets."""
        c = self.peek(2)[1:]
        if c and c in "dswDSW":
            self.at += 2
            return PERL[c] if c.islower() else f"[^{PERL[c.lower()]}]"
        if c and c in "pP":
            m = re.compile(r"\\[pP](?:\{(\^?)([^}]*)\}|([A-Za-z]))").match(self.source, self.at)
            name = (m[2] if m and m[2] is not None else m[3]) if m else ""  # type: ignore[index]
            if not m or not (name in CATEGORIES or name == "Any" or SCRIPT.match(name)):
                raise self.fail(f"invalid character class range: `{self.source[self.at : self.at + 2 + len(name) + 2]}`")
            self.at = m.end()
            inverse = (c == "P") != bool(m[1])
            if name == "Any":
                return r"[^\x00-\x{10FFFF}]" if inverse else r"\x00-\x{10FFFF}"
            return ("\\P" if inverse else "\\p") + "{" + (name if name in CATEGORIES else f"Is{name}") + "}"
        return None

    def character(self) -> int:
        """The code point that an escape stands for."""
        begin = self.at
        c = self.peek(2)[1:]
        bad = self.fail(f"invalid escape sequence: `{self.source[begin : begin + 2]}`")
        if not c:
            raise self.fail("trailing backslash at end of expression: ``")
        octal = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(self.source, begin)
        if octal:
            self.at = octal.end()
            return int(octal[1], 8)
        if c == "x":
            m = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))").match(self.source, begin)
            if not m or int(m[1] or m[2], 16) > 0x10FFFF:
                raise bad
            self.at = m.end()
            return int(m[1] or m[2], 16)
        if c in CONTROL:
            self.at += 2
            return CONTROL[c]
        if c.isascii() and not c.isalnum() and c != "_" or c == "_":
            self.at += 2
            return ord(c)
        raise bad

    def char_class(self) -> str:
        begin = self.at
        self.at += 1
        inverse = self.peek() == "^"
        self.at += inverse
        parts: list[str] = []
        first = True
        while first or self.peek() != "]":
            if self.at >= len(self.source):
                raise self.fail(f"missing closing ]: `{self.source[begin:]}`")
            first = False
            posix = re.compile(r"\[:(\^?)(\w*):\]").match(self.source, self.at)
            if self.peek(2) == "[:" and ":]" in self.source[self.at :]:
                if not posix or posix[2] not in POSIX:
                    raise self.fail(f"invalid character class range: `{self.source[self.at : self.source.index(':]', self.at) + 2]}`")
                self.at = posix.end()
                parts.append(f"[^{POSIX[posix[2]]}]" if posix[1] else POSIX[posix[2]])
                continue
            if self.peek() == "\\":
                group = self.class_escape()
                if group is not None:
                    parts.append(group)
                    continue
            low = self.class_character(begin)
            high = low
            start = self.at
            if self.peek() == "-" and self.peek(2)[1:] not in ("", "]"):
                self.at += 1
                high = self.class_character(begin)
                if high < low:
                    raise self.fail(f"invalid character class range: `{self.source[start - 1 : self.at]}`")
            parts.append(literal(low) if low == high else f"{literal(low)}-{literal(high)}")
        self.at += 1
        inside = "".join(parts)
        return f"[^{inside}]" if inverse else f"[{inside}]"

    def class_character(self, begin: int) -> int:
        if self.at >= len(self.source):
            raise self.fail(f"missing closing ]: `{self.source[begin:]}`")
        if self.peek() == "\\":
            return self.character()
        self.at += 1
        return ord(self.source[self.at - 1])


def compile_re2(source: str) -> Pattern:
    reader = _Reader(source)
    text, _ = reader.alternatives(Flags(), 0)
    if reader.at < len(source):
        raise reader.fail(f"unexpected ): `{source}`")
    return Pattern(source, text, reader.groups)


# Templates: patterns with references to captures


def template_parts(source: str) -> list[str | int]:
    """Text and capture references of a template, in order. References are
    ``$1``, ``$2``, ...; an escaped dollar sign is text."""
    parts: list[str | int] = [""]
    where, opened, i = "text", 0, 0  # text, class, posix or quoted

    def text(n: int) -> None:
        nonlocal i
        parts[-1] += source[i : i + n]  # type: ignore[operator]
        i += n

    while i < len(source):
        c, following = source[i], source[i + 1 : i + 2]
        if where == "quoted":
            if source.startswith("\\E", i):
                where = "text"
                text(2)
            elif c == "$" and re.match(r"[0-9{A-Za-z_]", following):
                raise PatternError(r"no captures between \Q and \E")
            else:
                text(1)
        elif c == "\\":
            if following == "Q":
                where = "quoted"
            text(2)
        elif where == "posix":
            if source.startswith(":]", i):
                where = "class"
                text(2)
            else:
                text(1)
        elif c == "$" and following == "{":
            raise PatternError("a capture is written $1, not ${1}")
        elif c == "$" and re.match(r"[A-Za-z_]", following):
            raise PatternError("a capture has a number, not a name")
        elif c == "$" and re.match(r"[0-9]", following):
            number = re.compile(r"\$([0-9]+)").match(source, i)[1]  # type: ignore[index]
            if where == "class":
                raise PatternError(f"${number} can't stand in brackets")
            if number[0] == "0":
                raise PatternError(f"there is no ${number}: the first capture is $1")
            parts += [int(number), ""]
            i += 1 + len(number)
        elif where == "class":
            if source.startswith("[:", i):
                where = "posix"
                text(2)
            elif c == "]" and i > opened:
                where = "text"
                text(1)
            else:
                text(1)
        elif c == "[":
            where = "class"
            opened = i + (2 if following == "^" else 1)  # a bracket here is text
            text(opened - i)
        else:
            text(1)
    return parts


@dataclass(frozen=True)
class Template:
    """A checked template; ``java`` has Java text and reference numbers."""

    source: str
    java: tuple[str | int, ...]
    highest: int


def compile_template(source: str) -> Template:
    parts = template_parts(source)
    free = (c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in source)
    marks = {n: next(free) for n in dict.fromkeys(p for p in parts if isinstance(p, int))}
    pattern = compile_re2("".join(p if isinstance(p, str) else marks[p] for p in parts))
    numbers = {mark: n for n, mark in marks.items()}
    java: list[str | int] = [""]
    for c in pattern.java:
        if c in numbers:
            java += [numbers[c], ""]
        else:
            java[-1] += c  # type: ignore[operator]
    return Template(source, tuple(java), max(numbers.values(), default=0))


def quote(text: str) -> str:
    """``text`` as a pattern that matches it, for RE2 and Java."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


def expand(source: str, captures: list[str]) -> str:
    """The template with references replaced by their quoted captures;
    ``captures[0]`` is the whole match."""
    out = ""
    for p in template_parts(source):
        if isinstance(p, int):
            if p >= len(captures):
                raise PatternError(f"nothing was captured for ${p}")
            out += f"(?:{quote(captures[p])})"
        else:
            out += p
    return out
