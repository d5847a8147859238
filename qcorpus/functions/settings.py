"""A small reader of settings in YAML's common forms: nested maps and lists, quoted and plain values, inline lists and maps, text blocks.

Anchors, tags, several documents and keys that are not plain text are errors, not guesses.
"""

from __future__ import annotations

import json
import re

Value = dict | list | str | int | float | bool | None
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{}&*!|>%@`"'#,][^#:]*?)\s*:(?:\s+|$)(.*)$""")
#: Plain words that are no text.
_WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


class SettingsError(ValueError):
    pass


def _scalar(text: str) -> Value:
    text = text.strip()
    if text.startswith('"'):
        try:
            return json.loads(text)
        except ValueError:
            raise SettingsError(f"not a quoted text: {text}") from None
    if text.startswith("'"):
        if not re.fullmatch(r"'(?:[^']|'')*'", text):
            raise SettingsError(f"not a quoted text: {text}")
        return text[1:-1].replace("''", "'")
    if text[:1] in "&*!%@`":
        if text:
            raise SettingsError(f"not read: {text}")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def _inline(text: str) -> Value:
    """A value on one line."""
    text = text.strip()
    if text[:1] not in "[{" or not text:
        return _scalar(text)
    closing = "]" if text[0] == "[" else "}"
    if text[-1] != closing:
        raise SettingsError(f"not closed: {text}")
    parts, depth, quote, start = [], 0, "", 1
    for i in range(1, len(text) - 1):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:-1])
    parts = [p for p in parts if p.strip()]
    if closing == "]":
        return [_inline(p) for p in parts]
    found = {}
    for p in parts:
        pair = _KEY.match(p.strip())
        if not pair:
            raise SettingsError(f"no key: {p}")
        found[str(_scalar(pair[1]))] = _inline(pair[2])
    return found


def _bare(line: str) -> str:
    """A line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " :,[{-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


class _Lines:
    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.raw):
            line = _bare(self.raw[self.at])
            if line.strip():
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise SettingsError("a tab indents a line")
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    def block(self, indent: int, folded: bool) -> str:
        """The text below, with line breaks or folded."""
        own: list[str] = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip()) > indent):
            own.append(self.raw[self.at])
            self.at += 1
        depth = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
        lines = [x[depth:].rstrip() for x in own]
        while lines and not lines[-1]:
            lines.pop()
        return " ".join(lines) if folded else "\n".join(lines) + "\n"


def _value(rest: str, indent: int, lines: _Lines) -> Value:
    """What a key or dash has: on its line, or below it."""
    if rest in ("|", ">", "|-", ">-"):
        text = lines.block(indent, rest[0] == ">")
        return text.rstrip("\n") if rest.endswith("-") or rest[0] == ">" else text
    if rest:
        return _inline(rest)
    below = lines.peek()
    if below and (below[0] > indent or below[0] == indent and below[1].startswith("- ")):
        return _node(below[0], lines)
    return None


def _node(indent: int, lines: _Lines) -> Value:
    first = lines.peek()
    if first[1] == "-" or first[1].startswith("- "):
        found: list = []
        while (now := lines.peek()) and now[0] == indent and (now[1] == "-" or now[1].startswith("- ")):
            rest = now[1][1:].strip()
            if rest and _KEY.match(rest) and rest[0] not in "[{\"'":
                # a map that begins behind the dash: its keys stand as deep as the first
                depth = indent + len(now[1]) - len(rest)
                lines.raw[lines.at] = " " * depth + rest
                found.append(_node(depth, lines))
            else:
                lines.at += 1
                found.append(_value(rest, indent, lines))
        return found
    pairs: dict = {}
    while (now := lines.peek()) and now[0] == indent:
        pair = _KEY.match(now[1])
        if not pair:
            raise SettingsError(f"no key: {now[1]}")
        key = str(_scalar(pair[1]))
        if key in pairs:
            raise SettingsError(f"a key is repeated: {key}")
        lines.at += 1
        pairs[key] = _value(pair[2].strip(), indent, lines)
    return pairs


def read_settings(text: str) -> Value:
    """The settings of a text; an empty one is None."""
    lines = _Lines(text.replace("\r\n", "\n"))
    first = lines.peek()
    if first is None:
        return None
    if not (first[1].startswith("- ") or first[1] == "-" or _KEY.match(first[1])):
        lines.at = len(lines.raw)
        return _inline(first[1])
    found = _node(first[0], lines)
    if left := lines.peek():
        raise SettingsError(f"not indented as what stands above: {left[1]}")
    return found
