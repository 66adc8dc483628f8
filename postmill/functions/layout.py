"""Folding a stream of layout events into lines of Markdown.

Elements are described by events: ("gap", n), ("text", words, marker), ("space", firm),
("break",), ("lines", lines) and ("rule",). A gap of 1 is a new line, of 2 a blank one;
gaps that meet become the larger. What an element asks for does not depend on what
stands around it, so the events of its parts can be joined as lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

Event = tuple
BREAK, RULE = ("break",), ("rule",)


def gap(size: int) -> Event:
    return ("gap", size)


def text(words: str, marker: str | None = None) -> Event:
    return ("text", words, marker)


def space(firm: bool = False) -> Event:
    """A space between words; a firm one also holds an empty line open."""
    return ("space", firm)


def lines(block: Iterable[str]) -> list[Event]:
    """Lines that are formatted already, apart from what stands around them."""
    block = list(block)
    return [gap(2), ("lines", block), gap(2)] if block else [gap(2), gap(2)]


@dataclass(frozen=True)
class Piece:
    """Laid-out events: lines (the last is the one it ended on), and what its edges ask for."""

    lines: list[str]
    gap_before: int = 0
    gap_after: int = 0
    space_before: bool = False
    space_after: bool = False
    firm_end: bool = False

    @property
    def trimmed(self) -> list[str]:
        filled = [k for k, line in enumerate(self.lines) if line]
        return self.lines[filled[0] : filled[-1] + 1] if filled else []

    @property
    def flat(self) -> str:
        return " ".join(line for line in self.lines if line)

    @property
    def single(self) -> Piece:
        """On one line, but for a line break at either end."""
        flat, many = self.flat, len(self.lines) > 1
        head = [""] if many and not self.lines[0] else []
        tail = [""] if many and not self.lines[-1] else []
        return replace(self, lines=head + ([flat] if flat else []) + tail, firm_end=self.firm_end and not flat)

    def events(self, write: Callable[[str], Event]) -> list[Event]:
        """The events that lay the piece out again, each line of text as write says."""
        before = [gap(self.gap_before)] if self.gap_before else [space()] * self.space_before
        inside = []
        for k, line in enumerate(self.lines):
            inside += [BREAK] * (k > 0) + ([write(line)] if line else [])
        after = [gap(self.gap_after)] if self.gap_after else [space()] * self.space_after
        return before + inside + [space(True)] * self.firm_end + after


class _Sheet:
    def __init__(self, escape: bool):
        self.escape = escape
        self.done: list[str] = []
        self.line, self.filled = "", False
        self.started = self.broken = False
        self.marker: str | None = None
        self.gap = self.first_gap = 0
        self.first_space = False

    def finished(self) -> str:
        line = self.line.strip(" ")
        return "\\" + line if self.escape and line.startswith(("```", "~~~")) else line

    def end_line(self) -> None:
        line = self.finished()
        if line or not (self.done and not self.done[-1]):
            self.done.append(line)
        self.line, self.filled = "", False

    def settle(self) -> None:
        size, self.gap = self.gap, 0
        if self.started and size:
            if self.filled:
                self.end_line()
            if size == 2 and self.done and self.done[-1]:
                self.done.append("")

    def touch(self, broken: bool = False) -> None:
        self.started, self.broken = True, broken

    def take(self, event: Event) -> None:
        kind = event[0]
        if kind == "gap":
            if not self.started:
                self.first_gap = max(self.first_gap, event[1])
            self.gap = max(self.gap, event[1])
        elif kind == "space":
            self.first_space |= not self.started
            if not self.gap and self.line:
                self.line = self.line.removesuffix(" ") + " "
            elif event[1]:
                self.settle()
                self.filled = True
                self.touch()
        elif kind == "text":
            self.write(event[1], event[2])
        elif kind == "break":
            self.settle()
            self.end_line()
            self.touch(broken=True)
        else:
            self.settle()
            if self.filled:
                self.end_line()
            if kind == "lines":
                self.done += event[1]
            elif next((x for x in reversed(self.done) if x), "") == "---":
                return  # two cards share the rule between them
            else:
                self.done.append("---")
            self.touch()

    def write(self, words: str, marker: str | None) -> None:
        self.settle()
        if marker:
            if self.marker == marker and self.line.endswith(marker):  # emphasis goes on
                self.line = self.line.removesuffix(marker)
                words += marker
            else:
                words = marker + words + marker
        if not self.line or self.line.endswith(" "):
            bare = words.lstrip(" ")
            self.first_space |= not self.started and bare != words
            words = bare
        if words:
            self.line += words
            self.filled, self.marker = True, marker
            self.touch()


def compose(events: Iterable[Event], escape: bool = True) -> Piece:
    """The piece that events make; escape: a line that would open a code fence gets a backslash."""
    sheet = _Sheet(escape)
    for event in events:
        sheet.take(event)
    ends = [sheet.finished()] if sheet.filled or sheet.broken else []
    return Piece(sheet.done + ends, sheet.first_gap, sheet.gap, sheet.first_space, not sheet.gap and sheet.line.endswith(" "), sheet.filled and not sheet.line.strip(" "))


def formatted(events: Iterable[Event]) -> bool:
    """Whether a block has formatted lines of its own among the events."""
    return any(e[0] in ("lines", "rule") for e in events)


def opens_with_text(events: Iterable[Event]) -> bool:
    return next((e[0] == "text" for e in events if e[0] in ("text", "lines", "rule")), False)
