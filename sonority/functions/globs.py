"""Constraint globs: text form, meaning as sets of segments, and lowering to patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sonority.functions.classes import label, members
from sonority.functions.features import FeatureTable
from sonority.functions.segments import FIRST

# What reads and what is shown as a repetition, and what reads as a feature's state.
READS = {"": "", "+": "+", "₁": "+", "*": "*", "₀": "*"}
SHOWS = {"": "", "+": "₁", "*": "₀"}
STATES = {"+": "+", "✓": "+", "√": "+", "-": "-", "−": "-", "0": "0"}

_CLASS = re.compile(r"\[\s*([¬^]?)([^\[\]]*)\]")
_NAME = re.compile(r"[^\s\d+\-−✓√\[\]¬^][^\s\[\]]*")


@dataclass(frozen=True)
class Part:
    repeat: str
    inverted: bool
    literals: tuple[tuple[str, str], ...]

    def __str__(self) -> str:
        if (self.repeat, self.inverted, self.literals) == ("*", False, ()):
            return "…"
        short = {(("+", "syllabic"),): "V", (("-", "syllabic"),): "C"}.get(self.literals)
        return (short if short and not self.inverted else label(self.inverted, self.literals)) + SHOWS[self.repeat]


@dataclass(frozen=True)
class Glob:
    """A sequence of classes, which may be tied to the start or end of a word."""

    initial: bool
    final: bool
    parts: tuple[Part, ...]

    def __str__(self) -> str:
        return "#" * self.initial + "".join(map(str, self.parts)) + "#" * self.final

    def sets(self, table: FeatureTable) -> list[tuple[str, int]]:
        """Repetition and bits of each part; unknown features don't count."""
        return [(p.repeat, members(table, p.inverted, list(p.literals))) for p in self.parts]


def parse_class(text: str) -> tuple[bool, tuple[tuple[str, str], ...]]:
    """A class in brackets. Features stand apart by blanks; a feature without a state has plus."""
    m = _CLASS.fullmatch(text.strip())
    if not m:
        raise ValueError(f"no class: {text!r}")
    literals = []
    for word in m[2].split():
        state, name = (STATES[word[0]], word[1:]) if word[0] in STATES else ("+", word)
        if not _NAME.fullmatch(name):
            raise ValueError(f"no feature: {word!r}")
        literals.append((state, name))
    return bool(m[1]), tuple(literals)


def parse_glob(text: str) -> Glob:
    """A glob: ``#`` at its ends, classes, ``V`` and ``C``, an ellipsis for anything, and repetitions after a part."""
    rest, parts = text.strip(), []
    initial, rest = rest.startswith("#"), rest.removeprefix("#")
    while rest and rest != "#":
        if rest[0] == "…":
            parts.append(Part("*", False, ()))
            rest = rest[1:]
            continue
        if rest[0] in "VC":
            inverted, literals, size = False, (("+" if rest[0] == "V" else "-", "syllabic"),), 1
        else:
            m = _CLASS.match(rest)
            if not m:
                raise ValueError(f"no glob: {text!r}")
            (inverted, literals), size = parse_class(m[0]), m.end()
        sign = rest[size : size + 1]
        sign = sign if sign in READS else ""
        parts.append(Part(READS[sign], inverted, literals))
        rest = rest[size + len(sign) :]
    if not parts:
        raise ValueError(f"no part: {text!r}")
    return Glob(initial, rest == "#", tuple(parts))


def char(seg_id: int) -> str:
    return chr(FIRST + seg_id)


def charset(mask: int) -> str:
    """A bracket of the encoded segments of a set; an empty set never matches."""
    return "[" + "".join(char(i + 1) for i in range(mask.bit_length()) if mask >> i & 1) + "]" if mask else "[^\\x{0}-\\x{10FFFF}]"


def body(sets: list[tuple[str, int]]) -> str:
    """The parts as a pattern."""
    return "".join(charset(mask) + rep for rep, mask in sets)


def counting_pattern(initial: bool, final: bool, sets: list[tuple[str, int]]) -> str:
    """A Java pattern that matches, as an empty string, once at each place where some match of the glob ends.

    Only for globs without repetitions, for a look-behind must have a bound.
    """
    return "(?<=" + "^" * initial + body(sets) + ")" + "\\z" * final
