"""Tagged columns and the patterns that select them. All of this runs on the driver, before Spark sees a plan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from ..errors import PatternError

#: Fixed value: a tag or attribute.
TOKEN = r"[A-Za-z][_0-9A-Za-z]*"
_PATTERN = re.compile(rf"\s*#?(?P<tag>\*|{TOKEN})(?P<attrs>(?:\s*[+-]\s*{TOKEN})*)\s*(?P<only>!?)\s*")
_SPEC = re.compile(rf"(?P<header>.*?)#\s*(?P<tag>{TOKEN})(?P<attrs>(?:\s*\+\s*{TOKEN})*)\s*", re.DOTALL)
_SIGNED = re.compile(rf"([+-])\s*({TOKEN})")


@dataclass(frozen=True)
class TagColumn:
    """A column's tag, attributes in their written order, free-text header and place in the source. tag None: untagged."""

    tag: str | None = None
    attributes: tuple[str, ...] = ()
    header: str | None = None
    source: int | None = None

    @staticmethod
    def parse(spec: str, header: str | None = None, source: int | None = None) -> TagColumn:
        """Read "Header text#tag+attr"; a header given apart wins over an empty one in the spec."""
        m = _SPEC.fullmatch(str(spec).strip())
        if not m:
            raise PatternError(f"not a column spec: {spec!r}")
        attrs = tuple(dict.fromkeys(a.lower() for _, a in _SIGNED.findall(m["attrs"])))
        return TagColumn("#" + m["tag"].lower(), attrs, m["header"].strip() or header, source)

    @staticmethod
    def hashtag(cell: object) -> TagColumn | None:
        """The column that a cell of a hashtag row declares; None if it declares none."""
        m = _SPEC.fullmatch(str("" if cell is None else cell).strip())
        return TagColumn.parse(str(cell)) if m and not m["header"].strip() else None

    @property
    def key(self) -> tuple[str | None, frozenset[str]]:
        """What makes two columns the same: tag and set of attributes."""
        return self.tag, frozenset(self.attributes)

    @property
    def display_tag(self) -> str:
        return "" if self.tag is None else "+".join((self.tag, *self.attributes))

    @property
    def sorted_tag(self) -> str:
        return "" if self.tag is None else "+".join((self.tag, *sorted(self.attributes)))

    def adding(self, attribute: str) -> TagColumn:
        return self if attribute in self.attributes else replace(self, attributes=(*self.attributes, attribute))

    def without(self, attribute: str) -> TagColumn:
        return replace(self, attributes=tuple(a for a in self.attributes if a != attribute))


@dataclass(frozen=True)
class TagPattern:
    """Selects columns: "#tag+with-without", "#*" for any tag, a final "!" for no attributes beyond those named."""

    tag: str | None
    include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    absolute: bool = False

    @staticmethod
    def parse(pattern: str | TagPattern) -> TagPattern:
        if isinstance(pattern, TagPattern):
            return pattern
        m = _PATTERN.fullmatch(str(pattern))
        if not m:
            raise PatternError(f"not a tag pattern: {pattern!r}")
        signed = [(s, a.lower()) for s, a in _SIGNED.findall(m["attrs"])]
        include, exclude = (frozenset(a for s, a in signed if s == sign) for sign in "+-")
        if m["only"] and exclude:
            raise PatternError(f"a pattern that ends in ! cannot exclude attributes: {pattern!r}")
        return TagPattern(None if m["tag"] == "*" else "#" + m["tag"].lower(), include, exclude, bool(m["only"]))

    @staticmethod
    def parse_list(patterns: str | TagPattern | Iterable[str | TagPattern] | None) -> tuple[TagPattern, ...]:
        if patterns is None or patterns == "":
            return ()
        if isinstance(patterns, TagPattern):
            return (patterns,)
        if isinstance(patterns, str):
            patterns = patterns.split(",")
        return tuple(TagPattern.parse(p) for p in patterns)

    def matches(self, column: TagColumn) -> bool:
        own = set(column.attributes)
        return (
            column.tag is not None
            and self.tag in (None, column.tag)
            and self.include <= own
            and not (self.exclude & own)
            and (not self.absolute or own <= self.include)
        )

    def find(self, columns: Sequence[TagColumn]) -> list[int]:
        """Places of the matching columns, in source order."""
        return [i for i, c in enumerate(columns) if self.matches(c)]

    def first(self, columns: Sequence[TagColumn]) -> int | None:
        return next(iter(self.find(columns)), None)

    def __str__(self) -> str:
        return (self.tag or "#*") + "".join(f"+{a}" for a in sorted(self.include)) + "".join(f"-{a}" for a in sorted(self.exclude)) + "!" * self.absolute


def find_any(patterns: Iterable[TagPattern], columns: Sequence[TagColumn]) -> list[int]:
    """Places of the columns that one of the patterns matches, in source order."""
    patterns = tuple(patterns)
    return [i for i, c in enumerate(columns) if any(p.matches(c) for p in patterns)]


def tags_of(cells: Sequence[object], headers: Sequence[object] | None = None) -> list[TagColumn] | None:
    """Columns that a raw row declares if it is a hashtag row: half of its cells that are not blank, or more, are hashtags."""
    found, filled = [], 0
    for i, cell in enumerate(cells):
        filled += str("" if cell is None else cell).strip() != ""
        header = None if headers is None or i >= len(headers) or headers[i] is None else str(headers[i]).strip()
        column = TagColumn.hashtag(cell) or TagColumn()
        found.append(replace(column, header=header or None, source=i))
    tagged = sum(c.tag is not None for c in found)
    return found if tagged and tagged * 2 >= filled else None
