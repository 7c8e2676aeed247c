"""Ordered text rewrite rules: the first rule whose needle occurs is applied once; done texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_first(text: Column, needle: str, replacement: str) -> Column:
    """Only the first occurrence."""
    at = F.locate(needle, text)
    return F.when(at > 0, F.overlay(text, F.lit(replacement), at, F.lit(len(needle)))).otherwise(text)


def in_gate(path: Column, package: str) -> Column:
    """Modules of the package's distribution folder."""
    return path.contains(package) & path.contains("/dist/")


Rules = list[tuple[str, str, str]]


def rewrite(text: Column, rules: Rules, done: str | None = None) -> Column:
    """rules: (id, needle, replacement) by priority.  Null where `done` is there already, or no rule applies."""
    tried = F.coalesce(*[F.when(text.contains(needle), replace_first(text, needle, new)) for _, needle, new in rules])
    return tried if done is None else F.when(~text.contains(done), tried)


def applied_rule(text: Column, rules: Rules, done: str | None = None) -> Column:
    """The id of the rule that `rewrite` applies."""
    name = F.coalesce(*[F.when(text.contains(needle), F.lit(name)) for name, needle, _ in rules])
    return name if done is None else F.when(~text.contains(done), name)


# What the rewritten bundles hold, and what takes its place.
_STYLE_FILTER = ".filter(h=>/^(Normal|Heading[1-4])$/.test(h.styleId))"
_HEADING3 = '{styleId:"Heading3",name:"Heading 3",nameKey:"styles.heading3",type:"paragraph",priority:5,qFormat:true,fontSize:28,bold:true}'
_HEADING4 = '{styleId:"Heading4",name:"Heading 4",nameKey:"styles.heading4",type:"paragraph",priority:6,qFormat:true,fontSize:24,bold:true}'
_OPTIONS = "resolveParagraphStyleOptions(o);return "
#: The rules of each rewrite, and the text that shows that it was done.
SHAPES: dict[str, tuple[Rules, str | None]] = {
    "popover": ([("1.6.x-mode", "left:f.right-220", "left:f.left")], None),
    "styles": (
        [
            ("1.6.x", _OPTIONS + "u.length===0?Co:u.map(", f"{_OPTIONS}Co{_STYLE_FILTER};0&&u.map("),
            ("1.2.x", '!o||o.length===0?vo:o.filter(u=>u.type==="paragraph")', f"vo{_STYLE_FILTER}"),
        ],
        _STYLE_FILTER,
    ),
    "heading4": ([("tail", _HEADING3 + "]", f"{_HEADING3},{_HEADING4}]")], "styles.heading4"),
}


def picked_styles(styles: Column, pattern: str = "^(Normal|Heading[1-4])$") -> Column:
    """The entries of a style list whose styleId matches."""
    return F.filter(styles, lambda s: s["styleId"].rlike(pattern))
