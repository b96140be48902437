"""Path ownership rules, compiled into one expression per question: no join, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PathRule:
    """rule_class: always_local, merge, managed, private, yield or meta. kind: exact, prefix or regex; letters' case is ignored."""

    rule_class: str
    kind: str
    pattern: str


Rules = tuple[PathRule, ...]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _plain(path: Column) -> Column:
    """Lower case, forward slashes, one leading `./` dropped; null is empty. Short, since it stands in every condition."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), r"^\./", ""))


#: Files in a consumer's own directories that come from upstream all the same.
_SPARED = r"(\.template|(^|/)\.gitkeep)$"


def matches(path: Column, rules: Rules, rule_class: str) -> Column:
    """Whether a rule of the class fits; an empty path fits none.

    A consumer's own directories spare templates and keep-files; its exact paths don't.
    """
    low = _plain(path)
    own = [r for r in rules if r.rule_class == rule_class]
    exact = [r.pattern.lower() for r in own if r.kind == "exact"]
    wide = [low.startswith(r.pattern.lower()) for r in own if r.kind == "prefix"] + [low.rlike(f"(?i){r.pattern}") for r in own if r.kind == "regex"]
    if not exact and not wide:
        return F.lit(False)
    within = _any(wide)
    if rule_class == "always_local" and wide:
        within = within & ~low.rlike(_SPARED)
    return (low != "") & (low.isin(exact) | within if exact else within)


def owner_class(path: Column, rules: Rules) -> Column:
    """always_local before merge before managed; else other."""
    return (
        F.when(matches(path, rules, "always_local"), "always_local")
        .when(matches(path, rules, "merge"), "merge")
        .when(matches(path, rules, "managed"), "managed")
        .otherwise("other")
    )


def is_private(path: Column, rules: Rules) -> Column:
    """Private to the upstream; a consumer's own paths never are."""
    return ~matches(path, rules, "always_local") & matches(path, rules, "private")


def is_delivered(path: Column, rules: Rules) -> Column:
    """Managed, and not private."""
    return matches(path, rules, "managed") & ~matches(path, rules, "always_local") & ~matches(path, rules, "merge") & ~matches(path, rules, "private")
