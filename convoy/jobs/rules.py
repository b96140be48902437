"""The rule set that the registered jobs use; real fleets bring their own."""

from __future__ import annotations

from convoy.functions.rules import PathRule, Rules

FLEET_RULES: Rules = (
    PathRule("always_local", "prefix", "docs/specs/"),
    PathRule("always_local", "regex", r"/own-[a-z]+/"),
    PathRule("managed", "prefix", ".github/"),
    PathRule("private", "regex", r"/(tests|fixtures)/"),
    PathRule("yield", "prefix", ".github/agents/"),
)
