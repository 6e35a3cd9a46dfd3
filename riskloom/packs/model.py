"""Shape of a declarative rule."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    weight: int
    confidence: str
    cwe_id: str | None
    patterns: tuple[str, ...]
    excludes: tuple[str, ...] = ()
    file_types: tuple[str, ...] = ()
    hard_trigger: bool = False
    suppressed_by: tuple[str, ...] = ()

    @property
    def content_patterns(self) -> tuple[str, ...]:
        """Patterns that name a line break: evaluated once over the whole text."""
        return tuple(p for p in self.patterns if "\\n" in p or "\\r" in p)

    @property
    def line_patterns(self) -> tuple[str, ...]:
        return tuple(p for p in self.patterns if p not in self.content_patterns)

    @property
    def description(self) -> str:
        return f"{self.rule_id.replace('_', ' ').lower()} ({self.category})"
