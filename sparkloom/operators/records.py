"""Conformance of records, rights, eligibility and ledger totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rules: dict[str, Column]) -> Column:
    """The messages of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(holds, message) for message, holds in rules.items()]))


def decide_rights(register: dict[str, dict], use: str) -> dict[str, tuple[bool, str]]:
    """source -> (allowed, reason) for a use: denied unless the register clears the source and, if it has parts, all of them."""

    def one(source: str, seen: frozenset[str] = frozenset()) -> tuple[bool, str]:
        entry = register.get(source)
        if entry is None:
            return False, "unknown_source"
        if source in seen:
            return False, "circular_components"
        status = entry.get("uses", {}).get(use) or entry.get("status") or "needs_review"
        if status != "cleared":
            return False, status
        for part in entry.get("components", ()):
            allowed, _ = one(part, seen | {source})
            if not allowed:
                return False, "component_not_cleared"
        return True, "cleared"

    return {source: one(source) for source in register}


def with_rights(records: DataFrame, source: str, decisions: dict[str, tuple[bool, str]]) -> DataFrame:
    """Records with ``allowed`` and ``reason``; the register is configuration, its decisions a map literal."""
    table = F.create_map(*[x for s, (ok, why) in sorted(decisions.items()) for x in (F.lit(s), F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("why")))])
    d = F.try_element_at(table, F.col(source))
    return records.withColumns({"allowed": F.coalesce(d["ok"], F.lit(False)), "reason": F.coalesce(d["why"], F.lit("unknown_source"))})


#: Which status may follow which.
TRANSITIONS = {"draft": ("submitted",), "submitted": ("verified", "rejected"), "verified": ("withdrawn", "expired"), "rejected": ("draft",)}


def can_follow(current: Column, new: Column) -> Column:
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, current), new), F.lit(False))
