"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import cobucket, exact_dedup, license, linededup, mixing, packing, pii, rules, simhash, spelling, suffix, toxicity, webpage

_MODULES = [toxicity, pii, rules, packing, suffix, license, exact_dedup, mixing, linededup, simhash, cobucket, webpage, spelling]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
