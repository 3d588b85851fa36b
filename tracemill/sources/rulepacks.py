"""Rule packs and code references: small dimensions read from TOML on the driver.

A file holds one pack as a `[meta]` table and `[[pattern]]` entries, bundled or a user's.  A file or rule
that does not parse is skipped with a warning, never fatal.
"""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.patterns import is_safe
from ..schemas import CODE_REF_DIM, PARSER_DIM, RULE_DIM

BUNDLED = Path(__file__).resolve().parent.parent / "rules"


@dataclass(frozen=True)
class Rule:
    name: str
    event_type: str
    severity: str
    regex: str
    fields: dict = field(default_factory=dict)
    state_condition: str | None = None
    state_transition: str | None = None
    deprecated: bool = False
    replaced_by: str | None = None

    @property
    def active(self) -> bool:
        return not (self.deprecated and self.replaced_by)


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...] = ()
    detect: tuple[str, ...] = ()
    detect_full: tuple[str, ...] = ()
    stateful: bool = False
    route: str = "structured"
    priority: int = 50
    min_version: str | None = None
    max_version: str | None = None
    source: str = "builtin"

    @property
    def active_rules(self) -> list[Rule]:
        return [r for r in self.rules if r.active]


def _keep_safe(pack: str, rules) -> tuple[Rule, ...]:
    kept = []
    for rule in rules:
        if is_safe(rule.regex):
            kept.append(rule)
        else:
            warnings.warn(f"pack {pack}: rule {rule.name} has an unusable regex, skipped")
    return tuple(kept)


def _pack(path: Path, source: str) -> Pack:
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    meta = raw.get("meta", {})
    rules = [
        Rule(
            p.get("name", ""), p.get("event_type", ""), p.get("severity", ""), p.get("regex", ""),
            p.get("fields", {}), p.get("state_condition"), p.get("state_transition"),
            p.get("deprecated", False), p.get("replaced_by"),
        )
        for p in raw.get("pattern", [])
    ]
    name = meta.get("name", "")
    return Pack(
        name, _keep_safe(name, rules), tuple(meta.get("detect") or ([path.stem] if source == "user" else ())),
        tuple(meta.get("detect_full", ())), meta.get("parser_type") == "stateful",
        meta.get("route", "structured"), meta.get("priority", 0 if meta else 50),
        meta.get("min_version"), meta.get("max_version"), source,
    )


def load_packs(dirs=()) -> list[Pack]:
    """Bundled packs plus every readable `.toml` of the user directories, unresolved."""
    packs = [_pack(path, "builtin") for path in sorted((BUNDLED / "packs").glob("*.toml"))]
    for directory in dirs:
        for path in sorted(Path(directory).expanduser().glob("*.toml")):
            try:
                packs.append(_pack(path, "user"))
            except (tomllib.TOMLDecodeError, UnicodeDecodeError, OSError) as error:
                warnings.warn(f"{path}: skipped ({error})")
    return packs


def resolve_packs(packs: list[Pack]) -> list[Pack]:
    """One pack per name: the highest priority wins, a user pack wins a tie."""
    ranked = sorted(packs, key=lambda p: (-p.priority, p.source != "user"))
    best: dict[str, Pack] = {}
    for pack in ranked:
        best.setdefault(pack.name, pack)
    return list(best.values())


def to_dimensions(spark: SparkSession, packs: list[Pack]) -> tuple[DataFrame, DataFrame]:
    """(parsers, rules) DataFrames of a few hundred rows at most."""
    parsers = [
        (p.name, list(p.detect), list(p.detect_full), "stateful" if p.stateful else "toml",
         p.route, p.priority, p.min_version, p.max_version, p.source)
        for p in packs
    ]
    rules = [
        (p.name, i, r.name, r.regex, r.event_type, r.severity, r.fields, r.state_condition,
         r.state_transition, r.deprecated, r.replaced_by)
        for p in packs
        for i, r in enumerate(p.rules)
    ]
    return spark.createDataFrame(parsers, PARSER_DIM), spark.createDataFrame(rules, RULE_DIM)


def load_rules(spark: SparkSession, dirs=()) -> tuple[DataFrame, DataFrame]:
    return to_dimensions(spark, load_packs(dirs))


def load_code_refs(spark: SparkSession, dirs=()) -> DataFrame:
    """Code references; a user table replaces the bundled table of the same tool."""
    bundled = tomllib.loads((BUNDLED / "code_refs.toml").read_text(encoding="utf-8"))
    tables = {
        tool: [(tool, code, message, raw["source"]) for code, message in raw["refs"]]
        for tool, raw in bundled.items()
    }
    for directory in dirs:
        for path in sorted(Path(directory).expanduser().glob("*.toml")):
            try:
                raw = tomllib.loads(path.read_text(encoding="utf-8"))
                tool = raw["meta"]["name"]
                tables[tool] = [
                    (tool, str(e["code"]), e["message"], e.get("source")) for e in raw["entry"]
                ]
            except (tomllib.TOMLDecodeError, KeyError, OSError) as error:
                warnings.warn(f"{path}: skipped ({error})")
    return spark.createDataFrame([r for rows in tables.values() for r in rows], CODE_REF_DIM)
