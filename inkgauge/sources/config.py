"""The configuration file: which rules run, how severe they are, and which paths are read."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexicons import EXPRESSIONS
from .tables import glob_pattern, path_matches

NAME, SECTION = ".inkgauge.toml", "inkgauge"
#: The modules with the number of their rules, the severities, and the keys of the section.
MODULES = {"deadweight": ("DEAD", 18), "vibecheck": ("VIBE", 35), "papertrail": ("TRAIL", 2)}
SEVERITIES = {"info": "info", "warn": "warning", "warning": "warning", "error": "error"}
KEYS = frozenset(("fail-level", "max-file-size", "rules", "ignore", "files", *MODULES))
RULES = tuple(f"{prefix}{i:03d}" for prefix, n in MODULES.values() for i in range(1, n + 1))
assert set(EXPRESSIONS) <= set(RULES)


class ConfigError(ValueError):
    """A configuration that says what it can't mean."""


@dataclass(frozen=True)
class Config:
    fail_level: str = "warning"
    max_file_size: int = 1_000_000
    off: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def reads(self, path: Column) -> Column:
        return path_matches(path, list(self.include), list(self.exclude))


def _only(section: dict, keys: frozenset, where: str) -> dict:
    if unknown := sorted(set(section) - keys):
        raise ConfigError(f"unknown key in {where}: {unknown[0]}")
    return section


def _globs(section: dict, key: str) -> tuple[str, ...]:
    out = tuple(section.get(key, ()))
    for g in out:
        if not isinstance(g, str) or not g.strip("/!"):
            raise ConfigError(f"not a path pattern: {g!r}")
        glob_pattern(g.lstrip("!"))
    return out


def parse(text: str) -> Config:
    """A configuration from its text; unknown keys and rules, bad severities, and a file that leaves no rule, are errors."""
    try:
        section = _only(tomllib.loads(text), frozenset((SECTION,)), "the file").get(SECTION, {})
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _only(section, KEYS, SECTION)
    overrides: dict[str, str] = {}
    off = {r for m, (prefix, _) in MODULES.items() if not _only(section.get(m, {}), frozenset(("enabled",)), m).get("enabled", True) for r in RULES if r.startswith(prefix)}
    for rule, value in section.get("rules", {}).items():
        if rule not in RULES:
            raise ConfigError(f"no such rule: {rule}")
        if value == "off":
            off.add(rule)
        elif value in SEVERITIES:
            overrides[rule] = SEVERITIES[value]
        else:
            raise ConfigError(f"{rule}: no such severity: {value}")
    if off == set(RULES):
        raise ConfigError("every rule is off")
    level, size = section.get("fail-level", "warning"), section.get("max-file-size", 1_000_000)
    if level not in SEVERITIES or not isinstance(size, int) or size < 1:
        raise ConfigError(f"bad fail-level or max-file-size: {level}, {size}")
    files = _only(section.get("files", {}), frozenset(("include", "exclude")), "files")
    ignored = _only(section.get("ignore", {}), frozenset(("paths",)), "ignore")
    return Config(SEVERITIES[level], size, tuple(sorted(off)), overrides, _globs(files, "include"), _globs(files, "exclude") + _globs(ignored, "paths"))


def find(start: str) -> Config:
    """The configuration nearest to a folder, from it upwards; the usual one if there is none."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, NAME)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return parse(f.read())
        if folder == os.path.dirname(folder):
            return Config()
        folder = os.path.dirname(folder)
