"""Settings of an analysis: defaults, a JSON file over them, checks.

Every setting is one row of SETTINGS: its default, a test and what the test asks for.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Mapping
from types import SimpleNamespace

FILE_NAME = ".ctx.json"


def _count(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


def _number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _texts(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) for v in x)


def _among(*values: str) -> Callable[[object], bool]:
    return lambda x: isinstance(x, str) and x in values


SETTINGS: dict[str, tuple[object, Callable[[object], bool], str]] = {
    "include_patterns": (["**/*"], _texts, "must be a list of texts"),
    "exclude_patterns": ([], _texts, "must be a list of texts"),
    "max_file_size_kb": (500, lambda x: _number(x) and x > 0, "must be > 0"),
    "chunk_max_lines": (150, _number, "must be a number"),
    "chunk_min_lines": (10, _number, "must be a number"),
    "output_dir": (".codeloom", lambda x: isinstance(x, str), "must be a text"),
    "manifest_file": ("manifest.json", lambda x: isinstance(x, str), "must be a text"),
    "generate_agents_md": (True, lambda x: isinstance(x, bool), "must be a boolean"),
    "pagerank_damping": (0.85, lambda x: _number(x) and 0 < x < 1, "must be between 0 and 1"),
    "pagerank_iterations": (20, lambda x: _number(x) and x >= 1, "must be >= 1"),
    "unity_asset_scope": ("project-owned", _among("project-owned", "all"), "must be 'project-owned' or 'all'"),
    "unity_agents_asset_limit": (12, _count, "must be a positive integer"),
    "unity_agents_object_limit": (8, _count, "must be a positive integer"),
    "unity_editor_mode": ("auto", _among("auto", "open", "batch", "offline"), "must be 'auto', 'open', 'batch', or 'offline'"),
    "unity_editor_required": (False, lambda x: isinstance(x, bool), "must be a boolean"),
    "unity_editor_timeout_seconds": (300, _count, "must be a positive integer"),
    "unity_editor_path": (None, lambda x: x is None or isinstance(x, str), "must be a string or null"),
    "language_overrides": ({}, lambda x: isinstance(x, dict), "must be a map"),
}


class Settings(SimpleNamespace):
    """One attribute for each row of SETTINGS."""


def defaults() -> Settings:
    return Settings(**json.loads(json.dumps({k: v[0] for k, v in SETTINGS.items()})))


def merged(base: Settings, over: Mapping[str, object]) -> Settings:
    """base with the values of over; unknown names warn and are left out."""
    for name in over.keys() - SETTINGS.keys():
        warnings.warn(f"unknown setting '{name}'", stacklevel=2)
    return Settings(**{k: over.get(k, getattr(base, k)) for k in SETTINGS})


def load(root: str, path: str | None = None) -> Settings:
    """Defaults under the file of a project, or the file at path; one that can't be read warns and counts as empty."""
    at = path or os.path.join(root, FILE_NAME)
    if not os.path.exists(at):
        return defaults()
    try:
        with open(at, encoding="utf-8") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("no map of settings")
    except (OSError, ValueError) as e:
        warnings.warn(f"{at}: {e}", stacklevel=2)
        return defaults()
    return merged(defaults(), found)


def problems(settings: Settings) -> list[str]:
    """What is wrong with the values; empty if all is well."""
    found = [f"{k} {wish}" for k, (_, good, wish) in SETTINGS.items() if not good(getattr(settings, k))]
    if _number(settings.chunk_max_lines) and _number(settings.chunk_min_lines) and settings.chunk_max_lines < settings.chunk_min_lines:
        found.append("chunk_max_lines must be >= chunk_min_lines")
    return found
