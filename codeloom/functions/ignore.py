"""Ignore rules in the manner of version control: the last rule that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RULES = tuple(
    ("*.swo *.swp *~ .git/ .hg/ .idea/ .mypy_cache/ .next/ .nuxt/ .output/ .pytest_cache/ .ruff_cache/ .svn/ .venv/ .vs/ .vscode/ Build/ Builds/ Cargo.lock Library/ Logs/ MemoryCaptures/ Obj/ Recordings/ Temp/ UserSettings/ "
     "__pycache__/ build/ dist/ node_modules/ out/ package-lock.json pnpm-lock.yaml poetry.lock target/ vendor/ venv/ yarn.lock").split()
)


def parse_rules(lines: list[str]) -> list[str]:
    """Rules of a file: without blank lines and comments."""
    kept = (x.strip() for x in lines)
    return [x for x in kept if x and not x.startswith("#")]


def _glob(pattern: str) -> str:
    """A wildcard pattern as a regular expression; '*' and '?' also cross '/'."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def rule_regex(rule: str) -> tuple[str, bool]:
    """A regular expression for whole relative paths of files, and whether the rule re-includes.

    A trailing '/' names a directory by its literal path from the root or by any
    component: what lies below matches.  '**/x' matches any tail of the path; with
    '**' elsewhere the path begins with what is before it and ends with what follows.
    A rule without '/' matches any component, or the whole path; others match from
    the root, where '*' crosses '/'.
    """
    again = rule.startswith("!")
    body = rule[1:] if again else rule
    if body.endswith("/"):
        return f"^(?:.*/)?{re.escape(body[:-1])}/.*$", again
    body = body.lstrip("./")
    if body.startswith("**/"):
        return f"^(?:.*/)?{_glob(body[3:])}$", again
    if body.count("**") == 1:
        head, tail = body.split("**")
        head, tail = head.rstrip("/"), tail.lstrip("/")
        start = f"(?:{re.escape(head)}|{_glob(head)}(?:/|$))" if head else ""
        return f"^{f'(?={start})' if start else ''}{'.*' + _glob(tail) if tail else '.*'}$", again
    if "/" in body:
        return f"^{_glob(body)}$", again
    inner = _glob(body).replace(".*", "[^/]*")
    return f"^(?:{_glob(body)}|(?:.*/)?{inner}(?:/.*)?)$", again


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule excludes the path."""
    out = F.lit(False)
    for rule in rules:
        pattern, again = rule_regex(rule)
        out = F.when(path.rlike(f"(?s){pattern}"), not again).otherwise(out)
    return out


def not_ignored(df: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    return df.filter(~ignored(F.col(path), rules))
