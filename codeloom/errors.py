"""Errors: what can be raised, and the table of those that only cost a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: path, error_type (permission, encoding, parse, resolution), message, line, recoverable
ERROR_FIELDS = "path string, error_type string, message string, line int, recoverable boolean"
#: category (config, pattern, deprecated, performance), message, file, suggestion
WARNING_FIELDS = "category string, message string, file string, suggestion string"


class LoomError(Exception):
    """Any error of this engine."""


class SettingsError(LoomError):
    """Settings that can't be used."""


class ManifestError(LoomError):
    """A stored analysis that can't be used."""


class PrimitiveError(LoomError):
    """A question that has no answer, as of a path that isn't there."""


class ParseError(LoomError):
    def __init__(self, message: str, path: str | None = None, line: int | None = None):
        super().__init__(message)
        self.path, self.line = path, line


class ResolutionError(LoomError):
    def __init__(self, message: str, source_path: str, target: str):
        super().__init__(message)
        self.source_path, self.target = source_path, target


def by_type(errors: DataFrame) -> DataFrame:
    """error_type, errors, critical: how many files each kind of error cost."""
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"), F.count_if(~F.coalesce("recoverable", F.lit(True))).alias("critical"))


def exit_code(errors: DataFrame) -> int:
    """0 without errors, 1 with some, 2 where one of them can't be recovered from."""
    row = errors.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("recoverable", F.lit(True))).alias("critical")).first()
    return 2 if row.critical else 1 if row.n else 0


def summary(errors: DataFrame, warnings: DataFrame | None = None) -> str:
    kinds = [f"{r.errors} {r.error_type}" for r in by_type(errors).orderBy("error_type").collect()]
    n = warnings.count() if warnings is not None else 0
    return "; ".join(filter(None, ["Errors: " + ", ".join(kinds) if kinds else "", f"Warnings: {n}" if n else ""])) or "No errors or warnings"


def report(errors: DataFrame, warnings: DataFrame | None = None, verbose: bool = False) -> str:
    """Errors by type and warnings, three and five of them unless verbose; only what is shown is fetched."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("error_type").orderBy("path", F.coalesce("line", F.lit(0)), "message"))
    shown = errors.withColumn("place", place)
    rows = (shown if verbose else shown.filter("place <= 3")).orderBy("error_type", "place").collect()
    counts = {r.error_type: r.errors for r in by_type(errors).collect()}
    lines = [f"⚠️  {sum(counts.values())} file(s) had errors:", ""] if counts else []
    for kind in sorted(counts):
        own = [r for r in rows if r.error_type == kind]
        lines.append(f"  {kind.upper()} ({counts[kind]}):")
        lines += [f"    - {r.path}{f':{r.line}' if r.line else ''}: {r.message}" for r in own]
        lines += [f"    ... and {counts[kind] - len(own)} more"] * (len(own) < counts[kind]) + [""]
    n = warnings.count() if warnings is not None else 0
    if n:
        own = (warnings if verbose else warnings.limit(5)).collect()
        lines += [f"📝 {n} warning(s):", ""]
        for r in own:
            lines.append(f"  {f'{r.file}: ' if r.file else ''}[{r.category}] {r.message}")
            lines += [f"    → {r.suggestion}"] * bool(r.suggestion)
        lines += [f"  ... and {n - len(own)} more"] * (len(own) < n)
    return "\n".join(lines)
