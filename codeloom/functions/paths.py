"""Path expressions with '/' as the separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """'' for a path without a directory."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, lower case; a dot that leads the name begins none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    """The path without its last suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path, '' (the root) first."""
    p = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def shorten(path: Column, most: int = 30) -> Column:
    """A long path of three parts or more by its last two after '.../', or by its name alone where even those are long."""
    p = F.split(path, "/")
    two = F.array_join(F.slice(p, -2, 2), "/")
    return F.when((F.length(path) <= most) | (F.size(p) <= 2), path).when(F.length(two) <= most - 4, F.concat(F.lit(".../"), two)).otherwise(F.concat(F.lit(".../"), basename(path)))


def node_id(path: Column) -> Column:
    """An identifier that diagram languages take: special signs become '_', and a leading digit gets one."""
    safe = F.translate(path, "/.- ()[]", "________")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)


def escape_label(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
