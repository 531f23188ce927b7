"""Text expressions: tokens, relevance, anchors, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def semantic_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, camelCase parted."""
    parted = F.regexp_replace(text, r"([a-z0-9])(?=[A-Z])", "$1 ")
    return F.array_distinct(F.transform(F.regexp_extract_all(parted, F.lit(r"([A-Za-z0-9]+)"), 1), F.lower))


def tokens_of(text: str) -> set[str]:
    """semantic_tokens of a Python string."""
    return {t.lower() for t in re.findall("[A-Za-z0-9]+", re.sub("([a-z0-9])(?=[A-Z])", r"\1 ", text))}


def relevance(tokens: Column, keywords: list[str] | None = None, task: str | None = None) -> Column:
    """Share of the keywords, and of the task's words, among the tokens; their mean where both are asked for, 1 where neither is."""
    shares = []
    if keywords:
        hits = [F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in sorted(tokens_of(k))])).cast("int") if tokens_of(k) else F.lit(0) for k in keywords]
        shares.append(sum(hits[1:], hits[0]) / len(keywords))
    if task:
        words = sorted(tokens_of(task))
        shares.append(F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in words]))) / len(words) if words else F.lit(0.0))
    return sum(shares[1:], shares[0]) / len(shares) if shares else F.lit(1.0)


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def semantic_anchor(kind: Column, name: Column, normalized: Column) -> Column:
    return sha16(F.concat(F.lit("TYPE:"), kind, F.lit("\nNAME:"), name, F.lit("\n"), normalized))


def signature_anchor(signature: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.regexp_replace(signature, r"\s+", " ")), 256), 1, 8)


def collapse(text: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def location_id(path: Column, line: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), kind, name)
