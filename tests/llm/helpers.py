"""Small tables with everything that may go wrong, and brute-force counterparts of the kernels."""

import re

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
SAME = "the very same words stand here in the very same order for every reader who cares to look at them twice"
ROWS = [(1, None), (2, ""), (3, "short"), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (None, SAME), (None, None), (7, "   \n\t "), (8, "é世界 🎉 naïve")]
#: Names that the operators use themselves.
CLASHING = ("set_id", "node", "component", "uid", "words", "tokens", "label", "score", "keep", "shard", "hash", "places", "a", "__gone", "__turn", "gone", "Turn", "class_id", "links", "gram", "second")


def table(spark, rows, extra=(), id_name="doc_id"):
    """rows of (id, text) as a table; extra columns hold a constant."""
    fields = f"{id_name} long, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], fields)


def ugly(spark):
    return table(spark, ROWS, CLASHING)


def empty(spark):
    return table(spark, [])


def words(text):
    return re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (text or "").lower())


def ngram_set(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
