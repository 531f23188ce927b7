"""Operator 5, secret scans: multipart credential linking.

Candidates are of three kinds: access identifiers, secrets and endpoints.  Strong
ones (a vendor's format, a value assigned to a telling name) are reported alone.
Weak ones (random-looking strings, user names, mail addresses, hosts) are reported
only where an interval join finds a complementary part within the scope: a secret
needs an identifier or endpoint, those need a secret.  A scope never crosses a
document, so the join is local to the row and costs no shuffle.

Defined results
- null or empty text: no candidates; in redact() it stays as it is;
- very long texts: scanned whole; offsets are in characters;
- very long values: taken whole, to the end of their signs, an assigned one to three
  of one punctuation sign; a private key to its END line, without one to the end of its
  lines of 32 signs of base 64 or more;
- a url of over LONG_URL characters with a random string beyond them: reported alone;
- overlapping candidates: the one first in RULES wins, then the earlier, then the longer;
- repeated rows: reported once, each redacted; null doc_id: reported as such;
- empty table: no rows; other columns: ignored in report(), passed through in redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import docs_only, table
from .kernels import slice_batches

#: Largest gap in characters between two parts of one credential.
SCOPE = 200
LEAST_ENTROPY = 3.0
#: A longer url is one that may be signed: a random string in it links it to itself.
LONG_URL = 300

#: (rule, kind, strong, pattern); the value is group v where there is one.
RULES = tuple(
    (name, kind, strong, re.compile(pattern))
    for name, kind, strong, pattern in (
        ("private key", "secret", True, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?s:(?:(?!-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----).)*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{32,})+(?:(?:\s|\\[nr])*[A-Za-z0-9+/]*={1,2})?)?"),
        ("connection string", "secret", True, r"\b[a-z][a-z0-9+]{1,15}://[^\s:/@\"']+:(?P<v>[^\s:/@\"']{3,})@[^\s/\"']{3,}"),
        ("cloud access key", "identifier", True, r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"),
        ("vendor token", "secret", True, r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
        ("assigned secret", "secret", True, r"(?i:\b(?:[a-z_]{0,20}(?:token|secret|password|passwd|pwd|api_?key|secret_?key|private_?key|credential))[\"']?\s{0,3}[=:]\s{0,3})[\"']?(?P<v>(?=[^\s\"',;]*[0-9])[A-Za-z0-9+/=_.~!@#$%^&*-]{8,}?)(?=[\"'\s,;]|$|([#*$%&!~^])\2\2)"),
        ("assigned identifier", "identifier", False, r"(?i:\b(?:user(?:name)?|login|client_?id|account|access_?key_?id)[\"']?\s{0,3}[=:]\s{0,3})[\"']?(?P<v>[A-Za-z0-9_.@-]{3,})"),
        ("mail address", "identifier", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"),
        ("url", "endpoint", False, r"\b(?:https?|ftp|s3|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}"),
        ("address", "endpoint", False, r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.]*[0-9])"),
        ("random string", "secret", False, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"),
    )
)
#: Every text with a candidate matches this; RE2 tests a whole batch at once.
_ANY = r"[0-9=@]|://|-----BEGIN|gh[pousr]_|xox|AIza|sk-|eyJ|[:]"
_FIELDS = "doc_id long, kind string, rule string, strong boolean, start int, end int, linked array<string>, partners int, digest string"


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the non-overlapping candidates of a text, by start."""
    taken: list[tuple[int, int, int]] = []  # never overlapping, by start
    for k, (name, _, _, pattern) in enumerate(RULES):
        for m in pattern.finditer(text):
            group = "v" if "v" in pattern.groupindex else 0
            s, e = m.span(group)
            if name == "random string" and entropy(text[s:e]) < LEAST_ENTROPY:
                continue
            if name == "connection string":
                s, e = m.span()
            at = bisect_left(taken, (s,))
            if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                taken.insert(at, (s, e, k))
    return taken


def linked(found: list[tuple[int, int, int]], scope: int = SCOPE) -> list[set[int]]:
    """For each candidate (by start), the complementary ones whose gap to it is at most scope."""
    if not found:
        return []
    start = np.array([f[0] for f in found])
    end = np.array([f[1] for f in found])
    secret = np.array([RULES[f[2]][1] == "secret" for f in found])
    to = np.searchsorted(start, end + scope, "right")
    out: list[set[int]] = [set() for _ in found]
    for i in range(len(found)):
        for j in range(i + 1, to[i]):
            if secret[i] != secret[j]:
                out[i].add(j)
                out[j].add(i)
    return out


def _signed(url: str) -> bool:
    return any(entropy(m.group()) >= LEAST_ENTROPY for m in RULES[-1][3].finditer(url, LONG_URL))


def findings(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, int, list[str], int]]:
    """(start, end, rule, kinds linked, partners) of what is reported for a text."""
    if not text:
        return []
    found = candidates(text)
    out = []
    for (s, e, k), near in zip(found, linked(found, scope)):
        if RULES[k][2] or near or (RULES[k][0] == "url" and e - s > LONG_URL and _signed(text[s:e])):
            out.append((s, e, k, sorted({RULES[found[j][2]][1] for j in near}), len(near)))
    return out


def _suspects(texts: pa.Array) -> list[int]:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False)).tolist()


def report(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each reported candidate; its value only as a digest."""

    def run(batches):
        for b in slice_batches(batches):
            ids, texts, rows, own = b.column("doc_id"), b.column("text"), [], []
            for i in _suspects(texts):
                text = texts[i].as_py()
                for s, e, k, kinds, n in findings(text, scope):
                    own.append(i)
                    rows.append((RULES[k][1], RULES[k][0], RULES[k][2], s, e, kinds, n, hashlib.sha256(text[s:e].encode()).hexdigest()[:16]))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], ["doc_id", "kind", "rule", "strong", "start", "end", "linked", "partners", "digest"])

    return docs_only(df).mapInArrow(run, _FIELDS).distinct()


def redact(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows and columns of df, with what report() finds replaced by ``[kind]`` and n_chars, where there is one, counted anew."""
    names = df.columns

    def run(batches):
        for b in slice_batches(batches):
            texts = b.column("text")
            changed = {}
            for i in _suspects(texts):
                text = texts[i].as_py()
                found = findings(text, scope)
                if found:
                    pieces, at = [], 0
                    for s, e, k, _, _ in found:
                        pieces += [text[at:s], f"[{RULES[k][1]}]"]
                        at = e
                    changed[i] = "".join([*pieces, text[at:]])
            if changed:
                new = texts.to_pylist()
                for i, t in changed.items():
                    new[i] = t
                b = b.set_column(names.index("text"), b.schema.field("text"), pa.array(new, texts.type))
                if "n_chars" in names:
                    c = names.index("n_chars")
                    sizes = b.column(c).to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    b = b.set_column(c, b.schema.field(c), pa.array(sizes, b.schema.field(c).type))
            yield b

    return df.mapInArrow(run, df.schema)


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported credential parts of all documents."""
    return report(table(spark, sf_dir, "documents"))
