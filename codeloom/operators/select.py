"""Selection of chunks and files within a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relevance, semantic_tokens

LEAST_TOKENS = 10
SKIPPED_OWNERS = ("generated", "package", "unity-generated", "vendor")
DIVERSITY = 0.3
KNAPSACK_CHUNKS, KNAPSACK_UNIT = 100, 10


def chunk_tokens(text: Column | None, lines: Column) -> Column:
    """From the text where it is known, else from 50 characters a line, LEAST_TOKENS at least."""
    guess = F.greatest(F.lit(LEAST_TOKENS), F.floor(lines * 50 / 4))
    return guess.cast("long") if text is None else F.coalesce(F.greatest(F.lit(1), F.floor(F.length(text) / 4)), guess).cast("long")


def prepare(chunks: DataFrame, scores: DataFrame, keywords: list[str] | None = None, task: str | None = None, least_score: float = 0.0) -> DataFrame:
    """chunks(id, path, name, type, exported, tokens, description[, ownership]) with pagerank, relevance, base_score, efficiency."""
    if "ownership" in chunks.columns:
        chunks = chunks.filter(~F.coalesce("ownership", F.lit("")).isin(*SKIPPED_OWNERS))
    df = chunks.filter(F.col("tokens") >= LEAST_TOKENS).join(scores.select(F.col("id").alias("path"), F.col("score").alias("pagerank")), "path", "left").fillna(0.0, ["pagerank"]).filter(F.col("pagerank") >= least_score)
    words = semantic_tokens(F.concat_ws(" ", "path", "name", "type", "description"))
    df = df.withColumn("relevance", relevance(words, keywords, task))
    df = df.withColumn("base_score", F.col("pagerank") * F.col("relevance") * F.when(F.col("exported"), 1.2).otherwise(1.0))
    return df.withColumn("efficiency", F.col("base_score") / F.col("tokens"))


def _greedy(pdf: pd.DataFrame, budget: int, factor: float) -> pd.DataFrame:
    """Picks of one query, best by efficiency after the penalty for what is like the picks so far; ties by id."""
    pdf = pdf.sort_values(["efficiency", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    base, tokens = pdf["base_score"].to_numpy(float), pdf["tokens"].to_numpy(np.int64)
    name, path, kind = pdf["name"].str.lower().to_numpy(), pdf["path"].to_numpy(), pdf["type"].to_numpy()
    prefix = np.array([x[:3] for x in name], object)
    same = np.zeros((3, len(pdf)))
    alive = np.ones(len(pdf), bool)
    rank = np.arange(len(pdf))
    left, picks, adjusted = budget, [], []
    while alive.any() and left > 0:
        penalty = 1 - factor * (1 - 1 / ((1 + same[0] * 0.5) * (1 + same[1] * 0.3) * (1 + same[2] * 0.1)))
        eff = base * penalty / tokens
        order = np.lexsort((rank, -eff))
        rank[order] = np.arange(len(pdf))
        fit = order[alive[order] & (tokens[order] <= left)]
        if not len(fit):
            break
        k = fit[0]
        picks.append(k)
        adjusted.append(base[k] * penalty[k])
        alive[k] = False
        left -= tokens[k]
        same[0] += path == path[k]
        same[1] += np.array([name[k].startswith(p) or n.startswith(prefix[k]) for n, p in zip(name, prefix)])
        same[2] += kind == kind[k]
    out = pdf.iloc[picks].copy()
    out["adjusted_score"], out["pick"] = adjusted, np.arange(1, len(picks) + 1)
    return out


def _knapsack(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The best total base score in units of ten tokens, of the most efficient candidates."""
    pdf = pdf.sort_values(["efficiency", "id"], ascending=[False, True], kind="stable").head(KNAPSACK_CHUNKS).reset_index(drop=True)
    size = np.maximum(1, pdf["tokens"].to_numpy(np.int64) // KNAPSACK_UNIT)
    value = pdf["base_score"].to_numpy(float) * 1000
    room = budget // KNAPSACK_UNIT + 1
    best = np.zeros(room + 1)
    keep = np.zeros((len(pdf), room + 1), bool)
    for k in range(len(pdf)):
        n = size[k]
        if n > room:
            continue
        new = best[: room + 1 - n] + value[k]
        keep[k, n:] = new > best[n:]
        best[n:] = np.where(keep[k, n:], new, best[n:])
    picks, w = [], room
    for k in range(len(pdf) - 1, -1, -1):
        if keep[k, w]:
            picks.append(k)
            w -= size[k]
    picks.reverse()
    out = pdf.iloc[picks].copy()
    out["adjusted_score"], out["pick"] = out["base_score"], np.arange(1, len(picks) + 1)
    return out


def optimize(prepared: DataFrame, budget: int, strategy: str = "greedy", diversity: float = DIVERSITY, filtered: bool = False, query: str | None = None) -> DataFrame:
    """The picks of each query (all rows are one where there is no query column), in order.

    Candidates that can never be picked (too large; irrelevant where ``filtered``) go
    before the sequential part, which is one group a query.
    """
    df = prepared.filter(F.col("tokens") <= (budget if strategy != "knapsack" else budget + 2 * KNAPSACK_UNIT))
    if filtered:
        df = df.filter("relevance > 0")
    key = query or "__all"
    if query is None:
        df = df.withColumn(key, F.lit(1))
    df = df.select(key, "id", "path", "name", "type", "tokens", "base_score", "efficiency")
    fields = f"{key} {df.schema[key].dataType.simpleString()}, pick int, id string, path string, tokens long, base_score double, adjusted_score double"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(pdf):
        return (_knapsack(pdf, budget) if strategy == "knapsack" else _greedy(pdf, budget, diversity))[names]

    out = df.groupBy(key).applyInPandas(run, fields)
    return out if query else out.drop(key)


def within_budget(files: DataFrame, budget: int, tokens_per_line: float = 4.0) -> DataFrame:
    """Of files(id, score, size_bytes) by score those that still fit, others are passed over; id, tokens, used.

    Each choice depends on those before, so the rows that can fit at all pass one task
    in order, sorted with spilling, and it keeps one number.
    """
    tokens = F.floor(F.coalesce(F.col("size_bytes"), F.lit(1000)) / 50 * tokens_per_line).cast("long")
    rows = files.select("id", (-F.col("score")).alias("rank"), tokens.alias("tokens")).filter(F.col("tokens") <= budget)
    kind = files.schema["id"].dataType.simpleString()

    def run(batches):
        used = 0
        for b in batches:
            size, keep, total = b.column("tokens").to_numpy(), [], []
            fits = np.flatnonzero(size <= budget - used)
            while len(fits):
                run_of = used + np.cumsum(size[fits])
                n = int(np.searchsorted(run_of, budget, "right"))
                keep += fits[:n].tolist()
                total += run_of[:n].tolist()
                used = total[-1] if total else used
                fits = fits[n:][size[fits[n:]] <= budget - used]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array([int(size[k]) for k in keep], pa.int64()), pa.array(total, pa.int64())], ["id", "tokens", "used"])

    return rows.repartition(1).sortWithinPartitions("rank", "id").mapInArrow(run, f"id {kind}, tokens long, used long")
