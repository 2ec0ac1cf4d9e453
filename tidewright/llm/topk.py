"""Operator 1, exact top-k search by term-at-a-time accumulation.

Rows are sparse integer vectors: parallel arrays of terms and weights. The candidates are dealt into shards; each shard inverts its
rows into postings, and every query row scatters its weighted postings into a dense score array over the shard. A partition
selection keeps the shard's k best, and the shards' results are merged.

Sums are made in 32 or 64 bits where these hold the largest possible one, else in whole numbers of any size; a score beyond 64 bits is returned as
the nearest that fits, and such scores rank by their value as a double.

Cases: rows with a null id or null terms or weights take no part; a row without terms scores 0 against everything; ids that repeat
keep one row (the smallest by weights, then terms); ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.blocks import best_per_query, blocks_of, pair_blocks

SHARD_ROWS = 4096
GROUP_ROWS = 8192
SCHEMA = "query_id long, vec_id long, score long, size double"
#: A term whose postings reach this share of a shard is kept as a dense row of weights.
DENSE = 0.25


def sparse_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, terms, weights) with weight floor(scale * x), a whole double, of each component x; rows that are null or hold null or non-finite components, as
    they are or scaled, are left out."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False)))
    # a double of 2 ** 53 or more is whole
    rows = rows.withColumn("w", F.transform("x", lambda v: F.when(F.abs(v) < 2**53, F.floor(v).cast("double")).otherwise(v)))
    hits = F.filter(F.transform("w", lambda v, i: F.struct(i.alias("t"), v.alias("w"))), lambda s: s["w"] != 0)
    return rows.select("id", hits["t"].alias("terms"), hits["w"].alias("weights"))


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """Needs terms, weights. Repeated ids keep their smallest row."""
    return rows.groupBy("id").agg(F.min(F.struct("weights", "terms")).alias("r")).select("id", "r.terms", "r.weights")


def flat(column: pd.Series, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and the row of each."""
    sizes = np.fromiter((len(x) for x in column), dtype=np.int64, count=len(column))
    return (np.concatenate([np.asarray(x, dtype=dtype) for x in column]) if len(column) else np.empty(0, dtype)), np.repeat(np.arange(len(column)), sizes)


def whole_numbers(values: np.ndarray, dtype) -> np.ndarray:
    return np.array([int(v) for v in values.tolist()], object) if dtype is object else values.astype(dtype)


def postings(rows: pd.DataFrame, dtype) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """term -> (positions, weights), or (None, weights of all positions) where the term is common in this shard."""
    terms, at = flat(rows["terms"], np.int64)
    weights = whole_numbers(flat(rows["weights"], np.float64)[0], dtype)
    order = np.argsort(terms, kind="stable")
    terms, at, weights = terms[order], at[order], weights[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
    out = {}
    for lo, hi in zip(starts, np.r_[starts[1:], len(terms)], strict=True):
        if hi - lo >= DENSE * len(rows):
            dense = np.zeros(len(rows), dtype)
            dense[at[lo:hi]] = weights[lo:hi]
            out[int(terms[lo])] = (None, dense)
        else:
            out[int(terms[lo])] = (at[lo:hi], weights[lo:hi])
    return out


def largest(column: pd.Series) -> int:
    return max((int(np.abs(np.asarray(x, np.float64)).max()) for x in column if len(x)), default=0)


def kept_places(scores: np.ndarray, want: int) -> np.ndarray:
    """Positions of the `want` highest scores, highest first, ties by position."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: -scores[i])[:want], np.int64)
    least = np.partition(scores, len(scores) - want)[len(scores) - want]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above[np.argsort(-scores[above].astype(np.int64), kind="stable")], level[: want - len(above)]])


def fitted(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As 64-bit numbers, and as doubles."""
    if scores.dtype != object:
        return scores.astype(np.int64), scores.astype(np.float64)
    most = 2**1023
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in scores], np.int64), np.array([float(max(-most, min(most, x))) for x in scores], np.float64)


def search_with(k: int):
    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64), "size": np.empty(0)})
        shard = shard.sort_values("id", ignore_index=True)
        ids, width = shard["id"].to_numpy(), max((len(x) for x in asked["terms"]), default=0)
        most = largest(shard["weights"]) * largest(asked["weights"]) * max(1, width)
        dtype = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
        lists, number = postings(shard, dtype), int if dtype is object else dtype
        scores, part, want = np.zeros(len(ids), dtype), np.zeros(len(ids), dtype), min(k + 1, len(ids))
        out_q, out_v, out_s, out_d = [], [], [], []
        for query, terms, weights in zip(asked["id"], asked["terms"], asked["weights"], strict=True):
            scores[:] = 0
            for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
                hit = lists.get(term)
                if hit is None:
                    continue
                if hit[0] is None:
                    np.multiply(hit[1], number(weight), out=part)
                    np.add(scores, part, out=scores)
                else:
                    scores[hit[0]] += hit[1] * number(weight)
            # k + 1 of them, as the query's own row may be among them; positions ascend with the ids, so ties go right
            kept = kept_places(scores, want)
            kept = kept[ids[kept] != query][:k]
            found, size = fitted(scores[kept])
            out_q.append(np.full(len(kept), query))
            out_v.append(ids[kept])
            out_s.append(found)
            out_d.append(size)
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s), "size": np.concatenate(out_d)})

    return search


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product for each query, the row of the query's own id left out.

    queries and candidates hold id, terms and weights, each id once."""
    n_shards, n_groups = blocks_of(candidates.count(), shard_rows), blocks_of(queries.count(), group_rows)
    found = pair_blocks(queries, candidates, "id", n_shards, n_groups, search_with(k), SCHEMA)
    return best_per_query(found, k, F.col("size").desc(), F.col("score").desc())
