"""Exact top-k inner products by reading sorted lists without random access.

Rows are dealt into blocks. In a block each dimension is a list sorted by value,
read from the top for positive query components and from the bottom for negative
ones, all lists in step. What has been read gives each row a lower and an upper
bound of its score: an unread component lies between the list's far end and its
frontier. Rows whose upper bound is below the k-th best lower bound are out;
reading goes deeper until the k best are known, and their scores are resolved.
All queries of a block of queries share the reading, so bounds are matrix
products. The k best of every block meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.session import ship_by_value, written_table

BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024
# Share of each list read before the bounds are looked at again; 1 is its end.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 1.0)
EXACT_DOUBLE = 2.0**53


def _numbers(rows: list[np.ndarray], limit_partner: float) -> np.ndarray:
    """Integer vectors as doubles where products and sums stay exact, else as int64."""
    return np.array(rows, np.float64 if limit_partner < EXACT_DOUBLE else np.int64)


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray,
                row_ids: np.ndarray, k: int):
    """(query index, row index, score) of each query's k best rows.

    Ties go to the smaller row id; a query's own id is no candidate.
    """
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    lists = np.sort(rows, axis=0)
    low, high = lists[0], lists[-1]
    both = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    waiting = np.arange(len(queries))
    there = np.arange(len(rows))
    least = np.iinfo(np.int64).min if rows.dtype == np.int64 else -np.inf
    out = []
    for depth in DEPTHS:
        read = max(1, min(len(rows), int(np.ceil(depth * len(rows)))))
        from_top, from_bottom = lists[len(rows) - read], lists[read - 1]
        part = rows[there]
        upper = np.concatenate(
            [np.maximum(part, from_top), np.minimum(part, from_bottom)], axis=1
        )
        lower = np.concatenate(
            [np.where(part >= from_top, part, low), np.where(part <= from_bottom, part, high)],
            axis=1,
        )
        weights = both[waiting]
        most, sure = weights @ upper.T, weights @ lower.T
        own = query_ids[waiting][:, None] == row_ids[there][None, :]
        most[own], sure[own] = least, least
        count = sure.shape[1]
        if count > k:
            bar = np.partition(sure, count - k, axis=1)[:, count - k]
        else:
            bar = np.full(len(waiting), least)
        able = (most >= bar[:, None]) & ~own
        settled = able.sum(axis=1) <= k
        if read == len(rows):
            settled[:] = True
        for i in np.flatnonzero(settled):
            found = np.flatnonzero(able[i])
            scores = queries[waiting[i]] @ part[found].T
            # Stable sorts: by score, ties in row id order.
            best = np.argsort(-scores, kind="stable")[:k]
            out += [(waiting[i], order[there[found[b]]], scores[b]) for b in best]
        able = able[~settled]
        waiting = waiting[~settled]
        if not len(waiting):
            break
        there = there[able.any(axis=0)]
    return out


def top_k(
    vectors: DataFrame,
    is_query,
    k: int,
    id_column: str = "vec_id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query.

    ``vectors`` has an id and an array of integers; rows with a NULL id or
    vector take no part, and only vectors of one length are compared. Rows with
    the query's id are no candidates; a query id that is repeated is asked once,
    a repeated candidate counts once per row. Fewer candidates than k: all.
    """
    given = written_table(
        vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"),
            F.col(vector).cast("array<long>").alias("vector"),
            F.size(vector).alias("dims"),
            F.coalesce(is_query, F.lit(False)).alias("asked"),
        ),
        "vectors",
    )
    sizes = given.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("asked").alias("queries")
    ).first()
    row_blocks = max(1, -(-sizes["rows"] // block_rows))
    query_blocks = max(1, -(-sizes["queries"] // block_queries))

    def dealt(blocks: int):
        return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    every_row_block = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    rows = given.select(
        "id", "vector", "dims", F.lit(False).alias("asked"),
        dealt(row_blocks).alias("row_block"), every_query_block.alias("query_block"),
    )
    queries = given.where("asked").dropDuplicates(["id"]).select(
        "id", "vector", "dims", "asked",
        every_row_block.alias("row_block"), dealt(query_blocks).alias("query_block"),
    )

    def search(block: pd.DataFrame) -> pd.DataFrame:
        asked = block["asked"].to_numpy(bool)
        parts = [block[~asked], block[asked]]
        if not len(parts[0]) or not len(parts[1]) or not len(block["vector"].iloc[0]):
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"query_id": none, "vec_id": none, "score": none})
        whole = [np.array(p["vector"].tolist(), np.int64) for p in parts]
        reach = np.abs(whole[0].astype(float)).max() * np.abs(whole[1].astype(float)).max()
        numbers = [_numbers(w, reach * whole[0].shape[1]) for w in whole]
        ids = [p["id"].to_numpy(np.int64) for p in parts]
        found = block_top_k(numbers[1], ids[1], numbers[0], ids[0], k)
        q, r, s = zip(*found) if found else ((), (), ())
        return pd.DataFrame(
            {
                "query_id": ids[1][list(q)],
                "vec_id": ids[0][list(r)],
                "score": np.array(s, np.int64),
            }
        )

    near = (
        rows.unionByName(queries)
        .groupBy("dims", "row_block", "query_block")
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ship_by_value(__name__)
