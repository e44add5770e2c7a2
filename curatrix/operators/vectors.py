"""Pairs of similar vectors: cells around pivots where they pay, hashed tiles elsewhere."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .keyed import top_per_key, with_group_agg

#: Rows of a tile, and pivots of a block at most.
TILE_ROWS, PIVOTS = 2000, 512
#: Largest table of pivots that every task may hold.
PIVOT_BYTES = 64 << 20


def unit(rows: Sequence) -> np.ndarray:
    """Rows of length 1; null vectors stay as they are."""
    mat = np.stack([np.asarray(v, dtype="float64") for v in rows])
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return mat / np.where(norm == 0, 1, norm)


def similar_pairs(df: DataFrame, block: Sequence[str], key: str, vector: str, min_similarity: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id_a < id_b, similarity): pairs of one block whose cosine similarity reaches the limit.

    Blocks of up to ``tile_rows`` rows are compared whole. A larger block is dealt into cells
    around pivots, if that ships fewer rows than its tiles would (see ``cells``); each cell,
    and each block that has none, is then cut into hashed tiles of bounded size.
    """
    own = df.dropna(subset=[*block, vector]).select(F.xxhash64(*block).alias("_h"), *block, F.col(key).alias("_id"), F.col(vector).alias("_v"))
    sized = with_group_agg(own, ["_h"], _n=F.count(F.lit(1)))
    dealt = cells(sized.filter(F.col("_n") > tile_rows), min_similarity, tile_rows)
    whole = sized.select("_h", *block, "_id", "_v", F.lit(-1).alias("_cell"), F.lit(True).alias("_home"))
    if dealt is None:
        rows = whole
    else:
        placed, paying = dealt
        rows = whole.join(paying, "_h", "left_anti").unionByName(placed)
    return _tiled(rows, block, min_similarity, tile_rows)


def cells(df: DataFrame, min_similarity: float, tile_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows with _cell and _home, hashes of their blocks), or None if no block is dealt into cells.

    ``df``: _h (hash of the block), _id, _v, _n (rows of the block) and the block itself. Each vector is at home in the cell of the
    pivot nearest to it. Let x be at home with p and y with q. On the line from q to p, x
    lies on p's side of the middle and y on q's, so they can only be as near as the limit
    asks if x is no further from the middle than that. A vector therefore also visits the
    cells of lower number whose border is within this reach; every pair then meets once,
    where one of the two is at home. A block is dealt so if its rows with their visits are
    fewer than the copies its tiles would need, which is decided by counting them.
    """
    chosen = top_per_key(df.select("_h", "_id", "_v", "_n"), ["_h"], [F.xxhash64("_id").asc(), F.asc("_id")], PIVOTS)
    chosen = chosen.filter(F.col("rn") <= 2 * F.ceil(F.col("_n") / tile_rows))
    chosen = written(chosen.select("_h", "rn", "_v"))
    told = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    if not told[0] or told[0] * told[1] * 8 > PIVOT_BYTES:
        return None
    pivots: dict = {}
    for r in chosen.collect():
        pivots.setdefault(r["_h"], []).append((r["rn"], r["_v"]))
    held = df.sparkSession.sparkContext.broadcast({b: unit([v for _, v in sorted(rows, key=lambda x: x[0])]) for b, rows in pivots.items()})
    reach = math.sqrt(max(0.0, 2 - 2 * min_similarity)) + 1e-9

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = held.value
        gaps = {b: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for b, p in tables.items()}
        for frame in frames:
            found: list = [None] * len(frame)
            hashes = frame["_h"].to_numpy()
            for b in np.unique(hashes).tolist():
                at = np.flatnonzero(hashes == b)
                x = unit(frame["_v"].iloc[at])
                sims = x @ tables[b].T
                home = sims.argmax(axis=1)
                # distance from the middle between the home pivot and each other one
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond = (sims[np.arange(len(at)), home][:, None] - sims) / gaps[b][home]
                near = ~(beyond > reach) & (np.arange(sims.shape[1])[None, :] < home[:, None])
                for row, k in enumerate(at.tolist()):
                    found[k] = [int(home[row]), *np.flatnonzero(near[row]).tolist()]
            yield frame.assign(_cells=found)

    schema = T.StructType([*df.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    placed = written(df.mapInPandas(place, schema))
    visits = placed.groupBy("_h").agg(F.sum(F.size("_cells")).alias("_rows"), F.first("_n").alias("_n"))
    paying = written(visits.filter(F.col("_rows") < F.col("_n") * F.ceil(F.col("_n") / tile_rows)).select("_h"))
    if paying.isEmpty():
        return None
    rows = placed.join(paying, "_h", "left_semi").select("*", F.posexplode("_cells").alias("_k", "_cell"))
    return rows.withColumn("_home", F.col("_k") == 0).drop("_k", "_cells", "_n"), paying


def _tiled(rows: DataFrame, block: Sequence[str], min_similarity: float, tile_rows: int) -> DataFrame:
    """(id_a, id_b, similarity) within each cell of each block, of pairs with one at home.

    A cell of n rows is cut into ceil(n / tile_rows) hashed tiles; each pair of tiles is
    one small matrix product, so no task sees more than two tiles.
    """
    sized = with_group_agg(rows, ["_h", "_cell"], _m=F.count(F.lit(1)))
    tiles = F.ceil(F.col("_m") / tile_rows).cast("int")
    tiled = sized.withColumns({"_tiles": tiles, "_t": F.pmod(F.xxhash64("_id"), F.ceil(F.col("_m") / tile_rows)).cast("int")})
    spread = tiled.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(
        "_h", *block, "_cell", F.least("_t", "_o").alias("_lo"), F.greatest("_t", "_o").alias("_hi"), "_t", "_id", "_v", "_home")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        mat = unit(pdf["_v"])
        ids, t, home = pdf["_id"].to_numpy(), pdf["_t"].to_numpy(), pdf["_home"].to_numpy(bool)
        left, right = np.flatnonzero(t == lo), np.flatnonzero(t == hi)
        sim = mat[left] @ mat[right].T
        i, j = np.nonzero(sim >= min_similarity)
        a, b, s, one = ids[left[i]], ids[right[j]], sim[i, j], home[left[i]] | home[right[j]]
        keep = one & (a < b if lo == hi else a != b)
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "similarity": s})

    return spread.groupBy("_h", *block, "_cell", "_lo", "_hi").applyInPandas(product, "id_a bigint, id_b bigint, similarity double")
