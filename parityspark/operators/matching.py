"""Minimum-weight matching of small clusters, vectorised over the rows of an Arrow batch.

Rows with the same number of hits k are solved together: a table over subsets of hits is filled for all of
them at once, subset by subset. Rows of at most DENSE_HITS hits come here; ``decode._by_rounds`` takes larger ones. Costs arrive as one flat list per row, the k boundary costs first and then
the pairs (0,1), (0,2), ..., (k-2,k-1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Cells of the subset table held at once, and the hits up to which a row is solved inside a task; more go to rounds of joins.
# Both ways are exact and break ties alike.
_TABLE_CELLS = 1 << 22
DENSE_HITS = 12


def solve_subsets(rim: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total and the partner of every hit (-1 boundary) for rim (B, k) and pair (B, k, k).

    Ties prefer the boundary, then the earliest partner, for the lowest open hit first.
    """
    b, k = rim.shape
    best = np.full((b, 1 << k), np.inf)
    best[:, 0] = 0.0
    choice = np.full((b, 1 << k), -1, dtype=np.int8)
    for mask in range(1, 1 << k):
        low = (mask & -mask).bit_length() - 1
        rest = mask & (mask - 1)
        top = rim[:, low] + best[:, rest]
        for j in range(low + 1, k):
            if rest >> j & 1:
                cost = pair[:, low, j] + best[:, rest ^ (1 << j)]
                better = cost < top
                top = np.where(better, cost, top)
                choice[better, mask] = j
        best[:, mask] = top
    mate = np.full((b, k), -1, dtype=np.int64)
    open_ = np.full(b, (1 << k) - 1, dtype=np.int64)
    rows = np.arange(b)
    for low in range(k):
        todo = (open_ >> low & 1) == 1
        j = choice[rows, open_].astype(np.int64)
        paired = todo & (j >= 0)
        mate[paired, low] = j[paired]
        mate[rows[paired], j[paired]] = low
        open_[todo] &= ~(1 << low)
        open_[paired] &= ~(1 << j[paired])
    return best[:, -1], mate


def unfold(flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat cost lists to boundary (B, k) and symmetric pair (B, k, k) arrays."""
    pair = np.full((len(flat), k, k), np.inf if flat.dtype.kind == "f" else 0, dtype=flat.dtype)
    i, j = np.triu_indices(k, 1)
    pair[:, i, j] = pair[:, j, i] = flat[:, k:]
    return flat[:, :k], pair


def by_size(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of a batch grouped by the length of a list column."""
    sizes = np.asarray(batch.column(name).value_lengths())
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        step = max(1, _TABLE_CELLS >> min(int(k), DENSE_HITS))
        for at in range(0, len(rows), step):
            yield int(k), rows[at : at + step]


def matrix(batch: pa.RecordBatch, name: str, rows: np.ndarray, dtype) -> np.ndarray:
    """Equal-length lists of the given rows as a 2-d array, NULL becoming infinity."""
    values = batch.column(name).take(pa.array(rows)).flatten()
    arr = values.to_numpy(zero_copy_only=False)
    if np.dtype(dtype).kind == "f":
        arr = np.where(np.isnan(arr.astype(float)), np.inf, arr.astype(float))
    return arr.astype(dtype).reshape(len(rows), -1)


def solutions(batch: pa.RecordBatch, key_col: str, rows: np.ndarray, hits: np.ndarray, rim, pair, rim_obs, pair_obs) -> pa.RecordBatch:
    """Solve the given rows and lay the answer out as (key, w, obs, a[], b[]); infeasible rows get NULL."""
    total, mate = solve_subsets(rim, pair)
    ok = np.isfinite(total)
    k = hits.shape[1]
    r = np.arange(len(rows))[:, None]
    alone = mate < 0
    obs_each = np.where(alone, rim_obs, pair_obs[r, np.arange(k)[None, :], np.where(alone, 0, mate)])
    first = alone | (mate > np.arange(k)[None, :])
    obs = np.bitwise_xor.reduce(np.where(first, obs_each, 0), axis=1) if k else np.zeros(len(rows), dtype=np.int64)
    use = first & ok[:, None]
    counts = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
    partner = np.where(alone, -1, hits[r, np.where(alone, 0, mate)])
    lists = lambda v: pa.ListArray.from_arrays(pa.array(counts), pa.array(v[use].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(key_col).take(pa.array(rows)),
            pa.array(np.where(ok, total, 0.0), mask=~ok),
            pa.array(obs.astype(np.int64), mask=~ok),
            lists(hits),
            lists(partner),
        ],
        names=[key_col, "w", "obs", "a", "b"],
    )
