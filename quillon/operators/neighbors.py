"""Exact nearest neighbours of a query set against a bank, block by block."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut, parallelism

BLOCK_ROWS = 4096
PART_BLOCKS = 64
TILE_ROWS = 2048
EXACT_AT_ONCE = 50_000


def _pack(ids: np.ndarray, m: np.ndarray) -> bytes:
    """Ids and vectors, as single floats where these hold the same numbers."""
    short = m.astype(np.float32)
    return pickle.dumps((ids, short if (short == m).all() else m))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, v, kind, block) sorted by (block, kind): one row a block and kind, packed."""
    at, held = None, []

    def block() -> pd.DataFrame:
        ids, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
        return pd.DataFrame({"block": [at[0]], "kind": [at[1]], "data": [_pack(ids, vectors)]})

    for pdf in batches:
        if not len(pdf):
            continue
        number, kind, ids, v = (pdf[c].to_numpy() for c in ("block", "kind", "id", "v"))
        edge = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *edge], [*edge, len(pdf)], strict=True):
            if (number[lo], kind[lo]) != at:
                if held:
                    yield block()
                at, held = (number[lo], kind[lo]), []
            held.append((ids[lo:hi], np.stack(v[lo:hi])))
    if held:
        yield block()


def packed(df: DataFrame, key: str, vector: str, rows: int, by: str | None = None, part_blocks: int | None = None, blocks: int | None = None) -> DataFrame:
    """(block, kind, data): ids and vectors of ``df`` in blocks of about ``rows``, or in ``blocks`` blocks, materialised.

    Rows of one id lie in one block, that of its hash modulo the number of blocks, and with ``by`` a block holds one value of it, its
    ``kind``. A partition has at most ``part_blocks`` blocks or, without that bound, its
    share of all blocks, so that every core gets some. A vector is shuffled once, as it is
    stored, to where its block stays.
    """
    spark, kind = df.sparkSession, (F.col(by).cast("string") if by else F.lit(""))
    n = blocks or max(1, -(-df.count() // rows))
    part = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"), kind.alias("kind"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"))
    parts = -(-n // part_blocks) if part_blocks else min(n, max(parallelism(spark), spark.sparkContext.defaultParallelism))
    placed = part.repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "kind")
    return cut(placed.mapInPandas(_blocks, "block int, kind string, data binary"))


def products(queries: DataFrame, bank: DataFrame, start: Callable, meet: Callable, result: Callable, schema: str, when: Column | None = None) -> DataFrame:
    """Every packed query block against every packed bank block, for which ``when`` (of kind and bank_kind) holds.

    A task takes some query blocks and one partition of the bank, which it reads where it
    was materialised: nothing is broadcast or shuffled for a pair. A query block is handed
    to Python once a bank partition, then the bank blocks follow it alone, so no pair holds
    both. ``start`` makes a state of a block's (ids, vectors), ``meet`` lets it see a bank
    block, and ``result`` gives the rows of a state once its bank partition is through.
    """
    none = F.lit(None).cast("binary")
    twice = F.inline(F.array(F.struct(F.lit(True).alias("head"), F.col("data").alias("q")), F.struct(F.lit(False).alias("head"), none.alias("q"))))
    left = queries.select("block", "kind", twice)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    right = bank.select(F.col("kind").alias("bank_kind"), F.col("data").alias("b"), first.alias("first"))
    meets = ~F.col("head") if when is None else ~F.col("head") & when
    both = left.join(right, meets | (F.col("head") & F.col("first")))
    pairs = both.select("block", "q", F.when(~F.col("head"), F.col("b")).alias("b"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, query, state = None, None, None
        for pdf in batches:
            for block, q, b in zip(pdf["block"], pdf["q"], pdf["b"], strict=True):
                if q is not None:
                    if state is not None:
                        yield result(at, state)
                    at, query, state = block, q, None
                    continue
                if state is None:
                    state, query = start(*pickle.loads(query)), None
                meet(state, *pickle.loads(b))
        if state is not None:
            yield result(at, state)

    return pairs.mapInPandas(rows, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class _Nearest:
    """The k smallest distances of each query of a block so far, rounded and as they are, with their neighbours."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int, skip_self: bool):
        self.ids, self.u, self.k, self.skip_self = ids, _unit(m), k, skip_self
        self.short = self.u.astype(np.float32)
        self.d, self.exact = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.inf)
        self.names = np.full((len(ids), k), "", dtype=object)
        # Where a query is met in the bank, if it is not to be its own neighbour.
        self.own: dict[str, list[int]] = {}
        for i, name in enumerate(ids if skip_self else []):
            self.own.setdefault(name, []).append(i)
        # Single products of unit vectors are off by less than this.
        self.off = (m.shape[1] + 8) * 2.0**-23

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        u = _unit(m)
        for at in range(0, len(ids), TILE_ROWS):
            self._tile(ids[at : at + TILE_ROWS], u[at : at + TILE_ROWS])

    def _tile(self, ids: np.ndarray, u: np.ndarray) -> None:
        s = self.short @ u.astype(np.float32).T
        for j in [j for j, name in enumerate(ids) if name in self.own] if self.own else []:
            s[self.own[ids[j]], j] = -np.inf
        least = 1 - self.d[:, -1] - self.off
        open_ = np.flatnonzero(np.isinf(least))
        if len(open_) and s.shape[1] > self.k:
            least[open_] = np.partition(s[open_], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * self.off
        near = np.flatnonzero(s.max(axis=1) >= least)
        step = max(1, EXACT_AT_ONCE // max(1, s.shape[1]))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for at in range(0, len(near), step):
            here = near[at : at + step]
            r, j = np.nonzero(s[here] >= least[here][:, None])
            held.append((here[r], j))
            n += len(r)
            if n >= EXACT_AT_ONCE:
                self._merge(held, ids, u)
                held, n = [], 0
        if n:
            self._merge(held, ids, u)

    def _merge(self, held: list, ids: np.ndarray, u: np.ndarray) -> None:
        r, j = (np.concatenate(c) for c in zip(*held, strict=True))
        exact = np.clip(1 - np.einsum("ij,ij->i", self.u[r], u[j]), 0, 2)
        d = np.round(exact, 12)
        keep = d <= self.d[r, -1]
        if self.skip_self:
            keep &= self.ids[r] != ids[j]
        r, j, d, exact = r[keep], j[keep], d[keep], exact[keep]
        if not len(r):
            return
        own = np.unique(r)
        row = np.concatenate([np.repeat(own, self.k), r])
        d, exact = np.concatenate([self.d[own].ravel(), d]), np.concatenate([self.exact[own].ravel(), exact])
        row, d, exact, names = _first(row, d, exact, np.concatenate([self.names[own].ravel(), ids[j]]), self.k)
        shape = (len(own), self.k)
        self.d[own], self.exact[own], self.names[own] = d.reshape(shape), exact.reshape(shape), names.reshape(shape)


def _first(row: np.ndarray, d: np.ndarray, exact: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each row by ``d``, then name."""
    order = np.lexsort((d, row))
    tied = (row[order][1:] == row[order][:-1]) & (d[order][1:] == d[order][:-1]) & np.isfinite(d[order][1:])
    if tied.any():
        order = np.lexsort((names.astype(str), d, row))
    row = row[order]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    kept = order[place < k]
    return row[place < k], d[kept], exact[kept], names[kept]


def nearest_neighbors(queries: DataFrame, bank: DataFrame, key: str, vector: str, k: int, skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbor, distance, rank): the k smallest cosine distances of each query.

    Both sides are packed into blocks of about ``block_rows`` vectors, see ``products``. A
    pair of blocks is one product of single floats, whose error is bounded: only pairs that
    may lie within the k nearest so far are computed as doubles, and these decide. A query
    keeps k, and what it kept in each partition of the bank is merged by block. Ties, to
    twelve digits, go to the smaller neighbour id. ``k`` is capped by the bank; k <= 0
    raises. Ids come out as strings.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def kept(block: int, s: _Nearest) -> pd.DataFrame:
        return pd.DataFrame({"block": [block], "data": [pickle.dumps((s.ids, s.d, s.exact, s.names))]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, d, exact, names = (np.concatenate(c) for c in zip(*map(pickle.loads, pdf["data"]), strict=True))
        found, row = np.unique(ids.astype(str), return_inverse=True)
        row, d, exact, names = _first(np.repeat(row, k), d.ravel(), exact.ravel(), names.ravel(), k)
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) + 1
        out = pd.DataFrame({"id": found[row].astype(object), "neighbor": names, "distance": exact, "rank": rank})
        return out[np.isfinite(d)]

    # Bank blocks are kept so small that the JVM does not set whole regions of its heap aside for one.
    q, b = packed(queries, key, vector, block_rows), packed(bank, key, vector, max(1, block_rows // 4), part_blocks=4 * PART_BLOCKS)
    met = products(q, b, lambda ids, m: _Nearest(ids, m, k, skip_self), _Nearest.meet, kept, "block int, data binary")
    return met.groupBy("block").applyInPandas(merged, "id string, neighbor string, distance double, rank int")
