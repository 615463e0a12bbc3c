"""Exact top-k search by inner product over a bit-sliced index.

Every component is an integer; a block of rows keeps, for each component and bit, a
bitmap over its rows. A query adds, for each set bit of its components, the matching
slices (complemented where the component is negative) with carry-save and ripple adders on
whole bitmaps, which yields the slices of all rows' scores. The best rows are selected from
the most significant slice downward; rows that stay tied at the boundary are resolved by
smaller id, and the scores of the rows found are computed from their integers.

Blocks of ``BLOCK`` rows are packed once. Queries go out in batches of at most ``BATCH``
bytes, one pass over the blocks a batch; a task builds the slices of a block once a pass, runs the
batch's queries over them and hands on its k best rows a query. Every query sees every block.

Defined results: a vector that is null or has a null or non-finite component takes no part,
nor does a null id; an empty vector scores 0; vectors of other lengths than the query's are
not its candidates; rows that share an id, or are the same, are rows of their own, and only the
query's own row is not its candidate. Components of any size are exact: vectors with
integers of 2^24 or more are Python integers in blocks of their own. A score beyond 64 bits is ranked exactly and
written as the nearest 64-bit integer. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import saved

#: Rows in a block, bytes of a batch of queries, factor of the integers, rows that are queries.
BLOCK, BATCH, SCALE, EVERY = 8192, 16 << 20, 256, 50
#: Vectors of fewer components than this, all below it when squared, have 64-bit products.
DIMS, NARROW = 1 << 14, 1 << 24
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) -> words (..., rows / 64), rows padded with zeros."""
    rows = flags.shape[-1]
    wide = np.zeros((*flags.shape[:-1], -(-rows // 64) * 64), bool)
    wide[..., :rows] = flags
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """The bit slices of integer vectors (rows, dims), by ascending (id, row)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.low = int(self.vectors.min()) if vectors.size else 0
        high = int(self.vectors.max()) if vectors.size else 0
        self.bits = max(1, (high - self.low).bit_length())
        lifted = (self.vectors - self.low).T  # never negative
        flags = np.stack([lifted >> b & 1 for b in range(self.bits)], axis=1).astype(bool)
        self.slices = _bitmap(flags)
        self.valid = _bitmap(np.ones(len(ids), bool))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The slices (least significant first) of score minus a constant."""
        size = np.abs(query)
        top = max(1, int(size.max()).bit_length()) if len(query) else 1
        negative = np.where(query < 0, _ONES, np.uint64(0)).astype(np.uint64)[:, None, None]
        # q u, or |q| (2^bits - 1 - u) - |q| (2^bits - 1) where q < 0
        terms = self.slices ^ negative
        parts = []
        for b in range(top):
            chosen = np.flatnonzero((size >> b & 1).astype(bool))
            if len(chosen):
                parts.append((b, _carry_save(terms[chosen])))
        width = self.bits + top + len(query).bit_length() + 1
        total = np.zeros((width, terms.shape[-1]), np.uint64)
        for b, stack in parts:
            for one in stack:
                _add(total, one, b)
        return total

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than row ``own``."""
        total = self.scores(query)
        left = self.valid.copy()
        for at in np.flatnonzero(self.rows == own).tolist():
            left[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure, have = np.zeros_like(left), 0
        for line in total[::-1]:
            both = left & line
            n = int(np.bitwise_count(both).sum())
            if have + n > k:
                left = both
            else:
                sure |= both
                have += n
                left = left & ~line
                if have == k:
                    break
        rows = np.concatenate([_rows(sure), _rows(left)[: k - have]])
        return self.ids[rows], self.vectors[rows] @ query if len(query) else np.zeros(len(rows), np.int64)


def _carry_save(stack: np.ndarray) -> np.ndarray:
    """Numbers (n, bits, words) as bit slices -> two numbers or fewer of the same sum."""
    while len(stack) > 2:
        n = len(stack) // 3
        a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
        half = a ^ b
        out = np.zeros((2 * n + len(stack) - 3 * n, stack.shape[1] + 1, stack.shape[2]), np.uint64)
        np.bitwise_xor(half, c, out=out[:n, :-1])
        np.bitwise_or(a & b, half & c, out=out[n : 2 * n, 1:])
        out[2 * n :, :-1] = stack[3 * n :]
        stack = out
    return stack


def _add(total: np.ndarray, one: np.ndarray, shift: int) -> None:
    """total += one << shift, slice by slice with a carry; excess slices of one are zero."""
    carry = None
    for k in range(shift, len(total)):
        x = one[k - shift] if k - shift < len(one) else None
        if x is None and carry is None:
            return
        line = total[k]
        if x is None:
            total[k], carry = line ^ carry, line & carry
        elif carry is None:
            total[k], carry = line ^ x, line & x
        else:
            half = line ^ x
            total[k], carry = half ^ carry, (line & x) | (half & carry)


def _exact(x: float, scale: int) -> int:
    """floor(scale * x), also where that has more bits than a double."""
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def _order(score: int) -> bytes | None:
    """What tells scores apart that are written alike, being beyond 64 bits."""
    if _LEAST <= score <= _MOST:
        return b"\x80"
    raw = abs(score).to_bytes(-(-score.bit_length() // 8) + 1, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\x81" + raw if score > 0 else b"\x00" + bytes(255 - x for x in raw)


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, row, wide, dims, q, x) of the vectors that take part: the integers q, or the
    components x where some integer is large; ``row`` tells rows apart once it is saved."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    x = F.transform("embedding", lambda x: x.cast("double"))
    wide = F.exists(x, lambda v: F.abs(v) >= float(NARROW // scale)) | (F.size("embedding") >= DIMS)
    q = F.transform(x, lambda v: F.floor(v * scale).cast("int"))
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), wide.alias("wide"), F.size("embedding").alias("dims"),
        F.when(~wide, q).alias("q"), F.when(wide, x).alias("x"),
    )


def _packed(found: DataFrame, part: Column, scale: int) -> DataFrame:
    """(part, dims, wide, ids, rows, flat): the vectors of a part, length and kind in one row."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, dims = bool(pdf["wide"].iloc[0]), int(pdf["dims"].iloc[0])
        if wide:
            flat = ",".join(str(_exact(v, scale)) for x in pdf["x"] for v in x).encode()
        else:
            flat = np.array(pdf["q"].tolist(), np.int32).tobytes()
        ids, rows = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row"))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "dims": [dims], "wide": [wide], "ids": [ids], "rows": [rows], "flat": [flat]})

    form = "part long, dims int, wide boolean, ids binary, rows binary, flat binary"
    return found.withColumn("part", part).groupBy("part", "dims", "wide").applyInPandas(pack, form)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
    if row["wide"]:
        flat = np.array([int(x) for x in row["flat"].decode().split(",")], object)
    else:
        flat = np.frombuffer(row["flat"], np.int32).astype(np.int64)
    return ids, rows, flat.reshape(len(ids), row["dims"])


def search(rows: DataFrame, k: int = 5, every: int = EVERY, block: int = BLOCK, batch: int = BATCH, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``rows`` (vec_id,
    embedding); queries are the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    found = saved(vectors(rows, scale), "vectors")
    count = lambda n, size: max(1, -(-(n or 0) // size))
    asking = F.col("vec_id") % every == 0
    weight = F.col("dims") * F.when(F.col("wide"), 64).otherwise(8) + 32
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(asking, weight)).alias("bytes")).first()
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    many = count(total["n"], block)
    blocks = saved(_packed(found, spread(many), scale), "blocks")
    # tasks hold up to 32 blocks; small tables are spread out, as the work is in the scores
    parts = min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // 32))
    batches = count(total["bytes"], batch)
    asked = saved(_packed(found.where(asking), spread(batches), scale), "queries", found)
    near = None
    for number in range(batches):
        # about BATCH bytes, whatever the table's size
        packed = [r.asDict() for r in asked.where(F.col("part") == number).collect()]
        shared = spark.sparkContext.broadcast(packed)

        def scan(batches_: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asks = [(r["wide"], r["dims"], *_read(r)) for r in shared.value]
            best: dict[int, list] = {}  # row of the query -> (-score, id), the best first
            names = {}
            for got in batches_:
                for stored in got.to_pylist():
                    ids, rows_, flat = _read(stored)
                    here = Block(ids, rows_, flat)
                    for wide, dims, qids, qrows, qs in asks:
                        if dims != stored["dims"]:
                            continue
                        if wide or stored["wide"]:  # products of Python integers
                            qs = qs.astype(object)
                        for qid, qrow, q in zip(qids.tolist(), qrows.tolist(), qs, strict=True):
                            which, score = here.best(q, qrow, k)
                            names[qrow] = qid
                            best[qrow] = sorted(best.get(qrow, []) + [(-s, i) for s, i in zip(score.tolist(), which.tolist(), strict=True)])[:k]
            out = [(names[q], q, i, min(max(-s, _LEAST), _MOST), _order(-s)) for q, held in best.items() for s, i in held]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "own", "vec_id", "score", "beyond"])

        one = blocks.select("dims", "wide", "ids", "rows", "flat").repartition(parts).mapInArrow(scan, "query_id long, own long, vec_id long, score long, beyond binary")
        near = one if near is None else near.unionByName(one)
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
