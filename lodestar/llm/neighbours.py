"""Most similar vectors for every vector: block matrix join.

Unit vectors are cut into blocks; every pair of blocks is one tile, one task. A
vector travels as int8 codes with a scale of its own (of a small set of scales)
and an int16 remainder. A tile multiplies the codes: products of whole numbers,
exact in single-precision BLAS. Vectors of one scale stand together, so a bound
on the product is one number per row. A product plus both quantisation errors is
never below the true cosine: only pairs that reach the current k-th best of either
side are recomputed in float, from codes and remainders, and merged into both
lists. The lists of a vector's tiles are merged last. Nothing is lost, so recall is
1; the price is quadratic work, in BLAS, each product made once.

Where only others of a least similarity are asked for (``least``), vectors meet in
near tiles instead: several tables of random rotations, in each of which a vector
lies in the cell of its greatest rotated coordinates. Cells grow in number with the
table, so a tile stays of one size and the work is in proportion to the vectors.
Codes are multiplied and bounded as above, pairs that may reach ``least`` are
recomputed in float. A pair at ``least`` exactly is met with probability 1 - ``MISS``
or more, a nearer one more surely; no found similarity is inexact. Where that would
need more than ``TABLES`` tables, all pairs of blocks are multiplied.

Vectors of equal direction (to six decimals) are searched once and expanded
afterwards, so many copies do not flood the lists.

Defined results:
* null, wrong-length, all-zero vectors and vectors with a null or non-finite
  element are neither queries nor answers;
* similarities have six decimals, equal ones are ordered by id; repeated ids are kept apart only by
  their vectors (an id is never its own neighbour);
* with fewer than ``k`` other vectors, all of them come out;
* empty tables give empty tables; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import Kept

#: A vector is shipped once per block. Few blocks ship little, many blocks give
#: many tasks: about ``BLOCKS`` of them (that number of tiles squared and halved),
#: of sides between the two sizes; a side takes about 0.5 KB a vector.
BLOCKS, LEAST, MOST = 4, 8_192, 262_144
SUB_ROWS, SUB_COLS = 512, 4_096
#: Scales are powers of this ratio; codes reach 127 at the scale.
STEP = 2.0 ** (1 / 8)
#: Near tiles: vectors a tile, chance to miss a pair at the least similarity, most
#: tables, bytes a task.
ROOM, MISS, TABLES, SHARE = 2_048, 1e-4, 32, 16 << 20


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, int16 remainders, int8 exponents of the scales)."""
    top = np.maximum(np.abs(u).max(1), 1e-30)
    power = np.clip(np.ceil(np.log(top) / np.log(STEP) - 1e-9), -127, 127).astype(np.int8)
    unit = (STEP ** power.astype(np.float64) / 127)[:, None]
    q = np.clip(np.rint(u / unit), -127, 127)
    r = np.clip(np.rint((u / unit - q) * 65534), -32767, 32767)
    return q.astype(np.int8), r.astype(np.int16), power


def rebuilt(q: np.ndarray, r: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Float32 vectors of codes, remainders and exponents."""
    unit = (STEP ** power.astype(np.float64) / 127)[:, None]
    return ((q + r / 65534) * unit).astype(np.float32)


class Block:
    """One side of a tile, ordered by scale: ``ids``, whole-number ``codes``, the
    vectors ``u`` rebuilt from codes and remainders, and the codes' ``error``."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, r: np.ndarray, power: np.ndarray) -> None:
        ids, first = np.unique(ids, return_index=True)  # repeated rows of one id
        self.place = np.argsort(power[first], kind="stable")  # among the ids in their order
        self.sorted_ids, self.ids = ids, ids[self.place]
        order = first[self.place]
        self.power = power[order]
        unit = (STEP ** self.power.astype(np.float64) / 127)[:, None]
        self.codes = q[order].astype(np.float32)
        self.u = rebuilt(q[order], r[order], self.power)
        # rebuilding and the six decimals round: a small allowance on top
        self.error = np.linalg.norm(self.u - self.codes * unit.astype(np.float32), axis=1) + np.float32(4e-6)

    def segments(self, size: int) -> list[tuple[int, int, float]]:
        """(from, to, scale), each of one scale, the largest first."""
        edges = np.flatnonzero(np.diff(self.power)) + 1
        out = []
        for a, b in zip([0, *edges], [*edges, len(self.ids)]):
            out += [(k, min(k + size, b), STEP ** float(self.power[a]) / 127) for k in range(a, b, size)]
        return sorted(out, key=lambda x: (x[0] - x[1], x[0]))


#: A found pair is one number that sorts by similarity, then by id: millionths
#: below 1, then the id's place among its block's ids.
PLACE_BITS, PAIR_BITS = 18, 39
NONE = np.int64(2**PAIR_BITS - 1)


class Lists:
    """The ``k`` best others of every vector so far, best first. Found pairs
    wait until ``settle`` merges them."""

    def __init__(self, n: int, k: int) -> None:
        self.best = np.full((n, k), NONE)
        self.last = np.full(n, -np.inf, np.float32)
        self.waiting: list[np.ndarray] = []

    def floors(self, a: int, b: int, products: np.ndarray | None, slack: np.ndarray) -> np.ndarray:
        """What a product plus its error must reach, for the vectors ``a`` to
        ``b``; ``products`` (a row each) stand in where a list is not full."""
        floor, k = self.last[a:b], self.best.shape[1]
        if products is not None and products.shape[1] > k:
            # one of the k + 1 best products may be the vector itself
            kth = -np.partition(-products, k, axis=1)[:, k]
            floor = np.maximum(floor, kth - slack)
        return floor - slack

    def open(self, a: int, b: int) -> bool:
        """Whether some list of the vectors ``a`` to ``b`` is not full."""
        return bool(np.isinf(self.last[a:b]).any())

    def add(self, rows: np.ndarray, places: np.ndarray, millionths: np.ndarray) -> None:
        pair = (1_000_000 - millionths) << PLACE_BITS | places
        good = pair < self.best[rows, -1]
        self.waiting.append(rows[good] << PAIR_BITS | pair[good])

    def settle(self) -> None:
        new = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.int64)
        self.waiting = []
        if not len(new):
            return
        k = self.best.shape[1]
        touched = np.unique(new >> PAIR_BITS)
        pairs = np.concatenate([((touched << PAIR_BITS)[:, None] | self.best[touched]).ravel(), new])
        pairs.sort()
        row = pairs >> PAIR_BITS
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        top = pairs[first[:, None] + np.arange(k)] & NONE
        self.best[touched] = top
        full = top[:, -1] != NONE
        self.last[touched] = np.where(full, 1 - (top[:, -1] >> PLACE_BITS) / 1e6, -np.inf)


def tile_top_k(a: Block, b: Block | None, k: int) -> tuple[Lists, Lists | None]:
    """The ``k`` best in ``b`` of every vector of ``a``, and the other way round;
    without ``b``, the ``k`` best others within ``a``."""
    other = a if b is None else b
    mine, theirs = Lists(len(a.ids), k), None if b is None else Lists(len(b.ids), k)
    columns = other.segments(SUB_COLS)
    due = 1  # the columns' lists settle after 1, 2, 3, 4, 6, 9... strips of rows
    for strip, (r0, r1, rs) in enumerate(a.segments(SUB_ROWS), 1):
        xe = a.error[r0:r1]
        for c0, c1, cs in columns:
            ye = other.error[c0:c1]
            scale = np.float32(rs * cs)
            p = a.codes[r0:r1] @ other.codes[c0:c1].T
            slack = xe + (1 + xe) * ye.max()
            hit = p >= (mine.floors(r0, r1, p * scale if mine.open(r0, r1) else None, slack) / scale)[:, None]
            if theirs is not None:
                slack = ye + (1 + ye) * xe.max()
                hit |= p >= theirs.floors(c0, c1, p.T * scale if theirs.open(c0, c1) else None, slack) / scale
            rows, cols = np.divmod(np.flatnonzero(hit), c1 - c0)
            rows, cols = rows + r0, cols + c0
            apart = a.ids[rows] != other.ids[cols]
            rows, cols = rows[apart], cols[apart]
            if not len(rows):
                continue
            exact = np.empty(len(rows))
            for h in range(0, len(rows), 50_000):
                part = slice(h, h + 50_000)
                exact[part] = np.einsum("ij,ij->i", a.u[rows[part]], other.u[cols[part]], dtype=np.float64)
            sim = np.rint(exact * 1e6).astype(np.int64)
            mine.add(rows, other.place[cols], sim)
            mine.settle()
            if theirs is not None:
                theirs.add(cols, a.place[rows], sim)
        if theirs is not None and strip >= due:
            theirs.settle()
            due = strip + max(strip // 2, 1)
    if theirs is not None:
        theirs.settle()
    return mine, theirs


def unit_rows(ids: np.ndarray, vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float32 unit vectors) of the usable vectors of a batch."""
    right = [k for k, v in enumerate(vectors) if v is not None and len(v) == dims]
    if not right:
        return ids[:0], np.empty((0, dims), np.float32)
    x = np.array([vectors[k] for k in right], dtype=np.float64)  # null elements become NaN
    top = np.abs(x).max(1)
    good = np.isfinite(x).all(1) & (top > 0)
    x = x[good] / top[good, None]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return ids[np.array(right)[good]], x.astype(np.float32)


def usable(df: DataFrame, ident: str, vector: str, dims: int) -> DataFrame:
    """``id, code, h1, h2``: the quantised unit vector (codes, remainders,
    exponent) as bytes, and a hash of its direction to six decimals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, u = unit_rows(b["id"].to_numpy("i8"), list(b["v"]), dims)
            rounded = [r.tobytes() for r in np.round(u.astype(np.float64), 6) + 0.0]
            h = [[xxhash.xxh64_intdigest(r, seed) - 2**63 for r in rounded] for seed in (1, 2)]
            q, r, power = quantise(u) if len(u) else (np.empty((0, dims), np.int8), np.empty((0, dims), np.int16), np.empty(0, np.int8))
            code = np.concatenate([q.view(np.uint8), np.ascontiguousarray(r).view(np.uint8).reshape(len(u), 2 * dims), power.view(np.uint8)[:, None]], 1)
            yield pd.DataFrame({"id": ids, "code": [c.tobytes() for c in code], "h1": h[0], "h2": h[1]})

    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return rows.mapInPandas(run, "id bigint, code binary, h1 bigint, h2 bigint")


def _pack(df: DataFrame) -> DataFrame:
    """(block, ids, codes) as bytes: one row per block and input batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, g in b.groupby("block"):
                ids = g["id"].to_numpy("<i8").tobytes()
                yield pd.DataFrame({"block": [block], "ids": [ids], "codes": [b"".join(g["code"])]})

    return df.mapInPandas(run, "block int, ids binary, codes binary")


def _opened(codes: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, remainders, exponents) of their bytes."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 3 * dims + 1)
    r = np.ascontiguousarray(raw[:, dims : 3 * dims]).view(np.int16)
    return raw[:, :dims].view(np.int8), r, np.ascontiguousarray(raw[:, -1]).view(np.int8)


def _block(parts: list[pd.DataFrame], dims: int) -> Block:
    ids = np.frombuffer(b"".join(x for p in parts for x in p["ids"]), "<i8")
    return Block(ids, *_opened([x for p in parts for x in p["codes"]], dims))


def tile_lists(heads: DataFrame, n: int, k: int, dims: int) -> DataFrame:
    """``id, other, sim`` (millionths): the ``k`` best of every tile."""
    blocks = math.ceil(n / min(max(math.ceil(n / BLOCKS), LEAST), MOST)) or 1
    packed = _pack(heads.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")))
    met = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = packed.select("block", met.alias("met"), "ids", "codes")
    low, high = F.least("block", "met"), F.greatest("block", "met")
    # tile (low, high), numbered row by row: one partition each
    tile = (low * blocks - (low * (low - 1) / 2).cast("int") + high - low).cast("int")
    sides = both.select(tile.alias("tile"), (F.col("block") > F.col("met")).cast("int").alias("side"), "ids", "codes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, list] = {}
        diagonal = False
        for b in batches:
            for side, g in b.groupby("side"):
                parts.setdefault(side, []).append(g)
        if not parts:
            return
        sorted_sides = [_block(parts[s], dims) for s in sorted(parts)]
        diagonal = len(sorted_sides) == 1
        if diagonal and 1 in parts or diagonal and not _on_diagonal(int(parts[0][0]["tile"].iloc[0]), blocks):
            return  # the tile's other block is empty
        lists = tile_top_k(sorted_sides[0], None if diagonal else sorted_sides[1], k)
        for block, other, found in zip(sorted_sides, reversed(sorted_sides), lists):
            for a in range(0, len(block.ids), 20_000):
                pair = found.best[a : a + 20_000].ravel()
                real = pair != NONE
                met = other.sorted_ids[pair[real] & (2**PLACE_BITS - 1)]
                sim = (1_000_000 - (pair[real] >> PLACE_BITS)).astype(np.int32)
                yield pd.DataFrame({"id": np.repeat(block.ids[a : a + 20_000], k)[real], "other": met, "sim": sim})

    tiles = blocks * (blocks + 1) // 2
    return sides.repartitionById(tiles, F.col("tile")).mapInPandas(run, "id bigint, other bigint, sim int")


def _on_diagonal(tile: int, blocks: int) -> bool:
    return tile in {low * blocks - low * (low - 1) // 2 for low in range(blocks)}


def meeting_chance(cosine: float, top: int, dims: int) -> float:
    """How often two vectors of that cosine have their greatest of ``top`` rotated
    coordinates, and its sign, in common: simulated, less three standard errors."""
    rng, n = np.random.default_rng(top), 20_000
    x, z = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-30)
    y = cosine * x + math.sqrt(max(1 - cosine * cosine, 0.0)) * z
    p = float((_corner(x[:, :top]) == _corner(y[:, :top])).mean())
    return p - 3 * math.sqrt(p * (1 - p) / n)


def _corner(y: np.ndarray) -> np.ndarray:
    """The place of a row's greatest coordinate and its sign as one number."""
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


def near_plan(n: int, dims: int, least: float) -> tuple[list[int], int]:
    """(coordinates of each rotation that names a cell, number of tables) for ``n``
    vectors; no table where too many would be needed."""
    tops, cells, chance = [], n / ROOM, 1.0
    while cells > 1:
        tops.append(min(2 ** max(math.ceil(math.log2(cells)) - 1, 0), 2 ** int(math.log2(dims))))
        cells /= 2 * tops[-1]
        chance *= max(meeting_chance(least, tops[-1], dims), 0.0)
    if chance >= 1:
        return tops, 1
    tables = math.ceil(math.log(MISS) / math.log1p(-chance)) if chance > 0 else TABLES + 1
    return tops, tables if tables <= TABLES else 0


def _rotations(tops: list[int], tables: int, dims: int) -> list[list[np.ndarray]]:
    rng = np.random.default_rng(11)
    turn = lambda top: np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :top].astype(np.float32)
    return [[turn(top) for top in tops] for _ in range(tables)]


def near_in_tile(ids: np.ndarray, codes: np.ndarray, power: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, others): pairs of a tile whose product plus error may reach ``least``
    and, of a vector with more than ``k`` of them, its ``k`` best."""
    if len(np.unique(ids)) < len(ids):  # repeated rows of one id
        rows = np.concatenate([ids.view(np.uint8).reshape(-1, 8), codes.view(np.uint8), power.view(np.uint8)[:, None]], 1)
        first = np.unique(rows, axis=0, return_index=True)[1]
        ids, codes, power = ids[first], codes[first], power[first]
    n, dims = codes.shape
    unit = (STEP ** power.astype(np.float64) / 127).astype(np.float32)
    x = codes.astype(np.float32) * unit[:, None]
    error = np.float32(0.5 * math.sqrt(dims)) * unit + np.float32(1e-5)
    slack = error + (1 + error) * error.max()
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max((1 << 21) // n, 1)
    for a in range(0, n, step):
        p = x[a : a + step] @ x.T
        hit = p >= np.float32(least) - slack[a : a + step, None]
        rows, cols = np.divmod(np.flatnonzero(hit), n)
        apart = ids[rows + a] != ids[cols]
        rows, cols = rows[apart], cols[apart]
        count = np.bincount(rows, minlength=len(p))
        if (count > k).any():
            product = p[rows, cols]
            order = np.lexsort((-product, rows))
            rows, cols, product = rows[order], cols[order], product[order]
            first = np.cumsum(count) - count
            floor = np.where(count > k, product[np.minimum(first + k - 1, len(product) - 1)] - 2 * slack[a : a + step], -np.inf)
            good = product >= floor[rows]
            rows, cols = rows[good], cols[good]
        out.append((ids[rows + a], ids[cols]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def near_lists(heads: DataFrame, n: int, k: int, dims: int, least: float, plan: tuple[list[int], int]) -> DataFrame:
    """``id, other, sim`` (millionths): others of at least that similarity, among
    them the ``k`` best of every vector."""
    tops, tables = plan
    width = 8 + 8 + dims + 1  # tile, id, codes, exponent
    tasks = max(math.ceil(n * tables * width / SHARE), 2 * heads.sparkSession.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = _rotations(tops, tables, dims)
        for b in batches:
            q, r, power = _opened(list(b["code"]), dims)
            u = rebuilt(q, r, power)
            rows = np.empty((len(b), width), np.uint8)
            rows[:, 8:16] = np.ascontiguousarray(b["id"].to_numpy("<i8")).view(np.uint8).reshape(-1, 8)
            rows[:, 16 : 16 + dims], rows[:, -1] = q.view(np.uint8), power.view(np.uint8)
            for t, table in enumerate(turns):
                tile = np.zeros(len(b), "<i8")
                for turn in table:
                    tile = tile * (2 * turn.shape[1]) + _corner(u @ turn)
                tile = tile * tables + t
                rows[:, :8] = tile.view(np.uint8).reshape(-1, 8)
                task = ((tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(tasks)
                order = np.argsort(task, kind="stable")
                ends = np.flatnonzero(np.append(np.diff(task[order]) != 0, True)) + 1
                starts = np.append(0, ends[:-1])
                sent = rows[order]
                yield pd.DataFrame({"task": task[order][starts].astype(np.int32), "part": [sent[i:j].tobytes() for i, j in zip(starts, ends)]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = np.frombuffer(b"".join(x for b in batches for x in b["part"]), np.uint8).reshape(-1, width)
        tile = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
        order = np.argsort(tile, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(tile[order]) != 0, True)) + 1 if len(order) else []
        start = 0
        for end in ends:
            rows, start = raw[order[start:end]], end
            if len(rows) > 1:
                ids = np.ascontiguousarray(rows[:, 8:16]).view("<i8").ravel()
                a, b = near_in_tile(ids, rows[:, 16 : 16 + dims].view(np.int8), np.ascontiguousarray(rows[:, -1]).view(np.int8), k, least)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (rebuilt(*_opened(list(b[c]), dims)) for c in ("x", "y"))
            sim = np.rint(np.einsum("ij,ij->i", x, y, dtype=np.float64) * 1e6).astype(np.int32)
            both = pd.DataFrame({"id": np.append(b["a"], b["b"]), "other": np.append(b["b"], b["a"]), "sim": np.append(sim, sim)})
            yield both[both["sim"] >= round(least * 1e6)]

    kept = Kept(heads.sparkSession)
    dealt = heads.select("id", "code").mapInPandas(deal, "task int, part binary").repartitionById(tasks, F.col("task"))
    pairs = kept.keep(dealt.mapInPandas(meet, "a bigint, b bigint").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = kept.keep(heads.select("id", "code").join(ids, "id", "left_semi"), "vectors")
    sides = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = sides.mapInPandas(exact, "id bigint, other bigint, sim int")
    return found.groupBy("id", "other").agg(F.max("sim").alias("sim"))


def neighbours(df: DataFrame, ident: str, vector: str, k: int = 10, dims: int = 64, least: float | None = None) -> DataFrame:
    """``id, other, cosine, rank``: the ``k`` most similar others of every
    usable vector; with ``least``, those among them of at least that cosine."""
    kept = Kept(df.sparkSession)
    units = kept.keep(usable(df, ident, vector, dims), "units")
    keyed = units.select("id", "h1", "h2")
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where(F.col("n") > 1)
    copies = kept.keep(keyed.join(groups, ["h1", "h2"]).select("id", "rep").distinct(), "copies")
    others = copies.where(F.col("id") != F.col("rep")).select("id")
    heads, n = units.select("id", "code").join(others, "id", "left_anti"), units.count()
    plan = near_plan(n, dims, least) if least is not None else ([], 0)
    rows = near_lists(heads, n, k, dims, least, plan) if plan[1] else tile_lists(heads, n, k, dims)
    if least is not None:
        rows = rows.where(F.col("sim") >= round(least * 1e6))
    if not copies.isEmpty():
        rows = _expanded(rows, copies, k)
    best = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("id", "other", (F.col("sim") / 1e6).alias("cosine"), "rank")


def _expanded(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The lists of representatives for all copies of them."""
    # copies of one direction: the k + 1 least ids stand for the rest as answers
    few = copies.withColumn("o", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("o") <= k + 1)
    members = few.select(F.col("id").alias("m"), F.col("rep").alias("mrep"))
    # a list is cut to its best k before it is expanded
    best = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    found = found.withColumn("o", F.row_number().over(best)).where(F.col("o") <= k).drop("o")
    answers = found.join(members, F.col("other") == F.col("mrep"), "left").select(
        F.col("id").alias("q"), F.coalesce("m", "other").alias("other"), "sim"
    )
    asked = copies.withColumnsRenamed({"id": "cid", "rep": "crep"})
    rows = answers.join(asked, F.col("q") == F.col("crep"), "left").select(F.coalesce("cid", "q").alias("id"), "other", "sim")
    own = copies.join(members, F.col("rep") == F.col("mrep")).where(F.col("id") != F.col("m")).select(
        "id", F.col("m").alias("other"), F.lit(1_000_000).alias("sim")
    )
    return rows.unionByName(own)
