"""Near-duplicate records: a MinHash LSH forest with exact verification.

Every text becomes its set of word shingles; equal sets are one record from then
on. The forest has ``trees`` tries. In each a record has a label: min-hashes,
one per level. The tries are kept sorted by label, each cut into runs of records
with a common prefix, and records are compared within their run only.

The prefix is chosen where the data lie. It begins at the full label and is
shortened level by level for as long as the run stays at most ``run`` records;
it never gets shorter than the floor, the longest prefix that meets a pair at
the threshold with the target recall if every trie uses it, 1-(1-t^d)^trees.
A record that stands in crowded runs keeps longer prefixes there and so may miss
partners. Its recall over all tries, 1 - product of (1-t^depth), is then summed
up, and where it is under the target all its prefixes are shortened to the floor.
So every record reaches the target recall, and no run is capped.

Found pairs are thinned by set size and by the agreement of one-bit min-hashes
(five standard deviations below the expectation at the threshold); what remains
is verified by the exact Jaccard similarity of the shingle sets, made again from
the texts of the surviving records alone.

Data flow: one map over the texts makes the signatures, kept in the shared
folder; one shuffle of (prefix, rest of label, number, size) sorts the tries; all
later tables hold found pairs only. Joins choose their kind by the true sizes of
kept tables.

Defined results:
* null, blank and too short texts have no shingles and no partner;
* equal sets have similarity 1, whatever their number;
* repeated rows are copies of each other; with equal ids they are one record
  (of different texts under one id the one with the least set hash counts);
* empty tables give empty tables; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import shingle_sets
from lodestar.session import Kept

DEEPEST = 16
#: One-bit min-hashes of a sketch.
BITS = 256
#: Levels below the floor that a crowded run may be split by, of 8 bits each.
LEVELS = 3
_FLIP = np.uint64(0xFF51AFD7ED558CCD)


def depth_for(threshold: float, trees: int, target: float) -> int:
    """The longest prefix that still meets the target recall at the threshold."""
    depth = DEEPEST
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def min_hashes(sets: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of every set under each function: a row per set. ``sets``
    holds the 32-bit elements of all sets, set ``i`` from ``starts[i]`` on."""
    out = np.full((len(starts), len(a)), np.iinfo(np.uint32).max, np.uint32)
    ends = np.append(starts[1:], len(sets))
    lo, block = 0, 4096
    with np.errstate(over="ignore"):
        while lo < len(sets):  # blocks of elements bound the memory, also of one long set
            hi = min(lo + block, len(sets))
            h = sets[lo:hi, None] * a + b
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            first = int(np.searchsorted(ends, lo, "right"))
            last = int(np.searchsorted(starts, hi, "left"))
            at = np.maximum(starts[first:last] - lo, 0)
            out[first:last] = np.minimum(out[first:last], np.minimum.reduceat(h, at, axis=0))
            lo = hi
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, n, dtype=np.uint32)


def _hashed_sets(texts: list, words: int, seen: dict[str, int]) -> tuple:
    """(row, start, n, h1, h2, elements) of the non-empty sets of a batch."""
    row, elements = shingle_sets(texts, words, seen)
    rows, starts, n = np.unique(row, return_index=True, return_counts=True)
    if not len(rows):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, elements
    with np.errstate(over="ignore"):
        h1 = np.bitwise_xor.reduceat(elements * _FLIP, starts)
        h2 = np.add.reduceat(elements * (elements >> np.uint64(7)), starts)
    return rows, starts, n, h1.view(np.int64), h2.view(np.int64), elements


def _few(pdf: pd.DataFrame, letters: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with at most so many letters (or one long text) each."""
    size = np.cumsum([len(t) if t else 0 for t in pdf["t"]]) // letters
    for _, part in pdf.groupby(size, sort=True):
        yield part


def signatures(df: DataFrame, ident: str, text: str, words: int, trees: int, floor: int) -> DataFrame:
    """``id, n, h1, h2`` (of the set), ``b0..b3`` (sketch) and ``label`` (the
    tries' floor prefixes and the levels below); no row without shingles."""
    names = ["id", "n", "h1", "h2", "b0", "b1", "b2", "b3", "label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _functions(max(trees * (floor + LEVELS), BITS))
        tree = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seen: dict[str, int] = {}
        for pdf in (p for batch in batches for p in _few(batch)):
            rows, starts, n, h1, h2, elements = _hashed_sets(list(pdf["t"]), words, seen)
            if not len(rows):
                continue
            m = min_hashes((elements >> np.uint64(16)).astype(np.uint32), starts, a, b)
            bits = np.packbits((m[:, :BITS] >> np.uint32(31 - 24) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
            with np.errstate(over="ignore"):
                key = np.repeat(tree[None, :], len(rows), 0)
                for k in range(floor):
                    key = (key ^ m[:, k * trees : (k + 1) * trees]) * _FLIP
                    key ^= key >> np.uint64(33)
                rest = np.zeros((len(rows), trees), np.uint32)
                for k in range(floor, floor + LEVELS):
                    level = (m[:, k * trees : (k + 1) * trees] * np.uint32(0x9E3779B1)) >> np.uint32(24)
                    rest = rest << np.uint32(8) | level
            label = np.concatenate([key.view(np.uint8), rest.view(np.uint8)], axis=1)
            out = {"id": pdf["id"].to_numpy()[rows], "n": n.astype(np.int32), "h1": h1, "h2": h2}
            out |= {f"b{k}": bits[:, k] for k in range(4)}
            yield pd.DataFrame(out | {"label": [x.tobytes() for x in label]})[names]

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident).alias("id"), F.col(text).alias("t")).mapInPandas(
        run, f"id {kind}, n int, h1 bigint, h2 bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, label binary"
    )


def trie_rows(heads: DataFrame, trees: int) -> DataFrame:
    """``k, rest, rid, n``: one row per record and trie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[i : i + 2000] for b in batches for i in range(0, len(b), 2000)):
            raw = np.frombuffer(b"".join(pdf["label"]), np.uint8).reshape(len(pdf), trees * 12)
            key = np.ascontiguousarray(raw[:, : trees * 8]).view(np.int64)
            rest = np.ascontiguousarray(raw[:, trees * 8 :]).view(np.int32)
            each = lambda c: np.repeat(pdf[c].to_numpy(), trees)
            yield pd.DataFrame({"k": key.ravel(), "rest": rest.ravel(), "rid": each("rid"), "n": each("n")})

    return heads.select("rid", "n", "label").mapInPandas(run, "k bigint, rest int, rid bigint, n int")


class _Trie:
    """Cuts sorted trie rows, as they come, into runs of at most ``most``
    records (larger only where the whole label is equal)."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.held = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32)]
        self.crowded: list[tuple | None] = [None] * (LEVELS + 1)

    def _prefix(self, rest: np.ndarray, level: int) -> np.ndarray:
        return rest >> (8 * (LEVELS - level))

    def feed(self, rows: list[np.ndarray] | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(complete rows, their run numbers, their levels below the floor)."""
        cols = self.held if rows is None else [np.concatenate(x) for x in zip(self.held, rows)]
        k, rest = cols[:2]
        n = len(k)
        depth = np.full(n, LEVELS, np.int32)
        safe = n
        known = self.crowded
        self.crowded = [None] * (LEVELS + 1)
        settled = False
        for level in range(LEVELS + 1):
            p = self._prefix(rest, level)
            new = np.ones(n, bool)
            new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
            run = np.cumsum(new) - 1
            size = np.bincount(run, minlength=1) if n else np.empty(0, np.int64)
            if n and known[level] == (k[0], p[0]):
                size[0] = self.most + 1  # its first records were cut off before
            fits = size[run] <= self.most if n else np.empty(0, bool)
            depth = np.where(fits & (depth == LEVELS), np.minimum(depth, level), depth)
            if rows is not None and n and not settled:
                if fits[-1] or level == LEVELS:  # the last run may go on: hold it back
                    safe, settled = int(np.flatnonzero(new)[-1]), True
                else:
                    self.crowded[level] = (k[-1], p[-1])
        self.held = [c[safe:] for c in cols]
        done, depth = [c[:safe] for c in cols], depth[:safe]
        cut = done[1] >> (8 * (LEVELS - depth))
        new = np.ones(safe, bool)
        new[1:] = (done[0][1:] != done[0][:-1]) | (depth[1:] != depth[:-1]) | (cut[1:] != cut[:-1])
        return done, np.cumsum(new), depth


def _run_pairs(run: np.ndarray, rid: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs whose sizes allow the threshold."""
    at, j = np.arange(len(run)), 0
    while len(at):
        j += 1
        at = at[at + j < len(run)]
        at = at[run[at + j] == run[at]]
        x, y = n[at], n[at + j]
        near = np.minimum(x, y) >= threshold * np.maximum(x, y)
        if near.any():
            yield rid[at[near]], rid[at[near] + j]


def matched(rows: DataFrame, threshold: float, most: int) -> DataFrame:
    """``a, b, k`` of sorted trie rows: pairs of records (a < b) that share a
    run, and for every record in a crowded run (a, -level, floor prefix)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _Trie(most)
        fed = ([b[c].to_numpy() for c in ("k", "rest", "rid", "n")] for b in batches)
        for rows in _then_none(fed):
            (k, _, rid, n), runs, depth = trie.feed(rows)
            deep = depth > 0
            if deep.any():
                yield pd.DataFrame({"a": rid[deep], "b": -depth[deep].astype(np.int64), "k": k[deep]})
            parts, held = [], 0
            for x, y in _run_pairs(runs, rid, n, threshold):
                parts.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                held += len(x)
                if held > 1_000_000:
                    yield _pair_frame(parts)
                    parts, held = [], 0
            if parts:
                yield _pair_frame(parts)

    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "rest", "rid")
    return sorted_rows.mapInPandas(run, "a bigint, b bigint, k bigint")


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _pair_frame(parts: list[np.ndarray]) -> pd.DataFrame:
    p = np.unique(np.concatenate(parts), axis=0)
    p = p[p[:, 0] != p[:, 1]]
    return pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "k": np.zeros(len(p), np.int64)})


def _agree(x: str, y: str) -> Column:
    """Share of equal one-bit min-hashes."""
    differ = sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(BITS // 64)), F.lit(0))
    return F.lit(1.0) - differ / BITS


def _candidates(found: DataFrame, threshold: float, trees: int, floor: int, target: float) -> DataFrame:
    """Distinct pairs, with the prefixes of all records that are still under the
    target recall shortened to the floor."""
    pairs = found.where(F.col("b") >= 0).select("a", "b")
    deep = found.where(F.col("b") < 0).select(F.col("a").alias("rid"), (-F.col("b")).alias("level"), "k")
    if deep.isEmpty():
        return pairs.distinct()
    missed = lambda d: F.log(F.lit(1.0) - F.pow(F.lit(threshold), d))
    at_floor = missed(F.lit(float(floor)))
    seen = deep.groupBy("rid").agg(F.sum(missed(floor + F.col("level")) - at_floor).alias("more"))
    short = seen.where(F.lit(1.0) - F.exp(F.lit(trees) * at_floor + F.col("more")) < target).select("rid")
    # a crowded run holds all records of its floor prefix, so it is its own partner table
    asking = deep.join(short, "rid", "left_semi").select("k", F.col("rid").alias("x"))
    met = asking.join(deep.select("k", F.col("rid").alias("y")), "k").where(F.col("x") != F.col("y"))
    return pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def shingle_table(df: DataFrame, ident: str, text: str, words: int) -> DataFrame:
    """``id, h1, h2, sh`` (shingle hashes) of every text with shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in (p for batch in batches for p in _few(batch)):
            rows, starts, _, h1, h2, elements = _hashed_sets(list(pdf["t"]), words, seen)
            sets = np.split(elements.view(np.int64), starts[1:]) if len(rows) else []
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "h1": h1, "h2": h2, "sh": sets})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident).alias("id"), F.col(text).alias("t")).mapInPandas(
        run, f"id {kind}, h1 bigint, h2 bigint, sh array<bigint>"
    )


def near_duplicates(
    df: DataFrame, ident: str, text: str, words: int = 5, threshold: float = 0.8, trees: int = 40, target: float = 0.99,
    run: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). pairs: ``rep_a, rep_b, jaccard`` between different
    sets; members: ``id, rep``, one row per record with shingles, ``rep`` being
    the least id with the same set. Both are tables in the shared folder."""
    floor = depth_for(threshold, trees, target)
    work, result = Kept(df.sparkSession), Kept(df.sparkSession)
    try:
        df = df.where(F.col(ident).isNotNull())
        sig = work.keep(signatures(df, ident, text, words, trees, floor), "signatures")
        slim = sig.select("id", "n", "h1", "h2")
        twice = slim.groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("s"), F.count("*").alias("c")).where("c > 1")
        same = slim.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
        copies = slim.join(same, ["h1", "h2", "n"]).select("id", "rep").distinct()
        twice, copies = work.keep(twice.select("id", "s.*"), "twice"), work.keep(copies, "copies")
        ids = slim.select("id").join(twice.select("id"), "id", "left_anti").unionByName(twice.select("id"))
        one = copies.groupBy("id").agg(F.min("rep").alias("rep"))
        members = result.keep(ids.join(one, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")), "members")
        heads = sig.join(copies.where(F.col("id") != F.col("rep")).select("id").distinct(), "id", "left_anti")
        if not twice.isEmpty():  # of the rows of one id a single one stands for it
            heads = heads.join(twice.select("id"), "id", "left_anti").unionByName(
                heads.join(twice, ["id", "h1", "h2", "n"], "left_semi").dropDuplicates(["id"])
            )
        heads = heads.withColumn("rid", F.monotonically_increasing_id())
        if not copies.isEmpty() or not twice.isEmpty():
            heads = work.keep(heads, "heads")
        else:
            heads = sig.withColumn("rid", F.monotonically_increasing_id())
        found = work.keep(matched(trie_rows(heads, trees), threshold, run), "found")
        candidates = _candidates(found, threshold, trees, floor, target)
        share = (1 + threshold) / 2
        least = share - 5 * (share * (1 - share) / BITS) ** 0.5
        side = lambda r, p: heads.select(F.col("rid").alias(r), F.col("n").alias(f"{p}n"), *[F.col(f"b{k}").alias(f"{p}{k}") for k in range(4)])
        thin = (
            candidates.join(side("a", "x"), "a")
            .join(side("b", "y"), "b")
            .where((F.least("xn", "yn") >= F.lit(threshold) * F.greatest("xn", "yn")) & (_agree("x", "y") >= least))
            .select("a", "b")
        )
        thin = work.keep(thin, "thin")
        needed = thin.select(F.col("a").alias("rid")).unionByName(thin.select(F.col("b").alias("rid"))).distinct()
        needed = work.keep(heads.select("rid", "id", "h1", "h2").join(needed, "rid", "left_semi"), "needed")
        texts = df.join(needed.select(F.col("id").alias("__need")), F.col(ident) == F.col("__need"), "left_semi")
        sets = shingle_table(texts, ident, text, words).dropDuplicates(["id", "h1", "h2"]).join(needed, ["id", "h1", "h2"])
        sets = work.keep(sets.select("rid", "id", "sh"), "sets")
        both = thin.join(sets.select(F.col("rid").alias("a"), F.col("id").alias("ia"), F.col("sh").alias("sa")), "a").join(
            sets.select(F.col("rid").alias("b"), F.col("id").alias("ib"), F.col("sh").alias("sb")), "b"
        )
        common = F.size(F.array_intersect("sa", "sb"))
        jaccard = common / (F.size("sa") + F.size("sb") - common)
        pairs = both.select(F.least("ia", "ib").alias("rep_a"), F.greatest("ia", "ib").alias("rep_b"), jaccard.alias("jaccard"))
        return result.keep(pairs.where(F.col("jaccard") >= threshold), "pairs"), members
    finally:
        work.drop()


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of all records, copies expanded."""
    m = lambda n, r: members.select(F.col("id").alias(n), F.col("rep").alias(r))
    across = pairs.join(m("x", "rep_a"), "rep_a").join(m("y", "rep_b"), "rep_b")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = m("id_a", "r").join(m("id_b", "r"), "r").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    return across.unionByName(within)


def _roots(parent: DataFrame, rounds: Kept) -> DataFrame:
    """``v, p`` with every parent replaced by the root of its tree, by pointer
    doubling; a root is its own parent."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = rounds.keep(parent.join(up, "p").select("v", F.col("q").alias("p"), F.col("p").alias("old")))
        parent = step.select("v", "p")
        if step.where(F.col("p") != F.col("old")).isEmpty():
            return parent


def _contract(links: DataFrame, label: DataFrame, rounds: Kept) -> tuple[DataFrame, DataFrame]:
    """One round: every class with a link picks its least one, ordered by (lower
    label, higher label), so picks form trees whose only cycle is the one link
    that both its ends picked; the lower of them is the root and the least label
    of its tree. Each tree becomes one class."""
    least = F.min(F.struct(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")))
    pick = links.groupBy(F.col("s").alias("v")).agg(least.alias("e"))
    pick = rounds.keep(pick.select("v", F.when(F.col("e.lo") == F.col("v"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p")))
    back = pick.select(F.col("v").alias("p"), F.col("p").alias("q"))
    met = F.when(F.col("q") == F.col("v"), F.least("v", "p")).otherwise(F.col("p"))
    root = _roots(rounds.keep(pick.join(back, "p").select("v", met.alias("p"))), rounds)
    label = label.join(root.select(F.col("v").alias("c"), "p"), "c", "left")
    label = rounds.keep(label.select("v", F.coalesce("p", "c").alias("c"), "deg"))
    links = links.join(root.select(F.col("v").alias("s"), F.col("p").alias("ps")), "s").join(
        root.select(F.col("v").alias("t"), F.col("p").alias("pt")), "t"
    )
    links = links.where(F.col("ps") != F.col("pt")).select(F.col("ps").alias("s"), F.col("pt").alias("t")).distinct()
    return rounds.keep(links), label


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id, class_id, n_links``: connected components by contraction, until no
    link between different classes is left; every round at least halves the
    classes that still have links, whatever the graph looks like. ``n_links``
    counts a class representative's links to other sets."""
    rounds = Kept(pairs.sparkSession)
    both = rounds.keep(pairs.select(F.col("rep_a").alias("s"), F.col("rep_b").alias("t")))
    links = rounds.keep(both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"))))
    label = rounds.keep(links.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("deg")).withColumn("c", F.col("v")))
    try:
        while not links.isEmpty():
            links, label = _contract(links, label, rounds)
        label = Kept(pairs.sparkSession).keep(label, "classes")
    finally:
        rounds.drop()
    return members.join(label, F.col("rep") == F.col("v"), "left").select(
        "id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("deg", F.lit(0)).alias("n_links")
    )
