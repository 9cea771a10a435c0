"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within ``radius`` bits differ by at most t_i bits in some part i, whenever the thresholds
of m parts add up to radius - m + 1 (a part with -1 is left out). Parts gather correlated bits; parts and
thresholds are chosen by dynamic programming on estimated candidate counts. Fingerprints that agree on a
part but for t_i masked bits meet in a bucket, where the distance is verified.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.common import id_type, map_arrow, text_key, text_rows
from quillmap.session import durable, store

#: A bucket with more fingerprints is split into cells of two blocks of this size each.
BLOCK = 4096


def fingerprint(words: list[bytes], digest, size: int = 3) -> int:
    """Majority of the bits of the hashes of all word shingles; of the whole text if it is shorter; 0 without words."""
    if not words:
        return 0
    n = len(words) - size + 1
    shingles = [b" ".join(words)] if n < 1 else map(b" ".join, zip(*[words[k:] for k in range(size)]))
    n = max(n, 1)
    hashes = np.fromiter(map(digest, shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, seed: int = 42, size: int = 3) -> DataFrame:
    """doc_id, a hash of the text, and the text's fingerprint as a signed long. A-Z are folded; white space is ASCII's."""

    def maker():
        import xxhash

        digest = lambda x: xxhash.xxh64_intdigest(x, seed)

        def step(batch):
            found = [fingerprint(t.encode("utf-8", "surrogatepass").lower().split(), digest, size) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "_key": batch.column("_key"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))}

        return step

    rows = text_rows(docs).select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    return map_arrow(rows, maker, f"doc_id {id_type(docs)}, _key bigint, fp bigint")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j; 64 rows a task are added up."""

    def task(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            both += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array(np.repeat(np.arange(64), 64), pa.int32()),
                "j": pa.array(np.tile(np.arange(64), 64), pa.int32()),
                "both": pa.array(both.ravel()),
                "n": pa.array(np.full(4096, n), pa.int64()),
            }
        )

    out, n = np.zeros((64, 64)), 0
    rows = classes.select("fp").mapInArrow(task, "i int, j int, both double, n bigint").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    for r in rows.collect():
        out[r.i, r.j], n = r.both, r.n
    return n, out


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size; each part takes the bits most correlated with those it has."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: (link[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on with the given sum and the least cost; costs[i][t + 1] is that of part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for k, extra in enumerate(own):
                key = done + k - 1
                if key not in new or cost + extra < new[key][0]:
                    new[key] = (cost + extra, [*chosen, k - 1])
        best = new
    return best[total]


def _mask(bits) -> int:
    """Bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def plan_parts(classes: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """Parts and thresholds with the least estimated work, of all numbers of parts in choices.

    Pairs that agree on a part are counted over all fingerprints. For t bits more they are estimated from
    how often two fingerprints agree on each bit. Work is candidates and twice the signatures.
    """
    n, both = bit_moments(classes)
    if n < 2:
        return []
    p = np.diag(both) / n
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1)
    plans = {m: correlated_parts(n, both, m) for m in choices}
    flat = [(m, i, bits) for m, parts in plans.items() for i, bits in enumerate(parts)]
    values = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for k, (_, _, bits) in enumerate(flat)])
    counts = classes.select(F.explode(values).alias("x")).groupBy("x.part", "x.v").agg(F.count("*").alias("n"))
    pairs = {r.part: r.pairs for r in counts.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, parts in plans.items():
        costs = []
        for k, (own, _, bits) in enumerate(flat):
            if own != m:
                continue
            symmetric = [1.0] + [0.0] * radius  # elementary symmetric sums of the odds to differ
            for b in bits:
                odds = (1 - agree[b]) / agree[b]
                for s in range(radius, 0, -1):
                    symmetric[s] += odds * symmetric[s - 1]
            costs.append([0.0] + [pairs.get(k, 0.0) * sum(symmetric[: t + 1]) * comb(len(bits), t) ** 0.5 + 2.0 * n * comb(len(bits), t) for t in range(radius + 1)])
        found = allocate(costs, radius - m + 1)
        if best is None or found[0] < best[0]:
            best = (*found, parts)
    return [(bits, t) for bits, t in zip(best[2], best[1]) if t >= 0]


def linked_stars(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: (root, member) pairs that connect what links inside each key.

    Every pair of a key is compared; only stars of connected values are given, at most one pair a row.
    """
    n = len(keys)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, d = np.arange(n - 1), 1
    while len(at):
        at = at[at + d < n]
        at = at[keys[at] == keys[at + d]]
        near = at[np.bitwise_count((values[at] ^ values[at + d]).view(np.uint64)) <= radius]
        for i in near[root[near] != root[near + d]].tolist():
            a, b = find(i), find(i + d)
            root[max(a, b)] = min(a, b)
        d += 1
    while (root != root[root]).any():
        root = root[root]
    member = np.flatnonzero(root != np.arange(n))
    return values[root[member]], values[member]


def link_edges(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges a < b between distinct fingerprints that connect all pairs within radius, not one row a pair."""
    plan = plan_parts(classes, radius)
    spark = classes.sparkSession
    if not plan:
        return spark.createDataFrame([], "a bigint, b bigint")
    masks = [_mask([b for b in bits if b not in gone]) for bits, t in plan for gone in combinations(bits, t)]
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(masks)])
    keys = F.transform(table, lambda x: F.xxhash64(x["k"], F.col("fp").bitwiseAND(x["m"])))
    rows = classes.select("fp", F.explode(keys).alias("key"))
    crowded = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    if not crowded.isEmpty():
        # a crowded bucket: every pair of its blocks is a cell of its own
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        split = rows.join(crowded, "key", "left").withColumn("_blocks", F.coalesce(blocks, F.lit(1)))
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("_blocks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
        rows = split.select("fp", F.explode(F.when(F.col("_blocks") == 1, F.array("key")).otherwise(others)).alias("key"))

    def verify(batches):
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def stars(k, v):
            a, b = linked_stars(k, v, radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

        for batch in batches:
            k = np.concatenate([held_keys, batch.column("key").to_numpy()])
            v = np.concatenate([held, batch.column("fp").to_numpy()])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            if whole:
                yield stars(k[:whole], v[:whole])
            held_keys, held = k[whole:], v[whole:]
        if len(held):
            yield stars(held_keys, held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint").distinct()


def _roots(point: DataFrame) -> DataFrame:
    """(a, to) with every pointer led to the end of its chain; each round triples the length that is jumped."""
    while True:
        far = point.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        farther = point.select(F.col("a").alias("to2"), F.col("to").alias("to3"))
        jumped = store(point.join(far, "to").join(farther, "to2").select("a", "to", F.col("to3")))
        point = jumped.select("a", F.col("to3").alias("to"))
        if jumped.where(F.col("to") != F.col("to3")).isEmpty():
            return point


def components(edges: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """node and the smallest node it is connected with, for all nodes of the edges.

    Each round points every node at its smallest neighbour, follows the pointers to their ends and contracts
    the edges to those ends. Only nodes without a smaller neighbour are ends, no two of them are neighbours, so
    each round leaves at most half of the nodes of every component, and a chain of rising ids needs one round.
    Rounds are written to the shared folder as tables, so a lost executor costs one task, and the size of a
    table is that of its files; the estimate of a checkpoint would be multiplied in each join and grow to a number
    of millions of digits. ``sizes`` gets the number of edges of each round.
    """
    edges = store(edges.where(F.col("a") != F.col("b")))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    result = store(nodes.withColumn("root", F.col("node")))
    while not edges.isEmpty():
        if sizes is not None:
            sizes.append(edges.count())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = _roots(store(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))))
        moved = result.join(point.withColumnRenamed("a", "root"), "root", "left")
        result = store(moved.select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(point.withColumnRenamed("to", "a2"), "a").select("a2", "b")
        right = left.join(point.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        pairs = right.where(F.col("a2") != F.col("b2")).select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = store(pairs.distinct())
    return result


def rooted_rows(docs: DataFrame, radius: int = 3, seed: int = 42, size: int = 3) -> DataFrame:
    """doc_id, _key, fp, and root: the smallest fingerprint that the row's own one is connected with."""
    found = durable(fingerprints(docs, seed, size))
    classes = durable(found.select("fp").distinct())
    roots = components(link_edges(classes, radius)).select(F.col("node").alias("fp"), "root")
    return found.join(roots, "fp", "left").select("doc_id", "_key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, seed: int = 42, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    Rows with one fingerprint form a class; classes within ``radius`` bits link; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint zero and link like any other. A null doc_id stays
    null and names no component unless it has no other row. Repeated rows keep their number; an empty table
    gives an empty result; extra columns are dropped.
    """
    rows = durable(rooted_rows(docs, radius, seed, size))
    # stored, so that the join can split the rows of a large component
    names = durable(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(names, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, seed: int = 42, size: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the smallest doc_id, null last, then the
    smallest hash of the text. Special cases as in near_duplicates.
    """
    rows = rooted_rows(docs, radius, seed, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("s")
    kept = rows.groupBy("root").agg(first).select(F.col("s.doc_id").alias("__llm_id"), F.col("s._key").alias("__llm_text"))
    kept = kept.select(F.xxhash64("__llm_id", "__llm_text").alias("__llm_row"), "__llm_id", "__llm_text")
    text = text_key(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("__llm_hash", text).withColumn("__llm_row", F.xxhash64("doc_id", "__llm_hash"))
    same = (keyed["__llm_row"] == kept["__llm_row"]) & keyed["doc_id"].eqNullSafe(kept["__llm_id"]) & (keyed["__llm_hash"] == kept["__llm_text"])
    joined = keyed.join(kept, same, "left_semi")
    # of rows that are equal in id and text one stays
    nth = F.row_number().over(Window.partitionBy("__llm_row", "doc_id", "__llm_hash").orderBy(F.lit(1)))
    return joined.withColumn("__llm_nth", nth).where(F.col("__llm_nth") == 1).select(*docs.columns)
