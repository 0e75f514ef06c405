"""Agreement of stored views with asked ones in blocks: a pair of blocks is a few matrices, which shrink to queries by products before they leave the worker.

A chunk of rows meets a block of queries as a cogroup, whose rows travel one by one, so that neither the JVM nor a worker holds more than one chunk and one block. There
they lie side by side as arrays, and a tile of some queries and all rows of the chunk goes through each term in place. What goes on is a row for each query and
product of a chunk (of a distance from a shot, what the plan asks for), not one for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswell.functions.hashes import FAR
from brasswell.operators import decisions

#: Rows of either side in a block, at least and at most, by expectation; between them, so many pairs of blocks are made.
LEAST, MOST, PAIRS = 250, 8000, 200
#: Rows that a pair of blocks may give, at most: they leave the worker as one table.
GIVEN = 1 << 22
#: Pairs of rows in a tile: its arrays stay in a core's cache.
TILE = 1 << 17
NUMBERS = ("aspect", "fill", "holes", "comps", "density")
HASHES, HISTOGRAMS = ("dh", "ph", "ah"), ("orientation", "radial")
#: Components of a difference that are summed between looks at what is still short of the most that counts.
STRIDE = 8

Side = dict[str, np.ndarray]


def cells(df: DataFrame, *ids: str) -> DataFrame:
    """The ids, vector and signature of the rows that have a vector, as columns."""
    lists = [F.col(f"s.{c}").alias(c) for c in (*HASHES, *HISTOGRAMS)]
    return df.where("e is not null").select(*ids, "e", *(F.col(f"s.{c}").cast("double").alias(c) for c in NUMBERS), *lists)


def meeting(rows: DataFrame, asked: DataFrame, number: Column, block: Column, run: Callable[[Side, Side], Iterator[list]], schema: str, group: Column) -> DataFrame:
    """What run(rows, queries) gives for each pair of a chunk of rows (dealt by ``number``) and a block of queries (by ``block``), apart for each two lengths of vectors:
    a row for each query and ``group`` of the chunk's rows at most."""
    n, groups = rows.agg(F.count("*"), F.approx_count_distinct(group)).first()
    m = asked.count()
    size = min(MOST, max(LEAST, isqrt(n * m // PAIRS)), max(isqrt(GIVEN), GIVEN // max(1, groups)))
    chunks, blocks = -(-n // size) or 1, -(-m // size) or 1
    mine, other = (F.pmod(F.xxhash64(c), F.lit(k)).cast("long") for c, k in ((number, chunks), (block, blocks)))
    all_of = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    left = rows.select("*", mine.alias("_own")).select("*", F.explode(all_of(blocks)).alias("_k")).withColumn("_pair", F.col("_own") * blocks + F.col("_k")).drop("_own", "_k")
    right = asked.select("*", other.alias("_own")).select("*", F.explode(all_of(chunks)).alias("_k")).withColumn("_pair", F.col("_k") * blocks + F.col("_own")).drop("_own", "_k")

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        made = [pa.record_batch(x, schema=told) for v in _sides(a) for q in _sides(b) for x in run(v, q)]
        return pa.Table.from_batches(made, schema=told)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.sparkSession.createDataFrame([], schema).schema
    told = to_arrow_schema(kind)
    return left.groupBy("_pair").cogroup(right.groupBy("_pair")).applyInArrow(one, kind)


def _sides(table: pa.Table) -> list[Side]:
    """Arrays of a table's columns, lists as matrices, for the rows of each length of vectors."""
    if not table.num_rows:
        return []
    columns = {c: x.combine_chunks() for c, x in zip(table.column_names, table.columns, strict=True) if c != "_pair"}
    dims, out = columns["e"].value_lengths().to_numpy(zero_copy_only=False), []
    for dim in np.unique(dims):
        some = columns if (dims == dim).all() else {c: x.filter(pa.array(dims == dim)) for c, x in columns.items()}
        n = len(some["e"])
        out.append({c: x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False) for c, x in some.items()})
        out[-1]["e"] = out[-1]["e"].astype(float, copy=False)
    return out


def _ordered(v: Side, by: str) -> tuple[Side, np.ndarray]:
    """The rows in order, and where each value begins."""
    order = np.argsort(v[by], kind="stable")
    v = {c: x[order] for c, x in v.items()}
    return v, np.flatnonzero(np.append(True, v[by][1:] != v[by][:-1]))


def _tiles(n: int, rows: int, tile: int) -> Iterator[slice]:
    step = max(1, tile // max(1, rows))
    return (slice(a, a + step) for a in range(0, n, step))


def _lined(a: Side, b: Side, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Both histograms at length one, and where the product of the lengths is up to 1e-9, so that there is no cosine."""
    length = [np.sqrt((x[name] * x[name]).sum(axis=1)) for x in (a, b)]
    units = [x[name] / np.maximum(n, 1e-300)[:, None] for x, n in zip((a, b), length, strict=True)]
    none = np.multiply.outer(*length) <= 1e-9 if length[0].min() * length[1].min() <= 1e-9 else None
    return *units, none


def structures(a: Side, b: Side) -> np.ndarray:
    """Structure agreement of each signature of a with each of b, before it is held in [0, 1]. A term that falls from its weight is what it falls by; all weights are added
    at the end."""
    w, base = decisions.TERMS, 0.0
    total = np.zeros((len(a["fill"]), len(b["fill"])))
    term, other = np.empty_like(total), np.empty_like(total)
    for name in HISTOGRAMS:
        x, y, none = _lined(a, b, name)
        np.matmul(x * w[name], y.T, out=term)
        if none is not None:
            term[none] = 0.0
        total += term
    for name, more in (("aspect", 0.0), ("density", 1e-6)):  # least / max(1e-6, greatest)
        x, y = a[name] + more, b[name] + more
        np.multiply.outer(x * w[name], 1 / np.maximum(y, 1e-6), out=term)
        np.multiply.outer(w[name] / np.maximum(x, 1e-6), y, out=other)
        total += np.minimum(term, other, out=term)
    for name, width in (("fill", None), ("holes", 4), ("comps", 6)):
        part = w[name] / (width or 1)
        np.abs(np.subtract.outer(a[name] * part, b[name] * part, out=term), out=term)
        total -= term if width is None else np.minimum(term, w[name], out=term)
        base += w[name]
    return np.add(total, base, out=total)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Different bits of each hash of a (rows of longs) and each of b."""
    if a.shape[1] != b.shape[1]:
        return np.full((len(a), len(b)), FAR, np.int64)
    a, b = a.view(np.uint64), b.view(np.uint64)  # of a negative number the bits of its amount would count
    total = np.zeros((len(a), len(b)), np.uint16 if a.shape[1] < 1024 else np.int64)
    bits, count = np.empty(total.shape, np.uint64), np.empty(total.shape, np.uint8)
    for k in range(a.shape[1]):
        np.bitwise_xor(a[:, k, None], b[None, :, k], out=bits)
        total += np.bitwise_count(bits, out=count)
    return total


def _distances(dh: np.ndarray, ph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least hash distance of each group. Small numbers of bits are looked up: their distances in order are places in a table, and the least place is taken."""
    if dh.dtype != np.uint16 or ph.dtype != np.uint16 or (most := int(ph.max()) + 1) * (int(dh.max()) + 1) > 1 << 20:
        return np.minimum.reduceat(decisions.hash_distance(dh.astype(float), ph.astype(float)), starts, axis=1)
    all_ = decisions.hash_distance(np.arange(int(dh.max()) + 1.0)[:, None], np.arange(float(most))[None, :])
    values, place = np.unique(all_.ravel(), return_inverse=True)
    at = dh.astype(np.uint32) * np.uint32(most) + ph
    return values[np.minimum.reduceat(place.astype(np.uint32).take(at), starts, axis=1)]


def _claims(some: Side, v: Side, dh: np.ndarray, ph: np.ndarray, structure: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least hash distance of each group's near-duplicates, infinity without one. Few pairs are near by their first hash; only those are looked at."""
    tests = (decisions.DUPLICATE, decisions.RESCALED)
    out = np.full((len(dh), len(starts)), np.inf)
    row, at = np.nonzero(dh <= max(t[0] for t in tests))
    if len(row):
        d, p, s = dh[row, at], ph[row, at], np.minimum(1.0, structure[row, at])
        same = some["ah"].shape[1] == v["ah"].shape[1]
        a = np.bitwise_count((some["ah"][row] ^ v["ah"][at]).view(np.uint64)).sum(axis=1, dtype=np.int64) if same else np.full(len(row), FAR)
        holds = np.logical_or.reduce([(d <= t[0]) & (p <= t[1]) & (a <= t[2]) & (s >= t[3]) for t in tests])
        group = np.searchsorted(starts, at[holds], side="right") - 1
        np.minimum.at(out, (row[holds], group), decisions.hash_distance(d[holds].astype(float), p[holds].astype(float)))
    return out


SIGNALS = ("dot", "structure", "distance", "claim")


def bests(rows: DataFrame, asked: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """query, product and the wanted ones of the greatest dot and structure, the least distance, claim and dh, over rows (product, vec_id, e, s) and asked (query, e, s)."""

    def run(v: Side, q: Side) -> Iterator[list]:
        v, starts = _ordered(v, "product")
        for cut in _tiles(len(q["query"]), len(v["product"]), TILE):
            some, told = {c: x[cut] for c, x in q.items()}, {}
            if "dot" in wanted:
                alike = some["e"].shape[1] == v["e"].shape[1]
                told["dot"] = np.maximum.reduceat(some["e"] @ v["e"].T, starts, axis=1) if alike else np.full((len(some["query"]), len(starts)), -np.inf)
            if {"structure", "claim"} & set(wanted):
                structure = structures(some, v)
                told["structure"] = np.clip(np.maximum.reduceat(structure, starts, axis=1), 0.0, 1.0)
            if {"distance", "claim", "dh"} & set(wanted):
                dh = apart(some["dh"], v["dh"])
                told["dh"] = np.minimum.reduceat(dh, starts, axis=1).astype(np.int64)
            if {"distance", "claim"} & set(wanted):
                ph = apart(some["ph"], v["ph"])
                told["distance"] = _distances(dh, ph, starts)
            if "claim" in wanted:
                told["claim"] = _claims(some, v, dh, ph, structure, starts)
            values = [pa.array(told[c].ravel(), mask=np.isinf(told[c].ravel()) if c == "claim" else None) for c in wanted]
            yield [pa.array(np.repeat(some["query"], len(starts))), pa.array(np.tile(v["product"][starts], len(some["query"]))), *values]

    schema = ", ".join(f"{c} {'long' if c in ('query', 'product', 'dh') else 'double'}" for c in ("query", "product", *wanted))
    found = meeting(cells(rows, "product", "vec_id"), cells(asked, "query"), F.col("vec_id"), F.col("query"), run, schema, F.col("product"))
    best = lambda c: (F.max if c in ("dot", "structure") else F.min)(c).alias(c)
    return found.groupBy("query", "product").agg(*map(best, wanted))


def agreements(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query, product, vector, structure, hash and claim, as decisions.signals() gives them, of rows (product, vec_id, e, s) and asked (query, e, s)."""
    return decisions.agreed(bests(rows, asked, SIGNALS))


def _capped(v: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Sums of the absolute differences of each row of q and each of v, from the first component on, or ``most`` where they reach it. Once few sums of a tile are short of
    it, only those are carried on: a sum of such terms never falls."""
    total = np.zeros((len(q), len(v)))
    term, columns = np.empty_like(total), np.ascontiguousarray(v.T)
    for k in range(q.shape[1]):
        if k and k % STRIDE == 0 and np.count_nonzero(total < most) * 16 < total.size:
            row, at = np.nonzero(total < most)
            left = np.abs(q[row, k:] - v[at, k:])
            left[:, 0] += total[row, at]
            total[row, at] = np.cumsum(left, axis=1)[:, -1]  # in order, as the others
            break
        np.subtract(q[:, k, None], columns[k], out=term)
        total += np.abs(term, out=term)
    return np.minimum(total, most, out=total)


def _legacy(v: Side, q: Side) -> np.ndarray:
    """The legacy distance, to eleven places, of each query from each row. Vectors of two lengths have the most that differences count."""
    dh, ph, ah = (apart(q[c], v[c]) for c in HASHES)
    l1 = _capped(v["e"], q["e"], 2.0) if v["e"].shape[1] == q["e"].shape[1] else np.full(dh.shape, 2.0)
    total, term = np.multiply(dh, 0.45), np.empty(dh.shape)
    total /= 256
    for h, weight in ((ph, 0.25), (ah, 0.10)):
        np.multiply(h, weight, out=term)
        term /= 64
        total += term
    l1 /= 2
    l1 *= 0.20
    total += l1
    return np.round(total, 11, out=total)


def legacy(rows: DataFrame, asked: DataFrame, shot: Column, by: str = "") -> DataFrame:
    """shot, vec_id, product, d: the least legacy distance of each row (product, vec_id, e, s) from the queries (query, e, s) of a shot. All queries of a shot are in one block
    and all rows of a vec_id in one chunk, so what a worker gives for them is the result. by: "product" keeps the nearest row (then the least vec_id) of each shot and product,
    "shot" the nearest of each shot; those of each chunk are compared again."""

    def nearest(d: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows that are in order of ids inside each group, the place of the first least one of each group."""
        least = np.minimum.reduceat(d, starts, axis=1)
        ends = np.append(starts[1:], d.shape[1])
        if len(starts) * 8 < d.shape[1]:
            return np.stack([a + d[:, a:b].argmin(axis=1) for a, b in zip(starts, ends, strict=True)], axis=1)
        first = np.where(d == np.repeat(least, ends - starts, axis=1), np.arange(d.shape[1]), d.shape[1])
        return np.minimum.reduceat(first, starts, axis=1)

    def run(v: Side, q: Side) -> Iterator[list]:
        order = np.lexsort((v["vec_id"], v["product"])) if by != "shot" else np.argsort(v["vec_id"], kind="stable")
        v = {c: x[order] for c, x in v.items()}
        n = len(order)
        if by == "shot":
            starts = np.array([0])
        else:
            new = v["product"][1:] != v["product"][:-1]
            starts = np.flatnonzero(np.append(True, new if by else new | (v["vec_id"][1:] != v["vec_id"][:-1])))
        q, shots = _ordered(q, "shot")
        bounds = np.append(shots, len(q["shot"]))
        step, a = max(1, TILE // n), 0
        while a < len(shots):  # as many shots as a tile has room for, one at least
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
            least = np.full((b - a, n), np.inf)
            for k in range(bounds[a], bounds[b], step):  # a shot of more queries is cut
                upto = min(k + step, bounds[b])
                d = _legacy(v, {c: x[k:upto] for c, x in q.items()})
                at = np.searchsorted(bounds[a : b + 1], np.arange(k, upto), side="right") - 1
                cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                least[at[cuts]] = np.minimum(least[at[cuts]], np.minimum.reduceat(d, cuts, axis=0))
            at = nearest(least, v["vec_id"], starts) if by else np.broadcast_to(starts, (b - a, len(starts)))
            d = np.take_along_axis(least, at, axis=1) if by else np.minimum.reduceat(least, starts, axis=1)
            yield [pa.array(np.repeat(q["shot"][shots[a:b]], len(starts))), *(pa.array(v[c][at.ravel()]) for c in ("vec_id", "product")), pa.array(d.ravel())]
            a = b

    queries = cells(asked.withColumn("shot", shot.cast("long")), "shot")
    group = {"": F.col("vec_id"), "product": F.col("product"), "shot": F.lit(0)}[by]
    return meeting(cells(rows, "product", "vec_id"), queries, F.col("vec_id"), F.col("shot"), run, "shot long, vec_id long, product long, d double", group)


def near_counts(rows: DataFrame, asked: DataFrame, floor: float) -> DataFrame:
    """query, met, near: rows (vec_id, e) of the query's (query, e) dimension, and those of them whose dot product is over the floor. Products close to it are summed again in
    order of the components, since a matrix product adds in another order."""

    def run(v: Side, q: Side) -> Iterator[list]:
        if v["e"].shape[1] != q["e"].shape[1]:
            return
        most = np.sqrt((v["e"] * v["e"]).sum(axis=1).max())
        for cut in _tiles(len(q["query"]), len(v["vec_id"]), TILE):
            some, ids = q["e"][cut], q["query"][cut]
            dot = some @ v["e"].T
            near = dot > floor
            slack = 1e-13 * (1 + most * np.sqrt((some * some).sum(axis=1).max()))
            row, at = np.nonzero(np.abs(dot - floor) < slack)
            if len(row):
                near[row, at] = np.cumsum(some[row] * v["e"][at], axis=1)[:, -1] > floor
            yield [pa.array(ids), pa.array(np.full(len(ids), len(v["vec_id"]))), pa.array(near.sum(axis=1, dtype=np.int64))]

    plain = [df.where("e is not null").select(c, "e") for df, c in ((rows, "vec_id"), (asked, "query"))]
    found = meeting(*plain, F.col("vec_id"), F.col("query"), run, "query long, met long, near long", F.lit(0))
    return found.groupBy("query").agg(F.sum("met").alias("met"), F.sum("near").alias("near"))
