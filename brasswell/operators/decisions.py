"""Image search decisions from signals: structure, hash and vector agreement, fusion, near-duplicate claims, and the final verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.columns import clamped, cosine, half_up
from brasswell.functions.hashes import hamming

#: Weights of vector, structure and hash agreement (fixed values), by provider.
WEIGHTS = {"local": (0.32, 0.34, 0.34), "other": (0.5, 0.25, 0.25), "remote": (0.78, 0.10, 0.12)}
#: Largest distances of the three hashes (of 256, 64 and 64 bits) and least structure agreement of a near-duplicate, and of a rescaled one (fixed values).
DUPLICATE, RESCALED = (16, 5, 5, 0.86), (20, 6, 6, 0.95)
#: A winner is clear at this share of the rival's distance, or if the rival is farther than the second (fixed values).
MARGIN, RIVAL = 0.55, 0.12
#: Terms of the structure agreement (fixed values).
TERMS = {"aspect": 0.2, "fill": 0.14, "holes": 0.18, "comps": 0.12, "orientation": 0.16, "radial": 0.14, "density": 0.06}


def ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(F.lit(1e-6), F.greatest(a, b))


def structure_agreement(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Seven weighted terms in [0, 1] from columns aspect, fill, holes, comps, orientation, radial and density of two signatures."""
    gap = lambda name, width: F.greatest(F.lit(0.0), 1 - F.abs(a[name] - b[name]) / width)
    terms = {
        "aspect": ratio(a["aspect"], b["aspect"]),
        "fill": 1 - F.abs(a["fill"] - b["fill"]),
        "holes": gap("holes", 4),
        "comps": gap("comps", 6),
        "orientation": cosine(a["orientation"], b["orientation"]),
        "radial": cosine(a["radial"], b["radial"]),
        "density": ratio(a["density"] + 1e-6, b["density"] + 1e-6),
    }
    total = F.lit(0.0)
    for name, weight in TERMS.items():
        total = total + terms[name] * F.lit(weight)
    return clamped(total, 0.0, 1.0)


def hash_distance(dh: Column, ph: Column) -> Column:
    return 0.6 * dh / 256 + 0.4 * ph / 64


def legacy_distance(dh: Column, ph: Column, ah: Column, l1: Column) -> Column:
    return 0.45 * dh / 256 + 0.25 * ph / 64 + 0.10 * ah / 64 + 0.20 * F.least(F.lit(1.0), l1 / 2)


def legacy_score(distance: Column, duplicate: float = 0.07) -> Column:
    return F.when(distance <= duplicate, 99).otherwise(clamped(half_up(99 - distance * 55), 55, 92)).cast("long")


def near_duplicate(dh: Column, ph: Column, ah: Column, structure: Column) -> Column:
    """The path by which two signatures count as one image; null if by none."""
    holds = lambda t: (dh <= t[0]) & (ph <= t[1]) & (ah <= t[2]) & (structure >= t[3])
    return F.when(holds(DUPLICATE), "near-duplicate").when(holds(RESCALED), "rescaled")


def fused(vector: Column, structure: Column, hashed: Column, provider: str = "local") -> Column:
    v, s, h = WEIGHTS[provider]
    return vector * F.lit(v) + structure * F.lit(s) + hashed * F.lit(h)


def signals(pairs: DataFrame) -> DataFrame:
    """query, product, vector, structure, hash (agreements), claim (distance of the nearest near-duplicate pair, null if none) from
    pairs (query, product, dot, structure, dh, ph, ah): the best over all views of both, summed before the shuffle."""
    distance = hash_distance(F.col("dh"), F.col("ph"))
    claim = F.when(near_duplicate(F.col("dh"), F.col("ph"), F.col("ah"), F.col("structure")).isNotNull(), distance)
    best = pairs.groupBy("query", "product").agg(F.max("dot").alias("dot"), F.max("structure").alias("structure"), F.min(distance).alias("distance"), F.min(claim).alias("claim"))
    return agreed(best)


def agreed(best: DataFrame) -> DataFrame:
    """The agreements from query, product, claim and the best dot, structure and distance."""
    hashed = F.greatest(F.lit(0.0), 1 - F.col("distance"))
    return best.select("query", "product", clamped(F.coalesce("dot", F.lit(0.0)), 0.0, 1.0).alias("vector"), F.coalesce("structure", F.lit(0.0)).alias("structure"), F.coalesce(hashed, F.lit(0.0)).alias("hash"), "claim")


def scored(found: DataFrame, provider: str = "local") -> DataFrame:
    """Signals with combined (to nine places) and rank among the query's products."""
    combined = F.round(fused(F.col("vector"), F.col("structure"), F.col("hash"), provider), 9)
    return found.withColumn("combined", combined).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("combined"), "product")))


def guarded(rows: DataFrame) -> DataFrame:
    """query, claimants, winner, distance, rival and exact: one product claims the image and stands clear of its nearest rival."""
    first = F.min(F.when(F.col("claim").isNotNull(), F.struct("rank", "product", "claim"))).alias("w")
    won = rows.groupBy("query").agg(F.count("claim").alias("claimants"), first).withColumnRenamed("query", "asked")
    rivals = rows.join(won, F.col("query") == F.col("asked")).groupBy("query", "claimants", "w").agg(F.min(F.when(F.col("product") != F.col("w.product"), 1 - F.col("hash"))).alias("rival"))
    clear = F.col("rival").isNull() | (F.col("w.claim") <= F.col("rival") * MARGIN) | (F.col("rival") > RIVAL)
    return rivals.select("query", "claimants", F.col("w.product").alias("winner"), F.col("w.claim").alias("distance"), "rival", ((F.col("claimants") == 1) & clear).alias("exact"))


def similar_fill(rows: DataFrame, floor: float, fill: float, least: int, most: int) -> DataFrame:
    """query, product, rank of the products to show: those from the floor up, at most ``most``; if there are some but fewer than
    ``least``, the next from the fill floor up to that number."""
    primary = F.count_if(F.col("combined") >= floor).over(Window.partitionBy("query"))
    upto = F.when(F.col("primary") >= least, F.least("primary", F.lit(most))).when(F.col("primary") > 0, F.lit(least)).otherwise(0)
    shown = rows.withColumn("primary", primary).where((F.col("combined") >= floor) | (F.col("combined") >= fill)).where(F.col("rank") <= upto)
    return shown.select("query", "product", "rank", "combined")


def decided(rows: DataFrame, floor: float, fill: float, least: int, most: int) -> DataFrame:
    """query, verdict (EXACT, SIMILAR or NO_MATCH), exact product, number of products shown."""
    shown = similar_fill(rows, floor, fill, least, most).groupBy("query").agg(F.count("*").alias("similar"))
    both = guarded(rows).join(shown, "query", "left")
    verdict = F.when(F.col("exact"), "EXACT").when(F.col("similar") > 0, "SIMILAR").otherwise("NO_MATCH")
    number = F.when(F.col("exact"), 1).otherwise(F.coalesce("similar", F.lit(0))).cast("long")
    return both.select("query", verdict.alias("verdict"), F.when(F.col("exact"), F.col("winner")).alias("exact_product"), number.alias("shown"))


def distances(a: str, b: str) -> dict[str, Column]:
    """dh, ph and ah between the signatures of columns a and b (structs with arrays of longs)."""
    return {h: hamming(F.col(f"{a}.{h}"), F.col(f"{b}.{h}")) for h in ("dh", "ph", "ah")}
