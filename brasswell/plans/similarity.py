"""Image search over stored vectors: nearest products, signature agreement, fusion and verdicts, each beside its SQL.

``embeddings`` stands for the stored views: 25 products, some vectors stored again under product 25, so that two products claim one image. Every
twentieth row is asked, half of them distorted. Signatures are derived from the vectors' components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.columns import clamped, comparable_dot, cosine, dot
from brasswell.functions.hashes import bits_hex, bits_longs, hamming_hex, once
from brasswell.operators import decisions
from brasswell.operators.hamming import within
from brasswell.operators.pivots import Cells
from brasswell.operators.signals import agreements, bests, legacy, near_counts
from brasswell.operators.vectors import against, best_per_product, nearest, normalised
from brasswell.plans.registry import query, table
from brasswell.sources.storage import stored as in_table

LAGS = (1, 2, 3, 5)
PARTS = ("aspect", "fill", "holes", "comps", "orientation", "radial", "density")
FLOOR, FILL, LEAST, MOST, GATE = 0.62, 0.55, 3, 6, 0.5


def vectors_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def stored(spark, sf_dir) -> DataFrame:
    base = vectors_of(spark, sf_dir)
    again = base.where("vec_id % 60 = 0").select(F.col("vec_id") + 1000000, F.lit(25).cast("long"), "e")
    return base.select("vec_id", (F.col("vec_id") % 25).alias("product"), "e").union(again).toDF("vec_id", "product", "e")


def asked(spark, sf_dir) -> DataFrame:
    turned = F.transform("e", lambda x, i: F.when(i % 2 == 1, -x).otherwise(x))
    return vectors_of(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.when(F.col("vec_id") % 40 == 20, turned).otherwise(F.col("e")).alias("e"))


def bits(v: Column) -> dict[str, Column]:
    """Arrays of 0 and 1: dh compares components at four distances, ah their sign, ph with their mean."""
    at = lambda i: F.element_at(v, (i + 1).cast("int"))
    steps = F.sequence(F.lit(0), F.size(v) - 1)
    lag = lambda k: F.transform(steps, lambda i: (at(i) > at((i + k) % F.size(v))).cast("int"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return {"dh": F.concat(*(lag(k) for k in LAGS)), "ph": once(mean, lambda m: F.transform(v, lambda x: (x > m).cast("int"))), "ah": F.transform(v, lambda x: (x > 0).cast("int"))}


def signature(v: Column) -> Column:
    at = lambda k: F.abs(F.element_at(v, k))
    hashes = [bits_longs(b).alias(n) for n, b in bits(v).items()]
    return F.struct(*hashes, (at(1) + 0.5).alias("aspect"), at(2).alias("fill"), F.floor(at(3) * 10).alias("holes"), (F.floor(at(4) * 10) + 1).alias("comps"), F.slice(v, 5, 12).alias("orientation"), F.slice(v, 17, 16).alias("radial"), at(33).alias("density"))


def pairs(spark, sf_dir) -> DataFrame:
    """query, product, dot, structure and the three hash distances of every asked vector with every stored one."""
    left = stored(spark, sf_dir).withColumn("s", signature(F.col("e")))
    right = asked(spark, sf_dir).select("query", F.col("e").alias("q"), signature(F.col("e")).alias("t"))
    met = against(left, right, "vec_id")
    agreement = decisions.structure_agreement({p: F.col(f"s.{p}") for p in PARTS}, {p: F.col(f"t.{p}") for p in PARTS})
    apart = {h: c.alias(h) for h, c in decisions.distances("s", "t").items()}
    return met.select("query", "product", "vec_id", comparable_dot(F.col("e"), F.col("q")).alias("dot"), agreement.alias("structure"), *apart.values())


def signed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored and asked vectors with their signatures."""
    return tuple(df.withColumn("s", signature(F.col("e"))) for df in (stored(spark, sf_dir), asked(spark, sf_dir)))


def signals(spark, sf_dir) -> DataFrame:
    return agreements(*signed(spark, sf_dir))


def scored(spark, sf_dir, again: bool = False) -> DataFrame:
    """again: written first, for plans that read them more than once."""
    rows = decisions.scored(signals(spark, sf_dir))
    return in_table(rows) if again else rows


_E = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
_LAG = " || ".join(f"array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN e[i] > e[(i - 1 + {k}) % 64 + 1] THEN '1' ELSE '0' END), '')" for k in LAGS)
_SIG = f"""{_LAG} AS dh, array_to_string(list_transform(e, lambda x: CASE WHEN x > list_sum(e) / 64 THEN '1' ELSE '0' END), '') AS ph,
    array_to_string(list_transform(e, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS ah,
    abs(e[1]) + 0.5 AS aspect, abs(e[2]) AS fill, floor(abs(e[3]) * 10) AS holes, floor(abs(e[4]) * 10) + 1 AS comps, e[5:16] AS orientation, e[17:32] AS radial, abs(e[33]) AS density"""
_RATIO = "least(s.{0}, t.{0}) / greatest(1e-6, greatest(s.{0}, t.{0}))"
_COS = "list_inner_product(s.{0}, t.{0}) / (sqrt(list_inner_product(s.{0}, s.{0})) * sqrt(list_inner_product(t.{0}, t.{0})))"
#: CTEs: stored (s), asked (t), pairs, signals and scored.
_WITH = f"""WITH v AS ({_E}),
s AS (SELECT *, {_SIG} FROM (SELECT vec_id, vec_id % 25 AS product, e FROM v UNION ALL SELECT vec_id + 1000000, 25, e FROM v WHERE vec_id % 60 = 0)),
t AS (SELECT *, {_SIG} FROM (SELECT vec_id AS query, CASE WHEN vec_id % 40 = 20 THEN list_transform(e, lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END) ELSE e END AS e FROM v WHERE vec_id % 20 = 0)),
pairs AS (SELECT query, product, vec_id, list_inner_product(s.e, t.e) AS dot, bit_count(xor(s.dh::BIT, t.dh::BIT)) AS dh, bit_count(xor(s.ph::BIT, t.ph::BIT)) AS ph, bit_count(xor(s.ah::BIT, t.ah::BIT)) AS ah,
  least(1, greatest(0, 0.2::DOUBLE * {_RATIO.format("aspect")} + 0.14::DOUBLE * (1 - abs(s.fill - t.fill)) + 0.18::DOUBLE * greatest(0, 1 - abs(s.holes - t.holes) / 4) + 0.12::DOUBLE * greatest(0, 1 - abs(s.comps - t.comps) / 6)
    + 0.16::DOUBLE * {_COS.format("orientation")} + 0.14::DOUBLE * {_COS.format("radial")} + 0.06::DOUBLE * (least(s.density + 1e-6, t.density + 1e-6) / greatest(1e-6, greatest(s.density + 1e-6, t.density + 1e-6))))) AS structure
  FROM s, t),
signals AS (SELECT query, product, least(1, greatest(0, max(dot))) AS vector, max(structure) AS structure, greatest(0, 1 - min(0.6::DOUBLE * dh / 256 + 0.4::DOUBLE * ph / 64)) AS hash,
  min(CASE WHEN (dh <= 16 AND ph <= 5 AND ah <= 5 AND structure >= 0.86) OR (dh <= 20 AND ph <= 6 AND ah <= 6 AND structure >= 0.95) THEN 0.6::DOUBLE * dh / 256 + 0.4::DOUBLE * ph / 64 END) AS claim
  FROM pairs GROUP BY query, product),
scored AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY combined DESC, product) AS rank FROM (
  SELECT *, round(0.32::DOUBLE * vector + 0.34::DOUBLE * structure + 0.34::DOUBLE * hash, 9) AS combined FROM signals)),
won AS (SELECT query, count(claim) AS claimants, arg_min(product, rank) FILTER (claim IS NOT NULL) AS winner, arg_min(claim, rank) FILTER (claim IS NOT NULL) AS distance FROM scored GROUP BY query),
guarded AS (SELECT query, claimants, winner, distance, min(CASE WHEN product <> winner THEN 1 - hash END) AS rival FROM scored JOIN won USING (query) GROUP BY ALL),
exact AS (SELECT *, claimants = 1 AND (rival IS NULL OR distance <= rival * 0.55 OR rival > 0.12) AS exact FROM guarded),
shown AS (SELECT query, product, rank, combined FROM (SELECT *, count_if(combined >= {FLOOR}) OVER (PARTITION BY query) AS n FROM scored)
  WHERE combined >= {FILL} AND rank <= CASE WHEN n >= {LEAST} THEN least(n, {MOST}) WHEN n > 0 THEN {LEAST} ELSE 0 END)
"""


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v) SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 1e-9 THEN e[1] / norm ELSE e[1] END, 6) + 0 AS head, round(CASE WHEN norm > 1e-9 THEN e[64] / norm ELSE e[64] END, 6) + 0 AS tail FROM n")
def vec01_norm(spark, sf_dir):
    v = vectors_of(spark, sf_dir).select("vec_id", F.transform("e", lambda x: x * (F.col("vec_id") % 7)).alias("e"))
    unit = v.select("vec_id", F.sqrt(dot(F.col("e"), F.col("e"))).alias("norm"), normalised(F.col("e")).alias("u"))
    return unit.select("vec_id", F.round("norm", 6).alias("norm"), (F.round(F.element_at("u", 1), 6) + 0).alias("head"), (F.round(F.element_at("u", 64), 6) + 0).alias("tail"))


@query(f"WITH v AS ({_E}) SELECT vec_id, vec_id % 5 <> 0 AS comparable, CASE WHEN vec_id % 5 <> 0 THEN round(list_inner_product(e, list_reverse(e)), 6) END AS similarity FROM v")
def vec02_dot(spark, sf_dir):
    other = F.when(F.col("vec_id") % 5 == 0, F.slice("e", 1, 32)).otherwise(F.reverse("e"))
    found = vectors_of(spark, sf_dir).select("vec_id", comparable_dot(F.col("e"), other).alias("d"))
    known = F.col("d") > float("-inf")
    return found.select("vec_id", known.alias("comparable"), F.when(known, F.round("d", 6)).alias("similarity"))


@query(f"WITH v AS ({_E}) SELECT vec_id, round(greatest(0, least(1, list_inner_product(e, list_reverse(e)) / list_inner_product(e, e))), 6) AS similarity FROM v")
def vec03_cosine_clamp(spark, sf_dir):
    return vectors_of(spark, sf_dir).select("vec_id", F.round(clamped(cosine(F.col("e"), F.reverse("e")), 0.0, 1.0), 6).alias("similarity"))


@query("SELECT q.vec_id AS query_id, v.label, round(max(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY ALL")
def agg04_best_per_product(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    found = best_per_product(v.select(F.col("label").cast("long").alias("product"), "vec_id", F.col("e").alias("vector")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("asked")))
    return found.select(F.col("query").alias("query_id"), F.col("product").cast("int").alias("label"), F.round("similarity", 6).alias("similarity"))


def _as_vectors(spark, sf_dir):
    return stored(spark, sf_dir).withColumnRenamed("e", "vector"), asked(spark, sf_dir).withColumnRenamed("e", "asked")


@query(_WITH + ", n AS (SELECT query // 80 AS shot, vec_id, product, max(round(dot, 9)) AS d FROM pairs GROUP BY ALL) SELECT shot, vec_id, product, round(d, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY d DESC, vec_id) AS rank FROM n) WHERE rank <= 12")
def vec04_nearest(spark, sf_dir):
    """Four asked vectors are the views of one shot."""
    found = nearest(*_as_vectors(spark, sf_dir), 12, F.floor(F.col("query") / 80))
    return found.select(F.col("query").alias("shot"), "vec_id", "product", F.round("similarity", 6).alias("similarity"), "rank")


@query(_WITH + "SELECT query, vec_id, product, round(d, 6) AS similarity, rank FROM (SELECT query, vec_id, product, round(dot, 9) AS d, row_number() OVER (PARTITION BY query ORDER BY round(dot, 9) DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10")
def vec04_pruned_search(spark, sf_dir):
    """The ten nearest rows of each asked vector; cells that cannot hold one of them are not visited."""
    vectors, shots = _as_vectors(spark, sf_dir)
    found, _ = Cells(vectors, 64).nearest(shots, 10)
    return found.select("query", "vec_id", "product", F.round("similarity", 6).alias("similarity"), "rank")


@query(_WITH + ", n AS (SELECT query, product, vec_id, round(dot, 9) AS d FROM pairs) SELECT query, product, vec_id, round(d, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query, product ORDER BY d DESC, vec_id) AS k FROM n) WHERE k = 1")
def agg05_best_vector(spark, sf_dir):
    found = best_per_product(*_as_vectors(spark, sf_dir))
    return found.select("query", "product", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id // 20 AS shot, count_if(vec_id % 20 < 4 AND vec_id % 3 > 0) AS usable, CASE WHEN count_if(vec_id % 20 < 4 AND vec_id % 3 > 0) = 0 THEN 'error' ELSE 'ok' END AS state FROM embeddings WHERE vec_id % 20 < 4 GROUP BY 1")
def vec06_query_views(spark, sf_dir):
    """Views of a shot whose dimension is the provider's; without any the shot is an error, not a shot that matches nothing."""
    views = vectors_of(spark, sf_dir).where("vec_id % 20 < 4").select(F.floor(F.col("vec_id") / 20).alias("shot"), F.when(F.col("vec_id") % 3 == 0, F.slice("e", 1, 32)).otherwise(F.col("e")).alias("e"))
    usable = F.count_if(F.size("e") == 64)
    return views.groupBy("shot").agg(usable.alias("usable"), F.when(usable == 0, "error").otherwise("ok").alias("state"))


@query(_WITH + "SELECT query, product, round(coalesce(max(dot) FILTER (vec_id < 250), 0), 6) AS similarity FROM pairs GROUP BY query, product")
def jn01_best_hit_or_zero(spark, sf_dir):
    """Every product beside its best hit among a part of the vectors; products without a hit get a zero."""
    vectors, shots = _as_vectors(spark, sf_dir)
    hits = best_per_product(vectors.where("vec_id < 250"), shots).select("query", "product", "similarity")
    wanted = against(vectors.select("product").distinct(), shots.select("query"), "product")
    return wanted.join(hits, ["query", "product"], "left").select("query", "product", F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))


@query(_WITH + "SELECT query, product, round(max(structure), 6) AS structure, min(dh) AS dh FROM pairs GROUP BY query, product")
def jn02_view_pairs(spark, sf_dir):
    return bests(*signed(spark, sf_dir), ("structure", "dh")).select("query", "product", F.round("structure", 6).alias("structure"), "dh")


@query(_WITH + "SELECT query, product, round(structure, 6) AS structure FROM signals")
def strc01_structure(spark, sf_dir):
    return signals(spark, sf_dir).select("query", "product", F.round("structure", 6).alias("structure"))


@query(_WITH + "SELECT query, product, round(hash, 6) AS hash FROM signals")
def rrk01_hash_similarity(spark, sf_dir):
    return signals(spark, sf_dir).select("query", "product", F.round("hash", 6).alias("hash"))


@query(_WITH + "SELECT query, product, round(0.32::DOUBLE * vector + 0.34::DOUBLE * structure + 0.34::DOUBLE * hash, 6) AS local, round(0.5::DOUBLE * vector + 0.25::DOUBLE * structure + 0.25::DOUBLE * hash, 6) AS other, round(0.78::DOUBLE * vector + 0.1::DOUBLE * structure + 0.12::DOUBLE * hash, 6) AS remote FROM signals")
def rrk02_fusion(spark, sf_dir):
    one = lambda p: F.round(decisions.fused(F.col("vector"), F.col("structure"), F.col("hash"), p), 6).alias(p)
    return signals(spark, sf_dir).select("query", "product", *(one(p) for p in decisions.WEIGHTS))


@query(_WITH + f"SELECT query, product, round(combined, 6) AS combined FROM scored WHERE combined >= {GATE} OR vector >= 0.6")
def flt16_candidate_gate(spark, sf_dir):
    return scored(spark, sf_dir).where((F.col("combined") >= GATE) | (F.col("vector") >= 0.6)).select("query", "product", F.round("combined", 6).alias("combined"))


@query(_WITH + "SELECT query, vec_id, product, CASE WHEN dh <= 16 AND ph <= 5 AND ah <= 5 AND structure >= 0.86 THEN 'near-duplicate' WHEN dh <= 20 AND ph <= 6 AND ah <= 6 AND structure >= 0.95 THEN 'rescaled' END AS path FROM pairs WHERE dh <= 64")
def dec01_near_duplicate(spark, sf_dir):
    path = decisions.near_duplicate(F.col("dh"), F.col("ph"), F.col("ah"), F.col("structure"))
    return pairs(spark, sf_dir).where("dh <= 64").select("query", "vec_id", "product", path.alias("path"))


@query(_WITH + ", d AS (SELECT query, vec_id, product, dh FROM pairs WHERE dh <= 20) SELECT query, vec_id, product, CAST(dh AS BIGINT) AS distance, (SELECT min(dh) FROM d e WHERE e.query = d.query) = dh AS nearest FROM d")
def dec01_hashes_in_radius(spark, sf_dir):
    """Stored images whose gradient hash lies within the widest radius of a near-duplicate, by the pieces that the hashes share."""
    hashed = lambda df, i, h: df.select(F.col(i), bits_longs(bits(F.col("e"))["dh"]).alias(h))
    rows = stored(spark, sf_dir)
    found = within(hashed(rows, "vec_id", "hash").withColumnRenamed("vec_id", "id"), hashed(asked(spark, sf_dir), "query", "asked"), 256, decisions.RESCALED[0])
    least = found.groupBy("query").agg(F.min("distance").alias("least"))
    named = found.join(least, "query").join(rows.select(F.col("vec_id").alias("id"), "product"), "id")
    return named.select("query", F.col("id").alias("vec_id"), "product", "distance", (F.col("distance") == F.col("least")).alias("nearest"))


@query(_WITH + "SELECT query, product, row_number() OVER (PARTITION BY query ORDER BY rank) AS claim, round(claim, 6) AS distance FROM scored WHERE claim IS NOT NULL")
def dec02_claims(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return scored(spark, sf_dir).where("claim is not null").select("query", "product", order.alias("place"), F.round("claim", 6).alias("distance")).withColumnRenamed("place", "claim")


@query(_WITH + "SELECT query, claimants, winner, round(rival, 6) AS rival, exact FROM exact")
def dec03_exact_guard(spark, sf_dir):
    return decisions.guarded(scored(spark, sf_dir, again=True)).select("query", "claimants", "winner", F.round("rival", 6).alias("rival"), "exact")


@query(_WITH + "SELECT query, winner, round(rival, 6) AS rival FROM guarded WHERE winner IS NOT NULL")
def agg07_runner_up(spark, sf_dir):
    return decisions.guarded(scored(spark, sf_dir, again=True)).where("winner is not null").select("query", "winner", F.round("rival", 6).alias("rival"))


@query(_WITH + "SELECT query, product, rank FROM shown")
def set04_two_floors(spark, sf_dir):
    return decisions.similar_fill(scored(spark, sf_dir), FLOOR, FILL, LEAST, MOST).select("query", "product", "rank")


@query(_WITH + "SELECT e.query, CASE WHEN exact THEN 'EXACT' WHEN coalesce(n, 0) > 0 THEN 'SIMILAR' ELSE 'NO_MATCH' END AS verdict, CASE WHEN exact THEN winner END AS exact_product, CASE WHEN exact THEN 1 ELSE coalesce(n, 0) END AS shown FROM exact e LEFT JOIN (SELECT query, count(*) AS n FROM shown GROUP BY query) k ON e.query = k.query")
def dec05_verdict(spark, sf_dir):
    return decisions.decided(scored(spark, sf_dir, again=True), FLOOR, FILL, LEAST, MOST)


@query(_WITH + "SELECT query, product, rank FROM shown WHERE query IN (SELECT query FROM exact WHERE NOT exact)")
def flt18_response(spark, sf_dir):
    """What a user sees of similar products: no scores."""
    rows = scored(spark, sf_dir, again=True)
    open_ = decisions.guarded(rows).where("not exact").select("query")
    return decisions.similar_fill(rows, FLOOR, FILL, LEAST, MOST).join(open_, "query", "left_semi").select("query", "product", "rank")


def debug_top(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Each query's best rows by a score, 1 to 200 of them."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(key), "product"))
    return rows.withColumn("place", rank).where(F.col("place") <= min(200, max(1, most)))


@query(_WITH + "SELECT query, product, place, round(vector, 4) AS vector FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(vector, 9) DESC, product) AS place FROM scored) WHERE place <= 5")
def ord09_debug_top(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("vector", F.round("vector", 9))
    return debug_top(rows, "vector", 5).select("query", "product", "place", F.round("vector", 4).alias("vector"))


@query(_WITH + "SELECT query, coalesce(min(rank) FILTER (product = query % 7), 999) AS rank FROM scored WHERE rank <= 10 GROUP BY query")
def win03_rank_of_true(spark, sf_dir):
    """The place of the true product among the ten best, 999 where it isn't there."""
    true = F.min(F.when(F.col("product") == F.col("query") % 7, F.col("rank")))
    return scored(spark, sf_dir).where("rank <= 10").groupBy("query").agg(F.coalesce(true, F.lit(999)).alias("rank"))


_TRUE = "SELECT query, query % 40 = 20 AS distorted, min(rank) FILTER (product = query % 25) AS place FROM scored GROUP BY query"


def true_ranks(rows: DataFrame) -> DataFrame:
    place = F.min(F.when(F.col("product") == F.col("query") % 25, F.col("rank")))
    return rows.groupBy("query", (F.col("query") % 40 == 20).alias("distorted")).agg(place.alias("place"))


@query(_WITH + f"SELECT distorted, count(*) AS n, count_if(place = 1) AS top1, count_if(place <= 3) AS top3, count_if(place <= 6) AS top6, count_if(exact AND winner = query % 25) AS exact_right, count_if(exact AND winner <> query % 25) AS exact_wrong FROM ({_TRUE}) JOIN exact USING (query) GROUP BY distorted")
def agg14_kpis(spark, sf_dir):
    rows = scored(spark, sf_dir, again=True)
    both = true_ranks(rows).join(decisions.guarded(rows), "query")
    hit = lambda k: F.count_if(F.col("place") <= k)
    right = F.col("winner") == F.col("query") % 25
    return both.groupBy("distorted").agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(3).alias("top3"), hit(6).alias("top6"), F.count_if(F.col("exact") & right).alias("exact_right"), F.count_if(F.col("exact") & ~right).alias("exact_wrong"))


@query(_WITH + f"SELECT distorted, count(*) AS n, round(avg((place = 1)::INT), 3) AS passed FROM ({_TRUE}) WHERE (query // 20) % 3 = 0 GROUP BY distorted")
def agg13_self_test(spark, sf_dir):
    """Every third shot is tested: the share whose first product is the true one, to three places."""
    sample = true_ranks(scored(spark, sf_dir)).where(F.floor(F.col("query") / 20) % 3 == 0)
    return sample.groupBy("distorted").agg(F.count("*").alias("n"), F.round(F.avg((F.col("place") == 1).cast("double")), 3).alias("passed"))


@query(_WITH + "SELECT query % 40 = 20 AS distorted, round(avg(vector), 6) AS vector, round(avg(structure), 6) AS structure, round(avg(hash), 6) AS hash, round(avg(margin), 6) AS margin FROM (SELECT *, combined - lead(combined) OVER (PARTITION BY query ORDER BY rank) AS margin FROM scored) WHERE rank = 1 GROUP BY 1")
def agg16_signal_means(spark, sf_dir):
    margin = F.col("combined") - F.lead("combined").over(Window.partitionBy("query").orderBy("rank"))
    best = scored(spark, sf_dir).withColumn("margin", margin).where("rank = 1")
    return best.groupBy((F.col("query") % 40 == 20).alias("distorted")).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("vector", "structure", "hash", "margin")))


_COMBOS = [(0.2, 0.4, 0.4), (0.6, 0.2, 0.2), (1.0, 0.0, 0.0)]


@query(_WITH + ", c(combo, wv, ws, wh) AS (VALUES (0, 0.2::DOUBLE, 0.4::DOUBLE, 0.4::DOUBLE), (1, 0.6, 0.2, 0.2), (2, 1.0, 0.0, 0.0)), r AS (SELECT combo, query, product, row_number() OVER (PARTITION BY combo, query ORDER BY round(wv * vector + ws * structure + wh * hash, 9) DESC, product) AS rank FROM signals, c) SELECT combo, distorted, round(avg(coalesce(place, 150)), 4) AS mean_rank FROM (SELECT combo, query % 40 = 20 AS distorted, min(rank) FILTER (product = query % 27) AS place FROM r GROUP BY combo, query) GROUP BY combo, distorted")
def agg17_weight_sweep(spark, sf_dir):
    """Mean place of the true product under each combination of weights; 150 where it isn't in the list."""
    total = lambda w: F.round(sum((F.col(c) * F.lit(k) for c, k in zip(("structure", "hash"), w[1:], strict=True)), F.col("vector") * F.lit(w[0])), 9)
    combos = F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), total(w).alias("score")) for i, w in enumerate(_COMBOS))))
    rows = signals(spark, sf_dir).select("query", "product", combos.alias("c")).select("query", "product", "c.*")
    rank = F.row_number().over(Window.partitionBy("combo", "query").orderBy(F.desc("score"), "product"))
    places = rows.withColumn("rank", rank).groupBy("combo", "query").agg(F.min(F.when(F.col("product") == F.col("query") % 27, F.col("rank"))).alias("place"))
    return places.groupBy("combo", (F.col("query") % 40 == 20).alias("distorted")).agg(F.round(F.avg(F.coalesce("place", F.lit(150))), 4).alias("mean_rank"))


_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(s.e[i] - t.e[i])))"
_LEGACY = _WITH + f", l AS (SELECT query, s.vec_id, s.product, 0.45::DOUBLE * bit_count(xor(s.dh::BIT, t.dh::BIT)) / 256 + 0.25::DOUBLE * bit_count(xor(s.ph::BIT, t.ph::BIT)) / 64 + 0.1::DOUBLE * bit_count(xor(s.ah::BIT, t.ah::BIT)) / 64 + 0.2::DOUBLE * least(1, {_L1} / 2) AS d FROM s, t), m AS (SELECT query // 80 AS shot, vec_id, product, round(min(d), 11) AS d FROM l GROUP BY ALL)"


def shot() -> Column:
    """Four asked vectors are the views of one shot."""
    return F.floor(F.col("query") / 80)


@query(_LEGACY + " SELECT shot, vec_id, d AS distance FROM m")
def hsh05_legacy_distance(spark, sf_dir):
    return legacy(*signed(spark, sf_dir), shot()).select("shot", "vec_id", F.col("d").alias("distance"))


@query(_LEGACY + " SELECT shot, product, vec_id, d AS distance, CASE WHEN d <= 0.07 THEN 99 ELSE least(92, greatest(55, floor(99 - d * 55 + 0.5)))::BIGINT END AS score FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY d, vec_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY shot, product ORDER BY d, vec_id) AS k FROM m) WHERE k = 1) WHERE place <= 8")
def hsh06_legacy_ranking(spark, sf_dir):
    """The eight nearest products of a shot, each with its nearest image, and the score shown for the distance."""
    best = legacy(*signed(spark, sf_dir), shot(), by="product").groupBy("shot", "product").agg(F.min(F.struct("d", "vec_id")).alias("b")).select("shot", "product", "b.vec_id", "b.d")
    place = F.row_number().over(Window.partitionBy("shot").orderBy("d", "vec_id"))
    return best.withColumn("place", place).where("place <= 8").select("shot", "product", "vec_id", F.col("d").alias("distance"), decisions.legacy_score(F.col("d")).alias("score"))


@query(_LEGACY + " SELECT shot, min(d) AS least, min(d) <= 0.07 AS duplicate FROM m GROUP BY shot")
def agg06_least_distance(spark, sf_dir):
    return legacy(*signed(spark, sf_dir), shot(), by="shot").groupBy("shot").agg(F.min("d").alias("least"), (F.min("d") <= 0.07).alias("duplicate"))


_HEX = "array_to_string(list_transform(range(0, 64), lambda k: printf('%x', (substr(dh, 4 * k + 1, 1)::INT * 8 + substr(dh, 4 * k + 2, 1)::INT * 4 + substr(dh, 4 * k + 3, 1)::INT * 2 + substr(dh, 4 * k + 4, 1)::INT))), '')"


@query(_WITH + f"SELECT vec_id, {_HEX} AS hex, CASE WHEN vec_id % 9 = 0 THEN 2147483647 ELSE bit_count(xor(dh::BIT, (substr(dh, 65) || substr(dh, 1, 64))::BIT)) END AS distance FROM s")
def bit01_hamming(spark, sf_dir):
    """Hex text of 256 bits, and its distance from the same text turned by 64 bits, cut short for every ninth row."""
    own = stored(spark, sf_dir).select("vec_id", bits_hex(bits(F.col("e"))["dh"]).alias("hex"))
    turned = F.concat(F.substr("hex", F.lit(17)), F.substr("hex", F.lit(1), F.lit(16)))
    return own.select("vec_id", "hex", hamming_hex(F.col("hex"), F.when(F.col("vec_id") % 9 == 0, F.substr("hex", F.lit(1), F.lit(8))).otherwise(turned)).alias("distance"))


@query(_WITH + "SELECT product, count(*) AS views, string_agg(view || '=' || sig, ',' ORDER BY view) AS signatures FROM (SELECT product, vec_id % 4 AS view, substr(arg_min(dh, vec_id), 1, 16) AS sig FROM s GROUP BY ALL) GROUP BY product")
def agg20_views_of_product(spark, sf_dir):
    """product::view rows to one map for each product; the smallest vector speaks for a view."""
    text = F.array_join(F.transform(F.slice(bits(F.col("e"))["dh"], 1, 16), lambda b: b.cast("string")), "")
    rows = stored(spark, sf_dir).groupBy(F.concat_ws("::", "product", (F.col("vec_id") % 4).cast("string")).alias("key")).agg(F.min_by(text, "vec_id").alias("sig"))
    split = rows.select(F.substring_index("key", "::", 1).cast("long").alias("product"), F.substring_index("key", "::", -1).alias("view"), "sig")
    views = split.groupBy("product").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "sig")))).alias("m"))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return views.select("product", F.size("m").cast("long").alias("views"), told.alias("signatures"))


@query(_WITH + "SELECT query, count(*) AS met, count_if(dot > 0.2) AS near FROM pairs GROUP BY query")
def jn03_every_pair(spark, sf_dir):
    """Each asked vector beside all stored ones of its dimension."""
    return near_counts(stored(spark, sf_dir), asked(spark, sf_dir), 0.2)


@query(_WITH + "SELECT query, count(*) AS products, round(sum(vector), 5) AS total FROM signals GROUP BY query")
def vec05_no_early_cut(spark, sf_dir):
    """Every product counts with its best vector, however many there are."""
    found = best_per_product(*_as_vectors(spark, sf_dir))
    return found.groupBy("query").agg(F.count("*").alias("products"), F.round(F.sum(clamped(F.col("similarity"), 0.0, 1.0)), 5).alias("total"))


@query(_WITH + "SELECT query, product, round(combined, 6) AS combined FROM (SELECT * FROM scored ORDER BY combined DESC, query, product LIMIT 60)")
def ord03_best_scores(spark, sf_dir):
    """The sixty best of all, by score, then query and product: a top-k, not a sort of all."""
    return scored(spark, sf_dir).orderBy(F.desc("combined"), "query", "product").limit(60).select("query", "product", F.round("combined", 6).alias("combined"))
