"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown over statistics of a bounded sample of labelled rows (``SAMPLE`` rows, chosen by a hash of the id);
every path from a root is a rule, a conjunction of thresholds. A lasso logistic regression (proximal gradient steps)
keeps few rules, and these become one Spark column expression, which scores every whole text inside generated code.

Null text counts as empty and gets the score of an empty text. Ids are carried as they are; repeated rows are scored each. Repeated
labels of one id each count as an example; null labels count as none. With no labels, or of one class, every score is the smoothed share of
label 1. Ties between splits go to the first statistic and lowest threshold. Very long texts are measured whole. Columns that clash with a result
column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import crc_of_id, restored, sheltered, table

#: The most labelled rows that the fit sees.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST, LASSO = 30, 3, 0.3, 32, 20, 2e-3


def statistics(text: str = "text") -> dict[str, str]:
    """SQL expressions of the statistics that rules are about, over the columns _text, _words and _lines."""
    share = lambda pattern: f"(length(_text) - length(regexp_replace(_text, '{pattern}', ''))) / greatest(length(_text), 1)"
    return {
        "n_chars": "cast(length(_text) as double)",
        "word_length": "length(_text) / greatest(size(_words), 1)",
        "distinct_words": "size(array_distinct(_words)) / greatest(size(_words), 1)",
        "line_length": "length(_text) / greatest(size(_lines), 1)",
        "distinct_lines": "size(array_distinct(_lines)) / greatest(size(_lines), 1)",
        "capitals": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "marks": share("[!#$%&*@^|<>{}~=+_/-]+"),
        "stops": share("[.,;:?]+"),
        "wide": "octet_length(_text) / greatest(length(_text), 1)",
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a double column _s_<name> for each statistic."""
    base = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    base = base.withColumns({"_words": F.split(F.lower(F.trim("_text")), r"\s+"), "_lines": F.split("_text", "\n")})
    return base.withColumns({f"_s_{k}": F.expr(f"cast({v} as double)") for k, v in statistics().items()}).drop("_text", "_words", "_lines")


#: A condition: (statistic, whether at most or above, threshold); a rule is a tuple of them.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score between 0 and 1 from the columns of with_statistics()."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for name, below, at in rule:
                c = F.col(f"_s_{name}")
                hit = hit & (c <= F.lit(at) if below else c > F.lit(at))
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, below, at in rule:
        v = x[:, names.index(name)]
        out &= v <= at if below else v > at
    return out


def _grow(x, cuts, codes, g, h, rows, names, rule: Rule, out: list, depth: int) -> None:
    """Adds the tree's rules with their rows and step to out; each split is the best of second-order gains over binned statistics."""
    if rule:
        out.append((rule, rows, -g[rows].sum() / (h[rows].sum() + 1.0), depth == 0))
    if depth == 0 or len(rows) < 2 * LEAST:
        if rule:
            out[-1] = (*out[-1][:3], True)
        return
    best = (1e-3, -1, -1)
    gs, hs = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        c = codes[rows, f]
        gl = np.cumsum(np.bincount(c, g[rows], BINS))[: len(cuts[f])]
        hl = np.cumsum(np.bincount(c, h[rows], BINS))[: len(cuts[f])]
        nl = np.cumsum(np.bincount(c, minlength=BINS))[: len(cuts[f])]
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    _, f, k = best
    if f < 0:
        if rule:
            out[-1] = (*out[-1][:3], True)
        return
    low = codes[rows, f] <= k
    for below, part in ((True, rows[low]), (False, rows[~low])):
        _grow(x, cuts, codes, g, h, part, names, (*rule, (names[f], below, float(cuts[f][k]))), out, depth - 1)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    n, p = len(y), (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if n < 2 * LEAST or y.min() == y.max():
        return RuleModel(base, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin, rules = np.full(n, base), {}
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        out: list = []
        _grow(x, cuts, codes, q - y, q * (1 - q), np.arange(n), names, (), out, DEPTH)
        for rule, rows, step, leaf in out:
            rules.setdefault(rule)
            if leaf:
                margin[rows] += RATE * step
    kept, seen = [], set()
    for rule in rules:
        m = _holds(rule, x, names)
        if m.tobytes() not in seen and 0 < m.sum() < n:
            seen.add(m.tobytes())
            kept.append((rule, m))
    if not kept:
        return RuleModel(base, ())
    a = np.column_stack([np.ones(n), *(m.astype(float) for _, m in kept)])
    w = z = np.concatenate(([base], np.zeros(len(kept))))
    rate, t = 4 * n / np.linalg.norm(a, 2) ** 2, 1.0
    for _ in range(500):
        new = z - rate * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * LASSO, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return RuleModel(float(w[0]), tuple((rule, float(v)) for (rule, _), v in zip(kept, w[1:], strict=True) if v))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleModel:
    """Fits on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    marked = labels.select("doc_id", F.col(label).cast("double").alias("_y")).where((crc_of_id() % 5 != 0) & F.col("_y").isNotNull())
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(SAMPLE)  # so many rows at most: they may be broadcast
    names = list(statistics())
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")).select("doc_id", "_y", *(f"_s_{n}" for n in names)).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit_rules(rows[[f"_s_{n}" for n in names]].to_numpy(float), rows["_y"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with score and predicted. No shuffle, no Python."""
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    out = with_statistics(sheltered(base, "text")).withColumn("score", model.column())
    return out.select(*restored(base, "text"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")
