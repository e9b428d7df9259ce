"""URL verdicts: rules first, else logistic regression on hashed character n-grams.

DataFrame functions and Spark's own JVM logistic regression only. The labelled table is
small, so its model is a fixed DIM weights; scoring is one expression per row, without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, GRAMS, REG = 2048, (3, 4), 0.001
#: The rules are part of the plan; more than this belong in a table of their own.
MAX_RULES = 2000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _grams(text: Column, n: int, tag: str) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    cells = F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(DIM)).cast("int"))
    return F.when(F.length(text) >= n, cells).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column) -> Column:
    """Cells 0..DIM-1 of the n-grams of ``^host$`` and, apart from them, of ``path$``; a run of digits of any length counts as one digit."""
    host, path = (F.regexp_replace(c, "[0-9]+", "0") for c in (host, path))
    out = [_grams(text, n, f"{side}{n}") for side, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))) for n in GRAMS]
    return F.concat(*out)


def train(labelled: DataFrame, reg: float = REG) -> tuple[list[float], float]:
    """Weights and intercept from ``labelled (url string, label int)``, 1 for block.

    Rows with a null teach nothing. Without any row every score is 0; with one label only it is that label.
    """
    host, path = split_url(F.col("url"))
    known = labelled.where("url is not null and label is not null").distinct()
    if known.isEmpty():
        return [0.0] * DIM, float("-inf")
    counts = known.select("url", F.col("label").cast("double").alias("label"), F.explode(features(host, path)).alias("cell")).groupBy("url", "label", "cell").agg(F.sqrt(F.count("*")).alias("w"))
    sparse = counts.groupBy("url", "label").agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("at"))  # at most DIM entries
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.coalesce(F.get("at", i - 1)["cell"], F.lit(-1))
    upto = F.flatten(F.transform("at", lambda e, i: F.concat(zeros(e["cell"] - before(i) - 1), F.array(e["w"]))))
    dense = F.concat(upto, zeros(F.lit(DIM) - F.size(upto)))
    rows = sparse.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=reg, standardization=False, maxIter=40, tol=1e-4).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def score(cells: Column, weights: list[float], intercept: float) -> Column:
    """Probability of block: each cell weighs the square root of its count, as in training."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    # sorted cells: the k-th repeat of one cell adds sqrt(k) - sqrt(k - 1)
    step = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"), F.lit(0).alias("k"))

    def add(acc: Column, cell: Column) -> Column:
        k = F.when(acc["last"] == cell, acc["k"] + 1).otherwise(F.lit(1))
        return F.struct((acc["sum"] + F.get(table, cell) * (F.sqrt(k) - F.sqrt(k - 1))).alias("sum"), cell.alias("last"), k.alias("k"))

    z = F.aggregate(F.array_sort(cells), step, add)["sum"] + F.lit(intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of two as long, block wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a plan")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(set(rules), key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_filter(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score``, a row per page.

    A null or malformed url has empty host and path and is judged by the method like
    any other. Urls of any length are read whole. Repeated rows stay repeated, repeated labelled rows count once; columns other
    than id and url are not read, whatever their names. An empty table gives an empty result; without labelled
    rows every page that no rule fits is allowed.
    """
    weights, intercept = train(labelled)
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score(features(F.col("host"), F.col("path")), weights, intercept))
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
