"""Which endpoints of two services do the same: similarity of paths and verbs, spread over neighbours, then assigned.

An endpoint is the words of its path, where placeholders have no name. Two endpoints are alike as the weight of
their common words is to that of all their words; a word weighs more the fewer endpoints have it. Pairs are found by
their heaviest words alone: two endpoints that share none of those cannot reach the least likeness. Likeness then
spreads: pairs gain where the other verbs of their paths, and the paths above them, are alike too. What is left is
one-to-one assignment among endpoints whose verbs can stand for each other. No list of synonyms is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.endpoints import OPERATIONS
from weftline.plans.assignment import one_to_one
from weftline.plans.matching import NameMatcher

#: Likeness of words from which on pairs are looked at, and the score from which on they are assigned.
LEAST, ASSIGNED = 0.2, 0.2
#: How much of a score is the pair's own words, the verbs of its path, and the path above; times that likeness spreads.
OWN, PATH, ABOVE, ROUNDS = 0.6, 0.25, 0.15, 3


def words_of(path: Column) -> Column:
    """Words of a path in lower case without a plural s; each placeholder is the word {}, and {} at the end the word {}$."""
    blank = F.regexp_replace(F.lower(path), r"\{[^}]*\}", "{}")
    ended = F.regexp_replace(blank, r"\{\}$", "{}\\$")
    parts = F.filter(F.split(ended, r"[/\-_.:]+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"(?<=\w\w)s$", ""))


def featured(endpoints: DataFrame) -> DataFrame:
    """(id, verb, path, above, word, k) of endpoints (identifier): a row for each word, the k-th of its kind in the path."""
    verb, path = F.substring_index("identifier", " ", 1), F.regexp_replace("identifier", r"^\S+ ", "")
    rows = endpoints.select(F.col("identifier").alias("id"), F.upper(verb).alias("verb"), path.alias("path")).distinct()
    rows = rows.withColumn("above", F.regexp_replace("path", r"/[^/]*$", ""))
    words = rows.select("*", F.posexplode(words_of(F.col("path"))).alias("at", "word"))
    return words.withColumn("k", F.row_number().over(W.partitionBy("id", "word").orderBy("at"))).drop("at")


def standing_for(a: Column, b: Column) -> Column:
    """How well one verb stands for another; null if it cannot."""
    return F.when(a == b, 1.0).when(a.isin("PUT", "PATCH") & b.isin("PUT", "PATCH"), 0.95).when(a.isin("POST", "PUT") & b.isin("POST", "PUT"), 0.7)


def alike(a: DataFrame, b: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, a_path, b_path, a_above, b_above, kind, likeness) of endpoints (identifier) of two services.

    likeness: weight of common words over that of all, 0 to 1, times how well the verbs stand for each other.
    """
    sides = {"a": featured(a), "b": featured(b)}
    both = sides["a"].select("word", "id").unionByName(sides["b"].select("word", "id"))
    n = both.select("id").distinct().count()
    weights = both.groupBy("word").agg(F.log((n + 1) / F.count_distinct("id")).alias("w"))
    named = {}
    for side, rows in sides.items():
        weighed = rows.join(weights, "word")
        total = F.sum("w").over(W.partitionBy("id"))
        # of its words, heaviest first, an endpoint needs those before which less than 1 - least of the weight lies
        before = F.coalesce(F.sum("w").over(W.partitionBy("id").orderBy(F.desc("w"), "word", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        weighed = weighed.withColumns({"total": total, "heavy": before <= total * (1 - least) + 1e-9})
        named[side] = weighed.select("word", "k", "w", "heavy", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "verb", "path", "above", "total")])
    keys = ["word", "k"]
    met = named["a"].where("heavy").select(*keys, "a_id", "a_verb").join(named["b"].where("heavy").select(*keys, "b_id", "b_verb"), keys)
    pairs = met.where(standing_for(F.col("a_verb"), F.col("b_verb")).isNotNull()).select("a_id", "b_id").distinct()
    left, right = named["a"].drop("heavy"), named["b"].drop("heavy", "w")
    common = pairs.join(left, "a_id").join(right, ["b_id", *keys])
    whole = ["a_id", "b_id", "a_verb", "b_verb", "a_path", "b_path", "a_above", "b_above"]
    sums = common.groupBy(*whole).agg(F.sum("w").alias("shared"), F.max("a_total").alias("a_total"), F.max("b_total").alias("b_total"))
    verbs = standing_for(F.col("a_verb"), F.col("b_verb"))
    likeness = F.col("shared") / (F.col("a_total") + F.col("b_total") - F.col("shared"))
    kind = F.when(F.col("a_verb").isin("POST", "PUT", "PATCH"), "write").otherwise(F.col("a_verb"))
    found = sums.where(likeness >= least).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_path", "b_path", "a_above", "b_above", kind.alias("kind"), (likeness * verbs).alias("likeness"))
    return found


def spread(pairs: DataFrame) -> DataFrame:
    """pairs with a score: their likeness, that of the verbs of their paths, and that of the paths above them."""
    score = pairs.withColumn("score", F.col("likeness"))
    for _ in range(ROUNDS):
        # a pair of paths is as alike as its verbs are on average, each by its best counterpart
        best = score.groupBy("a_path", "b_path", "a").agg(F.max("score").alias("best"))
        paths = best.groupBy("a_path", "b_path").agg(F.avg("best").alias("alike"))
        above = paths.select(F.col("a_path").alias("a_above"), F.col("b_path").alias("b_above"), F.col("alike").alias("alike_above"))
        joined = score.join(paths, ["a_path", "b_path"], "left").join(above, ["a_above", "b_above"], "left")
        own, path = F.col("likeness"), F.coalesce("alike", F.lit(0.0))
        spread_out = OWN * own + PATH * path + ABOVE * F.coalesce("alike_above", path)
        score = joined.select(*pairs.columns, spread_out.alias("score"))
    return score


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, score) of endpoints (identifier) of two services, each in one pair at most."""
    pairs = alike(a, b).persist()  # each round of spreading reads them again
    return one_to_one(spread(pairs), "kind", ASSIGNED)


class StructureMatcher(NameMatcher):
    """Endpoints by structure; fields by names, as NameMatcher."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def endpoints(self, a: list[str], b: list[str]) -> dict:
        side = lambda labels: self.spark.createDataFrame([(x.partition(" - ")[0],) for x in labels], "identifier string")
        pairs = sorted((r.a, r.b) for r in matched(side(a), side(b)).collect()) if a and b else []  # endpoints of one request
        out: dict = {}
        for mine, other in pairs:
            op = self.operation(mine)
            path = mine.partition(" ")[2]
            collection = path.rpartition("/")[0] if path.endswith("}") else path
            if op is None or self.operation(other) is None:
                continue
            kind = out.setdefault(collection.strip("/"), {s: dict.fromkeys(OPERATIONS, "") for s in ("api1", "api2")})
            kind["api1"][op] = kind["api1"][op] or mine
            kind["api2"][op] = kind["api2"][op] or other
        return out
