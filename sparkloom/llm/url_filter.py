"""URL filter: listed rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import drop, saved


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    place: str  # host, "/" and the path's beginning

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host) :]


RULES = (UrlRule("allow", "com/"), UrlRule("block", "example.com/en/"), UrlRule("allow", "www.example.com/en/"), UrlRule("block", "net/es/"), UrlRule("block", "net/fr/"))
#: The trees are fitted on at most so many labelled URLs, those of least hash.
TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 4
#: The rules name hosts by their last labels and paths by their first part, so these are no features: trees would learn the rules
#: back and say nothing of other URLs. The suffix is that of the path's last part.
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "fragment", "suffix_length", "suffix_count", "secure")
#: Suffixes are counted in so many bins, so that their counts fit a broadcast whatever the table holds.
BINS = 1024


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path: both empty without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": F.regexp_extract(url, whole, 2)})


def fitting(rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits host and path, as a struct (rule, ruling); null if none does."""
    out = F.lit(None).cast("struct<rule:string,ruling:string>")
    for r in sorted(rules, key=lambda r: len(r.place)):
        own = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(own, F.struct(F.lit(r.place).alias("rule"), F.lit(r.verdict).alias("ruling"))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """The columns of FEATURES but suffix_count, and the bin of the path's suffix (what follows the last dot of its last part)."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.split(url, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / size
    entropy = F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(2.0, p)).otherwise(0.0))
    last = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": _count(F.col("host"), r"\."),
            "depth": _count(F.col("path"), "/[^/]"),
            "digit_ratio": _count(url, "[0-9]") / size,
            "host_digit_ratio": _count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1)),
            "hyphens": _count(F.col("host"), "-"),
            "entropy": entropy,
            "parameters": F.when(url.contains("?"), _count(url, "[?&][^?&#]")).otherwise(0.0),
            "fragment": url.contains("#").cast("double"),
            "bin": F.pmod(F.xxhash64(suffix), F.lit(BINS)),
            "suffix_length": F.length(suffix).cast("double"),
            "secure": url.startswith("https").cast("double"),
        }
    )


def examples(every: DataFrame) -> DataFrame:
    """The distinct URLs that a rule judges, with ``label`` (1.0 to block), the features, and ``held_out`` for a fifth of them by hash."""
    label = (F.col("fit.ruling") == "block").cast("double").alias("label")
    held_out = (F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0).alias("held_out")
    return every.where("fit is not null").select("url", label, held_out, *FEATURES).dropDuplicates(["url"])


def featured(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, ``fit`` (the rule, or null) and FEATURES of every row of ``pages``."""
    own = lexical(parsed(pages.select("page_id", "url")).withColumn("fit", fitting(rules)))
    bins = own.groupBy("bin").count()  # at most BINS rows
    shares = bins.select(F.col("bin").alias("of"), F.log1p("count").alias("suffix_count"))
    return own.join(F.broadcast(shares), own.bin == shares.of).drop("of", "bin")


def fitted(sample: DataFrame) -> PipelineModel | None:
    """Boosted trees on ``sample``, both verdicts weighing the same in all; None if it holds one verdict or none."""
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return None
    weight = F.when(F.col("label") == 1.0, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0]) * sum(counts.values())
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(sample.withColumn("weight", weight))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for every row of ``pages`` (page_id, url).

    A URL that a rule fits gets the rule's verdict, and is a labelled example. The others get that of gradient-boosted trees fitted
    on the examples that are not held out (at most TRAIN_ROWS distinct URLs); if these have one verdict only, that one; without any
    ``allow``. ``block_probability`` is the trees' own, for rows with a rule too, and null without trees.
    A null URL, or one without ``://``, has empty host and path and is judged by the trees like any other; a URL is read whole,
    however long. Rows that repeat are judged alike, an empty table gives an empty one, other columns are ignored.
    """
    every = saved(featured(pages, rules), "urls")
    sample = saved(examples(every).where("not held_out").orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS), "examples")
    if model := fitted(sample):
        judged = model.transform(every).withColumn("block_probability", vector_to_array("probability")[1])
        judged = judged.withColumn("method", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    else:
        only = "block" if sample.where("label = 1.0").limit(1).count() else "allow"
        judged = every.withColumns({"method": F.lit(only), "block_probability": F.lit(None).cast("double")})
    drop(sample)
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.ruling", "method").alias("verdict"), "block_probability")
