"""Operator 3: URL rules and, for the other URLs, gradient-boosted trees on lexical features; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, small_side, stored

ALLOW, BLOCK = "allow", "block"
#: URLs per class, on average, that the trees are trained on.
SAMPLE_PER_CLASS = 20_000
SMOOTHING = 20
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "path_depth", "params", "digit_ratio", "hyphens",
            "entropy", "suffix_pages", "suffix_block_rate", "domain_pages")


def parse(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path to (page columns): see ``judge``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (pages.withColumn("_rest", rest)
            .withColumn("host", ascii_lower(F.regexp_extract("_rest", "^[^/?#]*", 0)))
            .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def matching_rule(rules: list[tuple[str, str]]) -> Column:
    """The longest rule, as (chars, rule, verdict), that fits host and path, or null. ``rules``: ('host/path', verdict).

    Of two rules of the same length the later one in code point order is taken.
    """
    def fit(rule: str, verdict: str) -> Column:
        host, slash, path = rule.partition("/")
        on_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        return F.when(on_host & F.startswith(F.col("path"), F.lit(slash + path)),
                      F.struct(F.lit(len(rule)).alias("chars"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.array_max(F.array(*[fit(*r) for r in rules]))


def _with_features(urls: DataFrame, suffixes: DataFrame, n_suffixes: int, domains: DataFrame, n_domains: int, prior: float) -> DataFrame:
    """Add ``FEATURES`` to (url, host, path, suffix, domain, ruled).

    The share of blocked URLs among those of the suffix that rules label leaves out the row's own label, so that no
    training row sees its answer; ``SMOOTHING`` URLs of the ``prior`` share are added to each suffix.
    """
    url = F.col("url")
    chars = F.length(url)

    def times(one: Column) -> Column:
        return F.length(url) - F.length(F.replace(url, one, F.lit("")))

    def part(one: Column) -> Column:
        p = times(one) / chars
        return -p * F.log2(p)

    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                          lambda acc, c: acc + F.when((F.length(c) > 0) & (times(c) > 0), part(c)).otherwise(0.0))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    urls = urls.select(
        "*", chars.cast("double").alias("url_chars"), F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        F.regexp_count("path", F.lit("/+")).cast("double").alias("path_depth"),
        F.when(F.length(query) > 0, F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).otherwise(0).cast("double").alias("params"),
        F.coalesce((chars - F.length(F.translate(url, "0123456789", ""))) / F.when(chars > 0, chars), F.lit(0.0)).alias("digit_ratio"),
        times(F.lit("-")).cast("double").alias("hyphens"), entropy.alias("entropy"))
    own, own_block = F.col("ruled").isNotNull().cast("int"), F.coalesce(F.col("ruled") == BLOCK, F.lit(False)).cast("int")
    rate = (F.col("suffix_blocked") - own_block + SMOOTHING * prior) / (F.col("suffix_ruled") - own + SMOOTHING)
    joined = urls.join(small_side(suffixes, n_suffixes), "suffix", "left").join(small_side(domains, n_domains), "domain", "left")
    return joined.withColumn("suffix_block_rate", rate).drop("suffix_blocked", "suffix_ruled")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          sample_per_class: int = SAMPLE_PER_CLASS, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Allow or block every URL: by the longest rule that fits, else by gradient-boosted trees.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. A URL that is
    null or has no ``://`` has an empty host and path. A rule ``host/path``
    fits its host and all subdomains if the URL's path starts with ``/path``.
    Rules are a short list, which becomes part of the plan.

    The trees learn from the URLs that rules label, on a sample of about
    ``sample_per_class`` of each verdict picked by a hash of the URL. Features:
    lengths, path depth, host labels, digit ratio, character entropy, number
    of parameters, hyphens, and statistics of the host's last label and of its last two
    (pages, and the smoothed share of blocked ones among the others that rules
    label), which are taken over all pages; ``features`` may name fewer. If the rules label none or
    only one verdict, the other URLs get that verdict (none: allow).

    Returns one row per input row: id, host, path, rule (else null), verdict,
    ``score`` (the trees' probability of block; null where a rule decides or
    nothing was learnt). Repeated rows each get theirs; other columns are not
    looked at; an empty table gives no rows.
    """
    base = parse(pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")))
    base = base.withColumn("_m", matching_rule(rules)).select(
        "id", "url", "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("ruled"),
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))
    base = stored(base, "urls")
    blocked = F.col("ruled") == BLOCK
    counts = {r["ruled"]: r["n"] for r in base.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    n_block, n_allow = counts.get(BLOCK, 0), counts.get(ALLOW, 0)
    if not (n_block and n_allow):
        return base.select(F.col("id").alias(id_col), "host", "path", "rule",
                           F.coalesce("ruled", F.lit(BLOCK if n_block else ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior = n_block / (n_block + n_allow)
    suffixes = stored(base.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_pages"),
        F.count(F.when(blocked, 1)).alias("suffix_blocked"), F.count("ruled").alias("suffix_ruled")), "suffixes")
    domains = stored(base.groupBy("domain").agg(F.log1p(F.count("*")).alias("domain_pages")), "domains")
    rows = _with_features(base, suffixes, suffixes.count(), domains, domains.count(), prior)

    share = F.when(blocked, min(1.0, sample_per_class / n_block)).otherwise(min(1.0, sample_per_class / n_allow))
    labelled = rows.where(F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("url", "id"), F.lit(1_000_003)) / 1_000_003.0 < share))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    train = stored(labelled.select(*features, blocked.cast("double").alias("label")), "url-sample")
    if train.select("label").distinct().count() < 2:
        return base.select(F.col("id").alias(id_col), "host", "path", "rule",
                           F.coalesce("ruled", F.lit(BLOCK if prior >= 0.5 else ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=10, maxDepth=4, stepSize=0.3, seed=7).fit(assembler.transform(train))
    trees.setProbabilityCol("_p").setPredictionCol("_prediction")
    scored = PipelineModel([assembler, trees]).transform(rows)
    verdict = F.coalesce("ruled", F.when(F.col("_prediction") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
                         F.when(F.col("ruled").isNull(), vector_to_array("_p")[1]).alias("score"))
