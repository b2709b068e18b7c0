"""URL filter: rules, then a logistic regression on hashed character n-grams of
host and path.  DataFrame and SQL functions only.

The model is trained from a small labelled URL table, an argument; ``LABELLED``
is the default.  Only hashes below ``FEATURES`` enter, so the model is a vector
of that length whatever the tables hold.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 12

#: (first label of the host, path): what unwanted and ordinary URLs look like.
UNWANTED = [
    ("casino-win", "/en/1"), ("best-casino", "/bonus"), ("online-casino-777", "/"), ("free-bets", "/en/3"), ("bet-now", "/odds"), ("sports-betting", "/live"),
    ("cheap-pills", "/en/2"), ("buy-pills-online", "/order"), ("discount-pharmacy", "/viagra"), ("viagra-shop", "/"), ("adult-x", "/en/4"), ("xxx-videos", "/watch"),
    ("adult-cams", "/live"), ("porn-tube", "/xxx"), ("spam-farm", "/de/5"), ("link-farm", "/seo-links"), ("spam-links", "/"), ("seo-spam", "/buy-links"),
    ("ads-track", "/fr/6"), ("ad-tracker", "/click?ad=1"), ("ads-banner", "/banner"), ("click-track", "/redirect"), ("win-free-prize", "/claim"), ("free-money-now", "/loan"),
    ("payday-loans", "/apply"), ("easy-loan", "/cash"), ("replica-watches", "/sale"), ("crack-keygen", "/download"), ("poker-slots", "/jackpot"), ("lottery-win", "/prize"),
]
ORDINARY = [
    ("news", "/en/1"), ("www.library", "/catalog/2"), ("blog.garden", "/fr/3"), ("docs", "/guide/index.html"), ("m.weather", "/today"), ("museum", "/de/4"),
    ("university", "/courses/physics"), ("www.city-council", "/meetings"), ("recipes", "/es/5"), ("history", "/article/6.html"), ("science", "/en/7"), ("blog.travel", "/notes"),
    ("forum", "/thread/8"), ("health", "/advice/sleep"), ("shop", "/books/9"), ("school", "/timetable"), ("photos", "/album/10"), ("wiki", "/en/page"),
    ("radio", "/program"), ("maps", "/route/11"), ("mail", "/inbox"), ("the-times", "/world/12"), ("music", "/concert"), ("data", "/set/13"),
    ("there", "/en/825"), ("other", "/de/25"), ("thing", "/es/685/"), ("bleeding", "/fr/676.html"), ("station", "/en/770"), ("therein", "/de/853"),
]
#: (url, block): each under every ending, so that the ending tells nothing.
LABELLED = [(f"https://{h}.example.{end}{p}", block) for block, rows in ((1, UNWANTED), (0, ORDINARY)) for h, p in rows for end in ("com", "org", "net")]

#: Host, path beginning, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/?#``, A-Z lower-cased; path from there
    up to ``?#``.  Both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """n-grams of host and path, each between marks and told apart by a letter;
    runs of digits are one digit."""


    def of(mark: str, part: Column, k: int) -> Column:
        s = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]+", "0"), F.lit("$"))
        starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(s, i, F.lit(k))))

    return F.concat(*[of(mark, part, k) for mark, part in (("h", host), ("p", path)) for k in sizes])


def vectors(urls: DataFrame) -> DataFrame:
    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return tf.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(url).alias("url"), F.lit(block).alias("block")) for url, block in LABELLED]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """From (url, block); null rows are left out.  None without both classes."""
    host, path = host_and_path()
    rows = vectors(labelled.filter("url IS NOT NULL AND block IS NOT NULL").select(host.alias("_host"), path.alias("_path"), F.col("block").cast("double").alias("label")))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=60).fit(rows)


def rule_for(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent
    domain of it and begins the path; null if none does."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*fits)


def judge(pages: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages``.

    The verdict is the rule's, or ``block`` where the probability of the model
    is at least ``threshold``.  A url that is null or has no ``://`` has empty
    host and path and is allowed unless the model blocks the empty one; without
    a model nothing is blocked by score (0).  Rows repeat as they come.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("_host"), path.alias("_path"))
    model = train(labelled)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        odds = model.setFeaturesCol("_features").setProbabilityCol("_p").transform(vectors(rows))
        scored = odds.withColumn("score", vector_to_array("_p")[1])
    scored = scored.withColumn("_rule", rule_for(F.col("_host"), F.col("_path")))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
