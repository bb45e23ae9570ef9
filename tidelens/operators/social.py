"""Social metrics over scored posts.

Post rows: post_id, platform, content, author, followers, ts, sentiment, confidence,
engagement (map), protocols (array). One post counts for each of its protocols; all
protocol metrics are one grouped aggregate with conditional sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div
from ..functions.rolling import mean
from ..session import cut_lineage, stored
from .ordered import numbered
from .series import blocks, number_rows, unblock

# Fixed values.
FUD_WORDS = ("scam", "rugpull", "exit scam", "ponzi", "dump", "crash", "hack")
MIN_FOLLOWERS = 1000
VIRAL_FOLLOWERS = 10000
FEW_WORDS = 100_000  # frequent words that are sent to all tasks

# Tracked protocols and their keywords.
KEYWORDS = {
    "ethereum": ["eth", "$eth", "ethereum", "ether"],
    "bitcoin": ["btc", "$btc", "bitcoin"],
    "uniswap": ["uni", "$uni", "uniswap"],
    "aave": ["aave", "$aave"],
    "compound": ["comp", "$comp", "compound"],
    "maker": ["mkr", "$mkr", "maker", "dai"],
    "curve": ["crv", "$crv", "curve"],
    "sushiswap": ["sushi", "$sushi", "sushiswap"],
    "chainlink": ["link", "$link", "chainlink"],
    "polygon": ["matic", "$matic", "polygon"],
}

# Our own short list of English stop words.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being but by can could did do does for from had has have he her "
    "here him his how i if in into is it its just me more most my no not now of on only or other our out over she so some such than that "
    "the their them then there these they this those to too under up very was we were what when where which who why will with would you your"
).split()


def engagement_sum(engagement: Column) -> Column:
    return F.aggregate(F.map_values(engagement), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long"))


def by_protocol(posts: DataFrame) -> DataFrame:
    """One row per (post, protocol) with the engagement total; the text is kept only when asked."""
    return posts.withColumn("eng", engagement_sum(F.col("engagement"))).withColumn("protocol", F.explode("protocols")).drop("protocols", "engagement")


def _influence() -> Column:
    return F.when(F.col("followers") >= MIN_FOLLOWERS, F.log10(F.col("followers") / MIN_FOLLOWERS))


def weighted_sentiment() -> Column:
    return F.coalesce(div(F.sum(F.col("sentiment") * F.col("confidence")), F.sum("confidence")), F.lit(0.0))


def is_fud(content) -> Column:
    return F.lower(content).rlike("|".join(w for w in FUD_WORDS))


def deterioration(rows: DataFrame, share: float = 0.7, drop: float = 0.3, least: int = 10) -> DataFrame:
    """Mean sentiment of the first ``share`` of each protocol's posts by time against the rest.

    Posts are numbered over ranges of rows, so a protocol with most posts is not sorted in one task.
    """
    x = numbered(rows.select("protocol", "ts", "post_id", "sentiment"), ["protocol"], ["ts", "post_id"])
    n = rows.groupBy("protocol").agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, "protocol")
    old = F.col("_rn") <= F.floor(F.col("_n") * share)
    g = x.groupBy("protocol").agg(F.max("_n").alias("_n"), F.avg(F.when(old, F.col("sentiment"))).alias("older"), F.avg(F.when(~old, F.col("sentiment"))).alias("recent"))
    return g.select("protocol", "older", "recent", ((F.col("_n") >= least) & (F.col("older") - F.col("recent") > drop)).alias("deteriorated"))


def measures(now: Column, distinct=F.count_distinct) -> list[Column]:
    """The aggregates of one protocol (or of one protocol and window, with an approximate
    ``distinct``, where streams cannot count exactly)."""
    n = F.count(F.lit(1))
    w = _influence()
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    influencer = div(F.sum(F.col("sentiment") * w), F.sum(w))
    viral = (
        F.avg("eng") / 1000.0 * 0.3 + distinct("author") / n * 0.2
        + share(F.col("ts") > now - F.expr("INTERVAL 3 HOURS")) * 0.3 + share(F.col("followers") > VIRAL_FOLLOWERS) * 0.2)
    return [
        n.alias("mention_count"), distinct("author").alias("unique_authors"), weighted_sentiment().alias("sentiment_score"),
        F.avg("confidence").alias("sentiment_confidence"), F.coalesce(F.stddev_pop("sentiment"), F.lit(0.0)).alias("sentiment_volatility"),
        F.sum("eng").alias("total_engagement"), F.coalesce(influencer, weighted_sentiment()).alias("influencer_sentiment"),
        F.least(viral, F.lit(1.0)).alias("viral_score"),
        (share(F.col("sentiment") < -0.5) > 0.3).alias("negative"), (share(F.col("fud")) > 0.1).alias("fud_spread"),
        (share((F.col("sentiment") < -0.3) & (F.col("eng") < 5)) > 0.2).alias("quiet"),
    ]


def signal_list(deteriorated: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.col("negative"), "high_negative_sentiment"), F.when(F.col("fud_spread"), "fud_spreading"),
        F.when(deteriorated, "sentiment_deterioration"), F.when(F.col("quiet"), "widespread_quiet_negativity")))


def protocol_metrics(posts: DataFrame, now: Column | None = None) -> DataFrame:
    """The full metrics row of every protocol."""
    rows = by_protocol(posts.withColumn("fud", is_fud(F.col("content"))).drop("content"))
    now = now if now is not None else posts.agg(F.max("ts")).scalar()
    m = rows.groupBy("protocol").agg(*measures(now))
    d = deterioration(rows.select("protocol", "post_id", "ts", "sentiment"))
    out = m.join(d.select("protocol", "deteriorated"), "protocol")
    return out.withColumn("risk_signals", signal_list(F.col("deteriorated"))).drop("negative", "fud_spread", "quiet", "deteriorated")


def themes(posts: DataFrame, top: int = 10, features: int = 100, floor: float = 0.1) -> DataFrame:
    """Top words and word pairs per protocol by L2-normalised count over the ``features`` most frequent.

    Words have two letters or more; stop words are removed before pairing. Whole texts
    are used: words are exploded and counted with map-side combine. A pair is no more frequent
    than either of its words, so pairs are only counted of words that are as frequent as the
    last of the best ``features`` words of a protocol: no other pair can be among its best terms.
    """
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))
    x = stored(posts.select("protocols", words.alias("_w")))  # texts are cut into words once

    def by_term(rows: DataFrame, *term: str) -> DataFrame:
        # count per tag set first: the term stream is not multiplied by the tags
        counts = rows.groupBy("protocols", *term).agg(F.count(F.lit(1)).alias("n")).select(F.explode("protocols").alias("protocol"), *term, "n")
        return counts.groupBy("protocol", *term).agg(F.sum("n").alias("n")).select("protocol", F.concat_ws(" ", *term).alias("term"), "n")

    single = by_term(x.select("protocols", F.explode("_w").alias("a")), "a")
    place = F.rank().over(Window.partitionBy("protocol").orderBy(F.col("n").desc()))
    single = cut_lineage(single.withColumn("_p", place).filter(F.col("_p") <= features).drop("_p"))
    often = single.select("term").distinct()
    often = F.broadcast(often) if often.count() <= FEW_WORDS else often  # more only of words that are equally frequent
    but_one = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = x.select("protocols", F.explode(F.arrays_zip(F.slice("_w", 1, but_one).alias("a"), F.slice("_w", 2, but_one).alias("b"))).alias("t"))
    pairs = pairs.select("protocols", "t.a", "t.b")
    for side in "ab":
        pairs = pairs.join(often.select(F.col("term").alias(side)), side)
    counts = single.unionByName(by_term(pairs, "a", "b"))
    w = Window.partitionBy("protocol").orderBy(F.col("n").desc(), "term")
    best = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= features)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("protocol")))  # at most ``features`` rows
    return best.withColumn("score", F.col("n") / norm).filter((F.col("rank") <= top) & (F.col("score") > floor))


def influence_weight(followers: Column, accuracy: Column, multiplier: float = 5.0) -> Column:
    """Base (log10 of followers over the floor, plus 1) times accuracy weight, capped at 10."""
    base = F.log10(F.greatest(followers, F.lit(MIN_FOLLOWERS)) / MIN_FOLLOWERS) + 1.0
    return F.least(base * F.coalesce(accuracy + 0.5, F.lit(1.0)) * multiplier, F.lit(10.0))


def influencer_accuracy(outcomes: DataFrame) -> DataFrame:
    """A running mean with step 1/(n+1) from any start is the mean of all outcomes."""
    return outcomes.groupBy("platform", "author").agg(F.avg("outcome").alias("accuracy_score"), F.count(F.lit(1)).alias("prediction_count"))


def top_influencers(posts: DataFrame, accuracy: DataFrame, n: int = 10) -> DataFrame:
    people = posts.groupBy("platform", "author").agg(F.max("followers").alias("followers"), F.count(F.lit(1)).alias("posts"))
    x = people.join(accuracy, ["platform", "author"], "left").withColumn("influence_weight", influence_weight(F.col("followers"), F.col("accuracy_score")))
    w = Window.partitionBy("platform").orderBy(F.col("influence_weight").desc(), "author")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def trending(posts: DataFrame, n: int = 10) -> DataFrame:
    rows = by_protocol(posts.select("post_id", "engagement", "protocols"))
    return rows.groupBy("protocol").agg(F.sum("eng").alias("engagement"), F.count(F.lit(1)).alias("posts")).orderBy(F.col("engagement").desc(), "protocol").limit(n)


def hourly_metrics(posts: DataFrame) -> DataFrame:
    """Metric history: one row per protocol and hour."""
    rows = by_protocol(posts.drop("content"))
    return rows.groupBy("protocol", F.date_trunc("hour", "ts").alias("ts")).agg(
        weighted_sentiment().alias("sentiment_score"), F.count(F.lit(1)).alias("mention_count"), F.sum("eng").alias("engagement"),
        (F.avg("eng") / 1000.0 * 0.3 + F.count_distinct("author") / F.count(F.lit(1)) * 0.2).alias("viral_score"),
        F.count_if(F.col("sentiment") < -0.5).alias("negatives"))


def trends(history: DataFrame) -> DataFrame:
    """Slope in time order, range, volatility and correlation per protocol."""
    x = number_rows(history, ("protocol",), ("ts",), F.date_trunc("month", "ts"))
    i = (F.col("_rn") - 1).cast("double")
    s, v = F.regr_slope("sentiment_score", i), F.regr_slope(F.col("mention_count").cast("double"), i)
    t = x.groupBy("protocol").agg(
        F.coalesce(s, F.lit(0.0)).alias("slope"), F.coalesce(v, F.lit(0.0)).alias("volume_slope"), F.max_by("sentiment_score", "ts").alias("current"),
        F.min("sentiment_score").alias("lowest"), F.max("sentiment_score").alias("highest"), F.avg("sentiment_score").alias("mean"),
        F.stddev_pop("sentiment_score").alias("volatility"), F.corr("sentiment_score", F.col("mention_count").cast("double")).alias("sentiment_volume"))
    return t.withColumns({
        "direction": F.when(F.col("slope") > 0.01, "bullish").when(F.col("slope") < -0.01, "bearish").otherwise("neutral"),
        "volume_direction": F.when(F.col("volume_slope") > 0, "increasing").otherwise("decreasing")})


def anomalies(history: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """Rows over ``threshold`` population deviations from the protocol's mean."""
    st = history.groupBy("protocol").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n")).filter("_n >= 3")
    z = div(F.col(value) - F.col("_m"), "_s")
    return history.join(st, "protocol").withColumn("z_score", z).filter(F.abs("z_score") > threshold).select(
        "protocol", "ts", value, "z_score", F.when(F.col("z_score") > 0, "positive").otherwise("negative").alias("type"))


def moving_averages(history: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    x = number_rows(history.withColumnRenamed("protocol", "symbol"), ("symbol",), ("ts",))
    x = unblock(blocks(x, long).withColumns({"short_term": mean("sentiment_score", short), "long_term": mean("sentiment_score", long)}))
    return x.select(F.col("symbol").alias("protocol"), "ts", "short_term", "long_term",
                    F.coalesce(F.col("short_term") > F.col("long_term"), F.lit(False)).alias("golden_cross"))


def shifts(history: DataFrame, threshold: float = 0.2, least: int = 5) -> DataFrame:
    """First against second half of each protocol's history by time."""
    x = number_rows(history, ("protocol",), ("ts",), F.date_trunc("month", "ts"))
    n = history.groupBy("protocol").agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, "protocol").filter(F.col("_n") >= least)
    old = F.col("_rn") <= F.floor(F.col("_n") / 2)
    g = x.groupBy("protocol").agg(F.avg(F.when(old, F.col("sentiment_score"))).alias("older"), F.avg(F.when(~old, F.col("sentiment_score"))).alias("recent"))
    change = F.col("recent") - F.col("older")
    return g.withColumns({
        "magnitude": change, "direction": F.when(change > 0, "positive").otherwise("negative"), "confidence": F.least(F.abs(change) * 5.0, F.lit(1.0)),
    }).filter(F.abs("magnitude") > threshold)


def compare(history: DataFrame) -> DataFrame:
    """Means, sums and three rankings; the rankings run over one row per protocol."""
    g = history.groupBy("protocol").agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.stddev_pop("sentiment_score").alias("sentiment_std"),
        F.sum("mention_count").alias("total_mentions"), F.avg("viral_score").alias("avg_viral_score"), F.sum("negatives").alias("signals"))
    ranks = {f"by_{n}": F.rank().over(Window.orderBy(F.col(k).desc())) for n, k in (("sentiment", "avg_sentiment"), ("volume", "total_mentions"), ("viral", "avg_viral_score"))}
    return g.withColumns(ranks)


def market_sentiment(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("sentiment_score").alias("overall_sentiment"), F.sum("mention_count").alias("mentions"), F.count(F.lit(1)).alias("protocols"))


def top_risks(metrics: DataFrame, n: int = 5) -> DataFrame:
    return metrics.select("protocol", F.explode("risk_signals").alias("risk")).groupBy("protocol", "risk").agg(
        F.count(F.lit(1)).alias("frequency")).orderBy(F.col("frequency").desc(), "protocol", "risk").limit(n)


def alerts(shift_rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return shift_rows.filter(F.abs("magnitude") > threshold).select(
        "protocol", "magnitude", "direction", F.when(F.abs("magnitude") > 0.7, "high").otherwise("medium").alias("severity"))


def tag_protocols(posts: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """(post_id, protocol) by keyword: tokens of the text joined to the small keyword table."""
    pairs = [(w, p) for p, ws in (keywords or KEYWORDS).items() for w in ws]
    words = posts.sparkSession.createDataFrame(pairs, "token string, protocol string")  # fixed list, a few dozen rows
    tokens = posts.select("post_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\$?[\p{L}\p{N}_]+)"), F.lit(1)))).alias("token"))
    return tokens.join(F.broadcast(words), "token").select("post_id", "protocol").distinct()


def hygiene(posts: DataFrame, shortest: int = 10, longest: int = 500, languages=("en",), max_links: int = 3) -> DataFrame:
    """Length and language filter, spam by link count, bots by posting without letters, one copy per text."""
    size = F.length("content")
    ok = posts.filter(size.between(shortest, longest) & F.col("lang").isin(*languages))
    ok = ok.filter((F.regexp_count("content", F.lit("https?://")) < max_links) & F.col("content").rlike("[A-Za-z]"))
    key = F.sha2("content", 256)
    first = ok.groupBy(key.alias("_k")).agg(F.min("post_id").alias("post_id"))
    return ok.join(first.select("post_id"), "post_id", "left_semi")


def source_mix(posts: DataFrame) -> DataFrame:
    g = posts.groupBy("platform").agg(F.count(F.lit(1)).alias("posts"))
    total = g.agg(F.sum("posts")).scalar()
    return g.withColumn("share", div("posts", total))


def chart_series(history: DataFrame) -> DataFrame:
    """Points per protocol and day for charts: a bounded array of at most 24 hours."""
    point = F.struct("ts", "sentiment_score", "mention_count")
    return history.groupBy("protocol", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(point)).alias("points"))


def daily_summary(metrics: DataFrame, trend_rows: DataFrame, shift_rows: DataFrame, trend_posts: DataFrame) -> DataFrame:
    s = shift_rows.select("protocol", F.col("magnitude").alias("shift"))
    t = trend_rows.select("protocol", "direction", "slope")
    e = trend_posts.select("protocol", "engagement")
    return metrics.join(t, "protocol", "left").join(s, "protocol", "left").join(e, "protocol", "left")
