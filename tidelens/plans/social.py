"""Social metric queries over posts derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd, rounded
from ..operators import social as S
from ..sources import domain as D
from .catalog import query

P = D.POSTS_SQL
_FUD = "regexp_matches(lower(content), 'scam|rugpull|exit scam|ponzi|dump|crash|hack')"
_M = f"""n0 AS (SELECT max(ts) AS now FROM posts), pr AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY ts, post_id) AS rn, count(*) OVER (PARTITION BY protocol) AS cn FROM pp),
de AS (SELECT protocol, avg(sentiment) FILTER (rn <= floor(cn * 0.7)) AS older, avg(sentiment) FILTER (rn > floor(cn * 0.7)) AS recent, max(cn) AS cn FROM pr GROUP BY 1),
me AS (SELECT protocol, count(*) AS mention_count, count(DISTINCT author) AS unique_authors, sum(sentiment * confidence) / sum(confidence) AS sentiment_score, avg(confidence) AS sentiment_confidence, stddev_pop(sentiment) AS sentiment_volatility,
 CAST(sum(engagement) AS BIGINT) AS total_engagement, coalesce(sum(sentiment * log10(followers / 1000)) FILTER (followers >= 1000) / nullif(sum(log10(followers / 1000)) FILTER (followers >= 1000), 0), sum(sentiment * confidence) / sum(confidence)) AS influencer_sentiment,
 least(avg(engagement) / 1000 * 0.3 + count(DISTINCT author) / count(*) * 0.2 + avg(CASE WHEN ts > now - INTERVAL 3 HOUR THEN 1.0 ELSE 0.0 END) * 0.3 + avg(CASE WHEN followers > 10000 THEN 1.0 ELSE 0.0 END) * 0.2, 1) AS viral_score,
 avg(CASE WHEN sentiment < -0.5 THEN 1.0 ELSE 0.0 END) > 0.3 AS neg, avg(CASE WHEN {_FUD} THEN 1.0 ELSE 0.0 END) > 0.1 AS fud, avg(CASE WHEN sentiment < -0.3 AND engagement < 5 THEN 1.0 ELSE 0.0 END) > 0.2 AS quiet FROM pp, n0 GROUP BY protocol),
ms AS (SELECT me.*, list_filter([CASE WHEN neg THEN 'high_negative_sentiment' END, CASE WHEN fud THEN 'fud_spreading' END, CASE WHEN cn >= 10 AND older - recent > 0.3 THEN 'sentiment_deterioration' END, CASE WHEN quiet THEN 'widespread_quiet_negativity' END], lambda x: x IS NOT NULL) AS risk_signals FROM me JOIN de USING (protocol))"""
_COLS = """protocol, mention_count, unique_authors, round(sentiment_score, 6) AS sentiment_score, round(sentiment_confidence, 6) AS sentiment_confidence, round(sentiment_volatility, 6) AS sentiment_volatility, total_engagement,
 round(influencer_sentiment, 6) AS influencer_sentiment, round(viral_score, 6) AS viral_score"""
_R = ["sentiment_score", "sentiment_confidence", "sentiment_volatility", "influencer_sentiment", "viral_score"]


def _metrics(spark, root):
    return S.protocol_metrics(D.posts(spark, root))


@query("social_metrics", "SO-1 SO-2 SO-3 SO-4 SO-5 SO-6 SO-7 SO-9 SO-10 SO-11 SO-12 SO-13", f"WITH {P}, {_M} SELECT {_COLS}, array_to_string(risk_signals, ',') AS risk_signals FROM ms")
def social_metrics(spark, root):
    return rounded(_metrics(spark, root), _R).withColumn("risk_signals", F.array_join("risk_signals", ","))


@query("sentiment_deterioration", "SO-11", f"WITH {P}, {_M} SELECT protocol, round(older, 6) + 0.0 AS older, round(recent, 6) + 0.0 AS recent, cn >= 10 AND older - recent > 0.3 AS deteriorated FROM de")
def sentiment_deterioration(spark, root):
    rows = S.by_protocol(D.posts(spark, root)).select("protocol", "post_id", "ts", "sentiment")
    return rounded(S.deterioration(rows), ["older", "recent"])


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query("dominant_themes", "SO-8 FN-1 FN-6", rf"""WITH {P}, w AS (SELECT protocols, list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains([{_STOP}], x)) AS w FROM posts),
t AS (SELECT protocols, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT unnest(protocols) AS protocol, term FROM t), g AS (SELECT protocol, term, count(*) AS n FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY n DESC, term) AS rank FROM g), b AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY protocol)) AS score FROM r WHERE rank <= 100)
SELECT protocol, term, n, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM b WHERE rank <= 10 AND score > 0.1""")
def dominant_themes(spark, root):
    return rounded(S.themes(D.posts(spark, root)), ["score"])


_OUT = "oc AS (SELECT platform, author, avg(CASE WHEN (post_id * 13) % 10 < 6 THEN 1.0 ELSE 0.0 END) AS accuracy_score, count(*) AS prediction_count FROM posts GROUP BY 1, 2)"


def _accuracy(spark, root):
    p = D.posts(spark, root)
    return S.influencer_accuracy(p.select("platform", "author", F.when((F.col("post_id") * 13) % 10 < 6, 1.0).otherwise(0.0).alias("outcome")))


@query("influencer_accuracy", "SO-15", f"WITH {P}, {_OUT} SELECT platform, author, round(accuracy_score, 6) AS accuracy_score, prediction_count FROM oc")
def influencer_accuracy(spark, root):
    return rounded(_accuracy(spark, root), ["accuracy_score"])


@query("top_influencers", "SO-14 SRT-5", f"""WITH {P}, {_OUT}, pe AS (SELECT platform, author, max(followers) AS followers, count(*) AS posts FROM posts GROUP BY 1, 2),
w AS (SELECT platform, author, followers, posts, round(least((log10(greatest(followers, 1000) / 1000.0) + 1) * coalesce(accuracy_score + 0.5, 1.0) * 5, 10), 6) AS influence_weight FROM pe LEFT JOIN oc USING (platform, author)),
r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY influence_weight DESC, author) AS rk FROM w) SELECT platform, author, followers, posts, influence_weight, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10""")
def top_influencers(spark, root):
    return rounded(S.top_influencers(D.posts(spark, root), _accuracy(spark, root)), ["influence_weight"]).drop("accuracy_score", "prediction_count")


@query("recent_posts", "SO-16 FLT-6", f"WITH {P} SELECT post_id, platform, ts FROM posts WHERE ts >= (SELECT max(ts) FROM posts) - INTERVAL 24 HOUR")
def recent_posts(spark, root):
    p = D.posts(spark, root).select("post_id", "platform", "ts")
    return p.filter(F.col("ts") >= p.agg(F.max("ts")).scalar() - F.expr("INTERVAL 24 HOURS"))


@query("trending", "SO-17 SRT-6", f"WITH {P} SELECT protocol, CAST(sum(engagement) AS BIGINT) AS engagement, count(*) AS posts FROM pp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def trending(spark, root):
    return S.trending(D.posts(spark, root))


_H = f"""{P}, hm AS (SELECT protocol, date_trunc('hour', ts) AS ts, sum(sentiment * confidence) / sum(confidence) AS sentiment_score, count(*) AS mention_count, CAST(sum(engagement) AS BIGINT) AS engagement,
 avg(engagement) / 1000 * 0.3 + count(DISTINCT author) / count(*) * 0.2 AS viral_score, count(*) FILTER (sentiment < -0.5) AS negatives FROM pp GROUP BY 1, 2), hr AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY protocol) AS cn FROM hm)"""


def _history(spark, root):
    return S.hourly_metrics(D.posts(spark, root))


@query("hourly_social_metrics", "SO-16", f"WITH {_H} SELECT protocol, ts, round(sentiment_score, 6) + 0.0 AS sentiment_score, mention_count, engagement, round(viral_score, 6) AS viral_score, negatives FROM hm")
def hourly_social_metrics(spark, root):
    return rounded(_history(spark, root), ["sentiment_score", "viral_score"])


_T = """tr AS (SELECT protocol, coalesce(regr_slope(sentiment_score, rn - 1), 0) AS slope, coalesce(regr_slope(mention_count, rn - 1), 0) AS volume_slope, arg_max(sentiment_score, ts) AS current, min(sentiment_score) AS lowest, max(sentiment_score) AS highest,
 avg(sentiment_score) AS mean, stddev_pop(sentiment_score) AS volatility, corr(sentiment_score, mention_count) AS sv FROM hr GROUP BY 1)"""


@query("sentiment_trends", "SO-18 SO-21", f"""WITH {_H}, {_T} SELECT protocol, round(slope, 6) + 0.0 AS slope, round(volume_slope, 6) + 0.0 AS volume_slope, round(current, 6) + 0.0 AS current, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(mean, 6) + 0.0 AS mean, round(volatility, 6) AS volatility,
 round(sv, 6) + 0.0 AS sentiment_volume, CASE WHEN slope > 0.01 THEN 'bullish' WHEN slope < -0.01 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN volume_slope > 0 THEN 'increasing' ELSE 'decreasing' END AS volume_direction FROM tr""")
def sentiment_trends(spark, root):
    return rounded(S.trends(_history(spark, root)), ["slope", "volume_slope", "current", "lowest", "highest", "mean", "volatility", "sentiment_volume"])


@query("sentiment_anomalies", "SO-19", f"""WITH {_H}, z AS (SELECT protocol, ts, sentiment_score, (sentiment_score - avg(sentiment_score) OVER p) / nullif(stddev_pop(sentiment_score) OVER p, 0) AS z, cn FROM hr WINDOW p AS (PARTITION BY protocol))
SELECT protocol, ts, round(sentiment_score, 6) AS sentiment_score, round(z, 6) AS z_score, CASE WHEN z > 0 THEN 'positive' ELSE 'negative' END AS type FROM z WHERE abs(z) > 1.5 AND cn >= 3""")
def sentiment_anomalies(spark, root):
    return rounded(S.anomalies(_history(spark, root), "sentiment_score", 1.5), ["sentiment_score", "z_score"])


@query("sentiment_moving_averages", "SO-20", f"""WITH {_H}, m AS (SELECT protocol, ts, CASE WHEN count(*) OVER a = 7 THEN avg(sentiment_score) OVER a END AS s, CASE WHEN count(*) OVER b = 30 THEN avg(sentiment_score) OVER b END AS l FROM hm
 WINDOW a AS (PARTITION BY protocol ORDER BY ts ROWS 6 PRECEDING), b AS (PARTITION BY protocol ORDER BY ts ROWS 29 PRECEDING)) SELECT protocol, ts, round(s, 6) + 0.0 AS short_term, round(l, 6) + 0.0 AS long_term, coalesce(s > l, FALSE) AS golden_cross FROM m""")
def sentiment_moving_averages(spark, root):
    return rounded(S.moving_averages(_history(spark, root)), ["short_term", "long_term"])


@query("compare_protocols", "SO-22 SRT-8", f"""WITH {_H}, g AS (SELECT protocol, avg(sentiment_score) AS a, stddev_pop(sentiment_score) AS s, CAST(sum(mention_count) AS BIGINT) AS m, avg(viral_score) AS v, CAST(sum(negatives) AS BIGINT) AS n FROM hm GROUP BY 1)
SELECT protocol, round(a, 6) + 0.0 AS avg_sentiment, round(s, 6) AS sentiment_std, m AS total_mentions, round(v, 6) AS avg_viral_score, n AS signals, CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS by_sentiment, CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS by_volume, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS by_viral FROM g""")
def compare_protocols(spark, root):
    return rounded(S.compare(_history(spark, root)), ["avg_sentiment", "sentiment_std", "avg_viral_score"])


_SH = "sh AS (SELECT protocol, avg(sentiment_score) FILTER (rn <= floor(cn / 2)) AS older, avg(sentiment_score) FILTER (rn > floor(cn / 2)) AS recent FROM hr WHERE cn >= 5 GROUP BY 1), sx AS (SELECT *, recent - older AS mag FROM sh)"


@query("sentiment_shifts", "SO-23 SRT-7", f"""WITH {_H}, {_SH} SELECT protocol, round(older, 6) + 0.0 AS older, round(recent, 6) + 0.0 AS recent, round(mag, 6) AS magnitude, CASE WHEN mag > 0 THEN 'positive' ELSE 'negative' END AS direction, round(least(abs(mag) * 5, 1), 6) AS confidence
FROM sx WHERE abs(mag) > 0.01 ORDER BY abs(mag) DESC LIMIT 5""")
def sentiment_shifts(spark, root):
    s = S.shifts(_history(spark, root), threshold=0.01)
    return rounded(s, ["older", "recent", "magnitude", "confidence"]).orderBy(F.abs("magnitude").desc()).limit(5)


@query("sentiment_alerts", "SO-27", f"WITH {_H}, {_SH} SELECT protocol, round(mag, 6) AS magnitude, CASE WHEN mag > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(mag) > 0.7 THEN 'high' ELSE 'medium' END AS severity FROM sx WHERE abs(mag) > 0.02")
def sentiment_alerts(spark, root):
    return rounded(S.alerts(S.shifts(_history(spark, root), threshold=0.01), 0.02), ["magnitude"])


@query("daily_summary", "SO-24 SO-28", f"""WITH {_H}, {_M}, {_T}, {_SH}, e AS (SELECT protocol, CAST(sum(engagement) AS BIGINT) AS engagement FROM pp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT ms.protocol, mention_count, round(sentiment_score, 6) + 0.0 AS sentiment_score, CASE WHEN slope > 0.01 THEN 'bullish' WHEN slope < -0.01 THEN 'bearish' ELSE 'neutral' END AS direction, round(slope, 6) + 0.0 AS slope, round(sx.mag, 6) AS shift, e.engagement
FROM ms LEFT JOIN tr USING (protocol) LEFT JOIN (SELECT * FROM sx WHERE abs(mag) > 0.01) sx USING (protocol) LEFT JOIN e USING (protocol)""")
def daily_summary(spark, root):
    posts, h = D.posts(spark, root), _history(spark, root)
    m = _metrics(spark, root).select("protocol", "mention_count", "sentiment_score")
    return rounded(S.daily_summary(m, S.trends(h), S.shifts(h, threshold=0.01), S.trending(posts)), ["sentiment_score", "slope", "shift"])


@query("dashboard_series", "SO-25", f"WITH {_H} SELECT protocol, CAST(ts AS DATE) AS day, count(*) AS points, CAST(sum(mention_count) AS BIGINT) AS mentions, round(arg_min(sentiment_score, ts), 6) + 0.0 AS first_score FROM hm GROUP BY 1, 2")
def dashboard_series(spark, root):
    c = S.chart_series(_history(spark, root))
    return c.select("protocol", "day", F.size("points").cast("long").alias("points"), F.aggregate("points", F.lit(0).cast("long"), lambda a, x: a + x["mention_count"]).alias("mentions"),
                    rnd(F.col("points")[0]["sentiment_score"]).alias("first_score"))


@query("market_sentiment", "SO-26", f"WITH {P}, {_M} SELECT round(avg(sentiment_score), 6) + 0.0 AS overall_sentiment, CAST(sum(mention_count) AS BIGINT) AS mentions, count(*) AS protocols FROM ms")
def market_sentiment(spark, root):
    return rounded(S.market_sentiment(_metrics(spark, root)), ["overall_sentiment"])


@query("top_risks", "AG-41", f"WITH {P}, {_M} SELECT protocol, risk, count(*) AS frequency FROM (SELECT protocol, unnest(risk_signals) AS risk FROM ms) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def top_risks(spark, root):
    return S.top_risks(_metrics(spark, root))


@query("post_hygiene", "SO-29 SET-3", f"""WITH {P}, k AS (SELECT * FROM posts WHERE length(content) BETWEEN 10 AND 500 AND lang = 'en' AND len(regexp_extract_all(content, 'https?://')) < 3 AND regexp_matches(content, '[A-Za-z]'))
SELECT min(post_id) AS post_id, any_value(length(content)) AS size FROM k GROUP BY content""")
def post_hygiene(spark, root):
    return S.hygiene(D.posts(spark, root)).select("post_id", F.length("content").cast("long").alias("size"))


# the given prose is invented, so a few of its words stand in for protocol names
WORDS = {**S.KEYWORDS, "ethereum": [*S.KEYWORDS["ethereum"], "the", "that"], "bitcoin": [*S.KEYWORDS["bitcoin"], "than"], "curve": [*S.KEYWORDS["curve"], "of"]}
_KW = " UNION ALL ".join(f"SELECT '{w}' AS token, '{p}' AS protocol" for p, ws in WORDS.items() for w in ws)


@query("tag_protocols", "SO-30", rf"WITH {P}, kw AS ({_KW}), t AS (SELECT post_id, unnest(regexp_extract_all(lower(content), '\$?[\p{{L}}\p{{N}}_]+')) AS token FROM posts) SELECT DISTINCT post_id, protocol FROM t JOIN kw USING (token)")
def tag_protocols(spark, root):
    return S.tag_protocols(D.posts(spark, root), WORDS)


@query("source_mix", "SO-31 AG-18", f"WITH {P} SELECT platform, count(*) AS posts, round(count(*) * 1.0 / (SELECT count(*) FROM posts), 6) AS share FROM posts GROUP BY 1")
def source_mix(spark, root):
    return rounded(S.source_mix(D.posts(spark, root)), ["share"])
