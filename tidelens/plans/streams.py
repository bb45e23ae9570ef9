"""Streaming queries, run over the given tables as file streams until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import json_num, rounded
from ..operators import social as SOC
from ..session import new_folder
from ..sources import domain as D
from ..sources import log_source
from ..sources.keyed import KeyedTable
from ..sources.tables import table
from ..streaming import jobs as S
from ..streaming import stateful as SS
from . import data
from .catalog import query


class _Streamed:
    """Stands in for the session where a derivation reads a table: the table becomes a stream."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def schema(self, schema):
        self._schema = schema
        return self

    def parquet(self, path):
        root, _, name = path.rpartition("/")
        return S.stream_table(self.spark, root, name.removesuffix(".parquet"))


# The given tables are single files without any order in time: rows may come this far behind the newest one. A stream that is read as
# it grows takes minutes or hours here.
UNORDERED = "5000 days"


def _closed(spark, name, build, times):
    """All that a stream puts out once a heartbeat has moved its clock to the newest time of the table."""
    newest = times.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {UNORDERED}")).alias("at")).first()["at"]
    return SS.Job(spark, name).close(build, newest)


def _finish(spark, stream, name, mode="append", each=None):
    base, q = S.run(stream, name, mode, each)
    return S.results(spark, base, stream.schema), q


@query("stream_post_ingestion", "SM-1 SET-3", f"WITH {D.POSTS_SQL} SELECT post_id, platform, ts FROM posts")
def stream_post_ingestion(spark, root):
    p = D.posts(_Streamed(spark), root).select("post_id", "platform", "ts")
    job = SS.Job(spark, "posts")
    job.run(lambda clock: S.ingest_posts(p.unionByName(p), UNORDERED))
    return job.output()


@query("stream_sliding_metrics", "SM-2", f"""WITH {D.POSTS_SQL}, w AS (SELECT protocol, author, sentiment, confidence, engagement, content, unnest(range(0, 24)) AS k, date_trunc('hour', ts) AS h FROM pp)
SELECT protocol, h - to_hours(k) AS window_start, count(*) AS mention_count, round(sum(sentiment * confidence) / sum(confidence), 6) + 0.0 AS sentiment_score, CAST(sum(engagement) AS BIGINT) AS total_engagement, count(DISTINCT author) AS unique_authors, avg(CASE WHEN sentiment < -0.5 THEN 1.0 ELSE 0.0 END) > 0.3 AS negative, avg(CASE WHEN regexp_matches(lower(content), '{"|".join(SOC.FUD_WORDS)}') THEN 1.0 ELSE 0.0 END) > 0.1 AS fud_spread FROM w GROUP BY 1, 2""")
def stream_sliding_metrics(spark, root):
    # the last window starts at the newest post and ends a day later
    times = D.posts(spark, root).select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    out = _closed(spark, "sliding", lambda clock: SS.sliding_metrics(D.posts(_Streamed(spark), root), clock, UNORDERED), times)
    return rounded(out, ["sentiment_score"])


@query("stream_market_refresh", "SM-3", f"""WITH {D.PROTOCOL_EVENTS_SQL}, c AS (SELECT protocol, time_bucket(INTERVAL '5 minutes', ts) AS cell, count(*) AS n, sum(k) AS v FROM pe GROUP BY 1, 2)
SELECT protocol, cell, CAST(sum(n) OVER w AS BIGINT) AS transactions_24h, sum(v) OVER w AS volume_24h FROM c WINDOW w AS (PARTITION BY protocol ORDER BY cell RANGE BETWEEN INTERVAL '86100 seconds' PRECEDING AND CURRENT ROW)""")
def stream_market_refresh(spark, root):
    times = D.protocol_events(spark, root).select((F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"))
    return _closed(spark, "market", lambda clock: SS.market_refresh(D.protocol_events(_Streamed(spark), root), clock, UNORDERED), times)


@query("stream_portfolio_refresh", "SM-4", "SELECT o_custkey % 25 AS portfolio, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS orders, max(o_orderdate) AS ts FROM orders GROUP BY 1")
def stream_portfolio_refresh(spark, root):
    o = S.stream_table(spark, root, "orders").select((F.col("o_custkey") % 25).alias("portfolio"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").alias("ts"))
    out, _ = _finish(spark, S.portfolio_refresh(o), "portfolios", "update")
    return S.newest_per_key(out, ["portfolio"]).withColumn("value", F.col("value").cast("double"))


@query("stream_signal_index", "SM-5 SRC-13 SRC-14", """SELECT user_id % 20 AS model_id, event_id % 500 AS signal_id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS timestamp FROM events WHERE event_type IN ('signup', 'view') AND event_id % 17 <> 0 AND event_id % 23 <> 0 GROUP BY 1, 2""")
def stream_signal_index(spark, root):
    """Logs of blocks in an archive; the stream stops after half of them, goes on, and merges each signal once into a table on disk."""
    tx = data.chain_logs(spark, root).withColumn("block", F.expr("CAST(substr(signature, 4) AS BIGINT) DIV 100"))
    folder = new_folder(spark)
    signals = KeyedTable(spark, f"{folder}/signals", ["model_id", "signal_id"], ["timestamp", "signature", "position"], time="ts", unit="month")
    half = tx.agg((F.max("block") / 2000).cast("long") * 1000).first()[0] or 0
    for part in (tx.filter(F.col("block") < half), tx.filter(F.col("block") >= half)):
        log_source.archive(part, f"{folder}/logs", 1000)
        S.into_table(S.index_signals(log_source.read_logs(spark, f"{folder}/logs")), signals, f"{folder}/state", "indexer")
    return signals.read().select("model_id", "signal_id", "timestamp")


@query("stream_retention", "SM-9 SRC-15", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def stream_retention(spark, root):
    """Events in a table on disk; two heartbeats of the retention loop, five days apart, delete what is older than ten days."""
    folder, events = new_folder(spark), table(spark, root, "events").select("event_id", "ts")
    kept = KeyedTable(spark, f"{folder}/events", ["event_id"], ["ts"], time="ts")
    kept.upsert(events)
    newest = events.agg(F.max("ts").cast("timestamp").alias("at"), (F.max("ts").cast("timestamp") - F.expr("INTERVAL 5 DAYS")).alias("before")).first()
    for at in (newest["before"], newest["at"]):
        SS.tick(spark, f"{folder}/clock", "ts", at)
        S.retention_loop(spark, kept, f"{folder}/clock", f"{folder}/state", 10)
    return kept.read()


@query("stream_vault_balance", "SM-6", f"""WITH RECURSIVE {D.LEDGER_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY ts, tx) AS rn, CASE kind WHEN 'deposit' THEN amount WHEN 'withdrawal' THEN -amount ELSE 0 END AS d FROM led),
r AS (SELECT vault, rn, CAST(greatest(d, 0) AS DECIMAL(28,2)) AS b FROM o WHERE rn = 1 UNION ALL SELECT o.vault, o.rn, CAST(greatest(r.b + o.d, 0) AS DECIMAL(28,2)) FROM r JOIN o ON o.vault = r.vault AND o.rn = r.rn + 1)
SELECT o.tx, o.vault, o.kind, CAST(r.b AS DOUBLE) AS balance FROM o JOIN r USING (vault, rn)""")
def stream_vault_balance(spark, root):
    month = 30 * 86400
    times = D.ledger(spark, root).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    out = _closed(spark, "balances", lambda clock: SS.balances(D.ledger(_Streamed(spark), root), clock, UNORDERED, month), times)
    return out.select("tx", "vault", "kind", "balance")


@query("stream_first_last_seen", "SM-7", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def stream_first_last_seen(spark, root):
    out, _ = _finish(spark, S.seen(S.stream_table(spark, root, "events")), "seen", "update")
    return S.newest_per_key(out, ["user_id"])


@query("stream_progress", "SM-8", "SELECT 'events' AS component, count(*) AS input_rows, max(ts) AS last_ts, max(event_id) FILTER (ts = (SELECT max(ts) FROM events)) AS last_id FROM events")
def stream_progress(spark, root):
    e = S.stream_table(spark, root, "events").select("event_id", "ts")
    mark = {"input_rows": F.count(F.lit(1)), "newest": F.max(F.struct("ts", F.col("event_id").alias("id")))}
    base, _ = S.run(e, "progress", mark=mark)
    return S.progress(spark, base, "events")


@query("stream_alerts", "SM-10", "SELECT event_id, ts, event_type, value, CASE WHEN value > 200 THEN 'danger' ELSE 'warning' END AS severity FROM events WHERE value > 100")
def stream_alerts(spark, root):
    out, _ = _finish(spark, S.threshold_alerts(S.stream_table(spark, root, "events")), "alerts")
    return out.drop("batch")


def _model(pdf):
    return pdf["value"] * 0.5 + pdf["k"] * 0.1


_SCORED = "SELECT event_id, round(value * 0.5 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.1 + 1e-9, 6) AS prediction FROM events"


@query("stream_scoring", "SM-11 UD-6", _SCORED)
def stream_scoring(spark, root):
    e = S.stream_table(spark, root, "events").select("event_id", "value", json_num("props", "$.k").alias("k"))
    handler = lambda batch: batch.withColumn("prediction", F.round(F.col("prediction") + 1e-9, 6))
    out, _ = _finish(spark, S.score(e, _model, ["value", "k"], ["event_id"]), "scores", each=handler)
    return out.drop("batch")


@query("batch_scoring", "SM-12 UD-6", _SCORED)
def batch_scoring(spark, root):
    e = table(spark, root, "events").select("event_id", "value", json_num("props", "$.k").alias("k"))
    return S.score(e, _model, ["value", "k"], ["event_id"]).withColumn("prediction", F.round(F.col("prediction") + 1e-9, 6))


@query("stream_signal_expiry", "SM-13", """WITH s AS (SELECT event_id AS signal, user_id AS key, ts FROM events WHERE event_type = 'signup'), e AS (SELECT user_id AS key, ts AS at FROM events WHERE event_type = 'purchase'),
n AS (SELECT max(ts) AS now FROM events WHERE event_type IN ('signup', 'purchase')), j AS (SELECT signal, s.key, s.ts, min(e.at) AS executed_at FROM s LEFT JOIN e ON s.key = e.key AND e.at BETWEEN s.ts AND s.ts + INTERVAL 30 DAY GROUP BY 1, 2, 3)
SELECT signal, key, ts, executed_at, CASE WHEN executed_at IS NOT NULL THEN 'executed' WHEN ts + INTERVAL 30 DAY < now THEN 'expired' ELSE 'pending' END AS status FROM j, n""")
def stream_signal_expiry(spark, root):
    kind = F.when(F.col("event_type") == "signup", "signal").when(F.col("event_type") == "purchase", "execution")
    pick = lambda e: e.select(kind.alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts").filter("kind IS NOT NULL")
    changes = _closed(spark, "expiry", lambda clock: SS.expiring(pick(S.stream_table(spark, root, "events")), clock, 30 * 86400, UNORDERED),
                      pick(table(spark, root, "events")))
    return SS.newest_states(changes)
