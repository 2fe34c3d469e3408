"""Batch twins of the stream operators; tests run them against the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import shared, table
from lodestone.streaming import answers, buffers, sync, workflows

from .base import query


@query("""WITH k AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
a AS (SELECT conv_id, coalesce(string_agg(CASE WHEN text IS DISTINCT FROM p THEN text END, '' ORDER BY turn), '') AS answer FROM k GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS guid, md5(answer) AS digest, CAST(length(answer) AS INTEGER) AS units FROM a""")
def answer_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z1, Z3, T-21."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("guid"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), F.lit(False).alias("done"))
    return buffers.assembled(chunks).select("guid", F.md5("answer").alias("digest"), "units")


@query("""WITH s AS (SELECT *, coalesce(epoch(ts) - lag(epoch(ts)) OVER w >= 3600, TRUE) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 6) AS total FROM g GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time session windows."""
    return buffers.session_totals(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guid, seq, chunk): turns of a conversation as the chunks of one answer."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("guid"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))


@query("""WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS guid, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT guid, contains(t, 'qu') AS open, md5(CASE WHEN contains(t, 'qu') THEN substr(t, strpos(t, 'qu') + 2) ELSE '' END) AS readable FROM a""")
def gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer can be read after its marker."""
    return buffers.gated(chunks(spark, sf_dir), "qu").select("guid", "open", F.md5("readable").alias("readable"))


@query("""WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS guid, c_custkey AS seq, substr(c_name, 15, 1 + c_custkey % 5) AS chunk FROM customer), d AS (SELECT *, lag(chunk) OVER (PARTITION BY guid ORDER BY seq) AS p FROM k) SELECT guid, string_agg(chunk, '' ORDER BY seq) AS answer, TRUE AS fit FROM d WHERE chunk IS DISTINCT FROM p GROUP BY guid""")
def coalesced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: short chunks are held together; all text comes out in order, and no piece but the last is short."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("guid"), F.col("c_custkey").alias("seq"), F.expr("substring(c_name, 15, 1 + c_custkey % 5)").alias("chunk"))
    p = buffers.coalesced(c).groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return p.select("guid", text.alias("answer"), F.forall(F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - 1)), lambda x: F.length(x["piece"]) >= 4).alias("fit"))


@query("""WITH b AS (SELECT user_id, max(ts) AS last, bool_or(event_type = 'error') AS done FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, done, (done AND date_diff('second', date_trunc('second', last), date_trunc('second', now)) >= 5) OR date_diff('second', date_trunc('second', last), date_trunc('second', now)) > 600 AS gone FROM b, n""")
def evicted_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers that are done and idle, or idle for long, at the time of the last event."""
    e = table(spark, sf_dir, "events")
    b = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "error").alias("done"))
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    return buffers.evicted(b.join(F.broadcast(now)), F.col("now")).select("user_id", "done", "gone")


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS succeeded FROM events GROUP BY user_id")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log, summed up by user."""
    log = buffers.audited(table(spark, sf_dir, "events"))
    return log.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("succeeded"))


@query("""WITH s AS (SELECT conv_id, turn, contains(lower(text), 'wh') AS bad, role = 'user' AND turn >= 6 AS open FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (bad OR open) AS at, max(turn) AS last FROM s GROUP BY conv_id)
SELECT f.conv_id AS workflow, CASE WHEN f.at IS NULL THEN 'completed' WHEN s.open THEN 'pending' ELSE 'requires_alternative' END AS state, coalesce(f.at, f.last) AS at FROM f LEFT JOIN s ON s.conv_id = f.conv_id AND s.turn = f.at""")
def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each workflow has come."""
    answer = F.when(~((F.col("role") == "user") & (F.col("turn") >= 6)), F.col("text"))
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("workflow"), F.col("turn").alias("ord"), answer.alias("answer"))
    return buffers.workflow_states(s, ["wh"])


@query("""WITH k AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), a AS (SELECT conv_id, turn, coalesce(string_agg(CASE WHEN text IS DISTINCT FROM p THEN text END, '') OVER (PARTITION BY conv_id ORDER BY turn), '') AS t FROM k),
g AS (SELECT *, strpos(t, 'qu') AS pos, (turn * 53) % 200 AS o FROM a), f AS (SELECT *, greatest(o, pos + 1) AS first FROM g), v AS (SELECT *, CASE WHEN pos = 0 THEN '' ELSE substr(t, first + 1, 100) END AS value FROM f)
SELECT CAST(conv_id AS VARCHAR) AS guid, CAST(2 * turn + 1 AS BIGINT) AS seq, value, CAST(CASE WHEN pos = 0 THEN o ELSE first + length(value) END AS INTEGER) AS next, pos > 0 AND turn = 7 AND first + length(value) >= length(t) AS finished FROM v""")
def answer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer is read by offset after each of its chunks, a hundred UTF-16 units at a time, from its marker on."""
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn").cast("long")
    guid, none = F.col("conv_id").cast("string").alias("guid"), F.lit(None)
    no_marks = none.cast("map<string,string>").alias("marks")
    chunks = c.select(guid, (2 * turn).alias("seq"), F.col("text").alias("chunk"), (turn == 7).alias("done"), no_marks, none.cast("int").alias("offset"), none.cast("int").alias("units"))
    reads = c.select(guid, (2 * turn + 1).alias("seq"), none.cast("string").alias("chunk"), none.cast("boolean").alias("done"), no_marks, (turn * 53 % 200).cast("int").alias("offset"), F.lit(100).alias("units"))
    return answers.replies(chunks.unionByName(reads), marker="qu", short=0)


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id, event_type)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def synced_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of changes, of which the later ones are older; the newest row of each key stays."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    path = shared(spark, "sync")
    for version in range(3):
        sync.merge(events.where(F.pmod("event_id", F.lit(3)) == 2 - version), path, "user_id", "ts", version)
    return sync.snapshot(spark, path, events.schema).select("user_id", "ts", "event_type")


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), p AS (SELECT conv_id, [x FOR x IN string_split(text, chr(10)) IF x <> ''] AS steps FROM c WHERE i = 0),
a AS (SELECT conv_id, turn, contains(text, 'wh') AS empty FROM c WHERE i > 0), d AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM a),
s AS (SELECT conv_id, CAST(-1 AS BIGINT) AS seq, 0 AS before, 0 AS n, FALSE AS empty, TRUE AS plan FROM p UNION ALL SELECT conv_id, CAST(turn AS BIGINT), n - CASE WHEN empty THEN 0 ELSE 1 END, n, empty, FALSE FROM d),
j AS (SELECT s.*, steps, len(steps) AS k FROM s JOIN p USING (conv_id)), r AS (SELECT *, least(n, k) AS done FROM j)
SELECT CAST(conv_id AS VARCHAR) AS workflow, seq, CASE WHEN plan THEN CASE WHEN k > 0 THEN 'continue' ELSE 'complete' END WHEN before >= k THEN 'error' WHEN empty THEN 'requires_alternative' WHEN done < k THEN 'continue' ELSE 'complete' END AS action,
CAST(done AS INTEGER) AS step, CASE WHEN done < k THEN md5(steps[CAST(done + 1 AS BIGINT)]) END AS message, CASE WHEN k > 0 THEN round(100.0 * done / k, 1) ELSE 100.0 END::DOUBLE AS progress FROM r""")
def workflow_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a conversation's first turn are a plan, its other turns the steps' answers."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("workflow"), F.col("turn").cast("long").alias("seq"), "text")
    first = c.groupBy("workflow").agg(F.min(F.struct("seq", "text")).alias("f"))
    plans = first.select("workflow", F.lit(-1).cast("long").alias("seq"), F.filter(F.split("f.text", "\n"), lambda x: x != "").alias("steps"), F.lit(False).alias("answered"), F.lit(None).cast("string").alias("answer"))
    found = F.when(F.contains("text", F.lit("wh")), F.concat("text", F.lit(" No results found"))).otherwise(F.col("text"))
    answered = c.join(first.select("workflow", F.col("f.seq").alias("seq")), ["workflow", "seq"], "left_anti").select("workflow", "seq", F.lit(None).cast("array<string>").alias("steps"), F.lit(True).alias("answered"), found.alias("answer"))
    return workflows.folded(plans.unionByName(answered)).withColumn("message", F.md5("message"))
