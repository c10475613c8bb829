"""Registered queries for parsers, decisions, sources and sinks, each over whole tables and with its SQL twin.

Where a function reads a form that the tables don't have (a wrapped text, a
number with separators), the query writes that form around their values and the
twin works from the values.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order, shell
from ..functions import text as T
from ..operators import bootstrap, literature, pool
from ..sources import readers, sinks
from .slate import PLACES, grid, query, table

NL = "\n"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the cluster shares."""
    return posixpath.join(order.shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", *columns)


# Texts


@query("""SELECT doc_id, length(text) > 200 AS cut, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[truncated]' ELSE text END AS left_, sha256(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[truncated]' ELSE text END) AS digest FROM documents WHERE text IS NOT NULL""")
def truncated_texts(spark, sf_dir):
    left, cut, digest = T.truncated(F.col("text"), 200)
    return documents(spark, sf_dir).select("doc_id", cut.alias("cut"), left.alias("left_"), digest.alias("digest"))


@query("SELECT doc_id, regexp_replace(CASE WHEN lang = 'en' THEN text ELSE 'nav' || chr(10) || text END, '^\\s+|\\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL")
def page_chrome(spark, sf_dir):
    """Chrome around the English texts; the others have a line that is none."""
    around = F.when(F.col("lang") == "en", F.concat(F.lit(f"nav{NL}License: CC BY{NL}"), "text", F.lit(f"{NL}Instructions for reporting errors{NL}end"))).otherwise(F.concat(F.lit(f"nav{NL}"), "text"))
    return documents(spark, sf_dir, "lang").select("doc_id", T.without_chrome(around).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END AS task FROM documents WHERE text IS NOT NULL")
def task_descriptions(spark, sf_dir):
    prompt = F.concat(F.lit(f"You are an agent.{NL}Task Description:{NL}"), "text", F.lit(f"{NL}Current terminal state:{NL}$"))
    task = F.when(F.col("doc_id") % 2 == 0, T.task_description(prompt)).otherwise(T.task_description(F.col("text"), strip=False))
    return documents(spark, sf_dir).select("doc_id", task.alias("task"))


@query("SELECT event_id, lpad((event_id % 10000)::VARCHAR, 4, '0') || '.' || lpad(coalesce(user_id, 0)::VARCHAR, 5, '0') AS arxiv FROM events")
def arxiv_ids(spark, sf_dir):
    number = F.concat(F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.coalesce("user_id", F.lit(0)).cast("string"), 5, "0"))
    form = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("see https://arxiv.org/abs/"), number, F.lit("v2"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ARXIV: "), number)).otherwise(F.concat(F.lit("arxiv.org/pdf/"), number, F.lit(".pdf")))
    return table(spark, sf_dir, "events").select("event_id", T.arxiv_id(form).alias("arxiv"))


@query("""SELECT o_orderkey, (o_orderkey::VARCHAR || lpad((o_custkey % 1000)::VARCHAR, 3, '0'))::DOUBLE AS number, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, least(1.0, greatest(0.0, (o_custkey - 100) / 1000.0))::DOUBLE AS share,
    lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS slug, sha256(o_orderkey::VARCHAR || chr(0) || o_orderstatus) AS cache, o_custkey::VARCHAR || '.0,' || o_orderkey::VARCHAR || '.0' AS sorted_ FROM orders WHERE o_custkey < o_orderkey
    UNION ALL SELECT o_orderkey, (o_orderkey::VARCHAR || lpad((o_custkey % 1000)::VARCHAR, 3, '0'))::DOUBLE, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END, least(1.0, greatest(0.0, (o_custkey - 100) / 1000.0))::DOUBLE,
    lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')), sha256(o_orderkey::VARCHAR || chr(0) || o_orderstatus), o_orderkey::VARCHAR || '.0,' || o_custkey::VARCHAR || '.0' FROM orders WHERE o_custkey >= o_orderkey""")
def value_parsers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    number = F.concat(F.lit(" "), key, F.lit(","), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("% "))
    flag = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "0").otherwise("perhaps")
    numbers = F.array_join(F.transform(T.numbers(F.concat(F.lit("of "), key, F.lit(" and "), cust)), lambda x: F.concat(x.cast("long").cast("string"), F.lit(".0"))), ",")
    share = T.unit_interval(((F.col("o_custkey") - 100) / 1000.0).cast("string"))
    return o.select("o_orderkey", T.to_number(number).alias("number"), T.tri_state(flag).alias("flag"), share.alias("share"), T.slug(F.col("o_orderpriority")).alias("slug"), T.cache_key(key, F.col("o_orderstatus")).alias("cache"), numbers.alias("sorted_"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events WHERE props IS NOT NULL")
def outer_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props is not null")
    return e.select("event_id", F.try_variant_get(T.outer_json(F.concat(F.lit("Sure: ```json "), "props", F.lit(" ``` done"))), "$.k", "int").alias("k"))


# Decisions


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'task timeout' WHEN o_custkey % 7 = 1 THEN 'model/API failure' WHEN o_custkey % 7 = 2 THEN 'environment failure' WHEN o_orderstatus = 'F' THEN 'success' ELSE 'verifier failure' END AS ended FROM orders""")
def trial_endings(spark, sf_dir):
    k = F.col("o_custkey") % 7
    exception = F.when(k == 0, "AgentTimeoutError").when(k == 1, "RateLimitError").when(k == 2, "DiskFull").when(k == 3, "")
    return table(spark, sf_dir, "orders").select("o_orderkey", shell.termination(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0), exception).alias("ended"))


STATUS = "CASE doc_id % 6 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'results_only' WHEN 4 THEN 'reject' ELSE 'other' END"


@query(f"""SELECT doc_id, status, row_number() OVER (ORDER BY CASE status WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'results_only' THEN 3 WHEN 'reject' THEN 4 ELSE 9 END, doc_id) - 1 AS place FROM (SELECT doc_id, {STATUS} AS status FROM documents)""")
def status_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(STATUS).alias("status"))
    return literature.in_status_order(d, "doc_id").select("doc_id", "status", "place")


@query(f"SELECT doc_id, {STATUS} AS status, lang FROM documents WHERE doc_id % 6 = 2 OR doc_id % 10 = 0")
def review_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(STATUS).alias("status"), "lang", F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("lang"))).alias("disagreements"))
    return literature.review_queue(d).drop("disagreements")


@query("""SELECT doc_id, lang, NULL::VARCHAR AS venue, 'lang: ' || coalesce(lang, '') || ' | source: ' || coalesce(source, '') AS all_evidence FROM documents""")
def flat_records(spark, sf_dir):
    evidence = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")))
    return literature.flat_record(table(spark, sf_dir, "documents").withColumn("evidence", evidence), ["doc_id", "lang", "venue"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN 1990 + o_custkey % 20 END AS year FROM orders WHERE o_custkey % 4 = 0 OR o_custkey % 20 >= 12")
def recent_rows(spark, sf_dir):
    year = F.when(F.col("o_custkey") % 4 > 0, 1990 + F.col("o_custkey") % 20)
    return literature.recent(table(spark, sf_dir, "orders").select("o_orderkey", year.alias("year")), 2002)


@query("""SELECT o_custkey AS paper, o_orderpriority AS benchmark FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY declared DESC, teachers DESC, o_orderpriority) AS i FROM (
    SELECT o_custkey, o_orderpriority, count(*) AS teachers, bool_or(o_orderkey % 97 = 0) AS declared FROM orders GROUP BY ALL)) WHERE i = 1""")
def primary_benchmarks(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper"), F.col("o_orderpriority").alias("benchmark")).agg(F.count("*").alias("teachers"), F.bool_or(F.col("o_orderkey") % 97 == 0).alias("declared"))
    return literature.primary_benchmark(per, "paper").select("paper", "benchmark")


@query("""SELECT doc_id AS id, 'lang' AS field, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN upper(source) END AS value, doc_id % 3 = 2 AS unresolved FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def resolved_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null").select(F.col("doc_id").alias("id"), F.lit("lang").alias("field"), F.col("lang").alias("left"), F.upper("source").alias("right"))
    verdicts = d.where("id % 3 < 2").select("id", "field", F.when(F.col("id") % 3 == 0, "left").otherwise("right").alias("side"))
    return literature.resolve(d, verdicts, "id")


@query("""WITH a AS (SELECT o_custkey AS paper, o_orderkey AS id, o_orderkey % 4 < 3 AS ok, o_orderkey % 5 = 0 AS sep_no, o_orderkey % 5 = 1 AS sep_yes, o_orderkey % 9 = 0 AS mentioned FROM orders WHERE o_orderstatus <> 'P')
    SELECT paper::VARCHAR AS paper, bool_or(ok) AS verified, coalesce(string_agg(lpad(id::VARCHAR, 9, '0'), ',' ORDER BY id) FILTER (WHERE ok), '') AS ids,
        CASE WHEN bool_or(ok) THEN CASE WHEN coalesce(bool_or(ok AND sep_yes), false) THEN 'yes' WHEN coalesce(bool_and(sep_no) FILTER (WHERE ok AND (sep_no OR sep_yes)), true) AND NOT coalesce(bool_or(ok AND mentioned), false) THEN 'no' ELSE 'unclear' END END AS separable FROM a GROUP BY paper""")
def artifact_checks(spark, sf_dir):
    """Orders as a paper's artifacts: three of four can be read, some judged separable or not."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").cast("string").alias("paper"), F.lpad(k.cast("string"), 9, "0").alias("id"), F.when(k % 2 == 0, "datasets").otherwise("models").alias("kind"), F.lit("tasks").alias("role"), F.lit("unclear").alias("judged_role"),
        F.lit(True).alias("exists"), (k % 4 < 3).alias("accessible"), F.when(k % 5 == 0, "no").when(k % 5 == 1, "yes").alias("separable"), (k % 9 == 0).alias("mentioned"),
    )
    return literature.artifact_status(rows, "tasks").withColumn("ids", F.array_join("ids", ","))


@query("""WITH t AS (SELECT s_nationkey AS paper, 'teacher-t' || s_suppkey AS teacher, 't' || s_suppkey AS own FROM supplier), d AS (SELECT c_nationkey AS paper, 'lab/set_t' || (c_custkey % 300) || '-' || c_custkey AS dataset, 'sett' || (c_custkey % 300) || c_custkey AS n FROM customer),
    j AS (SELECT t.paper, t.teacher, min(dataset) AS dataset FROM t JOIN d ON t.paper = d.paper AND length(own) >= 3 AND contains(n, own) AND NOT EXISTS (SELECT 1 FROM t o WHERE o.paper = t.paper AND o.own <> t.own AND length(o.own) >= 3 AND contains(n, o.own)) GROUP BY ALL)
    SELECT t.paper, t.teacher, j.dataset FROM t LEFT JOIN j ON t.paper = j.paper AND t.teacher = j.teacher""")
def teacher_datasets(spark, sf_dir):
    teachers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("paper"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("teacher"))
    c = F.col("c_custkey")
    datasets = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("paper"), F.concat(F.lit("lab/set_t"), (c % 300).cast("string"), F.lit("-"), c.cast("string")).alias("dataset"))
    return literature.dedicated_links(teachers, datasets).withColumn("teacher", F.concat(F.lit("teacher-"), "teacher"))


# Merging and joining


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_events(spark, sf_dir):
    return literature.latest(table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT -doc_id - 1, 'new' FROM documents WHERE doc_id % 50 = 0")
def upserted_rows(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = old.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("lang"))
    return literature.upsert(old, changed.union(old.where("doc_id % 50 = 0").select(-F.col("doc_id") - 1, F.lit("new"))), "doc_id")


@query("SELECT c_custkey AS task, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, o_orderpriority AS teacher FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey, o_orderpriority ORDER BY o_orderkey) = 1")
def indexed_records(spark, sf_dir):
    """A manifest that names each customer's first record of each teacher by its position."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    records = o.select(F.col("o_orderpriority").alias("teacher"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).alias("pos"), F.col("c_custkey").alias("own_task"), "o_orderkey")
    first = records.groupBy("own_task", "teacher").agg(F.min("pos").alias("pos"))
    manifest = first.groupBy(F.col("own_task").alias("task")).agg(F.map_from_entries(F.collect_list(F.struct("teacher", "pos"))).alias("teacher_record_index"))
    return pool.at_positions(manifest, records).select("task", "o_orderkey", "pos", "teacher")


REPS = "r AS (SELECT o_custkey % 500 AS rep, avg(o_totalprice::DECIMAL(18,2))::DOUBLE AS value, min(o_totalprice::DECIMAL(18,2))::DOUBLE * 40 AS other FROM orders GROUP BY ALL)"


@query(f"""WITH {REPS}, d AS (SELECT value - other AS x FROM r), s AS (SELECT list(x ORDER BY x) AS l, count(*) AS n, avg(x) AS mean, count_if(x > 0) / count(*) AS p FROM d)
    SELECT round(mean, 3) AS mean, round(p, {PLACES}) AS p_positive, round(l[floor(n * 0.025)::INTEGER + 1], 3) AS low, round(l[least(floor(n * 0.975)::INTEGER, n - 1) + 1], 3) AS high FROM s""")
def paired_bootstrap(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    per = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("rep")).agg(F.avg(price).cast("double").alias("value"), (F.min(price).cast("double") * 40).alias("other"))
    out = bootstrap.paired_difference(per.select("rep", "value"), per.select("rep", F.col("other").alias("value")))
    return out.select(F.round("mean", 3).alias("mean"), F.round("p_positive", PLACES).alias("p_positive"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("SELECT o_custkey AS proxy, CASE WHEN count(*) < 2 THEN 'invariant' WHEN count(DISTINCT o_orderpriority) > 1 THEN 'yes' ELSE 'no' END AS flips FROM orders GROUP BY o_custkey")
def order_flips(spark, sf_dir):
    return bootstrap.flips(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("proxy"), F.col("o_orderpriority").alias("ranking")))


@query("SELECT o_orderpriority AS teacher, 'clerk' AS field, count_if(o_custkey % 3 = 0)::BIGINT AS missing FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, 'status', count_if(o_orderstatus = 'P')::BIGINT FROM orders GROUP BY ALL")
def missing_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("teacher"), F.when(F.col("o_custkey") % 3 > 0, "x").alias("clerk"), F.when(F.col("o_orderstatus") == "P", "  ").otherwise("y").alias("status"))
    return pool.missing_by_teacher(o, "clerk", "status")


# Sources and sinks


@query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS venue FROM orders")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "orders"), path, ["o_orderkey", "o_custkey", "venue"], "o_orderkey")
    return spark.read.schema("o_orderkey long, o_custkey long, venue string").option("header", True).csv(path)


@query("SELECT 'events' AS proxy, event_type AS teacher, user_id::VARCHAR AS task_id, count(*)::DOUBLE AS score FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def score_lines_round_trip(spark, sf_dir):
    """Scores appended as JSON lines in two runs, the second of which adds what the first has not written."""
    path = scratch(spark, "scores")
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    s = e.groupBy(F.lit("events").alias("proxy"), F.col("event_type").alias("teacher"), F.col("user_id").cast("string").alias("task_id")).agg(F.count("*").cast("double").alias("score"))
    sinks.append_lines(s.where("teacher <> 'view'"), path)
    sinks.append_lines(sinks.missing_only(s, readers.score_lines(spark, path), "teacher", "task_id"), path)
    return readers.score_lines(spark, path).select("proxy", "teacher", "task_id", "score")


@query("""SELECT 'T' AS teacher, conv_id::VARCHAR AS task, count(*) AS messages, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS said FROM conversations GROUP BY conv_id""")
def record_list_round_trip(spark, sf_dir):
    """Conversations as one JSON list of records, in which every task comes twice and the last record counts."""
    path = scratch(spark, "records")
    said = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))).alias("conversations"))
    record = per.select(F.struct(F.col("conv_id").cast("string").alias("task")).alias("metadata"), "conversations")
    stale = record.withColumn("conversations", F.slice("conversations", 1, 0))
    both = stale.withColumn("o", F.lit(0)).unionByName(record.withColumn("o", F.lit(1)))
    listed = both.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o", "metadata", "conversations"))), lambda r: F.struct(r["metadata"].alias("metadata"), r["conversations"].alias("conversations")))).alias("value"))
    listed.write.text(path)  # one list is one value, as the format has it
    rows = readers.record_list(spark, path, "T", "metadata.task")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",")
    return rows.select("teacher", "task", F.size("messages").cast("long").alias("messages"), shown.alias("said"))


@query("""WITH l AS (SELECT task, '{"task":' || task || ',"teacher":"' || teacher || '"}' AS line FROM (SELECT o_custkey AS task, min(o_orderpriority) AS teacher FROM orders GROUP BY o_custkey)) SELECT count(*) AS n_rows, sha256(string_agg(line || chr(10), '' ORDER BY task)) AS digest FROM l""")
def arm_digest(spark, sf_dir):
    arm = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.min("o_orderpriority").alias("teacher"))
    got = sinks.write_arm(arm, scratch(spark, "arm"))
    return spark.createDataFrame([(got["rows"], got["sha256"])], "n_rows long, digest string")


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0")
def artifact_changes(spark, sf_dir):
    """Two trees of files that differ in a seventh, and in a time stamp everywhere, which doesn't count."""
    d = documents(spark, sf_dir)
    tree = lambda stamp, more: sinks.artifact_hashes(d.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit(f"{stamp}{NL}"), "text", more).cast("binary").alias("content")))
    return sinks.artifact_diff(tree("2024-01-02 03:04:05", F.lit("")), tree("2025-06-07 08:09:10", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(""))).select("path")


@query("SELECT doc_id, source AS author, lang AS title, 2000 + doc_id % 25 AS year FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def atom_feeds(spark, sf_dir):
    """A feed for each source, with an entry for each document."""
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    entry = F.concat(F.lit("<entry><id>"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("</id><title> "), "lang", F.lit("</title><summary>s</summary><published>"), (2000 + F.col("doc_id") % 25).cast("string"), F.lit("-01-02</published></entry>"))
    feeds = d.select("source", entry.alias("e"), F.expr("doc_id div 50").alias("page")).groupBy("source", "page").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    e = readers.atom_entries(feeds)
    return e.select(F.substring_index("url", "/", -1).cast("long").alias("doc_id"), F.substring_index("url", "/", 1).alias("author"), "title", F.col("year").cast("long").alias("year"))
