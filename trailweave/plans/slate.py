"""The slate of registered queries over the provided tables, each with its DuckDB twin where SQL has one.

teacher, task and score stand for event_type, user_id and the mean value of
events; orders joined to customer give a second complete grid. Doubles are
rounded in the results only, never where ties are decided.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bootstrap, literature, overlap, pool, profiles, scores, selection, sequences, tokens
from ..sources.readers import guard
from ..sources.sinks import missing_only

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PLACES = 6
TRUTH = [["view"], ["click", "signup"], ["purchase"], ["error"]]
GAINS = {"view": 4.0, "click": 3.0, "signup": 3.0, "purchase": 2.0, "error": 1.0}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work each: a file of fewer splits than there are cores is dealt out, a larger one stays where it is read."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c in columns})  # no negative zero


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on common support; sums run over exact decimals so that no order of addition shows."""
    e = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null")
    s = e.groupBy(F.col("event_type").alias("teacher"), F.col("user_id").alias("task")).agg(F.avg(F.col("value").cast("decimal(18,6)")).cast("double").alias("score"), F.count("*").alias("n"))
    return scores.common_support(s)


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).groupBy("teacher").agg(F.round(F.avg("score"), PLACES).alias("score"))


GRID = """
    raw AS (SELECT event_type AS teacher, user_id AS task, sum(value::DECIMAL(18,6))::DOUBLE / count(*) AS score, count(*) AS n
            FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
    grid AS (SELECT * FROM raw WHERE task IN (SELECT task FROM raw GROUP BY task HAVING count(DISTINCT teacher) = (SELECT count(DISTINCT teacher) FROM raw)))"""
MEANS = GRID + ", means AS (SELECT teacher, round(avg(score), 6) AS score FROM grid GROUP BY teacher)"
TRUTH_SQL = "truth AS (SELECT * FROM (VALUES ('view', 0, 0, 4.0::DOUBLE), ('click', 1, 1, 3.0), ('signup', 1, 2, 3.0), ('purchase', 2, 3, 2.0), ('error', 3, 4, 1.0)) t(teacher, grp, pos, gain))"
SEQ = "seq AS (SELECT *, event_type = 'error' AS bad FROM events WHERE user_id IS NOT NULL)"


@query(f"WITH {GRID} SELECT teacher, count(*) AS n_tasks, round(avg(score), 6) AS mean_score FROM grid GROUP BY teacher")
def agg_common_support(spark, sf_dir):
    return rounded(grid(spark, sf_dir).groupBy("teacher").agg(F.count("*").alias("n_tasks"), F.avg("score").alias("mean_score")), "mean_score")


def order_grid(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderpriority").alias("teacher"), F.col("c_nationkey").alias("task")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("num"), F.count("*").alias("den"))


ORDER_GRID = """og AS (SELECT o_orderpriority AS teacher, c_nationkey AS task, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS num, count(*) AS den
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"WITH {ORDER_GRID} SELECT teacher, count(*) AS n_tasks, round(sum(num) / sum(den), 4) AS raw, round(-sum(num) / sum(den), 4) AS utility FROM og GROUP BY teacher")
def agg_ratio_of_means(spark, sf_dir):
    return scores.teacher_means(order_grid(spark, sf_dir), direction="lower_better").withColumns({c: F.round(c, 4) for c in ("raw", "utility")})


@query(f"""WITH {MEANS}, ranked AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM means),
    tied AS (SELECT rank, string_agg(teacher, ' = ' ORDER BY teacher) AS t FROM ranked GROUP BY rank)
    SELECT teacher, score, rank::INTEGER AS rank, (SELECT string_agg(t, ' > ' ORDER BY rank) FROM tied) AS ranking FROM ranked""")
def rank_competition(spark, sf_dir):
    return scores.competition_ranks(means(spark, sf_dir))


@query(f"""WITH {MEANS}, ranked AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM means), tied AS (SELECT rank, string_agg(teacher, ' = ' ORDER BY teacher) AS t FROM ranked GROUP BY rank)
    SELECT max(CASE WHEN rank = 1 THEN t END) AS teacher_rank_1, max(CASE WHEN rank = 2 THEN t END) AS teacher_rank_2, max(CASE WHEN rank = 3 THEN t END) AS teacher_rank_3, max(CASE WHEN rank = 4 THEN t END) AS teacher_rank_4 FROM tied""")
def rank_pivot(spark, sf_dir):
    return scores.rank_pivot(scores.competition_ranks(means(spark, sf_dir)))


@query(f"""WITH {GRID}, r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY task ORDER BY n) + (count(*) OVER (PARTITION BY task, n) - 1) / 2.0 AS ry FROM grid)
    SELECT task, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(corr(rx, ry), 6) + 0.0 END AS rho FROM r GROUP BY task""")
def rank_midrank_spearman(spark, sf_dir):
    return rounded(scores.spearman(grid(spark, sf_dir), ["task"], "score", "n"), "rho")


PAIRS = f"""WITH {MEANS}, {TRUTH_SQL}, t AS (SELECT * FROM means JOIN truth USING (teacher)),
    p AS (SELECT sign(a.score - b.score) AS u, sign(b.grp - a.grp) AS g, a.score AS sa, b.score AS sb FROM t a JOIN t b ON a.pos < b.pos)"""


@query(f"""{PAIRS}, c AS (SELECT count_if(u * g > 0)::BIGINT AS concordant, count_if(u * g < 0)::BIGINT AS discordant, count_if(u <> 0) AS fu, count_if(g <> 0) AS fg FROM p)
    SELECT concordant, discordant, CASE WHEN fu > 0 AND fg > 0 THEN round((concordant - discordant) / sqrt(fu::DOUBLE * fg), 6) END AS tau_b FROM c""")
def kendall_tau_b(spark, sf_dir):
    return rounded(scores.kendall_tau_b(means(spark, sf_dir), scores.truth_table(spark, TRUTH)), "tau_b")


@query(f"{PAIRS} SELECT count(*) AS comparable, round(avg(CASE WHEN sa > sb THEN 1.0 WHEN sa = sb THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM p WHERE g <> 0")
def pairwise_accuracy(spark, sf_dir):
    return rounded(scores.pairwise_accuracy(means(spark, sf_dir), scores.truth_table(spark, TRUTH)), "accuracy")


@query(f"""WITH {MEANS}, {TRUTH_SQL}, t AS (SELECT gain, row_number() OVER (ORDER BY score DESC, teacher) AS i, row_number() OVER (ORDER BY gain DESC, teacher) AS j FROM means JOIN truth USING (teacher))
    SELECT round(max(CASE WHEN i = 1 THEN gain END) / max(CASE WHEN j = 1 THEN gain END), 6) AS ndcg_1,
           round(sum(CASE WHEN i <= 2 THEN gain / log2(i + 1) END) / sum(CASE WHEN j <= 2 THEN gain / log2(j + 1) END), 6) AS ndcg_2,
           max(gain) - max(CASE WHEN i = 1 THEN gain END) AS regret FROM t""")
def ndcg_regret(spark, sf_dir):
    return rounded(scores.ndcg_regret(means(spark, sf_dir), scores.truth_table(spark, TRUTH, GAINS)), "ndcg_1", "ndcg_2")


@query(f"""WITH {GRID} SELECT teacher, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0), 6) AS std,
    round(coalesce(var_samp(score), 0), 4) AS variance, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.75), 6) AS q3,
    round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, round(min(score), 6) AS min, round(max(score), 6) AS max FROM grid GROUP BY teacher""")
def dispersion(spark, sf_dir):
    out = rounded(scores.dispersion(grid(spark, sf_dir)), "mean", "median", "std", "q1", "q3", "iqr", "min", "max")
    return out.withColumn("variance", F.round("variance", 4))


@query(f"""WITH {GRID}, g AS (SELECT teacher, task, n AS score FROM grid), top AS (SELECT task, max(score) AS top FROM g GROUP BY task), won AS (SELECT g.* FROM g JOIN top ON g.task = top.task AND score = top),
    ties AS (SELECT task, count(*) AS k FROM won GROUP BY task)
    SELECT teacher, round(sum(1.0 / k) / (SELECT count(*) FROM top), 6) AS share, count(*) AS n_best, max(k) AS widest_tie FROM won JOIN ties USING (task) GROUP BY teacher""")
def winner_share(spark, sf_dir):
    return rounded(scores.winner_share(grid(spark, sf_dir).select("teacher", "task", F.col("n").alias("score"))), "share")


@query(f"""WITH {GRID} SELECT teacher, task, 'events/mean' AS result, round(score, 6) AS score FROM grid UNION ALL SELECT teacher, task, 'events/count', n::DOUBLE FROM grid""")
def view_unpivot(spark, sf_dir):
    g = grid(spark, sf_dir).select("teacher", "task", F.lit("events").alias("proxy"), "score", F.create_map(F.lit("mean"), F.col("score"), F.lit("count"), F.col("n").cast("double")).alias("score_views"))
    return rounded(scores.unpivot_views(g), "score")


BEST = "best AS (SELECT task, teacher, n, n::DOUBLE AS utility, row_number() OVER (PARTITION BY task ORDER BY n DESC, substr(sha256(task::VARCHAR || chr(0) || teacher), 1, 16) DESC, teacher DESC) AS i FROM grid)"


@query(f"WITH {GRID}, {BEST} SELECT task, teacher, utility FROM best WHERE i = 1")
def best_per_task(spark, sf_dir):
    return scores.best_per_task(grid(spark, sf_dir), F.col("n"))


@query(f"""WITH {GRID}, arm AS (SELECT teacher, n AS tokens, row_number() OVER (PARTITION BY task ORDER BY n DESC, substr(sha256(task::VARCHAR || chr(0) || teacher), 1, 16) DESC, teacher DESC) AS i FROM grid)
    SELECT teacher, count(*) AS rows, sum(tokens)::BIGINT AS tokens, sum(tokens * tokens)::BIGINT AS squared, min(tokens) AS least, max(tokens) AS most,
           round(sum(tokens) / (SELECT sum(tokens) FROM arm WHERE i = 1), 6) AS share FROM arm WHERE i = 1 GROUP BY teacher""")
def arm_report(spark, sf_dir):
    g = grid(spark, sf_dir)
    arm = scores.best_per_task(g, F.col("n")).select("teacher", "task", F.col("utility").cast("long").alias("tokens"))
    return rounded(scores.arm_report(arm), "share")


@query(f"""WITH {GRID}, s AS (SELECT max(score) - min(score) AS spread FROM grid GROUP BY task)
    SELECT round(min(spread), 6) AS min, round(median(spread), 6) AS median, round(avg(spread), 6) AS mean, round(max(spread), 6) AS max FROM s""")
def within_task_spread(spark, sf_dir):
    return rounded(scores.within_task_spread(grid(spark, sf_dir)), "min", "median", "mean", "max")


@query(f"""WITH {ORDER_GRID}, c AS (SELECT num - avg(num) OVER (PARTITION BY task) AS x, den - avg(den) OVER (PARTITION BY task) AS y FROM og),
    c2 AS (SELECT round(x, 3) AS x, round(y, 3) AS y FROM c),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c2)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def centered_spearman(spark, sf_dir):
    return rounded(scores.centered_spearman(order_grid(spark, sf_dir), "num", "den", 3), "rho")


@query("""WITH j AS (SELECT d.doc_id, lang AS teacher, source AS task, n_chars, toxic FROM documents d JOIN labels l USING (doc_id)),
    bad AS (SELECT DISTINCT task FROM j WHERE toxic > 0 AND n_chars > 5000),
    full_ AS (SELECT task FROM j GROUP BY task HAVING count(DISTINCT teacher) = (SELECT count(DISTINCT teacher) FROM j))
    SELECT teacher, task, count(*) AS n FROM j WHERE task IN (SELECT * FROM full_) AND task NOT IN (SELECT * FROM bad) GROUP BY ALL""")
def completeness_filter(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("teacher"), F.col("source").alias("task"), "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id").withColumn("truncated", F.when(F.col("n_chars") > 5000, F.col("toxic")).otherwise(0))
    return scores.complete_tasks(j, "truncated").groupBy("teacher", "task").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)), h AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT g.lang, g.source, coalesce(n, 0) AS n, n IS NULL AS missing FROM g LEFT JOIN h ON g.lang IS NOT DISTINCT FROM h.lang AND g.source IS NOT DISTINCT FROM h.source""")
def missing_pairs(spark, sf_dir):
    return scores.missing_pairs(table(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH k AS (SELECT event_type AS teacher, user_id AS task, count(*) AS n FROM events GROUP BY ALL)
    SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = k.teacher AND e.user_id = k.task AND e.value > 90)""")
def anti_join_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "teacher", "user_id": "task"})
    return missing_only(e.groupBy("teacher", "task").agg(F.count("*").alias("n")), e.where("value > 90"), "teacher", "task")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
    SELECT count(*) AS all_ids, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::BIGINT AS both, count_if(b.doc_id IS NULL)::BIGINT AS only_documents, count_if(a.doc_id IS NULL)::BIGINT AS only_labels
    FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def id_set_audit(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "doc_id", "full").agg(F.count("*").alias("all_ids"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("b is null")).alias("only_documents"), F.count_if(F.expr("a is null")).alias("only_labels"))


def train_eval(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("train_id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eval_id"), "text")


NORM = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')"
JACCARD = f"""tw AS (SELECT doc_id AS train_id, string_split({NORM}, ' ') AS w FROM documents WHERE {NORM} <> ''),
    ew AS (SELECT item_id AS eval_id, string_split({NORM}, ' ') AS w FROM benchmark WHERE {NORM} <> ''),
    ts AS (SELECT train_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM tw),
    es AS (SELECT eval_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM ew),
    tx AS (SELECT train_id, len(s) AS a, unnest(s) AS g FROM ts), ex AS (SELECT eval_id, len(s) AS b, unnest(s) AS g FROM es),
    pairs AS (SELECT train_id, eval_id, count(*) / (any_value(a) + any_value(b) - count(*)) AS jaccard FROM tx JOIN ex USING (g) GROUP BY train_id, eval_id)"""


@query(f"""WITH t AS (SELECT doc_id, {NORM} AS k FROM documents), e AS (SELECT k, min(doc_id) AS eval_id FROM t GROUP BY k HAVING count(*) > 1)
    SELECT doc_id AS train_id, eval_id::VARCHAR AS eval_ids FROM t JOIN e USING (k) UNION ALL
    SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FROM t JOIN (SELECT item_id, {NORM} AS k FROM benchmark) USING (k) GROUP BY doc_id""")
def overlap_exact(spark, sf_dir):
    """Documents against the first of each repeated text, with other punctuation around it, and against the benchmark, which no document equals as a whole."""
    t, e = train_eval(spark, sf_dir)
    first = t.groupBy(F.sha2(T.normal(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("k")).agg(F.min_by(F.concat(F.lit("... "), F.coalesce("text", F.lit("")), F.lit(" ?!")), "train_id").alias("text"), F.min("train_id").alias("eval_id"), F.count("*").alias("n"))
    return overlap.exact_matches(t, first.where("n > 1").select("eval_id", "text")).union(overlap.exact_matches(t, e))


@query(f"WITH {JACCARD} SELECT train_id, eval_id, round(jaccard, 6) AS jaccard FROM pairs ORDER BY pairs.jaccard DESC, train_id, eval_id LIMIT 20")
def overlap_jaccard_topk(spark, sf_dir):
    return rounded(overlap.top_pairs(overlap.jaccard_pairs(*train_eval(spark, sf_dir))), "jaccard")


@query(f"""WITH {JACCARD}, exact AS (SELECT count(DISTINCT doc_id) AS exact FROM (SELECT doc_id, {NORM} AS k FROM documents) JOIN (SELECT {NORM} AS k FROM benchmark) USING (k))
    SELECT count_if(jaccard >= 0.5)::BIGINT AS over_half, count_if(jaccard >= 0.8)::BIGINT AS near, round(coalesce(max(jaccard), 0), 6) AS largest, (SELECT exact FROM exact) AS exact FROM pairs""")
def overlap_thresholds(spark, sf_dir):
    t, e = train_eval(spark, sf_dir)
    return rounded(overlap.audit(overlap.jaccard_pairs(t, e), overlap.exact_matches(t, e)), "largest")


def bad():
    return F.col("event_type") == "error"


ORDER = ["ts", "event_id"]


def seq(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id is not null")


@query("SELECT user_id, count(*) AS n, count_if(event_type = 'error')::BIGINT AS failed, round(count_if(event_type = 'error') / count(*), 6) AS rate FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def error_rate(spark, sf_dir):
    return rounded(sequences.error_rate(seq(spark, sf_dir), "user_id", bad()), "rate")


def marked(spark, sf_dir):
    """Errors of each user with a category of props, recovered by a purchase within three events; teacher = user modulo 5."""
    e = seq(spark, sf_dir).withColumns({"category": (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"), "teacher": F.col("user_id") % 5})
    return sequences.next_k(e, "user_id", ORDER, F.col("event_type") == "purchase")


MARKED = """m AS (SELECT *, event_type = 'error' AS bad, ((props->>'$.k')::INTEGER % 7)::VARCHAR AS category, user_id % 5 AS teacher,
        coalesce(max((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1, false) AS recovered
        FROM events WHERE user_id IS NOT NULL),
    prof AS (SELECT teacher, category, count(*) AS occurring, count(*) / any_value(n) AS e_t, count_if(recovered) / count(*) AS r_t
        FROM m JOIN (SELECT teacher, count(*) AS n FROM m GROUP BY teacher) USING (teacher) WHERE bad GROUP BY teacher, category),
    stud AS (SELECT category, count(*) / (SELECT count(*) FROM m) AS q_all, count_if(NOT recovered) / (SELECT count(*) FROM m) AS q_unrecovered FROM m WHERE bad GROUP BY category)"""


@query(f"WITH {MARKED} SELECT teacher, category, occurring, round(e_t, 6) AS e_t, round(r_t, 6) AS r_t FROM prof")
def error_profile(spark, sf_dir):
    return rounded(sequences.recovery_profile(marked(spark, sf_dir), "teacher", "category", bad()), "e_t", "r_t")


@query(f"WITH {MARKED} SELECT category, round(q_all, 6) AS q_all, round(q_unrecovered, 6) AS q_unrecovered FROM stud")
def student_profile(spark, sf_dir):
    return rounded(sequences.student_profile(marked(spark, sf_dir), "category", bad()), "q_all", "q_unrecovered")


@query(f"""WITH {MARKED} SELECT teacher, round(sum(q_all * e_t * r_t), 6) AS all_errors, round(sum(q_unrecovered * e_t * r_t), 6) AS unrecovered, round(sum(e_t), 6) AS error_density,
    round(sum(e_t * r_t), 6) AS recovery_density, round(sum(occurring * r_t) / sum(occurring), 6) AS recovery_rate FROM prof JOIN stud USING (category) GROUP BY teacher""")
def scrf_weighted_sum(spark, sf_dir):
    m = marked(spark, sf_dir)
    out = sequences.weighted_recovery(sequences.recovery_profile(m, "teacher", "category", bad()), sequences.student_profile(m, "category", bad()), "teacher", "category")
    return rounded(out, "all_errors", "unrecovered", "error_density", "recovery_density", "recovery_rate")


@query(f"""WITH {MARKED}, ref AS (SELECT category, occurring AS q FROM prof WHERE teacher = 0)
    SELECT teacher, round(sum(occurring * coalesce(q, 0)) / (sqrt(sum(occurring * occurring)) * (SELECT sqrt(sum(q * q)) FROM ref)), 6) AS cosine
    FROM prof LEFT JOIN ref USING (category) WHERE teacher <> 0 GROUP BY teacher""")
def profile_cosine(spark, sf_dir):
    p = sequences.recovery_profile(marked(spark, sf_dir), "teacher", "category", bad())
    return rounded(sequences.profile_cosine(p, "teacher", "category", "occurring", 0), "cosine")


@query(f"""WITH {MARKED}, full_ AS (SELECT t.teacher, c.category, coalesce(occurring, 0) AS n FROM (SELECT DISTINCT teacher FROM prof) t CROSS JOIN (SELECT DISTINCT category FROM prof) c LEFT JOIN prof p ON p.teacher = t.teacher AND p.category = c.category),
    sm AS (SELECT teacher, category, (n + 1e-6) / (sum(n) OVER (PARTITION BY teacher) + 1e-6 * count(*) OVER (PARTITION BY teacher)) AS p FROM full_),
    ref AS (SELECT category, p AS q FROM sm WHERE teacher = 0)
    SELECT teacher, round(sum(q * ln(q / p)), 6) AS kl, round(sum(p * q), 6) AS overlap FROM sm JOIN ref USING (category) WHERE teacher <> 0 GROUP BY teacher""")
def profile_kl_overlap(spark, sf_dir):
    p = sequences.recovery_profile(marked(spark, sf_dir), "teacher", "category", bad()).select("teacher", "category", "occurring")
    return rounded(sequences.divergence(sequences.smoothed(p, "teacher", "category", "occurring"), "teacher", "category", 0), "kl", "overlap")


@query(f"""WITH {SEQ}, n AS (SELECT user_id, bad, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM seq)
    SELECT user_id, count_if(bad)::BIGINT AS failed, count_if(coalesce(bad AND nxt = event_type, false))::BIGINT AS retried FROM n GROUP BY user_id""")
def retry_consecutive(spark, sf_dir):
    return sequences.consecutive_retry(seq(spark, sf_dir), "user_id", ORDER, "event_type", bad())


@query("""WITH per AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) FILTER (WHERE value < 10) AS bad FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
    n AS (SELECT user_id, coalesce(list_has_any(bad, lag(bad) OVER (PARTITION BY user_id ORDER BY day)), false) AS again FROM per)
    SELECT user_id, count(*) - 1 AS pairs, count_if(again)::BIGINT AS cycles FROM n GROUP BY user_id""")
def retry_cross_turn(spark, sf_dir):
    return sequences.cross_turn_retry(seq(spark, sf_dir).withColumn("day", F.to_date("ts")), "user_id", "day", "event_type", F.col("value") < 10)


@query(f"WITH {MARKED} SELECT user_id, count_if(bad)::BIGINT AS failed, count_if(bad AND recovered)::BIGINT AS recovered FROM m GROUP BY user_id")
def recovery_window_k3(spark, sf_dir):
    return marked(spark, sf_dir).groupBy("user_id").agg(F.count_if(bad()).alias("failed"), F.count_if(bad() & F.col("recovered")).alias("recovered"))


@query(f"""WITH {SEQ}, n AS (SELECT user_id, event_type, coalesce(max((event_type = 'view')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS hit FROM seq)
    SELECT user_id, count(*) AS actions, sum(hit)::BIGINT AS verified, round(sum(hit) / count(*), 6) AS rate FROM n WHERE event_type = 'purchase' GROUP BY user_id""")
def verify_within_horizon(spark, sf_dir):
    return rounded(sequences.checked_after(seq(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "purchase", F.col("event_type") == "view"), "rate")


@query(f"""WITH {SEQ}, n AS (SELECT user_id, event_type, ((props->>'$.k')::INTEGER % 20) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos_ FROM seq),
    f AS (SELECT *, min(CASE WHEN event_type = 'view' THEN pos_ END) OVER (PARTITION BY user_id, key) AS first_ FROM n)
    SELECT user_id, count(*) AS actions, count_if(coalesce(first_ < pos_, false))::BIGINT AS grounded, round(count_if(coalesce(first_ < pos_, false)) / count(*), 6) AS rate FROM f WHERE event_type = 'purchase' GROUP BY user_id""")
def inspect_before_act(spark, sf_dir):
    e = seq(spark, sf_dir).withColumn("key", F.get_json_object("props", "$.k").cast("int") % 20)
    return rounded(sequences.seen_before(e, "user_id", ORDER, "key", F.col("event_type") == "purchase", F.col("event_type") == "view"), "rate")


@query("""SELECT conv_id, count(*) AS turns, count_if(role = 'assistant')::BIGINT AS assistant_turns, coalesce(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS assistant_words,
    coalesce(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))), 0)::BIGINT AS words FROM conversations GROUP BY conv_id""")
def turn_lengths(spark, sf_dir):
    n = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), F.lit(1)))
    mine = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(mine).alias("assistant_turns"), F.coalesce(F.sum(F.when(mine, n)), F.lit(0)).alias("assistant_words"), F.coalesce(F.sum(n), F.lit(0)).alias("words"))


@query("""WITH t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last_ FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, count(*) AS turns, count_if(coalesce(before = role, false) OR (before IS NULL AND role <> 'user') OR (last_ AND role <> 'assistant')) = 0 AS strict FROM t GROUP BY conv_id""")
def role_alternation(spark, sf_dir):
    return sequences.alternation(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, regexp_matches(text, '(?i)licen[cs]e') AS licence, regexp_matches(text, '(?i)licen[cs]e') AND regexp_matches(text, '(?i)mit|apache') AS gate FROM documents WHERE text IS NOT NULL")
def keyword_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", literature.keyword_gate(F.col("text"), "licen[cs]e").alias("licence"), literature.keyword_gate(F.col("text"), "licen[cs]e", "mit|apache").alias("gate"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.title(F.col("html")).alias("title"))


def _html_sql() -> str:
    """The reader's result by patterns, as far as the tags and entities of the pages go."""
    nl, out = "' || chr(10) || '", "html"
    steps = [
        ("(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), ("(?is)<nav>.*?</nav>", nl * 2), ("(?s)<!--.*?-->", ""), ("<[^>]*$", ""), ("(?i)<h1[^>]*>", f"{nl * 2}# "),
        ("(?i)</?(p|div|article|h1|br|footer)(\\s[^>]*)?>", nl), ("<[^>]*>", ""), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&"),
        ("[ \\t\\r\\f\\v]+", " "), (" ?\\| ?", " | "), ("\\n ", nl), ("\\n{3,}", nl * 2), ("^\\s+|\\s+$", ""),
    ]
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


@query(_html_sql())
def html_to_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("""WITH r AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) AS refs FROM pages) SELECT page_id, array_to_string(list_sort(refs), ',') AS refs, len(refs)::INTEGER AS n FROM r""")
def url_refs(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z]+)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("refs"), F.size(found).alias("n"))


def _scrub_sql() -> str:
    out = "text"
    for pattern, by in (*T.SCRUB, *T.LISTED):  # documents hold no installations, whose rule needs \\G
        to = re.sub(r"\$(\d)", r"\\\1", by)
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents WHERE text IS NOT NULL"


@query(_scrub_sql())
def scrub_text(spark, sf_dir):
    return texts(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.scrub(F.col("text")).alias("text"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL AND json_valid(props)")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v")).where("v is not null")
    return e.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


@query("SELECT doc_id AS id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE regexp_matches(text, '\\S')")
def inverted_index_rebuild(spark, sf_dir):
    w = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"))
    return literature.rebuild_inverted(literature.inverted_index(w))


@query("""SELECT doc_id, CASE WHEN quality = 0 OR doc_id % 5 < 2 THEN 'reject' WHEN doc_id % 3 = 0 THEN 'needs_review' WHEN doc_id % 4 = 0 THEN 'results_only'
    WHEN doc_id % 5 < 3 OR toxic = 1 THEN 'silver' ELSE 'gold' END AS status FROM labels""")
def status_decision(spark, sf_dir):
    lab, yes = table(spark, sf_dir, "labels"), F.lit("yes")
    core = [F.when(F.col("quality") == 0, "no").when(F.col("doc_id") % 3 == 0, "unclear").otherwise("yes")]
    public = (F.when(F.col("doc_id") % 4 == 0, "no").otherwise("yes"), yes)
    made = literature.status(core, F.col("doc_id") % 5, F.lit(True), F.lit(False), public, (F.lit(True), F.lit(True)), yes, F.when(F.col("toxic") == 1, "unclear").otherwise("yes"))
    return lab.select("doc_id", made.alias("status"))


@query("""WITH p AS (SELECT doc_id, lang AS l1, CASE WHEN doc_id % 11 = 0 THEN upper(lang) || '.' WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang END AS l2, source AS s1, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE source END AS s2,
        n_chars AS n1, n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS n2 FROM documents)
    SELECT doc_id, 'lang' AS field, l1 AS "left", l2 AS "right" FROM p WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'source', s1, s2 FROM p WHERE s1 <> s2 UNION ALL SELECT doc_id, 'n_chars', n1::VARCHAR, n2::VARCHAR FROM p WHERE n1 <> n2""")
def field_diff(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), F.col("doc_id")
    lang = F.when(k % 11 == 0, F.concat(F.upper("lang"), F.lit("."))).when(k % 13 == 0, "xx").otherwise(F.col("lang"))
    other = d.select("doc_id", lang.alias("lang"), F.when(k % 17 == 0, "other").otherwise(F.col("source")).alias("source"), (F.col("n_chars") + F.when(k % 19 == 0, 1).otherwise(0)).alias("n_chars"))
    return literature.field_diff(d, other, "doc_id", ["source"], ["lang"], ["n_chars"])


@query("""WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
    x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    b AS (SELECT a.label AS a, c.label AS b, sum(a.x * c.x) AS s FROM m a JOIN m c ON a.i = c.i AND a.label <= c.label GROUP BY ALL)
    SELECT b.a, b.b, round(s, 6) AS mean_cosine, CASE WHEN b.a = b.b AND n > 1 THEN round((s * n * n - n) / (n * (n - 1)), 6) END AS off_diagonal FROM b JOIN n ON b.a = n.label""")
def vector_cosine_blocks(spark, sf_dir):
    return rounded(tokens.cosine_blocks(table(spark, sf_dir, "embeddings"), "label", "embedding"), "mean_cosine", "off_diagonal")


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS g FROM lineitem)
    SELECT l_returnflag AS teacher, count(*) AS n, round(avg(l_extendedprice) - (SELECT g FROM s) * avg(l_quantity), 3) AS adjusted FROM lineitem GROUP BY ALL""")
def casl_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    gamma = scores.ols(rows, "l_extendedprice", ["l_quantity"])[1]
    return rows.groupBy(F.col("l_returnflag").alias("teacher")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice") - F.lit(gamma) * F.avg("l_quantity"), 3).alias("adjusted"))


@query(f"""WITH {GRID}, idx AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS idx FROM (SELECT DISTINCT task FROM grid)), nn AS (SELECT count(*) AS n FROM idx),
    draws AS (SELECT rep, (('0x' || substr(md5(rep || ':' || k), 1, 8))::BIGINT % n) AS idx, count(*) AS cnt FROM nn, range(200) r(rep), range(n) q(k) GROUP BY ALL),
    m AS (SELECT rep, teacher, round(sum(score * cnt) / sum(cnt), 9) AS mean FROM grid JOIN idx USING (task) JOIN draws USING (idx) GROUP BY ALL),
    p AS (SELECT teacher, row_number() OVER (PARTITION BY rep ORDER BY mean DESC, teacher) AS place FROM m)
    SELECT teacher, place::INTEGER AS place, round(count(*) / 200, 6) AS p FROM p GROUP BY ALL""")
def bootstrap_top1(spark, sf_dir):
    g = grid(spark, sf_dir)
    m = bootstrap.replicate_means(g, bootstrap.hashed_draws(g.select("task").distinct(), 200)).withColumn("mean", F.round("mean", 9))
    return rounded(bootstrap.rank_distribution(m), "p")


@query()
def bootstrap_seeded(spark, sf_dir):
    g = grid(spark, sf_dir)
    return bootstrap.interval(bootstrap.replicate_means(g, bootstrap.seeded_draws(spark, g.select("task").distinct().count(), 200, 42)))


@query(f"""WITH {GRID}, idx AS (SELECT task, row_number() OVER (ORDER BY md5(task::VARCHAR)) - 1 AS place FROM (SELECT DISTINCT task FROM grid)), k AS (SELECT count(*) AS k FROM idx),
    ns AS (SELECT DISTINCT least(n, k) AS n FROM (SELECT unnest([5, 10, 20, 50, 100, 200]) AS n), k), m AS (SELECT ns.n, teacher, avg(score) AS m FROM grid JOIN idx USING (task) JOIN ns ON place < ns.n GROUP BY ALL),
    o AS (SELECT n, string_agg(teacher, ' > ' ORDER BY m DESC, teacher) AS ranking FROM m GROUP BY n), last_ AS (SELECT arg_max(ranking, n) AS full_ FROM o)
    SELECT n::INTEGER AS n, ranking, (SELECT min(n)::INTEGER FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b, last_ WHERE b.n >= a.n AND b.ranking <> full_)) AS smallest_stable_n FROM o""")
def ablation_hashed(spark, sf_dir):
    """Nested subsets in the order of the tasks' digests, which any engine can repeat."""
    g = grid(spark, sf_dir)
    orders = bootstrap.nested_orders(g, [5, 10, 20, 50, 100, 200], places=bootstrap.hashed_places(g))
    full = orders.orderBy(F.desc("n")).first()
    return orders.join(F.broadcast(bootstrap.smallest_stable(orders, full.ranking if full else "")))


@query()
def ablation_nested(spark, sf_dir):
    orders = bootstrap.nested_orders(grid(spark, sf_dir), [5, 10, 20, 50, 100, 200], 42)
    full = orders.orderBy(F.desc("n")).first()
    return orders.join(F.broadcast(bootstrap.smallest_stable(orders, full.ranking if full else "")))


def _assignment(spark, given):
    return spark.createDataFrame(sorted(given.items()), "task string, teacher string")


@query()
def balanced_select(spark, sf_dir):
    u = selection.table(grid(spark, sf_dir), "score")
    return _assignment(spark, selection.balanced(u, selection.quotas(len(u), sorted({t for x in u.values() for t in x}))))


@query()
def token_matched_select(spark, sf_dir):
    g = grid(spark, sf_dir)
    u, n = selection.table(g, "score"), selection.table(g, "n")
    quota = selection.quotas(len(u), sorted({t for x in u.values() for t in x}))
    total = round(sum(sum(x.values()) / len(x) for x in n.values()))
    return _assignment(spark, selection.matched(u, n, quota, total))


@query("""SELECT md5(coalesce(text, '')) AS key, first(lang ORDER BY doc_id) FILTER (WHERE lang <> '') AS lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id) AS hops FROM documents GROUP BY md5(coalesce(text, ''))""")
def candidate_merge(spark, sf_dir):
    """Documents of one text as one candidate."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "doc_id", "lang", "source", F.col("doc_id").alias("hops"))
    return literature.merge_candidates(d, "key", "doc_id", ["lang"], ["source"], ["hops"]).select("key", "lang", F.array_join(F.array_sort("source"), ",").alias("sources"), "hops")


@query("""WITH e AS (SELECT DISTINCT user_id AS a, 1000 + event_id % 5000 AS b FROM events WHERE user_id IS NOT NULL), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    h1 AS (SELECT b AS a, count(*) AS n FROM both_ WHERE a = 1 AND b <> 1 GROUP BY b),
    f1 AS (SELECT a FROM h1 WHERE a % 3 <> 0 ORDER BY n DESC, a LIMIT 12), h2 AS (SELECT b AS a, count(*) AS n FROM both_ WHERE a IN (SELECT a FROM f1) AND b <> 1 AND b NOT IN (SELECT a FROM h1) GROUP BY b),
    f2 AS (SELECT a FROM h2 WHERE a % 3 <> 0 ORDER BY n DESC, a LIMIT 12), h3 AS (SELECT b AS a, count(*) AS n FROM both_ WHERE a IN (SELECT a FROM f2) AND b <> 1 AND b NOT IN (SELECT a FROM h1) AND b NOT IN (SELECT a FROM h2) GROUP BY b)
    SELECT 1::BIGINT AS node, 0 AS hops UNION ALL SELECT a, 1 FROM h1 UNION ALL SELECT a, 2 FROM h2 UNION ALL SELECT a, 3 FROM h3""")
def citation_bfs(spark, sf_dir):
    """Users and what they touched as papers and citations; a gate and a frontier of 12 bound what is followed, which is the search's own feature."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("a"), (1000 + F.col("event_id") % 5000).alias("b")).distinct()
    gate = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().where("node % 3 <> 0")
    return literature.citation_search(spark.createDataFrame([(1,)], "node long"), e, 3, 12, gate)


@query("""SELECT label_pair, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement
    FROM (SELECT quality, toxic, CASE WHEN quality = toxic THEN 'same' ELSE 'different' END AS label_pair FROM labels) GROUP BY label_pair""")
def label_agreement(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("label_pair", F.when(F.col("quality") == F.col("toxic"), "same").otherwise("different"))
    return rounded(lab.groupBy("label_pair").agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("agreement")), "agreement")


@query("SELECT l_returnflag AS teacher, l_suppkey AS task, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def star_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("teacher"), F.col("l_suppkey").alias("task")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity"), 4).alias("score"), F.count("*").alias("n"))


def token_rows(spark, sf_dir):
    """A stand-in for model output: each line item as a token of (supplier, order) with a log-probability and a rank."""
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_suppkey") % 4).alias("teacher"), (F.col("l_orderkey") % 50).alias("task"), F.col("l_orderkey").alias("turn"), (F.col("l_linenumber") - 1).alias("pos"), (-F.col("l_quantity") / 10).alias("logprob"), (F.col("l_partkey") % 300 + 1).alias("rank"))


TOKENS = "tk AS (SELECT l_suppkey % 4 AS teacher, l_orderkey % 50 AS task, l_orderkey AS turn, l_linenumber - 1 AS pos, -l_quantity / 10 AS logprob, l_partkey % 300 + 1 AS rank FROM lineitem)"


@query(f"WITH {TOKENS} SELECT teacher, task, round(avg(logprob), 6) AS score, count(logprob) AS n FROM tk GROUP BY ALL")
def global_nll(spark, sf_dir):
    return rounded(tokens.global_nll(token_rows(spark, sf_dir)), "score")


@query(f"WITH {TOKENS}, t AS (SELECT teacher, task, turn, avg(logprob) AS m FROM tk GROUP BY ALL) SELECT teacher, task, round(avg(m), 9) AS score, count(*) AS n FROM t GROUP BY ALL")
def local_nll(spark, sf_dir):
    return tokens.local_nll(token_rows(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"""WITH {TOKENS} SELECT teacher, task, round(coalesce(avg(logprob) FILTER (WHERE pos >= 2), -16), 6) AS drop, round(avg(logprob), 6) AS mean, count_if(pos < 2)::BIGINT AS heads, round(count_if(pos < 2) / count(*), 6) AS ratio FROM tk GROUP BY ALL""")
def step_drop(spark, sf_dir):
    return rounded(tokens.step_drop(token_rows(spark, sf_dir)), "drop", "mean", "ratio")


@query(f"WITH {TOKENS} SELECT teacher, task, sum(least(rank, 100))::BIGINT AS num, round(sum(-logprob), 4) AS den, count(*) AS n, round(sum(least(rank, 100)) / sum(-logprob), 6) AS score FROM tk GROUP BY ALL")
def rank_surprisal(spark, sf_dir):
    return rounded(tokens.rank_surprisal(token_rows(spark, sf_dir)), "score").withColumn("den", F.round("den", 4))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL")
def guarded_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value").where("value is not null")
    return guard(e, F.isnan("value"), "value is not finite")


def segs(spark, sf_dir):
    """Events as labelled segments: errors failed, signups are format episodes, a purchase within three rows recovers, rewards go by user."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = sequences.next_k(seq(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "purchase")
    reward = F.when(F.col("user_id") % 3 == 1, 0.0).when(F.col("user_id") % 3 == 2, 1.0)
    return e.select((F.col("user_id") % 5).alias("teacher"), F.col("user_id").alias("task"), F.when(F.col("event_type") == "signup", "format").otherwise("command").alias("kind"), F.col("event_type").isin("error", "signup").alias("failure"), (k % 7).cast("string").alias("category"), (k % 3).cast("string").alias("subcategory"), "recovered", reward.alias("reward"), F.lit(True).alias("parsed"))


def taxonomy(spark):
    return spark.createDataFrame([(str(c), str(s)) for c in range(6) for s in range(2)], "category string, subcategory string")


SEGS = """segs AS (SELECT user_id % 5 AS teacher, user_id AS task, event_type = 'signup' AS fmt, event_type IN ('error', 'signup') AS failure, (props->>'$.k')::INTEGER % 7 AS c, (props->>'$.k')::INTEGER % 3 AS s,
        CASE WHEN event_type = 'signup' THEN 'Agent format :: Unparseable response' ELSE ((props->>'$.k')::INTEGER % 7)::VARCHAR || ' :: ' || ((props->>'$.k')::INTEGER % 3)::VARCHAR END AS key,
        CASE WHEN event_type = 'signup' THEN 'Agent format' ELSE ((props->>'$.k')::INTEGER % 7)::VARCHAR END AS cat, CASE user_id % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS reward,
        coalesce(max((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1, false) AS recovered FROM events WHERE user_id IS NOT NULL),
    cmd AS (SELECT *, coalesce(reward = 0, true) AS lost FROM segs WHERE NOT fmt),
    fine AS (SELECT key, cat, count(*) / (SELECT count(*) FROM cmd) AS q1, count_if(NOT recovered) / (SELECT count(*) FROM cmd) AS q2, count_if(lost) / (SELECT count(*) FROM cmd WHERE lost) AS q3 FROM cmd WHERE failure GROUP BY ALL),
    views AS (SELECT 'qS_all_episodes' AS view, key, cat, q1 AS q FROM fine UNION ALL SELECT 'qS_unrecovered', key, cat, q2 FROM fine UNION ALL SELECT 'qS_failed_trajectories', key, cat, q3 FROM fine),
    prof AS (SELECT view, key, q FROM views WHERE q > 0 UNION ALL SELECT view || '_cat', cat, sum(q) FROM views WHERE q > 0 GROUP BY view, cat)"""


@query(f"""WITH {SEGS}, cc AS (SELECT teacher, task, key, count(*) AS n FROM cmd WHERE failure GROUP BY ALL)
    SELECT teacher, task, count(*) AS commands, count_if(failure)::BIGINT AS failed, round(count_if(failure) / count(*), 6) AS rate, count_if(failure AND NOT (c < 6 AND s < 2))::BIGINT AS invalid_pairs,
           coalesce((SELECT string_agg(key || '=' || n, ', ' ORDER BY key) FROM cc WHERE cc.task = cmd.task), '') AS categories FROM cmd GROUP BY teacher, task""")
def command_errors(spark, sf_dir):
    out = profiles.command_errors(profiles.valid_pairs(segs(spark, sf_dir), taxonomy(spark)))
    listed = F.array_join(F.transform("category_counts", lambda x: F.concat(x["key"], F.lit("="), x["n"].cast("string"))), ", ")
    return rounded(out, "rate").select("teacher", "task", "commands", "failed", "rate", "invalid_pairs", F.coalesce(listed, F.lit("")).alias("categories"))


@query(f"WITH {SEGS} SELECT view, key, round(q, 6) AS q FROM prof")
def student_profile_views(spark, sf_dir):
    return rounded(profiles.student_profiles(segs(spark, sf_dir)), "q")


@query(f"""WITH {SEGS}, n AS (SELECT teacher, task, count(*) AS n FROM segs GROUP BY ALL), comp AS (
        SELECT teacher, task, false AS coarse, key, count(*) AS occ, count_if(recovered) AS rec FROM segs WHERE failure GROUP BY ALL UNION ALL
        SELECT teacher, task, true, cat, count(*), count_if(recovered) FROM segs WHERE failure GROUP BY ALL),
    hit AS (SELECT c.teacher, c.task, p.view, sum(q * occ / n.n * rec / occ) AS score FROM comp c JOIN n ON c.task = n.task JOIN prof p ON p.key = c.key AND ends_with(p.view, '_cat') = c.coarse GROUP BY ALL),
    every_ AS (SELECT * FROM (SELECT DISTINCT teacher, task FROM segs) CROSS JOIN (SELECT DISTINCT view FROM prof)),
    own AS (SELECT c.teacher, c.task, sum(rec) / any_value(n.n) AS density, sum(occ) / any_value(n.n) AS rate, sum(rec) / sum(occ) AS unweighted FROM comp c JOIN n ON c.task = n.task WHERE NOT coarse GROUP BY ALL)
    SELECT e.teacher, e.task, e.view, round(coalesce(score, 0), 6) AS score FROM every_ e LEFT JOIN hit h ON e.task = h.task AND e.view = h.view
    UNION ALL SELECT teacher, task, 'control_recovery_density', round(density, 6) FROM own UNION ALL SELECT teacher, task, 'control_total_error_rate', round(rate, 6) FROM own
    UNION ALL SELECT teacher, task, 'control_recovery_event_rate', round(density, 6) FROM own UNION ALL SELECT teacher, task, 'control_recovery_rate_unweighted', round(unweighted, 6) FROM own""")
def scrf_views(spark, sf_dir):
    s = segs(spark, sf_dir)
    return rounded(profiles.weighted_views(s, profiles.student_profiles(s)), "score")


@query(f"""WITH {SEGS}, bars AS (SELECT teacher::VARCHAR AS agent, cat AS category, count(*) AS failed, count_if(recovered)::BIGINT AS recovered FROM segs WHERE failure GROUP BY ALL
        UNION ALL SELECT 'student', cat, count(*), count_if(recovered)::BIGINT FROM segs WHERE failure GROUP BY cat),
    o AS (SELECT category, (row_number() OVER (ORDER BY sum(failed) DESC, category) - 1)::INTEGER AS place FROM bars GROUP BY category)
    SELECT agent, category, failed, recovered, place FROM bars JOIN o USING (category)""")
def recovery_bars(spark, sf_dir):
    s = segs(spark, sf_dir)
    return profiles.failed_and_recovered(profiles.components(s), profiles.student_recovery(s))


@query(f"""WITH {MEANS}, {TRUTH_SQL}, t AS (SELECT * FROM means JOIN truth USING (teacher)), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS i, row_number() OVER (ORDER BY score, pos DESC) AS j FROM t)
    SELECT string_agg(teacher, ' > ' ORDER BY i) AS predicted, count(DISTINCT score) > 1 AND max(CASE WHEN i = 1 THEN grp END) = min(grp) AS top1_correct,
           count(DISTINCT score) > 1 AND max(CASE WHEN j = 1 THEN grp END) = max(grp) AS worst_correct, count(DISTINCT score) <= 1 AS all_tied FROM o""")
def predicted_order(spark, sf_dir):
    return scores.predicted_order(means(spark, sf_dir), scores.truth_table(spark, TRUTH))


@query("""WITH c AS (SELECT doc_id AS key, source = 'src0' AS seed, CASE WHEN lang = 'en' THEN 'yes' WHEN lang = 'fr' THEN 'no' ELSE 'unclear' END AS relevant, quality AS confidence, toxic = 1 AS bare, n_chars AS hops FROM documents LEFT JOIN labels USING (doc_id))
    SELECT key, relevant, hops FROM c WHERE relevant <> 'no' ORDER BY NOT seed, relevant <> 'yes', coalesce(confidence, 0) DESC, coalesce(bare, true), hops, key LIMIT 25""")
def prescreen_order(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    sources = F.array(F.when(F.col("source") == "src0", "seed").otherwise(F.col("source")))
    c = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("key"), sources.alias("sources"), F.when(F.col("lang") == "en", "yes").when(F.col("lang") == "fr", "no").otherwise("unclear").alias("relevant"), F.col("quality").cast("double").alias("confidence"), F.when(F.col("toxic") == 0, "id").alias("arxiv_id"), F.col("n_chars").alias("hops"))
    return literature.prescreened(c, 25).select("key", "relevant", "hops")


def order_pool(spark, sf_dir):
    """Priorities as teachers, nations as tasks, with four scores of which one is undefined at times; joined from three inputs."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("o_orderpriority").alias("teacher"), F.col("c_nationkey").alias("task")]
    named = lambda df: df.withColumn("trajectory_id", F.concat_ws("::", "teacher", F.col("task").cast("string")))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    t = named(o.groupBy(*keys).agg(F.count("*").alias("turns")))
    s = named(o.groupBy(*keys).agg(F.max(price).cast("double").alias("rsr"), F.min(price).cast("double").alias("nll"), F.countDistinct("o_custkey").cast("double").alias("rank")))
    a = named(o.groupBy(*keys).agg(F.count_if(F.col("o_orderstatus") == "F").alias("tokens"), F.lit(0).alias("sft_turns_truncated")))
    made = pool.candidates(t, s, a)
    return made.withColumn("tor", F.when(F.col("turns") % 4 != 0, F.col("tokens") / F.col("turns")))


ORDER_POOL = """p0 AS (SELECT o_orderpriority AS teacher, c_nationkey AS task, count(*) AS turns, max(o_totalprice::DECIMAL(18,2))::DOUBLE AS rsr, min(o_totalprice::DECIMAL(18,2))::DOUBLE AS nll, count(DISTINCT o_custkey)::DOUBLE AS rank, count_if(o_orderstatus = 'F')::BIGINT AS tokens
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    p1 AS (SELECT *, CASE WHEN turns % 4 <> 0 THEN tokens / turns END AS tor FROM p0 WHERE task IN (SELECT task FROM p0 GROUP BY task HAVING count(DISTINCT teacher) = (SELECT count(DISTINCT teacher) FROM p0))),
    u AS (SELECT 'rsr_low' AS arm, task, teacher, -rsr AS utility FROM p1 UNION ALL SELECT 'rsr_high', task, teacher, rsr FROM p1 UNION ALL SELECT 'tor_high', task, teacher, coalesce(tor, -1) FROM p1
        UNION ALL SELECT 'nll_low', task, teacher, -nll FROM p1 UNION ALL SELECT 'rank_low', task, teacher, -rank FROM p1),
    arms AS (SELECT arm, task, teacher, utility FROM (SELECT *, row_number() OVER (PARTITION BY arm, task ORDER BY utility DESC, substr(sha256(task::VARCHAR || chr(0) || teacher), 1, 16) DESC, teacher DESC) AS i FROM u) WHERE i = 1)"""


@query(f"WITH {ORDER_POOL} SELECT teacher, task, turns, rsr, nll, rank, tokens, round(tor, 6) AS tor FROM p1")
def candidate_pool(spark, sf_dir):
    return rounded(order_pool(spark, sf_dir), "tor").select("teacher", "task", "turns", "rsr", "nll", "rank", "tokens", "tor")


@query(f"WITH {ORDER_POOL} SELECT arm, task, teacher, round(utility, 6) AS utility FROM arms")
def selection_arms(spark, sf_dir):
    return rounded(pool.arms(order_pool(spark, sf_dir)), "utility")


@query(f"""WITH {ORDER_POOL} SELECT a.arm, count(*) AS n, count(b.task) AS shared, round(count(b.task) / count(*), 6) AS share
    FROM arms a LEFT JOIN arms b ON b.arm = 'rsr_low' AND a.task = b.task AND a.teacher = b.teacher GROUP BY a.arm""")
def arm_overlap(spark, sf_dir):
    return rounded(pool.arm_overlap(pool.arms(order_pool(spark, sf_dir)), "rsr_low"), "share")


@query(f"""WITH {ORDER_POOL}, f AS (SELECT 'rsr' AS field, rsr AS v FROM p1 UNION ALL SELECT 'tokens', tokens FROM p1 UNION ALL SELECT 'tor', tor FROM p1)
    SELECT field, round(min(v), 6) AS min, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM f GROUP BY field""")
def field_summary(spark, sf_dir):
    return rounded(pool.summary(order_pool(spark, sf_dir), "rsr", "tokens", "tor"), "min", "median", "mean", "max")


@query("""WITH t AS (SELECT c_nationkey AS task, CASE c_nationkey % 4 WHEN 0 THEN 'hard' WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' END AS difficulty FROM customer GROUP BY c_nationkey) SELECT difficulty, count(*) AS tasks FROM t GROUP BY difficulty""")
def difficulty_counts(spark, sf_dir):
    k = F.col("c_nationkey") % 4
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("teacher"), F.col("c_nationkey").alias("task"), F.when(k == 0, "hard").when(k == 1, " easy ").when(k == 2, "medium").otherwise(" ").alias("difficulty"))
    return pool.difficulty_counts(rows)


@query("""WITH t AS (SELECT o_custkey AS task, o_orderstatus AS status, o_orderpriority AS priority FROM orders), f AS (SELECT task, count(DISTINCT status) AS s, count(DISTINCT priority) AS p FROM t GROUP BY task)
    SELECT 'status' AS field, count(*) AS tasks, count_if(s = 1)::BIGINT AS equal FROM f UNION ALL SELECT 'priority', count(*), count_if(p = 1)::BIGINT FROM f""")
def input_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return pool.alignment(rows, "status", "priority")


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'fail_retrieval'
        WHEN len(regexp_extract_all(text, 'GPT')) + len(regexp_extract_all(text, 'Claude')) + len(regexp_extract_all(text, 'DeepSeek')) + len(regexp_extract_all(text, 'Qwen')) + len(regexp_extract_all(text, 'Gemini')) + len(regexp_extract_all(text, 'Llama')) >= 3 AND regexp_matches(lower(text), 'sft|supervised fine')
          OR regexp_matches(text, 'from (GPT|Claude|DeepSeek|Qwen)') OR (contains(lower(text), 'ablation') AND regexp_matches(text, 'GPT|Claude|DeepSeek') AND (len(regexp_extract_all(lower(text), 'sft')) >= 2 OR len(regexp_extract_all(lower(text), 'training')) >= 3)) THEN 'pass'
        ELSE 'fail_scan' END AS verdict FROM documents""")
def signal_scan(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", literature.scan_verdict(F.col("text")).alias("verdict"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def run_counts(spark, sf_dir):
    return literature.run_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@query()
def projected_vectors(spark, sf_dir):
    return tokens.projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16, 42)
