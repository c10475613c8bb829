"""Registered queries over terminal trajectories.

The tables hold no shell turns, so each conversation is retold as one: the
length of an assistant's text decides, by the rules in `TURNS`, what is typed
and what the screen shows. The SQL twins know the commands from the same rules
and never look at the text; the queries parse it out of turns and screens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shell
from .slate import PLACES, query, table

#: Each turn with its two commands, what they are typed as and what they show; both engines read this.
TURNS = """numbered AS (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS a FROM conversations WHERE role = 'assistant'),
    ruled AS (SELECT conv_id, a, n, n % 11 = 0 AS garbled, n % 17 = 0 AS silent, n % 13 = 0 AS done, n % 6 = 0 AS hidden, CAST(floor(n / 5) AS BIGINT) % 5 AS second_,
        CASE n % 5 WHEN 0 THEN concat('cat /srv/f', n % 3, '.txt') WHEN 1 THEN concat('ls /srv/d', n % 2) WHEN 2 THEN concat('touch /srv/d0/f', n % 3, '.txt') WHEN 3 THEN concat('echo ', chr(39), 'two') ELSE concat('echo note > /srv/f', n % 2, '.txt') END AS line0,
        CASE CAST(floor(n / 5) AS BIGINT) % 5 WHEN 0 THEN 'cp /srv/f0.txt /srv/d0/f1.txt' WHEN 1 THEN 'cat notes.md' WHEN 2 THEN 'pytest -q' WHEN 3 THEN 'cd /srv/d0' ELSE 'python3 /srv/f1.txt' END AS line1,
        CASE WHEN n % 3 = 0 THEN 'Error: no' ELSE 'fine' END AS out0, CASE WHEN n % 4 = 0 THEN 'cp: Permission denied' ELSE 'fine' END AS out1 FROM numbered),
    turns AS (SELECT *, concat(CASE WHEN conv_id % 2 = 0 THEN 'root@box:/app' ELSE 'Apptainer' END, CASE WHEN conv_id % 2 = 0 THEN '# ' ELSE '> ' END) AS prompt,
        concat(line0, CASE WHEN n % 5 = 3 THEN concat(chr(92), 'nlines', chr(39)) ELSE '' END, chr(92), 'n') AS keys0, concat(line1, chr(92), 'n') AS keys1 FROM ruled),
    said AS (SELECT *, CASE WHEN garbled THEN 'no plan today' ELSE concat(CASE WHEN n % 2 = 0 THEN 'hm {"x": 1} </think>' ELSE '' END, '{"analysis": "", "commands": [',
            CASE WHEN silent THEN '' ELSE concat('{"keystrokes": "', keys0, '"}, {"keystrokes": "', keys1, '"}') END, ']', CASE WHEN done THEN ', "task_complete": true' ELSE '' END, '}') END AS content,
        CASE WHEN garbled THEN concat('Parsing error: send JSON', chr(10), prompt) ELSE concat(CASE WHEN silent THEN '' ELSE concat(prompt, line0, chr(10), out0, chr(10), CASE WHEN hidden THEN '' ELSE concat(prompt, line1, chr(10), out1, chr(10)) END) END, prompt) END AS screen FROM turns)"""
OPENING = "Do it.\nWorking Directory: /app\n"

#: The commands that a screen shows, from the rules; the output of the last one reaches to the end of the screen.
EVENTS = f"""WITH {TURNS}, typed AS (SELECT *, 0 AS i, line0 AS line, CASE WHEN hidden THEN concat(out0, chr(10), prompt) ELSE out0 END AS output FROM turns WHERE NOT garbled AND NOT silent UNION ALL SELECT *, 1, line1, concat(out1, chr(10), prompt) FROM turns WHERE NOT garbled AND NOT silent AND NOT hidden),
    placed AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN conv_id % 2 = 1 AND coalesce(bool_or(line = 'cd /srv/d0') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN '/srv/d0' ELSE '/app' END AS cwd FROM typed WINDOW w AS (PARTITION BY conv_id ORDER BY a, i)),
    ev AS (SELECT conv_id, a AS turn, pos, line, split_part(line, ' ', 1) AS word, cwd, output, regexp_matches(lower(output), 'error|permission denied') AS bad,
        CASE WHEN starts_with(line, 'cat') OR starts_with(line, 'ls') THEN 'observation' WHEN starts_with(line, 'touch') OR starts_with(line, 'cp') OR starts_with(line, 'python3') OR contains(line, '>') THEN 'action' ELSE 'other' END AS kind,
        CASE WHEN i = 0 THEN CASE n % 5 WHEN 3 THEN []::VARCHAR[] WHEN 4 THEN [split_part(line, '> ', 2)] ELSE [split_part(line, ' ', 2)] END
             ELSE CASE second_ WHEN 0 THEN ['/srv/d0/f1.txt', '/srv/f0.txt'] WHEN 1 THEN [cwd || '/notes.md'] WHEN 2 THEN []::VARCHAR[] ELSE [split_part(line, ' ', 2)] END END AS paths FROM placed),
    everyone AS (SELECT DISTINCT conv_id FROM numbered)"""
#: For each command and each looking one with targets, whether they fit.
FITS = f"""{EVENTS}, target AS (SELECT *, unnest(paths) AS p FROM ev),
    near AS (SELECT t.conv_id, t.pos, t.turn, o.pos AS opos, o.turn AS oturn, bool_or(o.p = t.p) AS exact, bool_or(o.p = t.p OR starts_with(t.p, o.p || '/')) AS strict,
        bool_or(o.p = t.p OR starts_with(t.p, o.p || '/') OR starts_with(o.p, t.p || '/') OR split_part(o.p, '/', -1) = split_part(t.p, '/', -1)) AS loose FROM target t JOIN target o ON t.conv_id = o.conv_id AND o.kind = 'observation' GROUP BY ALL)"""
_WINDOWS = {"any": "opos < e.pos", "prevturn": "oturn < e.turn"}
_VIEWS = [(how, w) for how in ("loose", "strict", "exact") for w in _WINDOWS]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as `said` in TURNS has them."""
    rules = TURNS.replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {conversations}")
    return spark.sql(f"WITH {rules} SELECT conv_id, a, content, screen FROM said", conversations=table(spark, sf_dir, "conversations"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages): the opening, then turns and screens by turns."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.array_sort(F.collect_list(F.struct("a", "content", "screen")))
    per = conversations(spark, sf_dir).groupBy("conv_id").agg(turns.alias("turns"))
    both = F.flatten(F.transform("turns", lambda t: F.array(message("assistant", t["content"]), message("user", t["screen"]))))
    return per.select("conv_id", F.concat(F.array(message("user", F.lit(OPENING))), both).alias("messages"))


def with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.with_events(trajectories(spark, sf_dir))


@query(f"{EVENTS} SELECT conv_id, turn::INTEGER AS turn, pos::INTEGER AS pos, line, word, array_to_string(paths, ',') AS paths, cwd, kind, output FROM ev")
def shell_segments(spark, sf_dir):
    e = with_events(spark, sf_dir).select("conv_id", F.explode("events").alias("e"))
    return e.select("conv_id", "e.turn", "e.pos", "e.line", "e.word", F.array_join("e.paths", ",").alias("paths"), "e.cwd", "e.kind", "e.output")


@query(f"""{FITS}, hit AS (SELECT e.conv_id, e.pos, e.kind, e.word, {", ".join(f"coalesce(bool_or({h} AND {_WINDOWS[w]}), false) AS {h}_{w}" for h, w in _VIEWS)} FROM ev e LEFT JOIN near n ON e.conv_id = n.conv_id AND e.pos = n.pos GROUP BY ALL)
    SELECT conv_id, {", ".join(f"round(avg({h}_{w}::INTEGER) FILTER (WHERE {member}), {PLACES}) AS tor_{name}_{h}_{w}" for name, member in (("list", "kind = 'action'"), ("all", "kind <> 'observation' AND word <> 'cd'")) for h, w in _VIEWS)}
    FROM everyone LEFT JOIN hit USING (conv_id) GROUP BY conv_id""")
def tor_views(spark, sf_dir):
    g = shell.grounding(with_events(spark, sf_dir))
    return g.select("conv_id", *(F.round(c, PLACES).alias(c) for c in g.columns if c.startswith("tor_")))


@query(f"""{FITS}, hit AS (SELECT e.conv_id, e.pos, coalesce(bool_or(loose AND opos < e.pos), false) AS early, coalesce(bool_or(loose AND opos > e.pos AND oturn <= e.turn + 3), false)
            OR EXISTS (SELECT 1 FROM ev c WHERE c.conv_id = e.conv_id AND c.pos > e.pos AND c.turn <= e.turn + 3 AND c.word = 'pytest') AS late
        FROM ev e LEFT JOIN near n ON e.conv_id = n.conv_id AND e.pos = n.pos WHERE e.kind = 'action' GROUP BY e.conv_id, e.pos, e.turn)
    SELECT conv_id, round(avg(late::INTEGER), {PLACES}) AS egs_post, round(avg((early AND late)::INTEGER), {PLACES}) AS egs_loop FROM everyone LEFT JOIN hit USING (conv_id) GROUP BY conv_id""")
def egs(spark, sf_dir):
    g = shell.grounding(with_events(spark, sf_dir))
    return g.select("conv_id", F.round("egs_post", PLACES).alias("egs_post"), F.round("egs_loop", PLACES).alias("egs_loop"))


@query(f"""{EVENTS}, per AS (SELECT conv_id, turn, coalesce(list(DISTINCT word) FILTER (WHERE bad), []) AS words FROM ev GROUP BY ALL),
    step AS (SELECT conv_id, list_has_any(words, lead(words) OVER (PARTITION BY conv_id ORDER BY turn)) AS again FROM per),
    follow AS (SELECT conv_id, bad AND word = lead(word) OVER (PARTITION BY conv_id ORDER BY pos) AS same FROM ev)
    SELECT conv_id, coalesce((SELECT count_if(again) FROM step s WHERE s.conv_id = e.conv_id), 0)::INTEGER AS cycles, greatest(coalesce((SELECT count(*) FROM step s WHERE s.conv_id = e.conv_id), 0) - 1, 0)::INTEGER AS turn_pairs,
        coalesce((SELECT count_if(same) FROM follow f WHERE f.conv_id = e.conv_id), 0)::INTEGER AS verbatim_cycles FROM everyone e""")
def error_retry_traj(spark, sf_dir):
    return shell.error_retry(with_events(spark, sf_dir)).drop("messages", "events")


@query(f"""WITH {TURNS} SELECT conv_id, count(*)::INTEGER AS assistant_turns, count_if(NOT garbled)::INTEGER AS parseable, count_if(garbled)::INTEGER AS unparseable, count_if(NOT garbled AND silent)::INTEGER AS empty,
        count_if(NOT garbled AND silent AND NOT done)::INTEGER AS idle, count_if(NOT garbled AND done)::INTEGER AS complete, (2 * count_if(NOT garbled AND NOT silent))::INTEGER AS commands FROM turns GROUP BY conv_id""")
def turn_audit(spark, sf_dir):
    return shell.with_audit(trajectories(spark, sf_dir)).select("conv_id", "audit.*")


@query(f"""WITH {TURNS}, t AS (SELECT conv_id, count(*)::INTEGER AS assistant_turns, (2 * count_if(NOT garbled AND NOT silent))::INTEGER AS commands, count_if(garbled)::INTEGER AS unparseable_turns,
        sum(len(regexp_extract_all(content, '\\S+')))::INTEGER AS assistant_tokens, (5 + sum(len(regexp_extract_all(content, '\\S+')) + len(regexp_extract_all(screen, '\\S+'))))::INTEGER AS total_tokens FROM said GROUP BY conv_id)
    SELECT *, -assistant_tokens::DOUBLE AS score, assistant_turns::DOUBLE AS turns_more, -assistant_turns::DOUBLE AS turns_less, assistant_tokens::DOUBLE AS tokens_more, -assistant_tokens::DOUBLE AS tokens_less FROM t""")
def trajectory_length(spark, sf_dir):
    t = shell.trajectory_length(trajectories(spark, sf_dir)).drop("messages")
    views = {f"{what}_{way}": F.col("score_views")[f"assistant_{what}_{way}"] for what in ("turns", "tokens") for way in ("more", "less")}
    return t.withColumns(views).drop("score_views")


@query(f"""WITH {TURNS}, per AS (SELECT *, lead(screen) OVER w AS later, lead(1) OVER w IS NULL AS last_ FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY a)),
    seg AS (SELECT conv_id, a, 0 AS pos, 'format' AS kind, content AS input, CASE WHEN last_ THEN '' ELSE screen END AS output FROM per WHERE garbled
        UNION ALL SELECT conv_id, a, 0, 'command', line0, out0 FROM per WHERE NOT last_ AND NOT garbled AND NOT silent UNION ALL SELECT conv_id, a, 1, 'command', line1, out1 FROM per WHERE NOT last_ AND NOT garbled AND NOT silent AND NOT hidden),
    made AS (SELECT p.conv_id, count(*)::INTEGER AS episodes, coalesce((SELECT count_if(kind = 'format') FROM seg s WHERE s.conv_id = p.conv_id), 0)::INTEGER AS format_errors, coalesce((SELECT count_if(kind = 'command') FROM seg s WHERE s.conv_id = p.conv_id), 0) = 0 AS never_started FROM per p GROUP BY p.conv_id)
    SELECT m.conv_id AS trial, a::INTEGER AS episode, pos, kind, input, CASE WHEN kind = 'command' AND pos = (SELECT max(pos) FROM seg t WHERE t.conv_id = s.conv_id AND t.a = s.a) THEN output || chr(10) || CASE WHEN s.conv_id % 2 = 0 THEN 'root@box:/app# ' ELSE 'Apptainer> ' END ELSE output END AS output, episodes, format_errors, never_started
    FROM made m LEFT JOIN seg s ON m.conv_id = s.conv_id""")
def student_segments(spark, sf_dir):
    """Each episode's response with the screen that the one before left."""
    said = conversations(spark, sf_dir)
    before = said.select("conv_id", (F.col("a") + 1).alias("a"), F.col("screen").alias("prompt"))
    found = said.join(before, ["conv_id", "a"], "left").select(F.col("conv_id").alias("trial"), F.col("a").cast("int").alias("episode"), F.coalesce("prompt", F.lit(OPENING)).alias("prompt"), F.col("content").alias("response"))
    return shell.student_segments(found)
