"""The selection pool, its reports, profiles and the metric registry on authored rows."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.functions import shell
from trailweave.operators import literature, pool, profiles, scores, tokens
from trailweave.plans import registry
from trailweave.sources import readers

SCHEMA = "teacher string, task string, trajectory_id string"


@pytest.fixture
def inputs(spark):
    keys = [("A", "t1"), ("B", "t1"), ("A", "t2"), ("B", "t2"), ("A", "t3")]
    t = spark.createDataFrame([(a, b, f"{a}::{b}") for a, b in keys], SCHEMA)
    s = spark.createDataFrame([(a, b, f"{a}::{b}", float(i), None if a == "A" else 0.0, 1.0, 1.0) for i, (a, b) in enumerate(keys)], f"{SCHEMA}, rsr double, tor double, nll double, rank double")
    n = spark.createDataFrame([(a, b, f"{a}::{b}", 10, int((a, b) == ("B", "t2"))) for a, b in keys], f"{SCHEMA}, tokens int, sft_turns_truncated int")
    return t, s, n


def test_a_candidate_needs_every_input_of_every_teacher(inputs):
    t, s, n = inputs
    assert sorted((r.teacher, r.task) for r in pool.candidates(t, s, n).collect()) == [("A", "t1"), ("B", "t1")]
    assert sorted({r.task for r in pool.candidates(t, s).collect()}) == ["t1", "t2"]


def test_an_id_that_differs_fails(inputs):
    t, s, _ = inputs
    with pytest.raises(Exception, match="trajectory ids differ"):
        pool.candidates(t, s.withColumn("trajectory_id", F.lit("x"))).collect()


def test_arms_and_their_overlap(inputs):
    t, s, _ = inputs
    arms = pool.arms(pool.candidates(t, s))
    got = {(r.arm, r.task): r.teacher for r in arms.collect()}
    assert [got[a, "t1"] for a in ("rsr_low", "rsr_high", "tor_high")] == ["A", "B", "B"]  # a defined 0 beats an undefined share
    assert got["nll_low", "t1"] in "AB"
    assert {r.arm: r.shared for r in pool.arm_overlap(arms, "rsr_low").collect()}["rsr_high"] == 0
    assert sorted(r.task for r in pool.global_arm(pool.candidates(t, s), "B").collect()) == ["t1", "t2"]


def test_records_at_manifest_positions(spark):
    m = spark.createDataFrame([("t1", {"A": 0, "B": 1})], "task string, teacher_record_index map<string,int>")
    records = spark.createDataFrame([("A", 0, "t1", "x"), ("B", 0, "t0", "y"), ("B", 1, "t1", "z")], "teacher string, pos int, own_task string, v string")
    assert sorted(r.v for r in pool.at_positions(m, records).collect()) == ["x", "z"]
    with pytest.raises(Exception, match="another task's record"):
        pool.at_positions(m, records.withColumn("own_task", F.lit("t9"))).collect()


def test_subset_reports(spark):
    rows = spark.createDataFrame([("A", "t1", " hard ", "q"), ("B", "t1", None, "q"), ("A", "t2", "", "q"), ("B", "t2", None, "r")], "teacher string, task string, difficulty string, prompt string")
    assert {r.difficulty: r.tasks for r in pool.difficulty_counts(rows).collect()} == {"hard": 1, None: 1}
    assert {(r.teacher, r.field): r.missing for r in pool.missing_by_teacher(rows, "difficulty").collect()} == {("A", "difficulty"): 1, ("B", "difficulty"): 2}
    assert tuple(pool.alignment(rows, "prompt").first()) == ("prompt", 2, 1)
    with pytest.raises(Exception, match="difficulty differs"):
        pool.difficulty_counts(rows.withColumn("difficulty", F.col("teacher"))).collect()


def test_fixed_directions_and_order(spark):
    assert scores.direction_of("rsr", "higher_better") == "lower_better"
    assert scores.direction_of("tor") == "higher_better"
    with pytest.raises(ValueError, match="unknown direction"):
        scores.direction_of("tor", "unknown")
    truth = scores.truth_table(spark, [["A"], ["B", "C"]])
    tied = scores.predicted_order(spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0)], "teacher string, score double"), truth).first()
    assert (tied.predicted, tied.top1_correct, tied.all_tied) == ("A > B > C", False, True)
    cache = spark.createDataFrame([(("1",),)], "meta struct<skip_tokens:string>")
    assert scores.stale(cache, "skip_tokens", "2")
    assert not scores.stale(cache.limit(0), "skip_tokens", "2")


def test_profiles_keep_format_apart(spark):
    schema = "teacher string, task string, kind string, failure boolean, category string, subcategory string, recovered boolean, reward double, valid_pair boolean, parsed boolean"
    rows = [("A", "t", "command", True, "c", "x", True, 1.0, True, True), ("A", "t", "command", True, "c", "y", False, 1.0, False, True), ("A", "t", "command", False, None, None, None, None, None, None), ("A", "t", "format", True, None, None, True, 1.0, None, None)]
    s = spark.createDataFrame(rows, schema)
    e = profiles.command_errors(s).first()
    assert (e.commands, e.failed, e.invalid_pairs, e.score) == (3, 2, 1, -2 / 3)
    got = {(r.view, r.key): r.q for r in profiles.student_profiles(s).collect()}
    assert got["qS_all_episodes", "c :: x"] == pytest.approx(1 / 3)
    assert got["qS_all_episodes_cat", "c"] == pytest.approx(2 / 3)
    assert ("qS_unrecovered", "c :: x") not in got
    assert not any(v == "qS_failed_trajectories" for v, _ in got)  # the lost command did not fail
    c = {r.key: (r.e_t, r.r_t) for r in profiles.components(s).collect()}
    assert c["c"] == (0.5, 0.5)
    assert c[profiles.FORMAT] == (0.25, 1.0)
    views = {r.view: r.score for r in profiles.weighted_views(s, profiles.student_profiles(s)).collect()}
    assert views["qS_all_episodes"] == pytest.approx(1 / 3 * 0.25)
    assert views["control_total_error_rate"] == 0.75


def authored(spark):
    """A few small trajectories."""
    say = lambda role, content: (role, content)
    turn = lambda *keys: '{"analysis":"","plan":"","commands":[' + ",".join('{"keystrokes":"%s\\n","duration":1}' % k for k in keys) + "]}"  # noqa: E731, UP031
    p = "root@box:/app# "
    rows = [
        ("A", "t1", [say("user", f"Task\n{p}"), say("assistant", turn("cat a.py", "sed -i s/x/y/ a.py")), say("user", f"{p}cat a.py\nx\n{p}sed -i s/x/y/ a.py\n{p}"), say("assistant", turn("pytest")), say("user", f"{p}pytest\n1 failed\n{p}"), say("assistant", turn("pytest -q")), say("user", f"{p}pytest -q\nERROR\n{p}")]),
        ("B", "t1", [say("user", f"Task\n{p}"), say("assistant", "thinking</think>" + turn("touch new.txt")), say("user", f"{p}touch new.txt\n{p}"), say("assistant", "no json"), say("user", p)]),
        ("B", "t2", [say("user", f"Task\n{p}"), say("assistant", turn("ls src", "echo hi > src/out")), say("user", f"{p}ls src\nb.py\n{p}echo hi > src/out\n{p}")]),
    ]
    return spark.createDataFrame(rows, "teacher string, task string, messages array<struct<role:string,content:string>>")


def test_student_segments(spark):
    p, turn = "root@box:/app# ", '{"commands":[{"keystrokes":"%s\\n"}]}'
    rows = [("a", 1, p, turn % "ls"), ("a", 2, f"{p}ls\nb.py\n", "no json"), ("a", 3, "Parsing error: send JSON", turn % "cat b.py"), ("a", 10, f"{p}cat b.py\nx\n", None), ("b", 1, p, "{")]
    got = shell.student_segments(spark.createDataFrame(rows, "trial string, episode int, prompt string, response string")).collect()
    assert sorted(((r.trial, r.episode, r.kind, r.output[:7]) for r in got), key=repr) == [("a", 0, "command", "b.py"), ("a", 1, "format", "Parsing"), ("a", 2, "command", "x"), ("b", 0, "format", "")]
    assert {r.trial: (r.episodes, r.format_errors, r.never_started) for r in got} == {"a": (3, 1, False), "b": (1, 1, True)}


def test_turn_audit_and_length(spark):
    ms = [{"role": "assistant", "content": c} for c in ('{"commands": []}', '{"commands": [], "task_complete": true}', "x y", '{"commands": [{"keystrokes": "ls\\n"}]}')]
    assert shell.audit(ms) == {"assistant_turns": 4, "parseable": 3, "unparseable": 1, "empty": 2, "idle": 1, "complete": 1, "commands": 1}
    df = spark.createDataFrame([("A", "t", [("user", "one two"), ("assistant", "x y z")])], "teacher string, task string, messages array<struct<role:string,content:string>>")
    got = shell.trajectory_length(df).first()
    assert (got.assistant_tokens, got.total_tokens, got.score) == (3, 5, -3.0)
    assert got.score_views == {"assistant_turns_more": 1.0, "assistant_turns_less": -1.0, "assistant_tokens_more": 3.0, "assistant_tokens_less": -3.0}


@pytest.mark.parametrize(
    ("reward", "exception", "want"),
    [(1.0, None, "success"), (0.0, None, "verifier failure"), (None, "", "verifier failure"), (1.0, "AgentTimeoutError", "task timeout"), (None, "RateLimitError", "model/API failure"), (None, "OSError", "environment failure")],
)
def test_terminations(spark, reward, exception, want):
    df = spark.createDataFrame([(reward, exception)], "r double, e string")
    assert df.select(shell.termination(F.col("r"), F.col("e")).alias("t")).first().t == want


def test_artifacts_and_links(spark):
    schema = "paper string, id string, kind string, role string, judged_role string, exists boolean, accessible boolean, separable string, mentioned boolean"
    rows = [
        ("p1", "o/d", "datasets", "trajectories", None, True, True, "yes", False), ("p2", "o/e", "datasets", "trajectories", "tasks", True, True, None, False), ("p3", "o/f", "datasets", None, "trajectories", True, True, "no", False),
        ("p4", "o/g", "github", None, None, True, True, None, False), ("p5", "o/h", "datasets", "trajectories", None, False, False, None, True),
    ]
    got = {r.paper: (r.verified, r.ids, r.separable) for r in literature.artifact_status(spark.createDataFrame(rows, schema), "trajectories").collect()}
    assert got == {"p1": (True, ["o/d"], "yes"), "p2": (False, [], None), "p3": (True, ["o/f"], "no"), "p4": (None, [], None), "p5": (False, [], None)}
    teachers = spark.createDataFrame([("p", "T-Gamma"), ("p", "Claude Opus 4.6"), ("p", "Other-X")], "paper string, teacher string")
    sets = spark.createDataFrame([("p", "o/gamma-runs"), ("p", "o/gamma-opus-mix"), ("p", "o/opus46")], "paper string, dataset string")
    assert {r.teacher: r.dataset for r in literature.dedicated_links(teachers, sets).collect()} == {"T-Gamma": "o/gamma-runs", "Claude Opus 4.6": "o/opus46", "Other-X": None}


def test_links_join_by_token_and_agree_with_brute_force(spark):
    r = random.Random(5)
    name = lambda n: "".join(r.choice("ab1") for _ in range(n))
    teachers = [(p, "-".join(name(r.randint(2, 4)) for _ in range(r.randint(1, 3)))) for p in "pq" for _ in range(8)] + [("p", "no"), (None, "abc")]
    sets = [(p, f"o/{name(r.randint(1, 6))}-{name(r.randint(0, 3))}") for p in "pq" for _ in range(150)] + [("p", None), (None, "o/abc")]
    tokens = {t: {x for x in t.split("-") if len(x) >= 3 and re.search("[a-z]", x)} for _, t in teachers}
    want = []
    for p, t in teachers:
        others = set().union(*(tokens[x] for q, x in teachers if q == p)) - tokens[t]
        own = [s for q, s in sets if s and q == p and p and any(k in s[2:].replace("-", "") for k in tokens[t]) and not any(k in s[2:].replace("-", "") for k in others)]
        want.append((p, t, min(own, default=None)))
    made = literature.dedicated_links(spark.createDataFrame(teachers, "paper string, teacher string"), spark.createDataFrame(sets, "paper string, dataset string"))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
    assert any(x for _, _, x in want)
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins
    assert all(any(k in x for k in ("token#", "begin#", "teacher#")) for x in joins), joins  # none by paper alone


def test_signals_queue_and_export(spark):
    df = spark.createDataFrame([("trajectories from GPT and Claude; Qwen SFT",), ("nothing",), (None,), ("ablation with GPT: training training training",)], "t string")
    assert [r.v for r in df.select(literature.scan_verdict(F.col("t")).alias("v")).collect()] == ["pass", "fail_scan", "fail_retrieval", "pass"]
    rec = spark.createDataFrame([("r1", "gold", [], {"b": "y", "a": "x"}, 2020), ("r2", "gold", ["f"], {}, None), ("r3", "needs_review", None, {}, 2010)], "id string, status string, disagreements array<string>, evidence map<string,string>, year int")
    assert sorted(r.id for r in literature.review_queue(rec).collect()) == ["r2", "r3"]
    assert tuple(literature.flat_record(rec, ["id", "gone", "status"]).first()) == ("r1", None, "gold", "a: x | b: y")
    assert sorted(r.id for r in literature.recent(rec, 2015).collect()) == ["r1", "r2"]


def test_api_payloads_become_candidates(spark):
    def put(body):
        return spark.createDataFrame([("q", json.dumps(body))], "source string, body string")

    cards = readers.dataset_cards(put([{"id": "o/d", "tags": ["x", "arxiv:2401.01234"]}, {"id": "o/e", "tags": []}])).collect()
    assert [(r.key, r.tags) for r in cards] == [("arxiv:2401.01234", ["hf_dataset:o/d"])]
    repos = readers.code_repositories(put({"items": [{"full_name": "o/r", "description": "see arXiv 2401.01234"}, {"full_name": "o/s", "description": "2401.01234"}]})).collect()
    assert [r.tags for r in repos] == [["github_repo:o/r"]]
    cited = readers.citations(put({"data": [{"citingPaper": {"title": "T", "externalIds": {"ArXiv": "2401.00001"}}}, {"citedPaper": {"url": "http://x"}}, {"citedPaper": {"title": "none"}}]})).collect()
    assert sorted(r.key for r in cited) == ["arxiv:2401.00001", "url:http://x"]


def test_spans_and_projection(spark):
    assert tokens.response_spans([1, 9, 9, 5, 6, 7, 8, 9, 9, 8, 9, 9, 3], [9, 9], [8]) == [(3, 6), (12, 13)]
    assert tokens.response_spans([9, 9, 0, 5], [9, 9], [8], frozenset([0])) == [(3, 4)]
    assert tokens.response_spans([1, 2], [], [8]) == []
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 4.0, 6.0, 8.0]), (3, [])], "k int, v array<float>")
    got = {r.k: r.projected for r in tokens.projected(v, "k", "v", 8, 1).collect()}
    assert got[2] == pytest.approx([2 * x for x in got[1]])
    assert all(abs(2 * x) in (0, 2, 4, 6, 8, 10) for x in got[1])
    assert got[3] is None


def test_registry(spark):
    t = {"trajectories": authored(spark), "bench": spark.createDataFrame([("A", 1.5), ("B", 2.5)], "teacher string, score double")}
    assert {(r.teacher, r.task): r.score for r in registry.run("teacher_bench", t).collect()} == {("A", "t1"): 1.5, ("B", "t1"): 2.5, ("B", "t2"): 2.5}
    for name in ("traj_length", "tor", "egs_loop", "error_retry"):
        assert registry.run(name, t).count() == 3
    with pytest.raises(Exception, match="no sourced score"):
        registry.run("teacher_bench", t | {"bench": t["bench"].limit(1)}).collect()
    with pytest.raises(NotImplementedError):
        registry.run("lark", t)
    with pytest.raises(KeyError):
        registry.run("unheard of", t)
    rows = registry.with_missing(registry.run("tor", t), t["trajectories"], t["trajectories"])
    assert sorted((r.teacher, r.task) for r in rows.where("missing").collect()) == [("A", "t2")]
    v = spark.createDataFrame([("A", "t", [1.0, 2.0]), ("A", "u", [3.0])], "teacher string, task string, vector array<double>")
    assert registry.by_teacher(v, lambda s: sum(len(x) for x in s)).first().score == 3.0
    assert registry.run("grace", {"vectors": v}).where("score is null").count() == 2
