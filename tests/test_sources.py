"""Readers, sinks and streams over small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trailweave.operators import tokens
from trailweave.sources import readers, sinks
from trailweave.streaming import incremental


def put(path, *objects, lines=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, objects)) if lines else json.dumps(list(objects)))
    return str(path)


def test_record_lists_of_both_forms(spark, tmp_path):
    legacy = [{"metadata": {"task": t}, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": a}, {"from": "tool", "value": "x"}]} for t, a in (("t1", "old"), ("t2", "a2"), ("t1", "new"))]
    got = {r.task: r.messages for r in readers.record_list(spark, put(tmp_path / "a.json", *legacy), "A", "metadata.task").collect()}
    assert [tuple(m) for m in got["t1"]] == [("user", "q"), ("assistant", "new")]
    with pytest.raises(Exception, match="duplicate task"):
        readers.record_list(spark, str(tmp_path / "a.json"), "A", "metadata.task", strict=True).collect()
    modern = [{"task_id": "t1", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "new"}]}]
    new = readers.record_list(spark, put(tmp_path / "b.json", *modern), "A", "task_id").first()
    assert new.messages == got["t1"]


def test_manifest(spark, tmp_path):
    path = put(tmp_path / "m.jsonl", {"kind": "task_manifest_header", "teachers": ["A"]}, {"task_id": "t", "task_dir": "d", "teacher_record_index": {"A": 3}}, lines=True)
    head, body = readers.manifest(spark, path)
    assert head["teachers"] == ["A"]
    assert body.first().teacher_record_index == {"A": 3}
    with pytest.raises(ValueError, match="no other"):
        readers.manifest(spark, path, "other")


def test_score_tables(spark, tmp_path):
    path = put(tmp_path / "s.jsonl", {"task_id": "t1", "score": 2.0, "assistant_tokens_scored": 7}, {"task_id": "t2", "rsr_b": 3.0, "num_tokens_masked": 8}, lines=True)
    assert sorted((r.rsr_b, r.num_tokens_masked) for r in readers.score_table(spark, path).collect()) == [(2.0, 7), (3.0, 8)]
    spark.createDataFrame([("x", "t", float("nan"), 1)], "trajectory_id string, task_id string, rsr_b double, num_tokens_masked long").write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(Exception, match="not finite"):
        readers.score_table(spark, str(tmp_path / "s.parquet")).collect()


def test_token_audit_and_sidecars(spark, tmp_path):
    schema = "trajectory_id string, task_id string, sft_total_tokens long, sft_trainable_tokens long, sft_turns_truncated long"
    spark.createDataFrame([("x", "t", 10, 11, 0)], schema).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(Exception, match="inconsistent"):
        readers.token_audit(spark, str(tmp_path / "t.parquet")).collect()
    same = spark.createDataFrame([("m", "r"), ("m", "r")], "model string, revision string")
    assert tuple(readers.agreed(same, ["model", "revision"]).first()) == ("m", "r")
    with pytest.raises(Exception, match="provenance differs"):
        readers.agreed(spark.createDataFrame([("m", "r"), ("m", "s")], "model string, revision string"), ["model", "revision"]).collect()


def test_trials_and_episodes(spark, tmp_path):
    for name, body in (("r/t-1/result.json", {"task_name": "t", "exception_info": {"exception_type": "E"}}), ("r/t-2/result.json", {"task_name": "t", "verifier_result": {"rewards": {"reward": 1.0}}}), ("r/x/result.json", {"other": 1})):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "r/bad").mkdir()
    (tmp_path / "r/bad/result.json").write_text("{")
    best = readers.best_trials(readers.trials(spark, str(tmp_path / "r"))).collect()
    assert [(r.task_name, r.reward) for r in best] == [("t", 1.0)]
    for i in (2, 10):
        (tmp_path / f"e/trial/episode-{i}").mkdir(parents=True)
        (tmp_path / f"e/trial/episode-{i}/prompt.txt").write_text(f"p{i}")
    got = [(r.trial, r.episode, r.text) for r in readers.episodes(spark, str(tmp_path / "e")).orderBy("episode").collect()]
    assert got == [("trial", 2, "p2"), ("trial", 10, "p10")]
    (tmp_path / "evals/a/b").mkdir(parents=True)
    (tmp_path / "evals/a/b/instruction.md").write_text("do")
    assert tuple(readers.instructions(spark, str(tmp_path / "evals")).first()) == ("a/b", "do")


def test_files_match_teachers_once(spark):
    files = spark.createDataFrame([("GLM-4.6.json",), ("opus_4.json",)], "file string")
    teachers = spark.createDataFrame([("glm 4.6",), ("Claude Opus 4",)], "teacher string")
    assert {r.teacher: r.file for r in readers.match_files(files, teachers).collect()} == {"glm 4.6": "GLM-4.6.json", "Claude Opus 4": "opus_4.json"}
    with pytest.raises(Exception, match="matches no file"):
        readers.match_files(files, spark.createDataFrame([("other",)], "teacher string")).collect()
    assert readers.id_field(["task_id", "metadata.task_id"], ["task_id"]) == "metadata.task_id"


def test_feeds_works_and_cached_pages(spark):
    xml = "<feed><entry><id>u1</id><title>A\n b</title><summary>s</summary><published>2024-05-01</published></entry></feed>"
    assert [tuple(r) for r in readers.atom_entries(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("u1", "A b", "s", 2024)]
    body = json.dumps({"results": [{"id": "w", "title": "T", "publication_year": 2020, "abstract_inverted_index": {"a": [0]}}]})
    assert readers.works(spark.createDataFrame([(body,)], "body string")).first().inverted == {"a": [0]}
    cache = spark.createDataFrame([("u1", 200, "x"), ("u2", 404, "y")], "url string, status int, body string")
    wanted = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string")
    assert [r.url for r in readers.cached_pages(cache, wanted).collect()] == ["u1"]


def test_arms_reports_and_csv(spark, tmp_path):
    arm = spark.createDataFrame([("t2", "B"), ("t1", "A")], "task string, teacher string")
    got = sinks.write_arm(arm, str(tmp_path / "arm"))
    text = '{"task":"t1","teacher":"A"}\n{"task":"t2","teacher":"B"}\n'
    assert got == {"rows": 2, "sha256": hashlib.sha256(text.encode()).hexdigest()}
    assert next((tmp_path / "arm").glob("part-*")).read_text() == text
    sinks.write_csv(arm, str(tmp_path / "csv"), ["task", "gone", "teacher"], "task")
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[:2] == ["task,gone,teacher", "t1,,A"]
    assert sinks.markdown(arm.orderBy("task"), ["task", "teacher"]).splitlines()[2] == "| t1 | A |"
    assert sinks.report({"b": 1, "a": 2}).index('"a"') < sinks.report({"b": 1, "a": 2}).index('"b"')
    assert sinks.id_digest(["a", "b"], True) != sinks.id_digest(["a", "b"], False) == hashlib.sha256(b"a\nb").hexdigest()


def test_artifacts_differ_by_scrubbed_text(spark):
    a = spark.createDataFrame([("f", b"pid 12"), ("g", b"\x00a"), ("h", b"x")], "path string, content binary")
    b = spark.createDataFrame([("f", b"pid 99"), ("g", b"\x00b")], "path string, content binary")
    got = sinks.artifact_diff(sinks.artifact_hashes(a), sinks.artifact_hashes(b))
    assert sorted(r.path for r in got.collect()) == ["g", "h"]


def test_a_stream_adds_each_key_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([("a", 1), ("a", 2), ("b", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(rows, "key string, v int").coalesce(1).write.mode("append").json(src)
        incremental.once_per_key(incremental.follow(spark, src, "key string, v int"), ["key"], out, ck).awaitTermination()
    got = sorted(r.key for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c"]


def test_windowed_rates_over_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'error' event_type union all select timestamp'2024-01-01 00:20:00', 'view' union all select timestamp'2024-01-01 05:00:00', 'view'").coalesce(1).write.json(src)
    stream = incremental.windowed_rates(incremental.follow(spark, src, "ts timestamp, event_type string"))
    stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.n, r.failed) for r in spark.table("rates").orderBy("window").collect()] == [(2, 1), (1, 0)]


def test_token_metrics(spark):
    rows = [("A", 1, 1, 0, -1.0, 5), ("A", 1, 1, 1, -2.0, 500), ("A", 1, 1, 2, -3.0, 1), ("A", 1, 2, 0, -4.0, 1), ("A", 1, 2, 1, -5.0, 1)]
    t = spark.createDataFrame(rows, "teacher string, task int, turn int, pos int, logprob double, rank int")
    assert tokens.global_nll(t).first().score == -3.0
    assert tokens.local_nll(t).first().score == -3.25
    drop = tokens.step_drop(t).first()
    assert (drop["drop"], drop.heads, drop.ratio) == (-3.0, 4, 0.8)
    assert tokens.rank_surprisal(t).first().score == 108 / 15
    assert tokens.step_drop(t.where("pos < 2")).first()["drop"] == -16.0
    ctx = spark.createDataFrame([([0, 1, 2, 3, 4, 5, 6, 7],)], "m array<int>").select(tokens.context(F.col("m"), F.lit(7), 1).alias("c")).first().c
    assert ctx == [0, 5, 6]
