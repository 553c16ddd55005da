import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import guards, readers
from tessella.streaming import trace


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_question_dialects(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps([{"Id": "TCGA-1234567", "Question": "Q?", "Choice": ["x", "y"], "Answer": "x"}]))
    got = readers.questions(spark, a, "wsi_vqa").first()
    assert (got["short_id"], got["choices"]) == ("TCGA-1234567", ["x", "y"])
    slides = spark.createDataFrame([("TCGA-1234567-DX1.svs",), ("TCGA-1234567-DX2",)], "name string")
    assert [r["slide_id"] for r in readers.questions(spark, a, "wsi_vqa", slides).collect()] == ["TCGA-1234567-DX1.svs"]
    b = put(tmp_path / "b.csv", "Slide,Question,A,B,C,D,Answer\ns1,Q?,w,x,y,z, b\n")
    assert readers.questions(spark, b, "slidebench_vqa").first()["answer"] == "x"
    c = put(tmp_path / "c.json", json.dumps({"questions": [{"slide_id": "s_1", "question_id": "q", "question": "Q?", "choices": ["x"], "answer": "x"}]}))
    got = readers.questions(spark, c, "local_wsi").first()
    assert (got["case_id"], got["evidence_tier"], got["choices"]) == ("s", "strict", ["x"])
    d = put(tmp_path / "d.csv", "slide_id,question,choices\ns_1,Q?,x | y\n")
    assert readers.questions(spark, d, "local_wsi").first()["choices"] == ["x", "y"]
    with pytest.raises(ValueError):
        readers.questions(spark, a, "other")


def test_manifests(spark, tmp_path):
    row = {"slide_id": "s", "patch_id": "p", "x_level0": 1, "y_level0": 2, "width_level0": 3, "height_level0": 4, "mpp_x": 0.5, "mpp_y": 0.5}
    tiles = put(tmp_path / "t.jsonl", "\n".join([json.dumps(row), "", json.dumps(row | {"patch_id": "o", "selected": False})]))
    assert [(r["patch_id"], r["magnification"]) for r in readers.tiles(spark, tiles).collect()] == [("p", 5)]
    twice = put(tmp_path / "u.jsonl", json.dumps(row) + "\n" + json.dumps(row))
    with pytest.raises(ValueError):
        readers.tiles(spark, twice)
    d = put(tmp_path / "d.json", json.dumps({"s": {"p": "text", "o": "more"}}))
    assert sorted(tuple(r) for r in readers.descriptions(spark, d).collect()) == [("s", "o", "more"), ("s", "p", "text")]
    env = put(tmp_path / "e.env", "# note\nexport A='x y'\n\nB=\"z\"\nC=1\n")
    assert sorted(tuple(r) for r in readers.settings(spark, env).collect()) == [("A", "x y"), ("B", "z"), ("C", "1")]
    with pytest.raises(Exception, match="not a setting"):
        readers.settings(spark, put(tmp_path / "f.env", "nothing\n")).collect()


def test_policy(spark, tmp_path):
    rule = {"feature_groups": [["a"]], "minimum_feature_groups_per_patch": 1, "minimum_clean_evidence_patches": 1, "required_anywhere_groups": [0]}
    contracts = {"schema_version": "c1", "term_matcher_version": "t1", "visual_concept_contracts": {"x": rule}, "target_support_contracts": {"y": {"visual_support_concept": "x", "requires_zoom_confirmation": True}}}
    types = {k: {"option_concepts": ["x", "y"]} for k in readers.QUESTION_TYPES}
    ontology = {"schema_version": "o1", "question_types": types, "concepts": {"x": {"display_zh": "", "label": "X"}, "y": {}}}

    def load(**change):
        held = json.loads(json.dumps(contracts))
        held["visual_concept_contracts"]["x"].update(change)
        return readers.policy(put(tmp_path / "c.json", json.dumps(held)), put(tmp_path / "o.json", json.dumps(ontology)), {"contracts": "c1", "ontology": "o1", "term_matcher_version": "t1"})

    held, shown = load()
    assert held == contracts
    assert sorted(tuple(r) for r in readers.concepts(spark, shown).collect()) == sorted((k, "x", "X") for k in readers.QUESTION_TYPES)
    assert [tuple(r) for r in readers.relations(spark, held).collect()] == [("y", "x", True)]
    for bad in ({"required_anywhere_groups": [3]}, {"feature_groups": [[]]}, {"feature_groups": []}, {"minimum_feature_groups_per_patch": 2}, {"minimum_clean_evidence_patches": 0}):
        with pytest.raises(ValueError):
            load(**bad)
    with pytest.raises(ValueError):
        readers.policy(str(tmp_path / "c.json"), str(tmp_path / "o.json"), {"ontology": "o2"})
    ontology["question_types"].pop("diagnosis")
    with pytest.raises(ValueError):
        load()


def test_features_are_finite(spark, tmp_path):
    for name, x in (("good", 1.0), ("nan", float("nan")), ("inf", float("-inf"))):
        spark.createDataFrame([("s", "p", [0.0, x])], "slide_id string, patch_id string, features array<double>").write.parquet(str(tmp_path / name))
    assert readers.features(spark, str(tmp_path / "good")).count() == 1
    for name in ("nan", "inf"):
        with pytest.raises(Exception, match="finite"):
            readers.features(spark, str(tmp_path / name)).collect()
    assert guards.frozen("canvas", 784) == 784
    with pytest.raises(ValueError):
        guards.frozen("canvas", 512)


def test_forbidden_keys(spark):
    df = spark.createDataFrame([('{"a": {"ground_truth": 1}}',), ('{"a": "ground_truth"}',), ('{"结构化金标": 1}',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(guards.forbidden_keys("t", trace.BLIND)).collect()] == [["ground_truth"], [], ["结构化金标"], [], []]


def test_call_stream_equals_table(spark, tmp_path):
    rows = [("r", "t", 1, "2024-01-01 00:00:00", "c1", "before"), ("r", "t", 2, "2024-01-01 00:00:02.5", "c1", "after"), ("r", "t", 3, "2024-01-01 00:00:03", "c2", "before"), ("r", "t", 4, "2024-01-02 00:00:03", "c3", "before")]
    df = spark.createDataFrame(rows, "run_id string, trace_id string, event_id int, at string, call_id string, phase string")
    events = df.withColumn("ts", F.to_timestamp("at")).drop("at")
    table = {r["call_id"]: (r["latency_ms"], r["finished"]) for r in trace.pair_calls(events, ["trace_id"]).collect()}
    assert table == {"c1": (2500, True), "c2": (None, False), "c3": (None, False)}
    trace.append(events, str(tmp_path / "events"))
    calls = trace.stream_calls(trace.read_events(spark, str(tmp_path / "events")))
    trace.write_stream(calls, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    done = {r["call_id"]: r["latency_ms"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done["c1"] == 2500
