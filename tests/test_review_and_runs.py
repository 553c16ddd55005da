import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import pixels
from tessella.operators import calls, review
from tessella.sources import files
from tessella.streaming import runs
from test_operators import RULE, TILES

CHOICES = ["Infiltrative glandular", "Solid", "Cystic", "Other"]


def state(spark, refs, visible=("p1", "p2", "z1"), candidate=CHOICES[0], clean=("p1", "p2"), kind="structure", relations=()):
    q = spark.createDataFrame([("q", kind, CHOICES, candidate, "strict", list(visible), refs, [CHOICES[1]])], "question_id string, question_type string, choices array<string>, candidate string, tier string, visible array<string>, refs array<string>, ranked array<string>")
    rows = [("q", t[0], t[6], t[0] in clean, t[5], *t[1:5]) for t in TILES]
    tiles = spark.createDataFrame(rows, "question_id string, patch_id string, text string, clean boolean, magnification int, x long, y long, w long, h long")
    concepts = spark.createDataFrame([(kind, f"c{i}", c) for i, c in enumerate(CHOICES)], "question_type string, concept string, display string")
    related = spark.createDataFrame(list(relations), "concept string, support string, needs_zoom boolean")
    solid = {"feature_groups": [["solid growth"]], "required_anywhere_groups": [0]}
    return review.evaluate(q, tiles, concepts, related, {"c0": RULE, "c1": solid, "c2": solid, "c3": solid}).first()


def test_unique_support_is_strict(spark):
    out = state(spark, ["p1", "p2"])
    assert out["citation_valid"] and out["evidence_found"] and out["candidate_evidence_found"] and out["ready"] and out["strict"]
    assert out["visible_passing"] == out["cited_passing"] == [CHOICES[0]] and out["support_score"] == 1.0
    assert out["differential"] == [CHOICES[1]] and out["missing"] == []


def test_one_citation_is_for_review(spark):
    out = state(spark, ["p1"])
    assert out["candidate_evidence_found"] and out["ready"] and not out["strict"]
    assert out["supporting"] == ["p1"] and "strict_contract_not_satisfied" in out["missing"]


def test_invisible_citations(spark):
    out = state(spark, ["invisible"])
    assert not (out["citation_valid"] or out["candidate_evidence_found"] or out["ready"] or out["strict"])
    assert out["supporting"] == [] and "valid_visible_citation_required" in out["missing"]
    out = state(spark, ["p1", "invisible"])
    assert out["evidence_found"] and not out["strict"] and out["invalid_refs"] == ["invisible"] and not out["supports_answer"]
    assert not state(spark, None)["citation_valid"]


def test_relations_and_zoom(spark):
    out = state(spark, ["p1", "p2"], kind="diagnosis", relations=[("c0", "c0", True)])
    assert out["visible_passing"] == [CHOICES[0]] and out["cited_passing"] == [] and "cited:zoom_confirmation_missing" in out["missing"]
    assert state(spark, ["p1", "p2", "z1"], kind="diagnosis", relations=[("c0", "c0", True)])["strict"]
    assert state(spark, ["p1", "p2"], kind="diagnosis")["missing"][-2] == "cited:no_frozen_visual_support_mapping"


def test_choices_need_concepts(spark):
    q = spark.createDataFrame([("q", "t", ["a", "b"])], "question_id string, question_type string, choices array<string>")
    one = spark.createDataFrame([("t", "c", "a")], "question_type string, concept string, display string")
    with pytest.raises(Exception, match="no concept"):
        review.option_concepts(q, one).collect()
    with pytest.raises(Exception, match="two concepts"):
        review.option_concepts(q.withColumn("choices", F.array(F.lit("a"))), one.union(one)).collect()
    with pytest.raises(ValueError):
        review.one_concept_each(one.union(one))


def test_missing_text_and_public_fields(spark):
    df = spark.createDataFrame([("", '["a", {"text": "b"}, ""]'), (None, " plain "), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(review.missing_text(F.col("a"), F.col("b"))).collect()] == ["a; b", "plain", "x"]
    kinds = "question_id string, candidate string, differential array<string>, valid_refs array<string>, missing array<string>, candidate_evidence_found boolean, ready boolean, strict boolean, supporting array<string>, opposing array<string>"
    out = review.public_fields(spark.createDataFrame([("q", "a", None, None, None, None, None, None, None, None), ("r", "a", [], ["p"], [], False, False, True, ["p"], [])], kinds)).collect()
    assert out[0]["missing_evidence"] == [review.NOT_EVALUATED] and out[1]["ready_for_pathologist_review"]


def test_calls_are_retried_and_bounded(spark):
    script = {"ok": [500, 200], "net": [None, None, None], "no": [401], "empty": [0, 200]}

    def send(text, seen={}):  # noqa: B006
        n = seen[text] = seen.get(text, 0) + 1
        status = script[text][n - 1]
        if status is None:
            raise ConnectionError
        return {"status": status or 200, "reply": "" if status == 0 else "yes", "prompt_tokens": 10}

    df = spark.createDataFrame([(k, k) for k in script] + [("long", "x" * 50)], "id string, request string").coalesce(1)
    got = {r["id"]: (r["status"], r["attempts"]) for r in calls.call(df, send, "id", "request", most_chars=40, sleep=lambda s: None).collect()}
    assert got == {"ok": (200, 2), "net": (None, 3), "no": (401, 1), "empty": (200, 2), "long": (413, 0)}


def test_cache(spark):
    key = calls.cache_key({"b": F.col("x"), "a": F.lit(1), "c": F.lit(None).cast("string")})
    df = spark.createDataFrame([("u",), ("v",)], "x string").withColumn("cache_key", key)
    import hashlib

    want = hashlib.sha256(b'{"a":1,"b":"u"}').hexdigest()
    assert df.first()["cache_key"] == want
    cache = spark.createDataFrame([(want, "said")], "cache_key string, reply string")
    assert {r["x"]: r["cached"] for r in calls.with_cache(df, cache).collect()} == {"u": "said", "v": None}
    assert [r["x"] for r in calls.new_entries(df, cache).collect()] == ["v"]


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, vector in (("a.npy", [1, 2]), ("b.npy", [3, 4])):
        held = io.BytesIO()
        np.save(held, np.array(vector, "float64"))
        (tmp_path / "s" / name).write_bytes(held.getvalue())
    assert {r["patch_id"]: list(r["features"]) for r in files.npy_features(spark, str(tmp_path / "s")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    (tmp_path / "s" / "t.jpeg").write_bytes(b"x")
    (tmp_path / "s" / "t.png").write_bytes(b"x")
    (tmp_path / "s" / "s.grandqc.png").write_bytes(b"x")
    tiles = spark.createDataFrame([("s", "t"), ("s", "none")], "slide_id string, patch_id string")
    found = {r["patch_id"]: r["path"] for r in files.resolve_images(tiles, files.listing(spark, str(tmp_path))).collect()}
    assert found["t"].endswith("t.jpeg") and found["none"] is None
    masks = files.resolve_masks(tiles.select("slide_id").distinct(), files.listing(spark, str(tmp_path)), ["/nowhere", str(tmp_path / "s")]).first()
    assert masks["mask"].endswith("s.grandqc.png")
    assert files.checksums(spark, str(tmp_path / "s" / "t.png")).first()["sha256"].startswith("2d711642")


def test_pixels(spark):
    df = spark.createDataFrame([(250, 250, 250), (255, 200, 200), (239, 239, 239), (255, 255, 241)], "r int, g int, b int")
    assert df.agg(pixels.white_fraction(F.col("r"), F.col("g"), F.col("b"))).first()[0] == 0.5
    assert df.select(pixels.over_white(F.lit(100), F.lit(0))).first()[0] == 255


def test_runs(spark, tmp_path):
    manifest = spark.createDataFrame([("m", 1)], "model string, seed int")
    runs.write_or_verify(manifest, str(tmp_path / "m"))
    runs.write_or_verify(manifest, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        runs.write_or_verify(manifest.withColumn("seed", F.lit(2)), str(tmp_path / "m"))
    events = spark.createDataFrame([("t", 2, "b", "{}"), ("t", 1, "a", "{}")], "trace_id string, event_id int, phase string, payload string")
    runs.finalize(events, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["document"].index('"a"') < 60
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.finalize(events, str(tmp_path / "t"))
    blind = spark.createDataFrame([("t", 1, "a", '{"x": {"ground_truth": 1}}')], events.schema)
    with pytest.raises(Exception, match="holds an answer"):
        runs.finalize(blind, str(tmp_path / "u"))
    results = spark.createDataFrame([("q", "answered")], "question_id string, ending string")
    spent = calls.within_budget(spark.createDataFrame([(1, 1000, 400, 600, 100, 200)], "id long, prompt_tokens long, hit_tokens long, miss_tokens long, completion_tokens long, status int"), [], ["id"], 0.0001)
    assert not spent.first()["may_go_on"] and runs.summary(results, spent).first()["cost"] == pytest.approx(0.000808)
    assert runs.resumable(results, results.where("false"), ["question_id"]).count() == 1
    runs.write_results(results, str(tmp_path / "r"))
    assert [r["ending"] for r in spark.read.json(str(tmp_path / "r")).collect()] == ["answered"]
    assert runs.consistent(results, results.withColumn("ending", F.lit("abstained")), ["question_id"], ["ending"]).count() == 1 - runs.consistent(results, results, ["question_id"], ["ending"]).count()
    runs.write_cases(spark.createDataFrame([("s", "Q?", "a")], "long_id string, question string, pred_answer string"), str(tmp_path / "cases"))
    assert set(runs.CASE) <= set(spark.read.json(str(tmp_path / "cases")).columns)


def test_budget_gates_calls(spark):
    df = spark.createDataFrame([(i, "x") for i in range(200)], "id long, request string")
    send = lambda t: {"status": 200, "reply": "yes", "prompt_tokens": 1_000_000}
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = calls.call_within(df, send, "id", "request", budget=50.0, sleep=lambda s: None).collect()
    sent = sum(r["status"] == 200 for r in out)
    assert len(out) == 200 and 50 <= sent <= 110 and all(r["attempts"] == 0 for r in out if r["status"] == 402)
    assert all(r["status"] == 402 for r in calls.call_within(df, send, "id", "request", budget=1.0, spent=2.0).collect())

    def shapeless(text):
        raise ValueError(text)

    assert calls.call(df.limit(1), shapeless, "id", "request", sleep=lambda s: None).first()["attempts"] == 3
    with pytest.raises(ValueError):
        calls.require_one_model(spark.createDataFrame([(1, "a"), (1, "b")], "id long, model string"), ["id"], "model")
