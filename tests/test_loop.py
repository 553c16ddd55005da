"""The decision loop where it stops, what a contract makes of answers, and what is described."""

import json
import math
import random
import shutil
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import unit
from tessella.operators import loop, retrieval
from tessella.operators.asking import Asking
from tessella.operators.calls import Meter, call_in_waves

RULE = {"feature_groups": [["gland"], ["infiltrat"]], "minimum_feature_groups_per_patch": 1, "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0, 1]}


def reply(kind, enough=False, refs=(), **action):
    return json.dumps({"provisional_recommendation": "glandular", "evidence_sufficient": enough, "evidence_refs": list(refs), "next_action": {"type": kind, **action}})


def world(spark, replies, texts=("Infiltrative glands.", "Infiltrative glands.", "Nothing.", "")):
    """One slide of 40 tiles, t00 the nearest to the query and so on."""
    tiles = [("s", f"t{i:02d}", 1000 * i, 0, 1000, 1000, [1.0, -i / 10], texts[i] if i < len(texts) else "Stroma.", True) for i in range(40)]
    tiles = spark.createDataFrame(tiles, "slide_id string, patch_id string, x long, y long, w long, h long, vector array<double>, text string, clean boolean")
    seen = [("s", f"x{1000 * i + 500 * c}_y{500 * r}_w500_h500_m10", t, 0.1, {"right": 0}, [1.0, float(r + c)], "Closer.", 1000 * i + 500 * c, 500 * r, 500, 500, True) for i in range(40) for r in (0, 1) for c, t in ((0, 0.5), (1, 0.5))]
    seen = spark.createDataFrame(seen, "slide_id string, patch_id string, tissue double, white double, padding map<string,int>, vector array<double>, text string, x long, y long, w long, h long, clean boolean")
    queries = spark.createDataFrame([(1, r, a, [1.0, 1.0]) for r in range(len(replies)) for a in range(6)], "question_id long, rollout_id int, attempt int, vector array<double>")
    said = [(1, r, a + 1, x) for r, own in enumerate(replies) for a, x in enumerate(own) if x is not None]
    said = spark.createDataFrame(said, "question_id long, rollout_id int, attempt int, raw string")
    questions = spark.createDataFrame([(1, r, "s", "Which?", "structure", "strict", ["glandular", "solid"]) for r in range(len(replies))], "question_id long, rollout_id int, slide_id string, question string, question_type string, tier string, choices array<string>")
    return questions, loop.World(tiles, seen, queries, said)


def outcomes(found):
    return {r["rollout_id"]: r for r in found.collect()}


def test_transitions(spark):
    zoom = reply("zoom", target_patches=["t01", "t39"], magnification=10)
    script = [
        [reply("retrieve"), reply("answer", True, ["t00", "t00", "t39", "t05"])],
        [zoom, zoom, reply("inspect", target_patches=["t02", "zzz"]), reply("abstain")],
        [reply("retrieve")] * 5,
        [None],
        [reply("inspect", target_patches=["t03"]), reply("answer", True)],
    ]
    states = {}
    found, steps = loop.run(*world(spark, script), after=lambda attempt, state: states.update({attempt: state}))
    got = outcomes(found)
    assert (got[0]["attempts"], got[0]["ending"], got[0]["answer"], got[0]["refs"], got[0]["seen"]) == (2, "answered", "glandular", ["t00", "t05"], 6)
    assert (got[1]["attempts"], got[1]["ending"], got[1]["focus"], got[1]["seen"]) == (4, "abstained", 1, 8)
    assert (got[2]["attempts"], got[2]["ending"], got[2]["seen"]) == (5, "budget_exhausted", 12)
    assert (got[3]["attempts"], got[3]["ending"], got[3]["answer"], got[3]["refs"], got[3]["sufficient"], got[3]["parse_status"]) == (1, "failed", None, [], False, "executor_api_failure")
    assert got[4]["ending"] == "answered" and got[4]["refs"] == []
    order = [r["patch_id"] for r in states[1].seen.where("rollout_id = 1").orderBy("seq").collect()]
    assert order[:4] == ["t00", "t01", "t02", "t03"] and set(order[4:]) <= {f"x{1000 + 500 * c}_y{500 * r}_w500_h500_m10" for r in (0, 1) for c in (0, 1)} and len(order) == 6
    assert [r["patch_id"] for r in states[3].fresh.where("rollout_id = 1").collect()] == ["t02"]
    assert [r["patch_id"] for r in states[1].fresh.where("rollout_id = 4").collect()] == ["t00"]
    told = {(r["rollout_id"], r["attempt"]): r for r in steps.collect()}
    assert told[1, 1]["n_described"] == 4 and told[1, 2]["n_described"] == 0 and told[1, 2]["step"] == "retrieve" and told[1, 3]["n_described"] == 2 and told[0, 2]["n_fresh"] == 2


def test_where_it_stops(spark):
    questions, tables = world(spark, [[reply("retrieve")] * 5])
    one = lambda *a, **k: loop.run(*a, **k)[0].first()
    out = one(questions, tables, most_chars=120)
    assert (out["ending"], out["attempts"], out["answer"], out["refs"]) == ("context_budget_exceeded", 1, "glandular", [])
    out = one(questions.withColumn("slide_id", F.lit("none")), tables)
    assert (out["ending"], out["attempts"], out["seen"]) == ("no_additional_evidence", 1, 0)
    few = loop.World(tables.tiles.where("patch_id < 't01'"), tables.observations, tables.queries, tables.replies)
    out = one(questions, few)
    assert (out["ending"], out["attempts"], out["seen"]) == ("no_additional_evidence", 2, 1)


def test_evidence_of_any_length(spark):
    """A run on a table of replies without ``most_chars`` goes on over evidence that no request would hold."""
    questions, tables = world(spark, [[reply("answer", True, ["t00"])]], texts=("x" * (loop.MOST_CHARS + 1),))
    assert loop.run(questions, tables)[0].first()["ending"] == "context_budget_exceeded"
    out = loop.run(questions, tables, most_chars=None)[0].first()
    assert (out["ending"], out["attempts"], out["refs"]) == ("answered", 1, ["t00"])


def test_only_what_passes_the_contract_answers(spark):
    concepts = spark.createDataFrame([("structure", "c0", "glandular"), ("structure", "c1", "solid")], "question_type string, concept string, display string")
    none = spark.createDataFrame([], "concept string, support string, needs_zoom boolean")
    contract = loop.Contract(concepts, none, {"c0": RULE, "c1": {"feature_groups": [["solid growth"]], "minimum_clean_evidence_patches": 1, "required_anywhere_groups": [0]}})
    cited = ["t00", "t01"]
    script = [[reply("retrieve", refs=cited)], [reply("answer", True, ["t02"]), reply("retrieve", refs=cited)], [reply("answer", True, ["t02"])] * 2 + [reply("abstain", refs=["t00"])]]
    got = outcomes(loop.run(*world(spark, script), contract=contract)[0])
    assert (got[0]["attempts"], got[0]["ending"], got[0]["sufficient"], got[0]["repairs"][-1]) == (1, "answered", True, "deterministic_contract_passed")
    assert (got[1]["attempts"], got[1]["ending"], got[1]["refs"]) == (2, "answered", cited) and "model_answer_lacked_contract_support" in got[1]["repairs"]
    assert (got[2]["attempts"], got[2]["ending"], got[2]["sufficient"], got[2]["answer"]) == (3, "abstained", False, "glandular")


def sender(log, broken=(), down=()):
    """Replies by a rule from the attempt in the request; every request that arrives is a line of ``log``."""

    def send(text):
        with open(log, "a") as f:
            f.write(text.replace("\n", " ") + "\n")
        asked = json.loads(text)
        if "patch_id" in asked:
            return {"status": 200, "reply": f"Seen at {asked['magnification']}.", "prompt_tokens": 10}
        rollout, attempt = asked["rollout_id"], asked["attempt"]
        if (rollout, attempt) in down:
            raise OSError("no connection")
        if (rollout, attempt) in broken and open(log).read().count(text.replace("\n", " ")) == 1:
            return {"status": 200, "reply": "let me think {", "prompt_tokens": 10}
        kind = ("retrieve", "inspect", "answer")[min(attempt - 1, 2)] if rollout % 2 else ("zoom", "retrieve", "abstain")[min(attempt - 1, 2)]
        action = {"type": kind, "target_patches": ["t03", "t01"], "magnification": 10}
        said = {"provisional_recommendation": "glandular", "evidence_sufficient": kind == "answer", "evidence_refs": ["t00", "t01"], "next_action": action}
        return {"status": 200, "reply": json.dumps(said), "prompt_tokens": 10}

    return send


def requests(log):
    return [json.loads(x) for x in open(log).read().splitlines()]


def test_asking_in_the_loop(spark, tmp_path):
    """No request is sent twice, a reply that does not parse is asked for again, described tiles become visible."""
    log, cache = str(tmp_path / "log"), f"file://{tmp_path}/cache"
    questions, tables = world(spark, [[]] * 4)
    quick = {"sleep": lambda s: None}
    asked = lambda log, **more: loop.World(tables.tiles, tables.observations, tables.queries, decide=Asking(sender(log, **more), cache, options=quick), describe=Asking(sender(log), cache, options=quick))
    found, steps = loop.run(questions, asked(log, broken={(1, 1)}))
    got = outcomes(found)
    assert {r: (got[r]["ending"], got[r]["attempts"]) for r in got} == {0: ("abstained", 3), 1: ("answered", 3), 2: ("abstained", 3), 3: ("answered", 3)}
    assert got[1]["refs"] == ["t00", "t01"] and got[1]["sufficient"]
    sent = requests(log)
    decided = [(x["rollout_id"], x["attempt"]) for x in sent if "attempt" in x]
    assert sorted(decided) == sorted([(r, a) for r in range(4) for a in (1, 2, 3)] + [(1, 1)])
    described = [(x["patch_id"], x["targeted"]) for x in sent if "patch_id" in x]
    assert len(described) == len(set(described)) and {("t00", False), ("t03", False), ("t03", True)} <= set(described)  # t03 had no text of its own
    third = next(x for x in sent if x.get("rollout_id") == 1 and x["attempt"] == 3)
    first = next(x for x in sent if x.get("rollout_id") == 1 and x["attempt"] == 1)
    assert "FOV=unknown] Seen at 5. Seen at 5." in third["evidence"] and "FOV=unknown] Seen at 5.\n" in first["evidence"] + "\n" and "Infiltrative glands. Seen at 5." in first["evidence"]
    again = str(tmp_path / "again")
    found, _ = loop.run(questions, asked(again))
    assert {r: tuple(x) for r, x in outcomes(found).items()} == {r: tuple(x) for r, x in got.items()} and not (tmp_path / "again").exists()


def test_failures_end_rollouts(spark, tmp_path):
    questions, tables = world(spark, [[]] * 3)
    decide = Asking(sender(str(tmp_path / "log"), down={(1, 1)}), f"file://{tmp_path}/cache", Meter(expected=100), {"sleep": lambda s: None})
    got = outcomes(loop.run(questions, loop.World(tables.tiles, tables.observations, tables.queries, decide=decide), attempts=1)[0])
    assert (got[1]["ending"], got[1]["answer"], got[1]["explanation"], got[1]["parse_status"]) == ("failed", None, None, "executor_api_failure")
    assert got[0]["ending"] == got[2]["ending"] == "budget_exhausted" and decide.meter.failures == 1


def test_failures_stop_the_batch(spark):
    asked = spark.createDataFrame([(i, str(i)) for i in range(40)], "id long, request string")

    def send(bad):
        return lambda text: {"status": 400 if int(text) in bad else 200, "reply": "yes", "prompt_tokens": 10}

    def sent(bad, meter):
        return sorted((r["id"], r["status"]) for r in call_in_waves(asked, send(bad), "id", "request", meter).collect())

    assert {s for _, s in sent({7}, Meter(expected=40))} == {200, 400}
    for bad, first in (({3, 4}, 16), ({15, 16}, 40), ({2, 9, 14}, 16), ({20, 21}, 40)):  # in a row, across waves, by their share, in the second wave
        meter = Meter(expected=40)
        out = sent(bad, meter)
        assert [s for i, s in out if i >= first] == [503] * (40 - first) and meter.refuses() == 503, bad
    meter = Meter(budget=0.0002)
    assert [s for _, s in sent(set(), meter)] == [200] * 20 + [402] * 20 and 0.0002 <= meter.spent < 0.00021


def test_a_run_is_resumed(spark, tmp_path):
    class Died(Exception):
        pass

    def dies(attempt, state):
        if attempt == 2:
            raise Died

    script = [[reply("retrieve")] * 5, [reply("zoom", target_patches=["t01"], magnification=10), reply("inspect", target_patches=["t02"]), reply("answer", True, ["t00"])], [reply("abstain")], [reply("retrieve"), reply("answer", True, ["t00"])]]
    questions, tables = world(spark, script)
    whole, steps = loop.run(questions, tables)
    path = f"file://{tmp_path}/ledger"
    with pytest.raises(Died):
        loop.run(questions, tables, after=dies, ledger=path)
    ran = []
    found, told = loop.run(questions, tables, after=lambda attempt, state: ran.append(attempt), ledger=path)
    assert ran == [3, 4, 5]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(found, whole) and same(told, steps)
    with pytest.raises(ValueError, match="replies"):
        loop.run(questions, world(spark, script[:3])[1], ledger=path)
    with pytest.raises(ValueError, match="attempts"):
        loop.run(questions, tables, attempts=3, ledger=path)
    shutil.rmtree(next((tmp_path / "ledger").glob("attempt-002-*")) / "tiles")
    with pytest.raises(ValueError, match="tiles of attempt 2"):
        loop.run(questions, tables, ledger=path)
    failed = f"file://{tmp_path}/failed"
    questions, tables = world(spark, [[reply("retrieve")] * 5, [None]])
    with pytest.raises(Died):
        loop.run(questions, tables, after=dies, ledger=failed)
    with pytest.raises(ValueError, match="failed rollouts"):
        loop.run(questions, tables, ledger=failed)


def test_outcomes_carry_what_is_shown(spark):
    concepts = spark.createDataFrame([("structure", "c0", "glandular"), ("structure", "c1", "solid")], "question_type string, concept string, display string")
    none = spark.createDataFrame([], "concept string, support string, needs_zoom boolean")
    contract = loop.Contract(concepts, none, {"c0": RULE, "c1": {"feature_groups": [["solid growth"]], "minimum_clean_evidence_patches": 1, "required_anywhere_groups": [0]}})
    cited = ["t00", "t01"]
    script = [[reply("answer", True, cited)], [reply("retrieve", refs=["t00"])], [reply("abstain", refs=["zzz"])]]
    got = outcomes(loop.run(*world(spark, script), contract=contract, attempts=1)[0])
    assert got[0]["shown"]["strict_evidence_sufficient"] and got[0]["shown"]["cited_patches"] == cited and got[0]["selected_attempt"] == 1 and not got[0]["abstain_recommended"]
    assert (got[1]["ending"], got[1]["parse_status"], got[1]["explanation"]) == ("budget_exhausted", "contract_v1_best_candidate", loop.BUDGET_UNDER_CONTRACT)
    assert got[1]["shown"]["ready_for_pathologist_review"] and not got[1]["shown"]["strict_evidence_sufficient"] and got[1]["shown"]["supporting_evidence"] == ["t00"]
    assert got[1]["unsupported_reason"] == loop.ENDINGS["budget_exhausted"][2] and got[1]["selected_attempt"] == 1
    assert got[2]["explanation"] == loop.ABSTAINED[0] and got[2]["shown"]["missing_evidence"][0] == "valid_visible_citation_required"


def test_nearest_of_groups(spark, monkeypatch):
    """What leaves the blocks holds the best of each group, with ties and vectors without an order, and not much more."""
    in_order = lambda numbers: reduce(float.__add__, numbers, 0.0)  # ``sum`` compensates
    monkeypatch.setattr(retrieval, "FEATURE_BLOCK", 128)
    rng = random.Random(3)
    vectors = [(g, f"{g}{i:04d}", [rng.gauss(0, 1) for _ in range(8)]) for g, n in (("a", 900), ("b", 40), ("c", 1)) for i in range(n)]
    vectors = [(g, i, vectors[k - 1][2] if k % 3 == 1 and vectors[k - 1][0] == g else v) for k, (g, i, v) in enumerate(vectors)]
    odd = [("a", "nan", [math.nan] * 8), ("a", "null", None), ("a", "gap", [1.0, None] + [1.0] * 6)]
    table = spark.createDataFrame(vectors + odd, "slide string, id string, vector array<double>").repartition(5)
    asks = [(g, 10 * k + need, [rng.gauss(0, 1) for _ in range(8)], need) for k, (g, need) in enumerate([("a", 1), ("a", 90), ("a", 899), ("a", 5000), ("b", 4), ("c", 1), ("d", 3)])]
    queries = spark.createDataFrame(asks, "slide string, query_id long, vector array<double>, need long").withColumn("query", unit(F.col("vector")))
    got = {}
    for r in retrieval.nearest(retrieval.grouped(table, "slide"), queries).collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for slide, query_id, query, need in asks:
        length = math.sqrt(in_order(x * x for x in query))
        score = lambda v: in_order(x * (y / length) for x, y in zip(v, query, strict=True))  # noqa: B023, E731
        want = sorted((-score(v), i) for g, i, v in vectors if g == slide)
        mine = [(i, s) for i, s in got.get(query_id, []) if i[0] == slide and i[1:].isdigit()]
        assert sorted((-s, i) for i, s in mine)[:need] == want[:need]
        assert len(mine) <= need + len(want) / 64 + 2 * 9 and len({i for i, _ in mine}) == len(mine)
        assert {i for i, _ in got.get(query_id, [])} - {i for i, _ in mine} == ({i for _, i, _ in odd} if slide == "a" else set())


def test_plans_do_not_grow(spark):
    """What the planner takes a state's size for does not multiply from attempt to attempt; a vector's length is worked out once."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    sizes = []
    loop.run(*world(spark, [[reply("retrieve")] * 2]), attempts=2, after=lambda attempt, state: sizes.extend([size(state.rollouts), size(state.tiles)]))
    assert len(sizes) == 4 and max(sizes) < 1_000_000
    plan = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(unit(F.col("v")).alias("u"))
    assert plan.first()["u"] == [0.6, 0.8] and plan._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1
