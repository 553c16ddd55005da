import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geometry, policy, text, vectors
from tessella.functions.negation import matching_groups, states
from tessella.operators import decisions
from tessella.plans.evidence import STATED

MORE = [
    ("gland (none)", "gland", True),
    ("free of necrosis", "necrosis", False),
    ("necrosis: not seen", "necrosis", False),
    ("腺泡性生长为阴性", "腺泡", False),
    ("x", "gland", False),
    ("Gland. Necrosis is negative for", "gland", True),
    (None, "gland", False),
]


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said,term,want", [*STATED, *MORE])
def test_terms_are_stated_or_negated(spark, said, term, want):
    assert one(spark, states(F.col("t"), term), t=said) is want


def test_groups(spark):
    found = matching_groups(F.col("t"), [["infiltrat"], ["gland"], ["solid"]])
    assert one(spark, found, t="Infiltrative growth. No glands, but solid nests.") == [0, 2]


def test_retrieval_counts(spark):
    k = lambda n, r, top=None: one(spark, policy.retrieval_count(F.col("n"), r, top), n=n)
    assert [k(5, 0.10), k(5, 0.05), k(3, 0.10, 10), k(3, 0.05, 2), k(0, 0.1), k(29, 0.1)] == [1, 1, 3, 2, 0, 2]
    with pytest.raises(ValueError):
        policy.retrieval_count(F.col("n"), 0.1, 0)


def test_costs(spark):
    cost = policy.call_cost(F.col("p"), F.col("h"), F.col("m"), F.col("c"))
    assert one(spark, cost, p=1000, h=400, m=600, c=100) == pytest.approx(0.000808)
    assert one(spark, policy.call_cost(F.col("p"), F.col("h"), F.lit(None).cast("long"), F.col("c")), p=1000, h=400, c=100) == pytest.approx(0.000808)


def test_read_levels(spark):
    level = lambda w: one(spark, geometry.read_level(F.array(*(F.lit(float(x)) for x in (1, 2, 4, 8, 16))), F.col("w"), F.col("w"), 784), w=w)
    assert [level(4018), level(2009), level(1004), level(10)] == [2, 1, 0, 0]


def test_padding(spark):
    args = [F.lit(x).cast("long") for x in (-5, 2, 20, 30, 10, 100)]
    assert one(spark, geometry.padding(*args), z=0).asDict() == {"left": 5, "top": 0, "right": 5, "bottom": 0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-9, 9, width=32), min_size=1, max_size=6).filter(lambda v: any(abs(x) > 0.1 for x in v)))
def test_unit_vectors_have_length_one(spark, v):
    df = spark.createDataFrame([(v,)], "v array<float>")
    length = df.select(vectors.norm(vectors.unit(F.col("v"))).alias("x")).first()["x"]
    assert math.isclose(length, 1.0, rel_tol=1e-9)


def test_morphology_is_kept_and_labels_go(spark):
    n = lambda t, labels=(): one(spark, text.normalize_morphology(F.col("t"), "v1", list(labels)), t=t).lower()
    kept = n("<answer>**Benign lesion**: Fibroadenoma of breast tissue. There are uniform glandular structures, evenly set.</answer>")
    assert "uniform glandular structures" in kept and not any(w in kept for w in ("fibroadenoma", "breast", "benign"))
    assert "answer label rather than visual evidence" in n("<answer>D</answer>")
    label = "Intraductal epithelial neoplasm"
    out = n(f"VISIBLE: {label} with papillary structures.", [label])
    assert "papillary structures" in out and label.lower() not in out and out.count(":") >= 4


def test_sanitizer(spark):
    said = "Irregular infiltrative glands in breast. This is adenocarcinoma with desmoplasia. KRAS mutation is likely."
    out = one(spark, text.sanitize(F.col("t")), t=said)
    assert "infiltrative glands" in out and "desmoplasia" in out and not any(w in out.lower() for w in ("breast", "adenocarcinoma", "kras"))
    assert one(spark, text.sanitize(F.col("t")), t=None) == text.SANITIZED_TAG


def test_letters_and_choices(spark):
    answer = text.letter_to_choice(F.col("t"), F.col("c"))
    choices = ["PDAC", "IPMN", "Insufficient evidence"]
    assert one(spark, answer, t="<think>..</think><answer>B</answer>", c=choices) == "<answer>IPMN</answer>"
    assert one(spark, answer, t="<answer>Z</answer>", c=choices) == "<answer>Z</answer>"
    assert one(spark, text.insufficient_choice(F.col("c")), c=choices) == "Insufficient evidence"
    assert one(spark, text.parse_choices(F.col("t")), t=" a || b ") == ["a", "b"]
    assert one(spark, text.parse_choices(F.col("t")), t='["a","b|c"]') == ["a", "b|c"]
    assert one(spark, text.safe_focus(F.col("t"), F.col("c")), t="look for IPMN here", c=choices) == "look for visible target morphology here"
    assert one(spark, text.safe_focus(F.col("t"), F.col("c")), t="the neoplasm", c=choices) == "visible morphology"


def test_coordinates(spark):
    at = lambda t: tuple(one(spark, text.coordinates(F.col("t")), t=t))
    assert at("78400_29984_m20.jpg") == (78400, 29984)
    assert at("tile.jpg") == (None, None)


def test_final_answers(spark):
    options = ["Demonstrated", "Not demonstrated", "Insufficient evidence"]
    found = lambda t, multiple=False, c=options: (r := one(spark, decisions.final_answer(F.col("t"), F.col("c"), multiple), t=t, c=c))["answer"] + [r["status"]]
    assert found('{"answer":"Not demonstrated","why": "cut') == ["Not demonstrated", "recovered_exact_choice"]
    assert found("{") == ["Insufficient evidence", "safe_fallback"]
    assert found('x {"answer":"zzz"}') == ["Insufficient evidence", "valid_json"]
    assert found('{"answer":"Demonstrated"} then {"a":1}') == ["Insufficient evidence", "valid_json"]
    assert found('{"answer":["Demonstrated","zzz"]}', True) == ["Demonstrated", "valid_json"]
    assert found('{"answer":[]}', True) == ["valid_json"]
    assert found('{"answer":"证"}', c=["a", "证据不足", "b"]) == ["证据不足", "valid_json"]
    assert found("nothing", c=["a", "b"]) == ["b", "safe_fallback"]


def test_decisions(spark):
    def act(raw, question="Which?", choices=("A", "B", "C", "D")):
        df = spark.createDataFrame([(raw, list(choices), question)], "raw string, choices array<string>, question string")
        return decisions.normalize(df).first()

    out = act('{"provisional_recommendation":"B","ranked_differential":["A","B","x","A","C"],"next_action":{"type":"retrieve"}}')
    assert (out["differential"], out["action"], out["parse_status"]) == (["A", "C"], "retrieve", "normalized_action_json")
    out = act('{"provisional_recommendation":"Insufficient evidence","next_action":{"type":"abstain"}}')
    assert (out["answer"], out["parse_status"]) == ("A", "invalid_action_json")
    out = act('{"provisional_recommendation":"A","next_action":{"type":"retrieve"}}', "What is the size of the primary invasive carcinoma?")
    assert (out["action"], out["repairs"]) == ("abstain", ["report_only_search_changed_to_abstain"])
    out = act('{"provisional_recommendation":"A","evidence_sufficient":"true","next_action":{"type":"answer"}}')
    assert (out["action"], out["sufficient"], out["abstain_recommended"]) == ("abstain", False, True)
    out = act('so {"provisional_recommendation":"A","evidence_sufficient":true,"next_action":{"type":"answer"}} {')
    assert (out["action"], out["sufficient"], out["parse_status"]) == ("answer", True, "valid_action_json")
    assert [one(spark, decisions.focus_magnification(F.col("m")), m=m) for m in ("10", "20.0", "15", "x", None)] == [10, 20, 20, 20, 20]
    assert act(None)["parse_status"] == act("[1]")["parse_status"] == "invalid_action_json"
    refs = decisions.visible_refs(F.array(*map(F.lit, ("a", "b_invisible", "a"))), F.array(F.lit("a")))
    assert one(spark, refs, z=0).asDict() == {"refs": ["a"], "dropped": ["b_invisible"]}
    focus = lambda n: one(spark, decisions.one_focus(F.lit("zoom"), F.lit(1), F.col("n")), n=n)
    assert (focus(3), focus(0)) == ("retrieve", "abstain")
