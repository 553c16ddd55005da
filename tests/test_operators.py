import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import contract, focus, joins, regions, retrieval

TILES = [
    ("p1", 0, 0, 100, 100, 5, "VISIBLE: Infiltrative glandular architecture is present.\nABSENT_OR_NOT_SEEN: none"),
    ("p2", 200, 0, 100, 100, 5, "VISIBLE: Irregular infiltrative glands are present.\nABSENT_OR_NOT_SEEN: none"),
    ("z1", 0, 0, 25, 25, 20, "VISIBLE: Nuclear atypia is present.\nABSENT_OR_NOT_SEEN: none"),
]
RULE = {"feature_groups": [["infiltrat"], ["gland"]], "minimum_feature_groups_per_patch": 2, "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0, 1]}


def tiles(spark, keep=("p1", "p2", "z1"), clean=("p1", "p2")):
    rows = [("q", t[0], t[6], t[0] in clean, t[5], *t[1:5]) for t in TILES if t[0] in keep]
    return spark.createDataFrame(rows, "q string, patch_id string, text string, clean boolean, magnification int, x long, y long, w long, h long")


def test_contract_passes_and_fails(spark):
    out = contract.visual_contract(tiles(spark), ["q"], RULE).first()
    assert (out["eligible"], out["support_score"], out["selected"]) == (True, 1.0, ["p1", "p2"])
    assert {(r["patch_id"], r["why"]) for r in contract.exclusions(tiles(spark), ["q"], RULE).collect()} == {("z1", "unclean"), ("z1", "zoomed")}
    out = contract.visual_contract(tiles(spark, keep=("p1",)), ["q"], RULE).first()
    assert (out["eligible"], out["support_score"], out["reasons"]) == (False, 0.833333, ["clean_nonoverlapping_patch_count_lt_2"])
    out = contract.visual_contract(tiles(spark, clean=()), ["q"], RULE).first()
    assert out["missing"] == [0, 1] and out["selected"] == []
    out = contract.visual_contract(tiles(spark, keep=("p1", "p2")), ["q"], RULE, needs_zoom=True).first()
    assert out["reasons"] == ["zoom_confirmation_missing"]
    limited = contract.visual_contract(tiles(spark, keep=("p1",)), ["q"], RULE, tier=F.lit("limited")).first()
    assert limited["eligible"]


def test_rules_are_rows(spark):
    """A hundred rules give what each gives alone, by a plan of the same size."""
    rules = {f"r{i}": RULE | {"minimum_clean_evidence_patches": 1 + i % 3, "minimum_feature_groups_per_patch": 1 + i % 2} for i in range(100)}
    out = {r["rule"]: r for r in contract.visual_contracts(tiles(spark), ["q"], rules).collect()}
    for name in ("r0", "r1", "r2", "r5"):
        alone = contract.visual_contract(tiles(spark), ["q"], rules[name]).first().asDict()
        assert {k: v for k, v in out[name].asDict().items() if k != "rule"} == alone
    scans = lambda some: contract.tile_matches(tiles(spark), ["q"], contract.rule_rows(spark, some))._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans(rules) == scans({"r0": RULE})


def greedy(rects, most):
    """Ids taken one by one, as (id, x, y, w, h) come."""
    taken = []
    for r in rects:
        free = all(r[1] + r[3] <= t[1] or t[1] + t[3] <= r[1] or r[2] + r[4] <= t[2] or t[2] + t[4] <= r[2] for t in taken)
        if free and len(taken) < most:
            taken.append(r)
    return [t[0] for t in taken]


def test_greedy_rounds_equal_the_fold(spark):
    chain = [(i, 60 * i, 0, 100, 50) for i in range(1000)]
    pile = [(i, i % 7, i % 5, 90, 90) for i in range(300)]
    rows = [("chain", *r) for r in chain] + [("pile", *r) for r in pile] + [(None, 1, 0, 0, 5, 5), (None, 2, 3, 3, 5, 5), (None, 3, 5, 0, 5, 5)]
    df = spark.createDataFrame(rows, "g string, id long, x long, y long, w long, h long")
    got = {}
    for r in regions.greedy_nonoverlap(df, ["g"], [F.col("id")], "id", 6).orderBy("position").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == {"chain": greedy(chain, 6), "pile": greedy(pile, 6), None: [1, 3]}
    loose = df.where("g = 'pile'").withColumn("apart", F.lit(False))
    assert [r["id"] for r in regions.greedy_nonoverlap(loose, ["g"], [-F.col("id")], "id", 3, apart="apart").orderBy("position").collect()] == [299, 298, 297]


def test_unique_answers(spark):
    rows = spark.createDataFrame([("q", "a", True), ("q", "b", False), ("r", "a", True), ("r", "b", True)], "q string, choice string, eligible boolean")
    found = {r["q"]: r["answer"] for r in contract.unique_answer(rows, ["q"]).collect()}
    assert found == {"q": "a", "r": None}


def test_focus_ranking(spark):
    rows = [("blank", "strict_blank", 0.0, 1.0, {}, 0.40, 0), ("ambiguous", "ambiguous", 0.03, 0.94, {}, 0.35, 1), ("tissue", "definite_nonblank", 0.30, 0.50, None, 0.33, 2), ("padded", "definite_nonblank", 0.50, 0.20, {"right": 10}, 0.50, 3)]
    df = spark.createDataFrame([("q", *r) for r in rows], "q string, id string, kind string, tissue double, white double, padding map<string,long>, score double, index int")
    out = {r["id"]: r for r in focus.rank_candidates(df, ["q"]).collect()}
    assert [i for i in sorted((i for i in out if out[i]["chosen"]), key=lambda i: out[i]["eligible_rank"])] == ["tissue", "ambiguous"]
    assert out["ambiguous"]["risk"] == pytest.approx(0.5) and out["ambiguous"]["adjusted"] == pytest.approx(0.325)
    assert (out["blank"]["reasons"], out["padded"]["reasons"]) == (["strict_blank"], ["padding"])
    assert all(r["adjusted"] <= r["score"] for r in out.values())


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 9999), st.integers(0, 9999), st.integers(8, 5000), st.integers(8, 5000), st.sampled_from([10, 20]))
def test_children_tile_their_parent(spark, x, y, w, h, target):
    parent = spark.createDataFrame([("s", "p", x, y, w, h)], "slide_id string, patch_id string, x long, y long, w long, h long")
    out = regions.children(parent, target).collect()
    assert len(out) == (target // 5) ** 2
    assert sum(r["w"] * r["h"] for r in out) == w * h
    assert (min(r["x"] for r in out), max(r["x"] + r["w"] for r in out), max(r["y"] + r["h"] for r in out)) == (x, x + w, y + h)


def test_tile_split(spark):
    tile = spark.createDataFrame([("t", 78400, 29984, 1024, 1024)], "patch_id string, x long, y long, w long, h long")
    out = sorted(tuple(r)[3:] for r in regions.split_tiles(tile, 2).collect())
    assert out == [(78400, 29984, 512, 512), (78400, 30496, 512, 512), (78912, 29984, 512, 512), (78912, 30496, 512, 512)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50), st.integers(1, 60), st.integers(1, 60)), min_size=1, max_size=12))
def test_overlaps_equal_brute_force(spark, rects):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rects)], "g int, id int, x long, y long, w long, h long")
    hit = lambda a, b: not (a[0] + a[2] <= b[0] or b[0] + b[2] <= a[0] or a[1] + a[3] <= b[1] or b[1] + b[3] <= a[1])
    want = sorted((i, j) for i in range(len(rects)) for j in range(i + 1, len(rects)) if hit(rects[i], rects[j]))
    assert sorted((r["a"], r["b"]) for r in regions.overlapping_pairs(df, ["g"], "id", 16).collect()) == want
    taken = [r["id"] for r in regions.greedy_nonoverlap(df, ["g"], [F.col("id")], "id", 99).orderBy("position").collect()]
    assert not any(hit(rects[i], rects[j]) for i in taken for j in taken if i < j)


def test_retrieval_is_disjoint_from_replenishment(spark):
    f = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0])], "q long, qv array<float>")
    scored = retrieval.scores(f, q, "id", "v", "q", "qv")
    n = spark.createDataFrame([(1, 60), (2, 60)], "query_id long, n long")
    first = retrieval.initial(scored, n, ["query_id"])
    more = retrieval.replenish(scored, n, first.select("query_id", "id"), ["query_id"])
    a, b = ({(r["query_id"], r["id"]) for r in x.collect()} for x in (first, more))
    assert (len(a), len(b), a & b) == (12, 6, set())


def test_best_in_blocks(spark, monkeypatch):
    """Blocks of any size, and queries sent whole or met block by block, give what ranking every pair gives: copies, ties, nulls, other lengths and non-finite components too."""
    rng = np.random.default_rng(5)
    made = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(90, 7))]
    rows = [(i, made[i % 90]) for i in range(240)] + [(i, made[3]) for i in range(240, 300)] + [(300, None), (301, [None] * 7), (302, [float("nan")] * 7), (303, made[4][:5]), (304, [0.0] * 7), (305, [float("inf")] + made[1][1:]), (306, made[5][:5])]
    f = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    q = f.where("id % 5 = 0 or id > 300").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    show = lambda df: sorted(str(tuple(r)) for r in df.select("query_id", "id", "score", "rank").collect())
    want = show(retrieval.top_k(retrieval.scores(f, q, "id", "v", "q", "qv"), ["query_id"], 5))
    for most, blocks in ((10_000, (4096, 2048, 256)), (10_000, (32, 8, 3)), (20, (32, 8, 3))):
        monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", most)
        for name, value in zip(("FEATURE_BLOCK", "QUERY_BLOCK", "AT_ONCE"), blocks):
            monkeypatch.setattr(retrieval, name, value)
        assert show(retrieval.best(f, q, "id", "v", "q", "qv", 5)) == want


def test_prefixes_of_one_beginning(spark):
    """Names that all begin alike are not met with the keys one by one; keys are of any length, absent, null or a whole name."""
    names = [f"Customer#{i:05d}" for i in range(0, 3000, 3)] + ["Customer#0\U0001f600x", "C", ""]
    keys = [f"Customer#{i:03d}" for i in range(40)] + ["Customer#", "Customer#00003", "Customer#00004", "Customer#0\U0001f600", "Customer#00003x", None]
    got = joins.resolve_prefix(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "k", "n", 9)
    want = {k: k and min((n for n in names if n.startswith(k)), default=k) for k in keys}
    assert {r["k"]: r["resolved"] for r in got.collect()} == want
    assert "StartsWith" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_joins(spark):
    keys = spark.createDataFrame([("ab",), ("zz",)], "k string")
    names = spark.createDataFrame([("abd",), ("abc",), ("b",)], "n string")
    assert {r["k"]: r["resolved"] for r in joins.resolve_prefix(keys, names, "k", "n", 1).collect()} == {"ab": "abc", "zz": "zz"}
    assert [tuple(r) for r in joins.set_differences(keys, keys.where("k = 'ab'"), "k").collect()] == [("zz", "left")]
