"""Queries on small rules: names, letters, references, focus texts, key walks and output fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import calls, decisions, joins, loop, review
from tessella.plans.registry import query, table
from tessella.sources import guards, readers


@query("""SELECT event_id, event_type = 'view' AND coalesce(event_id % 3 <> 0, false) AND event_id % 5 <> 0 AND NOT (event_id % 7 = 0) AS clean FROM events""")
def clean_predicate(spark, sf_dir):
    """Status, contract and safety pass and no fallback; every third contract is unknown."""
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "success").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(i, joins.clean(status, F.when(i % 3 != 0, True), i % 5 != 0, i % 7 == 0).alias("clean"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '<answer>' || ['AUTOMOBILE', 'BUILDING', 'FURNITURE'][1 + c_custkey // 4 % 3] || '</answer>' WHEN c_custkey % 4 = 1 THEN '<answer>Z</answer>' WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE 'said ' || c_custkey END AS answer FROM customer""")
def letter_answers(spark, sf_dir):
    """Letters of choices, one that no choice has, words, and text after a thought."""
    i = F.col("c_custkey")
    letter = F.concat(F.lit("<think>so {</think> <answer> "), F.element_at(F.array(*map(F.lit, "aBc")), (F.floor(i / 4) % 3 + 1).cast("int")), F.lit(" </answer>"))
    said = F.when(i % 4 == 0, letter).when(i % 4 == 1, F.lit("<answer>Z</answer>")).when(i % 4 == 2, F.col("c_mktsegment")).otherwise(F.concat(F.lit("<think>no</think>said "), i.cast("string")))
    return table(spark, sf_dir, "customer").select(i, T.letter_to_choice(said, F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE")))).alias("answer"))


@query(f"""WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'the Diagnosis of ' || c_name WHEN 1 THEN '' WHEN 2 THEN 'look at ' || c_mktsegment || ' near BUILDING' ELSE trim(c_name) END AS f FROM customer)
    SELECT c_custkey, CASE WHEN f = '' OR regexp_matches(f, '(?i)diagnosis') THEN 'visible morphology' ELSE replace(replace(f, 'BUILDING', 'visible target morphology'), 'MACHINERY', 'visible target morphology') END AS focus FROM f""")
def inspection_focus(spark, sf_dir):
    i = F.col("c_custkey")
    asked = F.when(i % 4 == 0, F.concat(F.lit("the Diagnosis of "), "c_name")).when(i % 4 == 1, F.lit(None).cast("string")).when(i % 4 == 2, F.concat(F.lit("look at "), "c_mktsegment", F.lit(" near BUILDING"))).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select(i, T.safe_focus(asked, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("focus"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), ' ') AS refs FROM conversations), v AS (SELECT *, list_filter(refs, lambda x, i: i % 2 = 0) AS visible FROM w)
    SELECT conv_id, turn, array_to_string(list_filter(refs, lambda x, i: list_contains(visible, x) AND list_position(refs, x) = i)[1:8], '|') AS refs, len(list_filter(refs, lambda x: NOT list_contains(visible, x))) AS dropped FROM v""")
def visible_references(spark, sf_dir):
    refs = F.split(F.coalesce("text", F.lit("")), " ", -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", refs.alias("refs")).withColumn("visible", F.filter("refs", lambda x, i: (i + 1) % 2 == 0))
    c = c.withColumn("r", decisions.visible_refs(F.col("refs"), F.col("visible")))
    return c.select("conv_id", "turn", F.array_join("r.refs", "|").alias("refs"), F.size("r.dropped").cast("long").alias("dropped"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gland ' || event_id WHEN 1 THEN 'a; ' || event_type WHEN 2 THEN event_type ELSE '' END AS missing FROM events""")
def missing_evidence_text(spark, sf_dir):
    i = F.col("event_id")
    first = F.when(i % 4 == 0, F.concat(F.lit("gland "), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit('["a", "", {"text": "'), "event_type", F.lit('"}]'))).when(i % 4 == 2, F.lit(""))
    return table(spark, sf_dir, "events").select(i, review.missing_text(first, F.when(i % 4 == 2, F.concat(F.lit(" "), "event_type"))).alias("missing"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ground_truth' WHEN 1 THEN 'gold_answer,ground_truth' WHEN 4 THEN 'gold_answer' ELSE '' END AS keys FROM events""")
def forbidden_key_walk(spark, sf_dir):
    """Keys at depth, in lists and with escapes are found; names in values and broken JSON are not."""
    texts = ['{"a": [{"b": {"ground_truth": 1}}]}', '{"gold_answer": [], "x": {"ground_truth": null}}', '{"a": "\\"ground_truth\\": 1", "ground_truths": 2}', '{"ground_truth": ', '{"gold\\u005fanswer": {}}']
    i = F.col("event_id")
    text = F.element_at(F.array(*map(F.lit, texts)), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(i, F.array_join(F.array_sort(guards.forbidden_keys(text, ("ground_truth", "gold_answer"))), ",").alias("keys"))


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id FROM labels)")
def key_union(spark, sf_dir):
    return joins.key_union(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '')")
def available_features(spark, sf_dir):
    """Features whose tile is described."""
    described = table(spark, sf_dir, "documents").where("trim(coalesce(text, '')) <> ''").select(F.col("doc_id").alias("vec_id"))
    return joins.available(table(spark, sf_dir, "embeddings").select("vec_id", "label"), described, ["vec_id"])


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type ELSE '' END AS display, CASE WHEN p_size IN (10, 20) THEN p_size ELSE 20 END::INTEGER AS magnification, length(p_name) + 1 + {len(loop.INITIAL_TARGETS)} AS query_length FROM part""")
def concept_names(spark, sf_dir):
    """Display names of concepts, magnifications of a closer look, and the length of a first query."""
    i = F.col("p_partkey") % 4
    a, b, c = F.when(i == 0, F.col("p_name")).otherwise(F.lit("")), F.when(i < 2, F.col("p_brand")), F.when(i < 3, F.col("p_type"))
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", readers.concept_display(a, b, c).alias("display"), decisions.focus_magnification(size).alias("magnification"), F.length(loop.initial_query(F.col("p_name"))).cast("long").alias("query_length"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE 'Uncertain' END AS answer, CASE event_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'no JSON' ELSE '' END AS thinking_steps,
    CASE event_id % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'No' WHEN 2 THEN 'Uncertain' ELSE '' END AS sufficient, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'Uncertain' ELSE 'nuclei' END END AS missing_info,
    CASE WHEN event_id % 4 <> 0 THEN CASE event_id % 5 WHEN 0 THEN 'Uncertain' WHEN 1 THEN '20' ELSE '5' END END AS zoom_level FROM events""")
def answer_chain(spark, sf_dir):
    """Three replies an event: an answer, whether it is enough, and what is missing."""
    i = F.col("event_id")
    a = F.when(i % 3 == 0, F.concat(F.lit('so {"answer":"'), "event_type", F.lit('","thinking_steps":"first"}'))).when(i % 3 == 1, "no JSON").otherwise("{}")
    b = F.when(i % 4 == 0, '{"sufficient":" Yes "}').when(i % 4 == 1, '{"sufficient":"No"}').when(i % 4 == 2, "none").otherwise("{}")
    c = F.when(i % 5 == 0, "none").when(i % 5 == 1, '{"missing_info":"nuclei","recommended_zoom_level":20}').otherwise('{"missing_info":"nuclei"}')
    out = table(spark, sf_dir, "events").select(i, decisions.chain(a, b, c).alias("c"))
    return out.select("event_id", "c.answer", "c.thinking_steps", "c.sufficient", "c.missing_info", "c.zoom_level")


@query("""WITH e AS (SELECT event_id, event_id % 2 = 0 AS known, event_id % 3 = 0 AS strict, event_id % 5 = 0 AS found FROM events)
    SELECT event_id, CASE WHEN known THEN 'p1' ELSE '' END AS cited, CASE WHEN known THEN 'code' ELSE 'deterministic_evidence_evaluation_unavailable' END AS missing, known AND (strict OR found) AS candidate_evidence_found, known AND strict AS ready,
        known AND strict AS strict, true AS review_required, CASE WHEN known THEN 'B' ELSE 'A' END AS answer, CASE WHEN event_id % 4 = 0 THEN 'sum' ELSE 'ended' END AS explanation, known AND strict AS sufficient, CASE WHEN known THEN 2 END AS attempt FROM e""")
def output_fields(spark, sf_dir):
    """What is shown of evaluated and unevaluated results, and their final answers."""
    i = F.col("event_id")
    known = i % 2 == 0
    some = lambda *x: F.when(known, F.array(*map(F.lit, x)))
    best = F.struct(F.lit("B").alias("answer"), F.lit(2).alias("attempt"), F.array(F.lit("p1")).alias("refs"), F.when(i % 4 == 0, "sum").otherwise("").alias("summary"), F.lit("").alias("reason"), (i % 3 == 0).alias("strict"), F.lit(True).alias("evidence_found"), F.lit(True).alias("citation_valid"), F.lit(False).alias("supports_answer"))
    e = table(spark, sf_dir, "events").select(
        i.alias("question_id"), F.lit("B").alias("candidate"), some("A").alias("differential"), some("p1").alias("valid_refs"), some("p1").alias("supporting"), some().cast("array<string>").alias("opposing"), some("code").alias("missing"),
        F.when(known, i % 5 == 0).alias("candidate_evidence_found"), F.when(known, False).alias("ready"), F.when(known, i % 3 == 0).alias("strict"), F.array(F.lit("A"), F.lit("B")).alias("choices"), F.when(known, best).alias("best"),
    )
    shown = review.public_fields(e, "v1", "s1").select("question_id", F.array_join("cited_patches", ",").alias("cited"), F.array_join("missing_evidence", ",").alias("missing"), "candidate_evidence_found", F.col("ready_for_pathologist_review").alias("ready"), F.col("strict_evidence_sufficient").alias("strict"), "review_required")
    final = review.contract_final(e, F.lit("ended"), F.lit("stopped")).select("question_id", "answer", "explanation", F.col("evidence_sufficient").alias("sufficient"), F.col("selected_candidate_attempt").alias("attempt"))
    return shown.join(final, "question_id").withColumnRenamed("question_id", "event_id")


@query("""SELECT c_custkey, left(c_name, 12) AS short_id, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) IS NOT NULL AS there FROM customer WHERE left(c_name, 12) IN (SELECT DISTINCT left(c_name, 12) FROM customer WHERE c_custkey % 2 = 0)""")
def short_id_join(spark, sf_dir):
    """Questions by the first twelve characters of a slide's name, and whether a slide has any."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", 1, 12).alias("short_id"))
    slides = c.where("c_custkey % 2 = 0").select("short_id").distinct()
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(c.join(slides, "short_id", "left_semi"), asked, ["c_custkey"], "there").select("c_custkey", "short_id", "there")


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return guards.duplicates(table(spark, sf_dir, "events"), ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'm2' ELSE 'm1' END AS model FROM events)
    SELECT user_id, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM e GROUP BY user_id HAVING count(DISTINCT model) > 1""")
def model_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 97 == 0, "m2").otherwise("m1").alias("model"))
    return calls.drifted(e, ["user_id"], "model").select("user_id", F.array_join("models", ",").alias("models"))
