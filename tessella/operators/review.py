"""The whole state of evidence for a question: contracts of all choices, citations and review layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.checkpoints import cut
from tessella.operators.contract import citations, differential, evidence_of, judged, rule_rows, strictly_supported, tile_matches, zoomed

# Codes of what is missing, and constants of the output.
NO_CITATION = "valid_visible_citation_required"
NO_MATCH = "clean_localizable_cited_patch_matching_an_allowed_feature_group_required"
NO_DIRECT = "direct_support_for_provisional_or_ranked_differential_required"
NOT_STRICT = "strict_contract_not_satisfied"
NO_MAPPING = "no_frozen_visual_support_mapping"
NOT_EVALUATED = "deterministic_evidence_evaluation_unavailable"
REVIEW_REASON = "research_output_requires_pathologist_review"


def one_concept_each(concepts: DataFrame) -> None:
    """An error if two concepts (question_type, concept, display) of a question type are shown alike; for a policy when it is loaded."""
    doubled = concepts.groupBy("question_type", "display").count().where("count > 1").take(1)
    if doubled:
        raise ValueError(f"two concepts are shown as {doubled[0]['display']}")


def option_concepts(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows (question_id, position, choice, concept): every choice by the concept (question_type, concept, display) that shows it.

    A choice without a concept, and one that two concepts show, are errors when the rows are read.
    """
    fail = lambda said: F.raise_error(F.concat(F.lit(said), "choice"))
    shown = concepts.groupBy("question_type", F.col("display").alias("choice")).agg(F.min("concept").alias("concept"), F.count("*").alias("times"))
    choices = questions.select("question_id", "question_type", F.posexplode("choices").alias("position", "choice"))
    known = choices.join(shown, ["question_type", "choice"], "left")
    concept = F.when(F.col("concept").isNull(), fail("a choice has no concept: ")).when(F.col("times") > 1, fail("two concepts are shown as ")).otherwise(F.col("concept"))
    return known.select("question_id", "question_type", "position", "choice", concept.alias("concept"))


def supports(options: DataFrame, relations: DataFrame) -> DataFrame:
    """``options`` with ``support`` (null where nothing visual supports a choice) and ``needs_zoom``; structures support themselves."""
    related = options.join(relations.select("concept", F.col("support").alias("other"), F.col("needs_zoom").alias("zoom")), "concept", "left")
    own = F.col("question_type") == "structure"
    support = F.when(own, F.col("concept")).otherwise(F.col("other"))
    return related.withColumn("support", support).withColumn("needs_zoom", ~own & F.coalesce("zoom", F.lit(False))).drop("other", "zoom")


def _scopes(asked: DataFrame) -> DataFrame:
    """Rows (question_id, scope, patch_id): the tiles of each question in the scopes visible and cited, each once."""
    both = asked.select("question_id", F.explode(F.create_map(F.lit("visible"), F.array_distinct("visible"), F.lit("cited"), F.col("cites.valid"))).alias("scope", "ids"))
    return both.select("question_id", "scope", F.explode("ids").alias("patch_id"))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.withColumn("cites", citations(F.col("refs"), F.col("visible")))


def choice_matches(matches: DataFrame, scopes: DataFrame, options: DataFrame) -> DataFrame:
    """Rows (question_id, patch_id, support, choice, concept, needs_zoom, groups, direct, x, y, w, h): every match of a cited tile with a rule that supports a choice."""
    cited = scopes.where("scope = 'cited'").select("question_id", "patch_id")
    wanted = options.where("support is not null").select("question_id", F.col("support").alias("rule"), "choice", "concept", "needs_zoom")
    found = matches.join(cited, ["question_id", "patch_id"]).join(wanted, ["question_id", "rule"])
    return found.select("question_id", "patch_id", F.col("rule").alias("support"), "choice", "concept", "needs_zoom", "groups", "direct", "x", "y", "w", "h")


def cited_matches(questions: DataFrame, tiles: DataFrame, concepts: DataFrame, relations: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``choice_matches`` of the questions by a policy's rules."""
    matches = tile_matches(tiles, ["question_id"], rule_rows(tiles.sparkSession, rules))
    return choice_matches(matches, _scopes(_asked(questions)), supports(option_concepts(questions, concepts), relations))


def match_records(matches: DataFrame) -> DataFrame:
    """One row for each cited tile that matches anything: the choices that it matches, by which rule and groups, and whether it supports any directly."""
    said = F.array_sort(F.collect_set(F.struct("choice", "support", "direct", "groups", "needs_zoom")))  # at most one for each choice
    return matches.groupBy("question_id", "patch_id", "x", "y", "w", "h").agg(said.alias("matches"), F.max("direct").alias("any_direct"))


def evaluate(questions: DataFrame, tiles: DataFrame, concepts: DataFrame, relations: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """One row per question with everything that its evidence shows.

    ``questions`` has question_id, question_type, choices, candidate, tier,
    visible, refs and ranked; ``tiles`` question_id, patch_id, text, clean,
    magnification, x, y, w and h; ``relations`` concept, support and needs_zoom.
    Rules are rows: a tile is searched once for the terms of all of them, and
    tiles are taken for every question, scope and rule in the same rounds.
    """
    asked = _asked(questions)
    ranked = F.coalesce("ranked", F.array().cast("array<string>"))
    asked = asked.withColumn("differential", differential(ranked, F.col("choices"), F.col("candidate"), F.greatest(F.lit(0), F.size("choices") - 1)))
    held, scopes = rule_rows(tiles.sparkSession, rules), cut(_scopes(asked))
    options = cut(supports(option_concepts(questions, concepts), relations))
    matches = cut(tile_matches(tiles, ["question_id"], held))
    wanted = options.select("question_id", F.col("support").alias("rule")).distinct()
    found = evidence_of(matches.join(scopes, ["question_id", "patch_id"]).join(wanted, ["question_id", "rule"]), ["question_id", "scope", "rule"])
    closer = scopes.join(tiles.where(zoomed()).select("question_id", "patch_id"), ["question_id", "patch_id"]).groupBy("question_id", "scope").agg(F.lit(True).alias("has_zoom"))
    each = options.withColumn("scope", F.explode(F.array(F.lit("visible"), F.lit("cited")))).withColumnRenamed("support", "rule")
    each = each.join(F.broadcast(held.rows), "rule", "left").join(found, ["question_id", "scope", "rule"], "left").join(closer, ["question_id", "scope"], "left")
    each = judged(each.join(asked.select("question_id", "candidate", "tier"), "question_id"), F.col("tier"), F.col("needs_zoom"), F.col("has_zoom"))
    unmapped = F.col("rule").isNull()
    ruled = F.when(unmapped | F.col("least_tiles").isNotNull(), F.col("eligible")).otherwise(F.raise_error(F.concat(F.lit("a concept is supported by a rule that is not there: "), "rule")))
    each = each.withColumns({
        "eligible": ~unmapped & ruled, "support_score": F.when(unmapped, 0.0).otherwise(F.col("support_score")),
        "reasons": F.when(unmapped, F.array(F.lit(NO_MAPPING))).otherwise(F.col("reasons")),
    })
    own = F.col("choice") == F.col("candidate")

    def passing(scope: str) -> Column:
        rows = F.collect_list(F.when(F.col("eligible") & (F.col("scope") == scope), F.struct("position", "choice")))
        return F.transform(F.array_sort(rows), lambda r: r["choice"]).alias(f"{scope}_passing")

    of = lambda scope, what: F.max(F.when(own & (F.col("scope") == scope), F.col(what)))
    state = each.groupBy("question_id").agg(
        passing("visible"), passing("cited"), of("visible", "support_score").alias("support_score"), of("cited", "support_score").alias("citation_score"),
        of("cited", "eligible").alias("supports_answer"), of("visible", "reasons").alias("visible_reasons"), of("cited", "reasons").alias("cited_reasons"),
    )
    matched = choice_matches(matches, scopes, options).join(asked.select("question_id", "candidate", "differential"), "question_id")
    wanted = F.col("direct") & ((F.col("choice") == F.col("candidate")) | F.array_contains("differential", F.col("choice")))
    against = F.col("direct") & (F.col("choice") != F.col("candidate"))
    tiles_where = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("patch_id"))))
    layers = matched.groupBy("question_id").agg(F.count("*").alias("matched"), tiles_where(wanted).alias("supporting"), tiles_where(against).alias("opposing"))
    out = asked.join(state, "question_id").join(layers, "question_id", "left")
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    out = out.withColumn("citation_valid", F.col("cites.all_valid")).withColumn("unique_visible", one("visible_passing")).withColumn("unique_cited", one("cited_passing"))
    out = out.withColumn("strict", strictly_supported(F.col("citation_valid"), F.col("unique_visible"), F.col("unique_cited"), F.col("candidate")))
    empty = F.array().cast("array<string>")
    valid_only = lambda c: F.when(F.col("citation_valid"), F.coalesce(c, empty)).otherwise(empty)
    out = out.withColumn("supporting", valid_only("supporting")).withColumn("opposing", valid_only("opposing"))
    candidate_found = F.col("strict") | (F.col("citation_valid") & (F.coalesce("matched", F.lit(0)) > 0))
    out = out.withColumn("candidate_evidence_found", candidate_found).withColumn("ready", F.col("strict") | (candidate_found & (F.size("supporting") > 0)))
    coded = lambda scope: F.transform(F.coalesce(f"{scope}_reasons", empty), lambda r: F.concat(F.lit(f"{scope}:"), r))
    first = F.filter(F.array(F.when(~F.col("citation_valid"), NO_CITATION), F.when(~F.col("candidate_evidence_found"), NO_MATCH), F.when(~F.col("ready"), NO_DIRECT)), lambda c: c.isNotNull())
    last = F.when(~F.col("strict"), F.array(F.lit(NOT_STRICT))).otherwise(empty)
    out = out.withColumn("missing", F.concat(first, F.array_distinct(F.concat(coded("visible"), coded("cited"))), last))
    return out.select(
        "question_id", "candidate", "differential", F.col("cites.valid").alias("valid_refs"), F.col("cites.invalid").alias("invalid_refs"), "citation_valid",
        (F.size("visible_passing") > 0).alias("evidence_found"), F.coalesce("supports_answer", F.lit(False)).alias("supports_answer"), "strict", "candidate_evidence_found", "ready",
        "supporting", "opposing", "missing", "visible_passing", "cited_passing", "unique_visible", "unique_cited", F.coalesce("support_score", F.lit(0.0)).alias("support_score"),
        F.coalesce("citation_score", F.lit(0.0)).alias("citation_score"),
    )


def candidate_record(evaluated: DataFrame, attempt: Column, stability: Column) -> DataFrame:
    """One record per question to compare attempts by (``operators.history.best_so_far``)."""
    return evaluated.select("question_id", F.col("candidate").alias("answer"), attempt.alias("attempt"), stability.alias("stability"), "support_score", "citation_score", F.col("valid_refs").alias("refs"), "differential")


def shown_fields(answer: Column, of: Callable[[str], Column], contract_version: str | None = None, schema_version: str | None = None) -> list[Column]:
    """The 13 fields that are shown of an answer, from what ``of`` gives of its evaluation; without one they say so, and strict evidence implies the weaker layers."""
    strict = F.coalesce(of("strict"), F.lit(False))
    yes = lambda name: strict | F.coalesce(of(name), F.lit(False))
    listed = lambda name: F.coalesce(of(name), F.array().cast("array<string>"))
    return [
        answer.alias("provisional_recommendation"), listed("differential").alias("ranked_differential"), listed("valid_refs").alias("cited_patches"),
        listed("supporting").alias("supporting_evidence"), listed("opposing").alias("opposing_or_conflicting_evidence"),
        F.when(of("strict").isNull(), F.array(F.lit(NOT_EVALUATED))).otherwise(of("missing")).alias("missing_evidence"),
        yes("candidate_evidence_found").alias("candidate_evidence_found"), yes("ready").alias("ready_for_pathologist_review"), strict.alias("strict_evidence_sufficient"),
        F.lit(True).alias("review_required"), F.lit(REVIEW_REASON).alias("review_reason"), F.lit(contract_version).cast("string").alias("contract_version"),
        F.lit(schema_version).cast("string").alias("output_schema_version"),
    ]


def public_fields(results: DataFrame, contract_version: str | None = None, schema_version: str | None = None) -> DataFrame:
    """``shown_fields`` of each result, and its evidence_refs."""
    refs = F.coalesce("valid_refs", F.array().cast("array<string>")).alias("evidence_refs")
    return results.select("question_id", *shown_fields(F.col("candidate"), F.col, contract_version, schema_version), refs)


# Fixed value: how an answer that is the best candidate so far is marked.
BEST_CANDIDATE = "contract_v1_best_candidate"


def contract_final(results: DataFrame, explanation: Column, stop_reason: Column) -> DataFrame:
    """The final answer of rollouts that end without a pass: the best candidate's, or the first choice where there is none.

    ``results`` has question_id, choices and ``best`` (answer, attempt, refs,
    summary, reason, strict, evidence_found, citation_valid and supports_answer).
    """
    best, none = F.col("best"), F.array().cast("array<string>")
    no = lambda c: F.coalesce(c, F.lit(False))
    first = F.coalesce(F.try_element_at("choices", F.lit(1)), F.lit(""))
    return results.select(
        "question_id", F.coalesce(best["answer"], first).alias("answer"), F.coalesce(F.nullif(best["summary"], F.lit("")), explanation).alias("explanation"), F.coalesce(best["refs"], none).alias("evidence_refs"),
        F.lit(None).cast("double").alias("confidence"), F.lit(BEST_CANDIDATE).alias("parse_status"), no(best["strict"]).alias("evidence_sufficient"), no(best["evidence_found"]).alias("evidence_found"),
        no(best["citation_valid"]).alias("citation_valid"), no(best["supports_answer"]).alias("citation_supports_answer"), F.lit(True).alias("abstain_recommended"),
        F.coalesce(F.nullif(best["reason"], F.lit("")), stop_reason).alias("unsupported_answer_reason"), best["attempt"].alias("selected_candidate_attempt"),
    )


def missing_text(first: Column, second: Column) -> Column:
    """What is missing as one text: ``first`` unless blank, else ``second``; each a text or a JSON list of texts or of objects with ``text``."""
    said = F.coalesce(F.nullif(first, F.lit("")), second)
    items = F.from_json(said, "array<string>")
    texts = F.transform(items, lambda i: F.coalesce(F.get_json_object(i, "$.text"), i))
    listed = F.array_join(F.filter(texts, lambda t: t != ""), "; ")
    return F.when(F.startswith(F.ltrim(said), F.lit("[")), listed).otherwise(F.trim(F.coalesce(said, F.lit(""))))
