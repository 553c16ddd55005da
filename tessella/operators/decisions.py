"""Model decisions as text made into checked decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import INSUFFICIENT, insufficient_in, is_report_only

# The actions, and how many entries lists may have.
ACTIONS = ("answer", "retrieve", "inspect", "zoom", "abstain")
SEARCHES = ("retrieve", "inspect", "zoom")
MOST_DIFFERENTIAL, MOST_REFS, MOST_ANSWER_REFS = 3, 8, 5
# Texts where a reply says nothing, and magnifications of a closer look with the one that stands for others.
UNPARSED_MISSING = "valid Executor decision"
UNPARSED_REASON = "The Executor did not return valid structured output."
UNPARSED_SUMMARY = "No valid Executor evidence judgment was returned."
UNPARSED_ACTION_REASON = "Invalid model output; stop conservatively."
REPORT_ONLY_REASON = "The requested fact requires report, gross, ancillary, or clinical evidence not available from H&E patches."
FOCUS_MAGNIFICATIONS, FOCUS_DEFAULT = (10, 20), 20
MORE_MORPHOLOGY = "additional relevant morphology"
RECOVERED = "The exact choice was recovered from a truncated JSON response; detailed evidence fields were discarded."
UNRECOVERED = "The model did not return valid JSON, so the safe fallback choice was used."
UNEXPLAINED, UNKNOWN = "No explanation provided.", "Unknown"
# What a domain decision says where it is no JSON.
DOMAIN_SUMMARY = "The Executor did not return valid structured output."

_EMPTY = "array<string>"


def json_block(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, by counting braces; null if there is none.

    The text is cut before every brace, so what is folded has one entry a brace.
    """
    start = F.substring(text, F.instr(text, "{"), F.length(text))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(F.startswith(part, F.lit("{")), 1).when(F.startswith(part, F.lit("}")), -1).otherwise(0)
        done = depth == 0
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.when(done, 1).otherwise(F.length(part))).alias("n"), done.alias("done")))

    end = F.aggregate(F.filter(F.split(start, r"(?=[{}])"), lambda c: c != ""), zero, step)
    return F.when((F.instr(text, "{") > 0) & end["done"], F.left(start, end["n"]))


def kind(value: Column) -> Column:
    """The type of a variant: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT and so on; VOID for a JSON null, null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def parsed(raw: Column) -> Column:
    """A reply as a variant: all of the text if that is JSON, else its first balanced block; null if neither parses."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(json_block(raw)))


class Fields:
    """The fields of a variant column by their names, by what they are in JSON: the string "true" is not true."""

    def __init__(self, column: Column):
        self.column = column

    def variant(self, name: str) -> Column:
        return F.try_variant_get(self.column, f"$.{name}", "variant")

    def is_a(self, name: str, what: str) -> Column:
        return F.coalesce(kind(self.variant(name)) == what, F.lit(False))

    def text(self, name: str) -> Column:
        """A string field, or null."""
        return F.when(self.is_a(name, "STRING"), F.try_variant_get(self.column, f"$.{name}", "string"))

    def shown(self, name: str) -> Column:
        """Any field as text; null for false, 0, what is empty and what is not there."""
        said = F.try_variant_get(self.column, f"$.{name}", "string")
        return F.when(F.when(self.is_a(name, "STRING"), said != "").otherwise(~said.isin("false", "0", "[]", "{}")), said)

    def true(self, name: str) -> Column:
        return self.is_a(name, "BOOLEAN") & F.coalesce(F.try_variant_get(self.column, f"$.{name}", "boolean"), F.lit(False))

    def there(self, name: str) -> Column:
        """Whether there is a field that is not null."""
        return F.coalesce(kind(self.variant(name)) != "VOID", F.lit(False))

    def items(self, name: str) -> Column:
        """The entries of a list that are strings, null for others; an empty array if it is no list."""
        entries = F.try_variant_get(self.column, f"$.{name}", "array<variant>")
        texts = F.transform(entries, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        return F.when(self.is_a(name, "ARRAY"), texts).otherwise(F.array().cast(_EMPTY))


def _strings(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def _action(fields: Fields) -> tuple[Column, Column]:
    """The type that ``next_action`` names, folded, and whether it is an object."""
    is_object = fields.is_a("next_action", "OBJECT")
    said = F.when(is_object, F.try_variant_get(fields.column, "$.next_action.type", "string")).otherwise(fields.text("next_action"))
    return F.lower(F.trim(F.coalesce(said, F.lit("")))), is_object


def _of_action(fields: Fields, is_object: Column, name: str) -> Column:
    return F.when(is_object, fields.shown(f"next_action.{name}"))


def normalize(decisions: DataFrame, raw: str = "raw", choices: str = "choices", question: str = "question") -> DataFrame:
    """``decisions`` with the checked decision of each reply.

    answer, differential, sufficient, abstain_recommended, unsupported_reason,
    advisory (candidate_evidence_found, ready, strict), action, query, targets,
    magnification, refs, summary, missing_evidence, action_reason, repairs and
    parse_status.  Repairs come in this order: the differential, an answer without
    sufficient evidence, a search for what only a report says; abstaining takes
    back sufficiency.  An answer that is no choice, and an unknown action, make a
    decision invalid.
    """
    out = decisions.withColumn("json_", parsed(F.col(raw)))
    out = out.withColumn("json_", F.when(kind(F.col("json_")) == "OBJECT", F.col("json_")))
    f = Fields(F.col("json_"))
    is_json = F.col("json_").isNotNull()
    options = F.coalesce(F.col(choices), F.array().cast(_EMPTY))
    first = F.coalesce(F.try_element_at(options, F.lit(1)), F.lit(""))
    said = F.when(f.there("provisional_recommendation"), f.text("provisional_recommendation")).otherwise(f.text("benchmark_answer"))
    known = F.coalesce(F.array_contains(options, said), F.lit(False))
    values = f.items("ranked_differential")
    action, is_object = _action(f)
    legal = action.isin(*ACTIONS)
    out = out.withColumns({
        "answer": F.when(known, said).otherwise(first), "values_": values, "sufficient_": f.true("evidence_sufficient"),
        "valid_": is_json & known & legal, "named_": F.when(~is_json, "abstain").when(legal, action), "reason_": F.when(is_json, F.trim(F.coalesce(f.shown("unsupported_answer_reason"), F.lit("")))).otherwise(UNPARSED_REASON),
    })
    good = F.array_distinct(F.filter("values_", lambda v: F.coalesce(F.array_contains(options, v) & (v != F.col("answer")), F.lit(False))))
    out = out.withColumn("good_", good).withColumn("first_", F.coalesce("named_", F.when(F.col("sufficient_"), "answer").otherwise("abstain")))
    unsupported = (F.col("first_") == "answer") & ~F.col("sufficient_")
    report = F.col("first_").isin(*SEARCHES) & ~F.col("sufficient_") & is_report_only(F.col(question))
    repairs = F.array(
        F.when(f.there("ranked_differential") & ~f.is_a("ranked_differential", "ARRAY"), "invalid_ranked_differential_changed_to_empty"),
        F.when(F.size("values_") > F.size("good_"), "invalid_ranked_differential_entries_removed"),
        F.when(unsupported, "unsupported_answer_changed_to_abstain"),
        F.when(report, "report_only_search_changed_to_abstain"),
    )
    out = out.withColumn("action", F.when(unsupported | report, "abstain").otherwise(F.col("first_"))).withColumn("repairs", _strings(repairs))
    missing = F.when(is_json, f.shown("missing_evidence")).otherwise(UNPARSED_MISSING)
    out = out.withColumns({
        "differential": F.slice("good_", 1, MOST_DIFFERENTIAL),
        "sufficient": F.col("sufficient_") & (F.col("action") != "abstain"),
        "abstain_recommended": (F.col("action") == "abstain") | f.true("abstain_recommended"),
        "unsupported_reason": F.when(report & (F.col("reason_") == ""), REPORT_ONLY_REASON).otherwise(F.col("reason_")),
        "advisory": F.struct(f.true("advisory_evidence_state.candidate_evidence_found").alias("candidate_evidence_found"), f.true("advisory_evidence_state.ready_for_pathologist_review").alias("ready"), F.col("sufficient_").alias("strict")),
        "query": F.trim(F.coalesce(_of_action(f, is_object, "query"), missing, F.lit(""))),
        "targets": F.when(is_object, _strings(f.items("next_action.target_patches"))).otherwise(F.array().cast(_EMPTY)),
        "magnification": _of_action(f, is_object, "magnification"),
        "refs": _strings(f.items("evidence_refs")),
        "summary": F.when(is_json, f.shown("evidence_summary")).otherwise(UNPARSED_SUMMARY),
        "missing_evidence": missing,
        "action_reason": F.when(is_json, f.shown("action_reason")).otherwise(UNPARSED_ACTION_REASON),
        "parse_status": F.when(~F.col("valid_"), "invalid_action_json").when(F.size("repairs") > 0, "normalized_action_json").otherwise("valid_action_json"),
    })
    return out.drop("json_", "first_", "valid_", "sufficient_", "values_", "good_", "named_", "reason_")


def normalize_domain(decisions: DataFrame, raw: str = "raw") -> DataFrame:
    """``decisions`` of the domain protocol: answer, sufficient, summary, action, query, targets, magnification, refs and parse_status.

    The answer is not held against choices, and no action is repaired but an unknown one.
    """
    out = decisions.withColumn("json_", parsed(F.col(raw)))
    out = out.withColumn("json_", F.when(kind(F.col("json_")) == "OBJECT", F.col("json_")))
    f = Fields(F.col("json_"))
    is_json = F.col("json_").isNotNull()
    action, is_object = _action(f)
    legal = action.isin(*ACTIONS)
    missing = F.when(is_json, f.shown("missing_evidence")).otherwise(UNPARSED_MISSING)
    out = out.withColumns({
        "answer": F.when(is_json, f.text("candidate_answer")).otherwise(INSUFFICIENT),
        "sufficient": f.true("sufficient"),
        "summary": F.when(is_json, f.shown("evidence_summary")).otherwise(DOMAIN_SUMMARY),
        "action": F.when(~is_json, "abstain").when(legal, action).when(f.true("sufficient"), "answer").otherwise("abstain"),
        "query": F.trim(F.coalesce(_of_action(f, is_object, "query"), missing, F.lit(""))),
        "targets": F.when(is_object, _strings(f.items("next_action.target_patches"))).otherwise(F.array().cast(_EMPTY)),
        "magnification": _of_action(f, is_object, "magnification"),
        "refs": _strings(f.items("evidence_refs")),
        "parse_status": F.when(is_json & legal, "valid_action_json").otherwise("invalid_action_json"),
    })
    return out.drop("json_")


# What a step of the chain says where it is no JSON, and the level without one.
UNCERTAIN, CHAIN_LEVEL = "Uncertain", "5"


def chain(answer: Column, enough: Column, more: Column) -> Column:
    """The three replies of the answer chain: answer, steps, sufficient, and, unless that is yes, what is missing and whether to look closer."""
    a, b, c = (Fields(parsed(x)) for x in (answer, enough, more))
    has = lambda f: kind(f.column) == "OBJECT"
    said = F.when(has(b), F.coalesce(b.text("sufficient"), F.lit(""))).otherwise(UNCERTAIN)
    end = F.lower(F.trim(said)) == "yes"
    last = lambda name, absent, otherwise: F.when(~end, F.when(has(c), F.coalesce(F.try_variant_get(c.column, f"$.{name}", "string"), absent)).otherwise(otherwise))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(has(a), F.coalesce(a.text("answer"), F.lit(UNCERTAIN))).otherwise(UNCERTAIN).alias("answer"),
        F.when(has(a), F.coalesce(a.text("thinking_steps"), F.lit(""))).otherwise(F.coalesce(answer, F.lit(""))).alias("thinking_steps"),
        said.alias("sufficient"),
        last("missing_info", none, F.lit(UNCERTAIN)).alias("missing_info"),
        last("zoom_recommendation", none, F.lit(UNCERTAIN)).alias("zoom_recommendation"),
        last("recommended_zoom_level", F.lit(CHAIN_LEVEL), F.lit(UNCERTAIN)).alias("zoom_level"),
        last("zoom_reason", none, F.coalesce(more, F.lit(""))).alias("zoom_reason"),
    )


def focus_magnification(asked: Column) -> Column:
    """The magnification of a closer look: a whole number that is allowed, else the default."""
    number = F.regexp_extract(F.coalesce(asked, F.lit("")), r"^\s*(\d+)(?:\.\d*)?\s*$", 1).try_cast("int")
    return F.when(number.isin(*FOCUS_MAGNIFICATIONS), number).otherwise(FOCUS_DEFAULT)


def visible_refs(refs: Column, visible: Column) -> Column:
    """Refs to visible tiles, each once, at most 8, and the refs that were dropped."""
    seen = lambda r: F.coalesce(F.array_contains(visible, r), F.lit(False))
    kept = F.slice(F.array_distinct(F.filter(refs, seen)), 1, MOST_REFS)
    return F.struct(kept.alias("refs"), F.filter(refs, lambda r: ~seen(r)).alias("dropped"))


def one_focus(action: Column, focus_used: Column, remaining: Column) -> Column:
    """A second zoom becomes a retrieval while tiles remain, else an abstention."""
    again = (action == "zoom") & (focus_used >= 1)
    return F.when(again, F.when(remaining > 0, "retrieve").otherwise("abstain")).otherwise(action)


def final_answer(raw: Column, choices: Column, multiple: Column | bool = False) -> Column:
    """The last answer of a reply: answer (a list), explanation, refs, confidence and status.

    The last ``{...}`` without braces inside that parses counts.  A single answer
    is a choice, else the choice that says that evidence is insufficient, else the
    last choice; a ``multiple`` one is the list of those entries that are choices.
    If nothing parses, the first text after ``"answer":`` counts if it is a choice.
    """
    multiple = F.lit(multiple) if isinstance(multiple, bool) else multiple
    choices = F.coalesce(choices, F.array().cast(_EMPTY))
    blocks = F.transform(F.reverse(F.regexp_extract_all(raw, F.lit(r"(?s)\{.*?\}"), F.lit(0))), lambda b: F.try_parse_json(b))
    found = F.try_element_at(F.filter(blocks, lambda v: v.isNotNull()), F.lit(1))
    f = Fields(found)
    safe = F.coalesce(insufficient_in(choices), F.try_element_at(choices, F.lit(-1)), F.lit(UNKNOWN))
    exact = F.trim(F.regexp_extract(raw, r'"answer"\s*:\s*"([^"]+)"', 1))
    recovered = F.when(exact != "", F.try_element_at(F.filter(choices, lambda c: F.trim(c) == exact), F.lit(1)))
    said = F.trim(F.coalesce(F.try_variant_get(found, "$.answer", "string"), F.lit("")))
    single = F.when((said != "") & ((F.size(choices) == 0) | F.array_contains(choices, said)), said).otherwise(safe)
    several = F.when(f.is_a("answer", "ARRAY"), f.items("answer")).otherwise(F.array(f.text("answer")))
    several = F.filter(several, lambda x: F.coalesce(F.array_contains(choices, x), F.lit(False)))
    explained = F.coalesce(F.nullif(F.trim(F.coalesce(f.text("explanation"), F.lit(""))), F.lit("")), F.lit(UNEXPLAINED))
    is_json = found.isNotNull()
    return F.struct(
        F.when(is_json & multiple, several).when(is_json, F.array(single)).otherwise(F.array(F.coalesce(recovered, safe))).alias("answer"),
        F.when(is_json, explained).when(recovered.isNotNull(), RECOVERED).otherwise(UNRECOVERED).alias("explanation"),
        F.when(is_json, _strings(f.items("evidence_refs"))).otherwise(F.array().cast(_EMPTY)).alias("refs"),
        F.when(is_json, F.try_variant_get(found, "$.confidence", "double")).otherwise(0.0).alias("confidence"),
        F.when(is_json, "valid_json").when(recovered.isNotNull(), "recovered_exact_choice").otherwise("safe_fallback").alias("status"),
    )
