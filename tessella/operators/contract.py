"""Evidence contracts: does what is visible support a choice, and only that one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.negation import stated_terms
from tessella.functions.text import visible_section
from tessella.operators.regions import greedy_nonoverlap

# Magnifications and numbers where a rule names none.
MAGNIFICATIONS, MOST_TILES, LEAST_LIMITED, LEAST_STRICT = (5,), 4, 1, 1
NO_ZOOM = "zoom_confirmation_missing"


@dataclass(frozen=True)
class Rules:
    """Rules as rows.

    ``rows`` has rule, n_groups, least_groups (a tile has to match), least_tiles,
    allowed (magnifications), required (groups) and apart (whether tiles may not
    overlap); ``owners`` term, rule and group, for the numbers of ``terms``.
    """

    rows: DataFrame
    owners: DataFrame
    terms: tuple[str, ...]


def rule_rows(spark: SparkSession, rules: dict[str, dict]) -> Rules:
    """The rules of a policy by their names; each term of theirs is listed once, however many rules share it."""
    terms, rows, owners = {}, [], []
    for name, rule in rules.items():
        groups = rule.get("feature_groups") or []
        rows.append((
            name, len(groups), int(rule.get("minimum_feature_groups_per_patch", len(groups))), max(int(rule.get("minimum_clean_evidence_patches", 1)), LEAST_STRICT),
            [int(m) for m in rule.get("allowed_magnifications", MAGNIFICATIONS)], [int(g) for g in rule.get("required_anywhere_groups", [])], bool(rule.get("require_nonoverlap", True)),
        ))
        owners += [(terms.setdefault(term, len(terms)), name, i) for i, group in enumerate(groups) for term in group]
    held = spark.createDataFrame(rows, "rule string, n_groups int, least_groups int, least_tiles int, allowed array<int>, required array<int>, apart boolean")
    return Rules(held, spark.createDataFrame(owners, "term int, rule string, group int"), tuple(terms))


def tile_matches(tiles: DataFrame, key: list[str], rules: Rules) -> DataFrame:
    """Rows (key, patch_id, x, y, w, h, rule, groups, direct, apart): each clean, placed tile with each rule that allows its magnification and of which it matches a group.

    ``tiles`` has the key, patch_id, text, clean, magnification, x, y, w and h, one
    row per tile; a null magnification is 5.  A text is searched once for the terms
    of all rules.
    """
    usable = F.col("clean") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    of = [*key, "patch_id", "x", "y", "w", "h"]
    read = tiles.where(usable).select(*of, F.coalesce("magnification", F.lit(5)).alias("magnification"), visible_section(F.col("text")).alias("said"))
    hits = read.withColumn("term", F.explode(stated_terms(F.col("said"), rules.terms))).join(F.broadcast(rules.owners), "term")  # a policy is a small file
    found = hits.groupBy(*of, "magnification", "rule").agg(F.array_sort(F.collect_set("group")).alias("groups")).join(F.broadcast(rules.rows), "rule")
    return found.where(F.array_contains("allowed", F.col("magnification"))).select(*of, "rule", "groups", (F.size("groups") >= F.col("least_groups")).alias("direct"), "apart")


def evidence_of(matches: DataFrame, by: list[str], most: int = MOST_TILES) -> DataFrame:
    """Rows (by, selected, represented): the tiles among the direct ``matches`` that are taken, by more groups and then smaller id, and the groups that they show."""
    taken = greedy_nonoverlap(matches.where("direct"), by, [-F.size("groups")], "patch_id", most, apart="apart")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "patch_id"))), lambda t: t["patch_id"])  # of at most ``most``
    return taken.groupBy(*by).agg(listed.alias("selected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("represented"))


def judged(rows: DataFrame, tier: Column, needs_zoom: Column, has_zoom: Column) -> DataFrame:
    """``rows`` (a rule's columns, selected and represented, null for none) with wanted, missing, reasons, eligible and support_score."""
    out = rows.withColumns({"selected": F.coalesce("selected", F.array().cast("array<string>")), "represented": F.coalesce("represented", F.array().cast("array<int>"))})
    out = out.withColumn("wanted", F.when(tier == "limited", LEAST_LIMITED).otherwise(F.col("least_tiles"))).withColumn("lacks_zoom", needs_zoom & ~F.coalesce(has_zoom, F.lit(False)))
    out = out.withColumn("missing", F.filter("required", lambda g: ~F.array_contains(F.col("represented"), g)))
    reasons = [
        F.when(F.size("selected") < F.col("wanted"), F.concat(F.lit("clean_nonoverlapping_patch_count_lt_"), F.col("wanted").cast("string"))),
        F.when(F.size("missing") > 0, "required_visual_feature_group_missing"),
        F.when(F.col("lacks_zoom"), NO_ZOOM),
    ]
    out = out.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull())).withColumn("eligible", F.size("reasons") == 0)
    tiles = F.least(F.size("selected") / F.greatest(F.lit(1), F.col("wanted")), F.lit(1.0))
    groups = F.when(F.size("required") > 0, (F.size("required") - F.size("missing")) / F.size("required")).otherwise(1.0)
    return out.withColumn("support_score", F.round((tiles + groups + F.when(F.col("lacks_zoom"), 0.0).otherwise(1.0)) / 3.0, 6)).drop("lacks_zoom")


def zoomed() -> Column:
    """Whether a tile was looked at more closely."""
    return F.coalesce("magnification", F.lit(5)) > 5


def visual_contracts(tiles: DataFrame, by: list[str], rules: dict[str, dict], tier: Column | None = None, needs_zoom: bool = False, most: int = MOST_TILES) -> DataFrame:
    """One row per group of ``tiles`` and rule: eligible, support_score, selected, represented, missing and reasons.

    Unclean tiles, those off the rule's magnifications and those without geometry
    are passed over (``exclusions`` lists them); the others need enough feature
    groups in the visible part of their text.  They are taken by more groups and
    then smaller id, each unless it overlaps one before, up to ``most``.  The plan
    does not grow with the number of rules.
    """
    held = rule_rows(tiles.sparkSession, rules)
    found = evidence_of(tile_matches(tiles, by, held), [*by, "rule"], most)
    groups = tiles.withColumn("tier_", F.lit("strict") if tier is None else tier).groupBy(*by).agg(F.max("tier_").alias("tier_"), F.max(zoomed()).alias("has_zoom"))
    listed = groups.withColumn("rule", F.explode(F.array(*map(F.lit, rules)))).join(F.broadcast(held.rows), "rule").join(found, [*by, "rule"], "left")
    out = judged(listed, F.col("tier_"), F.lit(needs_zoom), F.col("has_zoom"))
    return out.select(*by, "rule", "eligible", "support_score", "selected", "represented", "missing", "reasons")


def visual_contract(tiles: DataFrame, by: list[str], rule: dict, tier: Column | None = None, needs_zoom: bool = False, most: int = MOST_TILES) -> DataFrame:
    """``visual_contracts`` for a single rule."""
    return visual_contracts(tiles, by, {"": rule}, tier, needs_zoom, most).drop("rule")


def exclusions(tiles: DataFrame, by: list[str], rule: dict) -> DataFrame:
    """Rows (by, patch_id, why): tiles that a rule cannot use, ``unclean`` or ``misplaced`` (without geometry), and those ``zoomed``; a tile may be both unclean and zoomed."""
    allowed = F.coalesce("magnification", F.lit(5)).isin(*(int(m) for m in rule.get("allowed_magnifications", MAGNIFICATIONS)))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    why = F.array(F.when(~F.col("clean"), "unclean").when(allowed & ~placed, "misplaced"), F.when(zoomed(), "zoomed"))
    return tiles.select(*by, "patch_id", F.explode(F.filter(why, lambda w: w.isNotNull())).alias("why"))


def unique_answer(evaluations: DataFrame, by: list[str], choice: str = "choice") -> DataFrame:
    """Per group the choices that pass, and the one that passes alone, or null."""
    passing = evaluations.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("eligible"), F.col(choice)))).alias("passing"))
    return passing.withColumn("answer", F.when(F.size("passing") == 1, F.element_at("passing", 1)))


def citations(refs: Column, visible: Column) -> Column:
    """Cited tiles that are visible and that are not, each once and in order, and whether there are some and all are visible."""
    refs = F.coalesce(refs, F.array().cast("array<string>"))
    valid, unknown = F.array_intersect(F.array_compact(refs), visible), F.array_except(refs, F.array_compact(visible))
    invalid = F.when(F.size(unknown) > 0, F.filter(refs, lambda r: r.isNull() | F.array_contains(unknown, r))).otherwise(F.array().cast("array<string>"))
    return F.struct(valid.alias("valid"), invalid.alias("invalid"), ((F.size(valid) > 0) & (F.size(unknown) == 0)).alias("all_valid"))


def strictly_supported(all_valid: Column, from_visible: Column, from_cited: Column, candidate: Column) -> Column:
    """Whether the candidate is the only choice that passes, from all visible tiles and from the cited ones."""
    return F.coalesce(all_valid & (from_visible == candidate) & (from_cited == candidate), F.lit(False))


def differential(values: Column, choices: Column, candidate: Column, most: Column | int) -> Column:
    """Other choices in their order, each once, without the candidate, cut to ``most``."""
    kept = F.array_distinct(F.filter(values, lambda v: F.array_contains(choices, v) & (v != candidate)))
    return F.slice(kept, F.lit(1), F.lit(most) if isinstance(most, int) else most)
