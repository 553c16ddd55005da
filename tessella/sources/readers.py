"""Readers: questions in three dialects, manifests, features, descriptions, settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import parse_choices
from tessella.sources.guards import require_unique

QUESTION = ("slide_id", "short_id", "case_id", "question_id", "question", "question_type", "difficulty", "evidence_tier", "choices", "answer")
SLIDES = "slide_id string, slide_path string, width long, height long, level_downsamples array<double>"
TILES = (
    "slide_id string, patch_id string, x_level0 long, y_level0 long, width_level0 long, height_level0 long, mpp_x double, mpp_y double, "
    "magnification int, parent_patch_id string, selected boolean"
)
CLEAN = "slide_id string, patch_id string, status string, audit struct<contract_pass:boolean,safety_pass:boolean,fallback_or_uninformative:boolean>"


def _shaped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*(columns.get(c, F.lit(None).cast("array<string>" if c == "choices" else "string")).alias(c) for c in QUESTION))


def questions(spark: SparkSession, path: str, dialect: str, slides: DataFrame | None = None) -> DataFrame:
    """Questions in one shape.  ``slides`` (name) keeps those whose slide is there.  An unknown dialect is an error."""
    if dialect == "wsi_vqa":
        raw = spark.read.schema("Id string, Question string, Choice array<string>, Answer string").option("multiLine", True).json(path)
        out = _shaped(raw, {"slide_id": F.col("Id"), "short_id": F.col("Id"), "question": F.col("Question"), "choices": F.col("Choice"), "answer": F.col("Answer")})
        if slides is None:
            return out
        names = slides.where(F.col("name").contains("DX1")).select("name", F.substring("name", 1, 12).alias("short_id"))
        return out.drop("slide_id").join(names, "short_id").withColumnRenamed("name", "slide_id").select(*QUESTION)
    if dialect == "slidebench_vqa":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        choices = F.array("A", "B", "C", "D")
        letter = F.upper(F.trim("Answer"))
        answer = F.when(letter.isin("A", "B", "C", "D"), F.element_at(choices, F.ascii(letter) - 64)).otherwise(F.col("Answer"))
        out = _shaped(raw, {"slide_id": F.col("Slide"), "question": F.col("Question"), "choices": choices, "answer": answer})
        if slides is None:
            return out
        return out.join(slides.where(F.col("name").contains("DX1")).select(F.split_part("name", F.lit("."), F.lit(1)).alias("slide_id")).distinct(), "slide_id", "left_semi").select(*QUESTION)
    if dialect == "local_wsi":
        out = _local(spark, path)
        return out if slides is None else out.join(slides.select(F.col("name").alias("slide_id")).distinct(), "slide_id", "left_semi").select(*QUESTION)
    raise ValueError(f"unknown dialect {dialect}")


def _local(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
        if "questions" in raw.columns:
            raw = raw.select(F.explode("questions").alias("q")).select("q.*")
    present = {c.lower(): c for c in raw.columns}
    def col(*names: str) -> Column:
        found = [F.nullif(F.col(present[n.lower()]).cast("string"), F.lit("")) for n in names if n.lower() in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    choice = next((present[n] for n in ("choices", "choice") if n in present), None)
    if choice is None:
        choices = F.lit(None).cast("array<string>")
    else:
        choices = F.col(choice) if dict(raw.dtypes)[choice].startswith("array") else parse_choices(F.col(choice))
    slide = col("slide_id", "long_id", "Slide", "Id")
    slide = F.when(slide.isNull(), F.raise_error(F.lit("a question names no slide"))).otherwise(slide)
    return _shaped(raw, {
        "slide_id": slide, "short_id": F.coalesce(col("short_id"), slide), "case_id": F.coalesce(col("case_id"), col("short_id"), F.split_part(slide, F.lit("_"), F.lit(1))),
        "question_id": col("question_id"), "question": col("question"), "question_type": col("question_type"), "difficulty": col("difficulty"),
        "evidence_tier": F.coalesce(col("evidence_tier"), F.lit("strict")), "choices": choices, "answer": F.coalesce(col("answer"), F.lit("")),
    })


def slides(spark: SparkSession, path: str) -> DataFrame:
    return require_unique(spark.read.schema(SLIDES).option("mode", "FAILFAST").json(path), ["slide_id"])


def tiles(spark: SparkSession, path: str, selected_only: bool = True) -> DataFrame:
    """Tiles at magnification 5; a row that says nothing is selected."""
    rows = spark.read.schema(TILES).option("mode", "FAILFAST").json(path)
    rows = rows.where(F.coalesce("selected", F.lit(True))) if selected_only else rows
    return require_unique(rows.withColumn("magnification", F.lit(5)), ["slide_id", "patch_id"])


def clean_manifest(spark: SparkSession, path: str) -> DataFrame:
    return require_unique(spark.read.schema(CLEAN).json(path), ["slide_id", "patch_id"])


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (slide_id, patch_id, description) of a JSON object of objects."""
    raw = spark.read.option("wholetext", True).text(path)
    slides_ = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("slide_id", "of"))
    return slides_.select("slide_id", F.explode("of").alias("patch_id", "description"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """Rows (slide_id, patch_id, features) of a Parquet table; a component that is null or not finite is an error."""
    rows = spark.read.parquet(path)
    sound = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("features", F.when(sound, F.col("features")).otherwise(F.raise_error(F.lit("features have to be finite"))))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, value) of a file of ``KEY=VALUE`` lines with comments, ``export`` and quotes."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pattern = r"^\s*(?:export\s+)?([^=\s]+)\s*=\s*(.*?)\s*$"
    value = F.regexp_replace(F.regexp_extract("value", pattern, 2), r"""^(["'])(.*)\1$""", "$2")
    name = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("not a setting: "), "value")))
    return lines.select(name.alias("name"), value.alias("value"))


#: Question types whose choices an ontology has to show.
QUESTION_TYPES = ("structure", "diagnosis", "differentiation")


def policy(contracts: str, ontology: str, versions: dict[str, str] | None = None) -> tuple[dict, dict]:
    """Contracts and ontology from JSON files, checked.

    ``versions`` are what their ``schema_version`` (keys ``contracts`` and
    ``ontology``) and ``term_matcher_version`` have to be, where given.  Every
    question type has concepts; every rule has feature groups that are not empty,
    a minimum among them, required groups that are there, and at least one tile.
    """
    held, shown = (json.loads(Path(p).read_text(encoding="utf-8")) for p in (contracts, ontology))
    found = {"contracts": held.get("schema_version"), "ontology": shown.get("schema_version"), "term_matcher_version": held.get("term_matcher_version")}
    for name, version in (versions or {}).items():
        if found[name] != version:
            raise ValueError(f"{name} is of version {found[name]}, not {version}")
    for kind in QUESTION_TYPES:
        if not ((shown.get("question_types") or {}).get(kind) or {}).get("option_concepts"):
            raise ValueError(f"the ontology has no concepts for {kind}")
    for name, rule in (held.get("visual_concept_contracts") or {}).items():
        groups = rule.get("feature_groups")
        if not isinstance(groups, list) or not groups or not all(groups):
            raise ValueError(f"contract {name} has no feature groups, or an empty one")
        if not 1 <= int(rule.get("minimum_feature_groups_per_patch", 0)) <= len(groups):
            raise ValueError(f"contract {name} asks for more groups than it has, or for none")
        if int(rule.get("minimum_clean_evidence_patches", 0)) < 1:
            raise ValueError(f"contract {name} asks for no tile")
        if any(not 0 <= int(g) < len(groups) for g in rule.get("required_anywhere_groups", [])):
            raise ValueError(f"contract {name} requires a group that it does not have")
    return held, shown


def concept_display(*names: Column) -> Column:
    """The first of a concept's names that is not empty; an empty text if there is none."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit(""))


def concepts(spark: SparkSession, ontology: dict) -> DataFrame:
    """Rows (question_type, concept, display) of the concepts that show the choices of a question type."""
    rows = [
        (kind, concept, *((ontology.get("concepts") or {}).get(concept, {}).get(n) for n in ("display_zh", "label_zh", "label")))
        for kind, of in (ontology.get("question_types") or {}).items() for concept in of.get("option_concepts") or []
    ]
    held = spark.createDataFrame(rows, "question_type string, concept string, a string, b string, c string")
    return held.select("question_type", "concept", concept_display(F.col("a"), F.col("b"), F.col("c")).alias("display")).where("display <> ''")


def relations(spark: SparkSession, contracts: dict) -> DataFrame:
    """Rows (concept, support, needs_zoom): which visual concept supports another one."""
    held = contracts.get("target_support_contracts") or {}
    rows = [(name, of.get("visual_support_concept"), bool(of.get("requires_zoom_confirmation", False))) for name, of in held.items()]
    return spark.createDataFrame(rows, "concept string, support string, needs_zoom boolean")
