"""The bounded decision loop over all questions and rollouts at once.

What a rollout has seen is a table with a row per tile, in order; the rows of a
question are never gathered but for the references of a reply and for what a
contract looks at, both bounded by the request that a model can read.  Each
attempt is one plan over the rollouts that are still open; its tables are kept in files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import kept, need_checkpoints
from tessella.functions.policy import INITIAL_RATIO, REPLENISH_RATIO, retrieval_count
from tessella.functions.text import fallback_choice
from tessella.functions.vectors import dot, unit
from tessella.operators import asking, decisions, evidence, focus, regions, retrieval, review
from tessella.operators.asking import Asking
from tessella.operators.calls import STOPPED, UNPAID, append_description
from tessella.operators.ledger import Ledger, fingerprint

KEY = ["question_id", "rollout_id"]
# Attempts, tiles described in one, characters of a request, parents and children of a closer look, and the first line of the evidence.
MOST_ATTEMPTS, MOST_DESCRIBED, MOST_CHARS, MOST_PARENTS, MOST_CHILDREN = 5, 5, 120_000, 2, 2
HEADER, SEPARATOR = "[Per-patch WSI evidence metadata]", "\n\n"
# What a first retrieval asks for besides the question.
INITIAL_TARGETS = (
    "Retrieve lesional H&E regions with direct abnormal morphology: architectural distortion, infiltrative atypical "
    "glands, desmoplastic stroma, papillary or pseudopapillary structures, solid tumor cells, mucin, necrosis, "
    "or a tumor-stroma interface."
)


# Why a rollout ended: its explanation, and what is said of an answer without support, plain and under a contract.
ENDINGS = {
    "no_additional_evidence": ("No additional patch evidence is available.", "No additional patch evidence is available.", "No additional evidence was available for contract_v1."),
    "context_budget_exceeded": ("The accumulated evidence exceeded the fixed Executor context budget.", "Executor context budget exceeded.", "Executor context budget exceeded before contract_v1 sufficiency."),
    "budget_exhausted": ("The action budget was exhausted before sufficient visible evidence was obtained.", "Action budget exhausted.", "Action budget exhausted without contract_v1 sufficiency."),
}
BUDGET_UNDER_CONTRACT = "The action budget was exhausted before unique cited contract support was obtained."
ABSTAINED = ("The Executor abstained before a unique contract pass.", "Executor abstained without contract_v1 sufficiency.")
#: How rollouts end whose request was not answered, or not sent.
FAILED, NOT_ASKED = "failed", "stopped"


def initial_query(question: Column) -> Column:
    """The text whose vector ranks the tiles for the first retrieval."""
    return F.concat(question, F.lit(" " + INITIAL_TARGETS))


@dataclass(frozen=True)
class World:
    """The tables that the loop looks things up in.

    ``tiles`` has slide_id, patch_id, x, y, w, h, vector, text and clean;
    ``observations`` of sub-regions slide_id, patch_id, x, y, w, h, tissue, white,
    padding, vector, text and clean; ``queries`` the key, attempt (0 is the first
    retrieval) and vector; ``replies`` the key, attempt and raw, unless somebody is
    asked for decisions (``decide``).  ``describe`` is asked for a text of each tile
    that a round looks at first.  ``vectors`` (vector_id, vector), if given, holds
    the vectors of the observations, which have a vector_id then.
    """

    tiles: DataFrame
    observations: DataFrame
    queries: DataFrame
    replies: DataFrame | None = None
    decide: Asking | None = None
    describe: Asking | None = None
    vectors: DataFrame | None = None


@dataclass(frozen=True)
class Contract:
    """What ``review.evaluate`` holds evidence against."""

    concepts: DataFrame
    relations: DataFrame
    rules: dict[str, dict]


@dataclass(frozen=True)
class State:
    """Between two attempts: the open rollouts, and their tiles.

    ``tiles`` has the key, patch_id, seq (the order in which tiles were taken; null
    for one that was only inspected), magnification, pos (its place in this round,
    or null), described, look (whether this round asks for a text), said (what
    was answered so far, or null) and chars (of its line of evidence with what
    separates it from the next; null without a text).
    """

    rollouts: DataFrame
    tiles: DataFrame

    @property
    def seen(self) -> DataFrame:
        return self.tiles.where("seq is not null")

    @property
    def fresh(self) -> DataFrame:
        return self.tiles.where("pos is not null")


def _ranked(rollouts: DataFrame, pool: DataFrame, queries: DataFrame, attempt: int) -> DataFrame:
    """``pool`` (key, slide_id, patch_id, vector) of ``rollouts``, without the vectors but with score and rank by the query of ``attempt``."""
    asked = kept(rollouts.select(*KEY).join(queries.where(F.col("attempt") == attempt).select(*KEY, unit(F.col("vector")).alias("asked")), KEY))
    scored = pool.join(retrieval.few(asked, retrieval.MAX_BROADCAST_QUERIES), KEY).withColumn("score", dot(F.col("vector"), F.col("asked"))).drop("asked", "vector")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "patch_id")))


def _take(rollouts: DataFrame, seen: DataFrame, tiles: retrieval.Grouped, queries: DataFrame, attempt: int, ratio: float) -> DataFrame:
    """The next tiles of each rollout (with ``n_seen``) by the query of ``attempt``, as rows for ``_next``.

    Every different query of a slide is scored once, block by block.  What a rollout
    may take is among as many of the best as it takes and has seen; only these leave
    the blocks, and are ranked within score ranges (``retrieval.ranked_to``).
    """
    asked = rollouts.select(*KEY, "slide_id", "n", "n_seen").join(queries.where(F.col("attempt") == attempt).select(*KEY, "vector"), KEY)
    asked = kept(asked.withColumns({"ask": F.xxhash64("slide_id", "vector"), "k": retrieval_count(F.col("n"), ratio)}).where("k > 0"))
    asks = asked.groupBy("slide_id", F.col("ask").alias("query_id")).agg(F.first("vector").alias("vector"), F.max(F.col("k") + F.col("n_seen")).alias("need"))
    best = retrieval.nearest(tiles, asks.select("slide_id", "query_id", unit(F.col("vector")).alias("query"), "need"))
    mine = retrieval.few(asked.select(*KEY, "n", "k", F.col("ask").alias("query_id")))
    pool = best.join(mine.select(*KEY, "query_id"), "query_id").select(*KEY, F.col("id.patch_id").alias("id"), "score", "id.chars")
    pool = pool.join(seen.join(mine.select(*KEY), KEY, "left_semi").select(*KEY, F.col("patch_id").alias("id")), [*KEY, "id"], "left_anti")
    best = retrieval.ranked_to(pool, mine.select(*KEY, "n", "k"), KEY)
    return best.select(*KEY, F.col("id").alias("patch_id"), F.col("rank").cast("int").alias("pos"), F.lit(5).alias("magnification"), F.lit(True).alias("taken"), F.lit(False).alias("described"), F.lit(False).alias("look"), "chars")


_ROUND = "patch_id string, pos int, magnification int, taken boolean, described boolean, look boolean, chars long"


def _next(tiles: DataFrame, new: DataFrame) -> DataFrame:
    """The tiles after a round that ``new`` (key, patch_id, pos, magnification, taken, described, look, chars) follows; those taken go after all others."""
    last = tiles.groupBy(*KEY).agg(F.max("seq").alias("last"))
    before = tiles.withColumn("described", F.col("described") | (F.coalesce("pos", F.lit(MOST_DESCRIBED + 1)) <= MOST_DESCRIBED)).drop("pos", "look")
    new = new.withColumnsRenamed({"magnification": "new_magnification", "described": "new_described", "chars": "new_chars"}).join(last, KEY, "left")
    out = before.join(new, [*KEY, "patch_id"], "full")
    seq = F.coalesce("seq", F.when(F.col("taken"), F.coalesce("last", F.lit(0)) + F.col("pos"))).cast("long")
    was = F.coalesce("described", F.lit(False))
    look = F.coalesce("look", F.lit(False)) | (F.coalesce("pos", F.lit(MOST_DESCRIBED + 1)) <= MOST_DESCRIBED) & ~was
    return out.select(*KEY, "patch_id", seq.alias("seq"), F.coalesce("magnification", "new_magnification").alias("magnification"), "pos", (was | F.coalesce("new_described", F.lit(False))).alias("described"), look.alias("look"), "said", F.coalesce("chars", "new_chars").alias("chars"))


def _line(magnification: str | int) -> Column:
    """The line of evidence of a tile (patch_id, x, y, text)."""
    shown = F.col(magnification) if isinstance(magnification, str) else F.lit(magnification)
    return evidence.tile_line(F.col("patch_id"), F.col("x"), F.col("y"), shown, F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("text"))


def _chars(magnification: str | int) -> Column:
    """What the line of a tile adds to a request, or null."""
    return F.when(F.trim("text") != "", F.length(_line(magnification)) + len(SEPARATOR)).cast("long").alias("chars")


def _known(world: World, of: DataFrame) -> DataFrame:
    """slide_id, patch_id, x, y and text of the tiles and sub-regions that ``of`` (slide_id, patch_id; kept) names."""
    columns = ["slide_id", "patch_id", "x", "y", "text"]
    return world.tiles.select(*columns).unionByName(world.observations.select(*columns)).join(retrieval.few(of.select("slide_id", "patch_id")), ["slide_id", "patch_id"], "left_semi")


def _lines(rollouts: DataFrame, seen: DataFrame, world: World) -> DataFrame:
    """The tiles of ``seen`` that have a text, with all that evidence needs of them."""
    columns = ["slide_id", "patch_id", "x", "y", "w", "h", "clean", "text"]
    known = world.tiles.select(*columns).unionByName(world.observations.select(*columns))
    out = seen.join(rollouts.select(*KEY, "slide_id"), KEY).join(known, ["slide_id", "patch_id"])
    out = out.withColumn("text", F.when(F.col("said").isNotNull(), append_description(F.col("text"), F.col("said"))).otherwise(F.col("text")))
    return out.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def _described(state: State, world: World) -> State:
    """The state after the tiles that this round looks at were described; equal looks at a tile are asked for once, one that a reply named (``targeted``) besides that of its round."""
    looked = state.tiles.where("look").join(state.rollouts.select(*KEY, "slide_id"), KEY)
    request = F.to_json(F.struct("slide_id", "patch_id", "magnification", F.col("described").alias("targeted"))).alias("request")
    told = asking.ask(looked.select(*KEY, "patch_id", request), [*KEY, "patch_id"], world.describe, "description", parses=False)
    new = told.where("reply is not null").select(*KEY, "patch_id", F.col("reply").alias("new"))
    said = F.when(F.col("new").isNotNull(), append_description(F.col("said"), F.col("new"))).otherwise(F.col("said"))
    tiles = kept(state.tiles.join(new, [*KEY, "patch_id"], "left").withColumn("said", said))
    longer = _lines(state.rollouts, tiles.where("new is not null"), world).select(*KEY, "patch_id", _chars("magnification").alias("longer"))
    return State(state.rollouts, kept(tiles.drop("new").join(longer, [*KEY, "patch_id"], "left").withColumn("chars", F.coalesce("longer", "chars")).drop("longer")))


def _decided(now: DataFrame, lines: DataFrame, line: Column, world: World) -> DataFrame:
    """Rows (key, raw, status) for the rollouts ``now``, whose evidence fits a request."""
    texts = evidence.ordered_join(lines.join(now.select(*KEY), KEY, "left_semi"), KEY, ["seq"], line, SEPARATOR, "evidence")  # of at most a request's characters
    asked = now.select(*KEY, "question", "choices", "attempt").join(texts, KEY, "left")
    said = F.concat_ws("\n", F.lit(HEADER), "evidence")
    request = F.to_json(F.struct("question", "choices", "attempt", "rollout_id", said.alias("evidence"))).alias("request")
    return asking.ask(asked.select(*KEY, request), KEY, world.decide, "decision", parses=True).withColumnRenamed("reply", "raw")


#: What an evaluation says of a candidate, with its type.
EVALUATED = {
    "differential": "array<string>", "valid_refs": "array<string>", "supporting": "array<string>", "opposing": "array<string>", "missing": "array<string>", "candidate_evidence_found": "boolean", "ready": "boolean",
    "strict": "boolean", "evidence_found": "boolean", "citation_valid": "boolean", "supports_answer": "boolean",
}
_EVALUATION = f"struct<{','.join(f'{n}:{t}' for n, t in EVALUATED.items())}>"


def _gate(now: DataFrame, lines: DataFrame, contract: Contract) -> DataFrame:
    """``now`` after its evidence was held against the contract: what passes answers, an answer that does not pass goes on searching."""
    name = F.concat_ws("\0", *(F.col(c).cast("string") for c in KEY)).alias("question_id")
    visible = lines.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "patch_id"))), lambda s: s["patch_id"]).alias("visible"))
    asked = now.join(visible, KEY, "left").select(
        name, "question_type", "choices", F.col("answer").alias("candidate"), "tier", F.coalesce("visible", F.array().cast("array<string>")).alias("visible"),
        F.col("all_refs").alias("refs"), F.col("differential").alias("ranked"),
    )
    found = review.evaluate(asked, lines.select(name, "patch_id", "text", "clean", "magnification", "x", "y", "w", "h"), contract.concepts, contract.relations, contract.rules)
    shown = F.struct(*(F.col(c) for c in EVALUATED)).alias("evaluation")
    found = found.select(F.col("question_id").alias("name"), "strict", "unique_visible", F.col("support_score").alias("support"), F.col("valid_refs").alias("cited"), shown)
    out = now.withColumn("name", name).join(found, "name", "left").drop("name")
    strict = F.coalesce("strict", F.lit(False))
    stable = F.when(F.col("answer").eqNullSafe(F.col("last_answer")), F.col("stability") + 1).otherwise(1)
    mine = F.struct(F.coalesce("support", F.lit(0.0)).alias("support"), stable.alias("stability"), F.col("attempt").alias("attempt"), F.col("answer").alias("answer"), F.coalesce("cited", F.array().cast("array<string>")).alias("refs"), F.col("summary"), F.col("unsupported_reason").alias("reason"), F.col("evaluation"))
    rank = lambda s: F.struct(s["support"], s["stability"])
    best = F.when(F.col("best").isNull() | (rank(mine) > rank(F.col("best"))), mine).otherwise(F.col("best"))
    lacking = ~strict & (F.col("action") == "answer")
    searching = F.when(F.col("left") > 0, "retrieve").otherwise("abstain")
    return out.withColumns({
        "best": best, "stability": stable, "last_answer": F.col("answer"), "sufficient": strict,
        "action": F.when(strict, "answer").when(lacking, searching).otherwise(F.col("action")),
        "answer": F.when(strict, F.col("unique_visible")).otherwise(F.col("answer")), "targets": F.when(strict | lacking, F.array().cast("array<string>")).otherwise(F.col("targets")),
        "repairs": F.concat("repairs", F.filter(F.array(F.when(strict & (F.col("action") != "answer"), "deterministic_contract_passed"), F.when(lacking, "model_answer_lacked_contract_support")), lambda r: r.isNotNull())),
    }).drop("strict", "unique_visible", "support", "cited")


def _zoom(now: DataFrame, state: State, world: World, attempt: int) -> DataFrame:
    """Sub-regions of the best parents, ranked, with ``chosen``."""
    asked = now.where("step = 'zoom'").select(*KEY, "slide_id", "targets", decisions.focus_magnification(F.col("magnification")).alias("target"))
    asked = kept(asked)
    named = retrieval.few(kept(asked.select(*KEY, "slide_id", "target", F.explode(F.array_distinct("targets")).alias("patch_id"))))
    named = kept(state.seen.where("magnification = 5").select(*KEY, "patch_id").join(named, [*KEY, "patch_id"]))
    others = retrieval.few(kept(asked.join(named.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "slide_id", "target")))
    others = state.fresh.where("seq is not null and magnification = 5").select(*KEY, "patch_id").join(others, KEY)
    parents = named.unionByName(others).join(world.tiles.select("slide_id", "patch_id", "x", "y", "w", "h", "vector"), ["slide_id", "patch_id"])
    parents = kept(_ranked(asked, parents, world.queries, attempt).where(F.col("rank") <= MOST_PARENTS).drop("score").withColumnsRenamed({"patch_id": "parent_patch_id", "rank": "parent_rank"}))
    places = []
    for target in regions.MAGNIFICATIONS:
        some = parents.where(F.col("target") == target).select("slide_id", F.col("parent_patch_id").alias("patch_id"), "x", "y", "w", "h").distinct()
        places.append(regions.children(some, target))
    held = reduce(DataFrame.unionByName, places).select("slide_id", "patch_id", "parent_patch_id", F.col("magnification").alias("target"), "x", "y")
    candidates = kept(parents.select(*KEY, "slide_id", "parent_patch_id", "target", "parent_rank").join(held, ["slide_id", "parent_patch_id", "target"]))
    wanted = retrieval.few(kept(candidates.select("slide_id", "patch_id").distinct()))
    observed = world.observations.select("slide_id", "patch_id", F.col("x").alias("at_x"), F.col("y").alias("at_y"), "text", "tissue", "white", "padding", "vector" if world.vectors is None else "vector_id").join(wanted, ["slide_id", "patch_id"])
    if world.vectors is not None:
        observed = world.vectors.select("vector_id", "vector").join(retrieval.few(kept(observed)), "vector_id").drop("vector_id")
    candidates = candidates.join(observed, ["slide_id", "patch_id"]).withColumn("vector", unit(F.col("vector")))
    candidates = _ranked(asked, candidates, world.queries, attempt).drop("rank")
    candidates = candidates.withColumn("kind", focus.candidate_class(F.col("tissue"), F.col("white"))).withColumn("index", F.struct("parent_rank", "y", "x"))
    chosen = focus.rank_candidates(candidates, KEY, top_k=MOST_CHILDREN).withColumns({"x": F.col("at_x"), "y": F.col("at_y")})
    return chosen.select(*KEY, "patch_id", "eligible_rank", "target", "chosen", _chars("target"))


def _inspected(going: DataFrame, state: State, world: World) -> DataFrame:
    """The tiles with a text that rollouts name, or else the first of their round, as rows for ``_next``."""
    asked = going.where("step = 'inspect'")
    named = kept(asked.select(*KEY, "slide_id", F.posexplode(F.array_distinct("targets")).alias("pos", "patch_id")))
    held = _known(world, kept(named.select("slide_id", "patch_id").distinct())).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    held = held.select("slide_id", "patch_id", _chars(5)).withColumn("held", F.lit(True)).dropDuplicates(["slide_id", "patch_id"])
    told = state.tiles.where("said is not null").select(*KEY, "patch_id").withColumn("told", F.lit(True))
    named = named.join(held, ["slide_id", "patch_id"], "left").join(told, [*KEY, "patch_id"], "left").where("held or told").select(*KEY, "patch_id", (F.col("pos") + 1).alias("pos"), "chars")
    named = kept(named)
    first = state.fresh.where("pos = 1").join(asked.join(named.select(*KEY).distinct(), KEY, "left_anti"), KEY, "left_semi").select(*KEY, "patch_id", "pos", F.lit(None).cast("long").alias("chars"))
    return named.unionByName(first).select(*KEY, "patch_id", "pos", F.lit(5).alias("magnification"), F.lit(False).alias("taken"), F.lit(True).alias("described"), F.lit(True).alias("look"), "chars")


def _attempt(state: State, world: World, pool: retrieval.Grouped, attempt: int, last: bool, contract: Contract | None, most_chars: int | None) -> tuple[State, DataFrame, DataFrame]:
    """The state after one attempt, the rollouts that ended in it, and a row for each that took part."""
    if world.describe is not None:
        state = _described(state, world)
    lines = _lines(state.rollouts, state.seen, world)  # read where somebody is asked, and under a contract
    number = lambda condition, name: F.count_if(condition).cast("long").alias(name)
    chars = F.sum(F.when(F.col("seq").isNotNull(), F.col("chars"))) + len(HEADER)
    counts = state.tiles.groupBy(*KEY).agg(
        number(F.col("pos").isNotNull(), "n_fresh"), number((F.col("pos") <= MOST_DESCRIBED) & ~F.col("described"), "n_described"),
        number(F.col("seq").isNotNull(), "n_seen"), number(F.col("seq").isNotNull() & (F.col("magnification") == 5), "n_taken"), chars.alias("chars"),
    )
    now = state.rollouts.join(counts, KEY, "left")
    now = now.na.fill(0, ["n_fresh", "n_described", "n_seen", "n_taken"]).na.fill(len(HEADER), ["chars"]).withColumn("left", F.col("n") - F.col("n_taken")).withColumn("attempt", F.lit(attempt))
    long = F.lit(False) if most_chars is None else F.col("chars") > most_chars
    fits = (F.col("n_fresh") > 0) & ~long
    if world.decide is None:
        reply = world.replies.where(F.col("attempt") == attempt).select(*KEY, "raw", F.lit(200).alias("status")).dropDuplicates(KEY)
    else:
        now = kept(now)
        reply = _decided(now.where(fits), lines, _line("magnification"), world)
    now = now.join(reply, KEY, "left").withColumn("failure", F.when(fits & F.col("raw").isNull(), F.when(F.col("status").isin(STOPPED, UNPAID), NOT_ASKED).otherwise(FAILED))).drop("status")
    now = kept(decisions.normalize(now).drop("raw").withColumn("evaluation", F.lit(None).cast(_EVALUATION)))
    refs = retrieval.few(kept(now.select(*KEY, F.posexplode("refs").alias("pos", "patch_id"))))
    refs = state.seen.where("chars is not null").select(*KEY, "patch_id").join(refs, [*KEY, "patch_id"])
    refs = refs.groupBy(*KEY, "patch_id").agg(F.min("pos").alias("pos")).groupBy(*KEY)
    refs = refs.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "patch_id"))), lambda r: r["patch_id"]), 1, decisions.MOST_REFS).alias("visible_refs"))
    now = now.withColumnRenamed("refs", "all_refs").join(refs, KEY, "left").withColumn("refs", F.coalesce("visible_refs", F.array().cast("array<string>"))).drop("visible_refs")
    if contract is not None:
        answered = fits & F.col("failure").isNull()
        inside = kept(now.where(answered))
        gated = _gate(inside.drop("evaluation"), lines.join(inside.select(*KEY), KEY, "left_semi"), contract)
        now = gated.unionByName(now.where(~answered))
    action = decisions.one_focus(F.col("action"), F.col("focus"), F.col("left"))
    step = F.when(F.col("n_fresh") == 0, "no_additional_evidence").when(long, "context_budget_exceeded").otherwise(F.coalesce("failure", action))
    now = now.withColumn("step", step)
    ending = F.when(F.col("step") == "answer", "answered").when(F.col("step") == "abstain", "abstained").when(F.col("step").isin("no_additional_evidence", "context_budget_exceeded", FAILED, NOT_ASKED), F.col("step"))
    now = kept(now.withColumn("ending", F.coalesce(ending, F.lit("budget_exhausted") if last else F.lit(None))))

    ended, going = now.where("ending is not null"), now.where("ending is null")
    told = now.select(*KEY, "attempt", F.col("step"), "n_fresh", "n_described", "n_seen", "chars", "ending")
    steps = {r["step"] for r in going.select("step").distinct().collect()}
    if not steps:
        return State(going.select(*state.rollouts.columns), state.tiles), ended, told
    new = _keys(going).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _ROUND.split(", ")}).limit(0)
    tiles = state.tiles.join(retrieval.few(_keys(going)), KEY, "left_semi")
    rollouts = going.withColumn("repairs_before", F.concat("repairs_before", "repairs"))
    if "retrieve" in steps:
        new = new.unionByName(_take(going.where("step = 'retrieve' and left > 0"), state.seen, pool, world.queries, attempt, REPLENISH_RATIO))
    if "inspect" in steps:
        new = new.unionByName(_inspected(going, state, world))
    if "zoom" in steps:
        zoomed = kept(_zoom(going, state, world, attempt))
        new = new.unionByName(zoomed.where("chosen").select(*KEY, "patch_id", F.col("eligible_rank").alias("pos"), F.col("target").cast("int").alias("magnification"), F.lit(True).alias("taken"), F.lit(True).alias("described"), F.lit(True).alias("look"), "chars"))
        rollouts = rollouts.join(zoomed.select(*KEY).distinct().withColumn("tried", F.lit(1)), KEY, "left").withColumn("focus", F.col("focus") + F.coalesce("tried", F.lit(0)))
    return State(kept(rollouts.select(*state.rollouts.columns)), kept(_next(tiles, new))), ended, told


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY)


def _outcome(ended: DataFrame, contract: Contract | None) -> DataFrame:
    """The final answers of the rollouts in ``ended``, and why."""
    ending, none = F.col("ending"), F.array().cast("array<string>")
    failed, answered = ending.isin(FAILED, NOT_ASKED), ending == "answered"
    nothing = ending.isin("no_additional_evidence", "context_budget_exceeded")
    missing = F.trim(F.coalesce("missing_evidence", F.lit("")))
    unexplained = F.coalesce(F.nullif(F.col("action_reason"), F.lit("")), missing)
    of = lambda i: reduce(lambda c, e: c.when(ending == e[0], e[1][i]), ENDINGS.items(), F.when(F.lit(False), ""))
    answer = F.when(nothing, fallback_choice(F.col("choices"))).otherwise(F.col("answer"))
    refs = F.when(nothing, none).when(answered, F.slice("refs", 1, decisions.MOST_ANSWER_REFS)).otherwise(F.col("refs"))
    explanation = F.when(answered, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("action_reason"))).when(ending == "abstained", unexplained).otherwise(of(0))
    said = F.nullif(F.col("unsupported_reason"), F.lit(""))
    reason = F.when(answered, F.col("unsupported_reason")).when(ending == "abstained", F.coalesce(said, missing)).when(ending == "budget_exhausted", F.coalesce(said, of(1))).otherwise(of(1))
    status = F.when(ending == "context_budget_exceeded", ending).when(failed, "executor_api_failure").when(ending == "no_additional_evidence", None).otherwise(F.col("parse_status"))
    held, attempt = F.col("evaluation"), F.when(answered, F.col("attempt"))
    abstain = F.when(answered, F.col("abstain_recommended")).otherwise(True)
    if contract is not None:
        best = F.col("best")
        first = fallback_choice(F.col("choices"))
        detail = F.when(ending == "abstained", F.coalesce(said, F.nullif(missing, F.lit("")), F.lit(ABSTAINED[1]))).otherwise(of(2))
        told = F.when(ending == "abstained", F.coalesce(F.nullif(F.col("action_reason"), F.lit("")), F.nullif(missing, F.lit("")), F.lit(ABSTAINED[0]))).when(ending == "budget_exhausted", BUDGET_UNDER_CONTRACT).otherwise(of(0))
        answer, refs = F.when(answered, answer).otherwise(F.coalesce(best["answer"], first)), F.when(answered, refs).otherwise(F.coalesce(best["refs"], none))
        explanation = F.when(answered, explanation).otherwise(F.coalesce(F.nullif(best["summary"], F.lit("")), told))
        reason = F.when(answered, reason).otherwise(F.coalesce(F.nullif(best["reason"], F.lit("")), detail))
        status = F.when(answered | failed, status).when(ending == "context_budget_exceeded", ending).otherwise(review.BEST_CANDIDATE)
        held, attempt = F.when(answered, held).otherwise(best["evaluation"]), F.when(answered, attempt).otherwise(best["attempt"])
        abstain = F.when(answered, F.lit(False)).otherwise(True)
    sufficient = answered & F.col("sufficient")
    unless = lambda c: F.when(~failed, c)
    out = ended.select(
        *KEY, F.col("attempt").alias("attempts"), "ending", unless(answer).alias("answer"), F.when(failed, none).otherwise(refs).alias("refs"), (~failed & sufficient).alias("sufficient"), F.col("n_seen").alias("seen"), "focus",
        F.concat("repairs_before", "repairs").alias("repairs"), unless(explanation).alias("explanation"), unless(reason).alias("unsupported_reason"), unless(abstain).alias("abstain_recommended"), status.alias("parse_status"),
        unless(attempt).alias("selected_attempt"), unless(held).alias("evaluation"),
    )
    return out.withColumn("shown", F.when(~failed, _public(F.col("answer"), F.col("evaluation"))) if contract is not None else F.lit(None).cast(_PUBLIC))


_PUBLIC = (
    "struct<provisional_recommendation:string,ranked_differential:array<string>,cited_patches:array<string>,supporting_evidence:array<string>,opposing_or_conflicting_evidence:array<string>,"
    "missing_evidence:array<string>,candidate_evidence_found:boolean,ready_for_pathologist_review:boolean,strict_evidence_sufficient:boolean,review_required:boolean,review_reason:string,"
    "contract_version:string,output_schema_version:string>"
)


def _public(answer: Column, held: Column) -> Column:
    """The 13 fields that are shown of an answer."""
    return F.struct(*review.shown_fields(answer, lambda name: held[name])).cast(_PUBLIC)


def _manifest(questions: DataFrame, world: World, contract: Contract | None, attempts: int, most_chars: int | None) -> dict:
    """What a run is started with, as digests."""
    tables = {"questions": questions, "tiles": world.tiles, "observations": world.observations, "vectors": world.vectors, "queries": world.queries, "replies": world.replies, "concepts": contract and contract.concepts, "relations": contract and contract.relations}
    return {**{n: fingerprint(t) for n, t in tables.items() if t is not None}, "rules": contract and contract.rules, "attempts": attempts, "most_chars": most_chars, "asks": [world.decide is not None, world.describe is not None]}


def run(questions: DataFrame, world: World, contract: Contract | None = None, attempts: int = MOST_ATTEMPTS, most_chars: int | None = MOST_CHARS, after: Callable[[int, State], None] | None = None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the loop; the outcomes and the steps.

    ``questions`` has the key, slide_id, question, question_type, tier and choices.
    Outcomes: the key, attempts, ending, answer, refs, sufficient, seen, focus,
    repairs, explanation, unsupported_reason, abstain_recommended, parse_status,
    selected_attempt, and under a contract the evaluation of the answer and the 13
    fields that are shown of it.  Steps: the key, attempt, step, how many tiles
    were new, newly described and seen, the characters of the evidence, and the ending.

    A first retrieval takes a tenth of the slide's tiles and each further one a
    twentieth of all.  Nothing new, and evidence beyond ``most_chars`` (null: of any
    length, where replies are a table and nobody reads a request), end a rollout; the last attempt does so unless it answers or abstains.  A request
    that is not answered ends its rollout as failed, without an answer; once
    failures stop the batch, or its money is spent, open rollouts end as stopped.
    With a ``contract`` only what passes it is an answer, and other endings give
    the best candidate so far.  One closer look is taken: at most two children, by
    gated rank, of the two best parents.  ``after`` sees the state after each attempt.

    With a ``ledger`` (a folder that all executors share) every attempt is
    committed there, and a run that is started again with the same tables and
    parameters goes on after the last one.  Other tables or parameters, missing
    tables and failed rollouts are errors then.
    """
    if most_chars is None and world.decide is not None:
        raise ValueError("requests that somebody reads need most_chars")
    spark = questions.sparkSession
    need_checkpoints(spark)
    held = Ledger(spark, ledger) if ledger else None
    if held:
        held.begin(_manifest(questions, world, contract, attempts, most_chars))

    outcomes: list[DataFrame] = []
    steps: list[DataFrame] = []

    def told(tables: dict[str, DataFrame]) -> State:
        if "outcomes" in tables:
            outcomes.append(tables["outcomes"])
            steps.append(tables["steps"])
        return State(tables["rollouts"], tables["tiles"])

    def committed(attempt: int, tables: dict[str, DataFrame]) -> State:
        return told(held.commit(attempt, tables) if held else tables)

    done, state = 0, None
    while held and (back := held.load(done)):
        state, done = told(back), done + 1
    if outcomes and (bad := reduce(DataFrame.unionByName, outcomes).where(F.col("ending").isin(FAILED, NOT_ASKED)).select(*KEY).head(1)):
        raise ValueError(f"{ledger} holds failed rollouts, such as {bad[0].asDict()}; it cannot be gone on with")
    pool = retrieval.grouped(world.tiles.select("slide_id", F.struct("patch_id", _chars(5)).alias("id"), "vector"), "slide_id")
    if state is None:
        n = world.tiles.groupBy("slide_id").agg(F.count("*").alias("n"))
        best = f"struct<support:double,stability:int,attempt:int,answer:string,refs:array<string>,summary:string,reason:string,evaluation:{_EVALUATION}>"
        rollouts = questions.select(*KEY, "slide_id", "question", "question_type", "tier", "choices").join(n, "slide_id", "left").na.fill(0, ["n"])
        rollouts = kept(rollouts.withColumns({"focus": F.lit(0), "stability": F.lit(0), "last_answer": F.lit(None).cast("string"), "best": F.lit(None).cast(best), "repairs_before": F.array().cast("array<string>")}))
        empty = {"patch_id": F.lit(""), "seq": F.lit(0).cast("long"), "magnification": F.lit(0), "pos": F.lit(0), "described": F.lit(False), "look": F.lit(False), "said": F.lit(None).cast("string"), "chars": F.lit(None).cast("long")}
        nothing = rollouts.limit(0).select(*KEY, *(c.alias(k) for k, c in empty.items()))
        state, done = committed(0, {"rollouts": rollouts, "tiles": kept(_next(nothing, _take(rollouts.withColumn("n_seen", F.lit(0)), nothing, pool, world.queries, 0, INITIAL_RATIO)))}), 1
    for attempt in range(done, attempts + 1):
        if outcomes and state.rollouts.isEmpty():
            break
        state, ended, stepped = _attempt(state, world, pool, attempt, attempt == attempts, contract, most_chars)
        state = committed(attempt, {"rollouts": state.rollouts, "tiles": state.tiles, "outcomes": _outcome(ended, contract), "steps": stepped})
        if after:
            after(attempt, state)
    return reduce(DataFrame.unionByName, outcomes), reduce(DataFrame.unionByName, steps)
