"""URL filters: path rules, and a character language-model ratio for the rest.

DataFrame functions only.  Two smoothed Markov models of variable order over
folded characters, one of accepted and one of rejected URLs, are counted over
all rows.  A character is predicted from the longest context of up to ``ORDER``
characters that its model has seen; the more different characters have followed
it, the more weight the next shorter context has (Witten-Bell).  A URL's score
is the difference of its log-likelihoods under the two models, divided by its
length.

Hosts are dealt to ``FOLDS`` folds, and a URL is only ever scored by models that
have not counted its fold.  The threshold is calibrated on these scores: of all
thresholds it has the least sum of the share of rejected examples that pass and
``CAUTION`` times the share of accepted ones that do not, in the middle of the
widest gap that has it.

Examples of rejected URLs are those whose host has one of ``REJECTED_WORDS``, and
these words themselves, which are in the models of all folds.  The list ends
there: verdicts come from the score alone, for URLs with such a word and without.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import free_name, materialize

#: Words in host labels that make an example of a rejected URL.
REJECTED_WORDS = (
    "adult", "ads", "bet", "bets", "betting", "casino", "cheap", "click", "clickbait", "doorway", "escort", "farm", "free", "gamble", "gambling",
    "jackpot", "loan", "loans", "lottery", "malware", "payday", "phish", "phishing", "pill", "pills", "poker", "porn", "replica", "scam", "sex",
    "slots", "spam", "spammer", "track", "tracker", "tracking", "viagra", "warez", "win", "winner", "xxx",
)
#: Folded characters: a digit is 0, and what is not listed is none of them.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/"
SYMBOLS = len(ALPHABET) + 1
#: Characters of context, folds of hosts, weight of accepted examples that are blocked, and steps of a score to one.
ORDER, FOLDS, CAUTION, STEPS = 3, 4, 10, 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equally long ones the first in order), or null.

    A rule is a host and a path prefix, as in ``example.com/en/``; it fits that
    host and its subdomains.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r), reverse=False):
        of, _, prefix = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def symbols(text: Column) -> Column:
    """The numbers of a text's folded characters; 0 for others."""
    folded = F.translate(F.translate(text, _UPPER, _LOWER), "123456789", "000000000")
    return F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def has_rejected_word(host: Column, words: tuple[str, ...] = REJECTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-_]"), F.array(*map(F.lit, words)))


def ratio_model(examples: DataFrame) -> DataFrame:
    """One row with ``longest`` and ``shorter``: log-likelihood ratios, rejected to accepted, of runs of symbols under the models of every fold.

    ``examples`` has ``numbers`` (symbols), ``rejected`` and ``fold``; the models of
    a fold count the rows of the other folds and those without one.  ``longest``
    goes over folds and contexts of ``ORDER`` symbols and holds, for contexts that
    occur, the ratios of all symbols after them; ``shorter`` goes over folds and
    runs of ``ORDER`` symbols.  Their size is bounded whatever the input.
    """
    spark = examples.sparkSession
    runs = F.transform("numbers", lambda x, i: reduce(lambda code, back: code * SYMBOLS + F.when(i >= back, F.get("numbers", i - back)).otherwise(0), range(ORDER - 1, -1, -1), F.when(i >= ORDER, F.get("numbers", i - ORDER)).otherwise(0)))
    seen = examples.select("fold", "rejected", F.explode(runs).alias("run")).groupBy("fold", "run")
    seen = seen.agg(F.count(F.when(F.col("rejected"), 1)).alias("n1"), F.count(F.when(~F.col("rejected"), 1)).alias("n0"))
    folds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: F.coalesce(f != F.col("fold"), F.lit(True))))
    seen = materialize(seen.withColumn("model", folds).groupBy("model", "run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "url-counts")
    every = spark.range(FOLDS).select(F.col("id").cast("int").alias("model"))
    table = every.withColumns({"shorter": F.lit(0), "p0": F.lit(1.0 / SYMBOLS), "p1": F.lit(1.0 / SYMBOLS)})
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lower = None
    for order in range(ORDER + 1):
        contexts = SYMBOLS**order
        counts = seen.groupBy("model", (F.col("run") % (contexts * SYMBOLS)).alias("run")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        totals = counts.groupBy("model", F.floor(F.col("run") / SYMBOLS).cast("int").alias("context"))
        totals = totals.agg(*(f(f"n{c}").alias(f"{name}{c}") for c in (0, 1) for name, f in (("all", F.sum), ("kinds", lambda n: F.count(F.when(F.col(n) > 0, 1))))))
        known = every.withColumn("context", upto(contexts)).join(totals, ["model", "context"], "left") if order < ORDER else totals
        rows = known.withColumn("symbol", upto(SYMBOLS)).withColumn("run", F.col("context") * SYMBOLS + F.col("symbol"))
        rows = rows.withColumn("shorter", F.col("run") % contexts).join(counts, ["model", "run"], "left").na.fill(0).join(table, ["model", "shorter"])
        own = lambda c: F.when(F.col(f"all{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds{c}") * F.col(f"p{c}")) / (F.col(f"all{c}") + F.col(f"kinds{c}"))).otherwise(F.col(f"p{c}"))
        lower, table = table, materialize(rows.select("model", F.col("run").alias("shorter"), own(0).alias("p0"), own(1).alias("p1")), "url-order")
    in_order = lambda x, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, x.alias("x")))), lambda e: e["x"])
    ratio = F.log(F.col("p1") / F.col("p0")).cast("float")
    inner = table.groupBy("model", F.floor(F.col("shorter") / SYMBOLS).cast("int").alias("context")).agg(in_order(ratio, "shorter").alias("inner"))
    outer = every.withColumn("context", upto(SYMBOLS**ORDER)).join(inner, ["model", "context"], "left").agg(in_order(F.col("inner"), "model", "context").alias("longest"))
    return outer.withColumn("shorter", lower.agg(in_order(ratio, "model", "shorter").alias("x")).scalar())


def score(numbers: Column, fold: Column, longest: Column, shorter: Column) -> Column:
    """The length-normalised ratio under the models of ``fold``; 0 for an empty text."""
    contexts = SYMBOLS**ORDER
    ratio = lambda context, x: F.coalesce(
        F.get(F.get(longest, fold * contexts + context), x), F.get(shorter, fold * contexts + (context * SYMBOLS + x) % contexts)
    )
    state = lambda context, total: F.struct(context.cast("int").alias("context"), total.cast("double").alias("total"))
    total = F.aggregate(numbers, state(F.lit(0), F.lit(0.0)), lambda s, x: state((s["context"] * SYMBOLS + x) % contexts, s["total"] + ratio(s["context"], x)), lambda s: s["total"])
    return F.when(F.size(numbers) > 0, total / F.size(numbers)).otherwise(0.0)


def threshold(scored: DataFrame) -> DataFrame:
    """One row with ``threshold``, from rows (rejected, score); never below 0.  The window runs over the steps between scores, not over rows."""
    good, bad = F.count(F.when(~F.col("rejected"), 1)), F.count(F.when(F.col("rejected"), 1))
    steps = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(good.alias("good"), bad.alias("bad"))
    steps = steps.union(scored.sparkSession.range(1).select(F.lit(-1), F.lit(0), F.lit(0))).groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    order = Window.orderBy("step")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c, rows: F.coalesce(F.sum(c).over(rows) / F.nullif(F.sum(c).over(everything), F.lit(0)), F.lit(0.0))
    above = order.rowsBetween(1, Window.unboundedFollowing)
    after = F.coalesce(F.lead("step").over(order), F.col("step") + 2)
    steps = steps.select("step", after.alias("after"), (share("bad", order.rowsBetween(Window.unboundedPreceding, 0)) + CAUTION * share("good", above)).alias("cost"))
    best = F.min_by(F.struct("step", "after"), F.struct(F.round("cost", 12), F.col("step") - F.col("after"), "step"))
    return steps.agg(best.alias("best")).select(F.greatest((F.col("best.step") + 1 + F.col("best.after")) / (2.0 * STEPS), F.lit(0.0)).alias("threshold"))


def judge_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", words: tuple[str, ...] = REJECTED_WORDS) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict, one row for each row.

    ``rules`` maps rules to ``allow`` or ``block``; the longest rule that fits
    decides, and otherwise the score.  Null URLs, and URLs without ``://``, have
    empty host and path, fit no rule, and are allowed, as their score is 0 and
    the threshold is never below 0.  Repeated rows count as often as they stand.
    Columns of ``pages`` with the names of the results are replaced.
    """
    spark: SparkSession = pages.sparkSession
    drop = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "score", "verdict") and c != url]
    rows = pages.drop(*drop).withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    text, fold = symbols(F.concat("host", "path")), F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int")
    examples = rows.where("host <> ''").select(text.alias("numbers"), has_rejected_word(F.col("host"), words).alias("rejected"), fold.alias("fold"))
    seeds = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word")) if words else spark.range(0).select(F.lit("").alias("word"))
    seeds = seeds.select(symbols(F.col("word")).alias("numbers"), F.lit(True).alias("rejected"), F.lit(None).cast("int").alias("fold"))
    model = materialize(ratio_model(examples.union(seeds)), "url-model")
    held = {x: free_name(rows, x) for x in ("longest", "shorter")}
    models = {name: model.select(x).scalar() for x, name in held.items()}
    ratio = lambda numbers, of: score(numbers, of, *map(F.col, models))
    scored = examples.withColumns(models).select("rejected", ratio(F.col("numbers"), F.col("fold")).alias("score"))
    limit = materialize(threshold(scored), "url-threshold")
    judged = rows.withColumns(models).withColumn("score", ratio(text, fold)).drop(*models)
    by_rule = F.element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), F.col("rule")) if rules else F.lit(None).cast("string")
    by_score = F.when(F.col("score") > limit.scalar(), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(F.when(F.col("rule").isNotNull(), by_rule), by_score))
