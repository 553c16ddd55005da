"""A Merkle manifest of a table: one tree of digests for each group of rows, and one over the groups.

Rows are put in order once, which numbers the leaves of every tree; from then on
a node is known by (tree, level, index), and the number of leaves tells how many
children every node has.  What any part of the table knows about the trees is a
sparse forest: the nodes whose siblings it has not met.  Two forests are merged
by uniting them and replacing each complete run of siblings by its parent, which
is associative and commutative, so parts may be merged in any shape.  Every task
folds its leaves into such a forest of a few nodes.  Forests of many tasks are
merged by spans of leaves, whose groups are bounded, until few nodes are left;
those are merged by ``treeReduce``.

Proofs go the other way: leaves are grouped by spans of 2**SPAN, each group makes
its own part of a path, and takes the part above from the nodes at the levels
that are multiples of SPAN, which the way up has kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import broadcast_if_few, materialize, prepare

#: Levels of a span; a group of a span holds 2**SPAN nodes.
SPAN = 10
#: Unresolved nodes that may be merged by ``treeReduce``: about 20 MB.
MAX_NODES = 100_000
#: Trees whose digests may be broadcast: about 20 MB.
MAX_TREES = 100_000
ARITY = 2
NODE = "tree string, n long, level int, index long, digest string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: every field as its length in UTF-8 bytes, a colon and its text, or ``-`` if it is null."""
    parts = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*parts), 256)


def width(n: int, level: int) -> int:
    """Nodes at a level of a tree of ``n`` leaves."""
    return -(-n >> level) if level else n


def height(n: int) -> int:
    """The level of the root."""
    return (n - 1).bit_length()


class Forest:
    """Nodes of any trees whose siblings have not been met, and the nodes that were kept on the way."""

    def __init__(self, span: int = SPAN):
        self.span = span
        self.leaves: dict[str, int] = {}
        self.open: dict[tuple[str, int], dict[int, str]] = {}
        self.kept: list[tuple[str, int, int, int, str]] = []

    def add(self, nodes: Iterable[tuple[str, int, int, int, str]]) -> Forest:
        """Take in nodes (tree, leaves of the tree, level, index, digest)."""
        for tree, n, level, index, digest in nodes:
            self.leaves[tree] = n
            self.open.setdefault((tree, level), {})[index] = digest
        return self

    def resolve(self) -> Forest:
        """Replace every complete run of siblings by its parent."""
        for tree, n in self.leaves.items():
            for level in range(height(n)):
                at, last = self.open.get((tree, level)), width(n, level) - 1
                if not at:
                    continue
                for index in [i for i in at if i % ARITY == 0]:
                    if index < last and index + 1 not in at:
                        continue
                    run = [at.pop(index)] if index == last else [at.pop(index), at.pop(index + 1)]
                    parent = digest_of(*run)
                    self.open.setdefault((tree, level + 1), {})[index // ARITY] = parent
                    if (level + 1) % self.span == 0:
                        self.kept.append((tree, n, level + 1, index // ARITY, parent))
        return self

    def unresolved(self) -> list[tuple[str, int, int, int, str]]:
        return [(tree, self.leaves[tree], level, i, d) for (tree, level), at in self.open.items() for i, d in at.items()]

    def merge(self, other: Forest) -> Forest:
        self.kept += other.kept
        return self.add(other.unresolved()).resolve()


def _table(forest: Forest) -> pa.Table:
    rows = [(*node, False) for node in forest.unresolved()] + [(*node, True) for node in forest.kept]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["tree", "n", "level", "index", "digest", "kept"])


def _nodes(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in ("tree", "n", "level", "index", "digest")))


def numbered(df: DataFrame, tree: Column, order: list[Column], digest: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with tree, index (from 0 in the order of a tree) and n (rows of the tree); and rows (tree, n).

    Rows are sorted by ranges, so a tree with very many of them is spread over
    many tasks; numbers are places in a task and counts of the tasks before.
    Rows that are equal in ``order`` are put in the order of their digests.
    """
    keyed = df.withColumn("tree", tree).withColumn("at", F.monotonically_increasing_id())
    by = [F.col("tree"), *order, F.col(digest), F.col("at")]
    placed = materialize(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    runs = materialize(placed.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("rows")), "runs")
    before = F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(runs.groupBy("tree").agg(F.sum("rows").alias("n")), "sizes")
    shift = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")).join(broadcast_if_few(sizes, MAX_TREES), "tree")
    shift = broadcast_if_few(materialize(shift, "shifts"), MAX_TREES)
    out = placed.withColumn("part", part).join(shift, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift"))
    return out.drop("at", "part", "shift"), sizes


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (tree, n, level, index, digest): the roots of all trees of ``leaves`` (tree, n, index, digest), and the kept nodes; and the highest level of a root."""
    spark, floor = leaves.sparkSession, SPAN
    schema = NODE + ", kept boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(floor)  # of the leaves of a task, whatever leaves these are
        for batch in batches:
            forest.add(_nodes(batch)).resolve()
        yield from _table(forest).to_batches()

    found = materialize(leaves.select("tree", "n", F.lit(0).alias("level"), "index", "digest").mapInArrow(fold, schema), "forest")
    kept, open_nodes, span = found.where("kept").drop("kept"), found.where("not kept").drop("kept"), 0
    tallest = height(found.agg(F.max("n")).first()[0] or 1)

    def merged(group: pa.Table) -> pa.Table:
        return _table(Forest(floor).add(_nodes(group)).resolve())

    while span < tallest and open_nodes.count() > MAX_NODES:
        span += floor
        within = F.greatest(F.lit(0), F.lit(span) - F.col("level")).alias("within")
        spans = open_nodes.withColumn("within", within).withColumn("span", F.expr("shiftright(index, within)")).drop("within")
        found = materialize(spans.groupBy("tree", "span").applyInArrow(lambda group: merged(group.drop_columns(["span"])), schema), "forest")
        kept, open_nodes = kept.union(found.where("kept").drop("kept")), found.where("not kept").drop("kept")
    if span < tallest and open_nodes.head(1):
        forests = open_nodes.rdd.mapPartitions(lambda rows: [Forest(floor).add(map(tuple, rows)).resolve()])
        forest = forests.treeReduce(Forest.merge)
        kept = kept.union(spark.createDataFrame(forest.kept, NODE))
        open_nodes = materialize(spark.createDataFrame(forest.unresolved(), NODE), "roots")
    return open_nodes, kept, tallest


def _climb(group: pa.Table, above: list[str], span: int) -> Iterator[tuple[int, list[str]]]:
    """The path of each node of a span: for each level up to the root the sibling's digest after its side, or nothing if there is none; ``above`` holds the levels above the span.

    Yields the row of the group and its path.
    """
    n, level = group["n"][0].as_py(), group["level"][0].as_py()
    index = group["index"].to_pylist()
    order = sorted(range(len(index)), key=index.__getitem__)
    first, digests = index[order[0]], [group["digest"][i].as_py() for i in order]
    ways: list[list[str]] = [[] for _ in order]
    for step in range(min(span, height(n) - level)):
        entry = []
        for i, _ in enumerate(digests):
            place = (first >> step) + i
            if place % ARITY:
                entry.append("<" + digests[i - 1])
            else:
                entry.append(">" + digests[i + 1] if i + 1 < len(digests) else "")
        for i, way in enumerate(ways):
            way.append(entry[i >> step])
        digests = [digest_of(*digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
    for row, way in zip(order, ways):
        yield row, way + above


def folded(digest: str, path: Iterable[str]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for step in path:
        if not step:
            digest = digest_of(digest)
        elif step[0] == "<":
            digest = digest_of(step[1:], digest)
        else:
            digest = digest_of(digest, step[1:])
    return digest


def _above(right: pa.Table) -> list[str]:
    return right["path"][0].as_py() if len(right) else []


def upper_paths(kept: DataFrame, tallest: int, tops: DataFrame) -> DataFrame:
    """Rows (tree, span, path) for every span of leaves: the path from its top to the root of its tree, and on with ``tops`` (tree, n, path)."""
    span = SPAN
    floors = max(1, -(-tallest // span))
    tall = F.when(F.col("n") <= 1, 1)
    for floor in range(1, floors + 1):
        tall = tall.when(F.col("n") <= 1 << (span * floor), floor)
    entering = tops.select("tree", F.lit(0).cast("long").alias("span"), "path", tall.alias("floors"))
    upper = entering.where(F.col("floors") == floors).drop("floors")

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_climb(left, _above(right), span)) if len(left) else []
        columns = [pa.array([left[c][i].as_py() for i, _ in rows], t) for c, t in (("tree", pa.string()), ("index", pa.int64()))]
        return pa.Table.from_arrays([*columns, pa.array([way for _, way in rows], pa.list_(pa.string()))], names=["tree", "span", "path"])

    for floor in range(floors - 1, 0, -1):
        nodes = kept.where((F.col("level") == floor * span) & (F.col("n") > 1 << (span * floor)))
        here = nodes.withColumn("span", F.shiftright("index", span)).groupBy("tree", "span").cogroup(upper.groupBy("tree", "span"))
        found = here.applyInArrow(climb, "tree string, span long, path array<string>")
        upper = materialize(found.union(entering.where(F.col("floors") == floor).drop("floors")), "paths")
    return upper


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (the rows' columns, tree, n, index and digest), ``subroots`` (tree, subroot), ``root`` (null without rows) and the ``uppers`` of all paths."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    uppers: DataFrame

    def audited(self, claimed: str) -> DataFrame:
        """The leaves with ``path`` and ``folded_root``, which the digest in the column ``claimed`` and the path give."""
        span = SPAN
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.leaves.schema.fields) + ", path array<string>, folded_root string"

        def audit(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.drop_columns(["span"])
            paths: list[list[str]] = [[] for _ in range(len(left))]
            roots: list[str] = [""] * len(left)
            own, above, seen = left[claimed].to_pylist(), _above(right), {}
            with_level = left.append_column("level", pa.array([0] * len(left), pa.int32()))
            for row, way in _climb(with_level, [], span) if len(left) else ():
                top = folded(own[row], way)
                if top not in seen:
                    seen[top] = folded(top, above)
                paths[row], roots[row] = way + above, seen[top]
            return left.append_column("path", pa.array(paths, pa.list_(pa.string()))).append_column("folded_root", pa.array(roots, pa.string()))

        spans = self.leaves.withColumn("span", F.shiftright("index", SPAN)).groupBy("tree", "span")
        return spans.cogroup(self.uppers.groupBy("tree", "span")).applyInArrow(audit, schema)


def manifest(rows: DataFrame, group: str, order: str) -> Manifest:
    """The manifest of ``rows`` (``group``, ``order``, digest and others; none named tree, n, index, span, level, at or part).

    Each value of ``group`` is a tree over its rows by ascending ``order``; the
    roots of the trees by ascending ``group`` (null first, in the order of UTF-8
    bytes) are the leaves of the last tree.  While there are several nodes, every
    two consecutive ones become their digest, the last of an odd number its own; a
    single leaf is its own root.  Rows with equal ``order`` are ordered by their
    digests, so repeated rows are leaves like others; a null stands first.
    """
    spark = rows.sparkSession
    prepare(spark)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves, _ = numbered(rows, tree, [F.col(order)], "digest")
    roots, kept, tallest = grow(leaves)
    own = roots.select(F.col("tree").alias("group"), F.col("n").alias("leaves"), "digest")
    tops, top_sizes = numbered(own, F.lit("all"), [F.col("group")], "digest")
    top_roots, top_kept, top_tallest = grow(tops)
    end = spark.createDataFrame([("all", [])], "tree string, path array<string>").join(top_sizes, "tree")
    last = Manifest(tops, top_roots, None, upper_paths(top_kept, top_tallest, end)).audited("digest")
    ways = materialize(last.select(F.col("group").alias("tree"), F.col("leaves").alias("n"), "path"), "tops")
    top = top_roots.select("digest").head(1)
    subroots = roots.select("tree", F.col("digest").alias("subroot"))
    return Manifest(leaves, subroots, top[0][0] if top else None, upper_paths(kept, tallest, ways))


#: The columns of a document that its leaf stands for, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit_documents(docs: DataFrame, tampered: Column, key: str = "doc_id", group: str = "lang", changed: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows (key, leaf, subroot, root, path, folded_root, verified), one per document.

    ``path`` lists for each level from the leaf to the root the sibling's digest
    after ``<`` or ``>`` for its side, and is empty where a node has no sibling.
    ``folded_root`` is what the path makes of the leaf, where ``tampered`` is true
    of a leaf with 1 added to ``changed`` (a null stays; so does a row where ``tampered`` is null).  A null
    field counts as ``-``; rows with equal keys are leaves of their own, ordered
    by digest.  Extra columns are ignored.  An empty table has no rows and no root.
    """
    values = [docs[f] for f in fields]
    bent = [F.try_add(docs[f], F.lit(1).cast("long")) if f == changed else docs[f] for f in fields]
    rows = docs.select(docs[key].alias("key"), docs[group].alias("group"), leaf_of(*values).alias("digest"), F.when(tampered, leaf_of(*bent)).alias("bent"))
    rows = rows.withColumn("claimed", F.coalesce("bent", "digest")).drop("bent")
    made = manifest(rows, "group", "key")
    out = made.audited("claimed").join(broadcast_if_few(made.subroots, MAX_TREES), "tree")
    root = F.lit(made.root).cast("string")
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "folded_root", (F.col("folded_root") == root).alias("verified"))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), ""), 256)
