"""The pipeline's stages against what they promise, and the queries against their SQL."""

import collections

import pytest

import corpus_pipeline
from oracle import same
from tessella.llm.queries import ORACLE_SQL, QUERIES, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)


def test_each_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def test_stages(spark):
    docs, seen = table(spark, FOLDER, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == columns, name
        before, rows = ({tuple(r) for r in x.collect()} for x in (docs, after))
        assert rows <= before, name
        seen.append((len(before), after.count()))
        docs = after
    assert seen[1][1] < seen[1][0] and seen[2][1] < seen[2][0]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    counted = collections.Counter(r["doc_id"] for r in docs.collect())
    assert collections.Counter(r["doc_id"] for r in final.collect()) == counted
    assert corpus_pipeline.run(spark, FOLDER).count() == sum(counted.values())


def _awkward(spark):
    """Texts of the test table with null, empty and very long ones, repeated rows, keys that rows share, no keys, and columns with clashing names."""
    docs = table(spark, FOLDER, "documents")
    some = [r.asDict() for r in docs.where("doc_id < 120").collect()]
    long = " ".join(r["text"] for r in some if r["lang"] == "en" and r["text"])
    rows = some + [some[3], some[3], {**some[5], "doc_id": None}, {**some[7], "doc_id": None, "source": None}, {**some[9], "doc_id": some[11]["doc_id"], "lang": None}]
    rows += [{**some[0], "doc_id": 1000 + i, "text": t} for i, t in enumerate((None, "", " \n\t", "12 34 56", long * 20))]
    clash = {"component_id": 1, "text_hash": 2, "copies": 3, "own": 4, "key": "k", "score": 5.0}
    return spark.createDataFrame([{**r, **clash} for r in rows], docs.schema.simpleString()[7:-1].replace(":", " ") + ", component_id int, text_hash int, copies int, own int, key string, score double").repartition(5)


def test_stages_on_awkward_rows(spark):
    docs = _awkward(spark)
    columns, rows = docs.columns, lambda df: [tuple(r) for r in df.collect()]
    kept = rows(corpus_pipeline.language(spark, docs, FOLDER))
    at = {c: i for i, c in enumerate(columns)}
    assert {r[at["doc_id"]] for r in kept}.isdisjoint({1000, 1001, 1002, 1003}) and 1004 in {r[at["doc_id"]] for r in kept}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        found = rows(after)
        assert after.columns == columns and set(found) <= set(rows(before)), name
        if name == "near_duplicates":
            assert len(found) == len(set(found)) and {(r[at["doc_id"]], r[at["text"]]) for r in found} >= {(1004, [x for x in kept if x[at["doc_id"]] == 1004][0][at["text"]])}
        assert found == rows(after) or sorted(map(str, found)) == sorted(map(str, rows(stage(spark, before, FOLDER)))), name
        before = spark.createDataFrame(found, docs.schema)
    final = corpus_pipeline.tokens(spark, before, FOLDER)
    assert final.count() == before.count()
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0, name


def test_stages_on_columns_of_any_kind(spark):
    """Maps, structs and names with dots pass through every stage, also where rows repeat."""
    from pyspark.sql import functions as F

    docs = table(spark, FOLDER, "documents").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id in (3, 5)")).unionByName(docs.where("doc_id = 5").withColumn("lang", F.lit("xx")))
    docs = docs.withColumns({"m": F.create_map(F.lit("a"), F.col("doc_id")), "s": F.struct(F.lit(1).alias("x.y")), "a.b": F.col("doc_id") * 2, "a": F.struct(F.lit("z").alias("b"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        found = after.collect()
        assert found and all(r["a.b"] == 2 * r["doc_id"] and r["m"] == {"a": r["doc_id"]} and r["a"]["b"] == "z" for r in found), name
        if name == "near_duplicates":
            assert len({r["doc_id"] for r in found}) == len(found)
        docs = spark.createDataFrame(found, docs.schema)
    assert corpus_pipeline.tokens(spark, docs, FOLDER).count() == docs.count()
