"""Queries that write tables as the files of a run and read them back: questions, manifests, masks, features, logs, results, calls."""

from __future__ import annotations

import io
import struct
import uuid
import zlib

from pyspark.sql import functions as F

from tessella.checkpoints import need_checkpoints, shared_folder
from tessella.functions import text as T
from tessella.operators import calls, rasters
from tessella.plans.geometry import _RECTS, _rects
from tessella.plans.registry import query, table
from tessella.sources import files, npy, png, readers
from tessella.streaming import runs, trace


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _json_files(df, by, path, wrap=None):
    """``df`` as JSON files of one array each (or of an object that holds it as ``wrap``), a file for a thousand values of ``by``."""
    rows = F.collect_list(F.struct(*df.columns))
    held = df.withColumn("part", F.floor(F.col(by) / 1000)).groupBy("part").agg(F.to_json(F.struct(rows.alias(wrap)) if wrap else rows).alias("value"))
    held.write.partitionBy("part").text(path)
    return path


@query("""SELECT lpad(c_custkey::VARCHAR, 12, '0') || '-DX1.svs' AS slide_id, lpad(c_custkey::VARCHAR, 12, '0') AS short_id, 'Which segment has ' || c_name || '?' AS question, c_mktsegment || '|OTHER' AS choices, c_mktsegment AS answer FROM customer WHERE c_custkey % 3 = 0""")
def questions_wsi(spark, sf_dir):
    """Customers as questions in JSON, joined with slides by the first 12 characters of their names."""
    c = table(spark, sf_dir, "customer")
    short = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    rows = c.select(short.alias("Id"), F.concat(F.lit("Which segment has "), "c_name", F.lit("?")).alias("Question"), F.array("c_mktsegment", F.lit("OTHER")).alias("Choice"), F.col("c_mktsegment").alias("Answer"), "c_custkey")
    path = _json_files(rows, "c_custkey", _place(spark, "wsi"))
    slides = c.select(F.concat(short, F.when(F.col("c_custkey") % 3 == 0, "-DX1.svs").otherwise("-DX2.svs")).alias("name"))
    out = readers.questions(spark, path, "wsi_vqa", slides)
    return out.select("slide_id", "short_id", "question", F.array_join("choices", "|").alias("choices"), "answer")


@query("""SELECT 's' || conv_id AS slide_id, md5(coalesce(text, '')) AS question, role || '|b, "b"|c|d' AS choices, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'b, "b"' ELSE 'none' END AS answer FROM conversations WHERE conv_id % 2 = 0 AND coalesce(text, '') <> ''""")
def questions_slidebench(spark, sf_dir):
    """Turns as questions in CSV, with quotes and line breaks; answers are letters or texts."""
    c = table(spark, sf_dir, "conversations").where(F.coalesce("text", F.lit("")) != "")
    answer = F.when(F.col("turn") % 3 == 0, " a").when(F.col("turn") % 3 == 1, "B ").otherwise("none")
    rows = c.select(F.concat(F.lit("s"), "conv_id").alias("Slide"), F.col("text").alias("Question"), F.col("role").alias("A"), F.lit('b, "b"').alias("B"), F.lit("c").alias("C"), F.lit("d").alias("D"), answer.alias("Answer"))
    path = _place(spark, "slidebench")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(path)
    slides = c.select(F.concat(F.lit("s"), "conv_id", F.when(F.col("conv_id") % 2 == 0, ".DX1.svs").otherwise(".DX2.svs")).alias("name"))
    out = readers.questions(spark, path, "slidebench_vqa", slides)
    return out.select("slide_id", F.md5(F.col("question").cast("binary")).alias("question"), F.array_join("choices", "|").alias("choices"), "answer")


@query("""SELECT 'p' || p_partkey || '_x' AS slide_id, CASE WHEN p_partkey % 2 = 0 THEN 'case' || p_partkey ELSE 'p' || p_partkey END AS case_id, p_name AS question, CASE WHEN p_partkey % 3 = 0 THEN 'limited' ELSE 'strict' END AS evidence_tier, p_brand || '|' || p_type AS choices, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS answer FROM part""")
def questions_local(spark, sf_dir):
    """Parts as questions in a JSON object; cases, tiers and answers are missing from some."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k, F.concat(F.lit("p"), k, F.lit("_x")).alias("slide_id"), F.when(k % 2 == 0, F.concat(F.lit("case"), k)).alias("case_id"), F.col("p_name").alias("question"),
        F.when(k % 3 == 0, "limited").alias("evidence_tier"), F.concat(F.lit(" "), "p_brand", F.lit(" | |"), "p_type").alias("choices"), F.when(k % 5 != 0, F.col("p_brand")).alias("answer"),
    )
    out = readers.questions(spark, _json_files(rows, "p_partkey", _place(spark, "local"), wrap="questions"), "local_wsi")
    return out.select("slide_id", "case_id", "question", "evidence_tier", F.array_join("choices", "|").alias("choices"), "answer")


@query("""SELECT o_custkey::VARCHAR AS slide_id, 'o' || o_orderkey AS patch_id, o_orderkey % 1000 AS x, 5 AS magnification, coalesce(c, false) AS clean FROM orders
    LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS c FROM orders WHERE o_orderkey % 5 <> 0) ON k = o_orderkey WHERE o_orderkey % 4 <> 0""")
def tile_manifests(spark, sf_dir):
    """Orders as tiles in JSON lines, a quarter of them not selected, and their marks as a clean manifest that lacks some."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = [F.col("o_custkey").cast("string").alias("slide_id"), F.concat(F.lit("o"), k).alias("patch_id")]
    where, marks = _place(spark, "tiles"), _place(spark, "clean")
    o.select(*key, (k % 1000).alias("x_level0"), *(F.lit(1).alias(c) for c in ("y_level0", "width_level0", "height_level0")), F.lit(0.5).alias("mpp_x"), F.lit(0.5).alias("mpp_y"), F.when(k % 4 == 0, False).when(k % 4 == 1, True).alias("selected")).write.json(where)
    audit = F.struct((k % 3 != 0).alias("contract_pass"), F.lit(True).alias("safety_pass"), F.lit(False).alias("fallback_or_uninformative"))
    o.where(k % 5 != 0).select(*key, F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), audit.alias("audit")).write.json(marks)
    from tessella.operators import joins

    good = readers.clean_manifest(spark, marks)
    good = good.where(joins.clean(F.col("status"), F.col("audit.contract_pass"), F.col("audit.safety_pass"), F.col("audit.fallback_or_uninformative")))
    out = joins.with_flag(readers.tiles(spark, where), good, ["slide_id", "patch_id"], "clean")
    return out.select("slide_id", "patch_id", F.col("x_level0").alias("x"), "magnification", "clean")


@query("""SELECT 'c' || c_custkey AS slide_id, '/slides/' || c_name AS slide_path, c_custkey * 7 AS width, 2 AS n_levels FROM customer""")
def slide_manifest(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = _place(spark, "slides")
    c.select(F.concat(F.lit("c"), k).alias("slide_id"), F.concat(F.lit("/slides/"), "c_name").alias("slide_path"), (k * 7).alias("width"), k.alias("height"), F.array(F.lit(1.0), F.lit(4.0)).alias("level_downsamples")).write.json(path)
    return readers.slides(spark, path).select("slide_id", "slide_path", "width", F.size("level_downsamples").alias("n_levels"))


@query("""SELECT source AS slide_id, doc_id::VARCHAR AS patch_id, md5(coalesce(text, '')) AS digest FROM documents WHERE source IS NOT NULL""")
def description_files(spark, sf_dir):
    """Documents as descriptions in JSON objects of objects, some hundred tiles of a slide in each."""
    d = table(spark, sf_dir, "documents").where("source is not null").withColumn("part", F.floor(F.col("doc_id") / 500))
    of = d.groupBy("part", "source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))).alias("of"))
    held = of.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "of")))).alias("value"))
    path = _place(spark, "descriptions")
    held.write.partitionBy("part").text(path)
    return readers.descriptions(spark, path).select("slide_id", "patch_id", F.md5(F.col("description").cast("binary")).alias("digest"))


@query("""SELECT 'S_' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' # x' WHEN 1 THEN s_name ELSE '' END AS value FROM supplier""")
def settings_file(spark, sf_dir):
    """Suppliers as settings with quotes, exports, comments and blank lines."""
    k = F.col("s_suppkey")
    lines = F.array(F.lit("  # a note"), F.lit(""), F.concat(F.when(k % 2 == 0, "export S_").otherwise("S_"), k, F.lit("="), F.when(k % 3 == 0, F.concat(F.lit('"'), "s_name", F.lit(' # x"'))).when(k % 3 == 1, F.concat(F.lit(" '"), "s_name", F.lit("' "))).otherwise("")))
    path = _place(spark, "settings")
    table(spark, sf_dir, "supplier").select(F.explode(lines).alias("value")).write.text(path)
    return readers.settings(spark, path)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS x, CASE WHEN o_orderkey % 4 <> 0 THEN -o_orderkey END AS y FROM orders""")
def name_coordinates(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat("o_custkey", F.when(k % 4 == 0, "_x").otherwise(F.concat(F.lit("_-"), k)), F.when(k % 2 == 0, ".png").otherwise("_5.v2.jpeg"))
    return table(spark, sf_dir, "orders").withColumn("c", T.coordinates(name)).select(k.alias("id"), "c.x", "c.y")


_MARKED = f"regexp_replace(regexp_replace(coalesce(text, ''), '{T.DIAGNOSTIC}', '{T.LABEL_MARK}', 'g'), '{T.ORGAN}', '{T.ORGAN_MARK}', 'g')"
_FIELDS = "VISIBLE: Solid nests.\nABSENT_OR_NOT_SEEN: none\nUNCERTAIN: no\nQUALITY: good\nKRAS mutation was seen.\n"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace({_MARKED}, '^\\s+|\\s+$', '', 'g') AS x FROM documents), l AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '\\r\\n|\\n|\\r'), lambda s: NOT regexp_matches(s, '{T.ANCILLARY}')) AS l FROM t)
    SELECT doc_id, md5('[PATHO_MORPHOLOGY | v1]' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'VISIBLE: Solid nests.' || chr(10) || 'ABSENT_OR_NOT_SEEN: none' || chr(10) || 'UNCERTAIN: no' || chr(10) || 'QUALITY: good' || chr(10) || array_to_string(l, chr(10)) || 'end'
        WHEN 1 THEN '{T.UNUSABLE}' ELSE 'VISIBLE: Solid nests of cells are present.{T.NOT_STATED}' END) AS digest FROM l""")
def morphology(spark, sf_dir):
    """A third of the documents are complete descriptions, a third are bare labels, a third are prose with one sentence on form."""
    i, text = F.col("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+\z", "")
    prose = F.lit("Key features include Solid nests of cells are present. This is consistent with carcinoma of solid type. KRAS mutation of gland cells. Nothing.")
    said = F.when(i % 3 == 0, F.concat(F.lit(_FIELDS), text, F.lit("end"))).when(i % 3 == 1, "<think>so</think> <answer> B </answer>").otherwise(prose)
    return table(spark, sf_dir, "documents").select(i, F.md5(T.normalize_morphology(said, "v1").cast("binary")).alias("digest"))


@query("SELECT label AS slide_id, vec_id::VARCHAR AS patch_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def feature_files(spark, sf_dir):
    """Embeddings as NumPy files in a folder for each label, read by the data source."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), "label").alias("slide"), F.col("vec_id").cast("string").alias("tile"), "embedding")
    root = _place(spark, "features")

    def put(parts):
        import numpy as np
        import pandas as pd
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(root)
        for part in parts:
            for slide, tile, vector in part.itertuples(index=False):
                held = io.BytesIO()
                np.save(held, np.array(vector, "float32"))
                fs.create_dir(f"{at}/{slide}", recursive=True)
                with fs.open_output_stream(f"{at}/{slide}/{tile}.npy") as out:
                    out.write(held.getvalue())
            yield pd.DataFrame({"n": [len(part)]})

    e.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    npy.register(spark)
    read = spark.read.format(npy.NAME).load(root)
    total = F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return read.select(F.substring("slide_id", 2, 20).cast("long").alias("slide_id"), "patch_id", F.size("features").cast("long").alias("n"), total.alias("total"))


_CELLS = "cells AS (SELECT user_id % 10 AS slide, event_id % 32 AS i, event_id // 32 % 32 AS j, max((event_type IN ('view', 'click'))::BIGINT) AS v FROM events GROUP BY ALL)"


def _png(rows, width, height):
    """A grey PNG file of the pixels (i, j) that are set."""
    lines = [bytearray(width + 1) for _ in range(height)]
    for i, j in rows:
        lines[j][i + 1] = 255
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@query(f"""WITH {_RECTS}, {_CELLS},
    r AS (SELECT slide % 10 AS slide, id, floor(x / 4200::DOUBLE * 32) AS l0, ceil((x + w) / 4200::DOUBLE * 32) AS r0, floor(y / 4200::DOUBLE * 32) AS t0, ceil((y + h) / 4200::DOUBLE * 32) AS b0 FROM rects)
    SELECT id, coalesce(sum(v), 0) / (greatest(1, any_value(r0 - l0)) * greatest(1, any_value(b0 - t0)))::DOUBLE AS fraction
    FROM r LEFT JOIN cells AS c ON c.slide = r.slide AND i >= l0 AND i < least(r0, 32) AND j >= t0 AND j < least(b0, 32) GROUP BY id""")
def mask_files(spark, sf_dir):
    """Masks of slides as PNG images, and the part of every region that they cover."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    cells = e.select((F.col("user_id") % 10).alias("slide"), (F.col("event_id") % 32).alias("i"), (F.floor(F.col("event_id") / 32) % 32).alias("j")).distinct()

    def paint(group):
        import pandas as pd

        return pd.DataFrame({"slide_id": [str(group["slide"].iloc[0])], "content": [_png(zip(group["i"], group["j"]), 32, 32)]})

    from tessella.shipping import ship

    ship(spark)
    images = cells.groupBy("slide").applyInPandas(paint, "slide_id string, content binary")  # a group has at most 32 x 32 rows
    rects = _rects(spark, sf_dir).withColumn("slide_id", (F.col("slide") % 10).cast("string"))
    slides = rects.select("slide_id").distinct().withColumns({"slide_width": F.lit(4200), "slide_height": F.lit(4200)})
    return png.covered(rects, png.mask_sums(images), slides).select("id", "fraction")


@query(f"""WITH {_RECTS}, p AS (SELECT slide, i, j, (n * 40 % 256) AS r, v * 200 AS g, j * 8 AS a FROM (SELECT user_id % 10 AS slide, event_id % 32 AS i, event_id // 32 % 32 AS j, count(*) AS n, max((event_type = 'view')::BIGINT) AS v FROM events GROUP BY ALL)),
    q AS (SELECT slide % 10 AS slide, id, x % 40 - 4 AS x, y % 40 - 4 AS y FROM rects),
    o AS (SELECT q.*, c AS col, w AS row FROM q, generate_series(0, 7) AS a(c), generate_series(0, 7) AS b(w))
    SELECT id, sum(CASE WHEN a IS NULL THEN 255 ELSE floor(r * (a / 255.0::DOUBLE) + 255.0::DOUBLE * (1 - a / 255.0::DOUBLE) + 0.5) END)::BIGINT AS red, sum(CASE WHEN a IS NULL THEN 255 ELSE floor(g * (a / 255.0::DOUBLE) + 255.0::DOUBLE * (1 - a / 255.0::DOUBLE) + 0.5) END)::BIGINT AS green,
        greatest(0, any_value(-x)) AS pad_left, greatest(0, any_value(y) + 8 - 32) AS pad_bottom
    FROM o LEFT JOIN p ON p.slide = o.slide AND p.i = x + col AND p.j = y + row GROUP BY id""")
def region_pixels(spark, sf_dir):
    """Regions of 8 by 8 pixels of slides that are held as blocks, over their edges too, laid on white."""
    e = table(spark, sf_dir, "events")
    cells = e.groupBy((F.col("user_id") % 10).alias("slide"), (F.col("event_id") % 32).alias("i"), (F.floor(F.col("event_id") / 32) % 32).alias("j")).agg(F.count("*").alias("n"), F.max((F.col("event_type") == "view").cast("long")).alias("v"))

    def paint(group):
        import numpy as np
        import pandas as pd

        block = np.zeros((16, 16, 4), np.uint8)
        x, y = (group["i"] % 16).to_numpy(), (group["j"] % 16).to_numpy()
        for c, value in enumerate((group["n"] * 40 % 256, group["v"] * 200, 0, group["j"] * 8)):
            block[y, x, c] = value
        return pd.DataFrame({"slide_id": [str(group["slide"].iloc[0])], "level": [0], "bx": [group["bx"].iloc[0]], "by": [group["by"].iloc[0]], "pixels": [block.tobytes()]})

    blocks = cells.withColumns({"bx": F.floor(F.col("i") / 16), "by": F.floor(F.col("j") / 16)}).groupBy("slide", "bx", "by").applyInPandas(paint, "slide_id string, level int, bx long, by long, pixels binary")
    rects = _rects(spark, sf_dir)
    regions = rects.select((F.col("slide") % 10).cast("string").alias("slide_id"), F.col("id").alias("patch_id"), (F.col("x") % 40 - 4).alias("x"), (F.col("y") % 40 - 4).alias("y"), F.lit(8).cast("long").alias("w"), F.lit(8).cast("long").alias("h"))
    slides = regions.select("slide_id").distinct().withColumns({"slide_width": F.lit(32), "slide_height": F.lit(32), "downsamples": F.array(F.lit(1.0), F.lit(4.0))})
    read = rasters.read_regions(regions, slides, blocks, 16, 8)
    sums = rasters.channel_sums(read.withColumns({"pad_left": F.col("padding.left"), "pad_bottom": F.col("padding.bottom")}), 8, ["patch_id", "pad_left", "pad_bottom"])
    return sums.select(F.col("patch_id").alias("id"), "red", "green", "pad_left", "pad_bottom")


@query("""SELECT user_id::VARCHAR AS trace_id, count(*) AS n, count(DISTINCT event_id) AS different, min(event_id)::BIGINT AS first FROM events GROUP BY user_id""")
def event_log(spark, sf_dir):
    """Events as a stream into a log, which a second start of the stream does not write again."""
    e = table(spark, sf_dir, "events")
    named = dict(x.split() for x in trace.EVENT.split(", "))
    given = {"trace_id": F.col("user_id"), "event_id": F.col("event_id"), "ts": F.col("ts"), "status": F.col("event_type")}
    rows = e.select(*(given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in named.items()))
    source, log, checkpoint = (_place(spark, n) for n in ("events", "log", "log-checkpoint"))
    rows.write.parquet(source)
    for _ in range(2):
        trace.append_once(spark.readStream.schema(rows.schema).parquet(source), log, checkpoint).awaitTermination()
    return trace.read_log(spark, log).groupBy("trace_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("different"), F.min("event_id").cast("long").alias("first"))


@query("""SELECT o_orderkey AS question_id, o_orderstatus AS ending, o_orderkey % 3 = 0 AS open FROM orders""")
def results_and_rest(spark, sf_dir):
    """Results as JSON lines, and the questions that have none yet."""
    o = table(spark, sf_dir, "orders")
    questions = o.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("ending"))
    path = _place(spark, "results")
    runs.write_results(questions.where("question_id % 3 <> 0"), path)
    done = spark.read.schema("question_id long, ending string").json(path).select("question_id", "ending")
    rest = files.unfinished(questions, done, ["question_id"]).withColumn("open", F.lit(True))
    return done.withColumn("open", F.lit(False)).unionByName(rest)


@query("""SELECT c_name AS long_id, 'ask ' || c_custkey AS question, c_mktsegment AS pred_answer, CASE WHEN c_custkey % 2 = 0 THEN 'why' END AS explanation FROM customer""")
def case_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = _place(spark, "cases")
    runs.write_cases(c.select(F.col("c_name").alias("long_id"), F.concat(F.lit("ask "), "c_custkey").alias("question"), F.col("c_mktsegment").alias("pred_answer"), F.when(F.col("c_custkey") % 2 == 0, "why").alias("explanation")), path)
    return spark.read.schema("long_id string, question string, pred_answer string, explanation string").json(path).select("long_id", "question", "pred_answer", "explanation")


@query("""SELECT user_id, n_events, CASE WHEN user_id % 3 = 0 THEN 'no trace' WHEN user_id % 3 = 1 THEN 'other' ELSE 'same' END AS verdict FROM (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id)""")
def resume_checks(spark, sf_dir):
    """Results without a finished trace, and results whose trace says something else."""
    results = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    k = F.col("user_id")
    traces = results.where(k % 3 != 0).select(k, F.when(k % 3 == 1, F.col("n_events") + 1).otherwise(F.col("n_events")).alias("n_events"))
    open_ = runs.resumable(results, traces, ["user_id"]).withColumn("verdict", F.lit("no trace"))
    other = runs.consistent(results, traces, ["user_id"], ["n_events"]).select("user_id", "n_events").withColumn("verdict", F.lit("other"))
    same = results.join(open_.unionByName(other).select("user_id"), "user_id", "left_anti").withColumn("verdict", F.lit("same"))
    return open_.unionByName(other).unionByName(same)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 429 WHEN 3 THEN 413 END AS status, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS attempts, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS reply FROM events""")
def retried_calls(spark, sf_dir):
    """Calls that answer at once, at the second attempt, never, or are too long to send; one kind has no connection."""
    seen: dict = {}

    def send(request):
        kind, said = request[0], request.split("|")[1]
        n = seen[request] = seen.get(request, 0) + 1
        if kind == "4":
            raise OSError("no connection")
        return {"status": 429 if kind == "2" else 500 if kind == "1" and n % 2 else 200, "reply": None if kind == "2" else said, "prompt_tokens": 10}

    i = F.col("event_id")
    request = F.concat((i % 5).cast("string"), F.lit("|"), "event_type", F.lit("|"), i.cast("string"), F.when(i % 5 == 3, F.repeat(F.lit("x"), 200)).otherwise(""))
    asked = table(spark, sf_dir, "events").select(i, request.alias("request"))
    out = calls.call(asked, send, "event_id", "request", most_chars=150, sleep=lambda s: None)
    return out.select("event_id", "status", "attempts", F.when(F.col("status") == 200, F.col("reply")).alias("reply"))


@query("""SELECT c_custkey, r <= 100 AS sent, CASE WHEN r <= 100 THEN 200 ELSE 402 END AS status FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)""")
def budgeted_calls(spark, sf_dir):
    """Calls in the order of their keys, wave by wave, until a budget for a hundred is spent."""
    need_checkpoints(spark)
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("request"))
    out = calls.call_within(asked, lambda request: {"status": 200, "reply": "yes", "prompt_tokens": 1000}, "c_custkey", "request", budget=0.0999)
    return out.select("c_custkey", (F.col("attempts") > 0).alias("sent"), "status")
