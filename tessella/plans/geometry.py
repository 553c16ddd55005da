"""Queries on regions: children, levels, padding, overlaps, masks, focus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import focus, regions
from tessella.plans.registry import query, table

# Regions made from the keys of orders: (slide, id, x, y, w, h).
_RECTS = """rects AS (SELECT o_custkey // 10 AS slide, o_orderkey AS id, (o_orderkey * 7919) % 4000 AS x, (o_orderkey * 104729 + o_custkey) % 4000 AS y,
    100 + o_orderkey % 300 AS w, 100 + o_custkey % 300 AS h FROM orders)"""


def _rects(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.floor(cust / 10).alias("slide"), key.alias("id"), (key * 7919 % 4000).alias("x"), ((key * 104729 + cust) % 4000).alias("y"),
        (100 + key % 300).alias("w"), (100 + cust % 300).alias("h"),
    )


@query("""WITH p AS (SELECT p_brand AS slide_id, p_partkey AS patch, p_partkey * 37 % 5000 AS x, p_partkey * 91 % 5000 AS y, 1000 + p_size * 7 AS w, 1000 + p_partkey % 13 AS h, f
        FROM part, (VALUES (2), (4)) AS v(f)),
    g AS (SELECT *, unnest(generate_series(0, f - 1)) AS c FROM p), k AS (SELECT *, unnest(generate_series(0, f - 1)) AS r FROM g),
    e AS (SELECT slide_id, patch, f, x + c * w // f AS x0, x + (c + 1) * w // f AS x1, y + r * h // f AS y0, y + (r + 1) * h // f AS y1 FROM k)
    SELECT slide_id, 'x' || x0 || '_y' || y0 || '_w' || (x1 - x0) || '_h' || (y1 - y0) || '_m' || f * 5 AS patch_id, patch::VARCHAR AS parent_patch_id, x0 AS x, y0 AS y,
        x1 - x0 AS w, y1 - y0 AS h, (f * 5)::INTEGER AS magnification FROM e""")
def focus_partition_children(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("slide_id"), F.col("p_partkey").cast("string").alias("patch_id"), (F.col("p_partkey") * 37 % 5000).alias("x"),
        (F.col("p_partkey") * 91 % 5000).alias("y"), (1000 + F.col("p_size") * 7).cast("long").alias("w"), (1000 + F.col("p_partkey") % 13).alias("h"),
    )
    return regions.children(p, 10).union(regions.children(p, 20))


@query("""SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey ORDER BY r, c) AS part, x + c * (w // 3) AS x, y + r * (h // 3) AS y,
        CASE WHEN c = 2 THEN w - 2 * (w // 3) ELSE w // 3 END AS w, CASE WHEN r = 2 THEN h - 2 * (h // 3) ELSE h // 3 END AS h
    FROM (SELECT o_orderkey, o_orderkey % 1000 AS x, o_custkey % 1000 AS y, 100 + o_orderkey % 51 AS w, 100 + o_custkey % 37 AS h FROM orders), (VALUES (0), (1), (2)) AS a(r), (VALUES (0), (1), (2)) AS b(c)""")
def tile_split(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, sf_dir, "orders").select(key.alias("patch_id"), (key % 1000).alias("x"), (cust % 1000).alias("y"), (100 + key % 51).alias("w"), (100 + cust % 37).alias("h"))
    return regions.split_tiles(t, 3).select(F.col("patch_id").alias("id"), (F.col("row") * 3 + F.col("col") + 1).cast("long").alias("part"), "x", "y", "w", "h")


_FOCUS = """c AS (SELECT event_id, user_id, value / 1000 AS score, (event_id % 101) / 100.0::DOUBLE AS tissue, (event_id * 31 % 97) / 96.0::DOUBLE AS white, event_id % 11 = 0 AS padded FROM events),
    k AS (SELECT *, CASE WHEN tissue < 0.01::DOUBLE AND white >= 0.98::DOUBLE THEN 'strict_blank' WHEN tissue >= 0.05::DOUBLE AND white < 0.95::DOUBLE THEN 'definite_nonblank' ELSE 'ambiguous' END AS kind FROM c)"""


def _candidates(spark, sf_dir):
    i = F.col("event_id")
    pad = F.create_map(F.lit("right"), F.when(i % 11 == 0, F.lit(10)).otherwise(0).cast("long"), F.lit("left"), F.lit(0).cast("long"))
    c = table(spark, sf_dir, "events").select(i, "user_id", (F.col("value") / 1000).alias("score"), ((i % 101) / 100.0).alias("tissue"), ((i * 31 % 97) / 96.0).alias("white"), pad.alias("padding"))
    return c.withColumn("kind", focus.candidate_class(F.col("tissue"), F.col("white")))


@query(f"WITH {_FOCUS} SELECT kind, count(*) AS n, round(avg(tissue), 6) AS tissue FROM k GROUP BY kind")
def focus_candidate_class(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("tissue"), 6).alias("tissue"))


@query(f"""WITH {_FOCUS}, r AS (SELECT *, CASE WHEN kind = 'ambiguous' THEN greatest(least(greatest((0.05::DOUBLE - tissue) / 0.04::DOUBLE, 0), 1), least(greatest((white - 0.95::DOUBLE) / 0.03::DOUBLE, 0), 1)) ELSE 0 END AS risk,
        concat_ws('+', CASE WHEN kind = 'strict_blank' THEN 'strict_blank' END, CASE WHEN padded THEN 'padding' END) AS reasons FROM k),
    a AS (SELECT *, score - 0.05::DOUBLE * risk AS adjusted FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, reasons = '' ORDER BY adjusted DESC, score DESC, event_id) AS rank FROM a)
    SELECT event_id, user_id, kind, reasons, round(risk, 6) AS risk, round(adjusted, 6) AS adjusted, CASE WHEN reasons = '' THEN rank END AS eligible_rank, reasons = '' AND rank <= 2 AS chosen FROM n""")
def focus_strategy_c(spark, sf_dir):
    ranked = focus.rank_candidates(_candidates(spark, sf_dir), ["user_id"], "event_id")
    return ranked.select("event_id", "user_id", "kind", F.array_join("reasons", "+").alias("reasons"), F.round("risk", 6).alias("risk"), F.round("adjusted", 6).alias("adjusted"), F.col("eligible_rank").cast("long").alias("eligible_rank"), "chosen")


@query("""WITH r AS (SELECT o_orderkey AS id, 200 + o_orderkey * 13 % 8000 AS w, 200 + o_custkey * 29 % 8000 AS h FROM orders),
    l AS (SELECT *, greatest(1, least(w / 784::DOUBLE, h / 784::DOUBLE)) AS wanted FROM r),
    v AS (SELECT *, CASE WHEN wanted >= 16 THEN 4 WHEN wanted >= 8 THEN 3 WHEN wanted >= 4 THEN 2 WHEN wanted >= 2 THEN 1 ELSE 0 END::INTEGER AS level FROM l)
    SELECT id, level, greatest(1, ceil(w / 2::DOUBLE ** level))::BIGINT AS read_w, greatest(1, ceil(h / 2::DOUBLE ** level))::BIGINT AS read_h FROM v""")
def read_level_choice(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select(key.alias("id"), (200 + key * 13 % 8000).alias("w"), (200 + cust * 29 % 8000).alias("h"))
    levels = F.array(*(F.lit(float(2**i)) for i in range(5)))
    r = r.withColumn("level", G.read_level(levels, F.col("w"), F.col("h"), 784)).withColumn("d", F.element_at(levels, F.col("level") + 1))
    return r.select("id", "level", G.read_size(F.col("w"), F.col("d")).alias("read_w"), G.read_size(F.col("h"), F.col("d")).alias("read_h"))


@query(f"""WITH {_RECTS}, r AS (SELECT *, x - 150 AS l, y - 150 AS t FROM rects)
    SELECT id, greatest(0, -l) AS p_left, greatest(0, -t) AS p_top, greatest(0, l + w - 3900) AS p_right, greatest(0, t + h - 3900) AS p_bottom FROM r""")
def region_padding(spark, sf_dir):
    p = G.padding(F.col("x") - 150, F.col("y") - 150, F.col("w"), F.col("h"), F.lit(3900), F.lit(3900))
    return _rects(spark, sf_dir).withColumn("p", p).select("id", *(F.col(f"p.{s}").alias(f"p_{s}") for s in ("left", "top", "right", "bottom")))


@query(f"WITH {_RECTS} SELECT id, round(w * 0.2527::DOUBLE, 6) AS width_um, round(h * 0.2511::DOUBLE, 6) AS height_um FROM rects")
def physical_size(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return r.select("id", G.physical_size(F.col("w"), F.lit(0.2527)).alias("width_um"), G.physical_size(F.col("h"), F.lit(0.2511)).alias("height_um"))


@query(f"""WITH {_RECTS} SELECT a.slide, a.id AS a, b.id AS b FROM rects AS a JOIN rects AS b ON a.slide = b.slide AND a.id < b.id
    AND NOT (a.x + a.w <= b.x OR b.x + b.w <= a.x OR a.y + a.h <= b.y OR b.y + b.h <= a.y)""")
def rect_overlap_pairs(spark, sf_dir):
    return regions.overlapping_pairs(_rects(spark, sf_dir), ["slide"], "id", cell=512)


@query(f"""WITH RECURSIVE {_RECTS}, c AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY id % 5 DESC, id) AS rn FROM rects),
    r AS (SELECT DISTINCT slide, 0::BIGINT AS rn, []::STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[] AS taken FROM c
        UNION ALL SELECT r.slide, c.rn, CASE WHEN len(taken) < 8 AND len(list_filter(taken, lambda t: NOT (t.x + t.w <= c.x OR c.x + c.w <= t.x OR t.y + t.h <= c.y OR c.y + c.h <= t.y))) = 0
            THEN list_append(taken, {{'id': c.id, 'x': c.x, 'y': c.y, 'w': c.w, 'h': c.h}}) ELSE taken END FROM r JOIN c ON c.slide = r.slide AND c.rn = r.rn + 1),
    f AS (SELECT slide, arg_max(taken, rn) AS taken FROM r GROUP BY slide)
    SELECT slide, unnest(generate_series(1, len(taken)))::INTEGER AS position, unnest(list_transform(taken, lambda t: t.id)) AS id FROM f""")
def greedy_nonoverlap(spark, sf_dir):
    order = [-(F.col("id") % 5), F.col("id")]
    return regions.greedy_nonoverlap(_rects(spark, sf_dir), ["slide"], order, "id", most=8).select("slide", "position", "id")


@query(f"""WITH {_RECTS}, cells AS (SELECT user_id % 10 AS slide, event_id % 32 AS i, event_id // 32 % 32 AS j, max((event_type IN ('view', 'click'))::BIGINT) AS v FROM events GROUP BY ALL),
    r AS (SELECT slide % 10 AS slide, id, floor(x / 4200::DOUBLE * 32) AS l0, ceil((x + w) / 4200::DOUBLE * 32) AS r0, floor(y / 4200::DOUBLE * 32) AS t0, ceil((y + h) / 4200::DOUBLE * 32) AS b0 FROM rects)
    SELECT id, coalesce(sum(v), 0) / (greatest(1, any_value(r0 - l0)) * greatest(1, any_value(b0 - t0)))::DOUBLE AS fraction
    FROM r LEFT JOIN cells AS c ON c.slide = r.slide AND i >= l0 AND i < least(r0, 32) AND j >= t0 AND j < least(b0, 32) GROUP BY id""")
def mask_fraction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cells = e.groupBy((F.col("user_id") % 10).alias("slide"), (F.col("event_id") % 32).alias("i"), (F.floor(F.col("event_id") / 32) % 32).alias("j"))
    cells = cells.agg(F.max(F.col("event_type").isin("view", "click").cast("long")).alias("value"))
    corners = regions.summed_area(cells, ["slide"], 32, 32)
    rects = _rects(spark, sf_dir).withColumn("slide", F.col("slide") % 10)
    return regions.mask_fraction(rects, corners, ["slide"], 4200, 4200, 32, 32).select("id", "fraction")
