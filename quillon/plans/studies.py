"""Queries: repeated runs, persistence diagrams, boxes and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators import boxes, diagrams, resample, runs
from quillon.plans.evaluation import scored
from quillon.plans.registry import collector
from quillon.plans.views import class_clouds
from quillon.session import cut
from quillon.sources.tables import table

QUERIES, ORACLES, query = collector()

RUN = "run as (select case event_id % 2 when 0 then 'v1' else 'v2' end as version, user_id % 5 as seed, event_type as kind, avg(value) as metric, count(*) as n from events where value is not null group by 1, 2, 3)"


def run_level(spark, d):
    e = table(spark, d, "events").where("value is not null")
    v = F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2")
    return e.groupBy(v.alias("version"), (F.col("user_id") % 5).alias("seed"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("metric"), F.count("*").alias("n"))


@query(f"with {RUN} select a.kind, a.seed, round(a.metric, 7) as a_value, round(b.metric, 7) as b_value, round(b.metric - a.metric, 7) as delta from run a join run b on a.kind = b.kind and a.seed = b.seed and a.version = 'v1' and b.version = 'v2'")
def matched_deltas(spark, d):
    m = runs.matched_deltas(run_level(spark, d), ["kind", "seed"], "version", "v1", "v2", "metric")
    return m.select("kind", "seed", *[F.round(c, 7).alias(c) for c in ("a_value", "b_value", "delta")])


_T = ", ".join(str(x) for x in runs.T_CRITICAL)


@query(f"""with {RUN}, s as (select version, kind, count(*) as n, avg(metric) as mean, stddev_samp(metric) as sd, median(metric) as median, min(metric) as least, max(metric) as most from run group by 1, 2)
select version, kind, n, round(mean, 6) as mean, round(sd, 6) as sd, round(median, 6) as median, round(least, 6) as least, round(most, 6) as most,
round(mean - [{_T}][n - 1] * sd / sqrt(n), 6) as low, round(mean + [{_T}][n - 1] * sd / sqrt(n), 6) as high from s""")
def run_summary(spark, d):
    s = runs.summary(run_level(spark, d), ["version", "kind"], "metric")
    return s.select("version", "kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "least", "most", "low", "high")])


@query(f"""with {RUN}, r as (select *, rank() over (partition by kind order by metric) + (count(*) over (partition by kind, metric) - 1) / 2.0 as rx, rank() over (partition by kind order by n) + (count(*) over (partition by kind, n) - 1) / 2.0 as ry from run)
select kind, count(*) as k, round(corr(metric, n), 7) as pearson, round(corr(rx, ry), 7) as spearman from r group by 1 having count(*) >= 3""")
def run_correlations(spark, d):
    c = runs.correlations(run_level(spark, d), ["kind"], "metric", "n")
    return c.select("kind", F.col("n").alias("k"), F.round("pearson", 7).alias("pearson"), F.round("spearman", 7).alias("spearman"))


@query(f"""with {RUN}, m as (select a.kind, b.metric - a.metric as delta from run a join run b on a.kind = b.kind and a.seed = b.seed and a.version = 'v1' and b.version = 'v2'),
s as (select kind, count(*) filter (delta > 0) as favorable, count(*) filter (delta < 0) as adverse from m group by 1)
select kind, favorable, adverse, case when favorable >= 4 then 'improved' when adverse >= 4 then 'degraded' else 'mixed' end as label from s""")
def run_stability(spark, d):
    return runs.stability(runs.matched_deltas(run_level(spark, d), ["kind", "seed"], "version", "v1", "v2", "metric"), ["kind"], "delta")


@query(f"""with {RUN}, g as (select kind, version, avg(metric) as m, sum(n)::bigint as n from run group by 1, 2), p as (select kind, max(m) filter (version = 'v1') as v1, max(m) filter (version = 'v2') as v2 from g group by 1)
select kind, round(v1, 6) as v1, round(v2, 6) as v2, round(v2 - v1, 6) as shift,
round(case when max(v1) over () - min(v1) over () <= 1e-12 then 0 else (v1 - min(v1) over ()) / (max(v1) over () - min(v1) over ()) end + case when max(v2) over () - min(v2) over () <= 1e-12 then 0 else (v2 - min(v2) over ()) / (max(v2) over () - min(v2) over ()) end, 6) as composite from p""")
def run_shift(spark, d):
    p = run_level(spark, d).groupBy("kind").pivot("version", ["v1", "v2"]).agg(F.avg("metric"))
    return runs.min_max_total(p, ["v1", "v2"], "composite").select("kind", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"), F.round(F.col("v2") - F.col("v1"), 6).alias("shift"), F.round("composite", 6).alias("composite"))


@query(f"""with {RUN}, u as (unpivot (select version, kind, seed, round(metric, 7) as metric, n::double as n from run) on metric, n into name measure value amount)
select version, kind, seed, measure, amount from u""")
def run_long(spark, d):
    r = run_level(spark, d).select("version", "kind", "seed", F.round("metric", 7).alias("metric"), F.col("n").cast("double").alias("n"))
    return r.unpivot(["version", "kind", "seed"], ["metric", "n"], "measure", "amount")


# A bar runs from an event to the next of its user: (birth, death) are value and value plus the gap in hours; the last is essential.
BARS = """b0 as (select user_id, round(value, 4) as birth, round(value, 4) + round(epoch(lead(ts) over w - ts) / 3600, 3) as death from events where value is not null window w as (partition by user_id order by ts, event_id)),
bars as (select user_id, list({'birth': birth, 'death': coalesce(death, 'inf'::double)} order by birth, coalesce(death, 'inf'::double)) as b from b0 group by 1),
fin as (select user_id, b, list_filter(b, lambda x: isfinite(x.death) and x.death >= x.birth) as f from bars)"""


def bars(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.round((F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6 / 3600, 3)
    e = table(spark, d, "events").where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("birth", F.round("value", 4)).withColumn("death", F.coalesce(F.round("value", 4) + gap, F.lit(float("inf"))))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("birth", "death"))).alias("b"))


def grid_sql(name: str, points: int, where: str = "true") -> str:
    return f"""{name} as (select list_transform(range(0, {points}), lambda i: lo + i * ((hi - lo) / {points - 1})) as g from (
  select min(x.birth) as lo, max(x.death) as hi from (select unnest(f) as x from fin where {where})))"""


# Users that vectorizers are fitted on.
FITTED = "user_id % 5 != 0"
GRID = grid_sql("gr", 16, FITTED)


@query(f"with {BARS}, {GRID} select user_id, array_to_string(list_transform(g, lambda t: len(list_filter(f, lambda x: x.birth <= t and t < x.death))), ',') as curve, len(list_filter(b, lambda x: x.death = 'inf'::double)) as essential from fin, gr")
def betti_curves(spark, d):
    """Finite bars alive at 16 points from the least to the largest end of the fitting users' bars."""
    b = cut(bars(spark, d))
    both = b.crossJoin(F.broadcast(diagrams.fitted_grid(b.where(FITTED), "b", 16)))
    curve = diagrams.betti_curve(diagrams.finite_bars(F.col("b")), F.col("grid"))
    return both.select("user_id", F.array_join(curve.cast("array<string>"), ",").alias("curve"), diagrams.essential_count(F.col("b")).alias("essential"))


@query(f"""with {BARS}, l as (select user_id, list_transform(f, lambda x: x.death - x.birth) as v from fin), t as (select user_id, v, coalesce(list_sum(v), 0) as s from l)
select user_id, len(v) as n, round(s, 5) as total, round(case when len(v) > 0 then s / len(v) else 0 end, 6) as mean, round(coalesce(list_max(v), 0), 6) as longest,
  round(case when s > 0 then coalesce(list_sum(list_transform(list_filter(v, lambda x: x > 0), lambda x: -(x / s) * ln(greatest(x / s, 1e-12)))), 0) else 0 end, 6) as entropy,
  len(list_filter(v, lambda x: x >= 0.1 * list_max(v))) as n_long from t""")
def diagram_summaries(spark, d):
    s = bars(spark, d).select("user_id", diagrams.summary(F.col("b")).alias("s")).select("user_id", "s.*")
    return s.select("user_id", "n", F.round("total", 5).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "longest", "entropy")], "n_long")


@query(f"""with {BARS}, {GRID}, h as (select user_id, list_transform(g, lambda t: list_sort(list_transform(f, lambda x: greatest(0, least(t - x.birth, x.death - t))), 'DESC')) as r from fin, gr)
select user_id, round(list_sum(list_transform(r, lambda x: coalesce(x[1], 0))), 5) as level_1, round(list_sum(list_transform(r, lambda x: coalesce(x[2], 0))), 5) as level_2, round(list_sum(list_transform(r, lambda x: coalesce(x[3], 0))), 5) as level_3 from h""")
def landscapes(spark, d):
    """Sums of the three highest landscape levels over the fitted grid."""
    b = cut(bars(spark, d))
    v = b.crossJoin(F.broadcast(diagrams.fitted_grid(b.where(FITTED), "b", 16))).select("user_id", diagrams.landscape(F.col("b"), F.col("grid")).alias("v"))
    return v.select("user_id", *[F.round(vec.total(F.slice("v", i * 16 + 1, 16)), 5).alias(f"level_{i + 1}") for i in range(3)])


@query(f"""with {BARS}, bd as (select min(x.birth) as lo, max(x.birth) as hi, max(x.death - x.birth) as tall from (select unnest(f) as x from fin)),
c as (select user_id, least(floor((x.birth - lo) / (hi - lo) * 8), 7)::int as i, least(floor((x.death - x.birth) / tall * 8), 7)::int as j, x.death - x.birth as w from (select user_id, unnest(f) as x from fin), bd)
select user_id, i, j, round(sum(w), 5) as weight from c group by 1, 2, 3 having sum(w) > 0""")
def bar_histograms(spark, d):
    b = bars(spark, d)
    flat = b.select(F.explode(diagrams.finite_bars(F.col("b"))).alias("x"))
    bounds = flat.agg(F.min("x.birth").alias("lo"), F.max("x.birth").alias("hi"), F.max(F.col("x.death") - F.col("x.birth")).alias("tall"))
    v = b.crossJoin(F.broadcast(bounds)).select("user_id", F.posexplode(diagrams.weighted_histogram(F.col("b"), F.col("lo"), F.col("hi"), F.col("tall"))).alias("k", "w"))
    return v.where("w > 0").select("user_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.round("w", 5).alias("weight"))


@query()
def class_tree_summary(spark, d):
    """Zero-dimensional bars of the sampled test cloud of each class, the sample of ``rips_summary``."""
    deaths = class_clouds(spark, d).select("label", "n_points", diagrams.tree_deaths("c").alias("v"))
    zero = F.transform("v", lambda x: F.struct(F.lit(0.0).alias("birth"), x.alias("death")))
    return deaths.select("label", "n_points", diagrams.summary(zero).alias("s")).select("label", "n_points", F.col("s.n").alias("n_bars"), F.round("s.total", 6).alias("total"), F.round("s.longest", 6).alias("longest"), F.round("s.entropy", 6).alias("entropy"))


@query()
def bottleneck_distances(spark, d):
    """Bottleneck distance between the diagrams of each user and the next, over all finite bars."""
    b = bars(spark, d).select("user_id", F.transform(diagrams.finite_bars(F.col("b")), lambda x: F.array(x["birth"], x["death"])).alias("p"))
    other = b.select((F.col("user_id") - 1).alias("user_id"), F.col("p").alias("q"))
    return b.join(other, "user_id").select("user_id", F.round(diagrams.bottleneck("p", "q"), 6).alias("distance"))


# Boxes from keys: a truth box a line, and a detection that is the box moved a little.
BOX = """box as (select l_orderkey::varchar as image_id, l_orderkey::varchar || ':' || l_linenumber::varchar as gt_id, (l_partkey % 97)::double as x, (l_suppkey % 89)::double as y, 4 + (l_partkey % 13)::double as w, 4 + (l_suppkey % 11)::double as h,
  ((l_partkey + l_linenumber) % 5)::double as dx, (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber) % 1000003 / 1000003 as confidence from lineitem)"""


def _boxes(spark, d):
    part, supp, line = (F.col(c).cast("bigint") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    b = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("image_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("gt_id"), (part % 97).cast("double").alias("x"), (supp % 89).cast("double").alias("y"),
        (4 + part % 13).cast("double").alias("w"), (4 + supp % 11).cast("double").alias("h"), ((part + line) % 5).cast("double").alias("dx"), ((part * 7919 + supp * 104729 + line) % 1000003 / 1000003).alias("confidence"), "l_orderkey", "l_partkey",
    )
    box = lambda x: F.struct(x.alias("x_min"), F.col("y").alias("y_min"), (x + F.col("w")).alias("x_max"), (F.col("y") + F.col("h")).alias("y_max"))
    return b.withColumn("truth", box(F.col("x"))).withColumn("found", box(F.col("x") + F.col("dx")))


@query(f"""with {BOX}, o as (select gt_id, w, h, dx, x, y, greatest(w - dx, 0) * h as i from box)
select gt_id, round(i / (2 * w * h - i), 8) as iou, round(greatest(least(x + w, 64) - least(x, 64), 0) * greatest(least(y + h, 48) - least(y, 48), 0), 4) as visible, x <= 0 or y <= 0 or x + w >= 64 or y + h >= 48 as border from o""")
def box_overlap(spark, d):
    b = _boxes(spark, d)
    w, h = F.lit(64), F.lit(48)
    seen = boxes.clip(F.col("truth"), w, h)
    return b.select("gt_id", F.round(boxes.iou(F.col("truth"), F.col("found")), 8).alias("iou"), F.round(F.coalesce(boxes.area(seen), F.lit(0.0)), 4).alias("visible"), boxes.touches_border(F.col("truth"), w, h).alias("border"))


def _matches(spark, d, bound):
    b = _boxes(spark, d)
    g = b.select("image_id", "gt_id", "truth.*")
    f = b.select("image_id", F.col("gt_id").alias("detection_id"), "confidence", "found.*")
    return boxes.match_boxes(f, g, bound)


@query()
def detection_report(spark, d):
    """Counts, precision, recall and average precision of greedy matching at an overlap of one half."""
    m = cut(_matches(spark, d, 0.5))
    return boxes.precision_recall(m).crossJoin(boxes.average_precision(m, []).select(F.round("ap", 6).alias("ap50")))


@query(f"""with {BOX} select image_id, count(*) as n_boxes, array_to_string(list(gt_id order by gt_id), ',') as gt_ids, round(sum(w * h), 3) as covered from box group by 1""")
def boxes_by_image(spark, d):
    b = _boxes(spark, d)
    return b.groupBy("image_id").agg(F.count("*").alias("n_boxes"), F.array_join(F.sort_array(F.collect_list("gt_id")), ",").alias("gt_ids"), F.round(F.sum(boxes.area(F.col("truth"))), 3).alias("covered"))


@query()
def bootstrap_deltas(spark, d):
    """Entropy against maximum softmax on the test set: difference with its bootstrap interval."""
    from quillon.operators import scorers

    s = scored(spark, d).where("split = 'test'").select(F.col("pos").cast("int").alias("y"), F.col("score").alias("a"), F.round(scorers.predictive_entropy(F.col("z")), 9).alias("b"))
    return resample.bootstrap_delta(s)
