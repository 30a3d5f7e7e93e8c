"""Queries: audits, quality rules, sweeps and topology tables composed of other operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import boxes, diagrams, homology, metrics, near_duplicates, splits
from quillon.plans.evaluation import PREDICTED, SCORED, predictions, scored
from quillon.plans.manifest import EVIDENCE, M, evidence, manifest
from quillon.plans.registry import collector
from quillon.plans.sqltext import ARCHIVE
from quillon.plans.studies import BARS, _boxes, bars, grid_sql
from quillon.plans.views import archive, class_clouds
from quillon.session import cut

QUERIES, ORACLES, query = collector()


@query(f"""with {M}, t as (
  select 'rows' as item, count(*) as n from m union all select 'missing_split', count(*) from m where split = '' union all select 'missing_checksum', count(*) from m where checksum = ''
  union all select 'bad_size', count(*) from m where width is null or height is null or width <= 0 or height <= 0
  union all select 'unknown_in_training', count(*) from m where status = 'unknown' and split in ('train', 'validation')
  union all select 'contradictory_status', count(*) from (select sample_id from m where status in ('known', 'unknown') group by 1 having count(distinct status) > 1)
  union all select 'films_across_splits', count(*) from (select film from m where film != '' and split != '' group by 1 having count(distinct split) > 1)
  union all select 'checksums_across_splits', count(*) from (select checksum from m where checksum != '' and split != '' group by 1 having count(distinct split) > 1))
select item, n, item not in ('rows', 'missing_split', 'missing_checksum') and n > 0 as is_error from t""")
def manifest_audit(spark, d):
    """Counts of everything an audit of the manifest looks for, and whether it is an error."""
    m = cut(manifest(spark, d))
    size = F.col("width").isNull() | F.col("height").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    rows = m.agg(
        F.count("*").alias("rows"), F.count_if(F.col("split") == "").alias("missing_split"), F.count_if(F.col("checksum") == "").alias("missing_checksum"), F.count_if(size).alias("bad_size"),
        F.count_if((F.col("status") == "unknown") & F.col("split").isin("train", "validation")).alias("unknown_in_training"),
    )
    torn = m.where("status in ('known', 'unknown')").groupBy("sample_id").agg(F.min("status").alias("a"), F.max("status").alias("b")).where("a != b")
    spans = lambda c: splits.spanning_keys(m, c, "split").agg(F.count("*").alias("n"))
    out = rows.unpivot([], rows.columns, "item", "n")
    for name, df in (("contradictory_status", torn.agg(F.count("*").alias("n"))), ("films_across_splits", spans("film")), ("checksums_across_splits", spans("checksum"))):
        out = out.unionByName(df.select(F.lit(name).alias("item"), "n"))
    return out.select("item", "n", (~F.col("item").isin("rows", "missing_split", "missing_checksum") & (F.col("n") > 0)).alias("is_error"))


@query(f"""with {EVIDENCE}, r2 as (select key_a, key_b, level, bits, crosses, row_number() over (order by case level when 'confirmed' then 0 when 'probable_level1' then 1 when 'probable_level2' then 2 else 3 end, bits, same desc, similarity desc, correlation desc, key_a, key_b) as place from ev)
select * from r2 where place <= 100""")
def suspicious_pairs(spark, d):
    """The hundred near-duplicate pairs most worth a look: strong evidence, few bits, like fields."""
    order = [F.desc("rank"), F.col("bits"), F.desc("same"), F.desc("similarity"), F.desc("correlation"), F.col("key_a"), F.col("key_b")]
    top = evidence(spark, d)[1].withColumn("rank", near_duplicates.strength(F.col("level"))).orderBy(*order).limit(100)
    return top.select("key_a", "key_b", "level", "bits", "crosses", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


@query(f"""with {M}, q as (select sample_id, path, checksum, count(*) over (partition by path) > 1 as path_repeats, checksum != '' and count(*) over (partition by checksum) > 1 as checksum_repeats,
  coalesce(width < 256 or height < 256, true) as too_small, coalesce(greatest(width, height) > 2 * least(width, height), true) as elongated from m)
select sample_id, path, checksum, array_to_string(list_filter([case when path_repeats then 'path_repeats' end, case when checksum_repeats then 'checksum_repeats' end, case when too_small then 'too_small' end, case when elongated then 'elongated' end], lambda x: x is not null), ',') as flags,
  path_repeats::int + 2 * checksum_repeats::int + 2 * too_small::int + elongated::int as penalty from q""")
def quality_flags(spark, d):
    """Quality rules of a manifest row as flags and a penalty; repeats are found by counting keys."""
    m = manifest(spark, d)
    per = lambda c: m.groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    q = m.join(per("path"), "path").join(per("checksum"), "checksum")
    rules = {
        "path_repeats": (F.col("n_path") > 1, 1), "checksum_repeats": ((F.col("checksum") != "") & (F.col("n_checksum") > 1), 2),
        "too_small": (F.coalesce((F.col("width") < 256) | (F.col("height") < 256), F.lit(True)), 2),
        "elongated": (F.coalesce(F.greatest("width", "height") > 2 * F.least("width", "height"), F.lit(True)), 1),
    }
    penalty = F.lit(0)
    for hit, weight in rules.values():
        penalty = penalty + F.when(hit, weight).otherwise(0)
    named = F.array_compact(F.array(*[F.when(hit, name) for name, (hit, _) in rules.items()]))
    return q.select("sample_id", "path", "checksum", F.array_join(named, ",").alias("flags"), penalty.alias("penalty"))


@query(f"""with {ARCHIVE}, {SCORED}, {PREDICTED}, g as (select label, status, given, count(*) as k from pred group by all), per as (select label, status, sum(k)::bigint as n, sum(case when given = 'UNKNOWN' then k else 0 end)::bigint as rejected from g group by 1, 2),
mode as (select *, row_number() over (partition by label, status order by k desc, given) as r from g)
select label, per.status, n, round(rejected / n, 9) as rejected_share, given as most_given from per join mode using (label, status) where r = 1""")
def per_class_rejection(spark, d):
    g = predictions(spark, d).groupBy("label", "status", "given").agg(F.count("*").alias("k"))
    w = Window.partitionBy("label", "status").orderBy(F.desc("k"), "given")
    out = g.withColumn("r", F.row_number().over(w)).groupBy("label", "status").agg(
        F.sum("k").alias("n"), F.sum(F.when(F.col("given") == "UNKNOWN", F.col("k")).otherwise(0)).alias("rejected"), F.max(F.when(F.col("r") == 1, F.col("given"))).alias("most_given")
    )
    return out.select("label", "status", "n", F.round(F.col("rejected") / F.col("n"), 9).alias("rejected_share"), "most_given")


@query(f"""with {ARCHIVE}, {SCORED}, {PREDICTED}, c as (select score, sum((truth = 'UNKNOWN')::int) as p, count(*) as n from pred group by 1), r as (select score, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as k, sum(p) over () as np from c)
select score as threshold, round(tp / k, 9) as precision, round(tp / np, 9) as recall, round(2 * tp / (k + np), 9) as f1 from r order by round(2 * tp / (k + np), 12) desc, tp / np desc, score limit 1""")
def best_f1_threshold(spark, d):
    """The score threshold of the best F1 for finding unknown rows, by the larger recall on a tie."""
    c = metrics.score_counts(predictions(spark, d), [], F.col("truth") == "UNKNOWN", F.col("score"))
    run = metrics.falling(c, [], {"pos": "p", "neg": "n"}).crossJoin(F.broadcast(c.agg(F.sum("pos").alias("np"))))
    tp = F.col("p") + F.col("pos")
    r = run.select("score", tp.alias("tp"), (tp + F.col("n") + F.col("neg")).alias("k"), "np").where("np > 0")
    f1 = 2 * F.col("tp") / (F.col("k") + F.col("np"))
    return r.orderBy(F.desc(F.round(f1, 12)), F.desc("tp"), "score").limit(1).select(
        F.col("score").alias("threshold"), F.round(F.col("tp") / F.col("k"), 9).alias("precision"), F.round(F.col("tp") / F.col("np"), 9).alias("recall"), F.round(f1, 9).alias("f1")
    )


@query()
def detection_map(spark, d):
    """Average precision at overlaps 0.50 to 0.95 in steps of 0.05, and their mean in the last row."""
    b = cut(_boxes(spark, d))
    g, f = b.select("image_id", "gt_id", "truth.*"), b.select("image_id", F.col("gt_id").alias("detection_id"), "confidence", "found.*")
    bounds = [round(0.5 + 0.05 * k, 2) for k in range(10)]
    out = cut(boxes.average_precision(boxes.match_boxes(f, g, bounds), ["bound"]).select(F.col("bound").alias("overlap"), "ap"))
    mean = out.agg(F.avg("ap").alias("ap")).select(F.lit(None).cast("double").alias("overlap"), "ap")
    return out.unionByName(mean).select("overlap", F.round("ap", 6).alias("ap"))


@query(f"""with {BARS}, {grid_sql('gr', 201)}, c as (select user_id % 2 as half, list_transform(g, lambda t: len(list_filter(b, lambda x: x.birth <= t and t < x.death))) as v from fin, gr),
e as (select half, unnest(v) as y, unnest(range(0, 201)) as i from c), a as (select half, i, avg(y) as y from e group by 1, 2), p as (select x.i, x.y - z.y as g from a x join a z on x.i = z.i and x.half = 0 and z.half = 1)
select round(sqrt(sum(g * g)), 7) as l2, round(avg(abs(g)), 7) as mean_abs, round(max(abs(g)), 7) as max_abs from p""")
def betti_distance(spark, d):
    """Distance between the mean Betti curves of two halves of the users at 201 points over all bars, essential bars alive."""
    b = cut(bars(spark, d))
    both = b.crossJoin(F.broadcast(diagrams.fitted_grid(b, "b", 201)))
    c = both.select((F.col("user_id") % 2).alias("half"), F.posexplode(diagrams.betti_curve(F.col("b"), F.col("grid"))).alias("i", "y"))
    p = c.groupBy("i").pivot("half", [0, 1]).agg(F.avg("y")).select((F.col("0") - F.col("1")).alias("g"))
    return p.agg(F.round(F.sqrt(F.sum(F.col("g") * F.col("g"))), 7).alias("l2"), F.round(F.avg(F.abs("g")), 7).alias("mean_abs"), F.round(F.max(F.abs("g")), 7).alias("max_abs"))


@query()
def rips_summary(spark, d):
    """Bars of dimensions 0 and 1 of the sampled test cloud of each class, summarised."""
    bars_ = cut(class_clouds(spark, d).repartition(8).select("label", homology.cloud_persistence("c").alias("b")))
    out = None
    for k in (0, 1):
        of = F.transform(F.filter("b", lambda x: x["dim"] == k), lambda x: F.struct(x["birth"].alias("birth"), x["death"].alias("death")))
        one = bars_.select("label", F.lit(k).alias("dim"), diagrams.summary(of).alias("s"), diagrams.essential_count(of).alias("n_essential"))
        out = one if out is None else out.unionByName(one)
    return out.select("label", "dim", "n_essential", F.col("s.n").alias("n_bars"), F.round("s.total", 6).alias("total"), F.round("s.longest", 6).alias("longest"))


@query()
def field_persistence_summary(spark, d):
    """Sublevel bars of 8 x 12 fields made of the 96 coordinates of every sample, summarised."""
    rows = F.array(*[F.slice("e", 12 * i + 1, 12) for i in range(8)])
    b = archive(spark, d).select("sample_id", rows.alias("f")).select("sample_id", homology.field_persistence("f").alias("b"))
    n = lambda k: F.size(F.filter("b", lambda x: x["dim"] == k))
    return cut(b).select("sample_id", n(0).alias("n_components"), n(1).alias("n_holes"))


@query(f"with {ARCHIVE} select sample_id, (list_min(e) < 0 or list_max(e) > 1)::int as failed, case when list_min(e) < 0 or list_max(e) > 1 then 'values outside 0 to 1' end as error from archive")
def field_diagram_errors(spark, d):
    """Superlevel diagrams of fields that must lie within 0 to 1: which samples fail, and why."""
    rows = F.array(*[F.slice("e", 12 * i + 1, 12) for i in range(8)])
    got = archive(spark, d).select("sample_id", homology.field_diagrams(rows, superlevel=True, unit=True).alias("g"))
    return got.select("sample_id", F.col("g.error").isNotNull().cast("int").alias("failed"), F.col("g.error").alias("error"))


@query(f"""with {ARCHIVE}, {SCORED} select split, status, count(*) as n, round(avg(score), 8) as mean, round(stddev_samp(score), 8) as sd, round(min(score), 8) as least, round(quantile_cont(score, 0.25), 8) as q25, round(median(score), 8) as q50, round(quantile_cont(score, 0.75), 8) as q75, round(max(score), 8) as most from scored group by all""")
def score_description(spark, d):
    s = cut(scored(spark, d).select("split", "status", "score"))
    by = ["split", "status"]
    rest = s.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.min("score").alias("least"), F.max("score").alias("most"))
    out = rest.join(metrics.quantiles(s, by, "score", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by)
    return out.select(*by, "n", *[F.round(c, 8).alias(c) for c in ("mean", "sd", "least", "q25", "q50", "q75", "most")])
