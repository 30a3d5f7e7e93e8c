"""Queries: scores of the embedding archive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators import centroids, fields, metrics, scorers
from quillon.operators.neighbors import BLOCK_ROWS, PART_BLOCKS, nearest_neighbors, packed, products
from quillon.plans.sqltext import ARCHIVE
from quillon.plans.views import archive
from quillon.session import cut, release

# The similarity with a zero vector is 0, where the function gives NaN.
_COSINE = re.compile(r"list_cosine_similarity\(([\w.]+), ([\w.]+)\)")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _COSINE.sub(r"coalesce(nullif(list_cosine_similarity(\1, \2), 'nan'::double), 0)", sql)
        return f

    return keep


# Text pieces of the statements.
MEANS = """
dims as (select label, i, avg(e[i]) as m, count(*) as n from archive, range(1, 97) r(i) where split = 'train' and status = 'known' group by 1, 2),
means as (select label, list(m order by i) as m, max(n) as n from dims group by 1)"""
NEAR = """
pair as (select sample_id, a.label, status, split, means.label as c, sqrt(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) ** 2))) as d from archive a, means),
ranked as (select *, row_number() over (partition by sample_id order by d, c) as r, lead(d) over (partition by sample_id order by d, c) as second from pair),
near as (select * from ranked where r = 1)"""
LSE = "list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))"
SOFT = "list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))"


def auroc_sql(source: str, score: str) -> str:
    return f"""(select sum(case when pos then rk end) as rs, sum(pos::int) as np, sum((not pos)::int) as nn from (
    select pos, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as rk from {source}))"""


def _means(a: DataFrame) -> DataFrame:
    return centroids.class_means(scorers.train_only(a), "label", "e")


@query(f"""with {ARCHIVE}, {MEANS}, {NEAR}
select sample_id, label, c as nearest_label, round(d, 6) as nearest, round(second, 6) as second, round(second - d, 6) as margin from near where split = 'test'""")
def osr_centroid_scores(spark, d):
    a = archive(spark, d)
    near = centroids.with_nearest(a.where("split = 'test'"), _means(a), "label", "e")
    return near.select("sample_id", "label", "nearest_label", *[F.round(c, 6).alias(c) for c in ("nearest", "second", "margin")])


@query(f"""with {ARCHIVE}, {MEANS}, {NEAR}, s as (select round(d, 9) as score, status = 'unknown' as pos from near where split = 'test'),
u as {auroc_sql('s', 'score')} select round((rs - np * (np + 1) / 2.0) / (np * nn), 9) as auroc from u""")
def osr_centroid_auroc(spark, d):
    a = archive(spark, d)
    near = centroids.with_nearest(a.where("split = 'test'"), _means(a), "label", "e")
    counts = metrics.score_counts(near, [], F.col("status") == "unknown", F.round("nearest", 9))
    return metrics.auroc(counts, []).select(F.round("auroc", 9).alias("auroc"))


@query(f"""with {ARCHIVE}, s as (select sample_id, {SOFT} as p, z from archive)
select sample_id, round(1 - list_max(p), 8) as msp, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 8) as entropy,
  round(-({LSE}), 8) as energy_t1,
  round(-0.5 * (list_max(z) / 0.5 + ln(list_sum(list_transform(z, lambda x: exp(x / 0.5 - list_max(z) / 0.5))))), 8) as energy_t05,
  round(-2.0 * (list_max(z) / 2.0 + ln(list_sum(list_transform(z, lambda x: exp(x / 2.0 - list_max(z) / 2.0))))), 8) as energy_t2 from s""")
def score_logits(spark, d):
    z = F.col("z")
    cols = {"msp": scorers.maximum_softmax(z), "entropy": scorers.predictive_entropy(z), "energy_t1": scorers.energy(z), "energy_t05": scorers.energy(z, 0.5), "energy_t2": scorers.energy(z, 2.0)}
    return archive(spark, d).select("sample_id", *[F.round(c, 8).alias(n) for n, c in cols.items()])


@query(f"""with {ARCHIVE}, s as (select sample_id, {SOFT} as p from archive)
select sample_id, list_position(p, list_max(p)) - 1 as top1, round(list_sort(p, 'DESC')[1], 8) as confidence,
  round(list_sort(p, 'DESC')[2], 8) as runner_up, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 8) as margin from s""")
def signals_top2(spark, d):
    s = archive(spark, d).select("sample_id", vec.softmax(F.col("z")).alias("p")).withColumn("o", F.sort_array("p", asc=False))
    one, two = F.get("o", 0), F.get("o", 1)
    return s.select("sample_id", vec.argmax(F.col("p")).alias("top1"), F.round(one, 8).alias("confidence"), F.round(two, 8).alias("runner_up"), F.round(one - two, 8).alias("margin"))


UNIT = "unit as (select *, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) as u from archive)"


@query(f"""with {ARCHIVE}, {UNIT},
dims as (select label, i, avg(u[i]) as m from unit, range(1, 97) r(i) where split = 'train' and status = 'known' group by 1, 2),
means as (select label, list(m order by i) as m from dims group by 1)
select sample_id, round(1 - max(list_cosine_similarity(e, m)), 8) as score from archive, means where split != 'train' group by 1""")
def score_ncm_cosine(spark, d):
    a = archive(spark, d).withColumn("u", vec.l2_normalize(F.col("e")))
    means = centroids.class_means(scorers.train_only(a), "label", "u")
    near = centroids.with_nearest(a.where("split != 'train'"), means, "label", "e", "cosine")
    return near.select("sample_id", F.round("nearest", 8).alias("score"))


@query(f"""with {ARCHIVE}, s as (
  select q.sample_id, greatest(0, least(2, 1 - list_cosine_similarity(q.e, b.e))) as d, row_number() over (partition by q.sample_id order by round(1 - list_cosine_similarity(q.e, b.e), 12), b.sample_id) as r
  from archive q, archive b where q.split != 'train' and b.split = 'train' and b.status = 'known')
select sample_id, round(avg(d) filter (r <= 1), 8) as knn1, round(avg(d) filter (r <= 5), 8) as knn5, round(avg(d) filter (r <= 10), 8) as knn10 from s group by 1""")
def score_knn(spark, d):
    a = cut(archive(spark, d).select("sample_id", "status", "split", "e"))
    near = nearest_neighbors(a.where("split != 'train'"), scorers.train_only(a), "sample_id", "e", 10)
    release(a)
    mean = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, F.col("distance"))), 8).alias(f"knn{k}")
    return near.groupBy(F.col("id").alias("sample_id")).agg(mean(1), mean(5), mean(10))


@query(f"""with {ARCHIVE}, st as (select i, avg(e[i]) as m, stddev_pop(e[i]) as s from archive, range(1, 97) r(i) where split = 'train' and status = 'known' group by 1),
sl as (select list(m order by i) as m, list(case when s = 0 then 1 else s end order by i) as s from st),
w as (select sample_id, label, status, split, list_transform(list_zip(e, m, s), lambda p: (p[1] - p[2]) / p[3]) as e from archive, sl),
dims as (select label, i, avg(e[i]) as m from w, range(1, 97) r(i) where split = 'train' and status = 'known' group by 1, 2),
means as (select label, list(m order by i) as m from dims group by 1)
select sample_id, round(min(sqrt(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) ** 2)))), 6) as score from w, means where split != 'train' group by 1""")
def score_standardized_centroid(spark, d):
    a = archive(spark, d)
    w = centroids.standardized(a, scorers.train_only(a), "e", "e")
    return centroids.with_nearest(w.where("split != 'train'"), _means(w), "label", "e").select("sample_id", F.round("nearest", 6).alias("score"))


@query(f"""with {ARCHIVE}, {MEANS}, cap as (select quantile_cont(x, 0.9) as c from (select unnest(e) as x from archive where split = 'train' and status = 'known')),
r as (select sample_id, list_transform(e, lambda x: least(x, c)) as e from archive, cap where split != 'train'),
h as (select sample_id, list(list_sum(list_transform(list_zip(e, m), lambda p: p[1] * p[2])) / 96 order by label) as z from r, means group by 1)
select sample_id, round(-({LSE}), 8) as score from h""")
def score_react(spark, d):
    a = archive(spark, d)
    score = scorers.clipped_energy(scorers.train_only(a), a.where("split != 'train'"), 0.9)
    return score.select("sample_id", F.round("score", 8).alias("score"))


def _fitted(name):
    def run(spark, d):
        a = archive(spark, d)
        s = scorers.create_scorer(name).fit(scorers.train_only(a))
        return a.where("split != 'train'").select("sample_id", F.round(s.score(), 6).alias("score"))

    run.__name__ = f"score_{name}"
    return run


for _name in ("mahalanobis", "mahalanobis_lw", "relative_mahalanobis", "vim"):
    query()(_fitted(_name))


@query(f"""with {ARCHIVE}, {MEANS}, x as (select list_transform(list_zip(e, m), lambda p: p[1] - p[2]) as v from archive a join means on a.label = means.label where split = 'train' and status = 'known'),
n as (select count(*) as n from x) select i - 1 as i, j - 1 as j, round(sum(v[i] * v[j]) / greatest(1, (select n from n) - 1), 5) as covariance from x, range(1, 97) a(i), range(1, 97) b(j) where i <= j group by 1, 2""")
def pooled_covariance(spark, d):
    """Upper half of the pooled within-class covariance of the training vectors, from one pass of moments."""
    m = scorers.gather_moments(scorers.train_only(archive(spark, d)), "label", "e")
    c = m.within() / max(1.0, m.n.sum() - 1)
    size = len(c)
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 5) + 0.0) for i in range(size) for j in range(i, size)], "i int, j int, covariance double")


@query(f"""with {ARCHIVE}, {MEANS} select a.label as label_a, b.label as label_b,
round(case when a.label = b.label then 0 else sqrt(list_sum(list_transform(list_zip(a.m, b.m), lambda p: (p[1] - p[2]) ** 2))) end, 6) as distance from means a, means b""")
def centroid_distance_matrix(spark, d):
    m = centroids.mean_distances(_means(archive(spark, d)), "label")
    return m.withColumn("distance", F.round("distance", 6))


@query(f"""with {ARCHIVE}, {MEANS},
own as (select a.label, sqrt(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) ** 2))) as d, list_cosine_similarity(e, m) as c from archive a join means on a.label = means.label where split = 'train' and status = 'known'),
w as (select label, count(*) as n, avg(d) as dispersion, avg(c) as compactness from own group by 1),
b as (select x.label, min(sqrt(list_sum(list_transform(list_zip(x.m, y.m), lambda p: (p[1] - p[2]) ** 2)))) as separation from means x, means y where x.label != y.label group by 1)
select label, n, round(dispersion, 6) as dispersion, round(compactness, 6) as compactness, round(separation, 6) as separation, round(separation / nullif(dispersion, 0), 6) as ratio from w join b using (label)""")
def class_compactness(spark, d):
    a = archive(spark, d)
    m = _means(a)
    own = scorers.train_only(a).join(F.broadcast(m.select("label", "mean")), "label")
    dist, sim = vec.distance(F.col("e"), F.col("mean")), vec.dot(vec.l2_normalize(F.col("e")), vec.l2_normalize(F.col("mean")))
    within = own.groupBy("label").agg(F.count("*").alias("n"), F.avg(dist).alias("dispersion"), F.avg(sim).alias("compactness"))
    between = centroids.mean_distances(m, "label").where("label_a != label_b").groupBy(F.col("label_a").alias("label")).agg(F.min("distance").alias("separation"))
    return within.join(between, "label").select(
        "label", "n", *[F.round(c, 6).alias(c) for c in ("dispersion", "compactness", "separation")], F.round(F.try_divide("separation", F.nullif(F.col("dispersion"), F.lit(0.0))), 6).alias("ratio")
    )


@query(f"""with {ARCHIVE}, s as (
  select q.label, b.label as other, row_number() over (partition by q.sample_id order by round(1 - list_cosine_similarity(q.e, b.e), 12), b.sample_id) as r
  from archive q, archive b where q.split = 'test' and b.split = 'test' and q.sample_id != b.sample_id)
select label, count(*) as n_neighbors, round(avg((label != other)::double), 8) as mixing from s where r <= 10 group by 1""")
def cross_mixing(spark, d):
    a = archive(spark, d).where("split = 'test'")
    near = nearest_neighbors(a, a, "sample_id", "e", 10, skip_self=True)
    names = a.select("sample_id", "label")
    joined = near.join(names.select(F.col("sample_id").alias("id"), "label"), "id").join(names.select(F.col("sample_id").alias("neighbor"), F.col("label").alias("other")), "neighbor")
    return joined.groupBy("label").agg(F.count("*").alias("n_neighbors"), F.round(F.avg((F.col("label") != F.col("other")).cast("double")), 8).alias("mixing"))


@query(f"""with {ARCHIVE}, {MEANS}, {NEAR}, u as (select label, c, count(*) as k from near where split = 'test' and status = 'unknown' group by 1, 2)
select l.label as unknown_class, m.label as known_class, round(coalesce(u.k, 0) / sum(coalesce(u.k, 0)) over (partition by l.label), 8) as fraction
from (select distinct label from u) l cross join means m left join u on u.label = l.label and u.c = m.label""")
def attractor_matrix(spark, d):
    a = archive(spark, d)
    m = _means(a)
    near = centroids.with_nearest(a.where("split = 'test' and status = 'unknown'"), m, "label", "e").groupBy("label", "nearest_label").agg(F.count("*").alias("k"))
    grid = near.select(F.col("label").alias("unknown_class")).distinct().crossJoin(F.broadcast(m.select(F.col("label").alias("known_class"))))
    full = grid.join(near, (F.col("unknown_class") == F.col("label")) & (F.col("known_class") == F.col("nearest_label")), "left").fillna(0, ["k"])
    return full.select("unknown_class", "known_class", F.round(F.col("k") / F.sum("k").over(Window.partitionBy("unknown_class")), 8).alias("fraction"))


@query(f"""with {ARCHIVE}, {MEANS}, {NEAR}, u as (select label, c, count(*) as k from near where split = 'test' and status = 'unknown' group by 1, 2)
select label as unknown_class, c as attractor, k as n from (select *, row_number() over (partition by label order by k desc, c) as r from u) where r = 1""")
def attractor_mode(spark, d):
    a = archive(spark, d)
    near = centroids.with_nearest(a.where("split = 'test' and status = 'unknown'"), _means(a), "label", "e").groupBy("label", "nearest_label").agg(F.count("*").alias("k"))
    w = Window.partitionBy("label").orderBy(F.desc("k"), "nearest_label")
    return near.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("label").alias("unknown_class"), F.col("nearest_label").alias("attractor"), F.col("k").alias("n"))


@query(f"""with {ARCHIVE}, {MEANS}, {NEAR}, k as (
  select q.sample_id, 1 - list_cosine_similarity(q.e, b.e) as d, row_number() over (partition by q.sample_id order by round(1 - list_cosine_similarity(q.e, b.e), 12), b.sample_id) as r
  from archive q, archive b where q.split = 'test' and q.status = 'unknown' and b.split = 'train' and b.status = 'known'),
kn as (select sample_id, avg(d) as knn from k where r <= 10 group by 1)
select label, count(*) as n, round(avg(d), 6) as mean_nearest, round(median(second - d), 6) as median_margin, round(avg(knn), 8) as mean_knn, round(median(knn), 8) as median_knn
from near join kn using (sample_id) group by 1""")
def unknown_geometry(spark, d):
    a = archive(spark, d)
    u = a.where("split = 'test' and status = 'unknown'")
    near = centroids.with_nearest(u, _means(a), "label", "e")
    knn = nearest_neighbors(u, scorers.train_only(a), "sample_id", "e", 10).groupBy(F.col("id").alias("sample_id")).agg(F.avg("distance").alias("knn"))
    both = cut(near.join(knn, "sample_id").select("label", "nearest", "margin", "knn"))
    out = both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("nearest"), 6).alias("mean_nearest"), F.round(F.avg("knn"), 8).alias("mean_knn"))
    for c, digits in (("margin", 6), ("knn", 8)):
        out = out.join(metrics.medians(both, ["label"], c, "m").select("label", F.round("m", digits).alias(f"median_{c}")), "label")
    return out


@query(f"""with {ARCHIVE}, p as (select a.sample_id, a.e as x, b.e as y from archive a join archive b on a.label = b.label and a.split = 'test' and b.split = 'validation' and a.status = 'known' and b.status = 'known'),
m as (select sample_id, x, y, list_avg(x) as mx, list_avg(y) as my from p),
q as (select *, list_avg(list_transform(x, lambda v: (v - mx) ** 2)) as vx, list_avg(list_transform(y, lambda v: (v - my) ** 2)) as vy, list_avg(list_transform(list_zip(x, y), lambda v: (v[1] - mx) * (v[2] - my))) as c from m)
select sample_id, round(max((2 * mx * my + 1e-4) * (2 * c + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4))), 7) as best_similarity, round(max(c / sqrt(vx * vy)), 7) as best_correlation from q group by 1""")
def field_similarity(spark, d):
    """Best structural similarity and correlation of a test sample with the validation samples of its class."""
    a = cut(archive(spark, d).where("status = 'known' and split in ('test', 'validation')").select("sample_id", "label", "split", "e"))
    side = lambda name, **parts: packed(a.where(F.col("split") == name), "sample_id", "e", BLOCK_ROWS, "label", **parts)
    test, bank = side("test"), side("validation", part_blocks=PART_BLOCKS)
    # Written as a range, so that the join stays a product of blocks and the largest class is not one task.
    own = (F.col("kind") <= F.col("bank_kind")) & (F.col("kind") >= F.col("bank_kind"))
    best = products(test, bank, fields.Best, fields.Best.meet, fields.Best.rows, fields.SCHEMA, own)
    return best.groupBy("sample_id").agg(F.round(F.max("similarity"), 7).alias("best_similarity"), F.round(F.max("correlation"), 7).alias("best_correlation"))
