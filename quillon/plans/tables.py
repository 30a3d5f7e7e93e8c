"""Queries: comparisons of methods, classes, runs and domains, and rules over measured fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import names, vec
from quillon.operators import boxes, calibrate, checks, diagrams, homology, metrics, resample, rules, runs, scorers
from quillon.operators.centroids import class_means, with_nearest
from quillon.operators.tdist import correlation_p
from quillon.plans import evaluation as ev
from quillon.plans.evaluation import PREDICTED, SCORED, predictions, scored
from quillon.plans.manifest import ONE, samples
from quillon.plans.registry import collector
from quillon.plans.scores import MEANS, NEAR, auroc_sql
from quillon.plans.sqltext import ARCHIVE
from quillon.plans.studies import BARS, FITTED, GRID, RUN, _boxes, bars, run_level
from quillon.plans.views import archive
from quillon.session import cut, parallelism, release, small_side
from quillon.sources.tables import table

QUERIES, ORACLES, query = collector()


# Both scores of each usable sample, once: maximum softmax (a) and entropy (b), with their strict thresholds.
TWO = f"""{ARCHIVE}, {SCORED}, one_s as (select * from (select *, row_number() over (partition by sample_id order by label, status, split, e, z) as rn from scored) where rn = 1),
two as (select *, score as a, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 9) as b from one_s),
lim as (select round(quantile_cont(a, 0.95), 9) as ta, round(quantile_cont(b, 0.95), 9) as tb from two where split = 'validation' and status = 'known')"""


def two_scores(spark, d):
    s = scored(spark, d).withColumn("b", F.round(scorers.predictive_entropy(F.col("z")), 9))
    keep = ["label", "status", "split", "e", "z", "score", "b", "predicted", "pos"]
    one = s.groupBy("sample_id").agg(F.min(F.struct(*keep)).alias("r")).select("sample_id", "r.*").withColumnRenamed("score", "a")
    one = cut(one)
    cal = one.where("split = 'validation' and status = 'known'")
    lim = [calibrate.strict_threshold(cal, c).select(F.round("threshold", 9).alias(f"t{c}")) for c in "ab"]
    return one, lim[0].crossJoin(lim[1])


@query(f"with {TWO} select sample_id, a as score_a, b as score_b, case when a > ta then 'UNKNOWN' else predicted end as given_a, case when b > tb then 'UNKNOWN' else predicted end as given_b, (a > ta) = (b > tb) as agree from two, lim where split = 'test'")
def paired_predictions(spark, d):
    """Predictions of two methods for each test sample side by side, by a checked one-to-one join."""
    one, lim = two_scores(spark, d)
    test = one.where("split = 'test'").crossJoin(F.broadcast(lim))
    given = lambda c: F.when(F.col(c) > F.col(f"t{c}"), "UNKNOWN").otherwise(F.col("predicted")).alias("given")
    sides = [cut(test.select("sample_id", F.col(c).alias("score"), given(c))) for c in "ab"]
    j = checks.one_to_one(*sides, ["sample_id"])
    unknown = lambda k: F.col(f"given_{k}") == "UNKNOWN"
    return j.select("sample_id", "score_a", "score_b", "given_a", "given_b", (unknown("a") == unknown("b")).alias("agree"))


def _class_sql(c: str) -> str:
    return f"""al_{c} as (select label, {c} as score, true as pos from u union all select l.label, k.{c}, false from (select distinct label from u) l, k),
rk_{c} as (select label, pos, rank() over (partition by label order by score) + (count(*) over (partition by label, score) - 1) / 2.0 as r from al_{c}),
au_{c} as (select label, (sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / (sum(pos::int) * sum((not pos)::int)) as auroc from rk_{c} group by 1),
fp_{c} as (select label, avg((k.{c} > q)::double) as fpr from k, (select label, quantile_cont({c}, 1 - 0.95) as q from u group by 1) group by 1)"""


@query(f"""with {TWO}, k as (select a, b from two where split = 'test' and not pos), u as (select label, a, b from two where split = 'test' and pos), {_class_sql('a')}, {_class_sql('b')}
select label, (select count(*) from u where u.label = au_a.label) as n, case {' '.join(f"when label in ({', '.join(repr(x) for x in v)}) then '{g}'" for g, v in names.UNKNOWN_GROUPS.items())} else 'unassigned' end as unknown_group, round(au_b.auroc, 8) as auroc, round(fp_b.fpr, 8) as fpr95,
  round(au_b.auroc - au_a.auroc, 8) as delta_auroc, round(fp_b.fpr - fp_a.fpr, 8) as delta_fpr95 from au_a join au_b using (label) join fp_a using (label) join fp_b using (label)""")
def per_class_deltas(spark, d):
    """Each unknown class against all known rows under the entropy score, with the differences to maximum softmax."""
    one, _ = two_scores(spark, d)
    test = one.where("split = 'test'")
    classes = cut(test.where("pos").groupBy("label").agg(F.count("*").alias("n")))
    out = classes
    for c in "ab":
        u, k = test.where("pos").select("label", F.col(c).alias("score")), test.where("not pos").select(F.col(c).alias("score"))
        known = k.groupBy("score").agg(F.count("*").alias("m"))
        rows = u.groupBy("label", "score").agg(F.count("*").alias("pos")).withColumn("neg", F.lit(0).cast("bigint"))
        spread = known.crossJoin(small_side(classes.select("label"))).select("label", "score", F.lit(0).cast("bigint").alias("pos"), F.col("m").alias("neg"))
        counts = cut(rows.unionByName(spread).groupBy("label", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
        one_side = metrics.auroc(counts, ["label"]).join(metrics.fpr_of_counts(counts, ["label"]), "label")
        out = out.join(one_side.select("label", F.col("auroc").alias(f"auroc_{c}"), F.col("fpr").alias(f"fpr_{c}")), "label")
    r = lambda x, name: F.round(x, 8).alias(name)
    return out.select(
        "label", "n", names.unknown_group(F.col("label")).alias("unknown_group"), r(F.col("auroc_b"), "auroc"), r(F.col("fpr_b"), "fpr95"),
        r(F.col("auroc_b") - F.col("auroc_a"), "delta_auroc"), r(F.col("fpr_b") - F.col("fpr_a"), "delta_fpr95"),
    )


@query(f"""with {ARCHIVE}, {SCORED}, {PREDICTED}, cs as (select -score as s, sum((not pos)::int) as a, sum(pos::int) as b from pred group by 1),
run as (select a, sum(a) over (order by s desc) as ca, sum(b) over (order by s desc) as cb from cs) select round(sum(a * ca / (ca + cb)) / sum(a), 9) as known_aupr from run""")
def known_positive_aupr(spark, d):
    """Average precision with known rows as the positive class, sure ones first."""
    p = predictions(spark, d)
    counts = metrics.score_counts(p, [], ~F.col("pos"), -F.col("score"))
    return metrics.average_precision(counts, []).select(F.round("aupr", 9).alias("known_aupr"))


@query(f"""with {ev.SIGNALS}, {ev.POINTS}, {ONE}, t as (select sig.*, one.label from sig join one using (sample_id) where sig.split = 'test' and sig.status = 'unknown' and one.label is not null),
h as (select strategy, target, label, confidence, unknown_score, case strategy when 'confidence_only' then confidence >= c when 'confidence_margin' then confidence >= c and margin >= m else quality and unknown_score < u and confidence >= c and margin >= m end as hit from t, point)
select strategy, target, label, count(*) as n, round(avg(confidence), 8) as mean_confidence, round(median(confidence), 8) as median_confidence, round(avg(unknown_score), 8) as mean_unknown, round(median(unknown_score), 8) as median_unknown, round(avg(hit::double), 8) as accept_rate from h group by 1, 2, 3""")
def per_class_triage(spark, d):
    """Share of each unknown class that each operating point accepts, with its scores."""
    s = cut(ev.signals(spark, d))
    points = calibrate.operating_points(s.where("split = 'validation' and status = 'known'"), list(ev.TARGETS))
    t = s.where("split = 'test' and status = 'unknown'").join(samples(spark, d).where("label is not null").select("sample_id", "label"), "sample_id")
    stats = t.groupBy("label").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("unknown_score").alias("mean_unknown"))
    for c, name in (("confidence", "median_confidence"), ("unknown_score", "median_unknown")):
        stats = stats.join(metrics.medians(t, ["label"], c, name), "label")
    both = t.crossJoin(F.broadcast(points.select("strategy", "target", F.col("confidence").alias("c"), F.col("margin").alias("m"), F.col("unknown").alias("u"))))
    hit = calibrate.accepted_by(F.col("strategy"), *[F.col(x) for x in ("confidence", "margin", "unknown_score", "quality_pass", "c", "m", "u")])
    rate = both.groupBy("strategy", "target", "label").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accept_rate"))
    out = rate.join(small_side(cut(stats)), "label")
    return out.select("strategy", "target", "label", "n", *[F.round(c, 8).alias(c) for c in ("mean_confidence", "median_confidence", "mean_unknown", "median_unknown", "accept_rate")])


# A sample's seed: the place of its last id character among 16.
SEED = "strpos('0123456789abcdef', right(sample_id, 1)) % 5"
ATTRACT = f"""att as (select {SEED} as seed, label, predicted, count(*) as k from scored where status = 'unknown' and split = 'test' group by 1, 2, 3),
grid as (select seed, label, c as known_class from (select distinct seed, label from att), (select unnest([{ev._NAMES}]) as c)),
frac as (select grid.seed, grid.label, known_class, coalesce(k, 0) / sum(coalesce(k, 0)) over (partition by grid.seed, grid.label) as fraction from grid left join att on att.seed = grid.seed and att.label = grid.label and att.predicted = known_class)"""


@query(f"with {ARCHIVE}, {SCORED}, {ATTRACT} select label as unknown_class, known_class, count(*) as n, round(avg(fraction), 8) as mean_fraction, round(stddev_samp(fraction), 8) as sd_fraction, round(min(fraction), 8) as min_fraction, round(max(fraction), 8) as max_fraction from frac group by 1, 2")
def attractor_stability(spark, d):
    """Over seeds, the share of each unknown class that goes to each known class."""
    seed = (F.instr(F.lit("0123456789abcdef"), F.right("sample_id", F.lit(1))) % 5).alias("seed")
    s = scored(spark, d).where("status = 'unknown' and split = 'test'")
    counts = cut(s.groupBy(seed, "label", "predicted").agg(F.count("*").alias("k")))
    wide = counts.groupBy("seed", "label").pivot("predicted", list(ev.CLASSES)).agg(F.sum("k")).fillna(0, list(ev.CLASSES))
    total = sum((F.col(c) for c in ev.CLASSES[1:]), F.col(ev.CLASSES[0]))
    shares = wide.select("seed", F.col("label").alias("unknown_class"), *[(F.col(c) / total).alias(c) for c in ev.CLASSES])
    frac = shares.unpivot(["seed", "unknown_class"], list(ev.CLASSES), "known_class", "fraction")
    r = lambda f, name: F.round(f("fraction"), 8).alias(name)
    return frac.groupBy("unknown_class", "known_class").agg(F.count("*").alias("n"), r(F.avg, "mean_fraction"), r(F.stddev_samp, "sd_fraction"), r(F.min, "min_fraction"), r(F.max, "max_fraction"))


@query(f"""select * from ({ev.ORACLES['closed_set_summary']}), ({ev.ORACLES['calibration_metrics']}), (select round(avg(f1), 9) as macro_f1 from ({ev.ORACLES['closed_set_report']})),
(pivot (select metric, value from ({ev.ORACLES['open_set_metrics']}) where metric in ('auroc', 'fpr95', 'oscr')) on metric in ('auroc', 'fpr95', 'oscr') using max(value))""")
def run_metrics(spark, d):
    """Closed-set, calibration and open-set metrics of one run in one row."""
    closed = ev.closed_set_summary(spark, d).crossJoin(ev.calibration_metrics(spark, d))
    f1 = ev.closed_set_report(spark, d).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))
    open_ = ev.open_set_metrics(spark, d).groupBy().pivot("metric", ["auroc", "fpr95", "oscr"]).agg(F.max("value"))
    return closed.crossJoin(f1).crossJoin(open_)


_LYMPHOID = ", ".join(f"'{x}'" for x in names.UNKNOWN_GROUPS["lymphoid_related"])


@query(f"""with {ARCHIVE}, {SCORED}, {MEANS}, {NEAR}, g as (select label, count(*) as n, avg(d) as dist, avg(second - d) as margin from near where split = 'test' and label in ({_LYMPHOID}) group by 1),
a2 as (select label, avg((predicted = 'lymphocyte')::double) as share, avg(score) as score from scored where split = 'test' and label in ({_LYMPHOID}) group by 1)
select label, n, round(dist, 6) as nearest_distance, round(margin, 6) as prototype_margin, round(share, 8) as share_to_lymphocyte, round(score, 8) as mean_score from g join a2 using (label)""")
def lymphoid_failures(spark, d):
    """Where the lymphoid unknown classes lie and how many go to the lymphocyte class."""
    a = cut(scored(spark, d))
    means = class_means(scorers.train_only(a), "label", "e")
    of = a.where("split = 'test'").where(F.col("label").isin(*names.UNKNOWN_GROUPS["lymphoid_related"]))
    g = with_nearest(of, means, "label", "e")
    return g.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("nearest"), 6).alias("nearest_distance"), F.round(F.avg("margin"), 6).alias("prototype_margin"),
        F.round(F.avg((F.col("predicted") == "lymphocyte").cast("double")), 8).alias("share_to_lymphocyte"), F.round(F.avg("score"), 8).alias("mean_score"),
    )


_SERIES = "(1 - sin(th) * list_sum(list_transform(range(0, (df // 2)::bigint), lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2 * i))), 1) * cos(th) ** (2 * j))))"


@query(f"""with {RUN}, r as (select *, rank() over (partition by kind order by metric) + (count(*) over (partition by kind, metric) - 1) / 2.0 as rx, rank() over (partition by kind order by n) + (count(*) over (partition by kind, n) - 1) / 2.0 as ry from run),
c as (select kind, count(*) as k, corr(metric, n) as pearson, corr(rx, ry) as spearman from r group by 1 having count(*) >= 3),
v as (select kind, k, k - 2 as df, u.m as measure, u.r as r from c, lateral (values ('pearson', pearson), ('spearman', spearman)) u(m, r)),
a as (select *, atan(abs(r * sqrt(df / (1 - r * r))) / sqrt(df)) as th from v)
select kind, k, measure, round(r, 7) as r, round({_SERIES}, 7) as p from a""")
def correlation_tests(spark, d):
    """Correlations over runs with their two-sided p-values."""
    c = runs.correlations(run_level(spark, d), ["kind"], "metric", "n").withColumnRenamed("n", "k")
    v = c.unpivot(["kind", "k"], ["pearson", "spearman"], "measure", "r")
    return v.select("kind", "k", "measure", F.round("r", 7).alias("r"), F.round(correlation_p(F.col("r"), F.col("k")), 7).alias("p"))


@query(f"""with {RUN}, i as (select kind, seed, metric, n::double as n from run where version = 'v1'), e as (select kind, seed, metric, n::double as n from run where version = 'v2' and seed < 3)
select kind, seed, m.name as measure, round(m.a, 6) as internal, round(m.b, 6) as external, round(m.b - m.a, 6) as shift from i join e using (kind, seed), lateral (values ('metric', i.metric, e.metric), ('n', i.n, e.n)) m(name, a, b)""")
def domain_shift(spark, d):
    """Metrics of the runs that both domains hold, and their shift; runs of one domain only are left out."""
    r = run_level(spark, d).select("version", "kind", "seed", "metric", F.col("n").cast("double").alias("n"))
    long = lambda v, out: r.where(v).unpivot(["kind", "seed"], ["metric", "n"], "measure", out)
    j = checks.one_to_one(long("version = 'v1'", "internal"), long("version = 'v2' and seed < 3", "external"), ["kind", "seed", "measure"])
    return j.select("kind", "seed", "measure", F.round("internal", 6).alias("internal"), F.round("external", 6).alias("external"), F.round(F.col("external") - F.col("internal"), 6).alias("shift"))


@query(f"with {RUN} select a.version, a.kind, a.seed as seed_a, b.seed as seed_b, round(b.metric - a.metric, 7) as difference from run a join run b using (version, kind) where a.seed < b.seed")
def seed_pairs(spark, d):
    """Every pair of seeds of a version and kind, the smaller first."""
    r = cut(run_level(spark, d))
    return runs.pairs_within(r, ["version", "kind"], "seed").select("version", "kind", "seed_a", "seed_b", F.round(F.col("metric_b") - F.col("metric_a"), 7).alias("difference"))


@query(f"with {RUN}, m as (select a.kind, a.seed, b.metric - a.metric as delta from run a join run b on a.kind = b.kind and a.seed = b.seed and a.version = 'v1' and b.version = 'v2') select kind, seed, round(delta, 7) as delta, row_number() over (partition by kind order by delta desc, seed) as place from m where kind = 'click'")
def metric_deltas(spark, d):
    """The deltas of one kind of run in falling order."""
    m = runs.matched_deltas(run_level(spark, d), ["kind", "seed"], "version", "v1", "v2", "metric").where("kind = 'click'")
    w = Window.partitionBy("kind").orderBy(F.desc("delta"), "seed")
    return m.select("kind", "seed", F.round("delta", 7).alias("delta"), F.row_number().over(w).alias("place"))


@query(f"with {RUN}, g as (select version, kind, avg(metric) as m, stddev_samp(metric) as s from run group by 1, 2) select kind, round(max(m) filter (version = 'v1'), 6) as v1_mean, round(max(s) filter (version = 'v1'), 6) as v1_sd, round(max(m) filter (version = 'v2'), 6) as v2_mean, round(max(s) filter (version = 'v2'), 6) as v2_sd, case when max(m) filter (version = 'v2') > max(m) filter (version = 'v1') then 'v2' else 'v1' end as better from g group by 1")
def key_results(spark, d):
    """Mean and deviation of each kind of run, a column a version, and the version with the larger mean."""
    g = run_level(spark, d).groupBy("kind").pivot("version", ["v1", "v2"]).agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"))
    return g.select("kind", *[F.round(f"{v}_{x}", 6).alias(f"{v}_{x}") for v in ("v1", "v2") for x in ("mean", "sd")], F.when(F.col("v2_mean") > F.col("v1_mean"), "v2").otherwise("v1").alias("better"))


@query(f"with {RUN}, g as (select version, kind, avg(metric) as m from run group by 1, 2) select version, kind, round(m, 6) as mean from g where lower(version) = 'v2' and lower(kind) = 'click'")
def picked_result(spark, d):
    """The one row of the results with the wanted keys, whatever their case."""
    g = run_level(spark, d).groupBy("version", "kind").agg(F.round(F.avg("metric"), 6).alias("mean"))
    return checks.exactly_one(g, version="V2", kind="Click")


@query(f"""with {ARCHIVE}, {SCORED}, r as (select label, count(*) as n, avg(score) as m from scored where split = 'test' group by 1), k as (select *, row_number() over (order by m desc, label) as top, row_number() over (order by m, label) as low from r)
select label, n, round(m, 8) as mean_score, top, low from k where top <= 5 or low <= 5""")
def extreme_classes(spark, d):
    """The five classes with the highest and the five with the lowest mean score."""
    r = scored(spark, d).where("split = 'test'").groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    every = Window.partitionBy(F.lit(0))  # one row a class
    k = r.withColumn("top", F.row_number().over(every.orderBy(F.desc("m"), "label"))).withColumn("low", F.row_number().over(every.orderBy("m", "label")))
    return k.where("top <= 5 or low <= 5").select("label", "n", F.round("m", 8).alias("mean_score"), "top", "low")


METHODS = (
    ("msp", "primary", "logits", False), ("entropy", "natural_log", "logits", False), ("energy", "T=0.5", "logits", False), ("energy", "T=1.0", "logits", False), ("energy", "T=2.0", "logits", False),
    ("ncm", "euclidean", "embedding", True), ("ncm", "cosine", "embedding", True), ("knn_cosine", "k=1", "embedding", True), ("knn_cosine", "k=5", "embedding", True), ("knn_cosine", "k=10", "embedding", True),
    ("mahalanobis", "pinv", "embedding", True), ("mahalanobis", "ledoit-wolf", "embedding", True), ("mahalanobis", "relative", "embedding", True),
    ("react", "p85", "both", True), ("react", "p90", "both", True), ("react", "p95", "both", True), ("vim", "0.95", "both", True),
)
_METHODS = ", ".join(f"('{m}', '{v}', '{s}', {str(f).lower()})" for m, v, s, f in METHODS)


@query(f"with m(method, variant, source, fitted) as (values {_METHODS}) select *, lower(replace(replace(replace(replace(method || '_' || variant, '=', ''), '.', '_'), '-', '_'), ' ', '_')) as method_id from m")
def method_matrix(spark, d):
    """The methods that are compared, with what they read and whether they are fitted."""
    m = spark.createDataFrame(list(METHODS), "method string, variant string, source string, fitted boolean")
    return m.withColumn("method_id", names.method_id(F.col("method"), F.col("variant")))


LAYERS = """layer as (select p_brand as layer, max(p_size)::varchar || 'x' || max(p_size)::varchar as size, avg((p_partkey % 7 = 0)::int) * 100 as degenerate, var_pop(p_retailprice) as variance, avg(p_retailprice) / 1000 as runtime from part group by 1),
sized as (select *, split_part(size, 'x', 1)::int as height from layer), fit as (select *, height >= 14 and degenerate <= 14.3 and variance > 1e-6 as feasible from sized)"""


@query(f"""with {LAYERS}, s as (select *, degenerate / 100 + runtime / greatest((select max(runtime) from fit where feasible), 1e-9) - ln(1 + height) * 0.05 as score from fit)
select layer, height, round(degenerate, 6) as degenerate, feasible, round(case when feasible then score end, 7) as score, feasible and row_number() over (partition by feasible order by round(score, 7), layer) = 1 as chosen from s""")
def layer_choice(spark, d):
    """Layers by a composite of degenerate share, run time and size; the best feasible one is chosen."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(
        F.concat_ws("x", F.max("p_size").cast("string"), F.max("p_size").cast("string")).alias("size"), (F.avg((F.col("p_partkey") % 7 == 0).cast("int")) * 100).alias("degenerate"),
        F.var_pop("p_retailprice").alias("variance"), (F.avg("p_retailprice") / 1000).alias("runtime"),
    )
    p = p.withColumn("height", names.leading_size(F.col("size")))
    feasible = (F.col("height") >= 14) & (F.col("degenerate") <= 14.3) & (F.col("variance") > 1e-6)
    chosen = rules.best_feasible(p, "layer", feasible, "degenerate", "runtime", "height")
    return chosen.select("layer", "height", F.round("degenerate", 6).alias("degenerate"), "feasible", "score", "chosen")


@query("""with b as (select event_type as view, count(*) as n, avg(value) as mean, median(value) as median, quantile_cont(value, 0.95) as p95, avg((value <= 1)::int) * 100 as degenerate, var_pop(value) as variance from events where value is not null group by 1),
s as (select *, case when max(mean) over () - min(mean) over () <= 1e-12 then 0 else (mean - min(mean) over ()) / (max(mean) over () - min(mean) over ()) end + case when max(p95) over () - min(p95) over () <= 1e-12 then 0 else (p95 - min(p95) over ()) / (max(p95) over () - min(p95) over ()) end as total from b)
select view, n, round(mean, 6) as mean, round(median, 6) as median, round(p95, 6) as p95, round(degenerate, 6) as degenerate_percent, round(variance, 4) as variance, round(total, 6) as total, row_number() over (order by round(total, 6), view) = 1 as chosen from s""")
def cost_benchmark(spark, d):
    """Cost of each view: mean, median, 95th percentile, degenerate share, and the view least in both scaled costs."""
    e = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("view"), "value")
    b = e.groupBy("view").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.avg((F.col("value") <= 1).cast("int")) * 100).alias("degenerate"), F.var_pop("value").alias("variance"))
    b = b.join(metrics.quantiles(e, ["view"], "value", {"median": 0.5, "p95": 0.95}), "view")
    t = cut(runs.min_max_total(b, ["mean", "p95"], "total").withColumn("total", F.round("total", 6)))
    best = t.agg(F.min(F.struct("total", "view")).alias("m")).select(F.col("m.view").alias("best"))
    out = t.crossJoin(F.broadcast(best))
    return out.select("view", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], F.round("degenerate", 6).alias("degenerate_percent"), F.round("variance", 4).alias("variance"), "total", (F.col("view") == F.col("best")).alias("chosen"))


# Measured fields of a mask and of a crop, from keys.
MASK = "mk as (select (l_partkey % 101) / 100 as cell, (l_suppkey % 97) / 100 * (l_partkey % 101) / 100 as nucleus, l_linenumber * 2 as parts from lineitem)"


@query(f"""with {MASK}, f as (select *, cell - nucleus as plasma, case when cell > 0 then nucleus / cell else 0 end as ratio from mk),
w as (select [case when cell < 0.03 then 'empty_or_tiny_cell' end, case when cell > 0.985 then 'cell_covers_nearly_entire_image' end, case when nucleus < 0.005 then 'empty_or_tiny_nucleus_candidate' end,
    case when ratio > 0.85 then 'nucleus_candidate_larger_than_expected_cell_fraction' end, case when plasma < 0.01 then 'cytoplasm_candidate_tiny_or_impossible' end, case when parts > 8 then 'extreme_component_fragmentation' end] as all_w,
  cell < 0.03 or cell > 0.985 or nucleus < 0.005 or ratio > 0.85 as bad from f), t as (select bad, list_filter(all_w, lambda x: x is not null) as ws from w)
select case when bad then 'invalid' when len(ws) > 0 then 'warning' else 'valid' end as status, array_to_string(ws, ';') as warnings, count(*) as n from t group by 1, 2""")
def mask_status(spark, d):
    """Masks by status and warnings of the rules over their fractions."""
    part, supp = F.col("l_partkey") % 101 / 100, F.col("l_suppkey") % 97 / 100
    m = table(spark, d, "lineitem").select(part.alias("cell"), (supp * (F.col("l_partkey") % 101) / 100).alias("nucleus"), (F.col("l_linenumber") * 2).alias("parts"))
    s = m.select(rules.mask_status(F.col("cell"), F.col("nucleus"), F.col("cell") - F.col("nucleus"), F.col("parts")).alias("s"))
    return s.groupBy("s.status", F.array_join("s.warnings", ";").alias("warnings")).agg(F.count("*").alias("n"))


CROP = "cr as (select l_orderkey, l_linenumber, 20 + l_partkey % 60 as w, 20 + l_suppkey % 60 as h, (l_partkey % 40)::double as focus, (l_partkey * 7 % 256)::double as light, (l_suppkey % 50) / 100 as clipped, l_partkey % 9 = 0 as border from lineitem)"


@query(f"""with {CROP}, f as (select *, w < 32 or h < 32 as small, focus < 12 as blur, light < 20 or (clipped > 0.2 and light <= 127.5) as dark, light > 235 or (clipped > 0.2 and light > 127.5) as bright from cr)
select l_orderkey, l_linenumber, array_to_string(list_filter([case when small then 'too_small' end, case when border then 'clipped_at_image_border' end, case when blur then 'blur' end, case when dark then 'underexposed' end, case when bright then 'overexposed' end], lambda x: x is not null), ',') as flags,
  round(1 - least(1.0, 0.35 * small::int + 0.25 * border::int + 0.25 * blur::int + 0.3 * dark::int + 0.3 * bright::int), 6) as quality from f""")
def crop_quality(spark, d):
    """Flags and score of crops from their measured fields."""
    li = table(spark, d, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    q = rules.crop_quality(20 + p % 60, 20 + s % 60, (p % 40).cast("double"), (p * 7 % 256).cast("double"), s % 50 / 100, p % 9 == 0)
    return li.select("l_orderkey", "l_linenumber", q.alias("q")).select("l_orderkey", "l_linenumber", F.array_join("q.flags", ",").alias("flags"), F.round("q.quality", 6).alias("quality"))


@query(f"""with {ARCHIVE}, q as (select sample_id, e, list_aggregate(e, 'quantile_cont', 0.01) as lo, list_aggregate(e, 'quantile_cont', 0.99) as hi from archive),
s as (select sample_id, case when hi - lo <= 1e-12 then list_transform(e, lambda x: 0.0) else list_transform(e, lambda x: least(1.0, greatest(0.0, (x - lo) / (hi - lo)))) end as f from q)
select sample_id, round(list_sum(f), 6) as total, round(list_min(f), 6) as least, round(list_max(f), 6) as most from s""")
def clipped_fields(spark, d):
    """Fields scaled to 0..1 between their 1st and 99th percentiles, summarised."""
    f = archive(spark, d).select("sample_id", vec.percentile_scaled(F.col("e")).alias("f"))
    return f.select("sample_id", F.round(vec.total(F.col("f")), 6).alias("total"), F.round(F.array_min("f"), 6).alias("least"), F.round(F.array_max("f"), 6).alias("most"))


# The external domain: samples of every dataset but the largest.
HOME = f"""home as (select dataset from one where dataset is not null group by 1 order by count(*) desc, dataset limit 1),
side as (select archive.*, one.dataset = (select dataset from home) as inside from archive join one using (sample_id) where one.dataset is not null)"""


@query(f"""with {ARCHIVE}, {ONE}, {HOME}, {MEANS.replace('from archive,', 'from side,').replace("where split = 'train'", "where inside and split = 'train'")},
{NEAR.replace('from archive a, means', 'from side a, means').replace('select sample_id, a.label', 'select sample_id, inside, a.label')}, sc as (select sample_id, inside, label, status, split, round(d, 9) as score, c from near),
th as (select round(quantile_cont(score, 0.95), 9) as t from sc where inside and split = 'validation' and status = 'known'),
ex as (select score, status = 'unknown' as pos, label, c, score > t as rejected from sc, th where not inside),
u as {auroc_sql('ex', 'score')}
select (select count(*) from ex) as n, round((rs - np * (np + 1) / 2.0) / (np * nn), 8) as auroc, (select round(avg((not rejected)::double), 8) from ex where not pos) as known_accepted,
  (select round(avg(rejected::double), 8) from ex where pos) as unknown_rejected, (select round(avg((label = c)::double), 8) from ex where not pos) as closed_accuracy, (select round(t, 6) from th) as threshold from u""")
def external_evaluation(spark, d):
    """Class means and threshold from one dataset, frozen, on the samples of all others."""
    own = samples(spark, d).where("dataset is not null").select("sample_id", "dataset")
    home = own.groupBy("dataset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dataset").limit(1).select(F.col("dataset").alias("home"))
    side = cut(archive(spark, d).join(own, "sample_id").crossJoin(F.broadcast(home)).withColumn("inside", F.col("dataset") == F.col("home")))
    means = class_means(scorers.train_only(side.where("inside")), "label", "e")
    near = cut(with_nearest(side, means, "label", "e").withColumn("score", F.round("nearest", 9)))
    t = cut(calibrate.strict_threshold(near.where("inside and split = 'validation' and status = 'known'"), "score").select(F.round("threshold", 9).alias("t")))
    ex = near.where("not inside").crossJoin(F.broadcast(t)).withColumn("pos", F.col("status") == "unknown").withColumn("rejected", F.col("score") > F.col("t"))
    rate = lambda hit, of: F.round(F.avg(F.when(of, hit.cast("double"))), 8)
    row = ex.agg(
        F.count("*").alias("n"), rate(~F.col("rejected"), ~F.col("pos")).alias("known_accepted"), rate(F.col("rejected"), F.col("pos")).alias("unknown_rejected"),
        rate(F.col("label") == F.col("nearest_label"), ~F.col("pos")).alias("closed_accuracy"), F.round(F.max("t"), 6).alias("threshold"),
    )
    auroc = metrics.auroc(metrics.score_counts(ex, [], F.col("pos"), F.col("score")), []).select(F.round("auroc", 8).alias("auroc"))
    return row.crossJoin(auroc)


@query(f"""with {BARS}, {GRID}, bd as (select min(x.birth) as lo, max(x.birth) as hi, min(x.death - x.birth) as low, max(x.death - x.birth) as tall from (select unnest(f) as x from fin where {FITTED})),
l as (select user_id, list_transform(f, lambda x: x.death - x.birth) as v from fin), tt as (select user_id, v, coalesce(list_sum(v), 0) as s from l),
en as (select user_id, case when s > 0 then coalesce(list_sum(list_transform(list_filter(v, lambda x: x > 0), lambda x: -(x / s) * ln(greatest(x / s, 1e-12)))), 0) else 0 end as entropy from tt),
be as (select user_id, list_sum(list_transform(g, lambda t: len(list_filter(f, lambda x: x.birth <= t and t < x.death)))) as betti, list_sum(list_transform(list_transform(g, lambda t: list_sort(list_transform(f, lambda x: greatest(0, least(t - x.birth, x.death - t))), 'DESC')), lambda r: coalesce(r[1], 0) + coalesce(r[2], 0) + coalesce(r[3], 0))) as land from fin, gr),
im as (select user_id, coalesce(list_sum(list_transform(list_filter(f, lambda x: x.birth between lo and hi and x.death - x.birth between low and tall), lambda x: x.death - x.birth)), 0) as image from fin, bd)
select user_id, 1 + 16 + 48 + 64 as n_features, round(entropy, 6) as entropy, betti::double as betti_curve, round(land, 4) as landscape, round(image, 4) as image from en join be using (user_id) join im using (user_id)""")
def topology_features(spark, d):
    """Feature vectors of every user's bars, fitted on some users, as the sums of their four components."""
    b = cut(bars(spark, d))
    fitted = diagrams.fit_vectorizers(b.where(FITTED), "b")
    v = diagrams.vectorized(b, "b", fitted)
    part = lambda name: vec.total(F.slice("features", fitted.slices[name][0] + 1, fitted.slices[name][1] - fitted.slices[name][0]))
    return v.select(
        "user_id", F.size("features").alias("n_features"), F.round(part("entropy"), 6).alias("entropy"), part("betti_curve").alias("betti_curve"),
        F.round(part("landscape"), 4).alias("landscape"), F.round(part("image"), 4).alias("image"),
    )


@query()
def pairwise_bottlenecks(spark, d):
    """Bottleneck distances between the diagrams of every two of the five seeds of an event type."""
    e = table(spark, d, "events").where("value is not null").select("event_type", (F.col("user_id") % 5).alias("seed"), "user_id", "value")
    lo_hi = e.groupBy("event_type", "seed", "user_id").agg(F.min("value").alias("birth"), F.max("value").alias("death")).where("birth < death")
    b = cut(lo_hi.groupBy("event_type", "seed").agg(F.collect_list(F.array("birth", "death")).alias("p")))
    # A pair is two whole diagrams and a long computation: each core gets some.
    pairs = runs.pairs_within(b, ["event_type"], "seed").repartition(parallelism(spark), "event_type", "seed_a", "seed_b")
    return pairs.select("event_type", "seed_a", "seed_b", F.round(diagrams.bottleneck("p_a", "p_b"), 6).alias("distance"))


@query(f"""with {BARS}, {RUN}, t as (select user_id % 5 as seed, avg(coalesce(list_max(list_transform(f, lambda x: x.death - x.birth)), 0)) as longest from fin group by 1),
j as (select kind, version, t.seed, longest, metric from t join run using (seed)), c as (select kind, version, count(*) as k, corr(longest, metric) as r from j group by 1, 2 having count(*) >= 3),
a as (select *, k - 2 as df, atan(abs(r * sqrt((k - 2) / (1 - r * r))) / sqrt(k - 2)) as th from c)
select kind, version, k, round(r, 6) as pearson, round(case when df = 3 then 1 - 2 / pi() * (th + sin(th) * cos(th)) end, 6) as p from a""")
def topology_correlations(spark, d):
    """Correlation over seeds of the users' mean longest bar with each kind of run's metric, with p-values."""
    t = bars(spark, d).groupBy((F.col("user_id") % 5).alias("seed")).agg(F.avg(F.coalesce(F.array_max(diagrams.lengths(F.col("b"))), F.lit(0.0))).alias("longest"))
    j = t.join(run_level(spark, d), "seed")
    c = runs.correlations(j, ["kind", "version"], "longest", "metric")
    return c.select("kind", "version", F.col("n").alias("k"), F.round("pearson", 6).alias("pearson"), F.round(correlation_p(F.col("pearson"), F.col("n")), 6).alias("p"))


@query()
def bootstrap_report(spark, d):
    """Macro-F1 of the known test rows, AUROC and FPR at 95 % with bootstrap intervals."""
    p = cut(predictions(spark, d).select("truth", "closed", "label", "score", "pos"))
    closed = resample.bootstrap_macro_f1(p.where("not pos").select(F.col("label").alias("truth"), F.col("closed").alias("given")))
    open_ = resample.bootstrap_open(p.select(F.col("pos").cast("int").alias("y"), F.col("score").alias("s")))
    return closed.unionByName(open_).select("metric", *[F.round(c, 9).alias(c) for c in ("estimate", "lower", "upper")], "n_replicates")


@query()
def detection_threshold_sweep(spark, d):
    """Precision, recall and F1 of the detections at or above each score bound; the best by F1, then recall, is marked."""
    b = cut(_boxes(spark, d))
    g, f = b.select("image_id", "gt_id", "truth.*"), b.select("image_id", F.col("gt_id").alias("detection_id"), "confidence", "found.*")
    return boxes.threshold_sweep(f, g, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query()
def bootstrap_methods(spark, d):
    """Every plain method against maximum softmax: differences of AUROC and FPR at 95 % with bootstrap intervals."""
    stored = archive(spark, d).withColumn("e", F.col("e").cast("array<float>"))
    one = stored.groupBy("sample_id").agg(F.min(F.struct("label", "status", "split", "e", "z")).alias("r")).select("sample_id", "r.*")
    a = cut(one.where("split = 'test' or (split = 'train' and status = 'known')"))
    train, test = scorers.train_only(a), a.where("split = 'test'")
    rows, found = test.select("sample_id", (F.col("status") == "unknown").cast("int").alias("y"), F.round(scorers.maximum_softmax(F.col("z")), 9).alias("msp_primary")), []
    for method, variant in (("entropy", "natural_log"), ("ncm", "euclidean"), ("knn_cosine", "k=5")):
        found.append(f"{method}_{variant}".replace("=", ""))
        one = scorers.fit_and_score(method, variant, train, test).select("sample_id", F.round("score", 9).alias(found[-1]))
        rows = checks.one_to_one(cut(rows), cut(one), ["sample_id"])
    release(a)
    out = resample.bootstrap_deltas(rows, "msp_primary", found)
    return out.select(F.col("candidate").alias("method_id"), "metric", *[F.round(c, 9).alias(c) for c in ("estimate", "lower", "upper")], "n_replicates")


@query()
def topology_only_evaluation(spark, d):
    """Open-set and closed-set metrics from topology alone: diagrams of the samples' fields, vectorised
    and scaled on known training rows, scored by the distance to the nearest class mean."""
    lo, width = F.array_min("e"), F.greatest(F.array_max("e") - F.array_min("e"), F.lit(1e-12))
    field = vec.let(F.struct(lo.alias("lo"), width.alias("w")), lambda p: F.transform("e", lambda x: (x - p["lo"]) / p["w"]))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("f"), 12 * i + 1, F.lit(12)))
    a = archive(spark, d).select("sample_id", "label", "status", "split", field.alias("f")).withColumn("g", homology.field_diagrams(rows, unit=True))
    ok = cut(cut(a).where("g.error is null").select("sample_id", "label", "status", "split", F.transform("g.bars", lambda b: F.struct(b["birth"].alias("birth"), b["death"].alias("death"))).alias("b")))
    fitted = diagrams.fit_vectorizers(ok.where("split = 'train' and status = 'known'"), "b")
    v = cut(diagrams.vectorized(ok, "b", fitted).select("sample_id", "label", "status", "split", F.col("features").alias("e")))
    scored_ = cut(scorers.nearest_class(scorers.train_only(v), v.where("split = 'test'"), scaled=True).select("label", "status", "score", "nearest_label"))
    pos = F.col("status") == "unknown"
    counts = metrics.score_counts(scored_, [], pos, F.round("score", 9))
    closed = scored_.where("status = 'known'").agg(F.count("*").alias("n_known"), F.avg((F.col("label") == F.col("nearest_label")).cast("double")).alias("accuracy"))
    out = metrics.auroc(counts, []).crossJoin(metrics.fpr_of_counts(counts, [])).crossJoin(closed)
    return out.select(F.round("auroc", 6).alias("auroc"), F.round("fpr", 6).alias("fpr95"), "n_known", F.round("accuracy", 6).alias("accuracy"))
