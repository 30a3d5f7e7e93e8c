"""Queries: thresholds, open-set, closed-set and calibration metrics, triage coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import names, vec
from quillon.functions.text import normalize_label, split_name
from quillon.operators import calibrate, metrics, scorers
from quillon.operators.checks import finite_scores
from quillon.plans.registry import collector
from quillon.plans.scores import ORACLES as SCORES
from quillon.plans.sqltext import ARCHIVE, n, split
from quillon.plans.views import archive
from quillon.session import cut, small_side
from quillon.sources.tables import table

QUERIES, ORACLES, query = collector()

# Order of the logits.
CLASSES = ("basophil", "eosinophil", "lymphocyte", "monocyte", "neutrophil_segmented")
_NAMES = ", ".join(f"'{c}'" for c in CLASSES)

SCORED = f"""soft as (select *, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) as p from archive),
scored as (select *, round(list_max(p), 9) as confidence, round(1 - list_max(p), 9) as score, [{_NAMES}][list_position(p, list_max(p))] as predicted,
  status = 'unknown' as pos from soft)"""


def scored(spark, d):
    s = archive(spark, d).withColumn("p", vec.softmax(F.col("z")))
    names = F.array(*[F.lit(c) for c in CLASSES])
    return s.select(
        "*", F.round(F.array_max("p"), 9).alias("confidence"), F.round(1 - F.array_max("p"), 9).alias("score"),
        F.get(names, vec.argmax(F.col("p"))).alias("predicted"), (F.col("status") == "unknown").alias("pos"),
    )


@query(f"with {ARCHIVE}, {SCORED} select round(quantile_cont(score, 0.95), 9) as threshold from scored where split = 'validation' and status = 'known'")
def threshold_strict(spark, d):
    t = calibrate.strict_threshold(scored(spark, d).where("split = 'validation' and status = 'known'"), "score")
    return t.select(F.round("threshold", 9).alias("threshold"))


@query(f"""with {ARCHIVE}, {SCORED}, c as (select distinct score as s from scored where (split = 'validation' and status = 'known') or status = 'unknown'),
r as (select s, (select avg((score <= s)::double) from scored where split = 'validation' and status = 'known') as known_recall,
  (select avg((score > s)::double) from scored where status = 'unknown') as unknown_recall from c)
select s as threshold, round(known_recall, 9) as known_recall, round(unknown_recall, 9) as unknown_recall from r where known_recall + 1e-12 >= 0.95
order by round(0.5 * (known_recall + unknown_recall), 12) desc, s limit 1""")
def threshold_development(spark, d):
    s = scored(spark, d)
    t = calibrate.development_threshold(s.where("split = 'validation' and status = 'known'"), s.where("status = 'unknown'"), "score")
    return t.select("threshold", F.round("known_recall", 9).alias("known_recall"), F.round("unknown_recall", 9).alias("unknown_recall"))


PREDICTED = """t as (select round(quantile_cont(score, 0.95), 9) as threshold from scored where split = 'validation' and status = 'known'),
pred as (select sample_id, case when status = 'known' then label else 'UNKNOWN' end as truth, label, status, predicted as closed, case when score > threshold then 'UNKNOWN' else predicted end as given,
  score, confidence, pos, threshold, p, split from scored, t where split = 'test')"""


def predictions(spark, d):
    s = scored(spark, d)
    t = calibrate.strict_threshold(s.where("split = 'validation' and status = 'known'"), "score").select(F.round("threshold", 9).alias("threshold"))
    test = s.where("split = 'test'").crossJoin(F.broadcast(t))
    return test.withColumn("truth", F.when(F.col("status") == "known", F.col("label")).otherwise("UNKNOWN")).withColumn("closed", F.col("predicted")).withColumn(
        "given", F.when(F.col("score") > F.col("threshold"), "UNKNOWN").otherwise(F.col("predicted"))
    )


@query(f"with {ARCHIVE}, {SCORED}, {PREDICTED} select sample_id, truth, closed, given, score, threshold from pred")
def predictions_open_set(spark, d):
    return predictions(spark, d).select("sample_id", "truth", "closed", "given", "score", "threshold")


@query(f"""with {ARCHIVE}, {SCORED}, {PREDICTED},
rk as (select pos, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from pred),
au as (select (sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / (sum(pos::int) * sum((not pos)::int)) as v from rk),
cs as (select score, sum(pos::int) as a, sum((not pos)::int) as b from pred group by 1),
run as (select a, sum(a) over (order by score desc) as ca, sum(b) over (order by score desc) as cb from cs),
ap as (select sum(a * ca / (ca + cb)) / sum(a) as v from run),
th as (select quantile_cont(score, 1 - 0.95) as q from pred where pos),
fp as (select avg((score > q)::double) as v from pred, th where not pos),
lab as (select truth as l from pred union select given from pred),
f1 as (select avg(case when p2 + r2 > 0 then 2 * p2 * r2 / (p2 + r2) else 0 end) as v from (
  select l, (select coalesce(avg((given = l and truth = l)::double), 0) from pred where given = l) as p2, (select coalesce(avg((given = l)::double), 0) from pred where truth = l) as r2 from lab)),
oc as (select sum((not pos and predicted_ok)::int) as ok, sum((not pos)::int) as kn, sum(pos::int) as un, confidence from (select *, closed = label as predicted_ok from pred) group by confidence),
op as (select sum(ok) over (order by confidence desc) / greatest(1, sum(kn) over ()) as ccr, sum(un) over (order by confidence desc) / greatest(1, sum(un) over ()) as fpr from oc),
ov as (select sum((fpr - lf) * (ccr + lc) / 2) as v from (select fpr, ccr, lag(fpr) over (order by fpr, ccr) as lf, lag(ccr) over (order by fpr, ccr) as lc from op))
select 'auroc' as metric, round(v, 9) as value from au union all select 'aupr', round(v, 9) from ap union all select 'fpr95', round(v, 9) from fp
union all select 'known_recall', round(avg((given != 'UNKNOWN')::double), 9) from pred where not pos
union all select 'unknown_recall', round(avg((given = 'UNKNOWN')::double), 9) from pred where pos
union all select 'macro_f1', round(v, 9) from f1 union all select 'oscr', round(v, 9) from ov""")
def open_set_metrics(spark, d):
    """The metric bundle of one scored test set in long form."""
    p = cut(predictions(spark, d).select("pos", "score", "truth", "given", "closed", "label", "confidence"))
    counts = metrics.score_counts(p, [], F.col("pos"), F.col("score"))
    labels = p.select(F.explode(F.array("truth", "given")).alias("label")).distinct()
    f1 = metrics.class_report(p, "truth", "given", labels).agg(F.avg("f1").alias("v"))
    parts = {
        "auroc": metrics.auroc(counts, []), "aupr": metrics.average_precision(counts, []),
        "fpr95": metrics.fpr_of_counts(counts, []),
        "known_recall": p.where("not pos").agg(F.avg((F.col("given") != "UNKNOWN").cast("double"))),
        "unknown_recall": p.where("pos").agg(F.avg((F.col("given") == "UNKNOWN").cast("double"))),
        "macro_f1": f1, "oscr": metrics.oscr(p, [], ~F.col("pos"), F.col("closed") == F.col("label"), F.col("confidence")),
    }
    out = None
    for name, df in parts.items():
        row = df.toDF("v").select(F.lit(name).alias("metric"), F.round("v", 9).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with {ARCHIVE}, {SCORED}, c as (select score, sum(pos::int) as a, sum((not pos)::int) as b from scored where split = 'test' group by 1)
select score, round(sum(a) over (order by score desc) / sum(a) over (), 9) as tpr, round(sum(b) over (order by score desc) / sum(b) over (), 9) as fpr from c""")
def roc_curve(spark, d):
    s = scored(spark, d).where("split = 'test'")
    r = metrics.roc_points(metrics.score_counts(s, [], F.col("pos"), F.col("score")), [])
    return r.select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


KNOWN_TEST = "kt as (select * from scored where split = 'test' and status = 'known')"


@query(f"""with {ARCHIVE}, {SCORED}, {KNOWN_TEST}, l as (select unnest([{_NAMES}]) as label),
c as (select l.label, (select count(*) from kt where kt.label = l.label) as support, (select count(*) from kt where predicted = l.label) as given, (select count(*) from kt where kt.label = l.label and predicted = l.label) as tp from l),
r as (select label, support, case when given > 0 then tp / given else 0 end as p, case when support > 0 then tp / support else 0 end as r from c)
select label, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1, support from r""")
def closed_set_report(spark, d):
    classes = spark.createDataFrame([(c,) for c in CLASSES], "label string")
    r = metrics.class_report(scored(spark, d).where("split = 'test' and status = 'known'"), "label", "predicted", classes)
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""with {ARCHIVE}, {SCORED}, {KNOWN_TEST}, r as (select label, avg((label = predicted)::double) as r from kt group by 1)
select (select count(*) from kt) as n, (select round(avg((label = predicted)::double), 9) from kt) as accuracy, (select round(avg(r), 9) from r) as balanced_accuracy""")
def closed_set_summary(spark, d):
    k = scored(spark, d).where("split = 'test' and status = 'known'")
    ok = (F.col("label") == F.col("predicted")).cast("double")
    per = k.groupBy("label").agg(F.count("*").alias("n"), F.avg(ok).alias("r"), F.sum(ok).alias("k"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum("k") / F.sum("n"), 9).alias("accuracy"), F.round(F.avg("r"), 9).alias("balanced_accuracy"))


_PIVOT = ", ".join(f"count(*) filter (predicted = '{c}') as {c}" for c in CLASSES)


@query(f"with {ARCHIVE}, {SCORED}, {KNOWN_TEST} select label, {_PIVOT} from kt group by 1")
def confusion_matrix(spark, d):
    k = scored(spark, d).where("split = 'test' and status = 'known'")
    return k.groupBy("label").pivot("predicted", list(CLASSES)).agg(F.count(F.lit(1))).fillna(0)


@query(f"""with {ARCHIVE}, {SCORED}, {KNOWN_TEST},
b as (select confidence, label = predicted as ok, (select count(*) from range(0, 16) e(i) where i / 15 < confidence) as bin from kt),
e as (select sum(case when bin between 1 and 15 then g else 0 end) / sum(k) as v from (select bin, count(*) as k, abs(sum(ok::int) - sum(confidence)) as g from b group by 1)),
y as (select *, list_position([{_NAMES}], label) as i from kt)
select round((select v from e), 8) as ece, round(-avg(ln(least(1 - 2.220446049250313e-16, greatest(2.220446049250313e-16, p[i])))), 8) as nll,
  round(avg(list_sum(list_transform(p, lambda x: x * x)) - 2 * p[i] + 1), 8) as brier from y""")
def calibration_metrics(spark, d):
    k = scored(spark, d).where("split = 'test' and status = 'known'")
    own = F.get("p", F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("int") - 1)
    eps = 2.220446049250313e-16
    nll = -F.log(F.least(F.lit(1 - eps), F.greatest(F.lit(eps), own)))
    rest = k.agg(F.round(F.avg(nll), 8).alias("nll"), F.round(F.avg(vec.dot(F.col("p"), F.col("p")) - 2 * own + 1), 8).alias("brier"))
    ece = metrics.expected_calibration_error(k, [], F.col("confidence"), F.col("label") == F.col("predicted"))
    return ece.select(F.round("ece", 8).alias("ece")).crossJoin(rest)


@query(f"""with {ARCHIVE}, {SCORED}, k as (select score from scored where split = 'test' and not pos),
u as (select label, score from scored where split = 'test' and pos), al as (select label, score, true as pos from u union all select l.label, k.score, false from (select distinct label from u) l, k),
rk as (select label, pos, rank() over (partition by label order by score) + (count(*) over (partition by label, score) - 1) / 2.0 as r from al),
a as (select label, (sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / (sum(pos::int) * sum((not pos)::int)) as auroc, sum(pos::int) as n from rk group by 1),
t as (select label, quantile_cont(score, 1 - 0.95) as q, avg(score) as m, median(score) as md from u group by 1),
f as (select label, avg((k.score > q)::double) as fpr from t, k group by 1)
select label, n, round(auroc, 9) as auroc, round(fpr, 9) as fpr95, round(m, 8) as mean_score, round(md, 8) as median_score from a join t using (label) join f using (label)""")
def per_unknown_class(spark, d):
    """Each unknown class against all known rows; known scores are counted once, by value."""
    s = cut(scored(spark, d).where("split = 'test'").select("label", "pos", "score"))
    u = s.where("pos").select("label", "score")
    classes = small_side(u.select("label").distinct())
    known = metrics.score_counts(s.where("not pos"), [], F.col("pos"), F.col("score"))
    both = metrics.score_counts(u, ["label"], F.lit(True), F.col("score")).unionByName(known.crossJoin(classes)).groupBy("label", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    stats = u.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).join(metrics.medians(u, ["label"], "score", "median_score"), "label")
    both = cut(both)
    fpr = metrics.fpr_of_counts(both, ["label"]).withColumnRenamed("fpr", "fpr95")
    out = metrics.auroc(both, ["label"]).join(stats, "label").join(fpr, "label")
    return out.select("label", "n", *[F.round(c, 9).alias(c) for c in ("auroc", "fpr95")], *[F.round(c, 8).alias(c) for c in ("mean_score", "median_score")])


@query(f"""with {ARCHIVE}, {SCORED}, r as (select label, count(*) as n, avg(score) as m from scored where status = 'unknown' group by 1)
select case when label like 'lymphocyte%' then 'lymphoid' when label like '%myelo%' then 'myeloid' else 'unassigned' end as subgroup, sum(n)::bigint as n, round(sum(n * m) / sum(n), 8) as weighted_score from r group by 1""")
def subgroup_weighted(spark, d):
    r = scored(spark, d).where("status = 'unknown'").groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    g = F.when(F.col("label").startswith("lymphocyte"), "lymphoid").when(F.col("label").contains("myelo"), "myeloid").otherwise("unassigned")
    return r.groupBy(g.alias("subgroup")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 8).alias("weighted_score"))


FUSED = """f as (select sample_id, label, (select avg((v.score <= s.score)::double) from scored v where v.split = 'validation' and v.status = 'known') as pa,
  (select avg((round(v.e[1], 6) <= round(s.e[1], 6))::double) from scored v where v.split = 'validation' and v.status = 'known') as pb from scored s where split = 'test')"""


@query(f"""with {ARCHIVE}, {SCORED}, {FUSED} select sample_id, round(pa, 9) as pa, round(pb, 9) as pb, round(0.5 * pa + 0.5 * pb, 9) as mean_fused, round(greatest(pa, pb), 9) as max_fused from f""")
def percentile_fusion(spark, d):
    s = scored(spark, d).withColumn("second", F.round(F.get("e", 0), 6))
    ref, test = s.where("split = 'validation' and status = 'known'"), s.where("split = 'test'").select("sample_id", "score", "second")
    f = calibrate.empirical_percentile(calibrate.empirical_percentile(test, ref, "score", "pa"), ref, "second", "pb")
    a, b = F.col("pa"), F.col("pb")
    return f.select("sample_id", F.round(a, 9).alias("pa"), F.round(b, 9).alias("pb"), F.round(calibrate.late_fusion(a, b), 9).alias("mean_fused"), F.round(calibrate.max_fusion(a, b), 9).alias("max_fused"))


@query(f"""with {ARCHIVE}, {SCORED}, r as (select sample_id, label, score, row_number() over (partition by label order by score, sample_id) - 1 as i, count(*) over (partition by label) as n from scored)
select sample_id, label, score from r where i in (round_even(0 * (n - 1), 0), round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0), n - 1)""")
def representative_rows(spark, d):
    s = scored(spark, d).select("sample_id", "label", "score")
    return calibrate.representatives(s, "label", "score", "sample_id", [0.0, 0.25, 0.5, 0.75, 1.0])


SIGNALS = f"""sig as (select distinct sample_id, {split('split')} as split, {n('known_or_unknown')} as status, confidence, margin, unknown_score, coalesce(quality_pass, false) as quality, correct_if_known as correct
  from triage_signal where confidence between 0 and 1 and margin between 0 and 1 and unknown_score between 0 and 1 and not isnan(confidence) and not isnan(margin) and not isnan(unknown_score) and {n('known_or_unknown')} in ('known', 'unknown') and sample_id is not null)"""


def signals(spark, d):
    s = table(spark, d, "triage_signal").where("sample_id is not null")
    ok = [(F.col(c) >= 0) & (F.col(c) <= 1) for c in ("confidence", "margin", "unknown_score")]
    return (
        s.where(ok[0] & ok[1] & ok[2])
        .select("sample_id", split_name(F.col("split")).alias("split"), normalize_label(F.col("known_or_unknown")).alias("status"), "confidence", "margin", "unknown_score", F.coalesce("quality_pass", F.lit(False)).alias("quality_pass"), F.col("correct_if_known").alias("correct"))
        .where(F.col("status").isin("known", "unknown")).distinct()
    )


TARGETS = (0.95, 0.9, 0.8, 0.7, 0.6)
POINTS = f"""cal as (select * from sig where split = 'validation' and status = 'known'),
gc as (select distinct round(x, 9) as c from (select unnest(quantile_cont(confidence, [{', '.join(str(i / 20) for i in range(21))}])) as x from cal)),
gm as (select distinct round(x, 9) as m from (select unnest(quantile_cont(margin, [{', '.join(str(i / 20) for i in range(21))}])) as x from cal)),
gu as (select distinct round(x, 9) as u from (select unnest(quantile_cont(unknown_score, [{', '.join(str(i / 20) for i in range(21))}])) as x from cal)),
grid as (
  select 'confidence_only' as strategy, c, null::double as m, null::double as u, (select count(*) from cal where confidence >= c) as k from gc
  union all select 'confidence_margin', c, m, null, (select count(*) from cal where confidence >= c and margin >= m) from gc, gm
  union all select 'confidence_margin_msp_qc', c, m, u, (select count(*) from cal where quality and unknown_score < u and confidence >= c and margin >= m) from gc, gm, gu),
point as (select * from (select *, k / (select count(*) from cal) as coverage, row_number() over (partition by strategy, target order by abs(k / (select count(*) from cal) - target), -coalesce(c, -1), -coalesce(m, -1), -coalesce(u, -1)) as r
  from grid, (select unnest([{', '.join(str(t) for t in TARGETS)}]) as target)) where r = 1)"""


@query(f"""with {SIGNALS}, {POINTS} select strategy, target, round(coverage, 9) as coverage, (select count(*) from cal) as n_records, round(c, 9) as confidence, round(m, 9) as margin, round(u, 9) as unknown from point""")
def operating_points(spark, d):
    p = calibrate.operating_points(signals(spark, d).where("split = 'validation' and status = 'known'"), list(TARGETS))
    return p.select("strategy", "target", "n_records", *[F.round(c, 9).alias(c) for c in ("coverage", "confidence", "margin", "unknown")])


def _covered(spark, d):
    s = signals(spark, d)
    points = calibrate.operating_points(s.where("split = 'validation' and status = 'known'"), list(TARGETS))
    both = s.where("split = 'test'").select("status", "correct", "confidence", "margin", "unknown_score", "quality_pass").crossJoin(
        F.broadcast(points.select("strategy", "target", F.col("confidence").alias("c"), F.col("margin").alias("m"), F.col("unknown").alias("u")))
    )
    args = [F.col(x) for x in ("confidence", "margin", "unknown_score", "quality_pass", "c", "m", "u")]
    hit = calibrate.accepted_by(F.col("strategy"), *args)
    known, unknown = F.col("status") == "known", F.col("status") == "unknown"
    ratio = lambda a, b: F.when(b > 0, a / b)
    k = F.count_if(known & F.col("hit") & F.col("correct").isNotNull())
    return both.withColumn("hit", hit).groupBy("strategy", "target").agg(
        (F.count_if("hit") / F.count("*")).alias("coverage"), ratio(F.count_if(known & F.col("hit") & ~F.col("correct")), k).alias("risk"),
        ratio(F.count_if(unknown & F.col("hit")), F.count_if(unknown)).alias("unknown_accepted"),
    )


RISK = """hits as (select strategy, target, status, correct, case strategy when 'confidence_only' then confidence >= c when 'confidence_margin' then confidence >= c and margin >= m
    else quality and unknown_score < u and confidence >= c and margin >= m end as hit from sig, point where split = 'test'),
risk as (select strategy, target, avg(hit::double) as coverage, case when count(*) filter (hit and status = 'known' and correct is not null) > 0
    then count(*) filter (hit and status = 'known' and not correct) / count(*) filter (hit and status = 'known' and correct is not null) end as risk,
  case when count(*) filter (status = 'unknown') > 0 then count(*) filter (hit and status = 'unknown') / count(*) filter (status = 'unknown') end as unknown_accepted from hits group by 1, 2)"""


@query(f"""with {SIGNALS}, {POINTS}, {RISK} select strategy, target, round(coverage, 9) as coverage, round(risk, 9) as risk, round(unknown_accepted, 9) as unknown_accepted from risk""")
def risk_coverage(spark, d):
    return _covered(spark, d).select("strategy", "target", *[F.round(c, 9).alias(c) for c in ("coverage", "risk", "unknown_accepted")])


@query(f"""with {SIGNALS}, {POINTS}, {RISK}, l as (select *, lag(coverage) over w as lc, lag(risk) over w as lr from risk window w as (partition by strategy order by coverage, risk))
select strategy, round(sum((coverage - lc) * (risk + lr) / 2), 9) as aurc from l group by 1""")
def risk_area(spark, d):
    return metrics.trapezoid(_covered(spark, d), ["strategy"], "coverage", "risk", "aurc").select("strategy", F.round("aurc", 9).alias("aurc"))


@query(f"""with {ARCHIVE}, {SCORED}, r as (select label, count(*) as n, avg(score) as m, row_number() over (order by avg(score) desc, label) as worst from scored where split = 'test' group by 1)
select label, n, round(m, 8) as mean_score, worst as place from r where worst <= 5""")
def highest_scores(spark, d):
    r = scored(spark, d).where("split = 'test'").groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("m"), "label")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 5").select("label", "n", F.round("m", 8).alias("mean_score"), "place")


def compared(rows):
    """(method_id, auroc, fpr95) of (method_id, pos, score), all methods in one pass."""
    counts = metrics.score_counts(rows, ["method_id"], F.col("pos"), F.round("score", 9))
    both = metrics.auroc(counts, ["method_id"]).join(metrics.fpr_of_counts(counts, ["method_id"]), "method_id")
    return both.select("method_id", F.round("auroc", 6).alias("auroc"), F.round("fpr", 6).alias("fpr95"))


def method_scores(spark, d, methods):
    """(method_id, pos, score) of the test rows under each (method, variant), fitted on known training rows only."""
    a = cut(archive(spark, d))
    train, test = scorers.train_only(a), a.where("split = 'test'")
    ks = [int(variant.split("=")[-1]) for method, variant in methods if method == "knn_cosine"]
    near = cut(scorers.neighbour_means(train, test.select("sample_id", "e"), ks)) if ks else None
    out = None
    for method, variant in methods:
        name = names.method_id(F.lit(method), F.lit(variant)).alias("method_id")
        if method == "knn_cosine":
            one = finite_scores(test.join(near.select("sample_id", F.col("k" + variant.split("=")[-1]).alias("score")), "sample_id"), "score")
        else:
            one = scorers.fit_and_score(method, variant, train, test)
        # One method after the other, so that the plan and the broadcasts of all are never held at once.
        one = cut(one.select(name, (F.col("status") == "unknown").alias("pos"), "score"))
        out = one if out is None else out.unionByName(one)
    return out


FITTED_METHODS = (("mahalanobis", "pinv"), ("mahalanobis", "ledoit-wolf"), ("mahalanobis", "relative"), ("vim", "0.95"), ("ncm", "standardized"), ("react", "p85"), ("react", "p95"))
PLAIN_METHODS = (
    ("msp", "primary"), ("entropy", "natural_log"), ("energy", "T=0.5"), ("energy", "T=1.0"), ("energy", "T=2.0"), ("ncm", "euclidean"), ("ncm", "cosine"),
    ("knn_cosine", "k=1"), ("knn_cosine", "k=5"), ("knn_cosine", "k=10"), ("react", "p90"),
)


@query()
def method_comparison(spark, d):
    """AUROC and FPR at 95 % of the whole matrix of methods on the test rows."""
    return compared(method_scores(spark, d, PLAIN_METHODS + FITTED_METHODS))


_LONG = " union all ".join([
    *(f"select '{m}' as method_id, sample_id, {c} as score from lg" for m, c in (("msp_primary", "msp"), ("entropy_natural_log", "entropy"), ("energy_t0_5", "energy_t05"), ("energy_t1_0", "energy_t1"), ("energy_t2_0", "energy_t2"))),
    "select 'ncm_euclidean', sample_id, nearest from ce", "select 'ncm_cosine', sample_id, score from nc", *(f"select 'knn_cosine_k{k}', sample_id, knn{k} from kn" for k in (1, 5, 10)), "select 'react_p90', sample_id, score from re",
])


@query(f"""with {ARCHIVE}, lg as ({SCORES['score_logits']}), ce as ({SCORES['osr_centroid_scores']}), nc as ({SCORES['score_ncm_cosine']}), kn as ({SCORES['score_knn']}), re as ({SCORES['score_react']}),
lo as (select method_id, status = 'unknown' as pos, round(score, 5) as score from ({_LONG}) s join (select distinct sample_id, status from archive where split = 'test') using (sample_id)),
rk as (select method_id, pos, rank() over (partition by method_id order by score) + (count(*) over (partition by method_id, score) - 1) / 2.0 as r from lo),
au as (select method_id, (sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2.0) / (sum(pos::int) * sum((not pos)::int)) as auroc from rk group by 1),
th as (select method_id, quantile_cont(score, 1 - 0.95) as q from lo where pos group by 1), fp as (select method_id, avg((score > q)::double) as fpr from lo join th using (method_id) where not pos group by 1)
select method_id, round(auroc, 6) as auroc, round(fpr, 6) as fpr95 from au join fp using (method_id)""")
def plain_method_comparison(spark, d):
    """AUROC and FPR at 95 % of the methods that need sums only, from scores of five digits."""
    return compared(method_scores(spark, d, PLAIN_METHODS).withColumn("score", F.round("score", 5)))
