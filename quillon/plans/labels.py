"""Queries: taxonomy, derived names, checks of splits and checksums, external and detection manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import names
from quillon.functions.text import normalize_label, strip, trim_lower
from quillon.operators import boxes, checks, hashjoin, splits
from quillon.operators.taxonomy import Taxonomy, canonical_labels
from quillon.plans.evaluation import _NAMES, CLASSES
from quillon.plans.manifest import ALIAS, HASHED, M, ONE, images, manifest, samples
from quillon.plans.registry import collector
from quillon.plans.sqltext import ARCHIVE, n
from quillon.plans.studies import _boxes
from quillon.plans.views import archive
from quillon.session import cut, small_side
from quillon.sources.tables import table

QUERIES, ORACLES, query = collector()

TAXONOMY = Taxonomy(CLASSES, tuple(x for g in names.UNKNOWN_GROUPS.values() for x in g))


@query(f"with {M}, {ALIAS}, k as (select sample_id, coalesce(c, label) as canonical, status from m left join al on label = a) select distinct sample_id, canonical, case when canonical in ({_NAMES}) then 'known' else 'unknown' end as taxonomy_status, status is not distinct from case when canonical in ({_NAMES}) then 'known' else 'unknown' end as agrees from k")
def taxonomy_status(spark, d):
    """Canonical label and status by the taxonomy of every sample, and whether the manifest says the same."""
    m = manifest(spark, d).select("sample_id", "label", F.col("status").alias("said"))
    c = canonical_labels(m, "label", table(spark, d, "label_alias"))
    status = TAXONOMY.status(F.col("canonical"))
    return c.select("sample_id", "canonical", status.alias("taxonomy_status"), F.col("said").eqNullSafe(status).alias("agrees")).distinct()


@query(f"with {ONE}, {ALIAS}, k as (select coalesce(c, label) as canonical from one left join al on label = a) select canonical, case when canonical in ({_NAMES}) then 'known' else 'unknown' end as taxonomy_status, count(*) as n from k group by 1, 2")
def taxonomy_counts(spark, d):
    """Samples by canonical label and taxonomy status."""
    c = canonical_labels(samples(spark, d).select("label"), "label", table(spark, d, "label_alias"))
    return c.groupBy("canonical", TAXONOMY.status(F.col("canonical")).alias("taxonomy_status")).agg(F.count("*").alias("n"))


@query(f"with {ONE} select sample_id, case when split = 'validation' and status = 'known' then 'known_validation' when split = 'test' and status = 'known' then 'known_test' when split = 'test' then 'unknown_test' else split end as named from one")
def named_splits(spark, d):
    return samples(spark, d).select("sample_id", names.named_split(F.col("split"), F.col("status")).alias("named"))


@query("select distinct point_id, strategy, lower(replace(replace(replace(replace(strategy || '_k=' || point_id || '.0', '=', ''), '.', '_'), '-', '_'), ' ', '_')) as method_id from operating_point where strategy is not null")
def method_ids(spark, d):
    p = table(spark, d, "operating_point").where("strategy is not null")
    return p.select("point_id", "strategy", names.method_id(F.col("strategy"), F.concat(F.lit("k="), "point_id", F.lit(".0"))).alias("method_id")).distinct()


_GROUPS = " ".join(f"when label in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in names.UNKNOWN_GROUPS.items())


@query(f"with {ARCHIVE} select case {_GROUPS} else 'unassigned' end as unknown_group, count(*) as n, count(distinct label) as n_labels from archive where status = 'unknown' group by 1")
def unknown_groups(spark, d):
    a = archive(spark, d).where("status = 'unknown'")
    return a.groupBy(names.unknown_group(F.col("label")).alias("unknown_group")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query(f"with {ARCHIVE} select sample_id, label, coalesce(list_position([{_NAMES}], label), 0)::int - 1 as place from archive")
def label_indices(spark, d):
    return archive(spark, d).select("sample_id", "label", names.label_index(F.col("label"), CLASSES).alias("place"))


@query(f"with {ONE} select distinct m.sample_id, m.checksum, one.checksum as expected, m.checksum != '' as there, m.checksum != '' and m.checksum = one.checksum as matches from m join one using (sample_id)")
def checksum_states(spark, d):
    """Every checksum given for a sample against that of its first row."""
    first = samples(spark, d).select("sample_id", F.col("checksum").alias("expected"))
    m = manifest(spark, d).select("sample_id", "checksum").distinct().join(first, "sample_id")
    there = F.col("checksum") != ""
    return m.select("sample_id", "checksum", "expected", there.alias("there"), (there & (F.col("checksum") == F.col("expected"))).alias("matches")).distinct()


@query(f"select config_id, substr(sha256(concat_ws('|', 'method=' || coalesce({n('method')}, ''), 'seed=' || coalesce(seed::varchar, ''), 'train=' || coalesce(round(train_size * 1000)::int::varchar, ''))), 1, 16) as config_hash from split_config")
def config_hashes(spark, d):
    """A 16-digit name of each split configuration: SHA-256 of its settings in a fixed order."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.concat(F.lit("method="), text(normalize_label(F.col("method")))), F.concat(F.lit("seed="), text(F.col("seed"))), F.concat(F.lit("train="), text(F.round(F.col("train_size") * 1000).cast("int")))]
    return table(spark, d, "split_config").select("config_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("config_hash"))


@query(f"select coalesce({n('split')}, '') as split, count(*) as n, coalesce({n('split')}, '') in ('train', 'validation', 'test', '') as allowed from sample_manifest group by 1")
def split_names_found(spark, d):
    """Split names of the manifest as given, after N, and whether a predefined split may use them."""
    m = table(spark, d, "sample_manifest").select(F.coalesce(normalize_label(F.col("split")), F.lit("")).alias("split"))
    return m.groupBy("split").agg(F.count("*").alias("n")).select("split", "n", F.col("split").isin("train", "validation", "test", "").alias("allowed"))


@query(f"with {ONE}, c as (select label, split, count(*) as k from one where label is not null group by 1, 2) select label, string_agg(split || '=' || k, ',' order by split) as by_split, sum(k)::bigint as n from c group by 1")
def nested_counts(spark, d):
    """For each label, its samples by split as one text."""
    c = samples(spark, d).where("label is not null").groupBy("label", "split").agg(F.count("*").alias("k"))
    each = F.array_sort(F.collect_list(F.struct("split", "k")))
    return c.groupBy("label").agg(F.array_join(F.transform(each, lambda x: F.concat(x["split"], F.lit("="), x["k"])), ",").alias("by_split"), F.sum("k").alias("n"))


_FIRST = "arc as (select sample_id, min(split) as split from archive group by 1)"


@query(f"with {ARCHIVE}, {ONE}, {_FIRST} select sample_id, one.split as split_a, arc.split as split_b from one join arc using (sample_id) where one.split != arc.split")
def split_moves(spark, d):
    """Samples that the manifest and the archive put into different splits, by a checked one-to-one join."""
    a = samples(spark, d).select("sample_id", "split")
    b = archive(spark, d).groupBy("sample_id").agg(F.min("split").alias("split"))
    return checks.one_to_one(cut(a), cut(b), ["sample_id"]).where("split_a != split_b").select("sample_id", "split_a", "split_b")


@query(f"""with {ARCHIVE}, {ONE}, {_FIRST}, j as (select one.split as a, arc.split as b, one.status from one join arc using (sample_id))
select count(*) as n_shared, count(*) filter (a != b) as n_moved, count(*) filter (a = b) as n_kept, count(*) filter (a != b and b = 'test') as n_to_test, count(*) filter (a != b and status = 'known') as n_known_moved, (select count(*) from one) - count(*) as n_only_a from j""")
def split_move_report(spark, d):
    """One row of counts that compares two versions of the split."""
    a = cut(samples(spark, d).select("sample_id", "split", "status"))
    b = archive(spark, d).groupBy("sample_id").agg(F.min("split").alias("split"))
    j = checks.one_to_one(a, cut(b), ["sample_id"], "left")
    there, moved = F.col("split_b").isNotNull(), F.col("split_a") != F.col("split_b")
    return j.agg(
        F.count_if(there).alias("n_shared"), F.count_if(moved).alias("n_moved"), F.count_if(F.col("split_a") == F.col("split_b")).alias("n_kept"),
        F.count_if(moved & (F.col("split_b") == "test")).alias("n_to_test"), F.count_if(moved & (F.col("status") == "known")).alias("n_known_moved"), F.count_if(~there).alias("n_only_a"),
    )


QC = f"""src as (select distinct sample_id, {n('original_label')} as source_label, regexp_replace(path, '^\\s+|\\s+$', '', 'g') as rel, coalesce(lower(regexp_replace(checksum, '^\\s+|\\s+$', '', 'g')), '') as sum,
    coalesce(width > 0 and height > 0, false) as readable from sample_manifest where trim(sample_id) != '' and path is not null),
mapped as (select src.*, coalesce(c, source_label) as canonical, case when coalesce(c, source_label) in ({_NAMES}) then 'known' when c is not null or source_label in (select {n('canonical_label')} from sampling_target) then 'unknown' else 'excluded' end as mapping from src left join al on source_label = a),
qc as (select *, row_number() over (partition by rel order by sample_id, source_label nulls first, sum, readable) > 1 as duplicate_path, sum != '' and count(*) over (partition by sum) > 1 as duplicate_checksum from mapped)"""


def external_rows(spark, d):
    """Manifest rows as an external set: canonical label, mapping (known, unknown, excluded), repeats of path and checksum."""
    src = table(spark, d, "sample_manifest").where("trim(sample_id) != '' and path is not null").select(
        "sample_id", normalize_label(F.col("original_label")).alias("source_label"), strip(F.col("path")).alias("rel"), F.coalesce(trim_lower(F.col("checksum")), F.lit("")).alias("sum"),
        F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)).alias("readable"),
    ).distinct()
    al = table(spark, d, "label_alias").groupBy(normalize_label(F.col("alias")).alias("a")).agg(F.min(normalize_label(F.col("canonical_label"))).alias("c"))
    wanted = table(spark, d, "sampling_target").select(normalize_label(F.col("canonical_label")).alias("t")).where("t is not null").distinct()
    m = src.join(small_side(al), F.col("source_label") == F.col("a"), "left").join(small_side(wanted), F.col("source_label") == F.col("t"), "left").withColumn("canonical", F.coalesce("c", "source_label"))
    mapping = F.when(F.col("canonical").isin(*CLASSES), "known").when(F.col("c").isNotNull() | F.col("t").isNotNull(), "unknown").otherwise("excluded")
    m = cut(m.withColumn("mapping", mapping).drop("a", "c", "t"))
    order = ["sample_id", "source_label", "sum", "readable"]
    first = F.row_number().over(Window.partitionBy("rel").orderBy(*order)) > 1
    copies = m.groupBy("sum").agg(F.count("*").alias("copies"))
    return m.withColumn("duplicate_path", first).join(copies, "sum").withColumn("duplicate_checksum", (F.col("sum") != "") & (F.col("copies") > 1)).drop("copies")


@query(f"with {ALIAS}, {QC} select sample_id, rel, source_label, sum as checksum, readable, duplicate_path, duplicate_checksum from qc")
def external_quality(spark, d):
    return external_rows(spark, d).select("sample_id", "rel", "source_label", F.col("sum").alias("checksum"), "readable", "duplicate_path", "duplicate_checksum")


@query(f"with {ALIAS}, {QC} select sample_id, rel, canonical as canonical_label, mapping as known_status, 'test' as split, source_label, sum as checksum from qc where mapping != 'excluded'")
def external_manifest(spark, d):
    """The external rows that a mapping admits, all in the test split."""
    e = external_rows(spark, d).where("mapping != 'excluded'")
    m = e.select("sample_id", "rel", F.col("canonical").alias("canonical_label"), F.col("mapping").alias("known_status"), F.lit("test").alias("split"), "source_label", F.col("sum").alias("checksum"))
    return checks.test_only(m)


@query(f"with {ALIAS}, {QC} select count(*) filter (mapping != 'excluded') as n_rows, count(*) filter (mapping = 'known') as n_known, count(*) filter (mapping = 'unknown') as n_unknown, count(*) filter (mapping = 'excluded') as n_excluded, count(*) filter (not readable) as n_unreadable, count(*) filter (duplicate_path) as n_duplicate_path, count(*) filter (duplicate_checksum) as n_duplicate_checksum from qc")
def external_audit(spark, d):
    is_ = lambda m: F.count_if(F.col("mapping") == m)
    return external_rows(spark, d).agg(
        F.count_if(F.col("mapping") != "excluded").alias("n_rows"), is_("known").alias("n_known"), is_("unknown").alias("n_unknown"), is_("excluded").alias("n_excluded"),
        F.count_if(~F.col("readable")).alias("n_unreadable"), F.count_if("duplicate_path").alias("n_duplicate_path"), F.count_if("duplicate_checksum").alias("n_duplicate_checksum"),
    )


# Cells from keys: a raw label a line, boxes as in ``studies`` on an image of 96 x 88, films from suppliers.
RAW_LABELS = ("Small Lymph", "Artifact", " burst", "Monocyte", "neutrophil", "", "EOSINOPHIL", "Blast-cell", "small_lymph", "Basophil")
_RAW = ", ".join(f"'{x}'" for x in RAW_LABELS)
_NORM = "trim(regexp_replace(replace(replace(lower(raw), '_', ' '), '-', ' '), ' +', ' ', 'g'))"
CELLS = f"""lab as (select l_orderkey::varchar as image_id, l_orderkey::varchar || ':' || l_linenumber::varchar as gt_id, [{_RAW}][l_partkey % 10 + 1] as raw, (l_orderkey % 61)::varchar as film,
  (l_partkey % 97)::double as x, (l_suppkey % 89)::double as y, 4 + (l_partkey % 13)::double as w, 4 + (l_suppkey % 11)::double as h from lineitem),
c1 as (select image_id, gt_id, film, raw, {_NORM} as nrm, least(x, 96) as x_min, least(y, 88) as y_min, least(x + w, 96) as x_max, least(y + h, 88) as y_max from lab),
c2 as (select *, case when nrm in ('artifact', 'artefact', 'burst', '') then '' when nrm in ('basophil', 'eosinophil', 'monocyte') then nrm when nrm in ('small lymph', 'lymphocyte', 'lymph') then 'lymphocyte' when nrm = 'neutrophil' then 'neutrophil_segmented' else 'unknown' end as morphology,
  nrm not in ('artifact', 'artefact', 'burst', '') as eligible from c1 where x_max > x_min and y_max > y_min),
fs as (select film, row_number() over (order by sha256('13:' || film), film) as r, count(*) over () as n from (select distinct film from c2)),
cells as (select c2.*, case when eligible then case when morphology = 'unknown' then 'unknown' else 'known' end else 'excluded' end as status, case when eligible then '' when nrm = '' then 'empty_label' else nrm end as reason,
  case when r <= round_even(n * 0.7, 0) then 'train' when r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'validation' else 'test' end as split from c2 join fs using (film))"""


def detection_cells(spark, d):
    """Cells with clipped boxes, mapped labels and the split of their film; boxes outside the image are left out."""
    raw = F.get(F.array(*[F.lit(x) for x in RAW_LABELS]), (F.col("l_partkey") % 10).cast("int"))
    b = _boxes(spark, d).select("image_id", "gt_id", raw.alias("raw"), (F.col("l_orderkey") % 61).cast("string").alias("film"), boxes.clip(F.col("truth"), F.lit(96), F.lit(88)).alias("box"))
    c = cut(b.where("box is not null").select("image_id", "gt_id", "film", "raw", "box.*", names.cell_class(F.col("raw")).alias("m")).select("*", "m.*").drop("m"))
    return checks.full_lookup(c, splits.group_split(c, "film"), "film")


@query(f"with {CELLS} select image_id, gt_id, film, raw, morphology, status, eligible, reason, x_min, y_min, x_max, y_max, split from cells")
def detection_manifest(spark, d):
    return detection_cells(spark, d).select("image_id", "gt_id", "film", "raw", "morphology", "status", "eligible", "reason", "x_min", "y_min", "x_max", "y_max", "split")


@query(f"""with {CELLS}, e as (select * from cells where eligible)
select 'annotations' as item, '' as name, count(*) as n from cells union all select 'eligible', '', count(*) from e union all select 'films', '', count(distinct film) from cells
union all select 'images', split, count(distinct image_id) from e group by 2 union all select 'boxes', split, count(*) from e group by 2
union all select 'excluded', reason, count(*) from cells where not eligible group by 2 union all select 'morphology', morphology, count(*) from e group by 2 union all select 'status', status, count(*) from e group by 2""")
def detection_audit(spark, d):
    """Counts of a detection manifest by what they count."""
    c = cut(detection_cells(spark, d))
    e = c.where("eligible")
    row = lambda df, item, by, n: (df.groupBy(F.col(by).alias("name")) if by else df.groupBy(F.lit("").alias("name"))).agg(n.alias("n")).select(F.lit(item).alias("item"), "name", "n")
    n_rows = F.count("*")
    out = row(c, "annotations", "", n_rows)
    for df, item, by, n_ in (
        (e, "eligible", "", n_rows), (c, "films", "", F.countDistinct("film")), (e, "images", "split", F.countDistinct("image_id")), (e, "boxes", "split", n_rows),
        (c.where("not eligible"), "excluded", "reason", n_rows), (e, "morphology", "morphology", n_rows), (e, "status", "status", n_rows),
    ):
        out = out.unionByName(row(df, item, by, n_))
    return out


_CROSS = "x as (select a.id as a_id, a.split as a_split, b.id as b_id, b.split as b_split, hamming(a.h, b.h)::int as bits, coalesce(a.sha = b.sha, false) as same from img a join img b on a.split in ('train', 'validation') and b.split in ('validation', 'test') and a.split != b.split and hamming(a.h, b.h) <= 4)"


def cross_split_pairs(spark, d):
    """Image pairs of different splits, the earlier split first, with hashes at most four bits apart; no pair is dropped."""
    i = images(spark, d).where("split is not null")
    side = lambda k: i.select(F.col("id").alias(f"key_{k}"), F.col("split").alias(f"split_{k}"), F.col("sha").alias(f"sha_{k}"))
    p = hashjoin.hamming_pairs(i, "id", "h", 4).join(side("a"), "key_a").join(side("b"), "key_b").where("split_a != split_b")
    place = lambda c: F.when(F.col(c) == "train", 0).when(F.col(c) == "validation", 1).otherwise(2)
    first = place("split_a") < place("split_b")
    pick = lambda a, b, out: F.when(first, F.col(a)).otherwise(F.col(b)).alias(out)
    return p.select(
        pick("key_a", "key_b", "a_id"), pick("split_a", "split_b", "a_split"), pick("key_b", "key_a", "b_id"), pick("split_b", "split_a", "b_split"), F.col("hamming").alias("bits"),
        F.coalesce(F.col("sha_a") == F.col("sha_b"), F.lit(False)).alias("same"),
    )


@query(f"with {HASHED}, {_CROSS} select a_id, a_split, b_id, b_split, bits from x")
def cross_split_near_pairs(spark, d):
    return cross_split_pairs(spark, d).drop("same")


@query(f"""with {HASHED}, {_CROSS} select a_split, b_split, count(*) as n_near, count(*) filter (bits = 0) as n_equal_hash, count(*) filter (same) as n_same_file from x group by 1, 2""")
def duplicate_audit(spark, d):
    """Near pairs of different splits, with how many have one hash or are one file."""
    return cross_split_pairs(spark, d).groupBy("a_split", "b_split").agg(F.count("*").alias("n_near"), F.count_if(F.col("bits") == 0).alias("n_equal_hash"), F.count_if("same").alias("n_same_file"))


@query(f"""with {ARCHIVE}, {ONE}, b as (select distinct sample_id from archive where split = 'test'), t as (select one.sample_id, one.label, row_number() over (partition by one.label order by sha256('13:' || one.sample_id), one.sample_id) as r,
  count(*) over (partition by one.label) as available_n from one join b using (sample_id) where one.split = 'test' and one.label is not null)
select label, sample_id, available_n from t where r <= 192""")
def common_test_sample(spark, d):
    """At most 192 samples a class of those that both versions hold in test, with how many there are."""
    both = samples(spark, d).where("split = 'test'").select("sample_id").intersect(archive(spark, d).where("split = 'test'").select("sample_id"))
    t = samples(spark, d).where("label is not null").join(both, "sample_id", "left_semi").select("sample_id", "label")
    return splits.per_class_sample(t, "sample_id", "label", 192).select("label", "sample_id", "available_n")


MIXED_PAIRS = (
    ("lymphocyte", "lymphocyte_large_granular"), ("lymphocyte", "lymphocyte_neoplastic"), ("lymphocyte", "lymphocyte_reactive"), ("lymphocyte", "hairy_cell"), ("neutrophil_segmented", "neutrophil_band"),
)


@query(f"with {ARCHIVE}, p(class_a, class_b) as (values {', '.join(str(p) for p in MIXED_PAIRS)}) select class_a, class_b from p where class_a in (select label from archive where split = 'test') and class_b in (select label from archive where split = 'test')")
def mixing_pairs(spark, d):
    """The listed class pairs of which both are in the data."""
    there = cut(archive(spark, d).where("split = 'test'").select("label").distinct())
    p = spark.createDataFrame(list(MIXED_PAIRS), "class_a string, class_b string")
    for side in ("class_a", "class_b"):
        p = p.join(there, F.col(side) == F.col("label"), "left_semi")
    return p


@query(f"with {ARCHIVE}, u as (select split, status, count(*) as n from archive group by 1, 2) select split, status, n, split = 'train' and status = 'known' as used_to_fit, split = 'validation' and status = 'known' as used_to_calibrate, split = 'test' as used_to_evaluate from u")
def data_usage(spark, d):
    """Rows of the archive by what they may be used for."""
    u = archive(spark, d).groupBy("split", "status").agg(F.count("*").alias("n"))
    s, known = F.col("split"), F.col("status") == "known"
    return u.select("split", "status", "n", ((s == "train") & known).alias("used_to_fit"), ((s == "validation") & known).alias("used_to_calibrate"), (s == "test").alias("used_to_evaluate"))
