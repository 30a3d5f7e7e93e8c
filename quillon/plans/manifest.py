"""Queries: manifest, labels, splits, audits, near-duplicates and samples."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.functions.bits import hash64
from quillon.functions.text import normalize_label, split_name, strip, trim_lower
from quillon.operators import checks, hashjoin, near_duplicates, splits
from quillon.plans.registry import collector
from quillon.plans.sqltext import ARCHIVE, n, split, t
from quillon.plans.views import archive
from quillon.session import cut, small_side
from quillon.sources.tables import table

QUERIES, ORACLES, query = collector()

M = f"""m as (
  select distinct sample_id, regexp_replace(path, '^\\s+|\\s+$', '', 'g') as path, {t('dataset')} as dataset, {n('canonical_label')} as label, {n('known_status')} as status,
    coalesce({split('split')}, '') as split, coalesce({t('group_id')}, '') as film, coalesce({t('checksum')}, '') as checksum, width, height
  from sample_manifest where trim(sample_id) != '')"""


def manifest(spark, d):
    """Distinct normalised rows of the manifest; '' stands for a missing split, film or checksum."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return (
        table(spark, d, "sample_manifest").where("trim(sample_id) != ''")
        .select(
            "sample_id", strip(F.col("path")).alias("path"), trim_lower(F.col("dataset")).alias("dataset"), normalize_label(F.col("canonical_label")).alias("label"),
            normalize_label(F.col("known_status")).alias("status"), empty(split_name(F.col("split"))).alias("split"), empty(trim_lower(F.col("group_id"))).alias("film"),
            empty(trim_lower(F.col("checksum"))).alias("checksum"), "width", "height",
        ).distinct()
    )


ONE = f"""{M}, one as (select * from (select *, row_number() over (partition by sample_id order by path, label nulls first, status nulls first, split, film, checksum, width nulls first, height nulls first, dataset nulls first) as rn from m) where rn = 1)"""


def samples(spark, d):
    """The manifest with each sample once: its first row in the order of the columns."""
    order = ["path", "label", "status", "split", "film", "checksum", "width", "height", "dataset"]
    w = Window.partitionBy("sample_id").orderBy(*order)
    return manifest(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


ALIAS = f"al as (select {n('alias')} as a, min({n('canonical_label')}) as c from label_alias group by 1)"


@query(f"select sample_id, original_label, {n('original_label')} as normalized, {split('split')} as split from sample_manifest")
def normalized_labels(spark, d):
    m = table(spark, d, "sample_manifest")
    return m.select("sample_id", "original_label", normalize_label(F.col("original_label")).alias("normalized"), split_name(F.col("split")).alias("split"))


@query(f"with {M}, {ALIAS} select sample_id, coalesce(c, label) as canonical, coalesce(coalesce(c, label) in ('basophil', 'eosinophil', 'lymphocyte', 'monocyte', 'neutrophil_segmented'), false) as known from m left join al on label = a")
def canonical_labels(spark, d):
    alias = table(spark, d, "label_alias").groupBy(normalize_label(F.col("alias")).alias("a")).agg(F.min(normalize_label(F.col("canonical_label"))).alias("c"))
    m = manifest(spark, d).join(small_side(alias), F.col("label") == F.col("a"), "left").withColumn("canonical", F.coalesce("c", "label"))
    return m.select("sample_id", "canonical", F.coalesce(F.col("canonical").isin("basophil", "eosinophil", "lymphocyte", "monocyte", "neutrophil_segmented"), F.lit(False)).alias("known"))


@query(f"with {M} select sample_id, substr(sha1(dataset || ':' || path || ':' || checksum), 1, 20) as stable_id, regexp_extract(path, '\\.([A-Za-z]+)$', 1) as extension, split_part(path, '/', 4) as folder from m where dataset is not null")
def stable_ids(spark, d):
    m = manifest(spark, d).where("dataset is not null")
    return m.select(
        "sample_id", F.substring(F.sha1(F.concat_ws(":", "dataset", "path", "checksum")), 1, 20).alias("stable_id"),
        F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("extension"), F.split_part("path", F.lit("/"), F.lit(4)).alias("folder"),
    )


@query(f"with {ONE} select label, status, split, count(*) as n from one group by all")
def class_counts(spark, d):
    return samples(spark, d).groupBy("label", "status", "split").agg(F.count("*").alias("n"))


@query(f"""with {ONE} select count(*) as n_rows, count(distinct dataset) as n_datasets, array_to_string(list_sort(list(distinct label)), ',') as labels, min(width) as min_width, max(width) as max_width,
min(height) as min_height, max(height) as max_height, count(*) filter (status = 'known') as n_known, array_to_string(list_sort(list(distinct split)), ',') as splits from one""")
def manifest_summary(spark, d):
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return samples(spark, d).agg(
        F.count("*").alias("n_rows"), F.countDistinct("dataset").alias("n_datasets"), names("label").alias("labels"), F.min("width").alias("min_width"), F.max("width").alias("max_width"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.count_if(F.col("status") == "known").alias("n_known"), names("split").alias("splits"),
    )


@query(f"with {ONE}, c as (select label, count(*) as n from one where status = 'known' and label != '' group by 1) select label, n, round(1.0 / n * (select count(*) from c) / (select sum(1.0 / n) from c), 8) as weight from c")
def class_weights(spark, d):
    c = samples(spark, d).where("status = 'known' and label != ''").groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return c.select("label", "n", F.round(1 / F.col("n") * F.count("*").over(every) / F.sum(1 / F.col("n")).over(every), 8).alias("weight"))


@query(f"""with {ONE}, k as (select *, row_number() over (partition by label order by sha256('13:' || sample_id), sample_id) as r, count(*) over (partition by label) as n from one where status = 'known' and label != '')
select sample_id, case when r <= round_even(n * 0.7, 0) then 'train' when r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'validation' else 'test' end as split from k
union all select sample_id, 'test' from one where status = 'unknown' and label != ''""")
def split_stratified(spark, d):
    s = samples(spark, d).where("status in ('known', 'unknown') and label != ''").drop("split")
    return splits.stratified_split(s, "sample_id", "label", F.col("status") == "known").select("sample_id", "split")


@query(f"""with {ONE}, g as (select film, row_number() over (order by sha256('13:' || film), film) as r, count(*) over () as n from (select distinct film from one where film != ''))
select film, case when r <= round_even(n * 0.7, 0) then 'train' when r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'validation' else 'test' end as split from g""")
def split_by_group(spark, d):
    return splits.group_split(samples(spark, d).where("film != ''"), "film")


@query(f"""with {M}, u as (select 'checksum' as kind, checksum as key, split from m union all select 'film', film, split from m union all select 'sample', sample_id, split from m)
select kind, key, array_to_string(list_sort(list(distinct split)), ',') as splits from u where key != '' and split != '' group by 1, 2 having count(distinct split) > 1""")
def split_overlap_audit(spark, d):
    m = manifest(spark, d)
    out = None
    for kind, c in (("checksum", "checksum"), ("film", "film"), ("sample", "sample_id")):
        one = splits.spanning_keys(m, c, "split").select(F.lit(kind).alias("kind"), F.col(c).alias("key"), F.array_join("splits", ",").alias("splits"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {M} select 'sample_id' as field, count(*) - count(distinct sample_id) as duplicates, count(*) filter (sample_id = '') as missing from m
union all select 'checksum', count(*) filter (checksum != '') - count(distinct nullif(checksum, '')), count(*) filter (checksum = '') from m
union all select 'path', count(*) - count(distinct path), count(*) filter (path = '') from m""")
def duplicate_counts(spark, d):
    m = manifest(spark, d)
    out = None
    for c in ("sample_id", "checksum", "path"):
        there = F.when(F.col(c) != "", F.col(c))
        one = m.agg((F.count(there) - F.countDistinct(there)).alias("duplicates"), F.count_if(F.col(c) == "").alias("missing")).select(F.lit(c).alias("field"), "duplicates", "missing")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {M}, {ALIAS} select distinct label from m where label != '' and label not in (select c from al) and label not in (select a from al) and label not in (select {n('canonical_label')} from sampling_target where canonical_label is not null)")
def labels_outside_taxonomy(spark, d):
    al, tg = table(spark, d, "label_alias"), table(spark, d, "sampling_target")
    names = al.select(normalize_label(F.col("alias")).alias("label")).union(al.select(normalize_label(F.col("canonical_label")))).union(tg.select(normalize_label(F.col("canonical_label"))))
    return manifest(spark, d).where("label != ''").select("label").distinct().join(small_side(names.distinct()), "label", "left_anti")


_PARTS = ", ".join(f"sum(('0x' || substr(h, {i}, 15))::bigint)::varchar" for i in (1, 16, 31, 46))


@query(f"""with {M}, l as (select sha256(concat_ws('|', sample_id, path, coalesce(dataset, ''), coalesce(label, ''), coalesce(status, ''), split, film, checksum)) as h from m)
select sha256(concat_ws('|', {_PARTS})) as manifest_hash, count(*) as n_rows from l""")
def manifest_hash(spark, d):
    """Fingerprint of all rows that needs no order: sums of four parts of every row's SHA-256, hashed.

    Partial sums are combined map-side, so nothing is sorted or gathered.
    """
    line = F.concat_ws("|", "sample_id", "path", *[F.coalesce(c, F.lit("")) for c in ("dataset", "label", "status")], "split", "film", "checksum")
    rows = manifest(spark, d).select(F.sha2(line, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in (1, 16, 31, 46)]
    return rows.agg(F.sha2(F.concat_ws("|", *parts), 256).alias("manifest_hash"), F.count("*").alias("n_rows"))


HASHED = f"""bits0 as (select {t('image_id')} as id, regexp_replace({t('average_hash')}, '^0x', '') as h, {split('split')} as split, {t('sha256')} as sha from raabin_image),
img as (select id, min(case when length(h) = 64 then h when length(h) = 16 then array_to_string(list_transform(string_split(h, ''), lambda x: lpad(bin(cast(position(x in '0123456789abcdef') - 1 as integer)), 4, '0')), '') end) as h,
  min(split) as split, min(nullif(sha, '')) as sha from bits0 where id != '' group by 1)"""


def images(spark, d):
    i = table(spark, d, "raabin_image").select(
        trim_lower(F.col("image_id")).alias("id"), hash64(F.col("average_hash")).alias("h"), split_name(F.col("split")).alias("split"), F.when(strip(F.col("sha256")) != "", trim_lower(F.col("sha256"))).alias("sha")
    )
    return i.where("id != ''").groupBy("id").agg(F.min("h").alias("h"), F.min("split").alias("split"), F.min("sha").alias("sha"))


_FIRST = "rep as (select h, min(id) as id, count(*) as n from img where h is not null group by 1)"


@query(f"with {HASHED}, {_FIRST} select a.id as key_a, b.id as key_b, hamming(a.h, b.h) as hamming from rep a join rep b on a.id < b.id and hamming(a.h, b.h) <= 4")
def hamming_pairs(spark, d):
    """Pairs of image classes with near hashes, a class standing for its images of one hash; see ``equal_hash_groups``."""
    first = images(spark, d).where("h is not null").groupBy("h").agg(F.min("id").alias("id"))
    return hashjoin.hamming_pairs(first, "id", "h", 4)


@query(f"with {HASHED}, {_FIRST} select img.id as id, rep.id as class_id, n from img join rep using (h)")
def equal_hash_groups(spark, d):
    """Class of each image with a hash: the least image of the same hash, and how many there are.

    Members are never paired with each other, so a hash that many images share costs one row an image.
    """
    i = images(spark, d).where("h is not null").select("id", "h")
    first = i.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return i.join(first, "h").select("id", "class_id", "n")


# A sample's field is its vector scaled to 0..1; its hash has a bit a cell of the field resized from 96 to 64 values.
POOLED = "flatten(list_transform(range(0, 32), lambda t: [(2 * e[3 * t + 1] + e[3 * t + 2]) / 3, (e[3 * t + 2] + 2 * e[3 * t + 3]) / 3]))"
FIELDS = f"""{ARCHIVE}, {ONE}, first as (select * from (select *, row_number() over (partition by sample_id order by label, status, split, e) as rn from archive) where rn = 1),
fields as (select f.sample_id as id, f.label, f.status, f.split, nullif(one.checksum, '') as checksum, list_transform(e, lambda x: (x - list_min(e)) / greatest(list_max(e) - list_min(e), 1e-12)) as field,
  {POOLED} as cells from first f left join one using (sample_id)),
hashed as (select *, array_to_string(list_transform(cells, lambda x: case when x >= list_avg(cells) then '1' else '0' end), '') as h from fields)"""


def pooled(e: Column) -> Column:
    """96 values resized to 64: each three become two by their overlap."""
    at = lambda t, k: F.get(e, 3 * t + k)
    pair = lambda t: F.array((2 * at(t, 0) + at(t, 1)) / 3, (at(t, 1) + 2 * at(t, 2)) / 3)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), pair))


def fields(spark, d):
    """(id, label, status, split, checksum, field, h) of the usable samples of the archive, each once."""
    first = archive(spark, d).groupBy("sample_id").agg(F.min(F.struct("label", "status", "split", "e")).alias("r")).select(F.col("sample_id").alias("id"), "r.*")
    sums = samples(spark, d).select(F.col("sample_id").alias("id"), F.when(F.col("checksum") != "", F.col("checksum")).alias("checksum"))
    scaled = vec.let(F.array_min("e"), lambda lo: vec.let(F.greatest(F.array_max("e") - lo, F.lit(1e-12)), lambda w: F.transform("e", lambda x: (x - lo) / w)))
    both = checks.one_to_one(cut(first), cut(sums), ["id"], "left")
    return cut(both.select("id", "label", "status", "split", "checksum", scaled.alias("field"), hash64(vec.average_hash(pooled(F.col("e")))).alias("h")))


@query(f"with {FIELDS} select id as sample_id, h as bits from hashed")
def average_hash_bits(spark, d):
    """64-bit average hash of every sample's vector, resized to 64 cells, as binary digits."""
    f = fields(spark, d)
    digits = F.lpad(F.conv(F.hex("h"), 16, 2), 64, "0")
    return f.select(F.col("id").alias("sample_id"), digits.alias("bits"))


EVIDENCE = f"""{FIELDS}, p as (select a.id as key_a, b.id as key_b, hamming(a.h, b.h)::int as bits, coalesce(a.checksum = b.checksum, false) as same, a.split is distinct from b.split as crosses, a.field as x, b.field as y
  from hashed a join hashed b on a.id < b.id and hamming(a.h, b.h) <= 4),
q as (select *, list_avg(x) as mx, list_avg(y) as my from p),
r as (select *, list_avg(list_transform(x, lambda v: (v - mx) ** 2)) as vx, list_avg(list_transform(y, lambda v: (v - my) ** 2)) as vy, list_avg(list_transform(list_zip(x, y), lambda v: (v[1] - mx) * (v[2] - my))) as c from q),
m2 as (select *, round((2 * mx * my + 1e-4) * (2 * c + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)), 9) as similarity, round(case when vx * vy > 0 then c / sqrt(vx * vy) else (vx = vy and mx = my)::double end, 9) as correlation from r),
ev as (select *, case when same then 'confirmed' when bits <= 1 and similarity >= 0.985 and correlation >= 0.985 then 'probable_level1' when bits <= 4 and similarity >= 0.95 and correlation >= 0.95 then 'probable_level2' else 'candidate_level3' end as level from m2)"""


def evidence(spark, d):
    f = fields(spark, d)
    pairs = near_duplicates.candidate_pairs(f)
    side = lambda k: f.select(F.col("id").alias(f"key_{k}"), F.col("split").alias(f"split_{k}"))
    p = cut(pairs.join(side("a"), "key_a").join(side("b"), "key_b").withColumn("crosses", ~F.col("split_a").eqNullSafe(F.col("split_b"))).drop("split_a", "split_b"))
    return f, p


@query(f"with {EVIDENCE} select key_a, key_b, bits, same, round(similarity, 7) as similarity, round(correlation, 7) as correlation, crosses, level from ev")
def near_duplicate_evidence(spark, d):
    """Samples whose hashes differ in at most four bits, with what their checksums and fields say."""
    return evidence(spark, d)[1].select("key_a", "key_b", "bits", "same", F.round("similarity", 7).alias("similarity"), F.round("correlation", 7).alias("correlation"), "crosses", "level")


COMPONENTS = f"""{EVIDENCE}, link as (select key_a as a, key_b as b, case level when 'confirmed' then 3 else 2 end as s from ev where level in ('confirmed', 'probable_level1')),
e2 as (select a, b, s from link union select b, a, s from link),
label(node, low) using key (node) as (select id, id from hashed union select e2.a, min(l.low) from e2 join label l on l.node = e2.b join recurring.label own on own.node = e2.a group by e2.a, own.low having min(l.low) < own.low),
size as (select low, count(*) as k, row_number() over (order by count(*) desc, low) - 1 as i from label group by 1),
comp as (select 'ndc_' || lpad(i::varchar, 6, '0') as component_id, node, k as component_size, coalesce((select max(s) from e2 where a = node), 0)::int as evidence_strength from label join size using (low))"""


@query(f"with recursive {COMPONENTS} select * from comp")
def near_duplicate_components(spark, d):
    """Groups of samples that confirmed or probable duplicates of the first level link, singles included."""
    f, p = evidence(spark, d)
    return near_duplicates.duplicate_components(f, p)


@query(f"""with recursive {COMPONENTS}, mem as (select component_id, label, split from comp join hashed on id = node where status = 'known' and component_size > 1),
names as (select list(distinct label order by label) as ls from hashed where status = 'known'), sp as (select unnest(['train', 'validation', 'test']) as s, unnest([0.7, 0.15, 0.15]) as share, unnest([0, 1, 2]) as si),
slot as (select si, s, share, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as li, len(ls) as nl from sp, names),
init as (select list(coalesce(n, 0)::double order by si, li) as st, list(coalesce(t, 0) * share order by si, li) as goal, any_value(nl) as nl from slot
  left join (select label, split, count(*) as n from hashed where status = 'known' group by 1, 2) c on c.label = l and c.split = s left join (select label, count(*) as t from hashed where status = 'known' group by 1) k on k.label = l),
bad as (select component_id, string_agg(distinct split, ',' order by split) as old, row_number() over (order by component_id) as i from mem group by 1 having count(distinct split) > 1),
minus as (select i, list(coalesce(n, 0)::double order by si, li) as minus from bad cross join slot left join (select component_id, label, split, count(*) as n from mem group by all) c on c.component_id = bad.component_id and c.label = l and c.split = s group by 1),
plus as (select i, list(coalesce(n, 0)::double order by si, li) as plus from bad cross join slot left join (select component_id, label, count(*) as n from mem group by all) c on c.component_id = bad.component_id and c.label = l group by 1),
major as (select i, arg_max(split, {{'n': n, 'b': -rank}}) as major from (select i, split, count(*) as n, case split when 'test' then 0 when 'train' then 1 else 2 end as rank from mem join bad using (component_id) group by all) group by 1),
run(i, st, best) as (select 0::bigint, st, null::varchar from init union all
  select n.i, list_transform(range(1, 3 * nl + 1), lambda j: free[j] + case when (j - 1) // nl = list_position(['train', 'validation', 'test'], pick) - 1 then plus[j] else 0 end), pick from (
    select *, (select arg_min(o.s, {{'c': round(list_sum(list_transform(range(1, 3 * nl + 1), lambda j: (free[j] + case when (j - 1) // nl = o.si then plus[j] else 0 end - goal[j]) ** 2)), 6), 'm': o.s != major, 's': o.s}}) from sp o) as pick from (
      select run.i + 1 as i, list_transform(range(1, 3 * nl + 1), lambda j: st[j] - minus[j]) as free, plus, goal, nl, major
      from run join minus on minus.i = run.i + 1 join plus on plus.i = run.i + 1 join major on major.i = run.i + 1, init q(_, goal, nl))) n)
select component_id as component, old as old_splits, best as new_split from run join bad using (i)""")
def conservative_split(spark, d):
    """New splits of the near-duplicate components of known samples that the present splits tear apart."""
    f, p = evidence(spark, d)
    c = near_duplicates.duplicate_components(f, p).where("component_size > 1").select(F.col("node").alias("id"), F.col("component_id").alias("component"))
    return splits.conservative_resplit(f.where("status = 'known'").select("id", "label", "split"), c, "id", "label", "split")


@query(f"""with {ONE}, k as (select *, row_number() over (partition by label order by sha256('13:' || sample_id), sample_id) as r, count(*) over (partition by label) as c from one where status in ('known', 'unknown') and label != '')
select sample_id, label, c as available_n from k where r <= 20""")
def per_class_sample(spark, d):
    s = samples(spark, d).where("status in ('known', 'unknown') and label != ''")
    return splits.per_class_sample(s, "sample_id", "label", 20).select("sample_id", "label", "available_n")


@query(f"""with {ONE}, k as (select *, row_number() over (partition by label order by sha256('13:' || sample_id), sample_id) as r from one where status = 'known' and label != ''),
b as (select sample_id, label from k where r <= 200 // (select count(distinct label) from k)), x as (select sample_id, label from k where sample_id not in (select sample_id from b) order by sha256('13:' || sample_id), sample_id limit (200 - (select count(*) from b)))
select * from b union all select * from x""")
def balanced_sample(spark, d):
    s = samples(spark, d).where("status = 'known' and label != ''")
    return splits.balanced_fill(s, "sample_id", "label", 200).select("sample_id", "label")


@query(f"""with {ONE}, k as (select sample_id, split as old, case when r <= round_even(c * 0.7, 0) then 'train' when r <= round_even(c * 0.7, 0) + round_even(c * 0.15, 0) then 'validation' else 'test' end as new
  from (select *, row_number() over (partition by label order by sha256('13:' || sample_id), sample_id) as r, count(*) over (partition by label) as c from one where status = 'known' and label != ''))
select old, new, count(*) as n from k group by all""")
def split_comparison(spark, d):
    """Rows by present and recomputed split, from a one-to-one join on sample_id."""
    s = samples(spark, d).where("status = 'known' and label != ''")
    new = splits.stratified_split(s.drop("split"), "sample_id", "label", F.lit(True)).select("sample_id", F.col("split").alias("new"))
    return s.select("sample_id", F.col("split").alias("old")).join(new, "sample_id").groupBy("old", "new").agg(F.count("*").alias("n"))


@query(f"""with {M}, a as (select sample_id, width, height, row_number() over (partition by checksum order by path, sample_id, label nulls first, status nulls first, split, film, dataset nulls first, width nulls first, height nulls first) as r, checksum from m where checksum != '')
select checksum, sample_id, coalesce(width * height, -1) as pixels, coalesce(width <= 0 or height <= 0 or width is null or height is null, true) as bad_size from a where r = 1""")
def first_by_checksum(spark, d):
    w = Window.partitionBy("checksum").orderBy("path", "sample_id", "label", "status", "split", "film", "dataset", "width", "height")
    m = manifest(spark, d).where("checksum != ''").withColumn("r", F.row_number().over(w)).where("r = 1")
    bad = F.col("width").isNull() | F.col("height").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    return m.select("checksum", "sample_id", F.coalesce(F.col("width") * F.col("height"), F.lit(-1)).alias("pixels"), F.coalesce(bad, F.lit(True)).alias("bad_size"))
