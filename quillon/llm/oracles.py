"""DuckDB statements that give the same rows as the queries, written independently of them."""

from __future__ import annotations


def _t(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"


def _n(x: str) -> str:
    return rf"trim(regexp_replace({_t(x)}, '[ \-/\\._]+', '_', 'g'), '_')"


def _split(x: str) -> str:
    n = _n(x)
    return (
        f"case when {n} = 'train' then 'train' when {n} in ('validation', 'known_validation') then 'validation' "
        f"when {n} in ('test', 'known_test', 'unknown_test') then 'test' end"
    )


_MATCH = f"""
  select distinct {_t('left_image_id')} as l, {_t('right_image_id')} as r from raabin_duplicate_audit
  where {_t('left_image_id')} != '' and {_t('right_image_id')} != ''
    and {_t('left_image_id')} != {_t('right_image_id')} and hamming <= 4"""

_GROUPS = f"""
with recursive m as ({_MATCH}),
e as (select l as a, r as b from m union select r, l from m),
reach(id, other) as (select a, a from e union select reach.id, e.b from reach join e on reach.other = e.a),
g as (select id as image_id, min(other) as group_id from reach group by 1)"""

_BITS = f"regexp_replace({_t('average_hash')}, '^0x', '')"
_IMAGES = f"""
images as (
  select {_t('image_id')} as id, min({_split('split')}) as split, min({_t('source')}) as source,
    min(nullif({_t('sha256')}, '')) as sha,
    min(case when length({_BITS}) = 64 then {_BITS}
      when length({_BITS}) = 16 then array_to_string(list_transform(string_split({_BITS}, ''), lambda x:
        lpad(bin(cast(position(x in '0123456789abcdef') - 1 as integer)), 4, '0')), '') end) as h
  from raabin_image where {_t('image_id')} != '' group by 1)"""

_PAIRS = f"""
with m as ({_MATCH}), {_IMAGES},
either as (select l, r from m union select r, l from m),
pairs as (
  select a.id as train_id, b.id as eval_id, b.split as split, b.source as source,
    a.sha = b.sha as same_sha, hamming(a.h, b.h) as bits,
    exists (select 1 from either where l = a.id and r = b.id) as listed
  from images a, images b where a.split = 'train' and b.split in ('validation', 'test')),
found as (select * from pairs where coalesce(same_sha, false) or coalesce(bits <= 4, false) or listed)"""

_TARGETS = f"""
alias as (select {_n('alias')} as alias, min({_n('canonical_label')}) as name from label_alias group by 1),
target as (
  select plan_id, coalesce(name, {_n('t.canonical_label')}) as label, {_n('known_status')} as status,
    max(greatest(coalesce(min_rows, 0), cast(ceil(coalesce(target_fraction, 0) * coalesce(sample_size, 0) - 1e-9) as bigint))) as needed,
    max(greatest(coalesce(min_rows, 0), coalesce(target_fraction, 0) * coalesce(sample_size, 0))) as desired,
    max(coalesce(target_fraction, 0)) as fraction, max(coalesce(sample_size, 0)) as size
  from sampling_target t left join alias on alias.alias = {_n('t.canonical_label')} group by 1, 2, 3),
have as (
  select coalesce(name, {_n('s.canonical_label')}) as label, {_n('known_status')} as status, count(distinct sample_id) as available
  from sample_manifest s left join alias on alias.alias = {_n('s.canonical_label')} where trim(sample_id) != '' group by 1, 2)"""

_CUTS = f"""
with latest as (
  select * from (select *, row_number() over (partition by sample_id order by scored_at desc) as r from triage_signal where sample_id is not null) where r = 1),
record as (
  select coalesce({_t('dataset')}, '') as dataset, confidence, unknown_score from latest
  where {_split('split')} = 'validation' and {_n('known_or_unknown')} = 'known'),
score as (
  select dataset, 'confidence_only' as strategy, -confidence as x from record where confidence between 0 and 1 and not isnan(confidence)
  union all select dataset, 'confidence_margin_msp_qc', unknown_score from record where unknown_score between 0 and 1 and not isnan(unknown_score)),
value as (select dataset, strategy, x, count(*) as n_ties from score group by 1, 2, 3),
running as (
  select *, sum(n_ties) over (partition by dataset, strategy order by x) as n_kept,
    sum(n_ties) over (partition by dataset, strategy) as n_records from value),
point as (
  select distinct point_id, {_n('strategy')} as strategy, target_coverage as target from operating_point
  where target_coverage > 0 and target_coverage <= 1 and {_n('strategy')} in ('confidence_only', 'confidence_margin_msp_qc')),
first as (
  select point_id, point.strategy, target, dataset, min(x) as x from point join running using (strategy)
  where n_kept / n_records >= target group by 1, 2, 3, 4),
result as (
  select first.*, abs(first.x) as cutoff, cast(n_kept as bigint) as n_kept, n_ties, cast(n_records as bigint) as n_records
  from first join running using (dataset, strategy, x))"""

_RELATED = f"""
with recursive raw as (
  select sample_id, {_t('group_id')} as g, {_t('donor_id')} as d, {_split('split')} as split
  from triage_signal where sample_id is not null and config_id in (select config_id from split_config where {_n('method')} = 'group_stratified')),
edge as (
  select distinct 's' || sample_id as a, 'g' || g as b from raw where g not in ('', 'n/a', 'unknown')
  union select distinct 's' || sample_id, 'd' || d from raw where d not in ('', 'n/a', 'unknown')
  union select distinct 's' || sample_id, 's' || sample_id from raw),
e as (select a, b from edge union select b, a from edge),
label(node, low) using key (node) as (
  select a, min(b) from e group by a
  union
  select e.a, min(l.low) from e join label l on l.node = e.b join recurring.label own on own.node = e.a
  group by e.a, own.low having min(l.low) < own.low),
part as (select substr(node, 2) as sample_id, low from label where node like 's%')"""

ORACLES: dict[str, str] = {
    "p1_found": _GROUPS + " select image_id, group_id from g",
    "p1_image_groups": _GROUPS + f"""
select i.id as image_id, coalesce(g.group_id, i.id) as group_id
from (select distinct {_t('image_id')} as id from raabin_image where {_t('image_id')} != '') i left join g on g.image_id = i.id""",
    "p2_found": _PAIRS + " select least(train_id, eval_id) as image_id_a, greatest(train_id, eval_id) as image_id_b from found",
    "p2_report": _PAIRS.replace("a.sha = b.sha as same_sha,", "a.sha = b.sha as same_sha, a.h as train_h, b.h as eval_h,") + """,
piece(low, w) as (values (0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)),
cover as (
  select train_id, eval_id, case when coalesce(same_sha, false) then 64 when coalesce(bits <= 4, false) then
    (select sum(w) from piece where substr(train_h, 65 - low - w, w) = substr(eval_h, 65 - low - w, w)) end as covered,
    coalesce(same_sha, false) or coalesce(bits = 0, false) as exact from found),
one as (select eval_id, count(*) as k, count(*) filter (exact) as exact, max(covered) as most from cover group by 1)
select split, source, count(*) as n_images, count(k) as n_overlapping, coalesce(sum(k), 0)::bigint as n_pairs, coalesce(sum(exact), 0)::bigint as n_exact_pairs,
  coalesce(max(most), 0)::int as most_covered_bits
from images left join one on one.eval_id = images.id where split in ('validation', 'test') group by 1, 2""",
    "p3_found": _CUTS + " select point_id, dataset, cast(round(cutoff * 1000000) as bigint) as cutoff_ppm, n_kept from result",
    "p3_cutoffs": _CUTS + " select point_id, strategy, target, dataset, n_kept, n_ties, n_records, cutoff, n_kept / n_records as kept_share from result",
    "p4_found": f"""with {_TARGETS}
select plan_id, label as canonical_label from target left join have using (label, status) where coalesce(available, 0) < needed""",
    "p4_report": f"""with {_TARGETS},
counted as (select target.*, coalesce(available, 0) as available from target left join have using (label, status)),
unit as (
  select c.plan_id, m.sample_id, c.label, c.status, available - needed as slack, count(*) over (partition by c.plan_id, m.sample_id) as k
  from counted c join (select distinct sample_id, coalesce(name, {_n('s.canonical_label')}) as label, {_n('known_status')} as status
    from sample_manifest s left join alias on alias.alias = {_n('s.canonical_label')} where trim(sample_id) != '') m using (label, status)),
risk as (select *, count(*) filter (k > 1) over (partition by plan_id, label, status) as shared from unit),
drawn as (
  select plan_id, sample_id, arg_min({{'label': label, 'status': status}},
    {{'last': case when slack >= 0 and slack < shared then 0 else 1 end, 'slack': slack, 'label': label, 'status': status}}) as k from risk group by 1, 2),
own as (select plan_id, k.label as label, k.status as status, count(*) as n from drawn group by 1, 2, 3),
q as (select counted.*, coalesce(n, 0) as n, least(coalesce(n, 0), needed) as base from counted left join own using (plan_id, label, status)),
q2 as (
  select *, case when fraction > 0 then n - base else 0 end as spare,
    greatest(0, least(sum(needed - base) over (partition by plan_id), max(size) over (partition by plan_id) - sum(base) over (partition by plan_id))) as gap from q),
g as (
  select *, (gap - coalesce(sum(spare) over (partition by plan_id order by spare / fraction, label, status rows between unbounded preceding and 1 preceding), 0))
    / sum(fraction) over (partition by plan_id order by spare / fraction, label, status rows between current row and unbounded following) as level
  from q2 where spare > 0),
g2 as (select *, max(level) filter (spare >= fraction * level) over (partition by plan_id) as met from g),
g3 as (select *, sum(case when spare < fraction * level or met is null then spare else fraction * met end) over (partition by plan_id order by label, status) as upto from g2),
added as (
  select plan_id, label, status, floor(upto + 1e-6) - floor(coalesce(lag(upto) over (partition by plan_id order by label, status), 0) + 1e-6) as added from g3)
select plan_id, label, status, available, needed, desired, cast(base + coalesce(added, 0) as bigint) as selected,
  base + coalesce(added, 0) - desired as residual, available < needed as short
from q2 left join added using (plan_id, label, status)""",
    "p5_found": _RELATED + """,
bad as (select low from part join raw using (sample_id) group by low having count(distinct split) > 1)
select sample_id from part join bad using (low)""",
    "p5_splits": _RELATED + f""",
size as (
  select config_id, train_size, validation_size, coalesce(seed, 13) as seed from split_config
  where {_n('method')} = 'group_stratified' and abs(train_size + validation_size + test_size - 1) <= 1e-6),
name as (select low, min(sample_id) as component from part group by low),
kind as (
  select config_id, sample_id, max(coalesce({_n('known_or_unknown')} != 'known', false)) as unknown from triage_signal
  where sample_id is not null and config_id in (select config_id from size) group by 1, 2),
place as (select config_id, sample_id, component, unknown from kind join part using (sample_id) join name using (low)),
sets as (
  select config_id, component, count(*) filter (where not unknown) as known, max(unknown) as mixed from place group by 1, 2),
total as (
  select config_id, sum(known) as all_known, coalesce(sum(known) filter (where not mixed), 0) as free from sets group by 1),
pure as (
  select sets.*, sum(known) over (partition by config_id order by md5(component || '|' || seed), component) - known as before
  from sets join size using (config_id) where not mixed),
scaled as (
  select *, least(1.0::double, free / greatest((train_size + validation_size) * all_known, 1e-300)) as f
  from pure join total using (config_id) join size using (config_id)),
decided as (
  select config_id, component, case when before + known / 2 < train_size * all_known * f then 'train'
    when before + known / 2 < (train_size + validation_size) * all_known * f then 'validation' else 'test' end as split from scaled
  union all select config_id, component, 'test' from sets where mixed)
select config_id, sample_id, component, case when unknown then 'unknown' else 'known' end as status, split
from place join decided using (config_id, component)""",
    "p6_found": """
with v as (
  select sample_id, min(cast(embedding as double[])) as e from embedding_archive
  where sample_id is not null and len(embedding) = 96 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 96
    and len(list_filter(embedding, lambda x: x != 0)) > 0 group by 1),
sim as (
  select a.sample_id as a, b.sample_id as b, round(list_cosine_similarity(a.e, b.e), 12) as s
  from v a, v b where a.sample_id != b.sample_id and list_cosine_similarity(a.e, b.e) >= 0.9),
top as (select a, b, row_number() over (partition by a order by s desc, b) as r from sim)
select distinct least(a, b) as sample_id_a, greatest(a, b) as sample_id_b from top where r <= 5""",
}
