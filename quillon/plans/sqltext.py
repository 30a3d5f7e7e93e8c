"""Text pieces shared by the oracle statements."""

from __future__ import annotations


def t(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"


def n(x: str) -> str:
    return rf"trim(regexp_replace({t(x)}, '[ \-/\\._]+', '_', 'g'), '_')"


def split(x: str) -> str:
    y = n(x)
    return (
        f"case when {y} = 'train' then 'train' when {y} in ('validation', 'known_validation') then 'validation' "
        f"when {y} in ('test', 'known_test', 'unknown_test') then 'test' end"
    )


def finite(a: str, size: int) -> str:
    return f"len({a}) = {size} and len(list_filter({a}, lambda x: x is not null and isfinite(x))) = {size}"


ARCHIVE = f"""archive as (
  select distinct sample_id, {n('true_label')} as label, {n('known_status')} as status, {split('split')} as split,
    cast(embedding as double[]) as e, cast(logits as double[]) as z
  from embedding_archive
  where sample_id is not null and true_label is not null and {finite('embedding', 96)} and {finite('logits', 5)}
    and {n('known_status')} in ('known', 'unknown') and {split('split')} is not null)"""
