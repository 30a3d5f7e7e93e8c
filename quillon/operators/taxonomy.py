"""Known and unknown classes with the aliases that lead to them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label
from quillon.session import small_side


def normal(label: str) -> str:
    """N(x) of one label, as ``functions.text.normalize_label`` of a column."""
    return re.sub(r"[ \-/\\._]+", "_", label.strip().lower()).strip("_")


@dataclass(frozen=True)
class Taxonomy:
    """Classes after N; a class that is both known and unknown raises."""

    known: tuple[str, ...]
    unknown: tuple[str, ...] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "known", tuple(normal(x) for x in self.known))
        object.__setattr__(self, "unknown", tuple(normal(x) for x in self.unknown))
        object.__setattr__(self, "aliases", {normal(k): normal(v) for k, v in self.aliases.items()})
        both = sorted(set(self.known) & set(self.unknown))
        if both:
            raise ValueError(f"classes both known and unknown: {', '.join(both)}")

    @classmethod
    def from_mapping(cls, config: Mapping) -> Taxonomy:
        """From ``known_classes``, ``unknown_classes`` (a name or a list) and ``aliases``."""
        names = lambda v: (v,) if isinstance(v, str) else tuple(str(x) for x in v or ())
        return cls(names(config.get("known_classes")), names(config.get("unknown_classes")), dict(config.get("aliases") or {}))

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Taxonomy:
        """From a YAML file at any path that Spark reads."""
        return cls.from_mapping(read_yaml(spark, path))

    def canonical(self, label: Column) -> Column:
        """The label after N and alias. Aliases are part of the plan; for large tables see ``canonical_labels``."""
        n = normalize_label(label)
        if not self.aliases:
            return n
        pairs = [F.lit(x) for kv in self.aliases.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), n), n)

    def status(self, label: Column) -> Column:
        """``known`` if the canonical label is a known class, else ``unknown``; null labels are unknown."""
        return F.when(self.canonical(label).isin(*self.known), "known").otherwise("unknown")

    def checked(self, label: Column) -> Column:
        """The canonical label; one that is no known class raises."""
        c = self.canonical(label)
        return F.when(c.isin(*self.known), c).otherwise(F.raise_error(F.concat(F.lit("not a known class: "), F.coalesce(label, F.lit("null")))))


def canonical_labels(df: DataFrame, label: str, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """``df`` with ``out``: the label after N and the alias table (alias, canonical_label); of several targets the least."""
    names = aliases.groupBy(normalize_label(F.col("alias")).alias("__alias")).agg(F.min(normalize_label(F.col("canonical_label"))).alias("__name"))
    joined = df.withColumn("__raw", normalize_label(F.col(label))).join(small_side(names), F.col("__raw") == F.col("__alias"), "left")
    return joined.withColumn(out, F.coalesce("__name", "__raw")).drop("__raw", "__alias", "__name")


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML mapping of scalars, lists and mappings; anything but a mapping raises."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = _plain_yaml(text)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping in {path}")
    return value


def _plain_yaml(text: str) -> dict:
    """Nested ``key: value`` lines and ``- item`` lists, for boxes without a YAML library."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    scalar = lambda v: v.strip("'\"")

    def block(at: int, depth: int) -> tuple[Sequence | dict, int]:
        out: list | dict = [] if rows[at][1].startswith("-") else {}
        while at < len(rows) and rows[at][0] >= depth:
            line = rows[at][1]
            at += 1
            if isinstance(out, list):
                out.append(scalar(line[1:].strip()))
                continue
            key, _, value = line.partition(":")
            nested = at < len(rows) and (rows[at][0] > depth or rows[at][1].startswith("-") and rows[at][0] == depth)
            if value.strip() or not nested:
                value = value.strip()
                out[scalar(key.strip())] = [scalar(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else scalar(value)
            else:
                out[scalar(key.strip())], at = block(at, rows[at][0])
        return out, at

    return block(0, rows[0][0])[0] if rows else {}
