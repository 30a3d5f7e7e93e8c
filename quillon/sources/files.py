"""Scans of images, tables, nested records and annotations, with explicit schemas."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.functions.text import normalize_label, strip
from quillon.operators.taxonomy import Taxonomy

# Image file extensions, words for true, and manifest columns.
EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
TRUE_WORDS = ("1", "true", "yes", "y")
MANIFEST_SCHEMA = (
    "sample_id string, path string, dataset string, original_label string, canonical_label string, known_status string, "
    "split string, group_id string, checksum string, width int, height int"
)
SIGNAL_SCHEMA = (
    "sample_id string, split string, known_or_unknown string, confidence string, margin string, unknown_score string, "
    "quality_pass string, correct_if_known string"
)
CELLS = "map<string,struct<label:string,x1:string,y1:string,x2:string,y2:string>>"


def image_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, length[, content]) of the image files under ``root``, by extension in any case."""
    glob = "*.{" + ",".join(f"{e},{e.upper()}" for e in EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", *(["content"] if with_content else []))


def _png(b: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", b[16:24]) if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24 else None


def _bmp(b: bytes) -> tuple[int, int] | None:
    if b[:2] != b"BM" or len(b) < 26:
        return None
    w, h = struct.unpack("<ii", b[18:26])
    return w, abs(h)


def _jpeg(b: bytes) -> tuple[int, int] | None:
    """Walks the segments to the frame header, whose marker is C0 to CF but for C4, C8 and CC."""
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _tiff(b: bytes) -> tuple[int, int] | None:
    """Reads tags 256 and 257 of the first directory."""
    if b[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(order + "I", b[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        tag, kind = struct.unpack(order + "HH", b[at + 2 + 12 * k : at + 6 + 12 * k])
        if tag in (256, 257):
            value = b[at + 10 + 12 * k : at + 14 + 12 * k]
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, BMP, JPEG or TIFF; None where there is none. No pixel is decoded."""
    for read in (_png, _bmp, _jpeg, _tiff):
        try:
            size = read(content or b"")
        except (struct.error, IndexError):
            size = None
        if size:
            return size
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_sizes(content: pd.Series) -> pd.DataFrame:
    sizes = [image_size(c) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


def build_manifest(spark: SparkSession, root: str, dataset: str, group_depth: int | None = None, taxonomy: Taxonomy | None = None, strict: bool = False) -> DataFrame:
    """One row a file with all manifest columns, ready for ``save_manifest``.

    The label is the first folder, the group the folder at ``group_depth``, the checksum
    that of the bytes, the id a hash of dataset, path and checksum; canonical label and
    status follow the taxonomy (without one, N and null), the split is open (''). Width and
    height come from the file's header; where it has none they are null, or raise with
    ``strict``. Each file is read once, where it lies; there is no shuffle.
    """
    base = root.rstrip("/")
    rel = F.regexp_replace(F.expr("split_part(path, ':', -1)"), f"^/*{base.lstrip('/')}/", "")
    parts = F.split(rel, "/")
    group = F.coalesce(F.get(parts, group_depth), F.lit("")) if group_depth is not None else F.lit("")
    f = image_files(spark, root, True).select(rel.alias("path"), F.sha2("content", 256).alias("checksum"), F.get(parts, 0).alias("original_label"), group.alias("group_id"), image_sizes("content").alias("size"))
    key, label = F.concat_ws(":", F.lit(dataset), "path", "checksum"), F.col("original_label")
    unread = F.raise_error(F.concat(F.lit("no image size in "), F.col("path"))).cast("int")
    side = lambda c: F.coalesce(F.col(f"size.{c}"), unread) if strict else F.col(f"size.{c}")
    return f.select(
        F.substring(F.sha1(key), 1, 20).alias("sample_id"), "path", F.lit(dataset).alias("dataset"), "original_label",
        (taxonomy.canonical(label) if taxonomy else normalize_label(label)).alias("canonical_label"), (taxonomy.status(label) if taxonomy else F.lit(None).cast("string")).alias("known_status"),
        F.lit("").alias("split"), "group_id", "checksum", side("width").alias("width"), side("height").alias("height"),
    )


def training_rows(manifest: DataFrame, split: str, with_unknown: bool = False) -> DataFrame:
    """The rows of one split, known ones only unless told otherwise, in the order of their ids within a partition."""
    rows = manifest.where(F.col("split") == split)
    return (rows if with_unknown else rows.where(F.col("known_status") == "known")).repartitionByRange("sample_id").sortWithinPartitions("sample_id")


def synthetic_manifest(spark: SparkSession, n: int, known: tuple[str, ...], unknown: tuple[str, ...] = (), seed: int = 13) -> DataFrame:
    """``n`` made-up manifest rows, the same for the same seed: labels, groups and sizes from hashes of the row number."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    labels = F.array(*[F.lit(x) for x in (*known, *unknown)])
    place = (h(1) % (len(known) + len(unknown))).cast("int")
    rows = spark.range(n).withColumn("place", place).withColumn("label", F.get(labels, F.col("place")))
    path = F.concat_ws("/", "label", F.concat(F.lit("g"), h(2) % 50), F.concat(F.format_string("%08d", "id"), F.lit(".png")))
    return rows.select(
        F.substring(F.sha1(F.concat_ws(":", F.lit(seed), "id")), 1, 20).alias("sample_id"), path.alias("path"), F.lit("synthetic").alias("dataset"), F.col("label").alias("original_label"),
        normalize_label(F.col("label")).alias("canonical_label"), F.when(F.col("place") < len(known), "known").otherwise("unknown").alias("known_status"), F.lit("").alias("split"),
        F.concat(F.lit("g"), h(2) % 50).alias("group_id"), F.sha2(F.concat_ws("|", "id", F.lit(seed)), 256).alias("checksum"), (64 + h(3) % 64).cast("int").alias("width"), (64 + h(4) % 64).cast("int").alias("height"),
    )


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header under an explicit schema, so nothing is read to infer one."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=False)


def parse_flag(c: Column) -> Column:
    """True for the words of truth, null for blank, false otherwise."""
    t = F.lower(strip(c))
    return F.when(t != "", t.isin(*TRUE_WORDS))


def signal_records(spark: SparkSession, path: str) -> DataFrame:
    """Signals from CSV: numbers parsed or null, flags by word, a blank outcome null."""
    raw = csv_table(spark, path, SIGNAL_SCHEMA)
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    return raw.select(
        "sample_id", "split", "known_or_unknown", number("confidence"), number("margin"), number("unknown_score"),
        F.coalesce(parse_flag(F.col("quality_pass")), F.lit(False)).alias("quality_pass"), parse_flag(F.col("correct_if_known")).alias("correct_if_known"),
    )


def annotation_lines(lines: DataFrame) -> DataFrame:
    """(path, label, first, second) from white-space separated ``value`` lines; missing fields are 'nan'."""
    parts = F.split(strip(F.col("value")), r"\s+")
    field = lambda i, name: F.coalesce(F.get(parts, i), F.lit("nan")).alias(name)
    return lines.where(strip(F.col("value")) != "").select(F.get(parts, 0).alias("path"), field(1, "label"), field(2, "first"), field(3, "second"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines of a text file, or of the members of zip archives that end in ``.dat``.

    Archives are opened in the task that reads them; members with unsafe paths are skipped.
    """
    if not path.endswith(".zip"):
        return annotation_lines(spark.read.text(path))

    def members(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        clean = posixpath.normpath(name)
                        if name.endswith(".dat") and not clean.startswith(("/", "..")):
                            yield pd.DataFrame({"value": z.read(name).decode("utf-8", "replace").splitlines()})

    files = spark.read.format("binaryFile").load(path).select("content")
    return annotation_lines(files.mapInPandas(members, "value string"))


def cell_records(spark: SparkSession, path: str, prefix: str = "Cell_") -> DataFrame:
    """(image_id, cell, label, x_min, y_min, x_max, y_max) from one JSON document a file.

    Cells are the keys that start with ``prefix``; boxes that do not parse are null.
    """
    docs = spark.read.text(path, wholetext=True).withColumn("image_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    cells = F.from_json("value", CELLS)
    rows = docs.select("image_id", F.explode(cells).alias("cell", "c")).where(F.col("cell").startswith(prefix))
    number = lambda c, out: F.expr(f"try_cast(c.{c} as double)").alias(out)
    return rows.select("image_id", "cell", F.col("c.label").alias("label"), number("x1", "x_min"), number("y1", "y_min"), number("x2", "x_max"), number("y2", "y_max"))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, under an explicit schema."""
    return spark.read.json(path, schema=schema, multiLine=True)
