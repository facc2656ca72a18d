"""Catalogs of image files, manifests, paged rows and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import path_id, seed_hex
from ..operators import images

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("image_id", "relative_path", "source_split", "role")] + [T.StructField("label", T.IntegerType()), T.StructField("class_name", T.StringType())])
PAGE = "num_rows_total long, rows array<struct<row_idx:long,row:struct<label:int,img_id:string,image:struct<src:string>>>>"
IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|webp)$"


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a root; the content column is pruned, so no file is opened."""
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = root.removeprefix("file:").rstrip("/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace(full, f"^{base}/", "").alias("relative_path")).where(F.col("relative_path").rlike(IMAGE_NAME))


def _named(path: Column, label: Column, split: Column, role: Column) -> list[Column]:
    return [path_id(path).alias("image_id"), path.alias("relative_path"), split.alias("source_split"), role.alias("role"), label.cast("int").alias("label"), F.when(label == 1, "FAKE").otherwise("REAL").alias("class_name")]


def catalog_labeled_images(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Images of split/REAL and split/FAKE; a class without images is an error."""
    path = F.col("relative_path")
    found = _files(spark, f"{root}/{split}").withColumn("class", F.split(path, "/")[0]).where("class in ('REAL', 'FAKE')").withColumn("relative_path", F.concat(F.lit(f"{split}/"), path))
    missing = {"REAL", "FAKE"} - {r[0] for r in found.select("class").distinct().collect()}
    if missing:
        raise ValueError(f"no images of class {sorted(missing)} in {split}")
    return found.select(*_named(path, (F.col("class") == "FAKE").cast("int"), F.lit(split), F.lit(split)))


def catalog_challenge_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Images of several roots, labeled by any folder named FAKE or REAL (FAKE wins); others are dropped."""
    out = None
    for root in roots:
        parts = F.transform(F.split("relative_path", "/"), lambda x: F.upper(x))
        label = F.when(F.array_contains(parts, "FAKE"), 1).when(F.array_contains(parts, "REAL"), 0)
        one = _files(spark, root).withColumn("root", F.lit(root)).withColumn("label", label).where("label is not null")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("image_id", path_id(F.concat_ws("/", "root", "relative_path")))


def catalog_unlabeled_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): images that can be decoded, with label -1, and files that cannot, with a reason."""
    files = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).option("pathGlobFilter", "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}").load(root)
    path = F.regexp_replace("image.origin", "^[a-z]+:/*", "/")
    good = files.where("image.height > 0").select(path.alias("image_path"), path_id(path).alias("image_id"), F.lit(-1).alias("label"), F.lit("UNKNOWN").alias("class_name"), "image")
    return good, files.where("image.height <= 0").select(path.alias("image_path"), F.lit("not decodable").alias("reason"))


def decoded_pixels(good: DataFrame) -> DataFrame:
    """image_id, image_path, height, width and RGB pixels; Spark's reader gives BGR."""

    @F.pandas_udf("binary")
    def rgb(data, channels):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        out = []
        for d, c in zip(data, channels, strict=True):
            x = np.frombuffer(d, dtype=np.uint8).reshape(-1, c)
            out.append((np.repeat(x, 3, 1) if c == 1 else x[:, 2::-1]).tobytes())
        return pd.Series(out)

    return good.select("image_id", "image_path", F.col("image.height").alias("height"), F.col("image.width").alias("width"), rgb("image.data", "image.nChannels").alias("pixels"))


def upright_pixels(spark: SparkSession, root: str) -> DataFrame:
    """``decoded_pixels`` of all images below a root, turned as the Exif part of each file's head tells."""
    good, _ = catalog_unlabeled_images(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(IMAGE_NAME))
    told = images.orientations(files).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("image_path"), "orientation")
    return images.turn_upright(decoded_pixels(good).join(told, "image_path", "left"))


def validate_decode_sample(manifest: DataFrame, root: str, n: int, seed: int) -> None:
    """Decode a seeded sample of the manifest's images; an error names those that cannot be read."""
    sample = manifest.select("relative_path").orderBy(seed_hex(seed, F.col("relative_path")), "relative_path").limit(n)
    paths = [f"{root.rstrip('/')}/{r[0]}" for r in sample.collect()]  # n paths
    if paths:
        images = manifest.sparkSession.read.format("image").option("dropInvalid", False).load(paths)
        bad = [r[0] for r in images.where("image.height <= 0").select("image.origin").limit(3).collect()]
        if bad:
            raise ValueError(f"images cannot be decoded, such as {bad}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV manifest; an empty one is an error."""
    rows = spark.read.schema(MANIFEST).option("header", True).csv(path)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return rows


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select([f.name for f in MANIFEST]).write.option("header", True).csv(path)


def read_source_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, row_idx, label, img_id, src of paged JSON rows."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    return pages.select("page", F.explode("rows").alias("r")).select("page", "r.row_idx", "r.row.label", "r.row.img_id", F.col("r.row.image.src").alias("src"))


def read_image_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)
