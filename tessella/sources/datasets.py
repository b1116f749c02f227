"""Image data sets as frames of (image_id, image_path, label_path, row_idx), in the order of their paths.

Only paths are read: the scan has an empty read schema. Decoding, training and neural features stay outside; their
outputs, vectors and class ids, are this engine's inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.lineage import ranked

CAMVID_SPLITS = {"train": "train", "val": "val", "test": "test"}
#: Class names of the street-scene data set, by training id.
STREET_CLASSES = (
    "road", "sidewalk", "building", "wall", "fence", "pole", "traffic light", "traffic sign", "vegetation", "terrain",
    "sky", "person", "rider", "car", "truck", "bus", "train", "motorcycle", "bicycle",
)


#: Class names of the driving-video data set, by label.
VIDEO_CLASSES = ("sky", "building", "pole", "road", "pavement", "tree", "sign_symbol", "fence", "car", "pedestrian", "bicyclist")


def listed(spark: SparkSession, root: str, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(f"{root}/{folder}").select(F.col("path").alias("image_path"))


def numbered(rows: DataFrame) -> DataFrame:
    return ranked(rows, [F.asc("image_path")], "row_idx").withColumn("row_idx", F.col("row_idx") - 1)


def cityscapes(spark: SparkSession, root: str, split: str) -> DataFrame:
    rows = listed(spark, root, f"leftImg8bit/{split}", "*_leftImg8bit.png")
    image_id = F.regexp_extract("image_path", r"([^/]+)_leftImg8bit\.png$", 1)
    label = F.regexp_replace(F.regexp_replace("image_path", "/leftImg8bit/", "/gtFine/"), r"_leftImg8bit\.png$", "_gtFine_labelIds.png")
    return numbered(rows.select(image_id.alias("image_id"), "image_path", label.alias("label_path")))


def ade20k(spark: SparkSession, root: str, split: str) -> DataFrame:
    rows = listed(spark, root, f"images/{split}", "*.jpg")
    label = F.regexp_replace(F.regexp_replace("image_path", "/images/", "/annotations/"), r"\.jpg$", ".png")
    return numbered(rows.select(F.regexp_extract("image_path", r"([^/]+)\.jpg$", 1).alias("image_id"), "image_path", label.alias("label_path")))


def camvid(spark: SparkSession, root: str, split: str) -> DataFrame:
    folder = CAMVID_SPLITS[split]
    rows = listed(spark, root, folder, "*.png")
    label = F.regexp_replace("image_path", f"/{folder}/", f"/{folder}annot/")
    return numbered(rows.select(F.regexp_extract("image_path", r"([^/]+)\.png$", 1).alias("image_id"), "image_path", label.alias("label_path")))


DATASETS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {"cityscapes": cityscapes, "ade20k": ade20k, "camvid": camvid}


def dataset(spark: SparkSession, name: str, root: str, split: str, subset: DataFrame | None = None) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; there are {sorted(DATASETS)}")
    rows = DATASETS[name](spark, root, split)
    return rows if subset is None else restricted(rows, subset)


def restricted(rows: DataFrame, subset: DataFrame) -> DataFrame:
    """The rows of a subset's ids; an id that is not in the pool is an error."""
    unknown = subset.select("image_id").join(rows.select("image_id"), "image_id", "left_anti")
    some = [r[0] for r in unknown.orderBy("image_id").limit(3).collect()]
    if some:
        raise ValueError(f"{unknown.count()} subset ids are not in the pool, such as {some}")
    return rows.join(subset.select("image_id").distinct(), "image_id", "left_semi")


def class_names(spark: SparkSession, path: str, classes: int = 150) -> list[str]:
    """First synonyms of a tab-separated class table's last column, or class_i."""
    try:
        rows = spark.read.csv(path, sep="\t", header=True)
        names = [r[0] for r in rows.select(F.trim(F.split(F.col(rows.columns[-1]), ",")[0])).limit(classes).collect() if r[0]]
    except Exception as error:  # a missing file gives the fallback; anything else is raised
        if "PATH_NOT_FOUND" not in str(error):
            raise
        names = []
    return names or [f"class_{i}" for i in range(classes)]
