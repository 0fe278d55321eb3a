"""File sources and sinks: listings, reference images, tables, texts, annotations; all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")


def listing(
    spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, recurse: bool = True,
    include: tuple[str, ...] | None = None,
) -> DataFrame:
    """path and name of the files below a folder, hidden ones left out; ``include`` names folders of the first level."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(path)
    full = F.regexp_replace("path", "^file:/*", "/")
    root = path.removeprefix("file://").rstrip("/")
    rest = F.substring(full, len(root) + 2, 1_000_000)
    files = found.select(full.alias("path"), rest.alias("_rest"), F.element_at(F.split("path", "/"), -1).alias("name"))
    files = files.where(~F.col("_rest").rlike(r"(^|/)\."))
    if extensions:
        files = files.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    if include:
        files = files.where(F.get(F.split("_rest", "/"), F.lit(0)).isin(*include))
    return files.select("path", "name")


def reference_number(name: Column) -> Column:
    """Digits between the last underscore and the first dot of a name."""
    return F.regexp_extract(F.get(F.split(name, r"\."), F.lit(0)), r"_(\d+)$", 1).cast("long")


def is_reference(name: Column) -> Column:
    """Whether a name is that of a reference image."""
    return name.rlike(r"^ref_\d+\.(?i:" + "|".join(IMAGES) + ")$")


def references(spark: SparkSession, path: str) -> DataFrame:
    """n and path of a folder's reference images."""
    files = listing(spark, path, IMAGES, recurse=False).where(is_reference(F.col("name")))
    return files.select(reference_number(F.col("name")).alias("n"), "path")


def presorted(files: DataFrame, path: str = "path") -> DataFrame:
    """Files by path, its separators taken as dots."""
    return files.orderBy(F.translate(path, "\\/", ".."))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; a null in one of them is an error when the rows are read."""
    out = []
    for c in columns:
        ok = F.assert_true(F.col(c).isNotNull(), f"{c} has nulls")
        out.append(F.when(ok.isNull(), F.col(c)).alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], delimiter: str = ",", header: bool = True) -> DataFrame:
    """Named columns of a CSV file, without nulls."""
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=True)
    return require(df, *columns)


def image_paths(df: DataFrame, name: str, folder: str = "", suffix: str = "") -> Column:
    """folder/name+suffix."""
    joined = F.concat(F.col(name).cast("string"), F.lit(suffix))
    return F.concat_ws("/", F.lit(folder), joined) if folder else joined


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each text file, paths as ``listing`` has them."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_replace(plain, "^file:/*", "/").alias("path"), F.col("value").alias("text")
    )


def annotations(spark: SparkSession, path: str, prefix: str = "", lines: bool = False) -> DataFrame:
    """file_name, boxes ([top, left, bottom, right]) and classes of each annotated image of COCO documents.

    A folder may hold many documents, one a file or, with ``lines``, one a line; they share the numbers of images and
    categories. Only images that are annotated are listed, their boxes in the order of the documents.
    """
    schema = (
        "images array<struct<id:bigint,file_name:string>>, "
        "annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, "
        "categories array<struct<id:bigint,name:string>>"
    )
    whole = spark.read.schema(schema).json(path, multiLine=not lines).withColumn("file", F.col("_metadata.file_path"))
    images = whole.select(F.explode("images").alias("x")).select(F.col("x.id").alias("image_id"), "x.file_name")
    images = images.dropDuplicates(["image_id"])
    kinds = whole.select(F.explode("categories").alias("x")).select(F.col("x.id").alias("category_id"), "x.name").distinct()
    marks = whole.select("file", F.posexplode("annotations").alias("pos", "x")).select("file", "pos", "x.*").join(kinds, "category_id")
    b = F.col("bbox")
    box = F.array(b[1], b[0], b[3] + b[1], b[2] + b[0])
    grouped = marks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("file", "pos", box.alias("box"), "name"))).alias("m"))
    return images.join(grouped, "image_id").select(
        F.concat(F.lit(prefix), "file_name").alias("file_name"), F.col("m.box").alias("boxes"), F.col("m.name").alias("classes")
    )


def ratings(df: DataFrame, user: str | None = None, item: str | None = None, rating: str | None = None) -> DataFrame:
    """user, item and rating: by name, or the first three columns."""
    names = [user or df.columns[0], item or df.columns[1], rating or df.columns[2]]
    return df.select(*[F.col(n).alias(a) for n, a in zip(names, ("user", "item", "rating"))])


def write_pairs(df: DataFrame, x: str, y: str, path: str) -> None:
    """Two columns as CSV."""
    df.select(F.col(x).alias("x"), F.col(y).alias("y")).write.mode("overwrite").csv(path, header=True)


def write_lines(df: DataFrame, x: str, path: str) -> None:
    """One item a line."""
    df.select(F.col(x).cast("string")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of a training log: whole numbers as they are, nulls as ``#na#``, others with six places."""
    shown = []
    for name, kind in df.dtypes:
        value = F.col(name).cast("string") if kind not in ("float", "double") else F.format_string("%.6f", F.col(name))
        shown.append(F.when(F.col(name).isNull(), "#na#").otherwise(value).alias(name))
    df.select(*shown).write.mode("append").csv(path)


def new_only(df: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """Rows whose name isn't there yet."""
    return df.join(existing.select(name), name, "left_anti")


def frame_folders(spark: SparkSession, path: str, pattern: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """video, n, name and path of the frames of a folder of folders.

    ``pattern`` has the video and the frame's name as its groups; n counts a video's frames in the order of names.
    """
    found = listing(spark, path, extensions)
    named = found.select(F.regexp_extract("path", pattern, 1).alias("video"), F.regexp_extract("path", pattern, 2).alias("name"), "path")
    order = Window.partitionBy("video").orderBy("name", "path")
    return named.where("video != ''").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
