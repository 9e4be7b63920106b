"""How the given tables play the parts of samples, logs, registries and file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.folds import assign_folds
from tallyfold.operators.keys import lookup_candidate
from tallyfold.sources.files import write_files
from tallyfold.sources.run_log import read_log
from tallyfold.sources.shared import shared_folder

FOLDS = 5
STATUSES = ("F", "O", "P")
FLAGS = ("A", "N", "R")
VECTOR_CLASSES = 10
DIMENSIONS = 64
MANY = 87
QUALITY_CLASSES = 2
BLOCKS = tuple(f"block{b}" for b in range(4))
SEEDS = (0, 1, 2)
WHOLE = -1
SMALL_SCAN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """Give work that is heavy per row on a small table one task per core. A table that
    is read by as many tasks, or by SMALL_SCAN, is left alone."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < min(tasks, SMALL_SCAN)
    return df.repartition(tasks, key) if few else df


def orders(spark: SparkSession, sf_dir: str, seed: str = "") -> DataFrame:
    """id, y, coarse, key, fold. Folds go by customer, keys by priority and month."""
    rows = spread_out(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey"
        ),
        "o_orderkey",
    ).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("y"),
        F.col("o_orderpriority").alias("coarse"),
        F.concat_ws(
            "|", "o_orderpriority", F.year("o_orderdate") * 100 + F.month("o_orderdate")
        ).alias("key"),
        "o_custkey",
    )
    return assign_folds(rows, FOLDS, ["o_custkey"], seed).drop("o_custkey")


def order_predictions(spark: SparkSession, sf_dir: str, key: str = "key") -> DataFrame:
    return lookup_candidate(orders(spark, sf_dir), key, "y", "fold", STATUSES, "id", FOLDS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, key, fold of line items. Folds go by order, keys by size and discount."""
    rows = spread_out(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_returnflag", "l_quantity", "l_discount"
        ),
        "l_orderkey",
    ).select(
        F.col("l_orderkey").alias("id"),
        F.col("l_returnflag").alias("y"),
        F.concat_ws(
            "|",
            F.col("l_quantity").cast("int"),
            F.round(F.col("l_discount") * 100).cast("int"),
        ).alias("key"),
    )
    return assign_folds(rows, FOLDS, ["id"])


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_candidate(lines(spark, sf_dir), "key", "y", "fold", FLAGS, "id", FOLDS)


def texts(spark: SparkSession, sf_dir: str, *extra: str | Column) -> DataFrame:
    """id, text of documents, and more of their columns."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), "text", *extra)


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, y (quality, null where unlabelled), fold by content."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y")
    )
    rows = spread_out(texts(spark, sf_dir), "id").join(labels, "id", "left")
    return assign_folds(rows, FOLDS, ["text"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x, fold."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").alias("x")
    )
    return assign_folds(spread_out(rows, "id"), FOLDS, ["id"])


def block_candidates(seeds: Sequence[int] = SEEDS) -> list[tuple[str, int, list[int]]]:
    """Four candidates that each see 16 of the 64 dimensions; a seed leaves out a
    quarter of them, WHOLE none."""
    return [
        (name, s, [d for d in range(16 * b, 16 * b + 16) if s == WHOLE or (d + s) % 4 != 0])
        for b, name in enumerate(BLOCKS)
        for s in seeds
    ]


def seeded_candidates() -> list[tuple[str, int, list[int]]]:
    """One candidate that sees all dimensions; a seed leaves out a quarter of them."""
    return [("all", s, [d for d in range(64) if (d + s) % 4 != 0]) for s in SEEDS]


def many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, key, fold of line items; y has MANY classes."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_discount"
    )
    rows = spread_out(rows, "l_orderkey").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_suppkey") % MANY).cast("int").alias("y"),
        F.concat_ws(
            "|",
            F.col("l_quantity").cast("int"),
            F.round(F.col("l_discount") * 100).cast("int"),
        ).alias("key"),
    )
    return assign_folds(rows, FOLDS, ["id"])


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x: the class is the side of a plane, which models can learn."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("x")
    )
    side = F.get("x", F.lit(0)) + F.get("x", F.lit(1)) > 0
    return spread_out(rows.withColumn("y", side.cast("int")), "id")


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x, fold: the class is the largest of ten dimensions from all blocks, which
    candidates that see one block can learn in part."""
    rows = vectors(spark, sf_dir)
    ten = [F.get("x", F.lit(7 * c)) for c in range(VECTOR_CLASSES)]
    return rows.withColumn("y", (F.array_position(F.array(*ten), F.greatest(*ten)) - 1).cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a tree of files, some hidden; returns its root."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(
        F.element_at(F.array(F.lit("_"), F.lit("."), F.lit("a ")), (F.col("doc_id") % 3 + 1).cast("int")),
        F.col("doc_id").cast("string"),
    )
    path = F.concat_ws("/", F.concat(F.lit("_"), F.col("lang")), "source", name)
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    root = shared_folder(spark)
    write_files(docs.select(path.alias("path"), content.alias("content")), root)
    return root


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _version(date: Column) -> Column:
    return F.concat(
        F.lit("v"), F.year(date) - 1990, F.lit("."), F.month(date)
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, metric, version, logged_at, score: one entry per order."""
    version = _version(F.col("o_orderdate"))
    return spread_out(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.concat(F.lit("p"), F.col("o_custkey")).alias("project"),
        F.when(F.col("o_orderstatus") == "F", "local")
        .when(F.col("o_orderstatus") == "O", "platform")
        .otherwise("smoke")
        .alias("metric"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "original")
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(version, F.lit("_fix")))
        .otherwise(version)
        .alias("version"),
        F.col("o_orderdate").alias("logged_at"),
        (F.col("o_totalprice") / 1e6).alias("score"),
    )


def run_log(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """line: a written and reread log with a line per order (of one status); the
    priority decides the layout."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    head = F.concat(F.lit("p"), F.col("o_custkey"), F.lit(" "), _version(F.col("o_orderdate")))
    score = F.concat(F.lit("0."), F.lpad(F.floor("o_totalprice").cast("string"), 6, "0"))
    chosen = F.lower("o_orderstatus")
    line = (
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.lit("- "), day, F.lit("："), head, F.lit(" done, macro_f1="), score, F.lit(".")),
        )
        .when(
            F.col("o_orderpriority") == "2-HIGH",
            F.concat(
                F.lit("["), day, F.lit(" 06:05:04] "), head, F.lit(" trial over; selected="),
                chosen, F.lit("; macro_f1="), score, F.lit(", accuracy=0.5, archived."),
            ),
        )
        .when(
            F.col("o_orderpriority") == "3-MEDIUM",
            F.concat(
                F.lit("- "), day, F.lit(" 21:22:23 "), head, F.lit("; selected="), chosen,
                F.lit("; macro_f1=0.1; macro_f1="), score,
            ),
        )
        .when(
            F.col("o_orderpriority") == "5-LOW",
            F.concat(
                F.lit("| p"), F.col("o_custkey"), F.lit(" | "), _version(F.col("o_orderdate")),
                F.lit(" | macro_f1="), score, F.lit(" | log |"),
            ),
        )
        .otherwise(F.concat(F.lit("- "), day, F.lit("：nothing to report")))
    )
    rows = table(spark, sf_dir, "orders")
    if status:
        rows = rows.filter(F.col("o_orderstatus") == status)
    path = shared_folder(spark)
    rows.select(line.alias("line")).write.text(path)
    return read_log(spark, path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iteration records: one per document, with gaps where it has no labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.lit("2024-01-31").alias("date"),
        F.col("source").alias("project"),
        F.concat(F.lit("v"), F.col("quality"), F.lit("."), F.col("toxic")).alias("version"),
        F.col("lang").alias("archive_path"),
        F.when(F.col("quality") == 0, " ").otherwise(F.lit("model.bin")).alias("model_file"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.lit("out.csv")).alias("result_file"),
        F.when(F.col("quality").isNotNull(), "yes").alias("root_clean"),
        F.col("text").alias("note"),
    )


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, flag: a result file per line item."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber"
    )
    return spread_out(rows, "l_orderkey").select(
        F.concat(F.lit("p"), F.col("l_suppkey")).alias("project"),
        F.concat(
            F.lit("results/"),
            F.when(F.col("l_returnflag") == "R", "smoke_").otherwise(""),
            F.lit("submission_"), F.col("l_orderkey"), F.lit("_v1."), F.col("l_linenumber"),
            F.lit(".csv"),
        ).alias("path"),
        F.concat(F.lit("v1."), F.col("l_linenumber")).alias("version"),
        F.col("l_returnflag").alias("flag"),
    )


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests: documents that are not toxic, and documents that are toxic or not of
    low quality, the second with runs of spaces and line ends cut to one."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path")
    old = docs.filter(F.coalesce("toxic", F.lit(0)) == 0).select(
        path, F.length("text").cast("bigint").alias("length")
    )
    new = docs.filter((F.coalesce("quality", F.lit(1)) == 1) | (F.col("toxic") == 1)).select(
        path,
        F.length(F.regexp_replace("text", "[ \n]+", " ")).cast("bigint").alias("length"),
    )
    return old, new


def hashed_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests of the documents with the md5 of their texts: as they are, and with every
    fifth one moved to another folder, every seventh one removed and every eleventh one cut short."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    folder = F.concat_ws("/", "lang", "source")
    name = F.col("doc_id").cast("string")

    def manifest(rows: DataFrame, path: Column, text: Column) -> DataFrame:
        return rows.select(
            path.alias("path"), F.length(text).cast("bigint").alias("length"), F.md5(text.cast("binary")).alias("sha")
        )

    moved = F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", F.lit("moved"), "source")).otherwise(folder)
    text = F.when(F.col("doc_id") % 11 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    old = manifest(docs, F.concat_ws("/", folder, name), F.col("text"))
    new = manifest(docs.filter("doc_id % 7 <> 0"), F.concat_ws("/", moved, name), text)
    return old, new
