"""Matrices as files: genes x samples TSV, samples x genes CSV, labels, and their long and wide forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def cells(samples: DataFrame) -> DataFrame:
    """Long form: ``sample_id, gene_idx, value``."""
    return samples.select("sample_id", F.posexplode("features").alias("gene_idx", "value")).withColumn("value", F.col("value").cast("double"))


def wide(long: DataFrame) -> DataFrame:
    """Arrays back from ``sample_id, gene_idx, value``, in gene order."""
    ordered = F.sort_array(F.collect_list(F.struct("gene_idx", "value")))
    return long.groupBy("sample_id").agg(F.transform(ordered, lambda c: c["value"].cast("float")).alias("features"))


#: Where a row stands: its file, the split of the file, and the order in which a task reads that split.
_PLACE = ("_file", "_start", "_line")


def _placed(raw: DataFrame) -> DataFrame:
    """The rows of a text or CSV source with their places."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.select("*", *(c.alias(n) for c, n in zip(place, _PLACE)))


def _numbered(placed: DataFrame, name: str) -> DataFrame:
    """Dense numbers from 0 in the order of file names and lines, in place of the places; a task numbers one split of a file."""
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    inner = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_line")) - 1
    found = placed.join(splits.select("_file", "_start", before.alias("_before")), ["_file", "_start"])
    return found.withColumn(name, (F.col("_before") + inner).cast("long")).drop(*_PLACE, "_before")


def _tiles(width: int):
    """The values of a line in tiles of ``width`` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gene, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.array([float(v) if v else np.nan for v in line.as_py().split("\t")[1:]], np.float32)
                cuts = range(0, len(values), width)
                tiles = pa.array([values[at : at + width] for at in cuts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([at // width for at in cuts], pa.int64()), pa.array([gene] * len(tiles), pa.int64()), tiles], names=["tile", "gene_idx", "v"])

    return run


def _turned(width: int, genes: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["gene_idx"].to_numpy())
        V = [v.values.to_numpy() for v in table["v"]]
        if len(V) != genes or len({len(v) for v in V}) != 1:
            raise ValueError("lines of the matrix have different lengths")
        X = np.stack([V[i] for i in order]).T
        at = table["tile"][0].as_py() * width
        return pa.table({"ordinal": pa.array(np.arange(at, at + len(X))), "features": pa.array([*X], pa.list_(pa.float32()))})

    return run


def read_matrix(spark: SparkSession, path: str, tile_bytes: int = 8 << 20) -> tuple[DataFrame, list[str]]:
    """Samples (``sample_id, ordinal, features``) and gene names of a genes x samples TSV.

    The file has a gene per line, so it is turned by tiles: tasks cut lines into runs of
    samples, and the lines' runs of the same samples meet and are turned, about
    ``tile_bytes`` at a time.  Gene order is line order, sample order is header order; an
    empty value is NaN; every file of a folder has the header.  The driver gets the gene
    names, which are the width of the matrix.
    """
    lines = _placed(spark.read.text(path))
    first = lines.groupBy("_file").agg(F.min(F.struct("_start", "_line")).alias("p")).select("_file", F.col("p._start").alias("_start"), F.col("p._line").alias("_line"), F.lit(True).alias("_header"))
    lines = lines.join(first, [*_PLACE], "left")
    body = _numbered(lines.where("_header is null and length(value) > 0").drop("_header"), "gene_idx")
    genes = [r["gene"] for r in body.select("gene_idx", F.substring_index("value", "\t", 1).alias("gene")).orderBy("gene_idx").collect()]  # the width
    width = max(1, min(4096, tile_bytes // (4 * max(1, len(genes)))))
    tiles = body.select("gene_idx", "value").mapInArrow(_tiles(width), "tile long, gene_idx long, v array<float>")
    turned = tiles.groupBy("tile").applyInArrow(_turned(width, len(genes)), "ordinal long, features array<float>")
    header = lines.where("_header").orderBy("_file").limit(1)
    names = header.select(F.posexplode(F.split("value", "\t")).alias("at", "sample_id")).where("at > 0").select((F.col("at") - 1).cast("long").alias("ordinal"), "sample_id")
    return turned.join(names, "ordinal").select("sample_id", "ordinal", "features"), genes


def read_reference(spark: SparkSession, path: str | None) -> DataFrame:
    """An optional matrix: empty without a path or file."""
    try:
        if path:
            return read_matrix(spark, path)[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], "sample_id string, ordinal long, features array<float>")


def read_released(spark: SparkSession, path: str, genes: list[str]) -> DataFrame:
    """``row_id, features`` of a samples x genes CSV, columns chosen by name; a missing gene is an error.

    ``row_id`` counts the rows in the order of file names and lines.
    """
    raw = spark.read.csv(path, header=True)
    lost = [g for g in genes if g not in raw.columns]
    if lost:
        raise ValueError(f"genes missing from {path}: {lost[:5]}")
    rows = _placed(raw).select(*_PLACE, F.array(*(F.col(f"`{g}`").cast("float") for g in genes)).alias("features"))
    return _numbered(rows, "row_id").select("row_id", "features")


def read_labelled(spark: SparkSession, data: str, labels: str, genes: list[str]) -> DataFrame:
    """``row_id, features, label`` of two files, or folders of files, aligned by line in the order of file names."""
    from privaudit.operators.labels import positional

    left = read_released(spark, data, genes).withColumn("ordinal", F.col("row_id"))
    text = spark.read.csv(labels, header=True)
    right = _numbered(_placed(text).select(*_PLACE, F.col(f"`{text.columns[-1]}`").alias("label")), "ordinal")
    return positional(left, right).select("row_id", "features", "label")


def read_labels(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """``sample_id, label``: first column and the named label column (else the first one) of a CSV."""
    schema = StructType([StructField("sample_id", StringType()), StructField("label", StringType())])
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(raw.columns[0]).alias("sample_id"), F.col(f"`{column or raw.columns[1]}`").alias("label")).to(schema)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """``sample_id, score`` as CSV in input order (``ordinal``); a row per audited sample.

    Rows are sorted by ranges and written in parts, which in the order of their names make
    up the file, header first; ``_manifest`` in the folder lists the parts and their lines.
    """
    spark, line = predictions.sparkSession, F.to_csv(F.struct(F.col("sample_id").cast("string"), F.col("score").cast(DoubleType()).alias("score")))
    head = spark.createDataFrame([(None, "sample_id,score")], "ordinal long, value string")
    rows = head.union(predictions.select(F.col("ordinal").cast("long"), line.alias("value")))
    rows.orderBy(F.col("ordinal").asc_nulls_first()).select("value").write.mode("overwrite").text(path)
    parts = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count("*").alias("lines"))
    parts.orderBy("part").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")  # a row a part


def from_embeddings(df: DataFrame) -> DataFrame:
    """Samples of the driver's ``embeddings`` table."""
    return df.select(F.col("vec_id").cast("string").alias("sample_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("features"), F.col("label"))
