"""Sinks: the per-folder CSV of valid rows, the invalid-name lists, and a
JSON dump of blocks. Writes are partitioned by folder and range-split on
the line number, so one huge folder is written by many tasks (its part
files, read in part order, are the file in line order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import csv_field
from ..session import materialize


def csv_lines(valid: DataFrame, column_keys: DataFrame, heads: DataFrame) -> DataFrame:
    """``column_keys``: (folder_path, col_key) of the valid rows, one row per key.

    Returns (folder_path, line_no, line) of each folder's CSV: line 0 is
    ``Row,<header...>``; line r+1 is ``Row<r>`` followed by the row's cell
    at each of the folder's sorted column keys (empty when absent). The
    record width is the number of distinct keys, which may differ from the
    header width."""
    keys = (column_keys.groupBy("folder_path")
            .agg(F.array_sort(F.collect_list("col_key")).alias("keys")))
    keys = materialize(keys, "csv-keys")  # of a known size, so the rows are joined where they are
    data = valid.join(keys, "folder_path").select(
        "folder_path",
        (F.col("row_number") + 1).cast("bigint").alias("line_no"),
        F.concat_ws(",", F.concat(F.lit("Row"), F.col("row_number").cast("string")),
                    F.transform("keys", lambda k: csv_field(F.coalesce(F.try_element_at("cells", k),
                                                                      F.lit(""))))).alias("line"))
    header = heads.select(
        F.col("block_id").alias("folder_path"), F.lit(0).cast("bigint").alias("line_no"),
        F.concat_ws(",", F.lit("Row"), F.transform("column_headers", lambda h: csv_field(h))).alias("line"))
    return header.unionByName(data)


def _folder_dir(spark, out_dir: str, folder: str):
    """The partition directory of a folder's lines, and its file system."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/folder_path={name}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_folders(lines: DataFrame, out_dir: str, changed: DataFrame) -> None:
    """Puts ``lines`` (folder_path, line) of the ``changed`` folders (folder_path) in
    the place of what ``out_dir`` holds of them: folders with lines are overwritten
    one by one, those that have none any more lose theirs, and the files of all
    other folders are not touched. Lines of folders that didn't change are left out."""
    spark = lines.sparkSession
    changed = changed.select("folder_path").distinct()
    mine = lines.join(changed, "folder_path", "left_semi")
    (mine.select("folder_path", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("folder_path").text(out_dir))
    for row in changed.join(lines.select("folder_path"), "folder_path", "left_anti").toLocalIterator():
        path, fs = _folder_dir(spark, out_dir, row["folder_path"])
        fs.delete(path, True)


def write_csv(lines: DataFrame, out_dir: str, mode: str = "overwrite", changed: DataFrame | None = None) -> None:
    """Each folder's CSV as text files below ``out_dir/folder_path=<folder>``. With
    ``changed`` (folder_path) only these folders' files are replaced."""
    ordered = lines.repartitionByRange("folder_path", "line_no").sortWithinPartitions("folder_path", "line_no").select("folder_path", "line")
    if changed is not None:
        replace_folders(ordered, out_dir, changed)
    else:
        ordered.write.mode(mode).partitionBy("folder_path").text(out_dir)


def read_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """(folder_path, line) of all files that ``write_csv`` or ``write_invalid`` left."""
    return spark.read.schema("line string, folder_path string").text(out_dir).select("folder_path", "line")


def invalid_files_name(stamp) -> str:
    """``invalid_files_<yyyyMMddHHmmss>`` for a run stamp."""
    return f"invalid_files_{stamp:%Y%m%d%H%M%S}"


def write_invalid(invalid: DataFrame, out_dir: str, stamp=None, mode: str = "overwrite", changed: DataFrame | None = None) -> str:
    """One name per line per folder; folders without invalid names get no
    file. With ``stamp`` the output goes to ``out_dir/invalid_files_<stamp>``. With
    ``changed`` (folder_path) only these folders' lists are replaced, and the
    list of a folder that has no invalid name any more goes.
    Returns the folder written."""
    target = out_dir if stamp is None else f"{out_dir.rstrip('/')}/{invalid_files_name(stamp)}"
    ordered = invalid.select("folder_path", F.col("name").alias("line")).repartitionByRange("folder_path", "line").sortWithinPartitions("folder_path", "line")
    if changed is not None:
        replace_folders(ordered, target, changed)
    else:
        ordered.write.mode(mode).partitionBy("folder_path").text(target)
    return target


def write_dump(dump: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """The text dump as files of lines, blocks in order of their ids and lines in
    theirs; a large block spans files."""
    (dump.repartitionByRange("block_id", "line_no").sortWithinPartitions("block_id", "line_no")
     .select("json").write.mode(mode).text(out_dir))


def header_widths(column_keys: DataFrame, heads: DataFrame) -> DataFrame:
    """(folder_path, n_header, n_keys) of blocks whose rows have more or fewer
    different column keys than their header has columns: their CSV's records are not
    as wide as its header. ``column_keys``: (folder_path, col_key) of the valid rows."""
    keys = column_keys.select("folder_path", "col_key").distinct().groupBy("folder_path").agg(F.count(F.lit(1)).alias("n_keys"))
    return (heads.where("n_rows > 0").select(F.col("block_id").alias("folder_path"), F.size("column_headers").cast("bigint").alias("n_header"))
            .join(keys, "folder_path").where("n_header <> n_keys"))


def json_dump(block_rows: DataFrame, block_heads: DataFrame, block_id: str | None = None) -> DataFrame:
    """(block_id, line_no, json) readable dump of all blocks, or of one: line 0
    is the block's head, line r + 1 its row r, so a block of any size is spread
    over many lines."""
    if block_id is not None:
        block_rows, block_heads = (df.where(F.col("block_id") == block_id) for df in (block_rows, block_heads))
    heads = block_heads.select("block_id", F.lit(0).cast("bigint").alias("line_no"),
                               F.to_json(F.struct("block_id", "column_headers")).alias("json"))
    rows = block_rows.select("block_id", (F.col("row_number") + 1).alias("line_no"), F.to_json(F.struct(
        "row_number", F.map_from_entries("entries").alias("cell_columns"))).alias("json"))
    return heads.unionByName(rows)
