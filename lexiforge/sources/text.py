"""Line-oriented sources.

Every line table has the order columns ``part`` (glob position, or the key of the
row a text came from), ``file`` and ``line_no``; order is never left to partition
layout. Files are read in splits, so one large file is many tasks: a line's place in its
split comes from the task's own row counter, and the splits' line counts (a small table) give
the number of the first line of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import exclusive_running_sum, ordered_running_sum
from ..functions.text import col_of, strip_unicode, translate_controls
from ..session import cut_lineage, written
from .markup import page_text

LINE_COLS = ["part", "file", "line_no", "line"]


def read_lines(spark: SparkSession, globs) -> DataFrame:
    """A1: comma-separated globs read in listed order, files sorted within a glob; one row per
    physical line as ``readline`` returns it (lines end at a newline only; a final newline
    makes no extra line, and an empty file has no lines). Documents may continue across file
    ends. ``file`` is the path as it is named."""
    if isinstance(globs, str):
        globs = [g for g in globs.split(",") if g]
    frames = [
        spark.read.option("lineSep", "\n").text(g).select(
            F.lit(gi).cast("long").alias("part"), decoded_path().alias("file"),
            F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
        for gi, g in enumerate(globs)
    ]
    # Rows of one split follow each other in one task, so their counter rises by one. Written once, as columns (the path is
    # the same in many rows): a second scan could be split in another way (more executors), and its splits would not match.
    lines = written(reduce(DataFrame.unionByName, frames), "read-lines")
    splits = lines.groupBy("part", "file", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = exclusive_running_sum(splits, ["_split"], "_n", "_before", partition_cols=["part", "file"])
    return lines.join(_sent_round(splits), ["part", "file", "_split"]).select(
        "part", "file", (F.col("_before") + F.col("_row") - F.col("_first")).cast("long").alias("line_no"), "line")


FEW_SPLITS = 20_000  # a table of files or splits up to this goes to all tasks, so that their lines stay where they are


def _sent_round(small: DataFrame) -> DataFrame:
    """A table of one row per file or split, written, and broadcast if it has few rows."""
    small = cut_lineage(small)
    return F.broadcast(small) if small.count() <= FEW_SPLITS else small


def overall_numbers(lines: DataFrame, out: str = "overall") -> DataFrame:
    """``lines`` with one overall 0-based number in the order (part, file, line_no): a running
    sum over the table of files."""
    per_file = lines.groupBy("part", "file").agg(F.count(F.lit(1)).alias("_n"))
    offs = ordered_running_sum(per_file, ["part", "file"], "_n", "_off").select("part", "file", "_off")
    return lines.join(_sent_round(offs), ["part", "file"]).withColumn(out, F.col("_off") + F.col("line_no")).drop("_off")


def lines_from_table(df: DataFrame, key_col: str, text_col: str, doc_break: bool = True) -> DataFrame:
    """A1 over a table of texts: each row is a 'file' (order = key), split on newlines.
    With ``doc_break`` an empty line follows each text, i.e. every row is a document."""
    arr = F.split(F.col(text_col), "\n")
    if doc_break:
        arr = F.concat(arr, F.array(F.lit("")))
    return df.select(
        F.col(key_col).cast("long").alias("part"),
        F.lit("").alias("file"),
        F.posexplode(arr).alias("line_no", "line"),
    ).select("part", "file", F.col("line_no").cast("long"), "line")


def decoded_path() -> Column:
    """Path of the file that a row was read from, as it is named: Spark percent-encodes it.
    (``+`` means itself in a path, but a blank to ``url_decode``.)"""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


OPEN_COST = "spark.sql.files.openCostInBytes"


READ_BYTES = 8 << 20  # content of files read together


def read_labelled_folders(spark: SparkSession, root: str) -> DataFrame:
    """A2: one sub-folder per category under ``root``; only files named
    ``{category}*.txt`` count. Returns (label, file_name, content); order = (label, file_name).

    The driver lists the categories only: a task lists the files of a folder (hidden and empty ones left out, as Spark does),
    and tasks read them file by file, through the file systems that ``named_files`` writes by."""
    from ..operators.sequences import cpu_partitions
    from ..sinks.named_files import _filesystem

    system, base = _filesystem(root)
    folders = [(f.path,) for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory]
    if not folders:
        raise FileNotFoundError(f"no folder below {root}")

    def hidden(name: str) -> bool:
        return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(root)
        for folder in (f for b in batches for f in b["folder"].to_pylist()):
            todo = [folder]
            while todo:
                at = todo.pop()
                label, names = at.rsplit("/", 1)[-1], []
                for f in system.get_file_info(fs.FileSelector(at)):
                    name = f.base_name
                    if hidden(name):
                        continue
                    if f.type == fs.FileType.Directory:
                        todo.append(f.path)
                    elif name.startswith(label) and name.endswith(".txt") and f.size:
                        names.append(name)
                yield pa.RecordBatch.from_pydict({"folder": pa.array([at] * len(names), pa.string()), "label": pa.array([label] * len(names), pa.string()),
                                                  "file_name": pa.array(names, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(root)
        for b in batches:
            lo, size, content = 0, 0, []
            for i, (folder, name) in enumerate(zip(b["folder"].to_pylist(), b["file_name"].to_pylist())):
                with system.open_input_stream(f"{folder}/{name}") as f:
                    content.append(f.read())
                size += len(content[-1])
                if size >= READ_BYTES or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([b["label"].slice(lo, i + 1 - lo), b["file_name"].slice(lo, i + 1 - lo), pa.array(content, pa.binary())],
                                                     ["label", "file_name", "content"])
                    lo, size, content = i + 1, 0, []

    files = spark.createDataFrame(folders, "folder string").repartition(len(folders), "folder").mapInArrow(listed, "folder string, label string, file_name string")
    out = files.repartition(cpu_partitions(spark), "label", "file_name").mapInArrow(read, "label string, file_name string, content binary")
    return written(out.withColumn("content", F.col("content").cast("string")), "folders-read")


def labelled_files_from_table(df: DataFrame, label_col: str, key_col: str, text_col: str) -> DataFrame:
    """A2 over a table: category = ``label_col``, file name = ``{label}-{key}.txt``."""
    return df.select(
        F.col(label_col).alias("label"),
        F.concat(F.col(label_col), F.lit("-"), F.col(key_col).cast("string"), F.lit(".txt")).alias("file_name"),
        F.col(text_col).alias("content"),
    ).filter(F.col("file_name").startswith(F.col("label")))


def article_body(content) -> Column:
    """C11: drop the first two lines (URL, timestamp), strip each line, drop empty
    lines, join with no separator. Lines break at \\r\\n, \\r or \\n (universal newlines)."""
    lines = F.split(col_of(content), "\r\n|\r|\n")
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    stripped = F.transform(body, lambda s: strip_unicode(s))
    return F.array_join(F.filter(stripped, lambda s: s != F.lit("")), "")


def labelled_texts(files: DataFrame) -> DataFrame:
    """(label, file_name, text) with text = C10(C11(content))."""
    return files.select("label", "file_name", translate_controls(article_body(F.col("content"))).alias("text"))


# The pair delimiter of the sentence-pair input format.
PAIR_PATTERN = "(?s)^(.*) \\|\\|\\| (.*)\\z"


def parse_pairs(lines: DataFrame, id_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Strip the line; greedy match so the last ' ||| ' splits; no match ->
    text_b null; blank lines stay as rows. unique_id = line number."""
    s = strip_unicode(F.col(line_col))
    m = s.rlike(PAIR_PATTERN)
    return lines.select(
        F.col(id_col).cast("long").alias("unique_id"),
        F.when(m, F.regexp_extract(s, PAIR_PATTERN, 1)).otherwise(s).alias("text_a"),
        F.when(m, F.regexp_extract(s, PAIR_PATTERN, 2)).alias("text_b"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A6 from a file (or files, in name order): unique_id = overall line number."""
    return parse_pairs(overall_numbers(read_lines(spark, path), "uid"), "uid", "line")


# --- A10: page text extraction -------------------------------------------------

def page_parts(html) -> Column:
    """(title, lines) of a page's markup; null for a null page."""

    @F.pandas_udf("title string, lines array<string>")
    def parts(pages: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if h is None else page_text(h) for h in pages]
        return pd.DataFrame(rows, columns=["title", "lines"])

    return parts(col_of(html))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A10 (re-aimed): markup pages -> raw corpus lines in the extractor's layout:
    ``<doc id=.. url=.. title=..>``, title, empty line, text lines, ``</doc>``.
    Returns the line schema with part = page id; a null page has no lines."""
    x = pages.select(F.col(id_col).cast("long").alias("part"), F.col(url_col).alias("_url"), page_parts(F.col(html_col)).alias("_p"))
    header = F.format_string('<doc id="%s" url="%s" title="%s">', F.col("part").cast("string"), F.col("_url"), F.col("_p.title"))
    arr = F.concat(F.array(header, F.col("_p.title"), F.lit("")), F.col("_p.lines"), F.array(F.lit("</doc>")))
    return x.select("part", F.lit("").alias("file"), F.posexplode(arr).alias("line_no", "line")).select("part", "file", F.col("line_no").cast("long"), "line")
