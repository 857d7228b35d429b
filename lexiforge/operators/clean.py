"""Corpus cleaning (C1-C8) over line tables (part, file, line_no, line).

Passes that look at single lines are projections and filters. Those that count lines (headers,
line numbers) work on blocks of a file's lines: windows inside a block, a summary row per
block, and a running sum over the summaries, so that one large file is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import exclusive_running_sum
from ..functions.text import ltrim_spaces, rtrim_spaces, sentence_break
from ..session import cut_lineage

FILE_KEYS = ["part", "file"]
BLOCK_KEYS = [*FILE_KEYS, "_blk"]
BLOCK_LINES = 1 << 16  # lines of a file that one window sees


def in_blocks(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """Lines with the number ``_blk`` of their block in the file."""
    return lines.withColumn("_blk", F.floor(F.col("line_no") / F.lit(block)).cast("long"))


def doc_header_flags(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """C2 marks on lines that C1 has left: a line holding ``<doc id`` opens a two-line range
    (itself and the next line that is not empty, the title). A ``<doc id`` line inside an open
    range does not open another, so in a run of such lines every second one opens.

    A block is summed up by its number of lines and its last line without ``<doc id``; the places of
    these in the file are a running sum and a running maximum over blocks."""
    w = Window.partitionBy(*BLOCK_KEYS).orderBy("line_no")
    has = F.col("line").contains("<doc id")
    x = in_blocks(lines, block).withColumn("_has", has).withColumn("_at", F.row_number().over(w))
    other = F.when(~F.col("_has"), F.col("_at"))
    per = x.groupBy(*BLOCK_KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max(other).alias("_last"))
    per = exclusive_running_sum(per, ["_blk"], "_n", "_off", partition_cols=FILE_KEYS)
    w_blocks = Window.partitionBy(*FILE_KEYS).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*BLOCK_KEYS, "_off", F.coalesce(F.max(F.col("_off") + F.col("_last")).over(w_blocks), F.lit(0)).alias("_carry"))
    x = x.withColumn("_near", F.max(other).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(per, BLOCK_KEYS)
    at = F.col("_off") + F.col("_at")
    last = F.coalesce(F.col("_off") + F.col("_near"), F.col("_carry"))  # last line before this one that has no <doc id
    opens = F.col("_has") & ((at - last) % 2 == 1)
    after_opener = (at - 1 > last) & ((at - 1 - last) % 2 == 1)
    return x.withColumn("_in_header", opens | after_opener).drop("_blk", "_has", "_at", "_near", "_off", "_carry")


def drop_doc_header(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """C1 + C2: drop empty lines (lines of spaces stay), then each ``<doc id`` line and the
    line that follows it (the title). Empty lines go first, so the title is found past them."""
    kept = lines.filter(F.col("line") != F.lit(""))
    return doc_header_flags(kept, block).filter(~F.col("_in_header")).drop("_in_header")


def mark_doc_end(lines: DataFrame) -> DataFrame:
    """Remove ``</doc>``; the line left empty is the document boundary."""
    return lines.withColumn("line", F.regexp_replace("line", "</doc>", ""))


def first_pass(lines: DataFrame) -> DataFrame:
    """C1-C3 as the first in-place pass does them: empty lines are deleted, then the
    header ranges, then ``</doc>`` is removed."""
    return mark_doc_end(drop_doc_header(lines)).select(*lines.columns)


def split_sentences(lines: DataFrame, delims: str = "。", closers: str = "」|)）\"") -> DataFrame:
    """C4-C6 (second pass): trailing spaces removed, a break after each delimiter not
    followed by a closer, leading spaces removed from the start of the (unsplit) line;
    then the new lines. Adds ``sub_no``; order is (line_no, sub_no)."""
    buf = ltrim_spaces(sentence_break(rtrim_spaces(F.col("line")), delims, closers))
    return lines.select(
        *[c for c in lines.columns if c != "line"], F.posexplode(F.split(buf, "\n")).alias("sub_no", "line")
    )


def drop_leading_delim(lines: DataFrame, delims: str = "。") -> DataFrame:
    """Drop lines that begin with a delimiter (all text after it goes too)."""
    cond = F.lit(False)
    for ch in delims:
        cond = cond | F.col("line").startswith(ch)
    return lines.filter(~cond)


def lowercase(lines: DataFrame) -> DataFrame:
    """Lowercase every line."""
    return lines.withColumn("line", F.lower("line"))


def renumber(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """Dense line numbers per file after a pass that split lines: numbers inside a block and the
    lines of the blocks before it. ``lines`` is read twice."""
    x = in_blocks(lines, block)
    per = x.groupBy(*BLOCK_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    per = exclusive_running_sum(per, ["_blk"], "_n", "_off", partition_cols=FILE_KEYS).drop("_n")
    w = Window.partitionBy(*BLOCK_KEYS).orderBy("line_no", "sub_no")
    x = x.withColumn("_at", F.row_number().over(w) - 1).join(per, BLOCK_KEYS)
    return x.withColumn("line_no", (F.col("_off") + F.col("_at")).cast("long")).drop("sub_no", "_at", "_off", "_blk").select(*[c for c in lines.columns if c != "sub_no"])


def clean_corpus(lines: DataFrame, delims: str = "。", closers: str = "」|)）\"", lower: bool = True) -> DataFrame:
    """The four passes: C1-C3, C4-C6, C7, C8. Output keeps the line schema. The split lines are written
    once, since they are counted before they are numbered."""
    out = drop_leading_delim(split_sentences(first_pass(lines), delims, closers), delims)
    if lower:
        out = lowercase(out)
    return renumber(cut_lineage(out))


def preview(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` records in order (the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)


def check_seq_len(df: DataFrame, cols: list[str], n: int, max_len: int = 512) -> DataFrame:
    """C14: every feature array has length ``n`` and ``n`` is at most ``max_len``. The check
    is part of the returned columns, so a plan that uses one of them cannot drop it."""
    if n > max_len:
        raise ValueError(f"sequence length {n} is above the maximum {max_len}")
    checked = {}
    for c in cols:
        wrong = F.raise_error(F.concat(F.lit(f"{c} has not length {n} but "), F.coalesce(F.size(c), F.lit(-1)).cast("string")))
        checked[c] = F.when(F.size(c) == n, F.col(c)).otherwise(wrong.cast(df.schema[c].dataType))
    return df.withColumns(checked)
