"""Document assembly.

D1 is gaps-and-islands: a document number is the count of blank lines before a line
in corpus order. Within a block of a file's lines that is a window; across blocks and files
it is a running sum over a table of one row per block, so one large file is many tasks and a document may
continue across a file end exactly as in the reference. Sentence numbers inside a document
are built the same two-level way, so a document spanning many blocks or files never forces
all its lines through one window partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.indexing import dense_index_by_hash, exclusive_running_sum, ordered_running_sum
from ..functions.text import WS_CHARS, strip_unicode, ws_tokens
from ..session import cut_lineage, written
from .clean import BLOCK_KEYS, BLOCK_LINES, in_blocks



def to_documents(lines: DataFrame, tokenize: Callable[[Column], Column] | None = None, block: int = BLOCK_LINES,
                 again: bool = False) -> DataFrame:
    """D1 + D2: (part, file, line_no, line) -> sentences
    (doc_key long, sent_no long, part, file, line_no, sentence, tokens, n_tokens).

    Each line is stripped; an empty line starts a new document; lines that tokenise
    to nothing are dropped, and documents left empty vanish.

    Lines are read twice: their numbers are counted first, without their text, and each line then takes the number
    of its document from one row per block, so that texts are shuffled once. ``again`` says that ``lines`` are
    projections of a table, cheaper to make again than to write."""
    native = tokenize is None  # plain expressions: cheaper to split again than to shuffle the tokens
    tokenize = tokenize or ws_tokens
    s = lines.withColumn("sentence", strip_unicode(F.col("line"))).withColumn(
        "_blank", (F.col("sentence") == F.lit("")).cast("long")
    )
    if "sub_no" not in lines.columns:  # lines split by C5 may come without renumbering
        s = s.withColumn("sub_no", F.lit(0))
    s = in_blocks(s, block).drop("line")
    if not native:
        s = s.withColumn("tokens", tokenize(F.col("sentence")))
    full = F.trim("sentence", F.lit(WS_CHARS)) != F.lit("") if native else F.size("tokens") > 0  # has tokens
    # lines of one number (of texts that share a key) come in the same order both times
    s = s.withColumns({"_full": full, "_tie": F.xxhash64("sentence")})
    if not again:
        s = written(s, "lines")
    w_block = Window.partitionBy(*BLOCK_KEYS).orderBy("line_no", "sub_no", "_tie").rowsBetween(Window.unboundedPreceding, 0)

    def counted(x: DataFrame) -> DataFrame:
        return x.withColumns({"_cum": F.sum("_blank").over(w_block), "_seen": F.sum(F.when(F.col("_full"), 1).otherwise(0)).over(w_block)})

    docs = number_documents(counted(s.select(*BLOCK_KEYS, "line_no", "sub_no", "_tie", "_blank", "_full")))
    s = counted(s).filter("_full").join(docs, BLOCK_KEYS)
    s = s.withColumn("_doc", F.element_at("_docs", (F.col("_cum") - F.col("_docs")[0]["_cum"] + 1).cast("int")))
    if native:
        s = s.withColumn("tokens", tokenize(F.col("sentence")))
    s = s.withColumn("n_tokens", F.size("tokens"))
    kept = [c for c in lines.columns if c not in ("line", "sub_no")]
    return s.select(F.col("_doc.doc_key").alias("doc_key"), *kept, "sentence", "tokens", "n_tokens",
                    (F.col("_doc._boff") + F.col("_seen")).alias("sent_no"))


def number_documents(s: DataFrame) -> DataFrame:
    """(*BLOCK_KEYS, _docs), one row per block: for each value of ``_cum`` in it, in order and without gaps (a blank line
    has one, too), the document's number and what makes ``_seen``, the sentences of the block so far, the dense
    0-based number in the document, in corpus order."""
    per = s.filter("_cum is not null").groupBy(*BLOCK_KEYS, "_cum").agg(
        F.count(F.when(F.col("_full"), 1)).alias("_n"), F.min(F.when(F.col("_full"), F.col("_seen"))).alias("_first"), F.sum("_blank").alias("_nb"))
    per = cut_lineage(per)  # read twice, numbers only
    offs = ordered_running_sum(per.groupBy(*BLOCK_KEYS).agg(F.sum("_nb").alias("_nb")), BLOCK_KEYS, "_nb", "_off")
    per = per.join(offs.select(*BLOCK_KEYS, "_off"), BLOCK_KEYS).withColumn("doc_key", F.col("_off") + F.col("_cum"))
    per = exclusive_running_sum(per, BLOCK_KEYS, "_n", "_before", partition_cols=["doc_key"])
    row = F.struct("_cum", "doc_key", (F.col("_before") - F.col("_first")).alias("_boff"))
    return per.groupBy(*BLOCK_KEYS).agg(F.array_sort(F.collect_list(row)).alias("_docs"))


def document_table(sentences: DataFrame) -> DataFrame:
    """One row per document: (doc_key, n_sent, n_tokens)."""
    return sentences.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("n_sent"), F.sum("n_tokens").cast("long").alias("n_tokens")
    )


def index_documents(docs: DataFrame, seed: int = 12345) -> DataFrame:
    """D3: seeded shuffle of documents and dense ``doc_index`` 0..N-1."""
    keyed = docs.withColumn("_h", rng.sort_key(seed, "doc", F.col("doc_key")))
    return dense_index_by_hash(keyed, "_h", "doc_index", ["doc_key"]).drop("_h")


def duplicate(df: DataFrame, k: int, col: str = "rep") -> DataFrame:
    """Repeat every row ``k`` times with a repeat number (no join)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def shuffle_key(seed: int, *keys) -> Column:
    """Seeded global order of rows."""
    return rng.sort_key(seed, "shuffle", *keys)
