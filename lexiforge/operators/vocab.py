"""Vocabulary and tokenising.

Counting (E1a) and id assignment (E2) are aggregates; substrings (E1b) are in ``substrings``, the
training of subword pieces (E1c, E1d) in ``unigram``. Lookups (E3, E4, E5) are Arrow-batched pandas
UDFs over a broadcast trie or dictionary whose size is checked against a bound before it is collected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS_CHARS, strip_unicode
from .lattice import Trie, segment
from .substrings import WORD_START, candidate_substrings, repeated_substrings  # noqa: F401  (E1b)

# Reserved pieces ahead of the learned ones (unknown, sentence start
# and end, then the control symbols [PAD],[CLS],[SEP],[MASK]).
RESERVED = ["<unk>", "<s>", "</s>", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]
UNK_ID = 0

MAX_VOCAB_COLLECT = 2_000_000  # a vocabulary above this is not broadcast


# --- E1a: counts ------------------------------------------------------------

def word_counts(sentences: DataFrame, text_col: str = "sentence", lower: bool = True) -> DataFrame:
    """(word, n) over white-space words (``ws_tokens``). Each Arrow batch is cut and counted as a column,
    so that its distinct words, not all, are rows of the partial aggregation."""
    text = F.col(text_col)
    texts = sentences.select((F.lower(text) if lower else text).alias("text"))
    counts = texts.mapInArrow(_batch_counts, "word string, n long")
    return counts.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for b in batches:
        t = b.column(0).drop_null()
        for ch in WS_CHARS[1:]:
            t = pc.replace_substring(t, ch, WS_CHARS[0])
        c = pc.split_pattern(t, WS_CHARS[0]).flatten().value_counts()
        word = c.field("values")
        keep = pc.not_equal(word, "")
        yield pa.RecordBatch.from_arrays([word.filter(keep), c.field("counts").filter(keep)], ["word", "n"])


# --- E2 ---------------------------------------------------------------------------

def assign_ids(pieces: DataFrame, size: int, reserved: list[str] | None = None,
               score_col: str = "score", piece_col: str = "piece") -> DataFrame:
    """Reserved pieces get ids 0.., then the best ``size - len(reserved)`` pieces by
    score (ties by piece). Returns (piece, score, id). ``orderBy().limit()`` is a
    distributed top-k; only the kept rows are numbered."""
    reserved = RESERVED if reserved is None else reserved
    spark = pieces.sparkSession
    k = size - len(reserved)
    top = (
        pieces.filter(~F.col(piece_col).isin(reserved))
        .orderBy(F.col(score_col).desc(), F.col(piece_col))
        .limit(k)
        .select(F.col(piece_col).alias("piece"), F.col(score_col).cast("double").alias("score"))
    )
    w = Window.orderBy(F.col("score").desc(), F.col("piece"))  # over at most `size` rows
    learned = top.withColumn("id", (F.row_number().over(w) - 1 + len(reserved)).cast("int"))
    fixed = spark.createDataFrame(
        [(p, 0.0, i) for i, p in enumerate(reserved)], "piece string, score double, id int"
    )
    return fixed.unionByName(learned)


def word_vocab(sentences: DataFrame, size: int, text_col: str = "sentence") -> DataFrame:
    """Vocabulary of the minimum slice: the most frequent words (E1a) behind the reserved ids."""
    return assign_ids(word_counts(sentences, text_col).withColumnRenamed("word", "piece"), size, score_col="n")


def words_vocab(words: DataFrame, size: int) -> DataFrame:
    """``word_vocab`` of words already parted: one row (word) for each time that one occurs."""
    return assign_ids(words.groupBy(F.col("word").alias("piece")).agg(F.count(F.lit(1)).alias("n")), size, score_col="n")


# --- dictionaries ------------------------------------------------------------------

def bounded_collect(df: DataFrame, max_rows: int) -> list:
    """Rows of a table that must be small, in one job: more than ``max_rows`` is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"table above the collect bound of {max_rows} rows")
    return rows


def vocab_dict(vocab: DataFrame, max_size: int = MAX_VOCAB_COLLECT) -> dict[str, int]:
    """piece -> id, the last id winning for a repeated piece (E6 counterpart)."""
    d: dict[str, int] = {}
    for piece, i in sorted(((r["piece"], int(r["id"])) for r in bounded_collect(vocab.select("piece", "id"), max_size)),
                           key=lambda x: x[1]):
        d[piece] = i
    return d


def vocab_tables(vocab: DataFrame, max_size: int = MAX_VOCAB_COLLECT) -> tuple[dict[str, int], list[str]]:
    """One bounded collect: (piece -> id with the last id winning, distinct pieces in
    first-seen order)."""
    rows = sorted(((r["piece"], int(r["id"])) for r in bounded_collect(vocab.select("piece", "id"), max_size)),
                  key=lambda x: x[1])
    d: dict[str, int] = {}
    for piece, i in rows:
        d[piece] = i
    return d, list(dict.fromkeys(p for p, _ in rows))


def _flat_mapped(s, lookup):
    """``lookup`` of all values of an Arrow batch of arrays at once; null rows stay null."""
    n = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    return pa.ListArray.from_arrays(ends, lookup(s.flatten()), mask=s.is_null())  # flatten leaves out null rows


def tokens_to_ids(col: Column, vocab: DataFrame | dict) -> Column:
    """Tokens -> ids, unknown -> 0, as an Arrow UDF over a broadcast vocabulary: looked up as Arrow
    columns, so that no token becomes a Python object."""
    d = vocab if isinstance(vocab, dict) else vocab_dict(vocab)
    spark = SparkSession.getActiveSession()
    bc = spark.sparkContext.broadcast((list(d), np.fromiter(d.values(), np.int32, len(d))))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        pieces, numbers = pa.array(bc.value[0], pa.string()), pa.array(np.append(bc.value[1], np.int32(UNK_ID)))
        unknown = pa.scalar(len(pieces), pa.int32())
        for s in batches:
            yield _flat_mapped(s, lambda flat: numbers.take(pc.index_in(flat.cast(pa.string()), value_set=pieces).fill_null(unknown)))

    return _ids(col)


def ids_to_tokens(col: Column, vocab: DataFrame | dict) -> Column:
    """E5: ids -> tokens through the inverse vocabulary, unknown -> ``<unk>``."""
    d = vocab if isinstance(vocab, dict) else vocab_dict(vocab)
    table = ["<unk>"] * (max(d.values(), default=-1) + 2)  # by id; the last is unknown
    for p, i in d.items():
        table[i] = p
    bc = SparkSession.getActiveSession().sparkContext.broadcast(table)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def _toks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pa.array(bc.value, pa.string())
        last = len(pieces) - 1

        def pieces_of(flat):
            i = flat.fill_null(last).to_numpy(zero_copy_only=False)
            return pieces.take(pa.array(np.where((i >= 0) & (i < last), i, last)))

        for s in batches:
            yield _flat_mapped(s, pieces_of)

    return _toks(col)


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """Id -> piece of the effective vocabulary (a repeated piece keeps its last id)."""
    eff = vocab.groupBy("piece").agg(F.max("id").alias("id"))
    return eff.select(F.col("id").cast("int").alias("id"), "piece")


def parse_vocab(lines: DataFrame, id_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """A5 body: ``piece<TAB>score``, piece stripped, id = line index.
    Returns every line (piece, score, id); repeated pieces resolve in lookups."""
    parts = F.split(F.col(line_col), "\t")
    return lines.select(
        strip_unicode(parts[0]).alias("piece"),
        F.element_at(parts, 2).cast("double").alias("score"),
        F.col(id_col).cast("int").alias("id"),
    )


# --- E3: subword tokenizer, E1: training -----------------------------------------------

def normalize_text(text: str, lower: bool) -> str:
    """NFKC, optional lowercasing, white space runs -> one ``▁``, leading ``▁``."""
    t = unicodedata.normalize("NFKC", text)
    if lower:
        t = t.lower()
    words = t.split()
    if not words:
        return ""
    return "".join(WORD_START + w for w in words)


CACHED_WORDS = 200_000  # words whose pieces a task remembers between batches


def tokenize_subword(col: Column, vocab: DataFrame, lower: bool = True, normalize: bool = True) -> Column:
    """Subword tokens of a text column under the vocabulary's piece scores; pieces of
    any length count. The new words of a batch are segmented together over a double-array trie.
    Without ``normalize`` each text is one word as it stands."""
    scores = {r["piece"]: float(r["score"]) for r in bounded_collect(vocab.select("piece", "score"), MAX_VOCAB_COLLECT)
              if r["piece"] not in RESERVED}
    unk_penalty = (min(scores.values()) if scores else 0.0) - 10.0
    bc = SparkSession.getActiveSession().sparkContext.broadcast((Trie.build(list(scores)), np.array(list(scores.values()), np.float64)))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def _tok(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, piece_scores = bc.value
        known: dict[str, int] = {}  # words, without the marker, by number; their pieces follow each other in ``pieces``
        pieces, ends = pa.array([], pa.string()), np.zeros(1, np.int64)
        for s in batches:
            texts = [None if t is None else normalize_text(t, lower) if normalize else WORD_START + t for t in s.to_pylist()]
            words = "".join(t for t in texts if t).split(WORD_START)[1:]  # a marker inside a text parts words
            if len(known) > CACHED_WORDS:
                known, pieces, ends = {}, pieces[:0], ends[:1]
            new = [*set(words).difference(known)]
            if new:
                found = segment([WORD_START + w for w in new], trie, piece_scores, unk_penalty)[0]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                pieces = pa.concat_arrays([pieces, pa.array([p for w in found for p in w], pa.string())])
                ends = np.append(ends, ends[-1] + np.cumsum([len(w) for w in found]))
            word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            n = ends[word + 1] - ends[word]
            stop = np.concatenate(([0], np.cumsum(n)))
            at = np.repeat(ends[word] - stop[:-1], n) + np.arange(stop[-1])
            of_text = np.concatenate(([0], np.cumsum([0 if t is None else t.count(WORD_START) for t in texts], dtype=np.int64)))
            yield pa.ListArray.from_arrays(pa.array(stop[of_text], pa.int32()), pieces.take(pa.array(at)), mask=s.is_null())

    return _tok(col)


def train_unigram(sentences: DataFrame, size: int = 32000, text_col: str = "sentence", **settings) -> DataFrame:
    """Unigram vocabulary of ``size`` pieces including the reserved ones: ``unigram.train_pieces``
    (whose further settings apply), then ids (E2). Returns (piece, score, id) with reserved ids first."""
    from .unigram import train_pieces

    return assign_ids(train_pieces(sentences, size - len(RESERVED), text_col, **settings), size)
