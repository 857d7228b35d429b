"""Queries for scans, cleaning, documents and vocabulary (A, C, D, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import dense_index_by_hash
from ..functions.text import decode_utf8, infer_value, strip_unicode, translate_controls
from ..operators import clean, documents, vocab
from ..sinks.named_files import write_labelled_folders
from ..sources import markup, tables
from ..sources import text as src
from . import sqlparts as S
from ..session import cut_lineage, scratch_path, written
from .catalog import T, register, with_ctes

DELIMS = ".!?"  # the test corpus has no 。, so the sentence rule runs on these
VOCAB_SIZE = 32000
SEED = 12345


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> lines (every row is a document) -> C4-C8 without the dense renumbering: projections and
    filters only, enough for what counts words."""
    lines = src.lines_from_table(T(spark, sf, "documents"), "doc_id", "text", doc_break=True)
    return clean.lowercase(clean.drop_leading_delim(clean.split_sentences(lines, DELIMS), DELIMS))


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned corpus with dense line numbers."""
    return clean.renumber(cut_lineage(corpus_lines(spark, sf)))


SENTENCE_TOKENS = ["doc_key", "sent_no", "tokens", "n_tokens"]


def doc_sentences(spark: SparkSession, sf: str, cols: list[str] | None = None) -> DataFrame:
    """D1/D2 over the cleaned corpus (document assembly orders by (line_no, sub_no) itself). The sentence
    table (or ``cols`` of it) is written once; every later step reads it."""
    s = numbered_sentences(spark, sf)
    return written(s if cols is None else s.select(*cols), "sentences")


def doc_vocab(spark: SparkSession, sf: str, sentences: DataFrame | None = None) -> DataFrame:
    if sentences is not None:  # their tokens are the words of the sentence
        return vocab.words_vocab(sentences.select(F.explode("tokens").alias("word")), VOCAB_SIZE)
    return vocab.word_vocab(corpus_lines(spark, sf), VOCAB_SIZE, "line")


def numbered_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """D1/D2 for what reads the sentences once, or few of their columns: not written."""
    return documents.to_documents(corpus_lines(spark, sf), again=True)


def sentence_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of the sentences straight from the lines: a sentence is a stripped line with words, of a
    text with a key, so no document has to be put together to count them."""
    lines = corpus_lines(spark, sf).where("part is not null")
    return vocab.word_vocab(lines.select(strip_unicode("line").alias("line")), VOCAB_SIZE, "line")


def corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    """E1a over the cleaned lines."""
    return vocab.word_counts(corpus_lines(spark, sf), "line")


# --- A1 ---------------------------------------------------------------------------

def line_files(spark: SparkSession, ordered: DataFrame, keys: list[str], name: str, ranged: bool = False) -> str:
    """Text files of ``ordered`` (keys, line) in key order, many of them, for the readers. ``ranged``: its
    partitions are ranges of the keys already."""
    path = scratch_path(spark, name)
    (ordered if ranged else ordered.repartitionByRange(*keys)).sortWithinPartitions(*keys).select(F.col("line").alias("value")).write.option("lineSep", "\n").text(path)
    return path


@register("a1_read_lines", with_ctes([S.doc_lines("l", doc_break=False)],
                                     "SELECT CAST(row_number() OVER (ORDER BY part, line_no) - 1 AS BIGINT) AS line_no, line FROM l"))
def a1_read_lines(spark, sf):
    lines = src.lines_from_table(T(spark, sf, "documents"), "doc_id", "text", doc_break=False)
    path = line_files(spark, lines, ["part", "line_no"], "lines")
    return src.overall_numbers(src.read_lines(spark, path)).select(F.col("overall").alias("line_no"), "line")


# --- A10 + C1-C3 + C4-C8 on pages -------------------------------------------------

# Fixed values of the oracle: what the pages of the test tables hold (they are well formed), as patterns.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_DROP_RE = "(?is)<!--.*?-->|" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in markup.DROP_ELEMENTS)
_BLOCK_RE = "(?i)<\\s*/?\\s*(?:" + "|".join(markup.BLOCK_TAGS) + ")\\b[^>]*>"
_TAG_RE = "<[^>]*>"
_TITLE_RE = "(?is)<title[^>]*>(.*?)</title\\s*>"
_EDGE_RE = "^[ \\t\\r]+|[ \\t\\r]+\\z"


def _pages_sql() -> list[str]:
    title = (f"regexp_replace({_unesc(f'regexp_extract(html, {S.q(_TITLE_RE)}, 1)')}, "
             f"{S.q(_EDGE_RE)}, '', 'g')")
    t = f"regexp_replace(html, {S.q(_DROP_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {S.q(_BLOCK_RE)}, {S.NL}, 'g')"
    t = f"regexp_replace({t}, {S.q(_TAG_RE)}, '', 'g')"
    t = _unesc(t)
    body = (f"list_filter(list_transform(string_split({t}, {S.NL}), lambda s: regexp_replace(s, {S.q(_EDGE_RE)}, '', 'g')),"
            f" lambda s: s <> '')")
    arr = ("list_concat(['<doc id=\"' || CAST(page_id AS VARCHAR) || '\" url=\"' || url || '\" title=\"' || title || '\">',"
           f" title, ''], body, ['</doc>'])")
    return [
        f"pg AS (SELECT page_id, url, {title} AS title, {body} AS body FROM pages)",
        S.explode_lines("pg", "page_id", arr, "raw"),
    ]


def _unesc(e: str) -> str:
    for k, v in _ENTITIES:
        e = f"replace({e}, {S.q(k)}, {S.q(v)})"
    return e


@register("a10_extract_pages", with_ctes(_pages_sql(), "SELECT * FROM raw"))
def a10_extract_pages(spark, sf):
    return src.extract_pages(T(spark, sf, "pages"))


@register("c1_c3_first_pass", with_ctes(_pages_sql() + S.first_pass("raw", "p1"), "SELECT * FROM p1"))
def c1_c3_first_pass(spark, sf):
    return clean.first_pass(src.extract_pages(T(spark, sf, "pages")))


@register("c4_c8_clean_corpus",
          with_ctes(_pages_sql() + S.first_pass("raw", "p1") + S.sentence_split("p1", "p2", DELIMS), "SELECT * FROM p2"))
def c4_c8_clean_corpus(spark, sf):
    return clean.clean_corpus(src.extract_pages(T(spark, sf, "pages")), DELIMS)


@register("c5_c8_documents", with_ctes([S.doc_lines("dl"), *S.sentence_split("dl", "cl", DELIMS)], "SELECT * FROM cl"))
def c5_c8_documents(spark, sf):
    return doc_corpus(spark, sf)


@register("c9_strip_unicode", with_ctes([S.doc_lines("l", doc_break=False)],
                                        f"SELECT part, line_no, {S.strip('line')} AS stripped FROM l"))
def c9_strip_unicode(spark, sf):
    lines = src.lines_from_table(T(spark, sf, "documents"), "doc_id", "text", doc_break=False)
    return lines.select("part", "line_no", strip_unicode("line").alias("stripped"))


@register("c10_translate_controls",
          "SELECT doc_id, replace(replace(replace(text, chr(10), ''), chr(9), '　'), chr(13), '') AS text FROM documents")
def c10_translate_controls(spark, sf):
    return T(spark, sf, "documents").select("doc_id", translate_controls("text").alias("text"))


_BODY_SQL = (
    "array_to_string(list_filter(list_transform(list_slice(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 3, 2147483647),"
    f" lambda s: {S.strip('s')}), lambda s: s <> ''), '')"
)


@register("c11_article_body", f"SELECT doc_id, {_BODY_SQL} AS body FROM documents")
def c11_article_body(spark, sf):
    return T(spark, sf, "documents").select("doc_id", src.article_body(F.col("text")).alias("body"))


@register("c12_decode_utf8", "SELECT doc_id, text FROM documents")
def c12_decode_utf8(spark, sf):
    d = T(spark, sf, "documents")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return d.select("doc_id", decode_utf8(raw).alias("text"))


_INFER_SQL = """
WITH kv AS (
  SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS v FROM events
  UNION ALL SELECT event_id, 'event_type', event_type FROM events)
SELECT event_id, field,
  CASE WHEN regexp_matches(v, '^\\p{L}+$') THEN 'str' WHEN regexp_matches(v, '^[0-9]+$') THEN 'int' ELSE 'float' END AS kind,
  CASE WHEN regexp_matches(v, '^\\p{L}+$') THEN v END AS str_value,
  CASE WHEN NOT regexp_matches(v, '^\\p{L}+$') AND regexp_matches(v, '^[0-9]+$') THEN CAST(v AS BIGINT) END AS int_value,
  CASE WHEN NOT regexp_matches(v, '^\\p{L}+$') AND NOT regexp_matches(v, '^[0-9]+$') THEN CAST(v AS DOUBLE) END AS float_value
FROM kv"""


@register("c13_infer_value", _INFER_SQL)
def c13_infer_value(spark, sf):
    ev = T(spark, sf, "events")
    kv = ev.select("event_id", F.lit("k").alias("field"), F.get_json_object("props", "$.k").alias("v")).unionByName(
        ev.select("event_id", F.lit("event_type").alias("field"), F.col("event_type").alias("v"))
    )
    return kv.select("event_id", "field", infer_value("v").alias("t")).select("event_id", "field", "t.*")


# --- A2 / G2 ------------------------------------------------------------------------

@register("a2_labelled_folders",
          "SELECT source AS label, source || '-' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, text AS content "
          "FROM documents WHERE starts_with(source || '-' || CAST(doc_id AS VARCHAR) || '.txt', source)")
def a2_labelled_folders(spark, sf):
    """Files ``{source}/{source}-{doc_id}.txt`` on disk, read back by folder."""
    files = src.labelled_files_from_table(T(spark, sf, "documents"), "source", "doc_id", "text")
    return src.read_labelled_folders(spark, write_labelled_folders(files, spark, scratch_path(spark, "folders")))


@register("g2_labelled_table",
          "SELECT source AS label, source || '-' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, "
          f"replace(replace(replace({_BODY_SQL}, chr(10), ''), chr(9), '　'), chr(13), '') AS text FROM documents")
def g2_labelled_table(spark, sf):
    return src.labelled_texts(src.labelled_files_from_table(T(spark, sf, "documents"), "source", "doc_id", "text"))


# --- A6 -----------------------------------------------------------------------------

_PAIR_LINES_SQL = """pl AS (
  SELECT conv_id AS line_no, string_agg(replace(text, chr(10), ' '), ' ||| ' ORDER BY turn) AS line
  FROM conversations GROUP BY conv_id)"""


def pair_lines(spark, sf) -> DataFrame:
    """One input line per conversation: its turns joined by the pair delimiter."""
    c = T(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "\n", " ").alias("t"))))
    return c.groupBy(F.col("conv_id").alias("line_no")).agg(
        F.array_join(F.transform(turns, lambda s: s["t"]), " ||| ").alias("line")
    )


@register("a6_read_pairs", with_ctes([_PAIR_LINES_SQL], f"""SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS unique_id,
  CASE WHEN regexp_matches(s, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(s, '^(.*) \\|\\|\\| (.*)$', 1) ELSE s END AS text_a,
  CASE WHEN regexp_matches(s, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(s, '^(.*) \\|\\|\\| (.*)$', 2) END AS text_b
FROM (SELECT line_no, {S.strip('line')} AS s FROM pl) _p"""))
def a6_read_pairs(spark, sf):
    return src.read_pairs(spark, line_files(spark, pair_lines(spark, sf), ["line_no"], "pairs"))


# --- D ------------------------------------------------------------------------------

_SENTS = S.clean_doc_sentences("sents", DELIMS)


@register("d1_d2_documents", with_ctes(_SENTS, "SELECT doc_key, sent_no, sentence, tokens, n_tokens FROM sents"))
def d1_d2_documents(spark, sf):
    return numbered_sentences(spark, sf).select("doc_key", "sent_no", "sentence", "tokens", "n_tokens")


_DOCS_SQL = _SENTS + [
    f"""docs AS (
  SELECT doc_key, count(*) AS n_sent, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM sents GROUP BY doc_key)""",
    f"""idx AS (
  SELECT *, CAST(row_number() OVER (ORDER BY {S.sort_key(SEED, 'doc', 'doc_key')}, doc_key) - 1 AS BIGINT) AS doc_index
  FROM docs)""",
]


@register("d3_index_documents", with_ctes(_DOCS_SQL, "SELECT doc_key, n_sent, n_tokens, doc_index FROM idx"))
def d3_index_documents(spark, sf):
    return documents.index_documents(cut_lineage(documents.document_table(numbered_sentences(spark, sf))), SEED)


@register("d4_duplicate", with_ctes(_DOCS_SQL, "SELECT doc_index, CAST(r AS INTEGER) AS rep FROM idx, range(5) t(r)"))
def d4_duplicate(spark, sf):
    docs = documents.index_documents(cut_lineage(documents.document_table(numbered_sentences(spark, sf))), SEED)
    return documents.duplicate(docs.select("doc_index"), 5)


@register("d5_shuffle", with_ctes(_SENTS, f"""SELECT doc_key, sent_no,
  CAST(row_number() OVER (ORDER BY {S.sort_key(SEED, 'shuffle', 'doc_key', 'sent_no')}, doc_key, sent_no) - 1 AS BIGINT) AS position
FROM sents"""))
def d5_shuffle(spark, sf):
    s = written(numbered_sentences(spark, sf).select("doc_key", "sent_no"), "numbers")
    keyed = s.withColumn("_h", documents.shuffle_key(SEED, F.col("doc_key"), F.col("sent_no")))
    return dense_index_by_hash(keyed, "_h", "position", ["doc_key", "sent_no"]).drop("_h")


# --- E ------------------------------------------------------------------------------

_VOCAB_SQL = _SENTS + S.word_vocab("sents", "vocab", VOCAB_SIZE)


@register("e1a_word_counts", with_ctes(_SENTS + S.word_vocab("sents", "vocab", VOCAB_SIZE),
                                       "SELECT piece AS word, n FROM vocab_wc"))
def e1a_word_counts(spark, sf):
    return corpus_words(spark, sf)


@register("e1b_candidate_substrings", with_ctes(_VOCAB_SQL, """SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT substring(w, i, L) AS piece, n FROM (
    SELECT w, n, i, unnest(generate_series(1, least(16, length(w) - i + 1))) AS L FROM (
      SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM (SELECT '▁' || piece AS w, n FROM vocab_wc) _a) _b) _c) _d
GROUP BY piece"""))
def e1b_candidate_substrings(spark, sf):
    return vocab.candidate_substrings(corpus_words(spark, sf), max_len=16)


PIECE_CHARS, PIECES = 8, 4000

_BEST_SQL = "WITH RECURSIVE " + ",\n".join(_VOCAB_SQL + [
    "wd AS (SELECT '▁' || piece AS w, n FROM vocab_wc)",
    f"""occ AS MATERIALIZED (SELECT w, n, i - 1 AS s, L, substring(w, i, L) AS piece FROM (
  SELECT w, n, i, unnest(generate_series(1, least({PIECE_CHARS}, length(w) - i + 1))) AS L FROM (
    SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM wd) _a) _b)""",
    "su AS (SELECT piece, sum(n) AS n FROM occ GROUP BY piece)",
    f"""pc AS (SELECT piece, n FROM su WHERE length(piece) = 1 UNION ALL (
  SELECT piece, n FROM su WHERE length(piece) > 1 ORDER BY n * length(piece) DESC, piece LIMIT {PIECES}))""",
    "sc AS (SELECT piece, floor(1000 * ln(n / (SELECT CAST(sum(n) AS DOUBLE) FROM pc))) AS score FROM pc)",
    "ed AS MATERIALIZED (SELECT w, s, s + L AS t, score FROM occ JOIN sc USING (piece))",
    """dp AS (SELECT w, 0 AS k, [CAST(0 AS DOUBLE)] AS best FROM wd UNION ALL
  SELECT d.w, d.k + 1, list_append(any_value(d.best), max(d.best[e.s + 1] + e.score))
  FROM dp d JOIN ed e ON e.w = d.w AND e.t = d.k + 1 GROUP BY d.w, d.k)""",
]) + "\nSELECT substring(w, 2) AS word, CAST(best[k + 1] AS BIGINT) AS score FROM dp WHERE k = length(w)"


@register("e3_best_scores", _BEST_SQL)
def e3_best_scores(spark, sf):
    """Score of the best segmentation of every word of the corpus, from its tokens (E3): the pieces are all
    characters and the substrings of greatest count times length, at the logarithm of their share in
    thousandths."""
    words = cut_lineage(corpus_words(spark, sf))
    every = cut_lineage(vocab.candidate_substrings(words, PIECE_CHARS))
    multi = every.where(F.length("piece") > 1).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(PIECES)
    pieces = cut_lineage(every.where(F.length("piece") == 1).unionByName(multi))
    total = float(pieces.agg(F.sum("n")).first()[0] or 1)
    scores = pieces.select("piece", F.floor(F.lit(1000) * F.log(F.col("n") / F.lit(total))).alias("score"))
    tokens = words.select("word", F.explode(vocab.tokenize_subword(F.col("word"), scores, normalize=False)).alias("piece"))
    return tokens.join(scores, "piece").groupBy("word").agg(F.sum("score").cast("long").alias("score"))


@register("e2_assign_ids", with_ctes(_VOCAB_SQL, "SELECT piece, score, id FROM vocab"))
def e2_assign_ids(spark, sf):
    return doc_vocab(spark, sf)


_IDS_SQL = _VOCAB_SQL + [S.ids_of("sents", ["doc_key", "sent_no"], "tokens", "vocab", "ids", "sids")]


@register("e4_tokens_to_ids", with_ctes(_IDS_SQL, "SELECT doc_key, sent_no, ids FROM sids"))
def e4_tokens_to_ids(spark, sf):
    s = doc_sentences(spark, sf, SENTENCE_TOKENS)
    v = doc_vocab(spark, sf, s)
    return s.select("doc_key", "sent_no", vocab.tokens_to_ids(F.col("tokens"), v).alias("ids"))


_TOKS_SQL = """SELECT s.doc_key, s.sent_no,
  list_transform(s.ids, lambda i: coalesce((SELECT piece FROM inv WHERE inv.id = i), '<unk>')) AS tokens
FROM sids s"""


@register("e5_ids_to_tokens", with_ctes(_IDS_SQL + ["inv AS (SELECT max(id) AS id, piece FROM vocab GROUP BY piece)"],
                                        """SELECT e.doc_key, e.sent_no, list(coalesce(inv.piece, '<unk>') ORDER BY e.pos) AS tokens
FROM (SELECT doc_key, sent_no, pos, ids[pos] AS i FROM (SELECT doc_key, sent_no, ids, unnest(generate_series(1, len(ids))) AS pos FROM sids) _a) e
LEFT JOIN inv ON inv.id = e.i GROUP BY e.doc_key, e.sent_no"""))
def e5_ids_to_tokens(spark, sf):
    s = doc_sentences(spark, sf, SENTENCE_TOKENS)
    d = vocab.vocab_dict(doc_vocab(spark, sf, s))
    return s.select("doc_key", "sent_no", vocab.ids_to_tokens(vocab.tokens_to_ids(F.col("tokens"), d), d).alias("tokens"))


@register("e6_invert_vocab", with_ctes(_VOCAB_SQL, "SELECT CAST(max(id) AS INTEGER) AS id, piece FROM vocab GROUP BY piece"))
def e6_invert_vocab(spark, sf):
    return vocab.invert_vocab(doc_vocab(spark, sf))


@register("e7_round_trip", with_ctes(_VOCAB_SQL + ["vp AS (SELECT DISTINCT piece FROM vocab)"], """SELECT doc_key, sent_no,
  CAST(sum(CASE WHEN vp.piece IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
  CAST(count(*) AS BIGINT) AS n_tokens
FROM (SELECT doc_key, sent_no, unnest(tokens) AS tok FROM sents) t LEFT JOIN vp ON vp.piece = t.tok
GROUP BY doc_key, sent_no"""))
def e7_round_trip(spark, sf):
    """Tokens -> ids -> tokens; a token survives unless it is out of the vocabulary."""
    s = doc_sentences(spark, sf, SENTENCE_TOKENS)
    d = vocab.vocab_dict(doc_vocab(spark, sf, s))
    back = s.select("doc_key", "sent_no", "tokens", vocab.ids_to_tokens(vocab.tokens_to_ids(F.col("tokens"), d), d).alias("back"))
    diff = F.zip_with("tokens", "back", lambda a, b: F.when(a != b, 1).otherwise(0))
    return back.select(
        "doc_key", "sent_no",
        F.aggregate(diff, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_unknown"),
        F.size("tokens").cast("long").alias("n_tokens"),
    )


_VOCAB_LINES_SQL = f"""vl AS (
  SELECT CAST(row_number() OVER (ORDER BY part, line_no, pos) - 1 AS BIGINT) AS line_no, w || chr(9) || '0' AS line
  FROM (SELECT part, line_no, pos, ws[pos] AS w FROM (SELECT part, line_no, ws, unnest(generate_series(1, len(ws))) AS pos
    FROM (SELECT part, line_no, {S.ws_tokens('line')} AS ws FROM dl) _a) _b) _c)"""


def vocab_file_lines(spark, sf) -> DataFrame:
    """A vocabulary file made from the corpus: a line for every word of every text with
    score 0, in corpus order; words repeat, so later lines win. The texts' lines are put in order
    before they are cut into words, so that no word is shuffled; equal keys are left together."""
    from ..functions.text import ws_tokens

    lines = src.lines_from_table(T(spark, sf, "documents"), "doc_id", "text", doc_break=False)
    lines = lines.select("part", "line_no", "line").repartitionByRange("part", "line_no")
    words = lines.select("part", "line_no", F.posexplode(ws_tokens(F.col("line"))).alias("pos", "w"))
    return words.select("part", "line_no", "pos", F.concat("w", F.lit("\t0")).alias("line"))


@register("a5_read_vocab", with_ctes([S.doc_lines("dl", doc_break=False), _VOCAB_LINES_SQL], f"""SELECT piece, CAST(max(id) AS INTEGER) AS id FROM (
  SELECT {S.strip("split_part(line, chr(9), 1)")} AS piece, line_no AS id FROM vl) _v GROUP BY piece"""))
def a5_read_vocab(spark, sf):
    path = line_files(spark, vocab_file_lines(spark, sf), ["part", "line_no", "pos"], "vocab", ranged=True)
    return vocab.invert_vocab(tables.read_vocab(spark, path)).select("piece", "id")
