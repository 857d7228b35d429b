"""DuckDB SQL text for the oracles: common table expressions mirroring the Spark
operators step by step. Each function returns ``name AS (...)`` fragments."""

from __future__ import annotations

from ..functions.rng import sql_sort_key, sql_u
from ..functions.text import UNICODE_SPACE_CLASS, WS_SPLIT
from ..operators.vocab import RESERVED

STRIP_SQL = f"^{UNICODE_SPACE_CLASS}+|{UNICODE_SPACE_CLASS}+\\z"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(STRIP_SQL)}, '', 'g')"


def ws_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), {q(WS_SPLIT)}), lambda t: t <> '')"


def explode_lines(src: str, key: str, arr_expr: str, name: str) -> str:
    """Rows (part, file, line_no, line) from a list column, 0-based positions."""
    return f"""{name} AS (
  SELECT CAST(part AS BIGINT) AS part, '' AS file, CAST(i - 1 AS BIGINT) AS line_no, arr[i] AS line
  FROM (SELECT part, arr, unnest(generate_series(1, len(arr))) AS i
        FROM (SELECT {key} AS part, {arr_expr} AS arr FROM {src}) _a) _b)"""


def doc_lines(name: str = "doc_lines", doc_break: bool = True) -> str:
    arr = f"string_split(text, {NL})"
    if doc_break:
        arr = f"list_append({arr}, '')"
    return explode_lines("documents", "doc_id", arr, name)


def sentence_split(src: str, name: str, delims: str, closers: str = "」|)）\"") -> list[str]:
    """C4-C7 + C8 + renumber over a line CTE."""
    d = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in delims)
    k = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in closers)
    brk = f"regexp_replace(regexp_replace(line, ' +\\z', '', 'g'), {q(f'([{d}])([^{k}])')}, '\\1' || {NL} || '\\2', 'g')"
    buf = f"regexp_replace({brk}, '^ +', '', 'g')"
    starts = " OR ".join(f"starts_with(line, {q(ch)})" for ch in delims)
    return [
        f"""{name}_x AS (
  SELECT part, file, line_no, CAST(i - 1 AS BIGINT) AS sub_no, arr[i] AS line
  FROM (SELECT part, file, line_no, arr, unnest(generate_series(1, len(arr))) AS i
        FROM (SELECT part, file, line_no, string_split({buf}, {NL}) AS arr FROM {src}) _a) _b)""",
        f"""{name} AS (
  SELECT part, file, CAST(row_number() OVER (PARTITION BY part, file ORDER BY line_no, sub_no) - 1 AS BIGINT) AS line_no,
         lower(line) AS line
  FROM {name}_x WHERE NOT ({starts}))""",
    ]


def first_pass(src: str, name: str) -> list[str]:
    """C1-C3 by islands: lines left by C1 are numbered, consecutive ``<doc id`` lines form an
    island (their number less their rank among such lines is constant), and the odd members of an
    island open a range of two lines."""
    return [
        f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY part, file ORDER BY line_no) AS n FROM {src} WHERE line <> '')""",
        f"""{name}_h AS (SELECT part, file, n, n - row_number() OVER (PARTITION BY part, file ORDER BY n) AS island
  FROM {name}_n WHERE contains(line, '<doc id'))""",
        f"""{name}_o AS (SELECT part, file, n FROM (SELECT part, file, n,
  row_number() OVER (PARTITION BY part, file, island ORDER BY n) AS k FROM {name}_h) _k WHERE k % 2 = 1)""",
        f"""{name}_d AS (SELECT part, file, n FROM {name}_o UNION SELECT part, file, n + 1 FROM {name}_o)""",
        f"""{name} AS (SELECT l.part, l.file, l.line_no, replace(l.line, '</doc>', '') AS line FROM {name}_n l
  LEFT JOIN {name}_d d ON d.part = l.part AND d.file = l.file AND d.n = l.n WHERE d.n IS NULL)""",
    ]


def to_documents(src: str, name: str) -> list[str]:
    """D1 + D2 + sentence numbers: (doc_key, sent_no, part, file, line_no, sentence, tokens, n_tokens)."""
    return [
        f"""{name}_s AS (
  SELECT part, file, line_no, {strip('line')} AS sentence FROM {src})""",
        f"""{name}_b AS (
  SELECT *, CAST(sentence = '' AS BIGINT) AS blank,
         sum(CAST(sentence = '' AS BIGINT)) OVER (PARTITION BY part, file ORDER BY line_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM {name}_s)""",
        f"""{name}_fo AS (
  SELECT part, file, coalesce(sum(nb) OVER (ORDER BY part, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT part, file, sum(blank) AS nb FROM {name}_b GROUP BY part, file) _f)""",
        f"""{name}_t AS (
  SELECT CAST(o.off + b.cum AS BIGINT) AS doc_key, b.part, b.file, b.line_no, b.sentence,
         {ws_tokens('b.sentence')} AS tokens
  FROM {name}_b b JOIN {name}_fo o USING (part, file))""",
        f"""{name} AS (
  SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY part, file, line_no) - 1 AS BIGINT) AS sent_no,
         part, file, line_no, sentence, tokens, CAST(len(tokens) AS INTEGER) AS n_tokens
  FROM {name}_t WHERE len(tokens) > 0)""",
    ]


def clean_doc_sentences(name: str = "sents", delims: str = ".!?") -> list[str]:
    """documents -> lines with a document break -> C4-C8 -> D1/D2."""
    return [doc_lines("dl"), *sentence_split("dl", "cl", delims), *to_documents("cl", name)]


def reserved_values() -> str:
    rows = ", ".join(f"({q(p)}, 0.0, {i})" for i, p in enumerate(RESERVED))
    return f"(VALUES {rows})"


def word_vocab(src_sentences: str, name: str, size: int) -> list[str]:
    """E1a + E2 over a sentence CTE with a ``sentence`` column."""
    k = size - len(RESERVED)
    res = ", ".join(q(p) for p in RESERVED)
    return [
        f"""{name}_wc AS (
  SELECT w AS piece, count(*) AS n FROM (SELECT unnest({ws_tokens('sentence')}) AS w FROM {src_sentences}) _w GROUP BY w)""",
        f"""{name} AS (
  SELECT CAST(p AS VARCHAR) AS piece, CAST(s AS DOUBLE) AS score, CAST(i AS INTEGER) AS id FROM {reserved_values()} r(p, s, i)
  UNION ALL
  SELECT piece, CAST(n AS DOUBLE), CAST(rn - 1 + {len(RESERVED)} AS INTEGER) FROM (
    SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS rn FROM {name}_wc WHERE piece NOT IN ({res})) _r
  WHERE rn <= {k})""",
    ]


def ids_of(src: str, key_cols: list[str], tokens: str, vocab: str, out: str, name: str) -> str:
    """Ordered id list per row via unnest + left join + ordered list()."""
    keys = ", ".join(key_cols)
    ekeys = ", ".join(f"e.{k}" for k in key_cols)
    return f"""{name} AS (
  SELECT {ekeys}, list(coalesce(v.id, 0) ORDER BY e.pos) AS {out}
  FROM (SELECT {keys}, pos, _arr[pos] AS tok
        FROM (SELECT {keys}, _arr, unnest(generate_series(1, len(_arr))) AS pos
              FROM (SELECT {keys}, {tokens} AS _arr FROM {src}) _a) _b) e
  LEFT JOIN (SELECT piece, max(id) AS id FROM {vocab} GROUP BY piece) v ON v.piece = e.tok
  GROUP BY {ekeys})"""


def u(seed, purpose: str, *keys: str) -> str:
    return sql_u(seed, purpose, *keys)


def sort_key(seed, purpose: str, *keys: str) -> str:
    return sql_sort_key(seed, purpose, *keys)
