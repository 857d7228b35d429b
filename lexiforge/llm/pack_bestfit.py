"""Best-fit-decreasing packing of token sequences (operator 7).

Documents are tokenised in Arrow batches; longer ones than a sequence are cut so that only
the first piece is shorter. Best-fit decreasing looks at nothing but lengths, and lengths
are whole numbers up to the capacity, so the plan is made from the histogram of lengths (at
most ``capacity`` rows, whatever the input): lengths come in falling order, and a segment
tree over remaining capacities finds the tightest open bin in logarithmic time. Bins of
equal content are kept as one run, so a run of documents of one length is placed by one
search for each run of bins that it meets; the packing is the one that document by document
best fit gives. The plan has a row for each run and slot; pieces are numbered within
their length by running sums over nested hash ranges (no task holds a length) and find
their place by a join on (length, run).

Defined results: null text is empty and is one piece, the end id alone; a repeated row is a
piece of its own, placed like any other; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, running_sums, scratch_path

CAPACITY = 2048
END_ID = 0
#: Cached chunks per worker; the cache is emptied when it is full.
CACHE = 150_000

_ENCODERS: dict[str, "Encoder"] = {}


#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to those of the ``tokenizers``
    file (a byte-level BPE whose ids follow its merges). ``encode`` takes the file's added tokens
    in a text as text, ``encode_added`` gives them their own ids, as the file's defaults do.

    The vocabulary's pre-tokenizer never joins a space to what stands before it unless that
    is white space too, so a text may be cut before every space that follows
    something else, and the ids of a chunk (a word with its space and punctuation) are
    looked up in a cache. Chunks that it lacks are encoded from the same merges by a
    library that is faster on short strings.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        added = {a["content"]: a for a in file.get("added_tokens", [])}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added.values()):
            raise ValueError(f"{path}: added tokens that take in what is around them")
        self.added = {c: struct.pack("<I", a["id"]) for c, a in added.items()}
        # The longest first: of tokens that start at one place it is the one that is matched.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # Byte-level files write each byte as a printable character.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merged)):
            raise ValueError(f"{path}: ids do not follow the merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        if SPACES.search(text) is None and "\0" not in text:
            return text.replace(" ", "\0 ").split("\0")
        parts = SINGLE.split(text) if SPACES.search(text) else text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def long_ids(self, chunk: str) -> list[int]:
        """Ids of a long chunk. The pattern takes a run of white space up to its last character (all of it at the
        end) as one piece, but its engine's stack grows with the run, so long runs are cut out by the same rule
        and encoded as the one piece that they are."""
        out, at = [], 0
        for run in LONG_SPACE.finditer(chunk):
            stop = run.end() if run.end() == len(chunk) else run.end() - 1
            out += self.bpe.encode_ordinary(chunk[at : run.start()])
            out += self.bpe._encode_single_piece(chunk[run.start() : stop])
            at = stop
        return out + self.bpe.encode_ordinary(chunk[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.chunks(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        known, ids = self.cache, self.bpe.encode_ordinary
        for c in {c for part in lists for c in part if c not in known}:
            new = ids(c) if len(c) < LONG_RUN else self.long_ids(c)
            known[c] = PACK[len(new)](*new) if len(new) < len(PACK) else struct.pack(f"<{len(new)}I", *new)
        return [b"".join([known[c] for c in part]) for part in lists]

    def encode_added(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self.encode(texts)
        parts = [self.split.split(t) if self.split.search(t) else [t] for t in texts]
        between = iter(self.encode([p for part in parts for p in part[::2]]))
        return [b"".join([self.added[p] if i % 2 else next(between) for i, p in enumerate(part)]) for part in parts]


SPACES = re.compile(r"\s ")
LONG_RUN = 4096
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]  # by the number of ids
#: A long run of what the pattern's engine takes for white space (the Unicode property).
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
SINGLE = re.compile(r"(?<=\S) (?=\S)")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        yield from cut_with(enc, batches)
        enc.cache.clear()
        release()

    def cut_with(enc: Encoder, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if t is not None else "" for t in b["text"]]
            at = 0
            while at < len(texts):  # some MB of text at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1_000_000):
                    size += len(texts[to])
                    to += 1
                out: list[tuple] = []
                for doc, raw in zip(b["doc_id"].iloc[at:to], enc.encode_added(texts[at:to])):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for i, (s, e) in enumerate(zip(bounds, bounds[1:])):
                        out.append((doc, i, s, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = to

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES.format(id=id_type))


class TightestFit:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the runs of open
    bins with that much left. ``find(n)`` is the smallest capacity >= n with an open bin."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, left: int) -> None:
        at = self.size + left
        self.any[at] = bool(self.runs[left])
        at //= 2
        while at:
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]
            at //= 2

    def push(self, left: int, first: int, count: int) -> None:
        self.runs[left].append((first, count))
        self._mark(left)

    def pop(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run

    def find(self, least: int) -> int | None:
        at = self.size + least
        if at >= 2 * self.size:
            return None
        if self.any[at]:
            return least
        while at > 1:  # up until a right sibling holds something, then down its left edge
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``histogram`` (length -> pieces) as runs
    (length, first rank, count, first bin, offset): the pieces of that length with ranks
    [first, first + count) go to the bins from ``first bin`` on, one each, at ``offset``."""
    tree, out, bins = TightestFit(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.find(length)
            if room is None:
                room, first, count = capacity, bins, left
            else:
                first, count = tree.pop(room)
            # A bin that took one piece and has room for another is the tightest then: bins
            # fill up with this length one after the other, the last one perhaps in part.
            per = room // length
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            for k, n, at in ((per, full, first), (min(rest, per), 1, first + full)):
                for j in range(k if n else 0):
                    out.append((length, rank, n, at, capacity - room + j * length))
                    rank, left = rank + n, left - n
                if k and n and room - k * length:
                    tree.push(room - k * length, at, n)
            used = full + (rest > 0)
            if first == bins and room == capacity:
                bins += used
            elif used < count:
                tree.push(room, first + used, count - used)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with doc_id, piece, length) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    counts = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    runs = plan({r["length"]: r["n"] for r in counts}, capacity)
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "first", "count", "bin", "offset")])
    table = spark.createDataFrame(runs, schema)
    digest = F.xxhash64("doc_id", "piece", "ids_crc32")
    unit = F.shiftrightunsigned(digest, 11).cast("double") / F.lit(float(2**53))
    x = parts.withColumn("_u", unit).withColumn("_one", F.lit(1).cast("long"))
    x = running_sums(x, ["length"], "_u", ["doc_id", "piece"], "_one", "_rank").drop("_u", "_one")
    # A run covers ranks [first, first + count): found by blocks of ranks, so the join has an
    # equality key and a run meets only the blocks that it covers.
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("count") - 1) / BLOCK))
    t = table.withColumn("_block", F.explode(blocks))
    x = x.withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    hit = (F.col("l.length") == F.col("r.length")) & (F.col("l._block") == F.col("r._block")) \
        & (F.col("l._rank") >= F.col("r.first")) & (F.col("l._rank") < F.col("r.first") + F.col("r.count"))
    keep = [F.col(f"l.{c}") for c in x.columns if c not in ("_block", "_rank")]
    return x.alias("l").join(t.alias("r"), hit).select(
        *keep, (F.col("r.bin") + F.col("l._rank") - F.col("r.first")).alias("sequence_id"), F.col("r.offset").alias("offset"))


#: Ranks per block of the join of pieces and runs.
BLOCK = 256


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, capacity, end_id).write.parquet(path)
    return pack(spark.read.parquet(path), capacity)
