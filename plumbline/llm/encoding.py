"""Encoding a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation uses no regular expression. The texts of an Arrow batch become
one array of code points and one of character classes. A small automaton says at
which characters a piece starts; each character is a function from state to state,
composing such functions is associative, and a blocked scan over the compositions
gives the state before every character without a loop over characters. The pieces
between the starts are merged pair by rank and cached; their offsets decode back.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import table

DEFAULT_FOLDER = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
BLOCK = 128
#: Pieces whose ids a worker remembers, and the longest piece it remembers.
CACHE_PIECES, CACHE_CHARS = 200_000, 64

# character classes; END stands after each text, A2 and A3 are apostrophes that open "'s" or "'re"
OTHER, LETTER, NUMBER, SPACE, BLANK, A2, A3, END = range(8)
# states: what the piece before is made of; FRESH: the next character starts a piece
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, ONE_MORE, TWO_MORE, FRESH = range(7)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[class, state]`` and ``starts[class, state]``."""
    step = np.full((8, 7), FRESH, np.uint8)
    starts = np.zeros((8, 7), bool)
    for state in range(7):
        for kind, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            step[kind, state] = own
            starts[kind, state] = state not in (own, AFTER_SPACE)
        for kind, more in ((A2, ONE_MORE), (A3, TWO_MORE)):
            joins = state in (IN_OTHERS, AFTER_SPACE)
            step[kind, state] = IN_OTHERS if joins else more
            starts[kind, state] = not joins
        step[SPACE, state] = AFTER_SPACE
    for kind in (LETTER, NUMBER, OTHER):
        step[kind, ONE_MORE], step[kind, TWO_MORE] = FRESH, ONE_MORE
        starts[kind, ONE_MORE] = starts[kind, TWO_MORE] = False
    return step, starts


STEP, STARTS = _automaton()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point; the last entry is for the text end."""
    out = np.full(0x110001, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    blanks = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[blanks] = BLANK
    out[0x20], out[0x110000] = SPACE, END
    return out


def _scan(kinds: np.ndarray) -> np.ndarray:
    """The state before each character, by a blocked scan over composed transition functions."""
    n = len(kinds)
    width = -(-n // BLOCK) or 1
    padded = np.full(width * BLOCK, END, np.uint8)
    padded[:n] = kinds
    grid = padded.reshape(width, BLOCK)
    rows = np.arange(width)[:, None]
    # each block as one function: all states pushed through its characters
    total = np.tile(np.arange(7, dtype=np.uint8), (width, 1))
    for j in range(BLOCK):
        total = STEP[grid[:, j][:, None], total]
    # inclusive scan of the block functions, then the state that enters each block
    reach = 1
    while reach < width:
        later = total.copy()
        later[reach:] = total[reach:][rows[: width - reach], total[: width - reach]]
        total, reach = later, reach * 2
    state = np.full(width, FRESH, np.uint8)
    state[1:] = total[:-1, FRESH]
    before = np.empty((width, BLOCK), np.uint8)
    for j in range(BLOCK):
        before[:, j] = state
        state = STEP[grid[:, j], state]
    return before.reshape(-1)[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts, for code points with 0x110000 after each text."""
    kinds = _classes()[points]
    ahead = lambda k: np.concatenate([points[k:], np.full(min(k, len(points)), 0x110000, points.dtype)])
    n1, n2 = ahead(1), ahead(2)
    mark = points == 0x27
    short = mark & np.isin(n1, [ord(c) for c in "stmd"])
    pair = (n1 == ord("r")) & (n2 == ord("e")) | (n1 == ord("v")) & (n2 == ord("e")) | (n1 == ord("l")) & (n2 == ord("l"))
    kinds = np.where(short, np.uint8(A2), np.where(mark & pair, np.uint8(A3), kinds))
    starts = STARTS[kinds, _scan(kinds)]
    white = (kinds == SPACE) | (kinds == BLANK)
    prev = np.concatenate([[False], white[:-1]])
    nxt = np.concatenate([white[1:], [False]])
    nxt_end = np.concatenate([kinds[1:] == END, [True]])
    # white space is a piece up to its last character, which goes with what follows or stands alone
    starts[white] = (~prev | (~nxt & ~nxt_end))[white]
    starts[kinds == END] = True
    return starts


class Vocabulary:
    """The ranks of a ``.tiktoken`` file, and pair merging by them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.cache: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        """The ids of one piece."""
        got = self.cache.get(piece)
        if got is None:
            got = self._merge(piece.encode("utf-8"))
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = got
        return got

    def _merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        # a heap of mergeable pairs over a linked list: n log n, also for very long pieces
        part = [raw[i : i + 1] for i in range(len(raw))]
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap = [(r, i) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        end = len(part)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if part[i] else end
            if j >= end or not part[i] or ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], b""
            right[i] = right[j]
            if right[i] < end:
                left[right[i]] = i
                if (s := ranks.get(part[i] + part[right[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            h = left[i]
            if h >= 0 and (s := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [ranks[p] for p in part if p]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary, read once."""
    return Vocabulary(path)


def encode_texts(texts: list[str | None], voc: Vocabulary) -> tuple[list[list[int]], list[list[int]]]:
    """For each text its ids, and for each id-bearing piece its start in code points. Null and empty texts give empty lists."""
    ids: list[list[int]] = [[] for _ in texts]
    offsets: list[list[int]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        # so many texts at a time that the arrays stay small, one at least
        group, size = [], 0
        while at < len(texts) and (not group or size < 1 << 19):
            group.append(at)
            size += len(texts[at] or "")
            at += 1
        joined = []
        for i in group:
            joined += [np.frombuffer((texts[i] or "").encode("utf-32-le"), np.uint32), np.array([0x110000], np.uint32)]
        points = np.concatenate(joined)
        marks = np.flatnonzero(piece_starts(points))
        base = k = 0
        for i in group:
            text = texts[i] or ""
            out, off = ids[i], offsets[i]
            end = base + len(text)
            while marks[k] < end:
                s, e = int(marks[k]) - base, int(marks[k + 1]) - base
                out.extend(voc.ids(text[s:e]))
                off.append(s)
                k += 1
            k += 1
            base = end + 1
    return ids, offsets


def encode(df: DataFrame, id_col: str, text_col: str, path: str, offsets: bool = False) -> DataFrame:
    """``id_col`` and ``ids``, with ``offsets`` also the code point at which each piece starts.

    Null and empty texts have an empty list of ids. No special tokens are added, and
    their strings in a text are ordinary text. ``path`` is read by every worker.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        voc = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, offs = encode_texts(part.column(1).to_pylist(), voc)
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
                columns += [pa.array(offs, pa.list_(pa.int32()))] if offsets else []
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "offsets"][: len(columns)])

    schema = f"id {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """``id_col`` and the ``text`` that the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        word = {r: b for b, r in vocabulary(path).ranks.items()}
        for batch in batches:
            texts = [b"".join(word[i] for i in x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k."""
    return encode(table(spark, folder, "documents"), "doc_id", "text", f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken")


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of each document after encoding and decoding."""
    path = f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
    coded = encode(table(spark, folder, "documents"), "doc_id", "text", path)
    return decode(coded, "doc_id", "ids", path).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}

SQL = {
    "p8_round_trip": """SELECT doc_id, md5(coalesce(text, '')) AS digest,
        cast(length(coalesce(text, '')) AS INTEGER) AS n_chars FROM documents""",
}
