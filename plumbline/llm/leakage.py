"""Evaluation texts leaking into training text: an FM-index per training shard.

Each task cuts its documents into shards, turns a shard into a sequence of symbols of
its own words and builds its FM-index once: suffix array, Burrows-Wheeler transform,
wavelet matrix for ranks, and suffix positions sampled at every document start and
every few words. The test items wait in the shared folder, in blocks; a block's phrases
are searched backwards at once, their occurrences located from the samples, and
overlapping ones merged into spans to remove. No document is compared with an item
outside the index, and documents are read once for any number of items.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.lookalike import fold_python, fold_sql
from plumbline.llm.segments import open_folder, qualified
from plumbline.session import new_folder
from plumbline.sources.tables import table

WORDS = 12
#: Words of a shard, steps between sampled positions, items of one search block.
SHARD_WORDS, SAMPLE, BLOCK_ITEMS = 400_000, 8, 2_000
_WORD = re.compile(r"[^\W_]+")
_ACCENT = re.compile(r"[̀-ͯ]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in one form: look-alikes folded, no case, no accents, no punctuation."""
    if not text:
        return []
    text = fold_python(text)
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling over what is still tied; a 0 is smaller than all else and than every later 0."""
    n = len(seq)
    zero = seq == 0
    count = int(zero.sum())
    rank = seq.astype(np.int64) + count + 1
    rank[zero] = np.arange(1, count + 1)
    # as many words as fit one number are sorted at once
    bits = int(rank.max()).bit_length()
    reach = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(min(reach, n)):
        key[: n - i] |= rank[i:] << (bits * (reach - 1 - i))
    order = np.argsort(key, kind="stable")
    tied, place, key = order, np.arange(n), key[order]
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = place[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))] + 1
        alone = first & np.concatenate([first[1:], [True]])
        place = place[~alone]
        if not len(place):
            return order
        tied = order[place]
        after = tied + reach
        key = rank[tied] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[place] = tied
        reach *= 2


class FMIndex:
    """An FM-index over symbols ``0..sigma-1``, where 0 ends a document."""

    def __init__(self, seq: np.ndarray, sigma: int, starts: np.ndarray):
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.n, self.first = len(seq), np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        keep = order % SAMPLE == 0
        at_start = np.zeros(len(seq), bool)
        at_start[starts] = True
        keep |= at_start[order]
        self.kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.samples = order[keep].astype(np.int32)
        # wavelet matrix: a level for each bit, with the number of ones before each place
        self.levels = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros, values = [], [], bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place`` in the transform."""
        low = np.zeros_like(place)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            place = np.where(bit, zeros + ones[place], place - ones[place])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return place - low

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The transform's symbol at ``place``."""
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            out = out * 2 + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases``: the rows of the suffix array from, to."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = phrases[live, j]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffix array rows, walking to the nearest sample; documents' starts are samples, so no walk leaves its document."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.kept[at + 1] > self.kept[at]
            out[left[hit]] = self.samples[self.kept[at[hit]]] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            if len(left):
                c = self.symbol(at)
                at = self.first[c] + self.rank(c, at)
        return out


class Phrases:
    """All runs of ``n`` words of a block of items, over the block's own words."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = WORDS):
        symbols: dict[str, int] = {}
        where: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            seq = [symbols.setdefault(w, len(symbols)) for w in words]
            for i in range(len(seq) - n + 1):
                where.setdefault(tuple(seq[i : i + n]), set()).add(item)
        self.n, self.words = n, list(symbols)
        self.table = np.array(list(where), np.int64).reshape(len(where), n)
        self.items = [sorted(x) for x in where.values()]

    def within(self, symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The phrases whose words a shard has, in its symbols, and their numbers."""
        own = np.array([symbols.get(w, 0) for w in self.words], np.int64)
        phrases = own[self.table] if len(self.table) else self.table
        all_there = np.flatnonzero((phrases > 0).all(axis=1))
        return phrases[all_there], all_there


class Shard:
    """The FM-index of some documents over their own words."""

    def __init__(self) -> None:
        self.symbols: dict[str, int] = {}
        self.ids: list = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ident, words: list[str]) -> None:
        put = self.symbols.setdefault
        self.parts.append(np.array([*[put(w, len(self.symbols) + 1) for w in words], 0], np.int64))
        self.ids.append(ident)
        self.size += len(words) + 1

    def build(self) -> None:
        sizes = np.array([len(p) for p in self.parts])
        self.starts = np.cumsum(sizes) - sizes
        self.index = FMIndex(np.concatenate(self.parts), len(self.symbols) + 1, self.starts)

    def spans(self, phrases: Phrases) -> Iterator[tuple[object, int, int, int]]:
        """``(doc, item, first word, number of words)`` of all phrases found, merged where they overlap."""
        table, number = phrases.within(self.symbols)
        if not len(table):
            return
        lo, hi = self.index.search(table)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(number[found], count)
        first = np.repeat(np.cumsum(count) - count, count)
        at = self.index.locate(np.repeat(lo[found], count) + np.arange(len(which)) - first)
        doc = np.searchsorted(self.starts, at, "right") - 1
        hits = sorted({(d, item, p) for d, p, f in zip(doc.tolist(), (at - self.starts[doc]).tolist(), which.tolist()) for item in phrases.items[f]})
        run: list[int] | None = None
        for d, item, p in hits:
            if run and (d, item) == (run[0], run[1]) and p <= run[3]:
                run[3] = p + phrases.n
                continue
            if run:
                yield self.ids[run[0]], run[1], run[2], run[3] - run[2]
            run = [d, item, p, p + phrases.n]
        if run:
            yield self.ids[run[0]], run[1], run[2], run[3] - run[2]


def _write_blocks(items: DataFrame, blocks: int) -> str:
    """The items' words in the shared folder, a sub-folder for each block; the folder's name for the tasks."""
    spark = items.sparkSession
    i, u = items.columns[:2]

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = pa.array([words_of(t) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["block", "item", "words"])

    folder = new_folder(spark, "items")
    src = items.select(F.pmod(F.xxhash64(i), F.lit(blocks)).cast("int").alias("block"), F.col(i).cast("bigint").alias("item"), F.col(u).alias("t"))
    src.filter("item is not null and t is not null").repartition(min(blocks, 64), "block").mapInArrow(
        cut, "block int, item bigint, words array<string>"
    ).write.partitionBy("block").parquet(folder)
    return qualified(spark, folder)


def leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words``: the spans of ``docs`` (id, text) that hold ``n`` or more consecutive words of an item (id, text).

    Case, punctuation, spacing, accents and look-alike characters don't matter.
    Null and empty texts hold nothing, items of fewer words or without an id can't
    leak. Words are counted from 0. Items are the stated query set: a task holds
    ``block_items`` of them at a time, so what it needs doesn't grow with their number.
    """
    d, t = docs.columns[:2]
    src = docs.select(F.col(d).alias("id"), F.col(t).alias("t")).filter("t is not null")
    kind = src.schema["id"].dataType.simpleString()
    blocks = max(1, -(-items.count() // block_items))
    uri = _write_blocks(items, blocks)

    def read(b: int) -> Phrases:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = open_folder(uri)
        named = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/block={b}", allow_not_found=True)) if f.path.endswith(".parquet")]
        rows = [pq.read_table(p, filesystem=files, columns=["item", "words"], partitioning=None) for p in named]
        return Phrases([(i, w) for r in rows for i, w in zip(r["item"].to_pylist(), r["words"].to_pylist())], n)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = lru_cache(maxsize=4)(read)

        def flush(shard: Shard, id_type) -> Iterator:
            shard.build()
            for b in range(blocks):
                columns = list(zip(*shard.spans(block(b)))) or [(), (), (), ()]
                arrays = [pa.array(c, k) for c, k in zip(columns, (id_type, pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "first_word", "n_words"])

        shard = Shard()
        for batch in batches:
            id_type = batch.column(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) >= n:
                    shard.add(k, words)
                if shard.size >= shard_words:
                    yield from flush(shard, id_type)
                    shard = Shard()
        if shard.ids:
            yield from flush(shard, id_type)

    return src.mapInArrow(run, f"doc_id {kind}, item_id bigint, first_word int, n_words int")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document and the item it leaks."""
    return p9_spans(spark, folder).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans to remove."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, folder, "eval_items").select("item_id", "text"))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}


def _grams(table_name: str, ident: str) -> str:
    words = f"regexp_extract_all(lower(strip_accents({fold_sql('text')})), '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT DISTINCT {ident}, unnest(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS g
        FROM (SELECT {ident}, {words} AS w FROM {table_name} WHERE text IS NOT NULL) WHERE len(w) >= {WORDS}"""


SQL = {
    "p9_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_items', 'item_id')}) USING (g)""",
}
