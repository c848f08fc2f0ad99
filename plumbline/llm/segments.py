"""Sorted segments of an index in the shared folder, one file for each bucket, read by row group.

A segment file holds rows sorted by ``key`` and knows the first and last key of each
of its row groups. A lookup opens only the row groups in which one of the wanted keys
may lie, so its cost follows the number of keys and not the length of the history.
Files are written under another name and moved when complete; a task that runs twice
writes the same file again. A segment counts once the index's manifest names it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that the executors' Python needs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def open_folder(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def folder_name(what: str, segment: int) -> str:
    return f"{what}/s{segment:06d}"


def file_name(what: str, bucket: int, segment: int) -> str:
    return f"{folder_name(what, segment)}/b{bucket:05d}.parquet"


class Writer:
    """One segment file; rows come in the order of ``key``."""

    def __init__(self, uri: str, name: str, group_rows: int):
        self.fs, root = open_folder(uri)
        self.final, self.group_rows = f"{root}/{name}", group_rows
        self.temp = f"{self.final}.{uuid.uuid4().hex}"
        self.writer, self.held, self.rows, self.edges = None, [], 0, []

    def write(self, rows) -> None:
        """Add a ``pyarrow`` table."""
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows >= self.group_rows:
            self._flush(self.rows - self.rows % self.group_rows)

    def _flush(self, upto: int) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        whole = pa.concat_tables(self.held)
        if self.writer is None:
            self.fs.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
            self.writer = pq.ParquetWriter(
                self.temp, whole.schema, filesystem=self.fs, compression="zstd", use_dictionary=False, write_statistics=False
            )
        for at in range(0, upto, self.group_rows):
            part = whole.slice(at, min(self.group_rows, upto - at)).combine_chunks()
            keys = part["key"]
            self.edges.append((keys[0].as_py(), keys[-1].as_py()))
            self.writer.write_table(part)
        self.held = [whole.slice(upto)] if upto < whole.num_rows else []
        self.rows = whole.num_rows - upto

    def close(self) -> None:
        if self.rows:
            self._flush(self.rows)
        if self.writer is None:
            return
        self.writer.add_key_value_metadata({"edges": np.array(self.edges, np.int64).tobytes()})
        self.writer.close()
        self.fs.move(self.temp, self.final)


class Reader:
    """One segment file, or an empty one where the bucket has none."""

    def __init__(self, uri: str, name: str):
        import pyarrow.parquet as pq

        fs, root = open_folder(uri)
        try:
            self.file = pq.ParquetFile(fs.open_input_file(f"{root}/{name}"))
        except FileNotFoundError:
            self.file = None
            return
        edges = np.frombuffer(self.file.metadata.metadata[b"edges"], np.int64).reshape(-1, 2)
        self.low, self.high = edges[:, 0], edges[:, 1]

    def find(self, keys: np.ndarray, columns: Sequence[str], at_once: int = 16) -> Iterator[tuple[object, np.ndarray, int]]:
        """``rows, place, read``: tables of the rows whose key is among the sorted ``keys``, the place of each row's key there, and the rows read for them.

        Other columns than the key are read only where a key was found. The caller may
        narrow the search between steps by sending which keys need no more rows.
        """
        if self.file is None or not len(keys):
            return
        wanted = np.flatnonzero(np.searchsorted(keys, self.high, "right") > np.searchsorted(keys, self.low))
        done = None
        for at in range(0, len(wanted), at_once):
            groups = wanted[at : at + at_once]
            if done is not None:
                left = keys[~done]
                groups = groups[np.searchsorted(left, self.high[groups], "right") > np.searchsorted(left, self.low[groups])]
                if not len(groups):
                    continue
            parts = self.file.read_row_groups(groups.tolist(), columns=["key"], use_threads=False)["key"]
            there = parts.to_numpy()
            lo, hi = np.searchsorted(keys, there[0]), np.searchsorted(keys, there[-1], "right")
            start = np.searchsorted(there, keys[lo:hi])
            times = np.searchsorted(there, keys[lo:hi], "right") - start
            total = int(times.sum())
            place = np.repeat(np.arange(lo, hi), times)
            rows = np.repeat(start - np.cumsum(times) + times, times) + np.arange(total)
            ends = np.cumsum([self.file.metadata.row_group(g).num_rows for g in groups])
            hit = np.unique(np.searchsorted(ends, rows, "right"))
            sizes = np.diff(ends, prepend=0)
            # places of the rows in the groups that are read
            kept = np.zeros(len(groups), np.int64)
            kept[hit] = sizes[hit]
            at_group = np.searchsorted(ends, rows, "right")
            rows = rows - (ends - sizes)[at_group] + (np.cumsum(kept) - kept)[at_group]
            whole = self.file.read_row_groups(groups[hit].tolist(), columns=list(columns), use_threads=False)
            done = yield whole.take(rows), place, int(ends[-1])


def readers(uri: str, what: str, bucket: int, segments: Sequence[int]) -> list[Reader]:
    return [Reader(uri, file_name(what, bucket, s)) for s in segments]


def by_bucket(batches: Iterator) -> Iterator[tuple[int, object]]:
    """``bucket, rows``: Arrow batches, whose first column is a sorted ``bucket``, cut where it changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield int(buckets[a]), batch.slice(a, b - a)
