"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts up to CHUNK characters are encoded where they lie.  Longer ones are cut into overlapping
chunks that different tasks pre-tokenise and encode; a chunk may begin in the middle of a pre-token,
so the pieces of a document are stitched at the first boundary that two neighbouring chunks share:
from a common boundary on, both cut alike.  Where they share none (a run longer than the overlap),
the next chunk is cut anew from the last true boundary.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import whole_text
from propgraph.llm.pretokens import Memo, compiled, pretokens

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 512


@functools.cache
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 bytes and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def _coder(path: str, pattern: str):
    import tiktoken

    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})

    def packed(text: str) -> bytes:
        return np.array(coder.encode_ordinary(text), dtype="<i4").tobytes()

    return Memo(packed).__getitem__, compiled(pattern).findall


@functools.cache
def _bytes_of(path: str) -> list[bytes]:
    ranks = vocabulary(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """The ids of one text as little-endian 32-bit integers."""
    piece, find = _coder(path, pattern)
    return b"".join(map(piece, pretokens(text, find)))


def cut(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, chunk) of each chunk; the last one ends with the text."""
    if len(text) <= size:
        return [(0, text)]
    return [(k, text[k : k + size + overlap]) for k in range(0, len(text), size)]


def encode_chunk(start: int, chunk: str, path: str, pattern: str) -> tuple[bytes, bytes, bytes]:
    """Of each pre-token (or stretch left to the library) of a chunk: where it ends in the document, and how many ids it has; then all ids."""
    piece, find = _coder(path, pattern)
    pieces = pretokens(chunk, find)
    ids = [piece(p) for p in pieces]
    ends = start + np.cumsum(np.fromiter(map(len, pieces), "<i8", len(pieces)))
    return ends.astype("<i8").tobytes(), (np.fromiter(map(len, ids), "<i4", len(ids)) // 4).astype("<i4").tobytes(), b"".join(ids)


def stitch(chunks: list[tuple[int, str, bytes, bytes, bytes]], path: str, pattern: str) -> bytes:
    """The ids of a document from its chunks in order (start, text, ends, counts, ids)."""
    out: list[bytes] = []
    at = 0  # up to here the cuts are true
    for k, (start, text, ends, counts, ids) in enumerate(chunks):
        bounds = np.concatenate([[start], np.frombuffer(ends, "<i8")])
        first = int(np.searchsorted(bounds, at))
        if k + 1 == len(chunks):
            end = len(bounds) - 1
        else:
            reach = chunks[k + 1][0]
            settled = int(np.searchsorted(bounds, start + len(text)))  # a pre-token that ends with the chunk may go on
            near = np.arange(max(first, int(np.searchsorted(bounds, reach))), settled)
            both = near[np.isin(bounds[near], np.concatenate([[reach], np.frombuffer(chunks[k + 1][2], "<i8")]))]
            end = int(both[0]) if len(both) else max(first, settled - 1)
            if not len(both):  # the next chunk is cut anew from the last true boundary
                at, body = int(bounds[end]), chunks[k + 1][1]
                body = text[at - start : reach - start] + body if at < reach else body[at - reach :]
                chunks[k + 1] = (at, body, *encode_chunk(at, body, path, pattern))
        before = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i4"))])
        out.append(ids[4 * int(before[first]) : 4 * int(before[end])])
        at = int(bounds[end])
    return b"".join(out)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """df's columns but the text, plus ids: array<int>, the ids by which tiktoken would encode each whole text.

    Null text: the empty text, no ids.  Repeated rows repeat; an empty table gives none; other columns
    pass through (one named ids is replaced).  Only texts longer than CHUNK characters are shuffled:
    their chunks go to tasks by document and chunk, and their ids are put together by document.
    """
    given = [c for c in df.columns if c not in (text, "ids")]
    rest = [f"c{k}" for k in range(len(given))]  # names that the helpers' own do not clash with
    types = dict(df.dtypes)
    fields = [f"{r} {types[c]}" for r, c in zip(rest, given, strict=True)]
    rows = df.select(*(df[f"`{c}`"].alias(r) for r, c in zip(rest, given, strict=True)), whole_text(df[f"`{text}`"]).alias("_text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_text(t, ranks, pattern) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], id_lists(coded)], names=[*rest, "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                parts = cut(t)
                own = [pa.array([c[k].as_py()] * len(parts), c.type) for c in batch.columns[:-1]]
                row = pa.array([(task << 40) + n] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*own, row, pa.array([s for s, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.string())], names=[*rest, "_row", "_start", "_chunk"]
                )
                n += 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_chunk(s, t, ranks, pattern) for s, t in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            more = [pa.array([m[k] for m in made], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_ends", "_counts", "_ids"])

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("_start")
        parts = list(zip(*(table.column(c).to_pylist() for c in ("_start", "_chunk", "_ends", "_counts", "_ids")), strict=True))
        ids = id_lists([stitch(parts, ranks, pattern)])
        one = table.slice(0, 1)
        return pa.table([*(one.column(c) for c in rest), ids], names=[*rest, "ids"])

    out = ", ".join([*fields, "ids array<int>"])
    short = rows.filter(F.length("_text") <= CHUNK).mapInArrow(whole, out)
    cut_up = rows.filter(F.length("_text") > CHUNK).mapInArrow(chunks, ", ".join([*fields, "_row long", "_start long", "_chunk string"]))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ", ".join([*fields, "_row long", "_start long", "_chunk string", "_ends binary", "_counts binary", "_ids binary"])
    shared = cut_up.repartition(n, "_row", "_start").mapInArrow(coded, spread)
    return short.unionByName(shared.groupBy("_row").applyInArrow(together, out)).toDF(*given, "ids")


def id_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))


def decode(df: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df plus a binary column: the bytes of the ids, one after the other.  Null ids: null.  An id outside the vocabulary fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(ranks)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            values, offsets = lists.values.to_pylist(), lists.offsets.to_pylist()
            if values and min(values) < 0:
                raise ValueError("negative token id")
            texts = [b"".join([table[i] for i in values[a:b]]) if ok else None for a, b, ok in zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, into])

    return df.drop(into).mapInArrow(run, df.drop(into).schema.add(into, "binary"))
