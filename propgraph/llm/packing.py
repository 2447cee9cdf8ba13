"""Packing tokenised documents into fixed-length sequences.

A document longer than a sequence is cut into full sequences and a rest.  The pieces are dealt to
randomised groups of bounded expected size, and within each group packed by first-fit decreasing: a
tournament tree over the bins' free room finds the first bin that a piece fits into in O(log n).
Groups are independent tasks, so nothing but (document, start, length) is ever shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import unused, whole_text
from propgraph.llm.pretokens import WORD_PATTERN, Memo, as_shown, compiled, exotic, lowered

#: Pieces to a group, on average.
GROUP_PIECES = 8192


@functools.cache
def _words(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def packed(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    merge = tok.model.tokenize  # the merges alone: the word is cut and in its normal form already
    word = Memo(lambda w: np.array([t.id for t in merge(as_shown(w))], dtype="<u4").tobytes())
    return packed, word.__getitem__, compiled(WORD_PATTERN).findall


def word_ids(text: str, path: str) -> bytes:
    """The ids of a text by the word-end vocabulary, as little-endian unsigned 32-bit integers."""
    packed, word, find = _words(path)
    if exotic(text) or "<|" in text:  # control strings inside texts are the library's to find
        return packed(text)
    low = lowered(text)
    return packed(text) if exotic(low) else b"".join(map(word, find(low)))


def tokenise(df: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text") -> DataFrame:
    """df's columns but the text, plus ids: binary, the little-endian unsigned 32-bit ids of the whole text and end_id.

    Null text: the empty text, so the end id alone.  Repeated rows repeat; other columns pass through
    (one named ids is replaced).
    """
    rest = [c for c in df.columns if c not in (text, "ids")]
    types, end = dict(df.dtypes), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [word_ids(t, tokenizer) + end for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*rest, "ids"])

    rows = df.select(*(df[f"`{c}`"] for c in rest), whole_text(df[f"`{text}`"]).alias(unused(df, "body")))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in rest), "ids binary"]))


def pieces(df: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece: df's columns with ids cut to the piece, plus start, length and doc_tokens.  A document without ids has no piece."""
    n = F.octet_length("ids") / 4
    cut = df.where(F.octet_length("ids") > 0).withColumns({"doc_tokens": n.cast("long"), "_k": F.explode(F.sequence(F.lit(0), F.ceil(n / length).cast("int") - 1))})
    start = F.col("_k").cast("long") * length
    return cut.withColumns({"start": start, "length": F.least(F.lit(length).cast("long"), F.col("doc_tokens") - start)}).withColumn(
        "ids", F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), F.lit(4 * length))
    ).drop("_k")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (as given).  Pieces go longest first (ties: as given) into the first bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    full = int((lengths == capacity).sum())  # the longest: a bin each, with no room left
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1
    while leaves < max(1, len(rest)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # a node holds the most room below it; an unopened bin has all of it
    sizes = lengths.tolist()
    for i in rest:
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(df: DataFrame, key: list[str], groups: int, capacity: int = 2048, seed: int = 0) -> DataFrame:
    """df (one row per piece, with its length between 1 and capacity) plus sequence_id, offset and padded_length.

    A piece's group is drawn from a hash of the key columns, so a hot document's pieces are dealt over all groups;
    ties are broken by the key.  The same rows with the same keys give the same sequences.  A sequence is padded
    to the capacity unless its tokens are a power of two.  An empty table gives no rows.
    """
    made = ["sequence_id", "offset", "padded_length"]
    rows = df.drop(*made)
    group = unused(rows, "group")
    rows = rows.withColumn(group, F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(groups)))
    names = [c for c in rows.columns if c != group]
    types = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in key])
        lengths = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        total = np.bincount(bins, weights=lengths).astype("i8")
        padded = np.where(total & (total - 1) == 0, total, capacity)[bins]
        base = pc.shift_left(table.column(group).cast(pa.int64()), 32)
        return pa.table(
            [*(table.column(c) for c in names), pc.add(base, pa.array(bins)), pa.array(offsets), pa.array(padded)], names=[*names, *made]
        )

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"{c} long" for c in made)])
    return rows.groupBy(group).applyInArrow(run, schema)


def group_count(n_pieces: int) -> int:
    return max(1, -(-n_pieces // GROUP_PIECES))
