"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit per language, so and-ing the slots of an
n-gram returns every language that contains it (bit-sliced filters).  A text's score for a language
is the share of its n-grams with that language's bit, corrected for the filter's false positives.

The filter is learned from a bounded sample: of each language, PER_LANGUAGE documents are expected
to be drawn by a hash of their id and text, and n-grams are kept that make up MIN_SHARE of the sample.  It is
a table of 2 ** SLOT_BITS words, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import stored, unused, whole_text

N = 4
HASHES = 3
SLOT_BITS = 20
PER_LANGUAGE = 1500
MIN_SHARE = 1e-5
#: Characters normalised, and n-grams looked up, at a time; a longer text is normalised whole.
BLOCK = 1 << 18
UNDETERMINED = "und"

_SEPARATOR = "\x01"
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters (any other run is one blank), and how many each text has.

    A text ends in N - 1 blanks, so a single letter has an n-gram too; a text without letters may have some of blanks.
    """
    tail = _SEPARATOR * (N - 1)
    codes = np.frombuffer("".join(t.lower().replace(_SEPARATOR, " ") + tail for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    mark = codes == 1
    keep = letter | mark
    keep[1:] |= letter[:-1]
    kept_mark = mark[keep]
    c = np.where(letter, codes, 32)[keep].astype("u8")
    ends = np.flatnonzero(kept_mark)[N - 2 :: N - 1] + 1 if texts else np.zeros(0, "i8")
    lengths = np.diff(np.concatenate([[0], ends])) - (N - 1)
    if len(c) < N:
        return np.zeros(0, "u8"), lengths
    h = c[: -(N - 1)].copy()
    for k in range(1, N):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[k : len(c) - (N - 1) + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h[~kept_mark[: len(h)]], lengths


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype("u4")


@dataclass
class Filters:
    """languages, and per 64 of them a table of language masks; rate: each language's share of false positives."""

    languages: list[str]
    tables: list[np.ndarray] = field(default_factory=list)

    @cached_property
    def rate(self) -> np.ndarray:
        fill = [((t >> t.dtype.type(b)) & t.dtype.type(1)).mean() for t in self.tables for b in range(min(64, 8 * t.itemsize))]
        return np.array(fill[: len(self.languages)]) ** HASHES

    def hits(self, h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each text (rows) the n-grams that each language (columns) contains."""
        at = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros((len(lengths), len(self.languages)), "i8")
        for w, table in enumerate(self.tables):
            mask = table[slots(h, 0)]
            for k in range(1, HASHES):
                mask &= table[slots(h, k)]
            for b in range(min(64, len(self.languages) - 64 * w)):
                ones = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(b)) & mask.dtype.type(1), dtype="i8")])
                out[:, 64 * w + b] = ones[at[1:]] - ones[at[:-1]]
        return out


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE) -> Filters:
    """Filters of the languages of df's labelled rows.  Rows of null language or text teach nothing; no rows: no languages."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Filters([])
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))))
    place = F.create_map(*(F.lit(x) for k, name in enumerate(languages) for x in (name, k)))
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k in np.unique(of):
                for part in blocks([t for t, o in zip(texts, of, strict=True) if o == k]):
                    h, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, "i4")), pa.array(h.view("i8")), pa.array(n)], names=["k", "h", "n"])

    counted = drawn.select(place[F.col("lang")].alias("k"), "text").mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    counted = stored(counted, "gram-counts")
    totals = {r["k"]: r["t"] for r in counted.groupBy("k").agg(F.sum("n").alias("t")).collect()}
    least = F.create_map(*(F.lit(x) for k, t in totals.items() for x in (k, max(2.0, t * min_share)))) if totals else F.lit(None).cast("map<int,double>")
    bits = counted.where(F.col("n") >= least[F.col("k")]).select(
        F.floor(F.col("k") / 64).cast("int").alias("w"),
        F.expr("shiftleft(1L, k % 64)").alias("bit"),
        F.explode(F.array(*(F.expr(f"cast(shiftrightunsigned(h, {SLOT_BITS * k}) & {(1 << SLOT_BITS) - 1} AS int)") for k in range(HASHES)))).alias("slot"),
    )
    words = bits.groupBy("w", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** SLOT_BITS rows per 64 languages
    kind = next(np.dtype(f"u{b}") for b in (1, 2, 4, 8) if 8 * b >= min(64, len(languages)))
    tables = [np.zeros(1 << SLOT_BITS, kind) for _ in range(-(-len(languages) // 64))]
    w, slot, value = (words.column(c).to_numpy() for c in ("w", "slot", "bits"))
    for k, t in enumerate(tables):
        t[slot[w == k]] = value[w == k].view("u8").astype(kind)
    return Filters(languages, tables)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, some at a time: up to BLOCK characters together, or one longer text."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > BLOCK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def scores(texts: list[str], filters: Filters) -> np.ndarray:
    """Per text and language, the share of n-grams in the language, corrected for false positives: (share - rate) / (1 - rate), at least 0."""
    out = []
    for part in blocks(texts):
        h, n = grams(part)
        hits = np.zeros((len(part), len(filters.languages)), "i8")
        owner, at = np.repeat(np.arange(len(part)), n), 0
        while at < len(h):  # a long text's n-grams, made once of the whole text, are looked up some at a time
            own, lengths = np.unique(owner[at : at + BLOCK], return_counts=True)
            hits[own] += filters.hits(h[at : at + BLOCK], lengths)
            at += BLOCK
        out.append(np.clip((hits / np.maximum(n, 1)[:, None] - filters.rate) / np.maximum(1 - filters.rate, 1e-9), 0, 1))
    return np.concatenate(out) if out else np.zeros((0, len(filters.languages)))


def predict(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """df plus lang_pred and score (of that language, 0 to 1).

    Null text or one without any letter: "und", score 0; so is every text if no language was learned.
    Equal scores: the first language in order.  Rows are independent, other columns pass through.
    """
    made = ["lang_pred", "score"]
    rest = [c for c in df.columns if c not in made]
    _ = filters.rate  # once, here, and not by every task
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            best, score = np.zeros(len(texts), "i8"), np.zeros(len(texts))
            if known.languages and len(texts):
                table = scores(texts, known)
                best = table.argmax(axis=1)
                score = np.where(lettered, table[np.arange(len(texts)), best], 0.0)
            names = [known.languages[b] if ok and known.languages else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=[*rest, *made])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), "lang_pred string", "score double"])
    return df.select(*(df[f"`{c}`"] for c in rest), whole_text(df[f"`{text}`"]).alias(unused(df, "body"))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text is 2 modulo 4 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
