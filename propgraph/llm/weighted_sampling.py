"""Document fingerprints by consistent weighted sampling.

A term is a word, its weight how often the text has it.  For each sample k a term draws r and c from
Gamma(2, 1) and beta from [0, 1), all functions of a hash of (term, k); with t = floor(ln w / r + beta)
its value is a = c / (exp(r (t - beta)) exp(r)).  A text's sample k is the term with the least a, and
two texts' samples agree with a probability equal to the generalised Jaccard similarity of their
weights (Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1 Sketching").  As a is a function
of (term, t, k), the least a itself stands for the sample, so a signature is a row of plain minima.
All is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.llm.common import stored, whole_text

SAMPLES = 32


#: Samples that are reduced side by side: few, so that the generated code of one row stays small.
BESIDE = 4


def _unit(bits: Column, width: int) -> Column:
    """So many bits as a number strictly between 0 and 1."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-width)


def log_value(term: Column, log_weight: Column, k: Column) -> Column:
    """ln a of a hashed term in sample k.  Two hashes give four numbers of 24 bits, and beta their spare bits."""
    one, two = F.xxhash64(term, k), F.xxhash64(k, term)
    low, mid = (lambda h: h.bitwiseAND(0xFFFFFF)), (lambda h: F.shiftrightunsigned(h, 24).bitwiseAND(0xFFFFFF))
    r = -F.log(_unit(low(one), 24) * _unit(mid(one), 24))
    c = -F.log(_unit(low(two), 24) * _unit(mid(two), 24))
    beta = _unit(F.shiftleft(F.shiftrightunsigned(one, 48), 16).bitwiseOR(F.shiftrightunsigned(two, 48)), 32)
    return F.log(c) - r * (F.floor(log_weight / r + beta) - beta + 1)


def terms(text: Column) -> Column:
    """The words of a text between white space, in lower case; a text without any is one empty word."""
    return F.split(F.lower(text), "[ \\n\\t\\r\\f]+")


def signatures(df: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, signature: array<bigint>) per key of df; rows of equal key count as one text.

    A text's words are counted and reduced where its row lies if df is partitioned by (part of) the key,
    else they are pre-aggregated and shuffled by it.  Null text counts as empty; an empty table gives no rows.
    """
    words = df.select(*key, F.explode(terms(whole_text(text))).alias("_word")).select(*key, F.xxhash64("_word").alias("_term"))
    weighted = words.groupBy(*key, "_term").agg(F.count("*").alias("_n")).select(*key, "_term", F.log("_n").alias("_log"))
    blocks = weighted.select("*", F.explode(F.array(*(F.lit(k) for k in range(0, samples, BESIDE)))).alias("_block"))
    least = blocks.groupBy(*key, "_block").agg(*(F.min(log_value(F.col("_term"), F.col("_log"), F.col("_block") + j)).alias(f"_{j}") for j in range(BESIDE)))
    parts = least.select(*key, "_block", F.array(*(F.xxhash64(f"_{j}").bitwiseAND(0xFFFFFFFF) for j in range(BESIDE))).alias("_part"))
    whole = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", "_part"))).alias("_parts"))
    return whole.select(*key, F.flatten("_parts._part").alias("signature"))


def shown(signature: Column) -> Column:
    """A signature as text: eight hex digits a sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(one: Column, two: Column) -> Column:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.size(one)


#: What tells documents apart: their id (0 for null), and the text's hash, whose last bit says that the id is null.
KEY = ["id", "text_hash"]


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """KEY and text of every row; null text is empty."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), whole_text(F.col(f"`{text}`")).alias("text"))
    marked = F.shiftleft(F.xxhash64("text"), 1) + F.col("id").isNull().cast("long")
    return docs.select(F.coalesce("id", F.lit(0)).alias("id"), marked.alias("text_hash"), "text")


def no_id(text_hash: Column) -> Column:
    return text_hash.bitwiseAND(1) == 1


def neighbours(keys: DataFrame) -> DataFrame:
    """KEY and next_key (a struct of KEY) for every row of distinct KEY: the next smaller id (of equal ids, the smaller hash), null ids after all others, and after the last the first.

    Keys are dealt into ranges, written to the shared folder so that the ranges stay as they are; each
    range is a window of its own, and a range's last key takes the first of the next range that has any.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct(~no_id(F.col("text_hash")), "id", "text_hash")  # ascending, so null ids come first
    own = F.struct(*KEY)
    ids = keys.select(order.alias("place"), own.alias("key")).repartitionByRange(n, "place").withColumn("range", F.spark_partition_id())
    ids = stored(ids, "id-ranges")
    tops = ids.groupBy("range").agg(F.max_by("key", "place").alias("top"))  # a row per partition
    last = F.last("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    below = tops.select("range", F.coalesce(F.lag("top").over(Window.orderBy("range")), last).alias("below"))
    within = F.lag("key").over(Window.partitionBy("range").orderBy("place"))
    return ids.withColumn("lower", within).join(F.broadcast(below), "range").select("key.*", F.coalesce("lower", "below").alias("next_key"))


def edited_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """KEY, doc_id, next_key, copies, n_chars, text, edited per different (id, text): the edited text's last floor(n_chars / 2) code points are the next document's first.

    Null text counts as empty.  Rows that repeat id and text are one document, `copies` says how many; other
    rows of one id are documents of their own, as are rows of null id.
    """
    docs = keyed(df, doc_id, text)  # of the same columns on both sides, so that texts are shuffled once for both joins
    sizes = docs.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max(F.char_length("text")).cast("long").alias("n_chars"))
    sizes = stored(sizes, "sampling-keys")
    lent = neighbours(sizes).join(sizes, KEY).select(*(F.col(f"next_key.{k}").alias(k) for k in KEY), F.struct(*KEY).alias("borrower"), "copies", "n_chars")
    head = F.substring("text", F.lit(1), F.expr("cast(n_chars div 2 AS int)")).alias("_head")
    heads = docs.join(lent, KEY).select("borrower.*", F.struct(*KEY).alias("next_key"), "copies", "n_chars", head)
    one = F.row_number().over(Window.partitionBy(*KEY).orderBy("n_chars"))  # rows of equal key are alike, and together already
    both = docs.join(heads, KEY).withColumn("_one", one).where("_one = 1")
    kept = F.substring("text", F.lit(1), F.expr("cast(n_chars - n_chars div 2 AS int)"))
    return both.select(*KEY, F.when(~no_id(F.col("text_hash")), F.col("id")).alias("doc_id"), "next_key", "copies", "n_chars", "text", F.concat(kept, "_head").alias("edited"))
