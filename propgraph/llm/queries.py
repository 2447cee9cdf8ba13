"""The queries of the numbered operators: each applies its operator to a whole table and reduces the output to the columns to compare."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm import bpe, chat, exact_dedup, hilbert, language_id, line_crf, packing, pii, prefix_trie, simhash, token_counts, weighted_sampling, yinyang
from propgraph.llm.common import stored, table, whole_text


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document.  Null text: no tokens; null and repeated ids have a row each; no documents, no rows."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted as budgeted windows and read back.

    Null role or text counts as empty, a null conv_id is one conversation, repeated rows are turns of their own.
    """
    control = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), control.alias("text"))
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(convs.unionByName(made)))


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and how alike they and the next document's are.

    Null text counts as empty.  Null ids come after all others; rows that repeat an id are documents of their own,
    and rows that repeat id and text have the same result each.  No documents, no rows.
    """
    pairs = weighted_sampling.edited_pairs(table(spark, sf_dir, "documents"))
    key = weighted_sampling.KEY
    versions = pairs.select(*key, F.posexplode(F.array("text", "edited")).alias("edited", "text"))
    signed = weighted_sampling.signatures(versions, [*key, "edited"])
    both = signed.groupBy(*key).agg(
        F.max(F.when(F.col("edited") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("edited") == 1, F.col("signature"))).alias("changed")
    )
    facts = pairs.select(*key, "doc_id", "next_key", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    own = stored(facts.join(both, key), "signatures")
    following = own.select(F.struct(*key).alias("next_key"), F.col("own").alias("theirs"))
    return own.join(following, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        weighted_sampling.shown(F.col("own")).alias("fingerprint"),
        weighted_sampling.shown(F.col("changed")).alias("edited_fingerprint"),
        weighted_sampling.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        weighted_sampling.likeness(F.col("own"), F.col("theirs")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards along a Hilbert curve over language, source, length and id; sums of bytes are near equal, equal texts are in one shard.

    Null text counts as empty; rows of null or repeated doc_id have slots of their own; no documents, no rows.
    """
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    dims = [hilbert.by_value(docs, "lang"), hilbert.by_value(docs, "source"), hilbert.by_quantile(docs, "n_chars"), hilbert.by_range(F.col("doc_id"), low, high)]
    text = whole_text()
    size = F.octet_length(text).cast("long") + 1
    keep = {"doc_id": F.col("doc_id"), "size": size, "text_crc32": F.crc32(text.cast("binary"))}
    placed = hilbert.shard(docs, dims, 8, "doc_id", size, F.xxhash64(text), keep)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of fingerprints at most two bits apart.

    Null text counts as empty; rows of null or repeated ids have a row each; no documents, no rows.
    """
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the byte-level ranks and decoded again, as digests of ids and bytes.

    Null text counts as empty; rows of null or repeated ids have a row each; no documents, no rows.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(coded, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its equal texts.

    Null text counts as empty; of rows that repeat id and text one stays; no documents, no rows.
    """
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 2048 tokens; one row per piece.

    Null text counts as empty and is the end id alone; rows of null or repeated ids are documents of their own; no
    documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json")))
    narrow = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    narrow = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "pieces")  # repeated rows differ by it
    packed = packing.pack(narrow, ["doc_id", "start", "ids_crc32", "row"], packing.group_count(narrow.count()))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the fixed patterns' spans and those that the tagger adds.

    Null text counts as empty and has none; rows of null or repeated ids have a row each; no documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *map(counted, pii.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out.

    Null text, or one without a letter: und; null ids are not held out; repeated rows have a row each; no documents, no rows.
    """
    docs = table(spark, sf_dir, "documents")
    filters = language_id.learn(docs.where(~language_id.held_out()))
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.predict(rows, filters).select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations, each rebuilt with the beginning of its hundred's first.

    Null role or text counts as empty, null turns come first, repeated rows are turns of their own; rows of null
    conv_id have no conversation to be rebuilt and are left out; no conversations, no rows.
    """
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components in one of 40 clusters after five rounds; vectors of other lengths or with null, nan or infinite components have no row.

    Null and repeated ids are vectors of their own; no vectors, no rows.
    """
    vectors = yinyang.integers(table(spark, sf_dir, "embeddings"))
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return yinyang.cluster(vectors, order)


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the labels of its lines, learned from the labels of documents that are not held out.

    Null text counts as empty; rows of null or repeated id are documents of their own; no documents, no rows.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    field = line_crf.learn(docs, labels.where(~line_crf.held_out()))
    rows = docs.select("doc_id", line_crf.held_out().alias("held_out"), "text")
    return line_crf.predict(rows, field).select("doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_chat_windows, op3_weighted_sampling, op4_hilbert_shards, op5_simhash, op6_bpe_round_trip, op7_exact_dedup, op8_packing, op9_personal_data, op10_language_id, op11_prefix_trie, op12_yinyang_clusters, op13_line_quality)}



def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """op12 in SQL: every round compares every vector with every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v
            FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS near
            FROM (SELECT r, vec_id, kept.v, c0.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c{t}.v[i]) * (kept.v[i] - c{t}.v[i])))::BIGINT AS d
                  FROM kept, c{t})
            GROUP BY r)""".replace("c0.c,", f"c{t}.c,")
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (
            SELECT c, coalesce(m.v, c{t}.v) AS v
            FROM c{t} LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v
                FROM (SELECT near.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{t}, range(1, {dims + 1}) g(i) GROUP BY 1, 2)
                GROUP BY c) m USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
        SELECT vec_id, near.c AS cluster, near.d AS distance,
               (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia,
               (sum(near.d) OVER ())::BIGINT AS inertia,
               sha256(list_aggregate(list_transform(c{rounds}.v, lambda x: x::VARCHAR), 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = near.c"""
    )


#: Results of these queries in DuckDB's SQL.
ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        owns AS (
            SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base,
                   xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h
            FROM turns GROUP BY conv_id),
        convs AS (
            SELECT o.*, least(o.h, coalesce(b.own, 0)) AS borrowed, least(o.h, coalesce(b.own, 0)) + greatest(o.own - o.h, 0) AS n
            FROM owns o LEFT JOIN owns b ON b.conv_id = o.base),
        rebuilt AS (
            SELECT c.conv_id, c.n, t.pos + 1 AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
            UNION ALL
            SELECT c.conv_id, c.n, t.pos - c.h + c.borrowed + 1, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
        paths AS (
            SELECT conv_id, n, depth, length(text) AS chars,
                   list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
            FROM rebuilt
            UNION ALL SELECT conv_id, n, 0, 0, [] FROM convs),
        nodes AS MATERIALIZED (
            SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
            FROM paths GROUP BY path),
        kin AS MATERIALIZED (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        sums AS (
            SELECT path[:i] AS path, sum(saved)::BIGINT AS saved_tokens, sum((n_children IS NULL)::BIGINT)::BIGINT AS n_leaves
            FROM (SELECT n.path, saved, n_children, unnest(range(0, depth + 1)) AS i FROM nodes n LEFT JOIN kin USING (path)) GROUP BY 1)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s USING (path) LEFT JOIN kin k USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]""",
    "op12_yinyang_clusters": _clusters_sql(),
}
