"""Exact and near duplicates, components and fingerprints against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from propgraph.llm import exact_dedup, queries, simhash, weighted_sampling
from propgraph.llm.components import components

DOCS = "doc_id long, text string, h string, sha string"


def test_directory_doubles():
    occupancy = np.zeros(16, "i8")
    occupancy[[0, 1, 12]] = 5, 5, 9
    bucket = exact_dedup.directory(occupancy, 6)
    assert bucket[0] != bucket[1] and bucket[8] != bucket[0] and (bucket[np.unique(bucket)] == np.unique(bucket)).all()
    held = np.bincount(bucket, weights=occupancy, minlength=16)
    assert held[bucket[12]] == 9 and (exact_dedup.directory(occupancy, 99) == 0).all()


def test_exact_against_sql(spark, sf):
    got = queries.op7_exact_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES["op7_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(object).equals(want.astype(object))


def test_exact_of_odd_rows(spark):
    rows = [(1, "a", "c", None), (2, "a", None, None), (3, None, None, None), (4, "", None, None), (5, "b", None, None), (5, "b", None, None), (None, "a", None, None), (None, "z", None, None)]
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_classes(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(0, 2, 3, None), (0, None, 1, None), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, True)], key=str)
    kept = exact_dedup.distinct_rows(spark.createDataFrame(rows, DOCS))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.where("doc_id IS NOT NULL").collect()) == [(2, "a"), (4, ""), (5, "b")]
    assert exact_dedup.exact_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_colliding_hashes_chain():
    """Two texts under one hash stay two classes."""
    rows = [[0, 7, "s1", b"x", 1, 2], [0, 7, "s2", b"y", 5, 1], [0, 7, "s1", b"x", 3, 1], [0, 8, "s3", b"z", 2, 1]]
    out = [r for b in exact_dedup._own(iter([exact_dedup._rows(rows[:2]), exact_dedup._rows(rows[2:])])) for r in b.to_pylist()]
    assert [(r["h"], r["chain"], r["keep_id"], r["group_size"]) for r in out] == [(7, 0, 3, 3), (7, 1, 5, 1), (8, 0, 2, 1)]


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    for n, m in ((1, 1), (40, 30), (200, 150)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        pairs += [(1000 + k, 1001 + k) for k in range(60)]  # a chain
        apart = [p for p in pairs if p[0] != p[1]]
        want = brute_components(apart, {x for p in apart for x in p})
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = brute_components(pairs, prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_links_lose_none(spark):
    """A long list of close fingerprints, and scattered ones: links connect what pairs connect."""
    r = random.Random(5)
    center = r.getrandbits(64)
    prints = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)} | {r.getrandbits(64) for _ in range(200)}
    prints |= {p ^ (1 << r.randrange(64)) for p in list(prints)[:100]}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = [(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, pairs))
    assert brute_components(got, signed) == brute_components(pairs, signed)


def test_simhash_of_odd_rows(spark):
    rows = [(5, None, "x", None), (3, "", None, None), (9, " \n ", None, None), (4, "one", None, None), (4, "one", None, None), (8, "ONE", None, None), (None, "one", None, None)]
    got = simhash.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {3}
    assert {r["component_id"] for r in got if r["fingerprint"] != "0" * 16} == {4} and len(got) == 7
    assert simhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates(spark):
    """Texts with few changed words are caught, others are left; a large group of near copies is one class."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(40)]
    rows = [(k, " ".join(b), None, None) for k, b in enumerate(base)]
    for k in range(20):
        changed = list(base[k])
        changed[r.randrange(150)] = "changed"
        rows.append((100 + k, " ".join(changed), None, None))
    for k in range(150):
        changed = list(base[30])
        changed[r.randrange(150)] = f"other{k}"
        rows.append((1000 + k, " ".join(changed), None, None))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[100 + k] == k for k in range(20)) and {got[1000 + k] for k in range(150)} == {30}
    assert all(got[k] == k for k in range(40)) and len(got) == len(rows)
    assert simhash.near_classes(spark.createDataFrame([], DOCS)).count() == 0


def jaccard(a, b):
    a, b = (Counter(re.split(r"[ \n\t\r\f]+", t.lower())) for t in (a, b))
    return sum(min(a[w], b[w]) for w in a.keys() | b.keys()) / sum(max(a[w], b[w]) for w in a.keys() | b.keys())


def test_weighted_sampling(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = queries.op3_weighted_sampling(spark, sf).collect()
    assert len(rows) == len(texts)
    errors, by_text = [], defaultdict(set)
    for r in rows:
        own, other = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(r["near_edited"] - jaccard(own, edited))
        errors.append(r["near_next"] - jaccard(own, other))
        by_text[own].add(r["fingerprint"])
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.15
    assert all(len(v) == 1 for v in by_text.values())


def test_collision_rate_is_the_similarity(spark):
    """With many samples the estimate is close."""
    pair = [(1, "a " * 6 + "b " * 3 + "c d e"), (2, "a " * 2 + "b " * 3 + "c x y z")]
    df = spark.createDataFrame(pair, "doc_id long, text string")
    one, two = (r["signature"] for r in weighted_sampling.signatures(df, ["doc_id"], samples=1024).orderBy("doc_id").collect())
    assert abs(np.mean([a == b for a, b in zip(one, two, strict=True)]) - jaccard(pair[0][1].strip(), pair[1][1].strip())) < 0.06


def test_sampling_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A b"), (4, "a  B\n")], "doc_id long, text string")
    got = {r["doc_id"]: r["signature"] for r in weighted_sampling.signatures(df, ["doc_id"]).collect()}
    assert got[1] == got[2] and got[3] != got[1] and len(got) == 4
    pairs = weighted_sampling.edited_pairs(df)
    assert {r["doc_id"]: r["next_key"]["id"] for r in pairs.collect()} == {4: 3, 3: 2, 2: 1, 1: 4}
    assert weighted_sampling.edited_pairs(df.limit(0)).count() == 0
    alone = weighted_sampling.edited_pairs(df.where("doc_id = 3")).first()
    assert (alone["next_key"]["id"], alone["edited"]) == (3, "A A")


def test_sampling_of_null_and_repeated_ids(spark, tmp_path):
    """Every row has a result: of its own text and the next one's in the order of ids, then texts' hashes, null ids last."""
    rows = [(1, "a b c d"), (1, "e f g h i"), (2, None), (2, None), (None, "x y"), (None, "x y"), (None, "z"), (3, "one two three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_weighted_sampling(spark, str(tmp_path)).collect()
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.shiftleft(F.xxhash64("t"), 1).alias("h")).collect()}
    order = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]]), reverse=True)
    edited = {}
    for own, other in zip(order, order[1:] + order[:1], strict=True):
        half = len(own[1]) // 2
        edited[own] = hashlib.sha256((own[1][: len(own[1]) - half] + other[1][:half]).encode()).hexdigest()
    want = sorted((str(d), len(t or ""), edited[d, t or ""]) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 3}) == 1


@pytest.mark.parametrize("limits", [{}, {"short_list": 4, "block": 8}, {"short_list": 4, "list_rows": 12, "block": 8}], ids=["as built", "long lists, small blocks", "lists beyond their bound"])
def test_near_classes_against_brute_force(spark, limits):
    """Edited copies, some of one text in a long list: no link between documents that are none, and few missed."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(3000)]
    docs = []
    for k in range(50):
        body = r.choices(words, k=r.randint(60, 300))
        docs.append(body)
        for _ in range(r.randint(1, 3) if k else 25):
            copy = list(body)
            for _ in range(max(1, len(copy) // 80)):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append(copy)
    texts = {d: " ".join(w) for d, w in enumerate(docs)}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in enumerate(docs)}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = brute_components(pairs, sets)
    df = spark.createDataFrame([(d, t, None, None) for d, t in texts.items()], DOCS)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(df, **limits).collect()}
    assert got.keys() == want.keys() and all(want[d] == want[c] for d, c in got.items())
    assert len(pairs) > 100 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_distinct_rows_keep_their_columns(spark):
    """The row of the largest id stays with its own columns, whatever they are called or hold."""
    rows = [(1, "a", 1, None, [1]), (3, "a", 2, "x", None), (2, "a", 3, "y", [2]), (4, "", 4, None, []), (5, None, 5, "z", [5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int, sha string, `a.b` array<int>")
    kept = exact_dedup.distinct_rows(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(3, "a", 2, "x", None), (5, None, 5, "z", [5])]
    assert exact_dedup.distinct_rows(df.limit(0)).count() == 0


def test_equal_fingerprints_of_other_texts(spark):
    """A line repeated 40 times decides every bit: the rest of the text still tells documents apart."""
    r = random.Random(9)
    line = " ".join(["all rights of this line are kept by owner"] * 40)
    texts = [line + " " + " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6)]
    texts.append(texts[0].upper().replace(" ", "\n"))
    rows = [(d, t, None, None) for d, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}


@pytest.mark.parametrize("block", [simhash.FAMILY_BLOCK, 50], ids=["as built", "small blocks"])
def test_pairs_within_a_shared_passage(spark, block):
    """Documents of one passage (similarity 0.71 across) in long posting lists: their pairs of 0.85 are linked, and nothing else."""
    r = random.Random(10)

    def draw(n):
        return ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]

    passage, docs = draw(400), []
    for _ in range(200):
        own = draw(43)
        docs += [passage + own + draw(39), passage + own + draw(39)]
    rows = [(d, " ".join(w), None, None) for d, w in enumerate(docs)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(spark.createDataFrame(rows, DOCS), block=block).collect()}
    caught = sum(got[a] == got[a + 1] == a for a in range(0, len(docs), 2))
    assert caught >= 190 and len(set(got.values())) == len(docs) - caught


def test_repeats_do_not_hide_near_copies(spark):
    """Documents with one line 2 times and 10, 30 or 120 times, and a word changed besides: still near copies."""
    r = random.Random(11)
    rows = []
    for k, times in enumerate((10, 30, 120) * 4):
        body = ["".join(r.choices("abcdefghij", k=6)) for _ in range(300)]
        line = ["".join(r.choices("abcdefghij", k=6)) for _ in range(11)]
        rows.append((k, " ".join(body + line * 2), None, None))
        rows.append((100 + k, " ".join(["changed", *body[1:]] + line * times), None, None))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: d % 100 for d in got} and len(got) == 24


def test_repeated_ids_lose_no_row(spark):
    """Rows of one id are documents of their own: a near copy goes, another text of the same id or of null id stays."""
    import corpus_pipeline

    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, other, b, c = (words(200) for _ in range(4))
    near = " ".join([*a[:100], "changed", *a[101:]])
    rows = [(1, " ".join(a), "en", "s", 1), (5, near, "en", "s", 1), (5, " ".join(other), "en", "s", 1), (9, " ".join(b), "en", "s", 1), (None, " ".join(c), "en", "s", 1), (None, near + " end", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in kept.collect()) == sorted((-1 if i is None else i, t) for i, t, *_ in rows if i != 1 and t != near)
    once = corpus_pipeline.drop_near_copies(spark, df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "").collect()
    assert len(once) == 2 + (5 in {x["doc_id"] for x in once})


def test_tagger_sample_is_bounded(spark, monkeypatch):
    """Copies count once, and what reaches the driver has a bound."""
    from propgraph.llm import pii

    seen = []
    monkeypatch.setattr(pii, "labelled_windows", lambda texts: seen.append(texts) or [])
    monkeypatch.setattr(pii, "train", lambda windows: None)
    df = spark.createDataFrame([("hot text a@b.de",)] * 5000 + [("hot plain text",)] * 5000 + [(f"text {i}",) for i in range(500)], "text string")
    pii.fit(df, docs=20)
    assert len(seen[0]) == len(set(seen[0])) <= 80
