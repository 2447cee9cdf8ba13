"""Query texts that hang together, and texts that do not."""

import pytest
from pyspark.sql import functions as F

from propgraph.operators import scoring, wellformed

GOOD = [
    "MATCH (n) RETURN *", "MATCH (n) WITH * RETURN n", "match (n:Wall) where n.Name = 'it\\'s' return n;", "UNWIND [1, 2] AS x WITH x, x * 2 AS y WHERE y > 1 RETURN y", "OPTIONAL MATCH (n:Wall) RETURN collect(n.Name)[0]",
    "MATCH (a)-[r:R|S*1..3]->(b:B:C)<-[]-(c), (d) WHERE NOT (a)-[:X]->(:Y) AND a.n IS NOT NULL RETURN DISTINCT a, count(*) AS k, r ORDER BY k DESC, a.Name SKIP 1 LIMIT 5;",
    "MATCH (n) WHERE n.Name STARTS WITH 'RETURN (' AND n.x <> -1 RETURN n.x - 1 AS d", "MATCH (w:W) WITH max(w.a * w.b) AS most MATCH (v:V) WHERE v.c / abs(coalesce(v.d, 0) - most) >= 2.5 RETURN most, v",
    "MATCH (s) WITH sum(s.a) AS net, sum(s.b) AS all RETURN CASE WHEN all IS NULL OR all = 0 THEN NULL ELSE net / all END AS share", "MATCH (n)\nWHERE (n:A OR n:B) AND n.x IN ['a', 'b']\nRETURN n.x, count(n)",
]
BAD = [
    None, "", "  ", "hello", "RETURN", "MATCH (n) RETURN", "MATCH (n) RETURN m", "MATCH (n:Wall) WHERE x.Name = 'a' RETURN n", "MATCH (n:Wall RETURN n", "MATCH (n) WHERE RETURN n", "MATCH (n) WITH n.Name RETURN n",
    "MATCH (n) WITH n.Name AS a RETURN n", "MATCH (n) RETURN n.Name, n.Name", "MATCH (n) RETURN n.a AS x, n.b AS x", "MATCH (n) WHERE n.a = RETURN n", "MATCH (n) WHERE = 1 RETURN n", "MATCH (n)-[:R]>(m) RETURN n", "MATCH (n) RETURN n LIMIT x",
    "MATCH (n) RETURN n ORDER BY z", "MATCH (n) RETURN n MATCH (m)", "MATCH (n) WHERE n.a = 'x RETURN n", "MATCH (n) WHERE n.Name 'x' RETURN n", "MATCH (n) WHERE (n.a = 1 RETURN n", "MATCH (n) RETURN count(n", "MATCH (n) UNWIND keys(n) RETURN n",
    "MATCH (n) WHERE n.a = 1 AND = 2 RETURN n", "MATCH (n) RETURN n,", "MATCH (n) RETURN n.a n.b", "UNWIND keys(n) AS k RETURN k",
]


@pytest.mark.parametrize(("texts", "want"), [(GOOD, True), (BAD, False)])
def test_texts(spark, texts, want):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", wellformed.well_formed(F.col("t")).alias("ok")).collect()
    wrong = [r["t"] for r in rows if r["ok"] is not want]
    assert wrong == []


def test_masked_names(spark):
    query = "MATCH (n:Wall) WHERE n.Name = 'a.b (x:Roof)' AND n.Width > 10.25 RETURN n.Name, \"c.d \\\" e.f\""
    valid = [F.array(F.lit("wall")), F.array(F.lit("name"), F.lit("width"))]
    row = spark.range(1).select(scoring.schema_compliance(F.lit(query), *valid).alias("p"), scoring.schema_compliance(F.lit(query), *valid, mask=True).alias("m")).first()
    assert row["m"]["scr"] == 1.0 and row["m"]["invalid_properties"] == [] and row["p"]["scr"] < 1 and "Roof" in row["p"]["invalid_labels"]
