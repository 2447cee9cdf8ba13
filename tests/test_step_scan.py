"""STEP files from any byte on: the same rows for every split size, as a scanner that reads byte by byte finds them."""


import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propgraph.sources import step, step_scan


def byte_by_byte(data):
    """(place, raw, ended) of every statement."""
    out, state, begin, i = [], "plain", None, 0
    while i < len(data):
        two = data[i : i + 2]
        if state == "comment":
            if two == b"*/":
                state, i = "plain", i + 1
        elif state == "text":
            if data[i : i + 1] == b"'":
                state = "plain"
        elif two == b"/*":
            state, i = "comment", i + 1
        elif data[i : i + 1] not in (b" ", b"\n", b"\r", b"\t", b"\x0b", b"\x0c"):
            begin = i if begin is None else begin
            if data[i : i + 1] == b"'":
                state = "text"
            elif data[i : i + 1] == b";":
                out.append((begin, data[begin : i + 1], True))
                begin = None
        i += 1
    return out + ([(begin, data[begin:], False)] if begin is not None else [])


def in_splits(data, size):
    file = pa.BufferReader(data)
    starts = list(range(0, max(len(data), 1), size))
    states = [("f", s, *map(list, zip(*(step_scan.passed(data[s : s + size], x) for x in range(5)), strict=True))) for s in starts]
    known = {s: (x, b) for _, s, x, b in step_scan.begins(states)}
    return [r for s in starts for r in step_scan.statements(file, s, min(s + size, len(data)), *known.get(s, (0, False)))]


PIECES = ["'", "''", ";", "/*", "*/", "/", "*", " ", "\n", "\r\n", "#1=IFCWALL(", ")", "(", ",", "$", "'a;b'", "'it''s'", "/* ; ' */", "#2= IFCDOOR('x',(#1,\n#2));", "#3=IFCLABEL('/*');", "é"]


@settings(max_examples=600, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 30))
def test_any_split_size(pieces, size):
    data = "".join(pieces).encode()
    assert in_splits(data, size) == byte_by_byte(data)


MODEL = """ISO-10303-21;
HEADER;
FILE_SCHEMA(('IFC4'));
ENDSEC; DATA;
#1=IFCWALL('0000000000000000000001',$,'Wall; with ''all'' (of)
it, #9=IFCDOOR();',$);#2=IFCDOOR('0000000000000000000002',$,'D\\X2\\00E900FC\\X0\\ \\X\\E9 \\S\\i \\\\',$); /* #7=IFCSLAB('x'); ' */
#3 = IFCRELAGGREGATES ( 'r' , $,$,$ , #1 , ( #2 , /* and */
   #4 ) ) ;
#4=IFCPROPERTYSINGLEVALUE('deep',$,IFCX((1,(2,(3,(4)))),'a''b'),$);
#5=(IFCA(1)IFCB(2));
#6=IFCWALL('unclosed',(1);
#8=IFCEMPTY();
ENDSEC;
END-ISO-10303-21;
#10=IFCCUT('no end
"""


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_rows_of_a_model(spark, tmp_path, size):
    (tmp_path / "m.ifc").write_text(MODEL)
    rows = {r["id"]: (r["class"], r["args"]) for r in step.records(spark, str(tmp_path), size).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 8]
    assert rows[1] == ("IFCWALL", ["'0000000000000000000001'", "$", "'Wall; with ''all'' (of)\nit, #9=IFCDOOR();'", "$"])
    assert rows[2][1][2] == "'Déü é é \\'" and rows[3] == ("IFCRELAGGREGATES", ["'r'", "$", "$", "$", "#1", "(#2,#4)"])
    assert rows[4][1][2] == "IFCX((1,(2,(3,(4)))),'a''b')" and rows[8] == ("IFCEMPTY", [])
    assert [r["n"] for r in step.unread(spark, str(tmp_path), size).collect()] == [3]
    assert [r["schema"] for r in step.schema_names(spark, f"file://{tmp_path}/m.ifc").collect()] == ["IFC4"]


def test_every_split_is_a_task(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(3):
        (tmp_path / "a" / f"{k}.ifc").write_text("".join(f"#{i}=IFCWALL('{i}');\n" for i in range(1, 400)))
    (tmp_path / "a" / "_hidden").write_text("#1=IFCX();")
    (tmp_path / "a" / "empty.ifc").write_text("")
    found = step.records(spark, str(tmp_path / "a"), 1000)
    assert found.rdd.getNumPartitions() > 20
    assert found.groupBy("file").count().where("count <> 399").count() == 0 and found.count() == 3 * 399
    with pytest.raises(FileNotFoundError):
        step.records(spark, str(tmp_path / "none"))


def test_short_files_share_a_task(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.ifc").write_text(f"#{k}=IFCWALL('{k}');\n" * 3)
    found = step.statements(spark, str(tmp_path), 16)
    assert found.rdd.getNumPartitions() < 100 and found.count() == 900
    assert found.groupBy("file").agg(F.count_distinct("id").alias("ids"), F.min("at").alias("at")).where("ids <> 1 OR at <> 0").count() == 0


def test_states_of_splits_do_not_go_to_every_task(spark, tmp_path):
    (tmp_path / "a.ifc").write_text("".join(f"#{i}=IFCWALL('{i}');\n" for i in range(1, 2000)))
    read, made = type(spark.read), []
    option = read.option
    try:
        read.option = lambda self, key, value: made.append(len(str(value))) or option(self, key, value)
        assert step.records(spark, str(tmp_path), 100).count() == 1999
    finally:
        read.option = option
    assert max(made) < 500
