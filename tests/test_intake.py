"""Uploads that are taken in, rejected row by row, or refused."""

import pytest

from cohortspark.plans.intake import Intake, Refused, take_in
from cohortspark.sources import io

SPEC = Intake(numeric=["age", "u", "v"], categories=["kind"], age="age", key="who", denied=["outcome"], identifier_names={"mail": "e_?mail", "name": "^(first|last)_name$"}, identifier_values={"mail": "[^@ ]+@[^@ ]+", "phone": r"\+\d{8,}"}, ranges={"u": (0.0, 10.0)}, most_scored=2)


def upload(tmp_path, text, name="file.csv"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_rows_are_told_apart(spark, tmp_path):
    path = upload(tmp_path, b"who,age,u,v,kind,outcome,note\n1,30,1,NaN,a,1,x\n2,40,2,3,b,0,caf\xe9\n3,17,2,3,b,0,x\n4,abc,2,3,b,0,x\n5,50,,,b,0,x\n6,51,12,3,,0,x,too,long\n1,30,1,1,a,1,x\n7,60,99,1, ,0,x\n")
    rows, report = take_in(spark, path, SPEC, f"{tmp_path}/out")
    got = {(r.section, r.item): (r.value, r.level) for r in report.collect()}
    assert sorted(r.who for r in rows.collect()) == ["1", "1", "2", "7"]
    assert {r.who: r.note for r in rows.collect()}["2"] == "caf�"
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "rejected"} == {"corrupt": 2, "age": 1, "features": 1, "numeric": 0}
    assert got["file", "rows"][0] == 8 and got["rows", "accepted"][0] == 4 and got["rows", "will be scored"][0] == 2 and got["rows", "cap applied"][0] == 1
    assert got["coverage", "v"][0] == 6 / 8 and got["coverage", "kind"][0] == 6 / 8 and got["range", "u"] == (2 / 7, "warning")
    assert ("tier", "u/qualified_use/implausible") in got and ("tier", "outcome/prohibited/denied") in got and got["ready", "ready"][0] == 1
    assert got["capability", "description"][0] == 1.0
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == 8 and kept.filter("reject_reason = 'corrupt'").count() == 2


def test_one_scan_of_the_file(spark, tmp_path):
    text = "who,age,u,v,kind\n" + "".join(f"{i},30,1,2,a\n" for i in range(500))
    rows, _ = take_in(spark, upload(tmp_path, text), SPEC, f"{tmp_path}/out")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower() and rows.count() == 500  # what follows reads the written rows


def test_refused(spark, tmp_path):
    with pytest.raises(Refused, match="name persons") as e:
        take_in(spark, upload(tmp_path, "who,E-Mail,age\n1,a,3\n"), SPEC, f"{tmp_path}/a")
    assert e.value.columns == [("E-Mail", "mail")]
    with pytest.raises(Refused, match="identify persons") as e:
        take_in(spark, upload(tmp_path, "who,age,u,v,kind,note\n" + "".join(f"{i},30,1,2,a,{'x@y.z' if i % 4 == 0 else 'free text'}\n" for i in range(40))), SPEC, f"{tmp_path}/b")
    assert e.value.columns == [("note", "mail")] and spark.read.parquet(f"{tmp_path}/b").count() == 0
    for text, why in (("", "no header"), ("who,who\n1,2\n", "repeated"), ("who,,a\n1,2,3\n", "empty")):
        with pytest.raises(ValueError, match=why):
            take_in(spark, upload(tmp_path, text), SPEC, f"{tmp_path}/c")
    with pytest.raises(Refused, match="no rows"):
        take_in(spark, upload(tmp_path, "who,age,u\n"), SPEC, f"{tmp_path}/d")
    with pytest.raises(ValueError, match="csv"):
        io.csv_header(spark, upload(tmp_path, "a\n", "file.txt"))


def test_nothing_usable_blocks(spark, tmp_path):
    rows, report = take_in(spark, upload(tmp_path, "who,age,other\n1,12,a\n2,,b\n"), SPEC, f"{tmp_path}/out")
    last = report.filter("section = 'ready'").first()
    assert rows.count() == 0 and (last.item, last.value, last.level) == ("no accepted row", 0.0, "blocking")


def test_models_can_be_fitted_after_an_intake(spark, tmp_path):
    from cohortspark.operators import models

    take_in(spark, upload(tmp_path, "who,age,u,v,kind\n1,30,1,2,a\n"), SPEC, f"{tmp_path}/out")
    d = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y int")
    assert models.logistic(d, d, "y", ["x"]).count() == 40
