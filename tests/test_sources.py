import json

from driftlake.cli import main
from driftlake.operators import basics
from driftlake.sources.tables import load_reports, read_measurements, save_reports, simulated


def test_csv_and_command_line(spark, tmp_path, capsys):
    f = tmp_path / "m.csv"
    f.write_text("timestamp,result,analyte\n" + "".join(f"2024-01-{d:02d} 00:00:00,{d}.5,{'ab'[d % 2]}\n" for d in range(1, 25)) + "2024-01-30 00:00:00,,a\n")
    assert read_measurements(spark, str(f)).count() == 24
    assert main(["baseline", str(f), "--json"]) == 0
    assert {r["series"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])} == {"a", "b"}
    f.write_text("timestamp,value\n")
    assert main(["drift", str(tmp_path / "none.csv")]) == 2


def test_reports_round_trip(spark, tmp_path):
    df = simulated(spark, 100, "step", 60, noise=False)
    assert [r.value for r in df.orderBy("seq").where("seq in (60, 61)").collect()] == [100.0, 108.0]
    reports = basics.baseline(df)
    for name in ("r.json", "r.md", "r.parquet"):
        save_reports(reports, str(tmp_path / name))
    assert load_reports(spark, str(tmp_path / "r.json"))[0]["n"] == 100
    assert load_reports(spark, str(tmp_path / "r.parquet")).count() == 1


def test_commands(spark, tmp_path, capsys):
    f = tmp_path / "s.csv"
    f.write_text("timestamp,value,site,batch,control\n" + "".join(f"2024-01-{1 + d // 2:02d} {d % 2:02d}:00:00,{(10, 12)[d % 2] + d % 3 * 0.1},{'AB'[d % 2]},P{d % 3},{d % 2}\n" for d in range(40)))
    p = tmp_path / "p.csv"
    p.write_text("x,y\n" + "".join(f"{i},{i + 1.5}\n" for i in range(20)))

    def said(*args):
        assert main([*args, "--json"]) == 0
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert {r["site"] for r in said("study", str(f))} == {"A", "B"}
    assert said("batch", str(f))[0]["p"] < 0.05  # batch and the tenths of the values are both d % 3
    assert abs(said("compare", str(p))[0]["bias"] - 1.5) < 1e-9
    assert said("doctor")[0]["works"] and len(said("simulate", "step", "-n", "30")) == 30
    assert main(["study", str(p)]) == 2 and main(["version"]) == 0
    assert main(["simulate", "step", "-n", "30", "--to", str(tmp_path / "s.html")]) == 0 and "</table>" in (tmp_path / "s.html").read_text()


def test_cells_by_rules(spark, tmp_path):
    """Numbers, times, truths and text; short rows, blank lines and NA; no type but by all cells."""
    import datetime as dt
    import math

    from driftlake.sources.tables import read_table, typed

    f = tmp_path / "c.csv"
    f.write_text("when,result,ok,note,mixed,extra\n2024-01-01, 1.5 ,TRUE,a,1,5\n2024-01-02T03:04:05,NA,false,2024,x,\n\n2024-01-03 00:00:00,1e2,,true\n,inf,true,b,2024-01-01,7\nnever,<5,true,,3,8\n")
    kinds = dict(read_table(spark, str(f)).dtypes)
    assert kinds == {"when": "string", "result": "string", "ok": "boolean", "note": "string", "mixed": "string", "extra": "double"}
    rows = read_measurements(spark, str(f), time="when", keep=True).orderBy("seq").collect()
    assert [(r.ts, r.value) for r in rows] == [(dt.datetime(2024, 1, 1), 1.5), (dt.datetime(2024, 1, 3), 100.0)] and [r.ok for r in rows] == [True, None]
    assert [r.extra for r in rows] == [5.0, None]
    df = spark.createDataFrame([("1f", "NaN", " "), ("0x10", "-.5", None), ("1 2", "+7.", "")], "a string, b string, c string")
    own = typed(df).collect()
    assert [r.a for r in own] == ["1f", "0x10", "1 2"] and math.isnan(own[0].b) and [own[1].b, own[2].b] == [-0.5, 7.0] and [r.c for r in own] == [None] * 3
    f.write_text("label,level,date\nx,3,2024-01-01\ny,4,2024-01-02\n")
    assert [r.value for r in read_measurements(spark, str(f)).orderBy("seq").collect()] == [3.0, 4.0]  # the first column of a number
