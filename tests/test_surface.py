import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.config import Config, build, domain_rules, from_args, from_file, read_text
from quillon.errors import ConfigurationError, DatasetError, OutputError
from quillon.plans.analyze import Cancelled, analyze, write
from quillon.report import Report, graph_page
from quillon.sources import tabular
from quillon.streaming import monitor

TEXT = '﻿id,amount,amount,event_date,note\n1,"1,234.5",3,2024-01-01,"a, ""b"""\n2,2.5,4,2024-01-02,n/a\n3,7,5,2024-01-03,"line\nbreak"\n4,8,6,2024-01-04,x\n'


def test_reads_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TEXT, encoding="utf-8")
    d = tabular.load(spark, str(tmp_path / "t.csv"))
    assert d.columns == ["id", "amount", "amount_2", "event_date", "note", "row_id"]
    rows = {r["row_id"]: r for r in d.collect()}
    assert rows[0]["amount"] == 1234.5 and rows[0]["note"] == 'a, "b"' and rows[1]["note"] is None and rows[2]["note"] == "line\nbreak"
    assert dict(d.dtypes)["event_date"] == "timestamp" and sorted(rows) == [0, 1, 2, 3]


def test_compressed(spark, tmp_path):
    with gzip.open(tmp_path / "t; touch pwned.csv.gz", "wt", encoding="utf-8") as f:
        f.write(TEXT)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", TEXT)
    for name in ("t; touch pwned.csv.gz", "t.zip"):
        assert tabular.load(spark, str(tmp_path / name)).count() == 4
    assert not (tmp_path / "pwned").exists()
    with pytest.raises(DatasetError):
        tabular.load(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(DatasetError):
        tabular.load(spark, str(tmp_path / "missing.csv"))


def test_inference_thresholds(spark):
    def kind(good, bad, name="v"):
        cells = [(str(i),) for i in range(good)] + [("word",)] * bad
        return tabular.infer_types(spark.createDataFrame(cells, f"{name} string"))[name]

    assert kind(79, 21) == "categorical" and kind(80, 20) == "numeric" and kind(2, 0) == "categorical" and kind(3, 0) == "numeric"
    assert kind(10, 0, "event_time") == "datetime"
    assert tabular.infer_types(spark.createDataFrame([("1",)] * 5, "v string"), {"v": "categorical"})["v"] == "categorical"


def test_admission(spark):
    rows = [(str(i), str(float(i)), str(2.0 * i)) for i in range(1, 11)] + [(None, "55.0", "110.0"), ("Subtotal", "1", "2"), ("-- note", None, None), (" ", "", None), ("11", "11.0", "22.0")]
    d = tabular.with_row_id(tabular.admitted(spark.createDataFrame(rows, "k string, a string, b string").coalesce(1)))
    assert d.count() == 12
    assert tabular.without_running_totals(d, ["a", "b"]).count() == 11
    assert tabular.repair_width(["1", "a", "b", "3.5"], 3, {0, 2}, set()) == ["1", "a,b", "3.5"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "x"', float("nan")), (2, None, 0.5)], "i long, s string, v double")
    tabular.write_csv(d, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))
    assert "say 'x'" in text and "0.500000" in text
    tabular.write_parquet(d, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("v is null").count() == 1


@pytest.mark.parametrize("path,message", [("../x.html", "traversal"), ("/etc/x.html", "inside workspace"), ("/", "root"), ("  ", "empty")])
def test_path_guard(tmp_path, path, message):
    with pytest.raises(OutputError, match=message):
        tabular.safe_path(path, str(tmp_path))


def test_config(tmp_path):
    assert build(read_text('{"kfold": "3", "tuning": {"lof_k": 9}, "impute": {"a": "median"}}')).tuning.lof_k == 9
    assert build(read_text("target: y  # c\nexclude: a, b")).exclude == ["a", "b"]
    for bad in ({"kfold": 1}, {"nope": 1}, {"scaling": "robust"}, {"delimiter": "ab"}, {"tuning.significance_alpha": 2}, {"kfold": 2.5}, {"impute.a": "magic"}, {"max_feature_missing_ratio": 3}):
        with pytest.raises(ConfigurationError):
            build(bad)
    (tmp_path / "c.json").write_text('{"target": "y"}')
    assert from_file(tmp_path / "c.json").target == "y"
    assert from_args(["d.csv", "--kfold", "4", "--set", "type.a=numeric"]).type == {"a": "numeric"}
    with pytest.raises(ConfigurationError):
        from_args(["d.csv", "--unknown", "1"])
    assert Config(low_memory=True, outlier_method="lof").outlier_method == "iqr"
    assert domain_rules("suppress_causal: a, b\ndeprioritize = c") == {"block": {"a", "b"}, "weaken": {"c"}}


def test_report_escapes(spark, tmp_path):
    nasty = "x<script>alert(1)</script>"
    r = Report(nasty).heading(nasty).table(spark.createDataFrame([(nasty,)], f"`{nasty}` string")).bars([(nasty, 1.0)]).heatmap([nasty], [[0.5]])
    assert "<script>alert" not in r.html() and "&lt;script&gt;" in r.html()
    assert "<script>alert" not in graph_page([(nasty, "y", 0.5)], tmp_path / "g.html").read_text()


def test_whole_analysis(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(f"{rng.gauss(0, 1):.4f}", f"{rng.random() * 10:.3f}", "abc"[i % 3], i) for i in range(120)]
    lines = ["x<script>alert(1)</script>,b,kind,y"] + [f"{x},{b},{k},{2 * float(x) + float(b):.3f}" for x, b, k, _ in rows]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "a.csv.rules.txt").write_text("suppress_causal: b\ndeprioritize: b")
    seen = []
    config = build({"target": "y", "neural_strategy": "none", "tuning.causal_bootstraps": 4, "export_preprocessed": "csv"})
    out = analyze(str(tmp_path / "a.csv"), config, spark, progress=lambda *a: seen.append(a[0]))
    assert seen[0] == "profile" and seen[-1] == "causal"
    assert out.tables["models"].where("model = 'linear'").first()["r2"] > 0.99
    assert "b" not in {r["cause"] for r in out.tables["causal"].collect()}
    page = open(write(out, config, str(tmp_path))).read()
    assert "<script>alert" not in page and "&lt;script&gt;" in page
    with pytest.raises(Cancelled):
        analyze(str(tmp_path / "a.csv"), config, spark, cancel=lambda: True)


def test_analysis_with_network_and_plots(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.random() * 10, rng.gauss(5, 2)
        rows.append((a, b, c, "xyz"[i % 3], "pq"[i % 2], 3 * a + 0.5 * b + 0.2 * a * c + rng.gauss(0, 0.2)))
    d = spark.createDataFrame(rows, "first double, second double, third double, kind string, side string, outcome double")
    config = build({"target": "outcome", "tuning.causal_bootstraps": 4, "causal": "false", "plots": "all", "output_dir": "out", "feature_engineering": "false"})
    out = analyze(d, config, spark)
    assert {"topologies", "confidence", "interactions", "interaction_test", "conditional_drift", "narrative", "outlier_context", "mahalanobis", "psi", "pies", "contingency_kind_side"} <= set(out.tables)
    assert 0 <= out.tables["confidence"].first()["confidence"] <= 1
    told = {r["topic"]: r["text"] for r in out.tables["narrative"].collect()}
    assert told["drivers"].startswith("first") and "No " not in told.get("interaction", "")
    page = open(write(out, config, str(tmp_path))).read()
    assert page.count("<svg") >= 8 and len(list((tmp_path / "out" / config.assets_dir).glob("*.svg"))) >= 8
    with pytest.raises(ConfigurationError):
        build({"target": "y", "plots": "everything"})


def test_stream_monitor(spark, tmp_path):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    edges, shares = monitor.reference_bins(ref, "v")
    ref.select((F.col("v") + 60).alias("v")).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("v double").parquet(str(tmp_path / "in"))
    q = monitor.monitor(stream, "v", edges, shares, lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got[0]["n"] == 1000 and got[0]["psi"] > 0.25


def test_workbook(spark, tmp_path):
    """The first sheet: shared and inline strings, gaps, numbers and booleans."""
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>amount</t></is></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="C3" t="b"><v>1</v></c></row>
<row r="4"><c r="A4"><v>3</v></c><c r="B4"><v>7.5</v></c></row><row r="5"><c r="A5"><v>4</v></c><c r="B5"><v>9</v></c><c r="C5" t="s"><v>2</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>key</t></si><si><t>note</t></si><si><r><t>plain </t></r><r><t>text</t></r></si></sst>')
    d = tabular.load(spark, str(tmp_path / "t.xlsx"))
    assert [tuple(r) for r in d.select("key", "amount", "note").orderBy("key").collect()] == [(1.0, 2.5, "plain text"), (2.0, None, "TRUE"), (3.0, 7.5, None), (4.0, 9.0, "plain text")]


def test_text_is_split_unless_fields_hold_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(5000)))
    (tmp_path / "broken.csv").write_text('a,b\n1,"two\nlines"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        plain, broken = tabular.read_text_table(spark, str(tmp_path / "plain.csv")), tabular.read_text_table(spark, str(tmp_path / "broken.csv"))
        assert plain.rdd.getNumPartitions() > 3 and broken.rdd.getNumPartitions() == 1
        assert plain.where('b = concat(\'x, "\', a, \'"\')').count() == 5000 and broken.first()["b"] == "two\nlines"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_interactive_questions():
    from quillon.__main__ import QUESTIONS, asked

    answers = iter(["data.csv", "revenue", "", "", "nonsense", "quick", *[""] * (len(QUESTIONS) - 4)])
    said = []
    argv = asked(["--interactive"], lambda _: next(answers), said.append)
    assert argv == ["data.csv", "--target", "revenue", "--profile", "quick"] and len(said) == 1
    config = from_args(argv)
    assert config.target == "revenue" and config.profile == "quick" and config.dataset == "data.csv"


def test_nothing_but_findings_is_told():
    from quillon.operators import relate

    assert relate.narrative_rows([("a", None), ("b", "No effect"), ("c", " x leads "), ("d", "Insufficient rows"), ("e", "y")]) == [(1, "c", "x leads"), (2, "e", "y")]


def test_drawings_are_kept(tmp_path):
    """Every kind is well-formed, escapes names, and is drawn once."""
    from xml.etree import ElementTree

    from quillon import drawing

    odd = '<b>&"x'
    data = {
        "scatter": {odd: [(0.0, 1.0), (2.0, float("nan")), (3.0, 4.0)], "other": []}, "lines": {"a": [(2.0, 1.0), (1.0, 0.0)], odd: [(1.0, 5.0)]}, "bars": [(odd, 3.0), ("b", 0.0)],
        "boxes": [(odd, 0.0, 1.0, 2.0, 3.0, 9.0)], "pie": [(odd, 3.0), ("b", 1.0)], "heatmap": [(0, 0, odd, "b", 1.0), (0, 1, "a", "b", -0.5)], "schedule": [(odd, 5.0, 2.0), ("b", 6.0, 1.0)], "solid": [(0.0, 1.0, 2.0), (1.0, 1.0, 1.0)],
    }
    assert set(data) == set(drawing.KINDS)
    for kind, rows in data.items():
        path = drawing.draw(kind, rows, f"title {odd}", tmp_path / "assets")
        assert "<b>" not in path.read_text() and ElementTree.parse(path).getroot().tag.endswith("svg")
        path.write_text("kept")
        assert drawing.draw(kind, rows, f"title {odd}", tmp_path / "assets").read_text() == "kept"
        assert drawing.draw(kind, rows, "another", tmp_path / "assets") != path
    for kind, empty in (("scatter", {}), ("lines", {"a": []}), ("bars", []), ("boxes", []), ("pie", []), ("heatmap", []), ("schedule", []), ("solid", [])):
        ElementTree.fromstring(drawing.KINDS[kind](empty, "nothing"))
