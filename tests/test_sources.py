import gzip
import hashlib
import json

import pytest

from pitlake.sources import paged, readers


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Ticker,Open,High,Low,Close,Volume\n2020-01-02,A,1,2,0.5,1.5,10\n,A,1,2,0.5,1.5,10\n2020-13-02,A,1,2,0.5,1.5,10\n")
    assert [tuple(map(str, r)) for r in readers.ohlcv_csv(spark, str(tmp_path / "a.csv")).collect()] == [("A", "2020-01-02", "1.0", "2.0", "0.5", "1.5", "10.0")]
    (tmp_path / "w.csv").write_text("Date,A,B\nTicker,,\n2020-01-02,1,2\n2020-01-03,,2\n2020-01-06,3,4\n")
    got = readers.wide_closes_csv(spark, str(tmp_path / "w.csv"), ["A", "B"]).collect()
    assert sorted((r.sym, str(r.day), r.close) for r in got) == [("A", "2020-01-02", 1.0), ("A", "2020-01-06", 3.0), ("B", "2020-01-02", 2.0), ("B", "2020-01-06", 4.0)]


def test_json(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"arm":"a","cutoff":"2020-01-02","ticker":"X","resolve_date":"2020-01-09","p":0.6,"ret":0.01,"up":true}\n{"arm":"b","cut\n\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "p.jsonl"), readers.PREDICTIONS)
    assert good.count() == 1 and [r.line for r in bad.collect()] == ['{"arm":"b","cut']
    (tmp_path / "r1.json").write_text('{\n"name": "x",\n"score": 1.5}')
    (tmp_path / "r2.json").write_text('{"name": "y"}')
    (tmp_path / "r3.json").write_text("{oops")
    assert [(r.name, r.file) for r in readers.run_reports(spark, f"{tmp_path}/r*.json", "name string, score double", ["name", "score"]).collect()] == [("x", "r1.json")]
    meta = tmp_path / "prov.json"
    meta.write_text(json.dumps({"sha256": hashlib.sha256((tmp_path / "p.jsonl").read_bytes()).hexdigest()}))
    assert readers.gated(spark, str(tmp_path / "p.jsonl"), readers.PREDICTIONS, str(meta)).count() == 1
    meta.write_text('{"sha256": "0"}')
    with pytest.raises(ValueError):
        readers.gated(spark, str(tmp_path / "p.jsonl"), readers.PREDICTIONS, str(meta))


def test_bar_formats(spark):
    k = readers.kline_bars(spark.createDataFrame([(["1577923200000", "1", "2", "0.5", "1.5", "9"],)], "k array<string>")).first()
    assert (str(k.day), k.close, k.volume) == ("2020-01-02", 1.5, 9.0)
    z = readers.zulu_bars(spark.createDataFrame([("2020-01-03T02:00:00Z", 1.0, 2.0, 0.5, 1.5, 9.0)], "t string, o double, h double, l double, c double, v double")).first()
    assert str(z.day) == "2020-01-02"
    e = readers.epoch_bars(spark.createDataFrame([(1578016800000, 1.0, 2.0, 0.5, 1.5, None)], "t bigint, o double, h double, l double, c double, v double")).first()
    assert (str(e.day), e.volume) == ("2020-01-02", 0.0)


def test_texts_and_feeds(spark, tmp_path):
    with gzip.open(tmp_path / "k1.txt.gz", "wt") as f:
        f.write("line one\nline two")
    assert [(r.key, r.text) for r in readers.whole_texts(spark, f"{tmp_path}/*.txt.gz").collect()] == [("k1", "line one\nline two")]
    page = "<rss><item><title><![CDATA[A & B]]></title><link>http://x</link><pubDate>Fri</pubDate></item><item><title>C</title></item></rss>"
    got = readers.feed_items(spark.createDataFrame([(page,), (None,), ("",)], "page string"), "page").collect()
    assert [(r.title, r.link, r.published) for r in got] == [("A & B", "http://x", "Fri"), ("C", "", "")]


def test_versions_and_panels(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, s string")
    assert sorted((r.k, r.s) for r in readers.latest_by_key(h, ["k"], ["v"]).collect()) == [("a", "y"), ("b", "z")]
    assert sorted((r.k, r.valid_from, r.valid_to) for r in readers.versions(h, ["k"], "v").collect() if r.k == "a") == [("a", 1, 2), ("a", 2, None)]
    p = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0), ("A", 2, 1.0), ("B", 2, None)], "sym string, day int, close double")
    assert {r.day for r in readers.complete_days(p).collect()} == {1}
    assert readers.panel(p, p.select("day"), p.select("sym")).count() == 4
    f = spark.createDataFrame([(1, "2020-01-01", "b", 5.0), (1, "2020-01-01", "a", 4.0), (1, "2021-01-01", "0", 9.0)], "cik int, filed string, accn string, val double")
    assert [tuple(r) for r in readers.first_reported(f, ["cik"], "filed", "accn", "val").collect()] == [(1, 4.0, "2020-01-01")]
    x = spark.createDataFrame([(1, "2.02, 9.01", "2020-05-01"), (2, "2.02", "2020-05-01"), (1, "8.01", "2020-05-01")], "cik int, items string, filed string")
    m = spark.createDataFrame([(1, 2020), (1, 2020), (2, 2019)], "cik int, year int")
    assert [r.cik for r in readers.item_events(x, "items", "2.02", m).collect()] == [1] == [r.cik for r in readers.item_events(x, "items", "9.01", m).collect()]
    s = readers.synthetic_prices(spark, ["AB", "C"], "2020-01-01", "2020-01-10")
    assert s.count() == 20 and s.where("close is null").count() == 0
    assert readers.report(h.where("v = 2")).first().value == '{"k":"a","v":2,"s":"y"}'


def test_pages(spark, tmp_path):
    bar = lambda t, c: {"t": t, "o": 1, "h": 2, "l": 0.5, "c": c}
    (tmp_path / "A.json").write_text(json.dumps({"bars": [bar("d1", 1)], "next": "A2.json"}))
    (tmp_path / "A2.json").write_text(json.dumps({"bars": [bar("d2", 2)], "next": "A.json"}))
    paged.register(spark)
    got = spark.read.format("paged").option("path", str(tmp_path)).option("symbols", "A,B").load().collect()
    assert sorted((r.sym, r.t, r.c, r.v) for r in got) == [("A", "d1", 1.0, 0.0), ("A", "d2", 2.0, 0.0)]
