import json

from candela.sources import files, store


def line(i, *cells):
    return f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00-05:00," + ",".join(str(c) for c in cells)


def test_folder_of_csv_files(spark, tmp_path):
    hourly = ["Date,Close,High,Low,Open,Volume", ",BTC,BTC,BTC,BTC,BTC"] + [line(i, 10 + i, 20, 5, 9, 100) for i in range(120)]
    daily = ["Date,Open,High,Low,Close,Volume"] + [line(i, 1, 2, 3, 4, 5) for i in range(150)]
    adjusted = ["Datetime,Open,Adj Close,Close"] + [line(i, 1, 7.5, 8) for i in range(110)] + ["not a date,1,2,3"]
    quoted = ['"Date","Open","High","Low","Close","Volume"'] + [line(i, '"1,234.5"', 2, 1, '" 1,000 "', '"closed"') for i in range(101)]
    (tmp_path / "Q.csv").write_text("\n".join(quoted) + "\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,the close of day\n")
    short = ["Date,Open,High,Low,Close,Volume"] + [line(i, 1, 2, 3, 4, 5) for i in range(20)]
    for name, rows in {"BTC-USD_1h": hourly, "BTC-USD": daily, "AAPL": adjusted, "X": short}.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(rows) + "\n")
    got = files.read_ohlcv_folder(spark, str(tmp_path)).toPandas()
    assert set(got.ticker) == {"BTC", "AAPL", "Q"}
    q = got[got.ticker == "Q"]
    assert len(q) == 101 and (q.open == 1234.5).all() and (q.close == 1000).all() and (q.volume == 0).all()
    assert [r["file"] for r in files.rejected_files(spark, str(tmp_path)).collect()] == ["notes.csv"]
    btc = got[got.ticker == "BTC"].sort_values("ts")
    assert len(btc) == 120 and str(btc.ts.iloc[0]) == "2024-01-01 05:00:00"
    assert (btc.close.iloc[3], btc.open.iloc[3], btc.high.iloc[3]) == (13, 9, 20)
    aapl = got[got.ticker == "AAPL"]
    assert len(aapl) == 110 and (aapl.close == 7.5).all() and (aapl.high == 7.5).all() and (aapl.volume == 0).all()


def test_result_arrays(spark, tmp_path):
    day = {"date": "2024-01-02", "portfolio_value": 1.5, "benchmark_value": 1.0, "allocations": {"a": 0.4}, "confidence": 0.7, "regime": "bull", "optimizer": "Kelly"}
    (tmp_path / "results_low.json").write_text(json.dumps([day, day | {"date": "2024-01-03"}]))
    rows = files.read_results(spark, str(tmp_path / "results_low.json"), array_files=True).orderBy("date").collect()
    assert [str(r["date"]) for r in rows] == ["2024-01-02", "2024-01-03"] and rows[0]["allocations"] == {"a": 0.4}


def test_stored_stage_knows_changed_series(spark, tmp_path):
    from series import make_bars

    _, bars = make_bars(spark, lengths=(20, 10))
    store.save_stage(str(tmp_path), {"a": 1}, bars, bars.select("ticker", "ts", "close"), bars.select("ticker", "ts"))
    grown = bars.unionByName(bars.filter("ticker = 't1'").selectExpr("ticker", "ts + INTERVAL 900 DAYS AS ts", "open", "high", "low", "close", "volume"))
    features, events, stale = store.load_stage(spark, str(tmp_path), {"a": 1}, grown)
    assert features.count() == 20 and events.count() == 20
    assert [r["ticker"] for r in stale.collect()] == ["t1"]
    assert store.config_hash({"a": 1, "b": 2}) == store.config_hash({"b": 2, "a": 1}) != store.config_hash({"a": 2})
