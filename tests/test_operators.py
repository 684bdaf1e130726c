"""Operators against hand-worked cases and brute force."""

import itertools
import math
import random
from decimal import Decimal as D
from decimal import localcontext

import pytest
from pyspark.sql import functions as F

from quillspar.functions import numeric
from quillspar.operators import asof, book, features, intervals, ledger, prefix, replay, series, session, settlement


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [None, lambda t: F.floor(t / 7)])
def test_asof_brute(spark, forward, strict, block):
    rng = random.Random(3)
    left = [(i, rng.randrange(3), rng.randrange(40)) for i in range(60)]
    right = [(rng.randrange(3), t, t * 10) for t in rng.sample(range(40), 25)]
    got = asof.asof(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "t", ["v"], forward=forward, strict=strict, block=block)

    def best(k, t):
        ok = [x for x in right if x[0] == k and ((x[1] > t or (x[1] == t and not strict)) if forward else (x[1] < t or (x[1] == t and not strict)))]
        return (min if forward else max)(ok, key=lambda x: x[1])[2] if ok else None

    assert {r.id: r.v for r in got.collect()} == {i: best(k, t) for i, k, t in left}


def test_intervals_brute(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randrange(2), s := rng.randrange(300), s + rng.randrange(40)) for _ in range(n)]
    a, b = make(40), make(40)
    frame = lambda x: spark.createDataFrame(x, "k int, start long, end long")
    covered = lambda x, k: {t for q, s, e in x if q == k for t in range(s, e)}
    merged = intervals.islands(frame(a), ["k"], "start", "end").collect()
    for k in (0, 1):
        assert {t for r in merged if r.k == k for t in range(r.start, r.end)} == covered(a, k)
        ours = sorted((r.start, r.end) for r in merged if r.k == k)
        assert all(x[1] < y[0] for x, y in zip(ours, ours[1:]))
    pairs = sorted((x[0], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))
    assert rows(intervals.overlap(frame(a), frame(b), ["k"], 7), "k", "clip_start", "clip_end") == pairs
    missing = sorted(x for x in a if not any(y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in b))
    assert rows(intervals.uncovered(frame(a), frame(b), ["k"]), "k", "start", "end") == missing


def tape(spark, seed=1, n=300):
    rng = random.Random(seed)
    q = lambda x, p: D(x).quantize(D(10) ** -p)
    trades = [(i, i % 2, i % 2, rng.choice(["BUY", "SELL"]), q(str(rng.randint(1, 99) / 100), 10), q(str(rng.randint(1, 50)), 10), i // 3) for i in range(n)]
    orders = [(i, i % 2, i % 2, rng.choice(["BUY", "SELL"]), q(str(rng.randint(20, 80) / 100), 10), q(str(rng.randint(1, 40)), 10), (x := rng.randrange(90)), x + rng.randrange(1, 40), rng.choice(["GTC", "FOK", "IOC"])) for i in range(60)]
    return (
        spark.createDataFrame(orders, "order_index long, market_id int, asset_id int, side string, limit_price decimal(11,10), size decimal(26,10), arrival long, deadline long, tif string"),
        spark.createDataFrame(trades, "trade_id long, market_id int, asset_id int, side string, price decimal(11,10), size decimal(26,10), block long"),
    )


def test_private_fills_equal_one_order_folds(spark):
    orders, trades = tape(spark)
    got = {}
    for r in replay.private_fills(orders, trades, rate="0.1000", bucket=11, buffer="0.0050").collect():
        got.setdefault(r.order_index, []).append((r.trade_id, r.exec_price, r.qty))
    tape_rows = [r.asDict() for r in trades.collect()]
    for order in orders.collect():
        mine = [t for t in tape_rows if t["asset_id"] == order.asset_id]
        alone = [(f["trade_id"], f["exec_price"], f["qty"]) for f in replay.shared_fold([order.asDict()], mine, D("0.1"), D("0.005"))]
        assert sorted(got.get(order.order_index, [])) == sorted(alone)


def test_shared_fills_use_up_the_tape_in_order(spark):
    orders, trades = tape(spark)
    fills = replay.shared_fills(orders, trades, rate="0.5").collect()
    used, sizes = {}, {r.trade_id: r["size"] for r in trades.collect()}
    for f in fills:
        used[f.trade_id] = used.get(f.trade_id, 0) + f.qty
    assert fills and all(q <= sizes[t] / 2 for t, q in used.items())
    wanted = {r.order_index: r for r in orders.collect()}
    for i in {f.order_index for f in fills}:
        total = sum(f.qty for f in fills if f.order_index == i)
        assert total == wanted[i]["size"] if wanted[i].tif == "FOK" else total <= wanted[i]["size"]


@pytest.mark.parametrize("cap", [None, "5"])
def test_runs_of_a_hot_market_are_folded_apart(spark, cap):
    """One market and asset, with pauses: several runs, and the fills of one fold over everything."""
    rng = random.Random(5)
    at = [100 * rng.randrange(12) + rng.randrange(30) for _ in range(80)]
    orders = spark.createDataFrame([(i, 0, 0, rng.choice(["BUY", "SELL"]), D("0.50"), D(rng.randint(1, 9)), x, x + rng.randrange(12), rng.choice(["GTC", "FOK"])) for i, x in enumerate(at)], "order_index long, market_id int, asset_id int, side string, limit_price decimal(11,10), size decimal(26,10), arrival long, deadline long, tif string")
    trades = spark.createDataFrame([(i, 0, 0, rng.choice(["BUY", "SELL"]), D("0.50"), D(rng.randint(1, 6)), rng.randrange(1300)) for i in range(600)], "trade_id long, market_id int, asset_id int, side string, price decimal(11,10), size decimal(26,10), block long")
    got = replay.shared_fills(orders, trades, rate="0.5", window_cap=cap, window_blocks=7)
    want = list(replay.shared_fold([r.asDict() for r in orders.collect()], [r.asDict() for r in trades.collect()], D("0.5"), D(0), None if cap is None else D(cap), 7))
    assert sorted((r.order_index, r.trade_id, r.qty) for r in got.collect()) == sorted((f["order_index"], f["trade_id"], f["qty"]) for f in want) and want
    assert replay.runs(orders, ["market_id", "asset_id", "side"]).select("side", "run").distinct().count() > 10


def test_limit_replay_is_the_fold_of_each_order(spark):
    orders, trades = tape(spark)
    tape_rows = [r.asDict() for r in trades.collect()]
    plain = lambda r: {k: float(v) if isinstance(v, D) else v for k, v in r.items()}
    want = {}
    for o in orders.collect():
        own = [plain(t) for t in tape_rows if (t["market_id"], t["asset_id"]) == (o.market_id, o.asset_id)]
        fills = list(session.limit_fold(plain(o.asDict()), own, rate=0.25, decay=0.98, queue_factor=0.9))
        if o.tif != "FOK" or sum(f["qty"] for f in fills) >= float(o["size"]) - 1e-9:
            want |= {(f["order_index"], f["trade_id"]): f["qty"] for f in fills}
    got = {(r.order_index, r.trade_id): r.qty for r in session.limit_replay(orders, trades).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[k] - q) < 1e-9 for k, q in want.items())


def test_window_cap_holds(spark):
    orders, trades = tape(spark)
    fills = replay.shared_fills(orders, trades, rate="1", window_cap="5", window_blocks=10).collect()
    sides = {r.trade_id: (r.asset_id, r.side) for r in trades.collect()}
    per = {}
    for f in fills:
        key = (*sides[f.trade_id], f.block // 10)
        per[key] = per.get(key, 0) + f.qty
    assert per and max(per.values()) <= 5


def test_maker_fills_eat_the_queue_first(spark):
    orders = spark.createDataFrame([(1, 0, 0, "BUY", D("0.50"), D(10), 0, 9, "GTC", D(4))], "order_index long, market_id int, asset_id int, side string, limit_price decimal(11,10), size decimal(26,10), arrival long, deadline long, tif string, queue_ahead decimal(26,10)")
    trades = spark.createDataFrame([(i, 0, 0, "SELL", D("0.50"), D(s), i) for i, s in enumerate([3, 3, 20])], "trade_id long, market_id int, asset_id int, side string, price decimal(11,10), size decimal(26,10), block long")
    assert rows(replay.maker_fills(orders, trades, bucket=5), "trade_id", "qty") == [(1, D(2)), (2, D(8))]


def test_xorshift_and_paths(spark):
    assert replay.xorshift64(1) == 1082269761
    o = spark.createDataFrame([(i, 0.3, 10.0, 1.0, 50.0) for i in range(20)], "order_index long, intensity double, horizon double, clip double, size double")
    a = rows(replay.poisson_paths(o, 200), "order_index", "q10", "q50", "q90")
    assert a == rows(replay.poisson_paths(o.repartition(7), 200), "order_index", "q10", "q50", "q90")
    assert all(x[1] <= x[2] <= x[3] for x in a) and 2 <= sum(x[2] for x in a) / 20 <= 4


def test_fee_is_cut_not_rounded(spark):
    df = spark.createDataFrame([(D("10"), D("0.37"), D("0.0200"))], "s decimal(26,10), p decimal(6,4), r decimal(5,4)")
    assert df.select(numeric.fee(F.col("s"), F.col("p"), F.col("r")).alias("f")).first().f == D("0.04662")


def test_percentiles_and_piecewise(spark):
    got = spark.range(1).select(
        numeric.index_percentile(F.array(*map(F.lit, [1, 2, 3, 4])), 0.5).alias("a"), numeric.upper_median(F.array(*map(F.lit, [1, 2, 3, 4]))).alias("b"), numeric.piecewise(F.lit(0.5), [(0.0, 0.0), (1.0, 2.0)]).alias("c"), numeric.piecewise(F.lit(9.0), [(0.0, 0.0), (1.0, 2.0)]).alias("d")
    ).first()
    assert (got.a, got.b, got.c, got.d) == (3, 3, 1.0, 2.0)


def test_m4_keeps_extremes(spark):
    rng = random.Random(2)
    data = [(0, x, rng.random()) for x in range(500)]
    got = series.m4(spark.createDataFrame(data, "k int, x long, v double"), ["k"], "x", "v", 42)
    values = [r.v for r in got.collect()]
    assert len(values) <= 42 and min(values) == min(v for _, _, v in data) and max(values) == max(v for _, _, v in data)


def test_lots_draw_in_proportion_and_the_last_takes_the_rest(spark):
    entries = [(1, 1, D(10), D(5)), (1, 2, D(20), D(16)), (1, 3, D(-10), D(0)), (1, 4, D(-50), D(0)), (1, 5, D(7), D(7)), (1, 6, D(-2), D(0)), (2, 1, D(-1), D(0)), (2, 2, D(3), D(1)), (2, 3, D(-1), D(0))]
    got = settlement.lots(spark.createDataFrame(entries, "k long, seq long, qty decimal(18,4), cost decimal(18,4)"), ["k"])
    found = {(r.k, r.seq): r for r in got.collect()}
    third = found[1, 3]
    # 10 of 30: 3.3333333333 of the first lot, what is left of the second
    assert (third.sold, third.cost, third.open_qty, third.open_lots) == (10, D("1.6666666667") + D("5.3333333334"), 20, 2)
    assert (found[1, 4].sold, found[1, 4].short, found[1, 4].open_lots, found[1, 4].open_cost) == (20, 30, 0, 0) and third.cost + found[1, 4].cost == 21
    assert (found[1, 6].cost, found[1, 6].open_qty, found[2, 1].short, found[2, 1].sold, found[2, 3].open_qty) == (2, 5, 1, 0, 2)
    rng = random.Random(2)
    many = [(i, D(rng.randint(-40, 50)) / 10, D(rng.randint(1, 90)) / 10) for i in range(120)]
    alone = list(settlement.lots_fold([{"seq": i, "qty": q, "cost": c} for i, q, c in many]))
    split = settlement.lots(spark.createDataFrame([(1, *r) for r in many], "k long, seq long, qty decimal(18,4), cost decimal(18,4)"), ["k"]).orderBy("seq").collect()
    names = ("seq", "sold", "cost", "short", "open_lots", "open_qty", "open_cost")
    assert [tuple(r[n] for n in names) for r in split] == [tuple(r[n] for n in names) for r in alone]


@pytest.mark.parametrize("grouped", [False, True])
def test_trades_and_decreases_are_used_once(spark, grouped):
    """Against a slow version that looks at every earlier event."""
    rng = random.Random(8)
    events = [{"k": rng.randrange(2), "x": rng.randrange(400), "kind": rng.choice(["trade", "decrease"]), "id": i, "size": float(rng.randint(1, 9)), "group": rng.choice([None, "a", "b"]) if grouped else None} for i in range(160)]
    want = {}
    for k in (0, 1):
        seen = []
        for e in sorted((e for e in events if e["k"] == k), key=lambda e: (e["x"], e["kind"] != "trade", e["id"])):
            e = dict(e, left=e["size"])
            for o in seen:
                near = abs(e["x"] - o["x"]) <= 6
                linked = o["group"] == e["group"] if o["group"] and e["group"] else near
                if o["kind"] != e["kind"] and linked and min(e["left"], o["left"]) > 0:
                    take = min(e["left"], o["left"])
                    e["left"], o["left"] = e["left"] - take, o["left"] - take
            seen.append(e)
        want |= {e["id"]: e["size"] - e["left"] for e in seen}
    rows_ = [(e["k"], e["x"], e["kind"], e["id"], e["size"], e["group"]) for e in events]
    got = book.reconcile(spark.createDataFrame(rows_, "k long, x long, kind string, id long, size double, group string"), ["k"], 6)
    assert {r.id: r.matched for r in got.collect()} == want and sum(want.values()) > 0


def test_threshold(spark):
    bars = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.1, 0.6, 0.7, 0.8, 0.5, 0.6, 0.4])], "k long, seq long, price double")
    got = rows(ledger.threshold_strategy(bars, ["k"], entry=0.58, exit_=0.44, stop=0.075, target=0.16, max_bars=96), "entry_seq", "exit_seq", "reason")
    assert got == [(1, 3, "target"), (5, 6, "stop")]


def test_auc_and_logistic(spark):
    rng = random.Random(4)
    data = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(80)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "s double, y int")
    assert abs(ledger.auc(df, "s", "y").first().auc - want) < 1e-12
    a, b = ledger.logistic(df, "s", "y")
    p = df.select(F.avg(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("s"))))), F.avg("y")).first()
    assert abs(p[0] - p[1]) < 1e-9


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(i % 30, float(i % 7)) for i in range(900)], "c int, v double")
    got = ledger.cluster_bootstrap(df, "c", "v", 100, 1).first()
    mean = df.agg(F.avg("v")).first()[0]
    assert got.low <= mean <= got.high


def test_book_rules(spark):
    b = book.Book()
    e = lambda seq, kind, side, price, size, **x: b.apply({"seq": seq, "kind": kind, "side": side, "price": price, "size": size, **x})
    assert e(1, "delta", "BID", 0.4, 5) == "stale"
    assert e(2, "book", "BID", 0.4, 5) == "applied" and e(3, "delta", "BID", 0.6, 2) == "applied"
    assert e(3, "delta", "BID", 0.6, 2) == "out_of_order"
    assert e(4, "delta", "ASK", 0.5, 1, best_bid=0.4) == "applied"
    assert b.top() == (0.4, 0.5) and not b.crossed
    assert e(5, "gap", "BID", 0.0, 0) == "gap" and e(6, "delta", "BID", 0.3, 1) == "stale"


def test_fifo_and_fusion(spark):
    fills = list(book.fifo_fold([{"order_index": 2, "arrival": 1, "deadline": 9, "queue_ahead": 0.0, "size": 5.0}, {"order_index": 1, "arrival": 0, "deadline": 9, "queue_ahead": 3.0, "size": 4.0}], [{"x": 2, "flow_id": 7, "size": 6.0, "cancel": 1.0}]))
    assert [(f["order_index"], f["qty"]) for f in fills] == [(1, 4.0), (2, 2.0)]
    levels = spark.createDataFrame([(1, "YES", "ASK", D("0.60"), 5.0), (1, "NO", "BID", D("0.40"), 8.0)], "condition_id int, outcome string, side string, price decimal(11,10), size double")
    assert rows(book.fused_levels(levels), "side", "price", "size", "sources") == [("ASK", D("0.6"), 8.0, 2)]


def test_residual_book():
    b = book.ResidualBook(haircut=0.5)
    b.delta("YES", "ASK", 0.6, 10.0)
    b.delta("NO", "BID", 0.4, 16.0)  # the mirror of a YES ask at 0.6
    assert b.fused("ASK", 0.6) == 16.0
    assert b.take("BUY", 0.7, 5.0) == (5.0, 3.0) and b.take("BUY", 0.7, 9.0) == (3.0, pytest.approx(1.8))
    assert b.take("BUY", 0.7, 1.0) == (0.0, 0.0)
    b.delta("NO", "BID", 0.4, 18.0)  # grown by two
    assert b.take("BUY", 0.7, 9.0)[0] == 3.0
    b.snapshot("NO")
    assert b.fused("ASK", 0.6) == 10.0 and b.take("BUY", 0.5, 9.0) == (0.0, 0.0) and b.take("BUY", 0.6, 9.0)[0] == 5.0


def test_sessions_on_two_clocks():
    from quillspar.operators import session

    e = lambda ts, seq, kind, **x: {"ts": ts, "seq": seq, "kind": kind, "order_id": -1, "side": "", "price": 0.0, "size": 0.0, "ttl": 0, **x}
    events = [
        e(0, 1, "submit", order_id=1, side="BUY", price=0.5, size=4.0, ttl=100), e(1, 2, "trade", side="SELL", price=0.4, size=9.0), e(2, 3, "trade", side="SELL", price=0.5, size=1.0),
        e(3, 4, "cancel", order_id=1), e(4, 5, "trade", side="SELL", price=0.5, size=1.0), e(9, 6, "trade", side="SELL", price=0.5, size=9.0), e(0, 7, "submit", order_id=2, side="BUY", price=0.3, size=1.0, ttl=3),
    ]
    got = {r["order_id"]: (r["filled"], r["status"]) for r in session.session_fold(events, 2)}
    assert got == {1: (1.0, "CANCELLED"), 2: (0.0, "EXPIRED")}
    assert session.shard_plan({"a": 5, "b": 4, "c": 3}, 2) == {"a": 0, "b": 1, "c": 1}
    assert session.shard_plan({"a": 5, "b": 4}, 2, {"a": 1, "b": 0}, moves=0) == {"a": 1, "b": 0}


def test_catalog_resumes_and_prunes(spark, tmp_path):
    from quillspar.sources.catalog import TradeCatalog
    from quillspar.sources.sinks import ParquetTable

    rows = [(i, i, f"2024-01-{1 + i // 10:02d} 00:00:00") for i in range(100)]
    t = spark.createDataFrame(rows, "trade_id long, block long, at string").withColumn("block_time", F.col("at").cast("timestamp_ntz")).drop("at")
    c = TradeCatalog(spark, f"file://{tmp_path}/c")
    assert c.build(t.where("block < 50")) == 5 and c.build(t) == 5 and c.build(t) == 0
    assert len(c.files("block", 41, 52)) == 2 and c.window("block", 41, 52).count() == 12 and c.window("block", 900, 901).count() == 0
    table = ParquetTable(spark, f"file://{tmp_path}/t", ["k"])
    one = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert table.upsert_changed(one) == 2 and table.upsert_changed(one) == 0
    assert table.upsert_changed(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")) == 2 and table.read().count() == 3
    both = spark.createDataFrame([(None, "n"), (None, "m"), (3, "d")], "k int, v string")
    table.upsert(both)
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "a"), (2, "b"), (3, "d"), (None, "n")}
    before = table.latest().files
    table.append(one)
    assert table.latest().files[: len(before)] == before and table.read().count() == 6


def test_a_lost_writer_and_a_faster_one(spark, tmp_path, monkeypatch):
    """A reader between a writer's two steps sees the old version; a writer that finds its number taken starts again."""
    from quillspar.sources import sinks

    monkeypatch.setattr(sinks, "PATIENCE", 0.3)
    make = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    table = sinks.ParquetTable(spark, f"file://{tmp_path}/t", ["k"])
    table.append(make(1))
    table.write_files(make(2))  # lost before its manifest
    fs, path = table._fs(table._number_file(2))
    fs.create(path, False).close()  # lost within its manifest
    assert [r.k for r in table.read().collect()] == [1]
    table.append(make(3))
    assert sorted(r.k for r in table.read().collect()) == [1, 3]
    put, raced = sinks.ParquetTable._put, []

    def race(self, manifest):
        if not raced:
            raced.append(1)
            table.append(make(4))
        return put(self, manifest)

    monkeypatch.setattr(sinks.ParquetTable, "_put", race)
    table.insert_absent(make(4, 5))
    assert sorted(r.k for r in table.read().collect()) == [1, 3, 4, 5]
    assert table.vacuum() >= 1 and sorted(r.k for r in table.read().collect()) == [1, 3, 4, 5]


def test_receipts_publish_after_the_check_and_revoke_overlaps(spark, tmp_path):
    from quillspar.sources.sinks import ParquetTable, Receipts

    make = lambda low, high: spark.range(low, high).withColumnRenamed("id", "block")
    table = ParquetTable(spark, f"file://{tmp_path}/t", ["block"])
    receipts = Receipts(table)
    blocks = lambda: [] if table.read() is None else sorted(r.block for r in table.read().collect())
    assert not receipts.run("a", 0, 5, lambda: make(0, 5), lambda df: df.count() == 6) and blocks() == [] and receipts.receipts() == {}
    assert receipts.run("a", 0, 5, lambda: make(0, 5), lambda df: df.count() == 5) and blocks() == [0, 1, 2, 3, 4]
    assert not receipts.run("a", 0, 5, lambda: make(0, 5), lambda df: True)
    assert receipts.run("b", 5, 9, lambda: make(5, 9), lambda df: True) and receipts.missing(["a", "b", "c"]) == ["c"]
    assert receipts.run("c", 4, 6, lambda: make(4, 6), lambda df: True) and blocks() == [4, 5] and list(receipts.receipts()) == ["c"]
    receipts.revoke(5, 100)
    assert blocks() == [] and receipts.receipts() == {}
    assert receipts.run("d", 20, 21, lambda: make(20, 20), lambda df: True) and receipts.receipts()["d"]["rows"] == 0


def test_prior_and_strata(spark):
    data = [("a", 1, 1), ("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    got = {(r.k, r.c): r.rate for r in features.hierarchical_prior(spark.createDataFrame(data, "k string, c int, y int"), ["k", "c"], "y", 2.0).collect()}
    root = 2 / 4
    a = (2 + 2 * root) / 5
    assert got[None, None] == root and abs(got["a", None] - a) < 1e-12 and abs(got["a", 2] - (1 + 2 * a) / 3) < 1e-12
    table = spark.createDataFrame([("a", 1, 9, 0.5), ("a", 2, 1, 0.9)], "k string, c int, n long, value double")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("z", 1)], "k string, c int")
    assert [(r.k, r.c, r.depth) for r in sorted(features.strata_lookup(asked, table, ["k", "c"], "value", 5).collect())] == [("a", 1, 2), ("a", 2, 1), ("z", 1, 0)]


def test_global_orders(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([None, *range(20)]), rng.randrange(5)) for i in range(203)]
    df = spark.createDataFrame(data, "i int, s int, v long")
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = {r.i: r.row_number for r in prefix.row_numbers(df, "s", ["i"], buckets=7).collect()}
    assert [got[r[0]] for r in order] == list(range(1, 204))
    bins = {r.i: r.bin for r in prefix.ntile(df, "s", ["i"], 10).collect()}
    assert [bins[r[0]] for r in order] == [b for b in range(1, 11) for _ in range(21 if b <= 3 else 20)]
    known = df.where("s is not null")
    before = {r.i: r.before for r in prefix.running_before(known, "s", "v", buckets=5).collect()}
    assert all(before[i] == sum(x[2] for x in data if x[1] is not None and x[1] < s) for i, s, _ in data if s is not None)


def test_empty_inputs(spark):
    orders, trades = tape(spark, n=3)
    none = trades.where("false")
    assert replay.private_fills(orders, none, rate="0.5", bucket=10).count() == 0
    assert replay.results(orders, replay.private_fills(orders, none, rate="0.5", bucket=10)).where("filled > 0").count() == 0
    assert series.m4(spark.createDataFrame([], "k int, x long, v double"), ["k"], "x", "v", 42).count() == 0


def test_poisson_query_simulates_250_paths(spark, monkeypatch):
    from quillspar.plans import replay_plans

    seen, simulate = [], replay.poisson_paths
    monkeypatch.setattr(replay_plans.R, "poisson_paths", lambda orders, paths: seen.append(paths) or simulate(orders, paths))
    assert "poisson_monte_carlo" in replay_plans.PLANS and replay_plans.PLANS["poisson_monte_carlo"][0](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [250]


def test_relevance_settles_ties_by_key(spark):
    from quillspar.operators import reports

    parts = spark.createDataFrame([(i, "t", "same", 1) for i in random.Random(4).sample(range(60), 60)], "id long, slug string, title string, w int").repartition(7)
    got = reports.relevance(parts, "x", slug="slug", title="title", weight=[F.col("w")], ties=["id"]).limit(20)
    assert [r.id for r in got.collect()] == list(range(20))


def test_touch_of_no_size(spark):
    """A first touch of no size is no error; the order outweighs it as far as any."""
    orders = spark.createDataFrame([(1, 1, 1, "BUY", D("0.5"), D(4), 10, 20, "GTC")], "order_index long, market_id int, asset_id int, side string, limit_price decimal(11,10), size decimal(26,10), arrival long, deadline long, tif string")
    trades = [(1, 1, 1, "SELL", D("0.4"), D(2), 5), (2, 1, 1, "SELL", D("0.4"), D(0), 12)]
    made = spark.createDataFrame(trades, "trade_id long, market_id int, asset_id int, side string, price decimal(11,10), size decimal(26,10), block long")
    (got,) = replay.touch_survival(orders, made, bucket=7, lookback=10).collect()
    assert (got.hits_before, got.first_touch, got.crosses) == (1, 12, 1)
    assert abs(got.probability - (1 - math.exp(-0.1 * (0.5 + math.exp(-20)) * 8))) < 1e-12


def test_gaps_are_paired_in_one_pass(spark):
    """Against a slow version; a frame that shrinks would be gone through again for every row."""
    rng = random.Random(6)
    marks = [(rng.randrange(3), t, rng.choice(["open", "close"])) for t in range(200)]
    got = intervals.paired(spark.createDataFrame(marks, "k int, t int, kind string"), ["k"], "t", F.col("kind") == "open", F.col("kind") == "close", F.lit(999))
    later = lambda k, t: min((x for q, x, kind in marks if q == k and x > t and kind == "close"), default=None)
    assert rows(got, "k", "start", "end", "recovered") == sorted((k, t, 999 if later(k, t) is None else later(k, t), later(k, t) is not None) for k, t, kind in marks if kind == "open")
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("block", [None, lambda t: F.floor(t / 7)])
def test_asof_ahead_is_one_pass(spark, block):
    a, b = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([(1, 3, 4), (1, 9, 5)], "k int, t int, v int")
    got = asof.asof(a, b, ["k"], "t", ["v"], forward=True, strict=True, block=block)
    assert [r.v for r in got.collect()] == [4] and "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_runs_of_a_level_are_no_groups_of_their_own(spark):
    """Thousands of short runs go through few calls of Python, and a run over several batches is one."""
    events = spark.range(3000).selectExpr("id % 2 as k", "if(id < 2000, id * 100, id) as x", "if(id % 4 < 2, 'trade', 'decrease') as kind", "id", "2.0 as size", "cast(null as string) as group")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = book.reconcile(events, ["k"], 50)
        found = {r.id: r.matched for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for k in (0, 1):
        own = [{"x": i * 100 if i < 2000 else i, "kind": "trade" if i % 4 < 2 else "decrease", "id": i, "size": 2.0, "group": None} for i in range(k, 3000, 2)]
        want |= {r["id"]: r["matched"] for r in book.credit_fold(own, 50)}
    assert found == want and sum(want.values()) > 0 and "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["cents", "units", "large", "mixed"])
def test_lots_at_once_are_the_fold(kind):
    """Whole units, ties and remainders as in decimals; what doubles can't hold goes on in decimals."""
    rng = random.Random(kind)
    draw = {"cents": lambda: (D(rng.randint(-40, 50)) / 10, D(rng.randint(0, 90)) / 10), "units": lambda: (D(rng.randint(-6, 8)).scaleb(-10), D(rng.randint(0, 5)).scaleb(-10)), "large": lambda: (D(rng.randint(-(10**15), 10**15)).scaleb(-10), D(rng.randint(0, 10**15)).scaleb(-10)), "mixed": lambda: (D(rng.randint(-(10**14), 10**14)).scaleb(rng.choice([-10, -10, -10, -6])), D(rng.randint(-10, 10**14)).scaleb(-10))}[kind]
    unit = lambda x: int(x.scaleb(10))
    with localcontext(prec=60):
        for _ in range(40):
            entries = [(i, *draw()) for i in range(rng.randint(2, 120))]
            lots, got = settlement.Lots(), []
            for _, qty, cost in entries:
                if qty > 0:
                    lots.add(unit(qty), unit(cost))
                elif qty < 0:
                    got.append(lots.sell(unit(-qty)))
            want = settlement.lots_fold([{"seq": i, "qty": q, "cost": c} for i, q, c in entries])
            assert got == [(unit(r["sold"]), unit(r["cost"]), unit(r["short"]), r["open_lots"], unit(r["open_qty"]), unit(r["open_cost"])) for r in want]


def test_positions_are_no_groups_of_their_own(spark):
    entries = spark.range(4000).selectExpr("id % 3 as k", "id as seq", "cast(if(id % 2 = 0, 1.5, -1.5) as decimal(18,4)) as qty", "cast(1 as decimal(18,4)) as cost")
    got = settlement.lots(entries, ["k"])
    assert got.count() == 2000 and "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_conversions_of_an_event_come_together(spark):
    outcomes = spark.range(600).selectExpr("id % 20 as event_id", "id as outcome_id", "id % 3 > 0 as active")
    held = spark.range(1800).selectExpr("id % 3 as account", "cast(id / 3 as long) % 20 as event_id", "cast(id / 3 as long) as outcome_id", "cast(1 as decimal(18,2)) as quantity")
    rows = settlement.converted(held, outcomes).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 1800 * 20 - 3 * 400 and all(r["target"] != r["outcome_id"] for r in rows)
    runs = [k for k, _ in itertools.groupby((r["part"], r["event_id"]) for r in rows)]
    assert len(runs) == len({event for _, event in runs}) == 20
    own, targets = [], []
    for key, of in itertools.groupby(rows, lambda r: (r["event_id"], r["account"], r["outcome_id"])):
        own.append(key)
        targets.append([r["target"] for r in of])
    assert len(own) == 1800
    for (event, _, a), (after, _, b), x, y in zip(own, own[1:], targets, targets[1:], strict=False):
        assert event != after or [t for t in x if t not in (a, b)] == [t for t in y if t not in (a, b)]


def test_conversions_cast_nothing_for_each_row(spark, sf):
    """What the join multiplies is final: a holding's quantity becomes a double below it."""
    from quillspar import catalogue

    got = catalogue.queries()["neg_risk_conversion"](spark, sf)
    above, _, below = got._jdf.queryExecution().optimizedPlan().toString().partition("Join ")
    assert dict(got.dtypes)["quantity"] == "double" and "as double" in below and "as double" not in above
