"""Ingest, deletes, shares and scaling on small inputs."""

import pytest
from pyspark.sql import functions as F

from tillgrain.functions import labels
from tillgrain.operators import cleaning as cln, factored, forecast as fc, menu, tables as tbl
from tillgrain.plans import forecast as pf
from tillgrain.session import run_path
from tillgrain.sources import pos_files, sales as src
from tillgrain.streaming import ingest as stream

CSV = """Order ID, qty ,price,cost,Category,name,date,time
1,2.9,10.5,4,Sweets,Cake,2022-04-15,08:30:00
1,1,10.5,4,Sweets,Cake,2022-04-15,
2,x,3,1,Tea,Black tea,2022-08-15,18:00:00
,1,3,1,Tea,Black tea,2022-08-15,18:00:00
3,1,3,1,Tea,Black tea,someday,18:00:00
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    return str(tmp_path)


def test_csv_scan_and_cleaning(spark, folder):
    rows = cln.enriched(cln.normalised(pos_files.read_csv(spark, folder), 7))
    kept = cln.valid_rows(rows).orderBy("order_reference", "order_datetime").collect()
    assert [(r.order_reference, r.quantity, r.time_period, r.occasion) for r in kept[1:]] == [
        ("u7:1", 2, "morning", "Ramadan"), ("u7:1", 1, "Afternoon", "Ramadan")]
    s = cln.summary(rows, ["user_id"]).first()
    assert (s.rows_in_file, s.rows_imported, s.rows_skipped) == (5, 3, 2)


def test_headers_in_one_job_and_malformed_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,sku,qty,price,cost,category,date\n1,s1,2,10,4,Tea,2022-01-01\n2,s1\n3,s1,2,10,4,Tea,2022-01-01,more,and more\n")
    (tmp_path / "b.csv").write_text("price,qty,order_id,category,cost,name,date\n20,3,2,Tea,5,Green,2022-01-01\n")
    (tmp_path / "empty.csv").write_text("")
    assert sorted(len(f) for f in pos_files.headers(spark, str(tmp_path)).values()) == [1, 1]
    assert pos_files.read_csv(spark, str(tmp_path)).count() == 2
    got = {r.file.rsplit("/", 1)[1]: (r.lines, r.malformed) for r in pos_files.malformed(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (3, 2), "b.csv": (1, 0)}


def test_missing_columns_are_named(spark):
    with pytest.raises(pos_files.ContractError) as error:
        pos_files.resolve(spark.createDataFrame([("1", "2")], "order_id string, qty string"))
    assert error.value.missing == ["unit_price", "unit_cost", "category_en"]


def test_reupload_keeps_totals(spark):
    lines = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("b", "y", 2)], "order_reference string, sku string, quantity int")
    again = tbl.replace_items(lines, lines)
    assert sorted(again.collect()) == sorted(lines.collect())


def test_delete_leaves_no_orphans(spark, sf):
    t = tbl.clear_workspace(src.star(spark, sf), 7)
    assert t["order_items"].join(t["orders"], "order_id", "left_anti").count() == 0
    assert t["orders"].join(t["uploads"], "upload_id", "left_anti").count() == 0
    assert t["products"].join(t["order_items"], "product_id", "left_anti").count() == 0


def test_seed_references_are_unique(spark):
    rows = spark.createDataFrame([("nan", "2022-01-01", "night")] * 50 + [("9", "2022-01-01", None)], "order_reference string, date string, time_period string")
    made = cln.seed_references(rows.repartition(4))
    assert made.select("order_reference").distinct().count() == 51


def test_classes_partition_the_items(spark, sf):
    items = menu.item_table(src.real_only(src.sales(spark, sf)))
    done = menu.classified(items)
    assert done.count() == items.count()
    assert done.filter(F.col("classification").isNull()).count() == 0


def test_cells_add_up_to_the_day(spark, sf):
    daily = pf.naive_future(spark, sf)
    cells = sum(F.col(p) for p in labels.PERIODS)
    grid = factored.expand(daily, pf.cells(spark, sf)).groupBy("user_id", "ds").agg(F.sum(cells).alias("s"))
    worst = grid.join(daily, ["user_id", "ds"]).agg(F.max(F.abs(F.col("s") - F.col("yhat"))).alias("d")).first().d
    assert worst < 1e-2


def test_sums_on_factors_equal_sums_over_the_grid(spark, sf):
    daily, cells = pf.naive_future(spark, sf), pf.cells(spark, sf)
    items = cells.select("user_id", "product").distinct().withColumn("category", F.substring("product", 1, 3)).withColumn("price", (F.length("product") % 7).cast("double"))
    grid = factored.expand(daily, cells).join(items, ["user_id", "product"]).cache()
    every = sum(F.col(p) for p in labels.PERIODS)
    near = lambda a, b: abs(a - b) <= 1e-3 * max(1.0, abs(b))
    by = lambda df, keys, v: {tuple(r[k] for k in keys): r["v"] for r in df.groupBy(*keys).agg(F.sum(v).alias("v")).collect()}
    want = by(grid, ["user_id", "product"], F.col("night"))
    got = by(factored.totals(daily, cells).filter("time_period = 'night'"), ["user_id", "product"], F.col("total"))
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)
    want = by(grid, ["user_id", "category", "ds"], every * F.col("price"))
    got = by(factored.by_day(daily, cells, {"rev": F.col("price")}, ["category"], items), ["user_id", "category", "ds"], F.col("rev"))
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)
    want = by(grid, ["user_id", "ds"], F.col("morning"))
    got = by(factored.by_day(daily, cells, {"v": F.lit(1.0)}, ["time_period"]).filter("time_period = 'morning'"), ["user_id", "ds"], F.col("v"))
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_scale_stays_in_bounds(spark, sf):
    scale = fc.baseline_scale(pf.naive_future(spark, sf), fc.history_rate(src.sales(spark, sf)))
    row = scale.agg(F.min("scale").alias("a"), F.max("scale").alias("b")).first()
    assert 0.1 <= row.a and row.b <= 20.0


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    table, log = run_path(spark, "t"), run_path(spark, "c")
    schema = "order_reference string, sku string, quantity int"

    def arrive(name, text):
        (inbox / name).write_text(text)
        source = spark.readStream.schema(schema).csv(str(inbox))
        stream.start(source, table, log).awaitTermination()

    arrive("1.csv", "a,x,1\na,x,1\nb,y,2\n")
    arrive("2.csv", "b,z,5\nc,z,1\n")
    got = sorted(tuple(r) for r in stream.current(spark, table).select("order_reference", "sku", "quantity").collect())
    assert got == [("a", "x", 1), ("a", "x", 1), ("b", "z", 5), ("c", "z", 1)]
    # a batch that is replayed changes nothing
    merge = stream.merge_batches(table, "order_reference", lambda rows: rows)
    merge(spark.createDataFrame([("b", "z", 5), ("c", "z", 1)], schema), 1)
    assert sorted(tuple(r) for r in stream.current(spark, table).select("order_reference", "sku", "quantity").collect()) == got


@pytest.mark.parametrize("date,time,want", [
    ("2022-04-15", "8:30:00", "2022-04-15 08:30:00"), ("15/04/2022", "08:30", "2022-04-15 08:30:00"),
    ("2022/04/15", "08:30", "2022-04-15 08:30:00"), ("2022-04-15 00:00:00", "08:30:00", "2022-04-15 08:30:00"),
    ("4/15/2022", "8:30 PM", "2022-04-15 20:30:00"), ("15 April 2022", "12:05 am", "2022-04-15 00:05:00"),
    ("Apr 15, 2022", "08:30:00.5Z", "2022-04-15 08:30:00"), ("20220415", None, "2022-04-15 12:00:00"),
    ("15/04/22", "08:30", "2022-04-15 08:30:00"), ("15-Apr-22", "08:30", "2022-04-15 08:30:00"), ("04/15/22", "08:30", "2022-04-15 08:30:00"),
    ("Friday, April 15, 2022", "08:30", "2022-04-15 08:30:00"), ("May 5, 99", "08:30", "1999-05-05 08:30:00"), ("Sunday, November 23, 1997", "08:30", "1997-11-23 08:30:00"), ("1/1/0202", "08:30", None),
    ("2022-02-30", "08:30", None), ("someday", "08:30", None), ("2022-04-15", "soon", None), (None, "08:30", None),
])
def test_spelled_moments(spark, date, time, want):
    row = spark.createDataFrame([(date, time)], "date string, time string")
    got = row.select(cln.order_datetime(row).cast("string").alias("t")).first().t
    assert got == want


def test_odd_cells_do_not_stop_the_job(spark):
    row = spark.createDataFrame([("1", None, c, c, "1", "Tea", "2022-01-01", "x") for c in ("nan", "Infinity", "1e12", "1e30", None)],
                                "order_reference string, sku string, quantity string, unit_price string, unit_cost string, category_en string, date string, is_imputed string")
    got = cln.normalised(row, 7).select("quantity", "unit_price", "sku", "is_imputed").collect()
    assert [tuple(r) for r in got] == [(0, 0.0, "nan", False), (0, 0.0, "nan", False), (10**12, 1e12, "nan", False), (0, 1e30, "nan", False), (0, 0.0, "nan", False)]


def test_missing_reference_keeps_the_line(spark):
    row = spark.createDataFrame([(None, "1"), ("  ", "1")], "order_reference string, quantity string").selectExpr("*", "'2' AS unit_price", "'1' AS unit_cost", "'Tea' AS category_en", "'2022-01-01' AS date")
    assert [r.order_reference for r in cln.valid_rows(cln.normalised(row, 7)).collect()] == ["u7:", "u7:"]


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,sku,qty,price,cost,category,date\n1,s1,2,10,4,Tea,2022-01-01\n")
    (tmp_path / "b.csv").write_text("price,qty,order_id,category,cost,name,date\n20,3,2,Tea,5,Green,2022-01-01\n")
    got = pos_files.read_csv(spark, str(tmp_path), lambda f: cln.normalised(f, 7)).orderBy("order_reference").collect()
    assert [(r.order_reference, r.sku, r.quantity, r.unit_price, r.unit_cost) for r in got] == [("u7:1", "s1", 2, 10.0, 4.0), ("u7:2", "Green", 3, 20.0, 5.0)]


def test_seed_references_are_stable(spark):
    data = [("nan", "2022-01-01", "night")] * 5 + [(None, "2022-01-02", None), ("9", "2022-01-01", "night")]
    rows = spark.createDataFrame(data, "order_reference string, date string, time_period string")
    refs = lambda df: sorted(r.order_reference for r in cln.seed_references(df).collect())
    assert refs(rows.repartition(1)) == refs(rows.repartition(5)) and len(set(refs(rows))) == 7


def test_no_join_by_product_under_the_grid(spark, sf):
    """Slots and days are joined by group and slot alone, which small tables hold."""
    grid = factored.expand(pf.naive_future(spark, sf), pf.cells(spark, sf))
    joins = [x for x in grid._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not [x for x in joins if "product#" in x]


def test_sales_are_joined_once_a_query_call(spark, sf, monkeypatch):
    from tillgrain.plans import registry
    from tillgrain.sources import sales
    calls, plain = [], sales.sales
    monkeypatch.setattr(sales, "sales", lambda *a: calls.append(a) or plain(*a))
    registry.all_queries()["fc_total_daily"](spark, sf)
    assert len(calls) == 1


def test_moment_is_parsed_below_the_generator(spark, sf):
    """The parse is a column of its own, not repeated in the generator."""
    from tillgrain.operators import cleaning as cln
    from tillgrain.plans import ingest
    plan = cln.normalised(ingest.fields(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Generate inline" in x)
    assert "gettimestamp" not in line.lower() and "regexp" not in line.lower()


def exchanges_of_products(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in plan if ("Exchange" in x or "Window" in x) and "product#" in x]


def test_products_are_dealt_once(spark, sf):
    """What is asked of a product is read off its stored row."""
    daily, cells = pf.naive_future(spark, sf), pf.cells(spark, sf)
    assert cells.count() == cells.select("user_id", "product").distinct().count()
    for rows in (factored.expand(daily, cells), factored.wide_totals(daily, cells), pf.actuals(spark, sf)):
        assert not exchanges_of_products(rows)


def test_folds_know_the_lines_until_their_cutoff(spark):
    from tillgrain.operators import evaluate as ev
    lines = [(1, "tea", "2000-01-03", 8, 5), (1, "tea", "2000-01-10", 8, -5), (1, "tea", "2000-01-11", 13, 2), (1, "jam", "2000-01-11", 8, 4), (1, "pie", "2000-03-01", 8, 9)]
    sold = spark.createDataFrame(lines, "user_id int, product string, order_date string, hour int, quantity bigint").withColumn("order_date", F.col("order_date").cast("date"))
    plan = [("A", "2000-01-05", 7), ("B", "2000-01-20", 7)]
    folds = ev.fold_cells(ev.first_seen(sold, plan), plan)
    assert not [x for x in exchanges_of_products(folds) if "fold#" in x]
    got = {tuple(r) for r in fc.opened(folds, ["user_id", "fold"]).select("fold", "product", "season", "dow", "time_period", "qty").collect()}
    assert got == {("A", "tea", "Winter", 0, "morning", 5), ("B", "tea", "Winter", 0, "morning", 0), ("B", "tea", "Winter", 1, "Afternoon", 2), ("B", "jam", "Winter", 1, "morning", 4)}
    whole = {(r.fold, r.product): r.product_qty for r in folds.collect()}
    assert whole == {("A", "tea"): 5, ("B", "tea"): 2, ("B", "jam"): 4}


def test_units_hold_no_prices(spark, sf):
    from tillgrain.plans import facts
    from tillgrain.session import shared_tables
    with shared_tables():
        slim = facts.units(spark, sf)
        assert set(slim.columns) == set(facts.UNITS) and slim.count() == src.sales(spark, sf).count()
    with shared_tables():
        assert facts.units(spark, sf).sameSemantics(facts.units(spark, sf))


def test_item_prices_meet_their_products_in_place(spark, sf):
    """Prices and history are each dealt by product once; the view exchanges no product."""
    from tillgrain.plans import registry, views as pv
    assert not exchanges_of_products(registry.all_queries()["fc_item"](spark, sf))
    want = {(r.user_id, r.product): r.price for r in menu.items(src.sales(spark, sf)).select("user_id", "product", "price").collect()}
    got = {(r.user_id, r.product): r.price for r in menu.first_prices(src.sales(spark, sf)).collect()}
    assert got == want
    kept = {(r.user_id, r.product): r.price for r in pv.priced_cells(spark, sf).select("user_id", "product", "price").collect()}
    assert kept and all(want[k] == v for k, v in kept.items())


def test_item_days_are_made_as_arrays(spark, sf):
    """No function runs over a product's days one by one; values equal the factors' own."""
    import numpy as np
    from tillgrain.operators import grid
    from tillgrain.plans import registry
    plan = registry.all_queries()["fc_item"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    daily, cells = pf.naive_future(spark, sf), pf.cells(spark, sf).withColumn("price", F.lit(1.0))
    total = lambda df, c: {tuple(r[k] for k in ("user_id", "ds")): r.s for r in df.groupBy("user_id", "ds").agg(F.sum(c).alias("s")).collect()}
    want = total(factored.product_days(daily, cells), F.rint(F.col("yhat") * 100) / 100)
    got = total(grid.product_units(daily, cells, "price"), "revenue")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    value, there = np.array([[0.5, 0.5, 0.5, 0.2, 0.0], [1.25, 0.5, 0.0, 0.0, 0.0]]), np.array([[True] * 4 + [False], [True, True, False, False, False]])
    assert grid.largest_remainder(value, there).tolist() == [[1, 1, 0, 0, 0], [1, 1, 0, 0, 0]]


def test_every_product_is_sliced(spark, sf):
    """Not the most sold ones alone: each product that a fold knew, over all its scored days."""
    from tillgrain.operators import evaluate as ev
    from tillgrain.plans import evaluate as pe, registry
    from tillgrain.session import shared_tables
    got = {r.value: r.n for r in registry.all_queries()["ev_slice"](spark, sf).filter("dimension = 'product'").collect()}
    with shared_tables():
        known = pe.fold_cells(spark, sf).select(*ev.UF, "product").join(pe.scored(spark, sf).select(*ev.UF, "ds"), ev.UF)
        want = {r["product"]: r["n"] for r in known.groupBy("product").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_staged_batches_are_dropped(spark):
    """Beside the table nothing of a batch stays."""
    import os
    table, schema = run_path(spark, "staged"), "order_reference string, sku string, quantity int"
    merge = stream.merge_batches(table, "order_reference", lambda rows: rows)
    merge(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], schema), 0)
    merge(spark.createDataFrame([("b", "z", 5)], schema), 1)
    merge(spark.createDataFrame([], schema), 2)
    assert sorted(tuple(r) for r in stream.current(spark, table).select("order_reference", "sku", "quantity").collect()) == [("a", "x", 1), ("b", "z", 5)]
    left = [f for top, _, files in os.walk(table.removeprefix("file:") + "/stage") for f in files]
    assert not left


def test_open_partitions_hold_small_row_groups(spark, tmp_path, monkeypatch):
    import glob
    import pyarrow.parquet as pq
    monkeypatch.setattr(tbl, "ROW_GROUP", 1 << 16)
    rows = spark.range(400_000, numPartitions=1).select((F.col("id") % 4).cast("int").alias("user_id"), F.rand(7).alias("v"))
    tbl.write_table(rows, str(tmp_path / "t"), "parquet", ("user_id",))
    files = glob.glob(f"{tmp_path}/t/user_id=*/*.parquet")
    assert len(files) == 4 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000


def test_ranked_rows_are_exchanged_once(spark):
    from tillgrain.functions import ranking
    rows = spark.createDataFrame([(i % 3, i % 7 if i % 5 else None, f"p{i:03}") for i in range(400)], "user_id int, v int, product string").repartition(5)
    done = ranking.ranked(rows, ["user_id"], "v", "product")
    assert not exchanges_of_products(done)
    want = sorted(((r.user_id, -1000 if r.v is None else -r.v, r.product) for r in rows.collect()))
    place = {p: 1 + sum(u == u2 for u2, _, _ in want[:i]) for i, (u, _, p) in enumerate(want)}
    assert {r.product: r.place for r in done.collect()} == place


def test_history_meets_its_days_in_place(spark, sf, monkeypatch):
    """Also where the days of all workspaces are above the broadcast threshold."""
    fitted, cells = pf.fitted_total(spark, sf), pf.day_cells(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def sorted_joins():
            plan = factored.observed(pf.history_of(fitted), cells)._jdf.queryExecution().executedPlan().toString()
            return [x for x in plan.splitlines() if "SortMergeJoin" in x and "ds#" in x]
        assert not sorted_joins()
        monkeypatch.setattr(factored, "SENT_DAYS", -1)
        assert sorted_joins()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
