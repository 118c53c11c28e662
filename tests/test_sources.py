import pytest

from repeatbuy.operators import clean
from repeatbuy.plans import staging
from repeatbuy.sources import tables


@pytest.fixture
def orders_csv(tmp_path):
    path = tmp_path / "ORDERS.csv"
    path.write_text(
        "id,id.1,id.2,categoryid,id.3,quantitystepcount,totaloriginalprice,?column?,marketid,"
        "segmentationlabel,checkoutdate\n"
        "1,10,5,51,100,2,900,3,7,loyal,2023-05-01 10:11:12.000345\n"
        "2,10,5,51,100,1,450,1,7,,2023-05-03 10:11:12.500000\n"
    )
    return str(path)


def test_read_orders(spark, orders_csv):
    got = clean.parse_timestamp(tables.read_orders(spark, orders_csv)).orderBy("bid").collect()
    assert [(r["bid"], r["cid"], r["catid"], r["classid"], r["iid"]) for r in got] == [
        (1, 10, 5, 51, 100), (2, 10, 5, 51, 100),
    ]
    assert got[0]["checkoutdate"].microsecond == 345
    assert got[1]["segmentationlabel"] is None and got[1]["price"] == 450.0


def test_columns_are_found_by_header(spark, tmp_path):
    """Moved and further columns are read into the right fields; a missing one is an error."""
    path = tmp_path / "CLASS.csv"
    path.write_text("name,more,id,primaryparentid\nmilk,x,1,\n")
    assert tables.read_class(spark, str(path)).collect() == [(1, "milk", None)]
    path.write_text("name,id\nmilk,1\n")
    with pytest.raises(ValueError, match="primaryparentid"):
        tables.read_class(spark, str(path))
    path.write_text("")
    assert tables.read_class(spark, str(path)).collect() == []


def test_repeated_header_names(spark, tmp_path):
    folder = tmp_path / "ORDERS"
    folder.mkdir()
    header = "id,id,id,categoryid,id,quantitystepcount,totaloriginalprice,?column?,marketid,segmentationlabel,checkoutdate\n"
    (folder / "a.csv").write_text(header + "1,10,5,51,100,2,900,3,7,loyal,2023-05-01 10:11:12.000345\n")
    (folder / "b.csv").write_text(header + '2,10,6,52,101,1,450,1,7,"a, b",2023-05-03 10:11:12.5\n3,x,6,52,101,1,1,1,7,,\n4,10\n')
    got = tables.read_orders(spark, str(folder)).orderBy("bid").collect()
    assert [(r["bid"], r["cid"], r["catid"], r["classid"], r["iid"], r["segmentationlabel"]) for r in got] == [
        (1, 10, 5, 51, 100, "loyal"), (2, 10, 6, 52, 101, "a, b"),
    ]
    bad = tables.read_rejects(spark, str(folder), tables.ORDERS_SCHEMA).orderBy("line").collect()
    assert [r["line"] for r in bad] == ["3,x,6,52,101,1,1,1,7,,", "4,10"]
    assert all(r["file"].endswith("b.csv") for r in bad) and '"id":3' in bad[0]["fields"]


def test_read_dimensions(spark, tmp_path):
    (tmp_path / "CLASS.csv").write_text("id,name,primaryparentid\n1,root,\n51,milk,1\n")
    (tmp_path / "CAT.csv").write_text("id,name\n5,milk 1l\n6,\n")
    (tmp_path / "Items.csv").write_text(
        "id,name,categoryid,typeid,id.1,name.1\n100,whole milk,51,5,9,Farm\n")
    assert tables.read_class(spark, f"{tmp_path}/CLASS.csv").columns == [
        "classid", "class_name", "primaryparentid"]
    cats = tables.read_category(spark, f"{tmp_path}/CAT.csv")
    assert clean.null_rows(cats, "cat_name").count() == 1
    item = tables.read_items(spark, f"{tmp_path}/Items.csv").first()
    assert (item["iid"], item["catid"], item["brand_name"]) == (100, 5, "Farm")


def test_feature_runs(spark, tmp_path):
    path = str(tmp_path / "features")
    for run, n in (("1", 3), ("2", 5)):
        tables.write_features(spark.range(n), path, run, "train")
        tables.write_features(spark.range(1), path, run, "test")
    tables.write_features(spark.range(4), path, "1", "train")
    assert tables.read_features(spark, path, "1", "train").count() == 4
    assert tables.read_features(spark, path, "2").count() == 6


def test_a_report_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    for run in ("1", "2", "1"):
        tables.write_report(spark.range(2), path, "tree", "standard", run)
    rows = spark.read.parquet(path).groupBy("run").count().collect()
    assert sorted((str(r["run"]), r["count"]) for r in rows) == [("1", 2), ("2", 2)]


def test_stage_uses_the_named_folder(spark):
    folder = staging.shared_folder(spark)
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3
    assert all(folder.split(":")[-1] in f for f in staged.inputFiles())
