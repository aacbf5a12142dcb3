"""Readers and dataset loaders on small files."""

import math

import pytest

from lexiloom.session import scratch_path, shared_dir
from lexiloom.sources import datasets, ledger
from lexiloom.sources.delimited import scan_csv, scan_csv_skip
from lexiloom.sources.derived import materialize


def put(root, path, text, encoding="utf-8"):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding=encoding)


def load(spark, root, name):
    return datasets.dataset(name).load(spark, str(root))


def test_skip_over_many_files(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"f{i}.csv", "one\ntwo\n\nid,name\n" + "".join(f'{i * 100 + j},"n, {j}"\n' for j in range(30)))
    out = scan_csv_skip(spark, str(tmp_path), 3)
    assert out.columns == ["id", "name"]
    assert sorted(int(r["id"]) for r in out.collect()) == sorted(i * 100 + j for i in range(5) for j in range(30))
    assert out.filter("name = 'n, 7'").count() == 5


def test_index_and_latin1(spark, tmp_path):
    put(tmp_path, "x.csv", ",city\n1,Orléans\n", "latin-1")
    out = scan_csv(spark, str(tmp_path / "x.csv"), encoding="ISO-8859-1", index_name="row")
    assert out.first().asDict() == {"row": 1, "city": "Orléans"}


def test_vancouver_employee(spark, tmp_path):
    put(tmp_path, "vancouver_employee/raw/2017StaffRemunerationOver75KWithExpenses.csv",
        'a\nb\nc\nName,Remuneration\nX,"75,000.5"\nY,\n')
    rows = {r["Name"]: r["Remuneration"] for r in load(spark, tmp_path, "vancouver_employee").collect()}
    assert math.isclose(rows["X"], math.log(75000.5)) and rows["Y"] is None


def test_open_payments(spark, tmp_path):
    header = ",".join(datasets.PAYMENT_COLUMNS) + ",Other\n"
    put(tmp_path, "docs_payments/raw/OP_RSRCH_PGYR2013_x.csv", header + "S,d,v,Acme,10.5,No,1\nS,d,v,Acme,10.5,No,2\n")
    put(tmp_path, "docs_payments/raw/OP_GNRL_PGYR2013_x.csv", header + "S,d,v,Acme,10.5,No,1\n")
    put(tmp_path, "docs_payments/raw/OP_GNRL_PGYR2014_x.csv", header + "T,d,v,Late,10.5,No,1\n")
    for _ in range(2):
        out = load(spark, tmp_path, "open_payments")
        assert sorted(r["status"] for r in out.collect()) == [False, True]
    dataset = datasets.dataset("open_payments")
    assert dataset.n_rows == 100_000 and dataset.roles.special == [datasets.COMPANY]
    dataset.roles.check(out)


def test_road_safety(spark, tmp_path):
    base = "road_safety/raw"
    put(tmp_path, f"{base}/2015_Make_Model.csv", "Accident_Index,Vehicle_Reference,make\nA,1,FORD\nA,2,\nB,1,FIAT\n")
    put(tmp_path, f"{base}/Casualties_2015.csv",
        "Accident_Index,Vehicle_Reference,Sex_of_Driver\nA,1,1\nA,1,3\nA,2,2\nB,1,2\nC,1,1\nB,1,-1\n")
    rows = sorted((r["make"], r["Sex_of_Driver"]) for r in load(spark, tmp_path, "road_safety").collect())
    assert rows == [("FIAT", 1), ("FORD", 0)]


def test_other_loaders(spark, tmp_path):
    put(tmp_path, "consumer_complaints/raw/Consumer_Complaints.csv", "id,Consumer disputed?\n1,Yes\n2,No\n3,\n")
    assert sorted(r[1] for r in load(spark, tmp_path, "consumer_complaints").collect()) == [False, True]
    put(tmp_path, "federal_election/data_dict.csv", "Column Name\nNAME\nTRANSACTION_AMT\n")
    put(tmp_path, "federal_election/raw/itcont.txt", "José|-100\nAnn|1\nBob|7\n", "latin-1")
    amounts = {r["NAME"]: r["TRANSACTION_AMT"] for r in load(spark, tmp_path, "federal_election").collect()}
    assert set(amounts) == {"José", "Bob"} and math.isclose(amounts["José"], math.log(100))
    put(tmp_path, "cacao_flavors/raw/flavors_of_cacao.csv", 'Company,"Cocoa\nPercent"\nA,63%\n')
    assert load(spark, tmp_path, "cacao_flavors").first()[1] == 63.0
    put(tmp_path, "house_prices/raw/train.csv", "Id,MSSubClass\n1,20\n2,999\n")
    assert [r[1] for r in load(spark, tmp_path, "house_prices").orderBy("row_id").collect()] == ["1-STORY 1946 & NEWER ALL STYLES", "999"]
    put(tmp_path, "kickstarter_projects/raw/ks-projects-201612.csv", "ID,state ,usd pledged \n1,failed,0\n2,successful,10\n3,live,5\n")
    states = load(spark, tmp_path, "kickstarter_projects").orderBy("row_id").collect()
    assert [r[1] for r in states] == [False, True] and math.isclose(states[0][2], math.log(1e-10))
    put(tmp_path, "building_permits/raw/building-permits.csv", " ID , ESTIMATED_COST\n1,100\n")
    permits = load(spark, tmp_path, "building_permits")
    assert permits.columns == ["ID", "ESTIMATED_COST"] and math.isclose(permits.first()[1], math.log(100 + 1e-10))
    put(tmp_path, "criteo/raw/data.txt", "1\t2\tx\n")
    assert load(spark, tmp_path, "criteo").columns == ["0", "1", "2"]
    put(tmp_path, "firefighter_interventions/raw/interventions-hebdo-2010-2017.csv", "a;b\n1;2\n")
    assert load(spark, tmp_path, "firefighter_interventions").columns == ["a", "b"]
    with pytest.raises(ValueError):
        datasets.dataset("nope")


def test_roles_from_json():
    roles = datasets.roles_from_json('{"col_action": {"a": "Special", "b": "y"}, "clf_type": "binary", "dirtiness_type": null}')
    assert roles.target == "b" and roles.special == ["a"]


def test_materialize_builds_once(spark):
    path, built = scratch_path(spark, "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert materialize(spark, path, build).count() == materialize(spark, path, build).count() == 3
    assert len(built) == 1


def test_ledger(spark):
    path = scratch_path(spark, "ledger")
    assert ledger.read_results(spark, path).count() == 0
    ledger.record_run(spark, path, {"a": 1}, [(0, 10, 2, 0.5, 1.0, 2.0), (1, 10, 2, 0.6, 1.0, 2.0)])
    stored = ledger.read_results(spark, path)
    assert stored.count() == 2 and stored.select("config").distinct().first()[0] == '{"a": 1}'
    ledger.append_results(stored, scratch_path(spark, "json"), "json")


def test_shared_dir_is_reused(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
