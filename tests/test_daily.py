"""Landing faults, idempotency and history of whole business dates."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.values import FEEDS
from ledgerline.operators.fingerprint import table_fingerprint
from ledgerline.operators.quality import gate
from ledgerline.plans import daily
from ledgerline.sources import landing as L
from ledgerline.sources.tables import path_exists, read_table

D1, D2 = dt.date(2023, 12, 31), dt.date(2024, 1, 31)


def sources(spark):
    branch = spark.createDataFrame([("B1", "WEST"), ("B2", "MIDWEST")], "branch_id string, region string")
    customers = [
        (f"C{i}", "Ann", f"Lee{i}", dt.date(1980, 2, 29), "US" if i % 2 else "DE", "FR", dt.date(2020, 1, 1),
         ["APPROVED", "EXPIRED"][i % 2], dt.datetime(2021 if i % 3 else 2023, 6, 1), f"B{1 + i % 2}")
        for i in range(12)
    ]
    customer = spark.createDataFrame(
        customers,
        "customer_id string, first_name string, last_name string, dob date, country_of_birth string, citizenship string, "
        "onboarded_date date, kyc_status string, kyc_reviewed_at timestamp_ntz, branch_id string",
    )
    account = spark.createDataFrame([(f"A{i}", f"C{i}", "B1") for i in range(10)], "account_id string, customer_id string, branch_id string")
    txns = [
        (f"T{i}", f"A{0 if i % 3 else i % 10}", dt.date(2023, 10 + i // 3 % 3, 1 + i % 27), dt.datetime(2023, 12, 1), "WIRE", "ATM", "SETTLED",
         f"{10 + i}.50", ["USD", "EUR", "GBP"][i % 3], [None, "DEUTDEFF", "USBKUS44"][i % 3 if i % 4 else 1], "Y" if i % 11 == 0 else "N")
        for i in range(120)
    ]
    txn = spark.createDataFrame(
        txns,
        "txn_id string, account_id string, txn_date date, txn_timestamp timestamp_ntz, txn_type string, channel string, status string, "
        "amount string, currency string, counterparty_bank_bic string, reversal_flag string",
    ).withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    fx = spark.createDataFrame(
        [(dt.date(2023, 11, d), c, "USD", r, "ECB") for d in (1, 10, 20) for c, r in (("EUR", "1.1"), ("GBP", "1.25"))]
        + [(dt.date(2023, 1, 1), "EUR", "JPY", "150", "ECB")],
        "rate_date date, from_currency string, to_currency string, rate string, rate_source string",
    ).withColumn("rate", F.col("rate").cast("decimal(18,8)"))
    return {"branch": branch, "customer": customer, "account": account, "transaction": txn, "fx_rate": fx}


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    """Both days' feeds, exported once."""
    root = str(tmp_path_factory.mktemp("delivered") / "landing")
    for sor, entity, _ in FEEDS:
        L.export_landing(sources(spark)[entity].coalesce(1), root, sor, entity, override=D1.isoformat())
        shutil.copytree(L.partition_dir(root, sor, entity, D1.isoformat()), L.partition_dir(root, sor, entity, D2.isoformat()))
        edit(manifest_path(root, entity, D2, sor), lambda m: m.update(business_date=D2.isoformat()))
    return root


@pytest.fixture
def zone(delivered, tmp_path):
    root = str(tmp_path / "landing")
    shutil.copytree(delivered, root)
    return root, str(tmp_path / "warehouse")


def manifest_path(root, entity="customer", day=D1, sor="core_banking"):
    return f"{L.partition_dir(root, sor, entity, day.isoformat())}/_manifest.json"


def edit(path, change):
    with open(path) as fh:
        manifest = json.load(fh)
    change(manifest)
    with open(path, "w") as fh:
        json.dump(manifest, fh)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def flip_last_byte(directory):
    name = next(n for n in os.listdir(directory) if n.endswith(".parquet"))
    with open(f"{directory}/{name}", "r+b") as fh:
        fh.seek(-1, os.SEEK_END)
        last = fh.read(1)
        fh.seek(-1, os.SEEK_END)
        fh.write(bytes([last[0] ^ 1]))
    os.remove(f"{directory}/.{name}.crc")


FAULTS = {
    "missing key": (lambda root: edit(manifest_path(root), lambda m: m.pop("sha256")), "manifest missing keys: sha256"),
    "other entity": (lambda root: edit(manifest_path(root), lambda m: m.update(entity="x")), "manifest entity=x != expected customer"),
    "other date": (lambda root: edit(manifest_path(root), lambda m: m.update(business_date="1999-01-01")), "manifest business_date=1999-01-01"),
    "row count": (lambda root: edit(manifest_path(root), lambda m: m.update(row_count=m["row_count"] + 99999)), "row_count mismatch"),
    "flipped byte": (lambda root: flip_last_byte(os.path.dirname(manifest_path(root)) + "/data.parquet"), "sha256 mismatch"),
}


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_a_bad_feed_promotes_nothing(spark, zone, fault):
    root, warehouse = zone
    inject, reason = FAULTS[fault]
    inject(root)
    checks = L.ingest(spark, root, D1.isoformat(), warehouse)
    bad = [(r["entity"], r["reason"]) for r in checks.where("NOT passed").collect()]
    assert len(bad) == 1 and bad[0][0] == "customer" and bad[0][1].startswith(reason)
    assert not path_exists(spark, f"{warehouse}/src_branch")


def test_broken_and_missing_manifests(spark, zone):
    root, _ = zone
    with open(manifest_path(root), "w") as fh:
        fh.write("{not json")
    os.remove(os.path.dirname(manifest_path(root)) + "/._manifest.json.crc")
    os.remove(manifest_path(root, "account"))
    checks = {r["entity"]: r["reason"] for r in L.validate_manifest(spark, root, FEEDS, D1.isoformat()).collect()}
    assert checks["customer"] == "_manifest.json invalid JSON"
    assert checks["account"] == "_manifest.json missing"
    assert checks["branch"] == ""
    nowhere = L.validate_manifest(spark, root, FEEDS, "1990-01-01")
    assert {r["reason"] for r in nowhere.collect()} == {"landing partition not found"}


def test_promotion_moves_every_row(spark, zone):
    root, warehouse = zone
    checks = L.ingest(spark, root, D1.isoformat(), warehouse)
    assert checks.where("passed").count() == 5
    for entity, df in sources(spark).items():
        promoted = read_table(spark, f"{warehouse}/src_{entity}")
        assert promoted.columns == df.columns and promoted.count() == df.count()


def fact_of(spark, warehouse, day):
    return read_table(spark, f"{warehouse}/{daily.FACT}").where(F.col("as_of_date") == F.lit(day))


def test_reruns_are_identical_and_history_stays_and_ghosts_are_kept(spark, zone):
    root, warehouse = zone
    checks = daily.run_business_date(spark, root, warehouse, D1)
    verdict = gate(checks).first()
    assert verdict["checks_total"] == 15
    # Small data need not reach every tier; everything else must hold.
    assert verdict["failed_checks"] in ("", "L2_DQ_04")
    tables = ["stg_fx_resolved", "stg_transaction_normalized", "stg_customer_enriched"]

    def prints():
        staged = [table_fingerprint(read_table(spark, f"{warehouse}/{n}")).first()[0] for n in tables]
        return staged + [table_fingerprint(fact_of(spark, warehouse, D1)).first()[0]]

    before = prints()
    daily.run_business_date(spark, root, warehouse, D2)
    assert fact_of(spark, warehouse, D1).count() == fact_of(spark, warehouse, D2).count() == 12
    daily.run_business_date(spark, root, warehouse, D1)
    assert prints() == before
    assert fact_of(spark, warehouse, D2).count() == 12

    ghost = fact_of(spark, warehouse, D1).where("customer_id = 'C11'").first()
    assert (ghost["total_txn_volume_usd_90d"], ghost["txn_count_90d"], ghost["international_txn_ratio"]) == (0.0, 0, 0.0)
    assert (ghost["avg_txn_amount_usd"], ghost["reversal_rate"], ghost["volume_percentile"]) == (0.0, 0.0, 0.0)
    staged = read_table(spark, f"{warehouse}/stg_transaction_normalized")
    assert staged.where("fx_rate_source LIKE '%_BACKFILL'").count() > 0


def test_missing_landing_changes_nothing(spark, zone):
    root, warehouse = zone
    result = daily.run_business_date(spark, root, warehouse, dt.date(1990, 1, 1))
    assert result.where("NOT passed").count() == 5
    assert not path_exists(spark, f"{warehouse}/src_branch")
