"""Published label and sanction lists, read from written files."""

import json

import pytest

from ledgerloom.operators import labels
from ledgerloom.sources import label_files, lists

EVM = "0x" + "AB" * 20


def claims(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sanctions_in_xml_and_what_a_newer_snapshot_changes(spark, tmp_path):
    def xml(entries, day):
        body = "".join(f"<sdnEntry><uid>1</uid><lastName>{name}</lastName><idList>" + "".join(f"<id><uid>2</uid><idType>{t}</idType><idNumber>{n}</idNumber></id>" for t, n in ids) + "</idList></sdnEntry>" for name, ids in entries)
        return f'<?xml version="1.0"?><sdnList xmlns="http://tempuri.org/sdnList.xsd"><publshInformation><Publish_Date>{day}</Publish_Date><Record_Count>2</Record_Count></publshInformation>{body}</sdnList>'

    (tmp_path / "a.xml").write_text(xml([("SMITH &amp; CO", [("Digital Currency Address - ETH", EVM), ("Passport", "X1"), ("Digital Currency Address - XMR", "4abc")]), ("", [("Digital Currency Address -  XBT", "1Bc")])], "08/05/2024"))
    (tmp_path / "b.xml").write_text(xml([("", [("Digital Currency Address - XBT", "1Bc"), ("Digital Currency Address - TRX", "TXY")])], "09/05/2024"))
    got = lists.sanctions_xml(spark, str(tmp_path / "a.xml"))
    assert claims(got, "address", "chain", "label", "rationale") == sorted([(EVM.lower(), "eip155:1", "OFAC SDN (SMITH & CO)", None), ("4abc", None, "OFAC SDN (SMITH & CO)", "currency hint XMR"), ("1Bc", lists.SANCTION_CHAINS["XBT"], "OFAC SDN", None)], key=str)
    assert {r.observed_at for r in got.collect()} == {1722816000} and {r.category for r in got.collect()} == {"sanctioned"}
    assert claims(labels.difference(got, lists.sanctions_xml(spark, str(tmp_path / "b.xml"))), "address", "change") == sorted([("4abc", "removed"), (EVM.lower(), "removed"), ("TXY", "added")], key=str)


def test_sanctions_in_json(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"_snapshot": "2024-01-02", EVM: {"label": "OFAC SDN (X)", "chain": "eip155:1"}, "1Bc": {}}))
    (tmp_path / "deep.json").write_text(json.dumps({"fetched_at": "2024-01-02T00:00:00+00:00", "addresses": {"1Bc": {"label": "L"}}}))
    assert claims(lists.sanctions_json(spark, str(tmp_path / "flat.json")), "address", "label", "observed_at") == sorted([(EVM.lower(), "OFAC SDN (X)", 1704153600), ("1Bc", "OFAC SDN", 1704153600)], key=str)
    assert claims(lists.sanctions_json(spark, str(tmp_path / "deep.json")), "address", "label", "observed_at") == [("1Bc", "L", 1704153600)]


PACK = """title: Pack
creator: Someone
confidence: service_api
currency: BTC
lastmod: 2021-04-05
tags:
  - address: 1Abc
    label: An exchange
    category: exchange
  - {address: "%s", label: Own, currency: ETH, confidence: ownership, actor: me, context: why}
  - {address: 1Def}
  - just text
""" % EVM


def test_tag_packs(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "p.yaml").write_text(PACK)
    (tmp_path / "broken.yaml").write_text("title: [")
    (tmp_path / "list.yaml").write_text("- 1")
    got = lists.tag_packs(spark, str(tmp_path))
    assert claims(got.where("problem is null"), "address", "chain", "label", "category", "confidence", "source", "observed_at") == sorted([
        ("1Abc", lists.PACK_CHAIN["BTC"], "An exchange", "cex", 3, "Pack via Someone", 1617580800), (EVM.lower(), "eip155:1", "Own", "unknown", 4, "Pack via Someone", 1617580800)], key=str)
    assert {r.rationale for r in got.where("label = 'Own'").collect()} == {"tagpack p.yaml; confidence=ownership (100/100); actor=me; why"}
    assert sorted(r.problem.split(":")[0] for r in got.where("problem is not null").collect()) == ["bad file", "bad file", "bad tag", "no label"]
    spark.dataSource.register(lists.TagPacks)
    own = spark.read.format("tagpack").load(str(tmp_path))
    assert own.count() == 6 and own.where("tag['currency'] = 'ETH'").count() == 1


def test_labels_by_category(spark, tmp_path):
    rows = {"exchange": [{"address": EVM, "nameTag": "Ex 1"}, {"address": "0x1", "nameTag": ""}, {"address": " "}], "genesis": [{"address": EVM.lower(), "nameTag": "G"}, {"address": "0x2", "nameTag": "G2"}], "other": [{"address": "0x3"}]}
    for name, own in rows.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(own))
    (tmp_path / "phish-hack.json").write_text("not json")
    got = lists.labels_by_category(spark, str(tmp_path))
    assert claims(got.where("problem is null"), "address", "label", "category") == sorted([(EVM.lower(), "Ex 1", "cex"), ("0x1", "exchange (unnamed in the source)", "cex"), ("0x2", "G2", "contract")], key=str)
    assert claims(got.where("problem is not null"), "category", "problem") == [("illicit", "bad file")]


def test_contract_registry(spark, tmp_path):
    for chain, name, text in (("1", EVM, '{"project":"P","name":"Vault","source":"s"}'), ("56", EVM, '{"name":"Other"}'), ("1", "0x2", "{}"), ("1", "0x3", "broken")):
        (tmp_path / "contracts" / chain).mkdir(parents=True, exist_ok=True)
        (tmp_path / "contracts" / chain / f"{name}.json").write_text(text)
    got = lists.contract_registry(spark, str(tmp_path))
    assert claims(got, "address", "chain", "label", "source", "problem") == sorted([(EVM.lower(), "eip155:1", "P Vault", "contract registry (s)", None), (EVM.lower(), "eip155:56", "Other", "contract registry (no source recorded)", None), ("0x3", "eip155:1", None, "contract registry (no source recorded)", "bad file")], key=str)


def test_darklist_and_nametags(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"address": EVM, "comment": "XRP phishing website (x) this wallet collects", "date": "2018-01-16T00:00:00.000Z"}, {"address": EVM.lower(), "comment": "again"}, {"address": "0x9"}, {"comment": "no address"}]))
    got = lists.darklist(spark, str(tmp_path / "d.json"))
    assert claims(got, "address", "label", "rationale", "observed_at") == sorted([(EVM.lower(), "XRP phishing website (x)", "XRP phishing website (x) this wallet collects [reported 2018-01-16]", 1516060800), ("0x9", "reported address", "listed with no comment", None)], key=str)
    (tmp_path / "n.json").write_text(json.dumps({"_about": {"label": "x"}, EVM: {"label": "Binance 14", "chain": "eip155:1", "tags": ["exchange"]}, "0x5": {"name": "Somebody"}, "0x6": "text"}))
    assert claims(lists.nametags(spark, str(tmp_path / "n.json")), "address", "chain", "label", "category") == sorted([(EVM.lower(), "eip155:1", "Binance 14", "cex"), ("0x5", None, "Somebody", "service")], key=str)
    (tmp_path / "bad.json").write_text("[")
    assert claims(lists.nametags(spark, str(tmp_path / "bad.json")), "address", "problem") == [(None, "bad file")]


def test_fields_behind_the_first_thousand_are_read(spark, tmp_path):
    row = {f"aaa{i}": i for i in range(1500)} | {"Wallet": "W1", "name": "N"}
    (tmp_path / "x.jsonl").write_text(json.dumps(row))
    got = labels.coerced(label_files.read_labels(spark, str(tmp_path / "x.jsonl")), "s").first()
    assert (got.address, got.label) == ("W1", "N")
