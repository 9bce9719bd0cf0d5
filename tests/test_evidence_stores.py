"""Database evidence, stores with batches, the log's codec, controls."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import evidence_log
from corvane.session import table
from corvane.sources import database_evidence as de
from corvane.sources import stores

SOURCE = "kind: evidence-source\nid: star\nengine: sqlite\ndatabase: data/star.db\naccess: bounded-rows\nrelations: [main.nation, main.region]\nmax_rows: 3\n"


def test_descriptors():
    found = de.parse_source(SOURCE)
    assert found.relations == ("main.nation", "main.region") and found.limits == {"max_rows": 3, "max_bytes": 65_536, "timeout_ms": 5_000}
    assert de.parse_source(SOURCE.replace("sqlite\ndatabase: data/star.db", "postgresql\ndatabase: star\ncredential: env:STAR")).credential == "env:STAR"
    for old, new in (("sqlite", "oracle"), ("data/star.db", "/abs"), ("data/star.db", "../x"), ("bounded-rows", "all"), ("main.nation, ", "main.region, "), ("main.nation", "nation"), ("max_rows: 3", "max_rows: 0"), ("max_rows: 3", "max_rows: 99999"), ("id: star", "id: Star!"), ("kind: evidence-source", "kind: x"), ("max_rows: 3", "other: 1"), ("sqlite", "postgresql"), ("max_rows: 3", "snapshot: x"), ("max_rows: 3", "credential: env:A")):
        with pytest.raises(de.DescriptorError):
            de.parse_source(SOURCE.replace(old, new))
    store = "kind: state-store\nid: s\nbackend: file\npath: a/b\n"
    assert de.parse_store(store)["path"] == "a/b"
    for old, new in (("file", "sqlite"), ("a/b", "/a"), ("path: a/b", "max_bytes: 1")):
        with pytest.raises(de.DescriptorError):
            de.parse_store(store.replace(old, new))


def tables(spark, sf):
    return {"main.nation": table(spark, sf, "nation"), "main.region": table(spark, sf, "region")}


SQL = "select n_name, n_regionkey from main.nation order by 1"


def test_evidence_is_sealed(spark, sf):
    source = de.parse_source(SOURCE)
    found = de.collect(spark, source, SQL, tables(spark, sf), "2024-01-01")
    assert found.outcome == "truncated" and [json.loads(r)[0] for r in found.rows] == ["ALGERIA", "ARGENTINA", "BRAZIL"] or len(found.rows) == 3
    record = json.loads(found.record)
    assert record["row_count"] == 3 and record["truncated"] and record["dlp"] == "passed" and list(record) == sorted(record)
    assert de.collect(spark, source, SQL, tables(spark, sf), "2024-01-01").digest == found.digest
    node, content = de.packet_evidence(spark, found)
    assert node.first()["id"].startswith("db:star:") and found.result_digest in content.first()["content"]
    plain = de.collect(spark, source, None, tables(spark, sf), "x")
    assert plain.outcome == "schema-only" and "main.nation.n_name" in plain.record and not plain.rows


def test_evidence_that_is_not_admitted(spark, sf):
    source, t = de.parse_source(SOURCE), tables(spark, sf)
    for wrong, sql in ((de.parse_source(SOURCE.replace("bounded-rows", "introspection")), SQL), (source, "drop table main.nation"), (de.parse_source(SOURCE + f"queries: [{'0' * 64}]\n"), SQL)):
        with pytest.raises(de.Refused):
            de.collect(spark, wrong, sql, t, "x")
    pinned = de.parse_source(SOURCE + f"snapshot: {'a' * 64}\n")
    assert de.collect(spark, pinned, SQL, t, "x", snapshot=lambda: "a" * 64).outcome == "truncated"
    moved = iter(["a" * 64, "b" * 64])
    for seen in (lambda: None, lambda: next(moved)):
        found = de.collect(spark, pinned, SQL, t, "x", snapshot=seen)
        assert found.outcome == "stale-snapshot" and not found.rows and "n_name" not in found.record
    assert de.collect(spark, source, SQL, {"main.nation": t["main.nation"]}, "x").outcome == "unavailable"
    leaking = {**t, "main.nation": t["main.nation"].withColumn("n_name", F.lit("token=abc"))}
    found = de.collect(spark, source, SQL, leaking, "x")
    assert found.outcome == "dlp-rejected" and "token" not in found.record and not found.rows
    with pytest.raises(de.Refused):
        de.packet_evidence(spark, found)
    stop = threading.Event()
    stop.set()
    assert de.collect(spark, source, SQL, t, "x", cancel=stop).outcome == "cancelled"


def test_work_ends_at_its_deadline(spark):
    slow = lambda: spark.range(1 << 40).select(F.sum(F.crc32(F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary")))).collect()
    assert de.run_bounded(spark, slow, 400)[1] == "timeout"
    event = threading.Event()
    threading.Timer(0.3, event.set).start()
    assert de.run_bounded(spark, slow, 60_000, event)[1] == "cancelled"
    assert de.run_bounded(spark, lambda: spark.range(3).count(), 60_000) == (3, None)


def test_batches_of_results(tmp_path):
    store = stores.ResultStore(str(tmp_path), max_bytes=10, max_entries=3, max_age=5)
    a = store.put_batch([b"1111"], 1)[0]
    b = store.put_batch([b"22"], 2)[0]
    assert store.get(a) == b"1111" and store.used() == 6
    c, d = store.put_batch([b"333", b"44"], 3)
    assert [store.get(x) is not None for x in (a, b, c, d)] == [False, True, True, True]
    with pytest.raises(stores.StoreError):
        store.put_batch([b"x" * 11], 4)
    assert store.get(b) == b"22"
    e = store.put_batch([b"5"], 8)[0]
    assert [store.get(x) is not None for x in (b, c, d, e)] == [False, False, False, True]


def test_typed_forms_differ():
    forms = [stores.canonical_yaml(v) for v in (None, True, 1, "1", [1], {"a": 1}, "true")]
    assert len({json.dumps(f) for f in forms}) == len(forms)
    assert stores.canonical_yaml({"a": [1, None]}) == {"type": "mapping", "value": {"a": {"type": "sequence", "value": [{"type": "number", "value": "1"}, {"type": "null"}]}}}


def test_logs_round_trip():
    ranking = dict(rank=1, bundle="b\tx", locator="l\\n", match_reason="exact:path", exact=1, partial=0, active=3, canonical=1, public_safe=0, confidence=50, freshness="")
    records = [{"request": "a\nb\\", "roots": ["/r", "x\ty"], "outcome": "grounded", "matched": ["m"], "unmatched": ["u\r"], "rankings": [ranking]}, {"request": "", "roots": [], "outcome": "miss", "matched": [], "unmatched": [], "rankings": []}]
    data = evidence_log.encode_log(records)
    assert evidence_log.decode_log(data) == records
    for bad in (data[:-1], data.replace(b"log 1", b"log 2"), data + b"other\tx\n", data + b"rank\t1\n", data.replace(b"outcome\tmiss\n", b""), data.replace(b"\\n", b"\\q"), data + b"outcome\tmiss\n", b"evidence-log 1\nroot\tx\n"):
        with pytest.raises(evidence_log.CodecError):
            evidence_log.decode_log(bad)
    with pytest.raises(evidence_log.CodecError):
        evidence_log.encode_log(records[1:] * 33)


def test_controls():
    assert evidence_log.experimental_controls({"max-sources": "4", "dependency-depth": "0"}) == {"max-sources": 4, "dependency-depth": 0}
    for bad in ({"other": "1"}, {"max-sources": "0"}, {"excerpt-bytes": "901"}, {"max-sources": "-1"}, {"max-sources": "x"}):
        with pytest.raises(ValueError):
            evidence_log.experimental_controls(bad)


def test_requests_are_asked_again(spark):
    schema = "request string, bundle string, locator string, rank int, match_reason string"
    recorded = spark.createDataFrame([("q", "b", "x", 1, "r"), ("q", "b", "y", 2, "r"), ("p", "b", "x", 1, "r")], schema)
    today = {"q": [("b", "x", 1, "r"), ("b", "z", 2, "r")], "p": [("b", "x", 3, "r")]}
    found = evidence_log.reevaluate(recorded, ["q", "p"], lambda r: spark.createDataFrame(today[r], "bundle string, locator string, rank int, match_reason string"))
    assert {(r["request"], r["locator"], r["change"]) for r in found.collect()} == {("q", "y", "removed"), ("q", "z", "added"), ("p", "x", "changed")}


def test_records_of_briefs(tmp_path):
    args = (["/r"], [None], "q", 8, "grounded", ["b", "a"], [], [{"rank": 1, "locator": "x", "reason": "exact:path"}], ["0" * 64])
    key, text = stores.brief_record(*args)
    assert stores.FileStore(str(tmp_path)).put(text.encode()) == key and json.loads(text)["matched"] == ["a", "b"]
    assert stores.brief_record(*args[:2], "other", *args[3:])[0] != key
    with pytest.raises(ValueError):
        stores.brief_record(*args[:-1], [])
