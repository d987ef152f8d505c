import gzip

from agestrata.llm import warc
from agestrata.llm.store import new_folder


def _record(i, body="hello", refers=None):
    return warc.page_record(i, f"http://x/{i}", body, refers, "2020-01-01T00:00:00Z")


def _ids(entries):
    return [e.fields["warc-record-id"] for e in entries if e.fields]


def _gaps(entries):
    return [(e.start, e.stop) for e in entries if e.reason]


def test_members_are_gzip():
    assert gzip.decompress(warc.member(_record(1))) == _record(1)


def test_salvage_of_whole_archives():
    for pack in (warc.member, bytes):
        parts = [pack(_record(i, "text " * i)) for i in range(20)]
        entries = warc.salvage(b"".join(parts))
        assert len(_ids(entries)) == 20 and not _gaps(entries)
        assert [e.start for e in entries] == [sum(map(len, parts[:i])) for i in range(20)]


def test_later_records_are_recovered_and_gaps_are_exact():
    for pack in (warc.member, bytes):
        parts = [pack(_record(i, f"body {i} " * 50)) for i in range(6)]
        at = [sum(map(len, parts[:i])) for i in range(7)]
        flipped = bytearray(parts[2])
        flipped[len(flipped) // 2] ^= 0x55
        data = b"".join([parts[0], b"junk WARC/1.1 and \x1f\x8b\x08 more", parts[1], bytes(flipped), *parts[3:5], parts[5][:-9]])
        entries = warc.salvage(data)
        assert _ids(entries) == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4)]
        junk = len(b"junk WARC/1.1 and \x1f\x8b\x08 more")
        assert _gaps(entries) == [(at[1], at[1] + junk), (at[2] + junk, at[3] + junk), (at[5] + junk, len(data))]
        # Every byte is in a record or a gap.
        assert entries[0].start == 0 and all(a.stop == b.start for a, b in zip(entries, entries[1:]))


def test_a_payload_that_looks_like_a_record():
    inner = _record(7, "inner").decode()
    entries = warc.salvage(_record(1, inner) + _record(2))
    assert _ids(entries) == ["<urn:x-page:1>", "<urn:x-page:2>"]
    broken = _record(1, inner).replace(b"WARC-Type: response", b"WARC-Tipe: response", 1) + _record(2)
    entries = warc.salvage(broken)
    assert _ids(entries)[-1] == "<urn:x-page:2>" and _gaps(entries)[0][0] == 0


def test_wrong_digest_is_quarantined():
    bad = _record(1).replace(b"hello", b"hellO")
    assert _gaps(warc.salvage(bad + _record(2))) == [(0, len(bad))]


def test_salvage_never_fails():
    import random

    rng, whole = random.Random(3), b"".join(warc.member(_record(i)) for i in range(5))
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        entries = warc.salvage(bytes(data[: rng.randrange(len(data))]))
        assert all(a.stop <= b.start or a.start == b.start for a, b in zip(entries, entries[1:]))


def test_round_trip_of_damaged_files_on_spark(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    parts = [warc.member(_record(i)) for i in range(3)]
    (folder / "a.warc.gz").write_bytes(parts[0] + b"###" + parts[1] + parts[2][:20])
    (folder / "b.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(folder)).collect()
    assert sorted(r["record_id"] for r in rows if r["reason"] is None) == ["urn:x-page:0", "urn:x-page:1"]
    assert len([r for r in rows if r["reason"]]) == 2 and {bytes(r["payload"]) for r in rows if r["payload"]} == {b"hello"}


def test_pages(spark):
    pages = [
        (1, "http://a/\r\nX: y", "same", 0), (2, None, "same", 0), (3, "http://c", None, 0), (4, "u", "", 0), (5, "v", "", 0),
        (6, "w", "né 🙂", 0), (None, "z", "same", 0), (7, "dup", "dup", 0), (7, "dup", "dup", 0), (8, "long", "y" * 3_000_000, 0),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, file int").withColumnRenamed("file", "_digest")
    rows = sorted(warc.archived_pages(df).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    kinds = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows]
    assert kinds == [
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 5), (4, 0, "revisit", 5), (5, 0, "response", None),
        (6, 8, "response", None), (7, 3, "response", None), (7, 3, "response", None), (8, 3_000_000, "response", None),
        (None, 4, "revisit", 2),
    ]
    assert {r["payload_digest"] for r in rows if r["payload_bytes"] == 4} == {warc.sha1_base32(b"same")}
    assert warc.archived_pages(df.limit(0)).collect() == []


def test_files_of_lost_attempts_are_not_read(spark):
    pages = spark.createDataFrame([(i, "u", f"p{i}") for i in range(4)], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.with_originals(pages), folder)
    base = folder.removeprefix("file://").removeprefix("file:")
    with open(f"{base}/archives/part-000000-999999-0000.warc.gz", "wb") as f:
        f.write(warc.member(_record(99)))
    assert warc.read_archives(spark, folder).count() == 4
