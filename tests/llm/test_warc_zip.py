import hashlib
import io
import zipfile

import pytest

from corvane.llm import warc_zip as W


def brute(rows):
    out, top = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        top[b] = max(i, top.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        later = len(b) >= 1000 and top[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if later else "response", top[b] if later else None))
    return sorted(out)


ROWS = [(i, ["http://a/ b?é=\r\nX: y", None, ""][i % 3], ["é" * 600, "x" * 999, "y" * 1000, None, "", "\r\n\r\nWARC/1.1\r\n" * 200, f"own {i}"][i % 7]) for i in range(80)] + [(500, "u", "z" * 3_000_000)]


def test_round_trip_equals_brute_force(spark):
    pages = spark.createDataFrame([(*r, "clash", 3) for r in ROWS], "page_id long, url string, html string, payload string, refers_to int")
    assert sorted(map(tuple, W.archive_round_trip(pages).collect())) == brute(ROWS)


@pytest.mark.parametrize("always64", [False, True])
def test_packages_are_zip_files_and_members_are_found(always64):
    out = io.BytesIO()
    z = W.ZipWriter(out, always64)
    members = {"archive/00000.warc.gz": b"abc" * 50, "indexes/00000.cdxj": b"", "é.txt": b"x"}
    begins = {name: z.add(name, data) for name, data in members.items()}
    z.close()
    with zipfile.ZipFile(out) as f:
        assert {n: f.read(n) for n in f.namelist()} == members and f.testzip() is None
    size = len(out.getvalue())
    found = {name: (method, length, W.data_offset(out, header)) for name, method, _, length, header in W.read_directory(out, size)}
    assert found == {name: (0, len(data), begins[name]) for name, data in members.items()}


def test_packages_of_other_writers_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("a", b"one")
        with f.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as m:
            m.write(b"two")
        f.comment = b"PK\x05\x06 in a comment"
    assert [(n, s) for n, _, _, s, _ in W.read_directory(out, len(out.getvalue()))] == [("a", 3), ("b", 3)]
    for broken in (b"", out.getvalue()[:-40]):
        with pytest.raises(ValueError):
            W.read_directory(io.BytesIO(broken), len(broken))


def test_members_are_cut_and_payloads_kept(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    packages = W.write_packages(W.with_revisits(pages), folder, member_bytes=2000, always64=True)
    members = W.list_members(packages, folder)
    assert members.count() > packages.count() and packages.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = {r["page_id"]: r for r in W.read_records(members, folder, with_payload=True).collect()}
    assert all(bytes(got[i]["payload"]) == (b"" if got[i]["record_type"] == "revisit" else (h or "").encode()) for i, _, h in ROWS)


def test_null_ids_repeats_empty_and_missing(spark):
    big = "q" * 2000
    pages = spark.createDataFrame([(None, "u", big), (1, "u", big), (1, "u", big), (2, None, big)], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in W.archive_round_trip(pages).collect()), key=str)
    assert got == [(0, "response", None), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    assert W.archive_round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        W.archive_round_trip(pages.drop("html"))
