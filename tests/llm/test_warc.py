from __future__ import annotations

import hashlib
import random
import zipfile
import zlib

import pytest
from cases import empty

from moorage.llm import warczip as w

SCHEMA = "page_id bigint, url string, html string, _digest string, _response int, path string, at int, n_records int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "p", 2, 3) for r in rows], SCHEMA)


def back(packages):
    found = w.read_records(packages).collect()
    return sorted(
        ((r.record_id, r.record_type, r.target_uri, r.payload_bytes, r.payload_digest, r.refers_to or None, r.payload)
         for r in found), key=str
    )


def brute(rows, least=1000):
    out = []
    for key, url, html in rows:
        body = (html or "").encode()
        twins = [k for k, _, h in rows if (h or "").encode() == body and k is not None]
        refers = max(twins) if key is not None and len(body) >= least and max(twins) > key else None
        kind = "response" if refers is None else "revisit"
        out.append(("" if key is None else str(key), kind, w._line(url) if url else None, len(body),
                    hashlib.sha1(body).hexdigest(), None if refers is None else str(refers), body if refers is None else None))
    return sorted(out, key=str)


@pytest.fixture
def rows():
    rng = random.Random(3)
    page = lambda n: "".join(rng.choice("abc <é\n\r\U0001f642") for _ in range(n))
    texts = [page(rng.choice([0, 10, 999, 1500, 4000])) for _ in range(40)]
    same = page(1200)
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)] + [(100 + i, "http://same/", same) for i in range(30)]
    rows += [(200, None, None), (201, "", ""), (202, "http://x/ a\r\nWARC-Type: odd\tü", "short"), (203, "u", "short")]
    rows += [(300, "u", "é" * 500), (301, "u", "é" * 500), (302, "u", "é" * 499), (303, "u", "é" * 499)]
    rows += [(None, "n", same), (None, "n", None), (129, "again", same), (5, "u", texts[5]), (400, "long", page(300_000))]
    return rows


@pytest.mark.parametrize("hot", [20_000, 4])
def test_round_trip_equals_brute_force(spark, tmp_path, monkeypatch, rows, hot):
    monkeypatch.setattr(w, "HOT_ROWS", hot)
    monkeypatch.setattr(w, "PACKAGE_RECORDS", 9)
    monkeypatch.setattr(w, "RANGE_BYTES", 1000)
    monkeypatch.setattr(w, "READ", 3000)
    packages = w.write_packages(frame(spark, rows).repartition(3), str(tmp_path / "w"))
    assert packages.agg({"n_records": "sum"}).first()[0] == len(rows)
    assert back(packages) == brute(rows)
    assert w.read_records(packages).where("problem is not null").count() == 0


def test_members_are_stored_and_plain_zip_tools_read_them(spark, tmp_path, rows):
    packages = w.write_packages(frame(spark, rows).coalesce(1), str(tmp_path / "w"))
    members = w.package_members(packages).collect()
    assert {m.member for m in members} == {w.ARCHIVE, w.INDEX} and {m.method for m in members} == {0}
    for m in members:
        with zipfile.ZipFile(m.path) as z, open(m.path, "rb") as f:
            f.seek(m.at)
            assert f.read(m.size) == z.read(m.member)
            assert z.testzip() is None


def archive(records, packed=True):
    return b"".join(zlib.compress(r, wbits=31) if packed else r for r in records)


def entries(*pages):
    return [w.record("response", str(i), f"http://h/{i}", p)[0] for i, p in enumerate(pages)]


def listed(spark, *paths):
    return spark.createDataFrame([(str(p), "x") for p in paths], "path string, at string")


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("large", [True, False])
def test_zip64_directories_comments_and_archives_without_an_index(spark, tmp_path, monkeypatch, packed, large):
    if large:
        # Sizes, places and counts above these limits go to the ZIP64 fields.
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    pages = [b"one", b"two" * 40_000, b""]
    name = "archive/a.warc" + (".gz" if packed else "")
    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
        z.writestr("readme.txt", "text " * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr(name, archive(entries(*pages), packed))
        z.writestr("pages/", "")
        z.comment = b"PK\5\6 a comment that looks like an end record PK\5\6"
    found = w.read_records(listed(spark, tmp_path / "p.wacz")).orderBy("at").collect()
    assert [(r.record_id, r.payload, r.problem) for r in found] == [(str(i), p, None) for i, p in enumerate(pages)]
    members = {m.member: m for m in w.package_members(listed(spark, tmp_path / "p.wacz")).collect()}
    assert members["readme.txt"].at is None and members[name].size == len(archive(entries(*pages), packed))
    assert w.directory_of(w.Ranges(str(tmp_path / "p.wacz")))[2] == 3


def test_many_members(tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i:06}" + "x" * 40, b"")
    found = [e[0] for e in w.entries_of(w.Ranges(str(tmp_path / "m.zip")))]
    assert len(found) == 66_000 and found[65_999].startswith("m065999")


def test_damaged_packages_give_a_problem(spark, tmp_path):
    good = entries(b"a" * 50)
    with zipfile.ZipFile(tmp_path / "good.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", archive(good))
    whole = (tmp_path / "good.wacz").read_bytes()
    (tmp_path / "cut.wacz").write_bytes(whole[:-30])
    (tmp_path / "empty.wacz").write_bytes(b"")
    (tmp_path / "text.wacz").write_bytes(b"no archive at all " * 20)
    with zipfile.ZipFile(tmp_path / "packed.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", archive(good))
    with zipfile.ZipFile(tmp_path / "index.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", archive(good))
        z.writestr("indexes/index.cdxj", 'k 1 {"offset": "5000", "length": "10", "filename": "a.warc.gz"}\n')
    with zipfile.ZipFile(tmp_path / "record.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", archive([b"nothing\r\n\r\n", good[0].replace(b"a" * 50, b"b" * 50)]))
    names = ["cut", "empty", "text", "packed", "index", "missing"]
    paths = [tmp_path / f"{n}.wacz" for n in names]
    found = w.read_records(listed(spark, *paths)).collect()
    assert len(found) == len(names) and all(r.problem and r.record_id is None for r in found)
    odd = w.read_records(listed(spark, tmp_path / "record.wacz")).orderBy("at").collect()
    assert [r.problem for r in odd] == ["malformed", "digest differs"]
    both = w.read_records(listed(spark, tmp_path / "good.wacz", tmp_path / "cut.wacz")).collect()
    assert [r.payload for r in both if r.problem is None] == [b"a" * 50]


def test_empty_tables(spark, tmp_path):
    packages = w.write_packages(empty(frame(spark, [(1, "u", "t")])), str(tmp_path / "w"))
    assert packages.count() == 0 and w.read_records(packages).count() == 0
    assert w.package_members(spark.createDataFrame([(None,)], "path string")).count() == 0
