import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc as W
from corpusloom.llm._spark import new_path


def brute(rows):
    best = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            best.setdefault(raw, []).append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        group = best.get(raw, [p])
        top = max((x for x in group if x is not None), default=None)
        again = len(group) > 1 and p != top
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    d = tmp_path / "sf"
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").write.mode("overwrite").parquet(str(d / "pages.parquet"))
    got = W.op2_warc_transactions(spark, str(d)).collect()
    assert all(r.n_metadata == 1 and r.has_request for r in got)
    return sorted((tuple(r)[:5] for r in got), key=str)


def test_against_brute_force(spark, tmp_path):
    big, other = "é<p>\r\n\r\n</p>" * 200, "z" * 1000
    rows = [(1, "http://a/b", big), (2, "http://a/c", big), (3, None, None), (4, "http://x", ""), (5, "u\nv", "short"), (6, "http://a/d", "short"), (7, "q", other), (7, "q", other), (8, "q", "y" * 999), (9, "q", "y" * 999), (0, "http://a/b", big), (10, "long", "w" * 3_000_000)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_null_page_ids_and_empty_table(spark, tmp_path):
    big = "b" * 2000
    rows = [(None, "u", big), (None, "u", big), (3, "u", big), (None, "v", "x")]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert run(spark, [], tmp_path) == []


def test_reader_takes_plain_and_gzipped_archives():
    rec = lambda k, b: f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    parts = [rec("resource", b"a\n\nb"), rec("metadata", b""), rec("resource", b"\r\n\r\nx" * 400_000)]
    for blob in (b"".join(parts), b"".join(gzip.compress(p) for p in parts), gzip.compress(b"".join(parts))):
        got = list(W.parse_records(io.BytesIO(blob)))
        assert [r["record_type"] for r in got] == ["resource", "metadata", "resource"] and got[0]["payload"] == b"a\n\nb" and len(got[2]["payload"]) == 2_000_000
    with pytest.raises(ValueError):
        list(W.parse_records(io.BytesIO(gzip.compress(parts[0])[:-9])))


def test_assembly_through_chains_and_orphans(spark):
    rows = [
        ("f", 1, "response", "<r1>", ["<q1>"]), ("f", 2, "request", "<q1>", []), ("f", 3, "metadata", "<m1>", ["<q1>"]), ("f", 4, "metadata", "<m2>", ["<m1>"]), *(("f", 10 + k, "metadata", f"<n{k}>", [f"<n{k - 1}>" if k else "<m2>"]) for k in range(6)), ("g", 3, "metadata", "<c1>", ["<c2>"]), ("g", 4, "metadata", "<c2>", ["<c1>"]),
        ("f", 5, "response", "<r2>", []), ("f", 6, "request", "<q2>", ["<r2>"]), ("g", 1, "metadata", "<m9>", ["<nowhere>"]), ("g", 2, "warcinfo", "<w>", []), ("h", 1, "response", "<r1>", ["<q3>"]), ("h", 2, "request", "<q3>", []),
    ]
    df = spark.createDataFrame(rows, "file string, at long, record_type string, record_id string, concurrent array<string>").withColumn("payload", F.lit(None).cast("binary"))
    got = {(r.capture.file, r.capture.at): (r.response and r.response.record_id, r.request and r.request.record_id, [m.record_id for m in r.metadata]) for r in W.assemble(df).collect()}
    assert got == {("f", 1): ("<r1>", "<q1>", ["<m1>", "<m2>", *(f"<n{k}>" for k in range(6))]), ("f", 5): ("<r2>", "<q2>", []), ("g", 1): (None, None, ["<m9>"]), ("g", 3): (None, None, ["<c1>"]), ("g", 4): (None, None, ["<c2>"]), ("h", 1): ("<r1>", "<q3>", [])}


def test_archives_round_trip(spark):
    folder = new_path(spark, "trip")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string")
    files = W.write_archives(pages, folder)
    back = W.read_archives(spark, files, folder).where("record_type = 'response'")
    assert {(r.target_uri, bytes(r.payload).decode()) for r in back.collect()} == {(f"http://h/{i}", f"<p>{i}</p>") for i in range(50)}
