import gzip
import hashlib
import http.server
import io
import tarfile
import threading

import pytest
from pyspark.sql import functions as F

from lociweave.sources import assets, supplements

DATA = bytes(range(256)) * 5000


@pytest.fixture
def server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int(self.headers.get("Range", "bytes=0-").split("=")[1].rstrip("-"))
            seen.append(start)
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(DATA) - start))
            self.end_headers()
            self.wfile.write(DATA[start:])

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/a/file.bin", seen
    s.shutdown()


def test_downloads_resume_and_verify(server, tmp_path):
    url, seen = server
    record = {"url": url, "size_bytes": len(DATA), "md5": hashlib.md5(DATA).hexdigest()}
    (tmp_path / "file.bin.part").write_bytes(DATA[:1000])
    got = assets.download(record, str(tmp_path))
    assert seen == [1000] and (tmp_path / "file.bin").read_bytes() == DATA and got["sha256"] == hashlib.sha256(DATA).hexdigest()
    assets.download(record, str(tmp_path))
    assert seen == [1000]  # it was there
    with pytest.raises(ValueError):
        assets.download(record | {"md5": "0" * 32, "filename": "other.bin"}, str(tmp_path))
    assert not (tmp_path / "other.bin").exists() and not (tmp_path / "other.bin.part").exists()
    assert [r["path"][-5:] for r in assets.download_all([record | {"filename": f"{k}.bin"} for k in "xyz"], str(tmp_path))] == ["x.bin", "y.bin", "z.bin"]


def test_members_stream(spark, tmp_path):
    for k in (1, 2):
        with tarfile.open(tmp_path / f"a{k}.tar.gz", "w:gz") as t:
            for name in ("d/one.txt", f"two{k}.txt"):
                info = tarfile.TarInfo(name)
                info.size = 3
                t.addfile(info, io.BytesIO(b"abc"))
    out = str(tmp_path / "out")
    rows = assets.extract(spark, [str(tmp_path / "a1.tar.gz")], ["one.txt", "two1.txt"], out).collect()
    assert sorted((r.name, r.size_bytes) for r in rows) == [("one.txt", 3), ("two1.txt", 3)] and (tmp_path / "out" / "one.txt").read_bytes() == b"abc"
    with pytest.raises(Exception, match="lacks two1.txt"):
        assets.extract(spark, [str(tmp_path / "a2.tar.gz")], ["one.txt", "two1.txt"], out).collect()
    content = gzip.compress(b"gene_id\tname\tTPM\nE1.4\tA\t2.5\nE2\tB\t1\nE2\tB\t1\n")
    assert assets.gene_of_member(content, "E1") == {"TPM": 2.5}
    for gene in ("E2", "E3"):
        with pytest.raises(ValueError):
            assets.gene_of_member(content, gene)


def test_conflicts_are_errors(spark):
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    with pytest.raises(Exception, match="two runs"):
        supplements.run_inventory(make([("E", "1", "R1"), ("E", "1", "R2")], "experiment cycle run")).collect()
    e = "experiment tf batch assay approved"
    with pytest.raises(Exception, match="two entries"):
        supplements.experiments(make([("E", "T", "B", "GHT", "YES")] * 2, e), "ght").collect()
    with pytest.raises(Exception, match="not YES or NO"):
        supplements.experiments(make([("E", "T", "B", "GHT", "maybe")], e), "ght").collect()
    runs = make([("T", "R", "E", "1", "x_magix")], "tf run experiment cycle peak_file")
    with pytest.raises(ValueError, match="no selected runs of U"):
        supplements.selected_runs(runs, ["T", "U"])
    good = supplements.selected_runs(runs, ["T"])
    for rows in ([], [("E", "T", "B", "GHT", "NO")], [("E", "U", "B", "GHT", "YES")]):
        with pytest.raises(Exception, match="disagrees"):
            supplements.agree(good, supplements.experiments(make(rows, e), "GHT")).collect()
    wide = make([("A", "1", None), ("B", "0", "1")], "bait X Y").withColumn("row_no", F.lit(1))
    assert {tuple(r) for r in supplements.interaction_table(wide, "row_no").collect()} == {("A", "X", "1"), ("B", "X", "0"), ("B", "Y", "1")}
    with pytest.raises(Exception, match="two hashes"):
        rows = spark.createDataFrame([(9, ["f", "aa"]), (10, ["f", "bb"])], "row_no long, cells array<string>")
        supplements.expected_hashes(rows, 8).collect()
    head = spark.createDataFrame([(1, ["a", None, "b", "a"])], "row_no long, cells array<string>")
    assert supplements.repeated_header(head, 1) == {"a": [0, 3], "b": [2]}
