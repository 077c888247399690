import gzip
import hashlib
import random

import pytest

from barloom.sources import catalog as C


@pytest.mark.parametrize("step", [20_000, 1 << 30])
def test_file_fingerprints_read_no_file_whole(spark, tmp_path, monkeypatch, step):
    rnd, bom = random.Random(5), b"\xef\xbb\xbf"
    given = {"random.parquet": rnd.randbytes(300_000), "ended.csv": b"a,b\r\n1,2\r\n\r\n" * 9000 + b"\n\n", "open.csv": b"x\n" * 50_000 + b"end",
             "mark.csv": bom + b"a\nb\n" * 20_000, "mark_open.csv": bom + bom + b"a\nb", "only_mark.csv": bom, "feed.txt": b"\n",
             "long line.txt": b"z" * 150_000 + b"\n" + b"y" * 70_000, "packed.csv.gz": gzip.compress(b"a\nb\n" * 10)}
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    # Files above this fail when they are read whole, as those above 2 GB do by default.
    monkeypatch.setattr(C, "HASH_PIECE", 4000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 40_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    # Joins that turn out small are broadcast only once they run, as with large files.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        found = {r.file: (r.length, r.sha256) for r in C.file_fingerprints(spark, str(tmp_path / "*"), step).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        for name in ("files.maxPartitionBytes", "autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in given.items()}
