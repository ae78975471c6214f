import glob
import hashlib
import random

from pyspark.sql import functions as F

from pulseline.llm import warc
from pulseline.session import scratch_path

SCHEMA = "page_id long, url string, html string, record int, task string"


def pages(spark, n=300):
    rows = [(i, f"http://x/{i}", f"<html>{'p' * (i % 50)}é{i}\r\n\r\n</html>", 1, "t") for i in range(n)]
    rows += [(None, None, None, None, None), (7, "http://x/7\r\nInjected: yes", "", 1, "t"), (5, "http://x/5", "<b>", 1, "t"), (5, "http://x/5", "<b>", 1, "t")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "page_id")


def volumes(spark, records, name):
    path = scratch_path(spark, name)
    warc.write_volumes(records, path)
    return path


def test_audit_finds_each_damaged_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_RECORDS", 16)
    monkeypatch.setattr(warc, "VOLUME_LEVELS", 1)
    source = pages(spark).cache()
    book = warc.manifest(warc.numbered(source), "page_id")
    bad = F.col("page_id").isin(3, 250) & (F.length("html") > 0)
    sound = warc.numbered(source)
    path = volumes(spark, sound.withColumn("record", F.when(bad, F.expr("overlay(record PLACING '?' FROM 20)")).otherwise(F.col("record"))), "test-warc")
    got = warc.audit(book, warc.read_leaves(spark, path, book)).collect()
    assert len(got) == 304 and {r.page_id for r in got if not r.intact} == {3, 250}
    same = warc.read_leaves(spark, volumes(spark, sound, "test-warc"), book)
    assert warc.audit(book, same).filter("NOT intact").count() == 0


def test_volumes_are_warc_files(spark):
    source = pages(spark, 40).coalesce(1).cache()
    book = warc.manifest(warc.numbered(source), "page_id").orderBy("position").collect()
    path = volumes(spark, warc.numbered(source), "test-warc")
    raw = open(glob.glob(path.removeprefix("file:") + "/*.txt")[0], "rb").read()
    for r in book:
        part = raw[r.start:r.start + r.length]
        assert part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n")
        head, _, body = part[:-4].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(body) and b"Injected" not in fields
        assert hashlib.sha256(part[:-4]).hexdigest() == r.digest
    assert sum(r.length for r in book) == len(raw)


def test_damage_hides_no_other_record(spark):
    """Lengths, first lines and end marks are damaged, bodies quote records, the file is cut: a record
    shows exactly where the bytes of its offset range are whole."""
    rng = random.Random(5)
    quoted = "WARC/1.1\r\nContent-Length: {}\r\n\r\nabc"
    rows = [(i, f"http://x/{i}", quoted.format(rng.randrange(3000)) * (i % 3) + "é" * (i % 40)) for i in range(80)]
    source = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).cache()
    book = warc.manifest(warc.numbered(source), "page_id").orderBy("start").collect()
    path = volumes(spark, warc.numbered(source), "test-warc")
    raw = open(glob.glob(path.removeprefix("file:") + "/*.txt")[0], "rb").read()
    assert {(r.start, r.length, r.digest) for r in book} <= set(warc.records_in(raw))
    for _ in range(200):
        bad = bytearray(raw)
        for _ in range(rng.randrange(1, 6)):
            r = rng.choice(book)
            line = raw.find(b"Content-Length: ", r.start) + 16
            at = rng.choice((line, r.start, r.start + r.length - 1, rng.randrange(len(raw))))
            bad[at] = rng.choice(b"0159W\r\n")
        bad = bytes(bad[:rng.choice((len(raw), rng.randrange(len(raw))))])
        found = {(start, length): digest for start, length, digest in warc.records_in(bad)}
        for r in book:
            whole = bad[r.start:r.start + r.length - 4] == raw[r.start:r.start + r.length - 4]
            assert (found.get((r.start, r.length)) == r.digest) == whole


def test_a_missing_volume_shows(spark):
    source = pages(spark, 20).coalesce(1).cache()
    book = warc.manifest(warc.numbered(source), "page_id")
    empty = volumes(spark, warc.numbered(source).limit(0), "test-warc")
    assert warc.audit(book, warc.read_leaves(spark, empty, book)).filter("intact").count() == 0


def test_empty_table(spark):
    source = spark.createDataFrame([], SCHEMA)
    book = warc.manifest(warc.numbered(source), "page_id")
    assert warc.audit(book, warc.read_leaves(spark, volumes(spark, warc.numbered(source), "test-warc"), book)).count() == 0
