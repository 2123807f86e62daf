"""Records by byte ranges against records of whole files, with a cut at every place."""

import gzip
import random

import pytest

from strandworks.sources import fasta
from strandworks.sources.ranges import read_record_ranges

KEYS = ("path", "record", "header", "block_id", "start", "seq")


def rows(df):
    return sorted((str(r["path"]).replace("file:///", "/").replace("file:/", "/"), *(r[k] for k in KEYS[1:])) for r in df.collect())


@pytest.fixture
def reads(spark):
    """Read with ranges of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None, "spark.sql.files.minPartitionNum": None}
    old = {k: spark.conf.get(k, None) for k in keys}

    def read(root, size, block):
        for k, v in zip(keys, (str(size), "0", "1")):
            spark.conf.set(k, v)
        return read_record_ranges(spark, root, block)

    yield read
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_every_cut(spark, tmp_path, reads):
    text = b"junk\nACG\n>one  first\nacgt\nAC gt\r\n\n  NNN\n>empty\n>two\n" + b"ACGTA\n" * 9 + b"> \nC\n>last"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.fa").write_bytes(text)
    (tmp_path / "y.fa").write_bytes(b"no header\nACGT\n")
    (tmp_path / "z.fa.gz").write_bytes(gzip.compress(text * 3))
    (tmp_path / "other.txt").write_bytes(b">no\nACGT\n")
    for block in (4, 1 << 20):
        want = rows(fasta.read_records(spark, str(tmp_path), block))
        assert len(want) > 8
        for size in (*range(1, 24, 3), 50, 1 << 20):
            assert rows(reads(str(tmp_path), size, block)) == want, size


def test_a_long_record_takes_many_tasks(spark, tmp_path, reads):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2000)]
    (tmp_path / "big.fa").write_text(">short\nAC\n>long one\n" + "\n".join(lines * 20) + "\n>end\nG\n")
    df = reads(str(tmp_path), 1 << 17, 50_000)
    parts = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    got = sorted((r.record, r.block_id, r.header, r.seq) for r in df.collect())
    assert parts >= 16 and [x[2] for x in got][:2] == ["short", "long one"] and got[-1] == (2, 0, "end", "G")
    assert "".join(x[3] for x in got if x[0] == 1) == "".join(lines * 20) and all(len(x[3]) == 50_000 for x in got[1:-2])


def test_malformed_events_are_named_by_line(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"run": 1}\n\n[1]\n{"run": 2\n{"run": 3}\n')
    with pytest.raises(ValueError, match="malformed line 4 in .*e.jsonl: .\"run\": 2"):
        fasta.read_events(spark, str(tmp_path), "run bigint").collect()
    (tmp_path / "e.jsonl").write_text('{"run": 1}\n\n[1]\n{"run": 2}\n')
    assert sorted(r.run for r in fasta.read_events(spark, str(tmp_path), "run bigint").collect()) == [1, 2]
