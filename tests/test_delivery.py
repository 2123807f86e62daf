"""A stream that is killed and started again delivers each row once."""

import json
import os

import pytest

from strandworks.streaming.delivery import Delivery

SCHEMA = "run bigint, seq bigint, event string"


def put(folder, name, rows):
    """Files are read in the order of their times."""
    (folder / name).write_text("".join(json.dumps({"run": r, "seq": s, "event": f"{r}/{s}"}) + "\n" for r, s in rows))
    os.utime(folder / name, (1_700_000_000 + int(name[0]),) * 2)


def run(spark, tmp_path, sink, checkpoint="checkpoint"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


class Killed(Delivery):
    """Fails in a given version, before or after its rows are written, or after its ledger."""

    def __init__(self, root, version, when):
        super().__init__(root)
        self.at, self.when = version, when

    def write(self, rows, path):
        if path.endswith(f"version={self.at}") and self.when == "before rows":
            raise RuntimeError("killed")
        super().write(rows, path)
        if path.endswith(f"version={self.at}") and self.when == "after rows":
            raise RuntimeError("killed")

    def __call__(self, batch, batch_id):
        at = self.version(batch.sparkSession) + 1
        super().__call__(batch, batch_id)
        if at == self.at and self.when == "after ledger":
            raise RuntimeError("killed")


@pytest.mark.parametrize("when", ["before rows", "after rows", "after ledger"])
def test_each_row_once(spark, tmp_path, when):
    (tmp_path / "in").mkdir()
    want = []
    for i in range(4):
        rows = [(r, s) for r in (1, 2) for s in range(5 * i + 1, 5 * i + 6)] + [(1, 5 * i + 1)]
        put(tmp_path / "in", f"{i}.json", rows)
        want += set(rows)
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, Killed(root, 2, when))
    run(spark, tmp_path, Delivery(root))
    got = lambda: sorted((r.run, r.seq) for r in Delivery(root).rows(spark).collect())
    assert got() == sorted(want)
    # a lost checkpoint brings all of it again, and a new file
    put(tmp_path / "in", "9.json", [(3, 1), (1, 21)])
    run(spark, tmp_path, Delivery(root), "another")
    assert got() == sorted([*want, (3, 1), (1, 21)])
    assert {r.run: r.delivered for r in Delivery(root).ledger(spark).collect()} == {1: 21, 2: 20, 3: 1}
