"""The stateful operator against plain Python, over restarts, repeated batches and a lost state."""

import random
import shutil
from datetime import datetime, timedelta

import pytest

pytest.importorskip("google.protobuf")
from epochgraph.streaming import latest  # noqa: E402

LOG = "crate_id long, version_id long, stable boolean, created_at timestamp, diff int"


def expected(rows):
    """{(package, release)}: the latest of what is there."""
    n, rank = {}, {}
    for crate, version, stable, created, diff in rows:
        if None in (crate, version, created, diff):
            continue
        n[crate, version] = n.get((crate, version), 0) + diff
        rank[crate, version] = (bool(stable), created, version)
    best = {}
    for (crate, version), times in n.items():
        if times > 0:
            best[crate] = max(best.get(crate, rank[crate, version]), rank[crate, version])
    return {(crate, r[2]) for crate, r in best.items()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    releases = [(rng.randrange(12), v, rng.random() < 0.7, datetime(2020, 1, 1) + timedelta(hours=rng.randrange(60), microseconds=v % 3)) for v in range(150)]
    log = [(*r, 1) for r in releases] + [(*r, -1) for r in rng.sample(releases, 60)] + [(*releases[0], 1), (*releases[0], 1)]
    rng.shuffle(log)  # some are taken back before they come
    log[70:70] = [(None, 900, True, datetime(2030, 1, 1), 1), (1, None, True, datetime(2030, 1, 1), 1), (1, 901, True, None, 1), (1, 902, True, datetime(2030, 1, 1), None), (77, 903, None, datetime(2020, 1, 1), 1)]
    (tmp_path / "in").mkdir()
    parts = [log[i::4] for i in range(3)] + [log[3::4], [(c, v, s, t, -1) for c, v, s, t in releases if (c, v) in expected(log)]]
    done = []
    for i, part in enumerate(parts):  # each part by a stream that is started anew
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in/part=*"))
        latest.start(stream, str(tmp_path)).awaitTermination()
        done += part
        changes = spark.read.parquet(str(tmp_path / "changes"))
        assert {tuple(r) for r in latest.latest_of(changes).collect()} == expected(done)
    rows = sorted(map(tuple, changes.collect()), key=str)
    assert {r[3] for r in rows} == {1, -1}

    commits = sorted((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()  # as if the driver had been lost before it noted the last batch: it is run again
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    latest.start(stream, str(tmp_path)).awaitTermination()
    assert last.exists() and sorted(map(tuple, spark.read.parquet(str(tmp_path / "changes")).collect()), key=str) == rows

    shutil.copytree(tmp_path / "in/part=0", tmp_path / "in/part=9")
    shutil.move(tmp_path / "checkpoint/state/0/1", tmp_path / "lost")
    with pytest.raises(Exception, match="(?i)state"):
        latest.start(stream, str(tmp_path)).awaitTermination()
