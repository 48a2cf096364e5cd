"""Keyed streaming state: restart, a batch run twice, decay and closing by timers."""

import datetime as dt
import json
import os

import pytest

from orrery.operators import versions
from orrery.streaming import keyed
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def observe(folder, name, *rows):
    lines = [json.dumps({"tenant_id": "t", "type": "CONNECTS_TO", "from_id": a, "to_id": b, "edge_key": "", "source": "flow", "observed_at": (START + dt.timedelta(days=d)).isoformat() + "Z", "detail": None}) for a, b, d in rows]
    (folder / name).write_text("\n".join(lines))


def told(spark, root):
    rows = keyed.log(spark, root).orderBy("from_id", "at", "seq").collect()
    return [(r.from_id, r.action, (r.at - START).total_seconds() / 86400, r.observations, round(r.confidence, 4)) for r in rows]


def test_stream_of_observations(spark, tmp_path):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()

    def run():
        stream = spark.readStream.schema(keyed.OBSERVATION).json(str(folder))
        keyed.run(stream, root, checkpoint).awaitTermination()

    observe(folder, "1.json", ("a", "b", 0), ("a", "b", 0.5), ("c", "d", 1))
    run()
    assert told(spark, root) == [("a", "create", 0, 1, 0.6), ("a", "accumulate", 0.5, 2, 0.8), ("c", "create", 1, 1, 0.6)]
    # A new process goes on with the state; day 11 lets a and c decay (the watermark is a day behind), and only theirs changes.
    observe(folder, "2.json", ("e", "f", 11), ("c", "d", 11))
    run()
    got = told(spark, root)
    assert [x for x in got if x[0] == "a"][2:] == [("a", "decay", 8.5, 2, 0.75), ("a", "decay", 9.5, 2, 0.7)]
    assert [x for x in got if x[0] == "c"] == [("c", "create", 1, 1, 0.6), ("c", "decay", 9, 1, 0.55), ("c", "decay", 10, 1, 0.5), ("c", "decay", 11, 1, 0.45), ("c", "accumulate", 11, 2, 0.8)]
    # The last batch is run once more, as after a crash before its commit.
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{n}"):
            os.remove(f"{checkpoint}/commits/{n}")
    run()
    assert told(spark, root) == got
    # All but what was observed in time is over on day 45; then a starts anew.
    observe(folder, "3.json", ("g", "h", 45))
    run()
    observe(folder, "4.json", ("a", "b", 46))
    run()
    got = told(spark, root)
    a = [x for x in got if x[0] == "a"]
    assert a[-2:] == [("a", "close", 30.5, 2, 0.2), ("a", "create", 46, 1, 0.6)]
    assert [x[4] for x in a if x[1] == "decay"] == [round(max(0.2, 0.8 - 0.05 * k), 4) for k in range(1, 13)]
    table = keyed.versions_of(keyed.log(spark, root))
    assert {r.from_id for r in table.where("valid_to is null").collect()} == {"a", "g"}
    overlap = table.alias("x").join(table.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.valid_from") < F.col("y.valid_from")) & (F.col("x.valid_to") > F.col("y.valid_from")))
    assert overlap.count() == 0 and table.select("from_id", "id").distinct().where("from_id = 'a'").count() == 2


@pytest.mark.parametrize("days", [8, 12, 30])
def test_a_decay_is_that_of_a_sweep(spark, days):
    """A timer's confidence is what a sweep at that time makes of the edge."""
    at = START + dt.timedelta(days=days)
    marker = {"source": versions.COUNT_MARKER, "observed_at": START, "detail": "3"}
    edge = spark.createDataFrame([("e", "inferred", 0.9, [marker], START, None)], "id string, source string, confidence double, evidence array<struct<source:string,observed_at:timestamp,detail:string>>, valid_from timestamp, valid_to timestamp")
    swept = versions.aging_actions(edge, F.lit(at)).first()
    assert swept.action == "decay" and abs(swept.new_confidence - keyed.decayed_confidence(0.9, days)) < 1e-9
