"""One truth over overlapping batches: any order of arrival, replays, failures, and what is read for it."""
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket
from tidemark.operators.timeseries import bucketed, exact_aggregates, reconciled
from tidemark.sources import measurements
from tidemark.sources import merged as m
from tidemark.sources.measurements import SCHEMA

COLUMNS = "event_id", "ts", "user_id", "event_type", "value", "props"


def batch(spark, rows):
    made = spark.createDataFrame([(i, at, None, kind, value, None) for i, at, kind, value in rows], SCHEMA.replace("timestamp_ntz", "string"))
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def table(spark, path, *batches, **more):
    m.create(spark, str(path), {"hours": m.Rollup("1 hour", ("event_type",))}, buckets=4, **more)
    return [m.land(b, str(path), str(k)) for k, b in enumerate(batches)]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


def rebuilt(spark, path):
    rows = m.rows(spark, str(path))
    return bucketed(rows, bucket("ts", "1 hour"), ["event_type"], exact_aggregates())


@pytest.fixture(scope="module")
def batches(spark):
    rnd = random.Random(7)
    out = []
    for _ in range(3):
        ids = rnd.sample(range(40), 25)
        out.append(batch(spark, [(i, f"2024-01-{rnd.randint(1, 4):02d} {rnd.randint(0, 23):02d}:00:00", rnd.choice("ab"), rnd.randint(0, 9) / 4) for i in ids + ids[:5]]))
    return out


def test_any_order_of_arrival(spark, batches, tmp_path):
    a, b, c = batches
    want = rows_of(measurements.deduplicated(a.unionByName(b).unionByName(c)))
    for k, order in enumerate([(a, b, c), (c, b, a, b)]):
        table(spark, tmp_path / str(k), *order)
        assert rows_of(m.rows(spark, str(tmp_path / str(k)))) == want
        assert reconciled(m.rollup(spark, str(tmp_path / str(k)), "hours"), rebuilt(spark, tmp_path / str(k))).count() == 0


def test_a_replay_changes_nothing(spark, batches, tmp_path):
    first, again = table(spark, tmp_path, batches[0], batches[0])
    assert again.version.days == first.version.days and again.version.rollups == first.version.rollups and again.version.changed == () and not again.rewritten


def test_only_what_a_batch_overlaps_is_read(spark, tmp_path):
    known = batch(spark, [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", "a", 1.0) for i in range(90)])
    fresh = batch(spark, [(1000, "2024-01-03 11:00:00", "a", 2.0)])
    late = batch(spark, [(4, "2024-01-07 09:00:00", "a", 5.0)])  # row 4 was on the fifth
    _, second, third = table(spark, tmp_path, known, fresh, late)
    assert second.read_days == [] and second.rewritten == [] and second.version.changed == ("2024-01-03",)
    assert len(third.hit_buckets) == 1 and third.read_days == ["2024-01-05"] and third.rewritten == ["2024-01-05"]
    assert third.version.changed == ("2024-01-05", "2024-01-07")
    for d in ("2024-01-01", "2024-01-03"):  # files and rollups of other days are those of the version before
        assert third.version.days[d] == second.version.days[d] and third.version.rollups["hours"][d] == second.version.rollups["hours"][d]
    plan = m.known_days(spark, str(tmp_path), third.hit_buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = m.rows(spark, str(tmp_path), since="2024-01-04 12:00:00", until="2024-01-06")
    assert {f.split("dt=")[1][:10] for f in read.inputFiles()} == {"2024-01-04", "2024-01-05", "2024-01-06"}
    read = m.rows(spark, str(tmp_path), since="2024-01-05", until="2024-01-05 12:00:00")
    assert {f.split("dt=")[1][:10] for f in read.inputFiles()} == {"2024-01-05"} and read.count() == 9


def test_filters_have_no_misses_and_few_false_hits(spark):
    version = m.Version(buckets=4, bitmaps=2)
    known = m._marked(spark.range(0, 20_000).select(F.col("id").alias("event_id")), version)
    filters = m._filter_of(known)
    asked = m._marked(spark.range(10_000, 60_000).select(F.col("id").alias("event_id")), version)
    hit = m.may_be_known(asked, filters)
    assert hit.where("event_id < 20000").count() == 10_000
    assert hit.where("event_id >= 20000").count() < 40_000 * 0.01


def test_a_landing_that_fails_leaves_the_old_version(spark, batches, tmp_path, monkeypatch):
    table(spark, tmp_path, batches[0])
    before = rows_of(m.rows(spark, str(tmp_path)))
    commit = m._commit
    monkeypatch.setattr(m, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        m.land(batches[1], str(tmp_path))
    monkeypatch.setattr(m, "_commit", commit)
    assert rows_of(m.rows(spark, str(tmp_path))) == before
    (tmp_path / "manifests" / "v0000000002.json").write_text('{"number": 2, "da')  # a writer that ended as it wrote
    assert rows_of(m.rows(spark, str(tmp_path))) == before
    m.land(batches[1], str(tmp_path))
    want = rows_of(measurements.deduplicated(batches[0].unionByName(batches[1])))
    assert rows_of(m.rows(spark, str(tmp_path))) == want
    m.cleared(spark, str(tmp_path))
    assert rows_of(m.rows(spark, str(tmp_path))) == want and not list((tmp_path / "_landing").glob("*"))
    assert reconciled(m.rollup(spark, str(tmp_path), "hours"), rebuilt(spark, tmp_path)).count() == 0


def test_writers_that_overlap_and_rows_that_cannot_land(spark, batches, tmp_path):
    table(spark, tmp_path, batches[0])
    with pytest.raises(RuntimeError, match="another writer"):
        m._commit(spark, str(tmp_path), m.latest(spark, str(tmp_path)))
    for wrong in ((None, "2024-01-01 00:00:00", "a", 1.0), (1, None, "a", 1.0)):
        with pytest.raises(Exception, match="a row has no"):
            m.land(batch(spark, [wrong]), str(tmp_path))
    with pytest.raises(ValueError, match="create it first"):
        m.land(batches[0], str(tmp_path / "none"))
    with pytest.raises(ValueError, match="divide a day"):
        m.create(spark, str(tmp_path / "odd"), {"weeks": m.Rollup("7 days")})
    assert m.land(batches[0].limit(0), str(tmp_path)).version.changed == ()


def test_crowded_days_are_written_anew_and_a_day_may_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "MOST_FOLDERS", 2)
    found = table(spark, tmp_path, *(batch(spark, [(i, "2024-01-01 10:00:00", "a", float(i))]) for i in range(4)))
    assert [len(f.version.days["2024-01-01"]) for f in found] == [1, 2, 2, 2] and m.rows(spark, str(tmp_path)).count() == 4
    moved = m.land(batch(spark, [(i, "2024-01-02 10:00:00", None, float(i)) for i in range(4)]), str(tmp_path))
    assert list(moved.version.days) == ["2024-01-02"] and list(moved.version.rollups["hours"]) == ["2024-01-02"]
    assert [(r["event_type"], r["n"]) for r in m.rollup(spark, str(tmp_path), "hours").collect()] == [(None, 4)]
    assert m.rolled_to(spark, str(tmp_path), "hours", bucket("bucket_start", "7 days", "4 days")).collect()[0]["n"] == 4


def test_large_landings_meet_in_parts_of_so_many_rows(spark, batches, tmp_path, monkeypatch):
    """Beyond SENT_IDS ids nothing is sent to all tasks; parts are counted by rows, which bounds what one of them sorts."""
    monkeypatch.setattr(m, "SENT_IDS", 4)
    monkeypatch.setattr(m, "ROWS", 6)
    want = rows_of(measurements.deduplicated(batches[0].unionByName(batches[1]).unionByName(batches[2])))
    table(spark, tmp_path, *batches, batches[0])
    assert rows_of(m.rows(spark, str(tmp_path))) == want and not list((tmp_path / "_maybe").glob("*"))
    assert reconciled(m.rollup(spark, str(tmp_path), "hours"), rebuilt(spark, tmp_path)).count() == 0
    some = spark.range(60).select(F.col("id").alias("event_id"))
    met = m._met(some, some.where("event_id % 2 = 0"), ["event_id"], "left_semi")
    assert met.count() == 30 and "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()


def test_filters_are_asked_once(spark, batches, tmp_path, monkeypatch):
    """What the filters let through is written, so that its readers do not ask them again."""
    asked, may_be_known = spark.sparkContext.accumulator(0), m.may_be_known

    def counted(marked, filters):
        tell = F.udf(lambda i: asked.add(1) or i, "bigint").asNondeterministic()
        return may_be_known(marked, filters).withColumn("event_id", tell("event_id"))

    monkeypatch.setattr(m, "may_be_known", counted)
    table(spark, tmp_path, batches[0], batches[0])
    assert asked.value == 25
