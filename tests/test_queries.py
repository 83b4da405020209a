"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from treeline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLE[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_parts_and_suppliers_of_one_id_stay_apart(spark, tmp_path):
    """From 1,000,000 parts on, both have ids that the other one has."""
    db = duckdb.connect()
    db.execute("create table part as select unnest([3, 4, 1000001, 1000002, 1000003, null])::bigint as p_partkey, 'B' as p_brand")
    db.execute("create table supplier as select unnest([1, 2, 3, null])::bigint as s_suppkey")
    for t in ("part", "supplier"):
        db.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = rows(db.sql(ORACLE["upserted_catalog"]).df())
    assert len(want) == 10
    assert rows(QUERIES["upserted_catalog"](spark, str(tmp_path)).toPandas()) == want


def test_stream_and_table_windows_agree(spark, tmp_path):
    from treeline.streaming import logtail

    schema = "ts timestamp, kind string, value double"
    spark.createDataFrame([], schema)
    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 'a' as kind, 1.0D as value union all select timestamp '2024-01-01 05:00:00', 'a', 2.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = logtail.windowed(stream, "ts", "kind", "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    table = logtail.windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "kind", "value")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, table.collect()))


def test_log_tail_waits_for_complete_lines(spark, tmp_path):
    """Appended lines come once, also after a restart; half a line waits; a malformed one fails."""
    from treeline.streaming import logtail

    folder, log = str(tmp_path / "logs"), tmp_path / "logs" / "w1" / "calls.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text('{"call": 1}\n{"ca')

    def run(name):
        q = logtail.tail_calls(spark, folder, "call long").writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.call for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("a") == [1]
    with log.open("a") as f:
        f.write('ll": 2}\n{"call": 3}\n')
    assert run("b") == [1, 2, 3]
    assert sorted(r.call for r in logtail.read_calls(spark, folder, "call long").collect()) == [1, 2, 3]
    with log.open("a") as f:
        f.write("\n")
    with pytest.raises(Exception, match="malformed"):
        logtail.read_calls(spark, folder, "call long").count()
