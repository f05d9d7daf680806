"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from hodonym.sources import readers, writers
from hodonym.streaming.windows import first_rows, windowed_counts


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("j,u,s,a\nAB,Alba,1,Strada Unirii (Strada Lenin)\nAB,Alba,x,\nAB,Alba,2,Aleea 12A\n,,,\nAB,Alba,3,Strada După\n")
    r = readers.registry(spark, str(tmp_path / "r.csv"))
    s = readers.streets(r)
    assert [tuple(x) for x in s.orderBy("id").select("siruta", "street_type", "name", "core_name_norm", "is_numeric").collect()] == [(1, "Strada", "Unirii", "unirii", 0), (2, "Aleea", "12A", None, 1)]
    assert [x.alias_normalized for x in readers.aliases(s).collect()] == ["strada lenin"]
    assert readers.registry(spark, str(tmp_path / "r.csv"), limit=1).count() == 1


def test_other_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("siruta,lat,long,cod_judet,localitate\n1,45.5,25.1,AB,Alba\n,1,2,AB,X\nx,1,2,AB,Y\n2,bad,2,AB,Z\n")
    assert [tuple(x) for x in readers.centres(spark, str(tmp_path / "c.csv")).orderBy("siruta").select("siruta", "lat").collect()] == [(1, 45.5), (2, None)]
    (tmp_path / "q.sql").write_text("-- :name one\nselect 1;\n\n\nnoise\n-- :name two\nselect 2\n-- =====\nmore\n")
    assert readers.named_queries(str(tmp_path / "q.sql")) == {"one": "select 1", "two": "select 2"}
    (tmp_path / "k.json").write_text(json.dumps({"id": 1, "name": "Unirii", "uat": {"id": 5}, "county": {"shortName": "AB"}, "locality": None, "roadType": {"name": "strada aleea"}, "roadStatus": {"name": "ok"}}) + "\n")
    assert readers.cadastre(spark, str(tmp_path / "k.json")).select("uat_siruta", "street_type", "locality_raw").first() == (5, "Aleea", None)
    first = spark.createDataFrame([(1, "7", "Alee", "Ion Popescu")], "row_id long, sector_code string, tip string, denumire string")
    second = spark.createDataFrame([(2, "AB", "Alba", "x", "Stradă", "Poet Vasile Ion")], "row_id long, judet_raw string, localitate_raw string, sirsup string, tip string, denumire string")
    assert [tuple(x) for x in readers.postal(first, second).orderBy("row_id").select("code", "street_type", "core_name_norm_swapped").collect()] == [(7, "Aleea", "popescu ion"), (None, "Strada", "ion vasile")]
    assert readers.not_done(first, spark.createDataFrame([(1,)], "row_id long"), "row_id").count() == 0
    line = ["a b", *[""] * 5, "persons", "A B", "", "1850x", *["" for _ in range(13)]]
    (tmp_path / "u.csv").write_text(",".join(readers.CURATION) + "\n" + ",".join(line) + "\n" + ",".join(line[:7] + ["Later"] + line[8:]) + "\n")
    assert [tuple(x) for x in readers.curation(spark, str(tmp_path / "u.csv")).select("core_name_norm", "full_name", "birth_year").collect()] == [("a b", "A B", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.replace_table(df, str(tmp_path / "t"), ["a"])
    writers.replace_table(df, str(tmp_path / "t"))
    writers.append_rows(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    writers.write_json(df, str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert writers.text_table(df.orderBy("a")) == "a  b\n1  ·\n2  x"
    assert writers.worklist(df, ["label"]).columns == ["a", "b", "label"]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 11:00:00", "a"), (3, "2024-01-02 01:00:00", "b")], "id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", windowed_counts(source(), "ts", ["kind"]), "complete"), ("d", first_rows(source(), ["kind"], "ts"), "append")):
        q = df.writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("s_w").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.kind for r in spark.table("s_d").collect()) == ["a", "b"]


def test_sectors_and_named_csv(spark):
    c = spark.createDataFrame([(179141, "B", "OWN", 1.0, 2.0)], "siruta int, judet string, uat string, lat double, lon double")
    got = {r.siruta: r.uat for r in readers.with_sectors(c).collect()}
    assert len(got) == 6 and got[179141] == "OWN" and got[179196] == "BUCUREȘTI SECTORUL 6"
    df = spark.createDataFrame([(1, None), (2, "a,b")], "x int, y string")
    assert writers.named_csv([("one", df), ("two", df.limit(0))]) == '# one\nx,y\n1,\n2,"a,b"\n\n# two\nx,y\n'
