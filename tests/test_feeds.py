"""Change feeds with restarts, the page connector, titles, measures and areas."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inkgrid.functions import texts as t
from inkgrid.operators import graph, titles
from inkgrid.sources.connector import DrawingPages
from inkgrid.streaming import feed
from inkgrid.streaming.progress import latest_progress

PAGES = "doc long, page long, kind string, id long"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Four files of pages, in their order; schedules come and go, some documents have none."""
    rnd = random.Random(4)
    folder = tmp_path_factory.mktemp("steps")
    rows = []
    for part in range(4):
        now = [(rnd.randrange(6), part * 10 + rnd.randrange(10), rnd.choice(["mark", "mark", "schedule"]) if doc else "mark", part * 1000 + k) for k, doc in ((k, rnd.random() > 0.1) for k in range(40))]
        rows += now
        spark.createDataFrame(now, PAGES).coalesce(1).write.parquet(str(folder / "tmp" / str(part)))
        (file,) = (folder / "tmp" / str(part)).glob("*.parquet")
        file.rename(folder / f"part{part}.parquet")
    return rows, folder


def stream(spark, folder):
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(str(folder))


def test_carried_state_survives_a_restart(spark, steps, tmp_path):
    rows, folder = steps
    with pytest.raises(StreamingQueryException):
        feed.started(feed.carried(stream(spark, folder)), str(tmp_path), stop_after=1).awaitTermination()
    made = feed.carried(stream(spark, folder))
    feed.started(made, str(tmp_path)).awaitTermination()
    got = sorted((r.doc, r.mark_id, r.schedule_id) for r in feed.table(spark, str(tmp_path), made.schema, "mark_id").collect())
    now, want = {}, []
    for doc, _, kind, i in sorted(rows, key=lambda r: (r[3] // 1000, r[1], r[2] != "schedule", r[3])):
        if kind == "schedule":
            now[doc] = i
        elif doc in now:
            want.append((doc, i, now[doc]))
    assert got == sorted(want) and len(want) > 20


def test_updates_are_merged_by_key_after_a_restart(spark, steps, tmp_path):
    rows, folder = steps

    def events(df):
        return latest_progress(df.select(F.col("doc").alias("pdf_id"), F.col("id").alias("seq"), F.col("page").alias("ts"), F.when(F.col("kind") == "mark", F.col("id")).alias("curr_step"), F.when(F.col("kind") == "schedule", F.col("id").cast("string")).alias("msg"), F.lit(None).cast("boolean").alias("success")))

    with pytest.raises(StreamingQueryException):
        feed.started(events(stream(spark, folder)), str(tmp_path), stop_after=2).awaitTermination()
    made = events(stream(spark, folder))
    feed.started(made, str(tmp_path)).awaitTermination()
    # only changed keys are written, so the parts hold fewer rows than documents times batches
    parts = spark.read.parquet(str(tmp_path / "updates"))
    assert parts.select("batch").distinct().count() == 4
    got = sorted(map(tuple, feed.table(spark, str(tmp_path), made.schema, "pdf_id").collect()))
    assert got == sorted(map(tuple, events(spark.createDataFrame(rows, PAGES)).collect()))
    assert feed.table(spark, str(tmp_path / "nothing"), made.schema, "pdf_id").collect() == []


@pytest.fixture
def documents(spark, tmp_path):
    spark.dataSource.register(DrawingPages)
    for doc in ("a", "b", "c"):
        (tmp_path / f"{doc}.json").write_text("\n".join(json.dumps({"page_number": p, "width": 10.0 * p, "height": 5.0, "elems": [{"text": f"{doc}{p}"}]}) for p in range(1, 4)) + "\n\n")
    return tmp_path


def test_connector_prunes_documents_and_pages(spark, documents):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        pages = spark.read.format("drawing_pages").option("path", str(documents)).load()
        assert pages.rdd.getNumPartitions() == 3 and pages.count() == 9
        some = pages.filter((F.col("page_number") > 1) & (F.col("pdf_id") == "b"))
        assert some.rdd.getNumPartitions() == 1
        assert sorted((r.pdf_id, r.page_number, json.loads(r.elems)[0]["text"]) for r in some.collect()) == [("b", 2, "b2"), ("b", 3, "b3")]
        assert pages.filter("pdf_id = 'nobody'").collect() == []
        asked = spark.read.format("drawing_pages").option("path", str(documents)).option("keys", "c, missing").load()
        rows = asked.collect()
        assert sum(r.pdf_id == "c" for r in rows) == 3 and [tuple(r) for r in rows if r.pdf_id == "missing"] == [("missing", None, None, None, None)]
        assert asked.filter("page_number = 2").count() == 1
    finally:
        spark.conf.set(key, before)


def test_connector_as_a_stream(spark, documents, tmp_path_factory):
    out = tmp_path_factory.mktemp("feed")

    def run():
        made = spark.readStream.format("drawing_pages").option("path", str(documents)).load().groupBy("pdf_id").agg(F.count("*").alias("n"))
        query = made.writeStream.outputMode("update").option("checkpointLocation", str(out / "offsets")).foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/updates/batch={k}")).start()
        query.processAllAvailable()
        query.stop()
        return {r.pdf_id: r.n for r in feed.table(spark, str(out), made.schema, "pdf_id").collect()}

    assert run() == {"a": 3, "b": 3, "c": 3}
    (documents / "d.json").write_text(json.dumps({"page_number": 1, "elems": []}))
    assert run() == {"a": 3, "b": 3, "c": 3, "d": 1}


def test_titles_of_documents(spark):
    def item(page, i, x, y, text, parent=None):
        return (1, page, i, float(x), float(y), x + 20.0, y + 10.0, text, parent, 1000.0, 1000.0)

    rows = [item(1, 1, 900, 350, "Project name:"), item(1, 2, 895, 330, "The\nHouse"), item(1, 3, 895, 310, "OWNER: me"), item(1, 4, 895, 290, " of Usher"), item(1, 5, 895, 270, "late")]
    rows += [item(2, 1, 900, 350, "PROJECT NAME "), item(2, 2, 895, 330, "New House"), item(2, 3, 900, 300, "Drawing Title"), item(2, 4, 900, 200, "Plan"), item(2, 5, 900, 180, "of roof"), item(2, 6, 900, 150, "A-12"), item(2, 7, 900, 120, "Drawing\n number"), item(2, 8, 900, 190, "inner", 3), item(2, 9, 900, 110, None)]
    rows += [item(3, 1, 100, 350, "project name"), item(3, 2, 900, 900, "project name")]
    elems = spark.createDataFrame(rows, "doc long, page long, id long, x0 double, y0 double, x1 double, y1 double, text string, parent long, page_width double, page_height double")
    got = {r.page: (r.page_name, r.house_name) for r in titles.document_titles(elems).collect()}
    assert got == {1: ("late", "New House"), 2: ("Plan of roof", "New House"), 3: ("", "New House")}
    assert {(r.page, r.name) for r in titles.house_names(elems).collect()} == {(1, "The House of Usher"), (2, "New House")}
    assert titles.document_titles(elems.limit(0)).collect() == []


@pytest.mark.parametrize(("text", "want"), [("12'", 12.0), ("12' 6\"", 12.5), ("12' 6 1/2\"", 12 + 6.5 / 12), ("10 feet", 10.0), ("114 inches", 9.5), (".5", 0.5), ("1 3/4\"", 1.75 / 12), ("1/0", 0.0), ("door", None), ("", None), (None, None)])
def test_measures_in_feet(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(t.feet(F.col("t"))).first()[0]
    assert got == want or abs(got - want) < 1e-12


def test_areas_by_finish(spark):
    elems = spark.createDataFrame([("r1", "schedule_row", '{"name_of_room": "Hall"}'), ("r2", "schedule_row", '{"name_of_room": "Hall"}'), ("r3", "schedule_row", "{"), ("c1", "schedule_cell", '{"ceiling": "C1"}'), ("c2", "schedule_cell", '{"ceiling": "C1"}'), ("c3", "schedule_cell", '{"floor": "C1"}'), ("q1", "square_feet", '{"name_of_room": "Hall", "square_feet": 120}'), ("q2", "square_feet", '{"name_of_room": "Hall", "square_feet": 30.5}'), ("q3", "square_feet", '{"name_of_room": "Attic", "square_feet": 9}')], "id string, elem_type string, data string")
    links = spark.createDataFrame([("c1", "r1", "cell_of_row"), ("c2", "r2", "cell_of_row"), ("c3", "r1", "cell_of_row"), ("c1", "r3", "cell_of_row")], "from_id string, to_id string, link_type string")
    assert {tuple(r) for r in graph.area_by_finish(elems, links, "ceiling").collect()} == {("C1", 1, 150.5), (None, 1, 9.0)}
