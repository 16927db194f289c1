from pyspark.sql import functions as F

from quire.api import Collection
from quire.operators import exchange as X
from quire.operators import layout as Y
from quire.sources.write import text_document


def test_collection(spark):
    rows = [("a", text_document(["Alpha", "needle"], info={"Title": "T", "CreationDate": "D:20240321094500+09'00'"})), ("b", b"%PDF-1.4 nothing")]
    docs = Collection(spark.createDataFrame(rows, "doc_id string, content binary"))
    assert {r.doc_id: r.status for r in docs.opened.collect()} == {"a": "ok", "b": "damaged"}
    facts = docs.metadata().first()
    assert facts.title == "T" and str(facts.creation_date) == "2024-03-21 00:45:00"
    assert docs.search("NEEDLE", columns=False).count() == 1
    assert docs.page(0).first().error is None and docs.page(3).first().error == "page 3 is outside 0 to 0"
    provider = spark.createDataFrame([("a", 0, "given needle needle"), ("z", 0, "needle")], "doc_id string, page_index int, text string")
    assert Collection(docs.files, provider).search("needle", columns=False).count() == 3


def test_json(spark):
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 1), (2, 1), (2, 0), (0, 0))))
    text, back, none = spark.range(1).select(X.quad_json(quad), X.quad_from_json(X.quad_json(quad)), X.quad_from_json(F.lit('{"topLeft":[1]}'))).first()
    assert text.startswith('{"topLeft":[0.0,1.0]') and [tuple(p) for p in back] == [(0, 1), (2, 1), (2, 0), (0, 0)] and none is None
    s = spark.range(1).select(X.selection_from_json(F.lit('{"start":{"page":3,"offset":1},"end":{"page":2,"offset":9}}'))).first()[0]
    assert tuple(s.start) == (2, 9) and tuple(s.end) == (3, 1)
    assert spark.range(1).select(X.position_json(F.lit(4), F.lit(1.5), F.lit(2.0))).first()[0] == '{"page":4,"offset":1.0,"zoom":2.0}'


def test_scrolling(spark):
    got = spark.range(1).select(Y.capture(F.lit(50.0), F.lit(20.0), F.lit(100.0)), Y.restore(F.lit(0.3), F.lit(20.0), F.lit(100.0)), Y.centred(F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(500.0)), Y.centred(F.lit(480.0), F.lit(490.0), F.lit(100.0), F.lit(500.0))).first()
    assert tuple(got) == (0.3, 50.0, 0.0, 400.0)


def test_kept_texts_are_parsed_once(spark):
    from pyspark.sql import functions as F

    texts = spark.range(3).select(F.col("id").cast("string").alias("t"))
    for read, times in ((X.quad_from_json, 1), (X.selection_from_json, 1), (X.position_from_json, 1), (X.highlight_from_json, 2)):
        plan = texts.select(read(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("from_json(") + plan.count("jsontostructs(") == times, plan
