from quire.llm import common
from quire.llm.common import ROW, keyed, marked, with_all_texts, with_text


def test_row_filter(spark, monkeypatch):
    rows = spark.range(20_000).withColumnRenamed("id", ROW)
    ids = spark.range(0, 20_000, 7).withColumnRenamed("id", ROW)
    passed = {r[0] for r in marked(rows, ids).where("_may").select(ROW).collect()}
    assert {*range(0, 20_000, 7)} <= passed and len(passed) < 4_500
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)  # a crowded filter lets more through; joins are the same
    named = ids.selectExpr(ROW, "'x' as mark")
    assert with_text(rows, named).count() == ids.count()
    out = with_all_texts(rows, named)
    assert out.count() == 20_000 and out.where("mark = 'x'").count() == ids.count()


def test_keys_follow_ids(spark):
    docs = spark.createDataFrame([(3, "c", 1), (1, "a", 2), (3, "b", 3), (None, "z", 4), (1, "a", 2)], "doc_id long, text string, _row int")
    out = keyed(docs).orderBy(ROW).collect()
    assert [r.doc_id for r in out] == [1, 1, 3, 3, None] and [r.text for r in out][2:] == ["b", "c", "z"]
    assert len({r[ROW] for r in out}) == 5
    assert keyed(docs.where("text = 'z'")).count() == 1 and keyed(docs.limit(0)).count() == 0


def test_a_worker_drops_what_other_operators_learnt():
    def stage(module, step):
        def run(batches):
            step()
            yield from batches

        run.__module__ = module
        return lambda: list(common.tidy(run)([1]))

    held = []
    pack = stage("quire.llm.packing", lambda: (common.worker_made("vocabulary", "spec", str.upper), common.worker_memo("words", 9).now.update(a=1), held.append(len(common.HASHES))))
    near = stage("quire.llm.jaccard_join", lambda: (common.HASHES.of([b"a", b"b"]), held.append((len(common._MEMOS), len(common._MADE)))))
    near()
    pack()
    assert held[1] == 0 and common.worker_memo("words", 9).now == {"a": 1}
    pack()
    assert common.worker_memo("words", 9).now == {"a": 1}  # kept from task to task of one operator
    near()
    assert held[-1] == (0, 0)
