"""What Python workers hold: tables of one operator at a time, kept from task to task, and batches of bounded size."""

import pyarrow as pa
from kerbline.llm import langid, near, packing


def docs(spark, n=400):
    words = "the of and to in is that for it with as was on are by this be from at or".split()
    rows = [(i, " ".join(words[(i * k + k) % 20] for k in range(1, 30)), ("en", "de")[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(32)


def held(spark):
    """What operators keep in the workers that take turns at 64 tasks."""

    def look(batches):
        from kerbline.llm import common, langid, packing

        for _ in batches:
            pass
        names = [common._KEPT["key"][0]] if getattr(common, "_KEPT", None) else []
        names += [k for k, m in (("langid", langid), ("packing", packing)) if getattr(m, "_SCORERS", None) or getattr(m, "_ENCODERS", None)]
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return {r["name"] for r in spark.range(64).repartition(64).mapInArrow(look, "name string").collect()}


def test_near_stage_keeps_no_tables_of_the_stage_before(spark):
    df = docs(spark)
    langid.keep_known(df).write.format("noop").mode("overwrite").save()
    assert held(spark) == {"langid"}
    near.marked(df, 5).write.format("noop").mode("overwrite").save()
    assert held(spark) == set()


def test_tasks_of_packing_share_their_worker_s_table(spark):
    packing.pieces(docs(spark)).write.format("noop").mode("overwrite").save()
    assert held(spark) == {"packing"}


def test_texts_of_the_near_stage_come_in_small_batches(spark, monkeypatch):
    seen, cut = {}, near.cut

    def noted(df, tag):
        seen[tag] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return cut(df, tag)

    monkeypatch.setattr(near, "cut", noted)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    near.near_duplicates(docs(spark, 60)).collect()
    assert seen["marks"] <= 1024 and seen["grams"] <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == old
