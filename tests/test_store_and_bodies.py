"""Sources, the mapping store, a stand-in model, bodies written back, streams run as streams."""

import json

from pyspark.sql import functions as F

from veilspark.operators import bodies, metrics, ner, restore
from veilspark.operators import mask as M
from veilspark.operators.detect import detect, detected_rows
from veilspark.plans.config import Settings
from veilspark.sources import mappings, requests
from veilspark.streaming import replacer


def test_requests_in_batches_and_as_a_stream(spark, tmp_path):
    lines = [{"request_id": "x", "api": "chat", "model": "m", "body": '{"messages":[]}'}, {"api": "chat"}, {"request_id": "x", "body": None}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    df = requests.read(spark, str(tmp_path / "in"))
    assert sorted((r.request_id or "", r.body or "") for r in df.collect()) == [("", ""), ("", ""), ("x", ""), ("x", '{"messages":[]}')]
    ids = [r.request_id for r in requests.with_server_ids(df).collect()]
    assert len(set(ids)) == 4 and "x" not in ids
    q = requests.read_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_mapping_store_end_to_end(spark, tmp_path):
    df = detect(spark.createDataFrame([(1, 0, "пишите a.b@mail.example.com"), (2, 0, "ничего"), (3, 0, "x@y.example и z@y.example")], "request_id int, o int, text string"))
    masked, mapping = M.mask(df, "request_id", "o")
    path = str(tmp_path / "store")
    mappings.save(mappings.with_expiry(mapping, F.to_timestamp(F.lit("2024-05-01 23:59:00")), 120), path)
    mappings.save(mappings.with_expiry(mapping.where("request_id = 9"), F.to_timestamp(F.lit("2024-05-02 10:00:00"))), path)
    stored = mappings.load(spark, path)
    assert {r.request_id for r in stored.collect()} == {1, 3} and stored.count() == 3  # a request without placeholders has no row
    asked = lambda at: spark.createDataFrame([(1, at), (2, at), (3, at)], "request_id int, at string").withColumn("at", F.to_timestamp("at"))
    live = lambda at, gone=None: sorted((r.request_id, r.original or "") for r in mappings.live(stored, asked(at), "at", gone).collect())
    assert live("2024-05-02 00:00:59") == [(1, "a.b@mail.example.com"), (2, ""), (3, "x@y.example"), (3, "z@y.example")]
    assert live("2024-05-02 00:01:00") == [(1, ""), (2, ""), (3, "")]
    assert live("2024-05-01 23:59:30", spark.createDataFrame([(3,)], "request_id int"))[2:] == [(3, "")]
    back = restore.restore(masked.select("request_id", "masked_text", "text"), stored, "request_id", "masked_text")
    assert all(r.restored_text == r.text for r in back.collect())


def test_a_model_adds_to_the_patterns(spark):
    """A stand-in model tags capitalised words; a text that it fails on keeps what the patterns found."""

    def load():
        def model(texts):
            if any("сбой" in t for t in texts):
                raise RuntimeError("no result")
            return [(t.split(), ["B-PER" if w[0].isupper() else "O" for w in t.split()]) for t in texts]

        return model

    rows = [(0, "звонил Пётр с a@b.example"), (1, "сбой Пётр c@d.example"), (2, ""), (3, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        df = spark.createDataFrame(rows, "id int, text string").withColumn("ner_spans", F.lit("the caller's"))
        found = detect(df, ner=ner.provider(load))
        assert found.columns == ["id", "text", "ner_spans", "spans"] and {r.ner_spans for r in found.collect()} == {"the caller's"}
        got = sorted((r.id, r.entity_type, r.text) for r in detected_rows(found, ["id"]).collect())
        assert got == [(0, "EMAIL_ADDRESS", "a@b.example"), (0, "PERSON", "Пётр"), (1, "EMAIL_ADDRESS", "c@d.example")]
        only = detected_rows(detect(df, ner=ner.provider(load), entities=["person"], **Settings().detection()), ["id"])
        assert [(r.id, r.entity_type) for r in only.collect()] == [(0, "PERSON")]
        assert "PERSON" not in {r.entity_type for r in detected_rows(detect(df, ner=ner.provider(load), score_threshold=0.71), ["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_masked_bodies_keep_all_else(spark):
    body = {"model": "m", "n": 12345678901234567890, "messages": [{"role": "user", "content": "от a@b.example"}, {"content": [{"type": "image_url", "text": "c@d.example"}, {"type": "text", "text": "к e@f.example"}, 7]}, {"content": None, "tool_calls": [{"function": {"arguments": '{"to":"a@b.example"}'}}, None]}, 5], "instructions": " ", "input": ["x", {"type": "input_text", "text": "g@h.example", "output": [{"text": "плюс"}]}], "x": [1.5, None, "é<"]}
    odd = [(1, json.dumps(body)), (2, "no json"), (3, None), (4, "{}"), (5, '{"messages": [ {"content": "чисто"} ]}')]
    got = {r.id: r for r in bodies.mask_bodies(spark.createDataFrame(odd, "id int, body string"), "id").collect()}
    new = json.loads(got[1].masked_body)
    assert new["messages"][0]["content"] == "от <EMAIL_ADDRESS_1>" and new["messages"][1]["content"][0]["text"] == "c@d.example"
    assert new["messages"][1]["content"][1]["text"] == "к <EMAIL_ADDRESS_2>" and new["messages"][2]["tool_calls"][0]["function"]["arguments"] == '{"to":"<EMAIL_ADDRESS_3>"}'
    assert new["input"][1]["text"] == "<EMAIL_ADDRESS_4>" and (new["n"], new["x"], new["instructions"], new["model"]) == (body["n"], body["x"], " ", "m")
    assert [m.original for m in got[1].mapping] == ["a@b.example", "e@f.example", "a@b.example", "g@h.example"]
    assert all(got[i].masked_body == b for i, b in odd[1:])


def test_restored_messages(spark):
    message = {"content": [{"type": "x", "text": "для <P_1>"}], "reasoning_content": "<P_2>?", "tool_calls": [{"function": {"arguments": '{"a":"<P_1>"}'}}]}
    rows = [(1, json.dumps(message), {"<P_1>": 'Иван "И"', "<P_2>": "Пётр"}), (2, json.dumps(message), None), (3, "no json", {"<P_1>": "x"}), (4, None, {"<P_1>": "x"})]
    got = {r.id: r.restored_message for r in bodies.restore_messages(spark.createDataFrame(rows, "id int, message string, mapping map<string,string>")).collect()}
    assert json.loads(got[1]) == {"content": [{"type": "x", "text": 'для Иван "И"'}], "reasoning_content": "Пётр?", "tool_calls": [{"function": {"arguments": '{"a":"Иван "И""}'}}]}
    assert [got[i] for i in (2, 3, 4)] == [rows[1][1], "no json", None]


def test_stream_by_request(spark, tmp_path):
    """Two micro-batches: a finish without text ends both fields; a mapping past its time to live is forgotten."""
    ddl = "request_id string, choice_index int, field string, seq long, delta string, finish_reason string, mapping map<string,string>"
    m = {"<P_1>": "Иван"}
    batches = [
        [("a", 0, "content", 1, "x <P", None, m), ("a", 0, "reasoning_content", 2, "y <", None, None), ("a", 1, "content", 3, "z <P_", None, None), ("b", 0, "content", 1, "<P_1>", None, None)],
        [("a", 0, "content", 4, "_1> <P_", None, None), ("a", 0, None, 5, None, "stop", None), ("a", 1, "content", 6, "1>", None, None)],
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = []
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        q = replacer.restore_stream(stream, idle=None).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = sorted((r.request_id, r.choice_index, r.field, r.seq, r.emitted) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, "content", 1, "x "), ("a", 0, "content", 4, "Иван "), ("a", 0, "content", 5, "<P_"), ("a", 0, "reasoning_content", 2, "y "), ("a", 0, "reasoning_content", 5, "<"), ("a", 1, "content", 3, "z "), ("a", 1, "content", 6, "Иван"), ("b", 0, "content", 1, "<P_1>")]


def test_windowed_rates_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:04:59", "x"), ("2024-01-01 00:20:00", "y")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = metrics.rates(stream, "ts", "kind", watermark="1 minute").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert [(r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x", 2)]
