from pyspark.sql import functions as F

from tripweave.streaming import ingest


def test_ingest_in_two_runs_loses_nothing_and_repeats_nothing(spark, tmp_path):
    inbox, out, check = (tmp_path / n for n in ("in", "out", "check"))
    inbox.mkdir()

    def run():
        ingest.start_ingest(spark, str(inbox), str(out), str(check), available_now=True).awaitTermination()

    (inbox / "1.json").write_text('{"_type":"location","lat":1,"lon":2,"tst":3,"_receiver_user":"a"}\nnot json\n\n')
    run()
    (inbox / "2.json").write_text('{"_type":"waypoint","received_at":"2024-03-01T10:00:00Z"}\n[1,2]\n{"x":1}\n')
    run()
    run()
    good = ingest.ingested(spark, str(out))
    assert sorted((r["user"], r["msg_type"]) for r in good.collect()) == [("a", "location"), ("unknown", "unknown"), ("unknown", "waypoint")]
    assert good.filter(F.get_json_object("payload", "$.received_at").isNull()).isEmpty()
    dated = good.filter("msg_type = 'waypoint'").first()
    assert str(dated["received_date"]) == "2024-03-01"
    bad = ingest.ingested(spark, str(out), "quarantine")
    assert sorted(r["payload"] for r in bad.collect()) == ["[1,2]", "not json"]
