"""The event contract on messages of every version."""

import base64
import json

from presswork.streaming import contract

BASE = dict(schema_version=5, event_id="e", event_type="upvote", user_id=1, source_space="mind", article_id="N7", event_ts=100)


def messages(spark, rows):
    values = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    return spark.createDataFrame([(bytearray(v.encode()),) for v in values], "value binary")


def test_old_versions_become_current(spark):
    rows = [
        {"schema_version": 2, "event_id": "a", "event_type": "upvote", "user_id": 1, "answer_id": 12, "event_ts": 1},
        {"schema_version": 3, "event_id": "b", "event_type": "upvote", "user_id": 1, "article_id": 13, "event_ts": 1},
        {"schema_version": 4, "event_id": "c", "event_type": "upvote", "user_id": 1, "news_id": "N14", "event_ts": 1},
        {**BASE, "event_id": "d", "source_space": "live", "article_id": "L" + "0a" * 16},
    ]
    good, dead = contract.accept(messages(spark, rows))
    assert {r.event_id: (r.source_space, r.article_id) for r in good.collect()} == {"a": ("mind", "N12"), "b": ("mind", "N13"), "c": ("mind", "N14"), "d": ("live", "L" + "0a" * 16)}
    assert dead.count() == 0


def test_what_breaks_the_contract_is_a_dead_letter(spark):
    cases = {
        "malformed": "{oops", "event_type": {**BASE, "event_type": "poke"}, "required": {**BASE, "event_ts": None}, "article_shape": {**BASE, "article_id": "7"},
        "article_required": {k: v for k, v in BASE.items() if k != "article_id"}, "query_required": {**BASE, "event_type": "search_query"}, "dwell_required": {**BASE, "event_type": "dwell"},
        "dwell_range": {**BASE, "event_type": "dwell", "dwell_ms": 86_400_001}, "sponsored_live": {**BASE, "source_space": "live", "article_id": "L" + "0" * 32, "campaign_id": 1}, "news_id": {**BASE, "news_id": "N8"},
    }
    good, dead = contract.accept(messages(spark, cases.values()))
    assert good.count() == 0
    assert sorted(r.error for r in dead.collect()) == sorted(cases)
    assert "{oops" in {base64.b64decode(r.payload).decode() for r in dead.collect()}


def test_the_key_ignores_times_and_the_wire_round_trips(spark):
    good, _ = contract.accept(messages(spark, [{**BASE, "event_ts": 1}, {**BASE, "event_ts": 2}, {**BASE, "event_type": "downvote"}]))
    assert good.select(contract.idempotency_key().alias("k")).distinct().count() == 2
    sent = contract.encode(good)
    assert {bytes(r.key) for r in sent.collect()} == {b"mind:1"}
    again, dead = contract.accept(sent)
    assert dead.count() == 0 and sorted(map(str, again.select(*good.columns).collect())) == sorted(map(str, good.collect()))
    assert sorted(r.label for r in contract.training_labels(good).collect()) == [0, 1, 1]


def test_keyed_messages_stay_in_a_stream(spark, tmp_path):
    messages(spark, [BASE]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value binary").parquet(str(tmp_path / "in"))
    good, dead = contract.accept(stream)
    assert good.isStreaming and dead.isStreaming
