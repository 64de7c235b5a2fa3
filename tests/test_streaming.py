"""The streaming message-log count resumes from its checkpoint."""

import shutil

from quarry.streaming import topics


def test_stream_counts_and_resume(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    events = "/root/testdata/sf0.001/events.parquet"
    shutil.copy(events, src / "part-0.parquet")
    out = str(tmp_path / "out")
    first = {r.topic: r.messages for r in topics.stream_topic_counts(
        spark, str(src), output_dir=out).collect()}
    batch = {r.topic: r.messages for r in topics.topic_counts(
        topics.message_log(spark.read.parquet(events))).collect()}
    assert first == batch
    # a new file arrives: the restarted query adds it to the kept state
    shutil.copy(events, src / "part-1.parquet")
    second = {r.topic: r.messages for r in topics.stream_topic_counts(
        spark, str(src), output_dir=out).collect()}
    assert second == {k: 2 * v for k, v in batch.items()}
