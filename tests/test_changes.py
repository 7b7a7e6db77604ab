"""The stateful change feed against the fold of the whole log."""

import random
import shutil

from pyspark.sql import functions as F

from factfold.operators.fold import KEY, fold_consensus
from factfold.params import FoldParams
from factfold.session import scratch_folder
from factfold.sources.tables import Store
from factfold.streaming import changes, feeds

LOG = (f"{KEY} string, device_id string, event_type string, value string, value_cluster string, modality string, "
       "device_trust_at_report double, client_sequence bigint, seq bigint, received_at_ns bigint")


def make_log(count, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, count + 1):
        kind = rng.choices(["OBSERVED", "RETRACTED", "RESOLVED"], [80, 15, 2])[0]
        value = rng.choice(["open", "shut", "ajar", None])
        rows.append((f"k{rng.randrange(12)}", "op" if kind == "RESOLVED" else f"d{rng.randrange(6)}", kind, value,
                     rng.choice([None, "", "c1", value]), rng.choice(["text", "vision", None]), rng.choice([None, 0.2, 0.55, 0.9, 1.0, 1.3]),
                     rng.choice([None, seq, seq - 20]), seq, seq))
    return rows


def final(df):
    return {r[0]: (r[1], r[2], round(r[3], 6)) for r in df.select(KEY, "status", "value", "confidence").collect()}


def test_state_equals_the_fold_without_reading_the_log(spark, tmp_path):
    rows = make_log(400, 3)
    rows += rows[:40]  # events that arrive again
    random.Random(5).shuffle(rows)
    log = spark.createDataFrame(rows, LOG)
    store, source, checkpoint = Store(spark, str(tmp_path / "hub")), tmp_path / "in", scratch_folder(spark, "cp")
    source.mkdir()
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    for turn, part in enumerate((rows[:150], rows[150:300], rows[300:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(str(source / f"turn{turn}"))
        feeds.run_changes(stream(), store, checkpoint).awaitTermination()
        shutil.rmtree(source / f"turn{turn}")  # what was read is gone before the next batch
        (source / f"turn{turn}").mkdir()
    found = store.verdict_changes()
    assert final(changes.current_verdicts(found)) == final(fold_consensus(log))
    # Versions count without a gap, and neighbours differ.
    for key, versions in found.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("version", "status", "value", "confidence")))).collect():
        assert [v.version for v in versions] == list(range(1, len(versions) + 1))
        assert all(a[1:] != b[1:] for a, b in zip(versions, versions[1:], strict=False))
    assert found.groupBy("batch_id").count().count() == 3


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    """The write of a batch is repeated as after a lost commit."""
    store = Store(spark, str(tmp_path / "hub"))
    log = spark.createDataFrame(make_log(60, 1), LOG)
    for _ in range(2):  # a new checkpoint starts from batch 0 again
        source = scratch_folder(spark, "replay")
        log.coalesce(1).write.parquet(source)
        feeds.run_changes(spark.readStream.schema(log.schema).parquet(source), store, scratch_folder(spark, "cp")).awaitTermination()
    assert store.verdict_changes().count() == changes.current_verdicts(store.verdict_changes()).count()


def test_judge_matches_on_every_mix():
    """No devices, one, ties between values, mixed modality."""
    params = FoldParams()
    assert changes.judge_ballots([], params) == ("ABSENT", None, 0.0, 0)
    assert changes.judge_ballots([("a", False, "x", "x", "text", 0.5)], params)[0] == "ABSENT"
    assert changes.judge_ballots([("a", True, "x", "x", "text", 0.5)], params) == ("LWW", "x", 0.5, 1)
    tie = [("b", True, "x", "x", "text", 0.5), ("a", True, "w", "w", "text", 0.5)]
    assert changes.judge_ballots(tie, params) == ("DISPUTED", "w", 0.25, 2)
    mixed = [("b", True, "x", "x", "text", 0.5), ("a", True, "x", "x", "vision", 0.5)]
    assert changes.judge_ballots(mixed, params) == ("CONFIRMED", "x", 0.825, 2)
