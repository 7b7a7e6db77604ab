import itertools
import random

import pytest
from pyspark.sql import functions as F

from factfold.operators import evaluation, explain, fold, state, trust
from factfold.params import FoldParams, TrustParams

SCHEMA = ("corroboration_key string, device_id string, value string, event_type string, seq long, client_sequence long, "
          "device_trust_at_report double, modality string, value_cluster string, resolver_id string, received_at_ns long")


def ev(device, value, seq, kind="OBSERVED", cs=None, trust=0.7, modality="text", cluster=None, resolver=None, at=None,
       key="k"):
    return (key, device, value, kind, seq, cs, trust, modality, cluster, resolver, at)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def verdict(spark, *rows, params=FoldParams(), trust=None):
    return fold.fold_consensus(log(spark, *rows), params, trust).first()


def test_disagreement_is_disputed(spark):
    rows = log(spark, ev("a", "x", 1), ev("b", "y", 2))
    v = fold.fold_consensus(rows).first()
    assert (v.status, v.live_device_count, v.value_count) == ("DISPUTED", 2, 2)
    assert {r.value for r in fold.ranked_values(rows).collect()} == {"x", "y"}


def test_corroboration_beats_a_single_report(spark):
    three = verdict(spark, ev("a", "x", 1), ev("b", "x", 2), ev("c", "x", 3))
    one = verdict(spark, ev("a", "x", 1))
    assert three.status == "CONFIRMED" and one.status == "LWW" and three.confidence > one.confidence == 0.7
    assert three.confidence == pytest.approx(1 - 0.3 ** 3)


def test_hub_order_beats_the_clock_and_retries_change_nothing(spark):
    assert verdict(spark, ev("a", "old", 1), ev("a", "new", 2)).value == "new"
    late = [ev("a", "x", 1, cs=1), ev("a", "x", 2, "RETRACTED", cs=2), ev("a", "x", 99, cs=1)]
    assert verdict(spark, *late).status == "ABSENT"
    assert verdict(spark, *late, ev("a", "x", 100, cs=3)).status == "LWW"


def test_retract_and_observe_again(spark):
    steps = [ev("a", "x", 1), ev("a", "x", 2, "RETRACTED"), ev("a", "x", 3)]
    assert [verdict(spark, *steps[:n]).status for n in (1, 2, 3)] == ["LWW", "ABSENT", "LWW"]


def test_half_life(spark):
    hour = 3_600_000_000_000
    rows = [ev("a", "old", 1, at=0), ev("b", "old", 2, at=0), ev("c", "new", 3, at=10 * hour)]
    assert verdict(spark, *rows).value == "old"
    assert verdict(spark, *rows, params=FoldParams(now_ns=10 * hour, half_life_ns=float(hour))).value == "new"
    never = verdict(spark, ev("a", "x", 1), params=FoldParams(now_ns=10 * hour, half_life_ns=float(hour)))
    assert never.confidence == 0.7


def test_cross_modal_adds_one_vote(spark):
    plain = verdict(spark, ev("a", "x", 1), ev("b", "x", 2))
    mixed = verdict(spark, ev("a", "x", 1), ev("b", "x", 2, modality="vision"))
    assert not plain.cross_modal and mixed.cross_modal and plain.confidence < mixed.confidence <= 1
    assert mixed.confidence == pytest.approx(1 - 0.3 * 0.3 * 0.7)


def test_empty_trust_table_means_default_trust(spark):
    none = spark.createDataFrame([], "device_id string, trust double")
    assert verdict(spark, ev("a", "x", 1, trust=0.1), trust=none).confidence == 0.7


def test_clusters_group_wordings_and_show_the_smallest(spark):
    v = verdict(spark, ev("a", "is wet", 1, cluster="c1"), ev("b", "be wet", 2, cluster="c1"), ev("c", "dry", 3, cluster="c2"))
    assert (v.value, v.winner_devices) == ("be wet", 2)


def test_resolution_overrides_and_later_reports_are_conflicts(spark):
    rows = [ev("a", "x", 1), ev("b", "y", 2), ev("op", "x", 3, "RESOLVED", resolver="chief"), ev("c", "y", 4), ev("d", "x", 5)]
    v = verdict(spark, *rows)
    assert (v.status, v.value, v.confidence, v.resolved_by, v.resolved_seq) == ("RESOLVED", "x", 1.0, "chief", 3)
    assert v.post_resolution_conflicts == 1
    only = verdict(spark, ev("op", "x", 3, "RESOLVED", resolver="chief"))
    assert (only.status, only.live_device_count) == ("RESOLVED", 0)


def test_a_decision_does_not_withdraw_the_vote_of_a_device_of_that_name(spark):
    rows = [ev("a", "x", 1), ev("a", "x", 2, "RESOLVED", resolver="a")]
    assert verdict(spark, *rows).live_device_count == 1
    assert verdict(spark, *rows, params=FoldParams(decisions_compete=True)).live_device_count == 0


def test_order_and_repetition_do_not_matter(spark):
    rows = [ev(f"d{i % 7}", "xyz"[i % 3], i + 1, "RETRACTED" if i % 5 == 0 else "OBSERVED", cs=i // 2,
               trust=0.3 + 0.1 * (i % 5), modality=("text", "vision")[i % 2]) for i in range(30)]
    want = fold.fold_consensus(log(spark, *rows)).first()
    for seed in range(5):
        mixed = rows + rows[:seed * 4]
        random.Random(seed).shuffle(mixed)
        assert fold.fold_consensus(log(spark, *mixed).repartition(seed + 1)).first() == want
    small = rows[:4]
    first = verdict(spark, *small)
    assert all(verdict(spark, *p) == first for p in itertools.islice(itertools.permutations(small), 0, 24, 5))


def test_kept_ballots_give_the_same_verdicts(spark):
    rows = log(spark, *[ev(f"d{i % 4}", "xy"[i % 2], i + 1, key=f"k{i % 3}") for i in range(20)],
               ev("op", "x", 50, "RESOLVED", resolver="o", key="k1"))
    direct = fold.fold_consensus(rows).orderBy("corroboration_key").collect()
    kept = fold.fold_consensus(fold.keep_ballots(rows)).orderBy("corroboration_key").select(
        fold.fold_consensus(rows).columns).collect()
    assert direct == kept


def test_trust_smoothing_and_clamp(spark):
    rows = log(spark, *[ev(d, "x", i + 1, trust=0.9, key=k) for k in ("k1", "k2") for i, d in enumerate("ab")])
    assert {r.trust for r in trust.derive_device_trust(rows).collect()} == {1.0}
    smooth = trust.derive_device_trust(rows, TrustParams(1.0, 1.0)).collect()
    assert {r.trust for r in smooth} == {0.75}
    assert {r.trust for r in trust.derive_device_trust(rows, TrustParams(1.0, 1.0, 0.0, 0.5)).collect()} == {0.5}


def test_disputed_keys_teach_nothing(spark):
    assert trust.derive_device_trust(log(spark, ev("a", "x", 1), ev("b", "y", 2))).count() == 0
    decided = log(spark, ev("a", "x", 1), ev("b", "y", 2), ev("op", "y", 3, "RESOLVED", resolver="o"))
    assert {r.device_id: r.trust for r in trust.derive_device_trust(decided).collect()} == {"a": 0.0, "b": 1.0}


def test_point_trust(spark):
    df = spark.createDataFrame([(1, "OBSERVED", 1), (1, "OBSERVED", 2), (2, "OBSERVED", 1), (2, "RETRACTED", 2)],
                               "point_id long, event_type string, seq long")
    got = {r.point_id: r.trust for r in trust.fold_point_trust(df, 0.0).collect()}
    assert got == {1: pytest.approx(0.880797, abs=1e-6), 2: 0.0}


def test_dispute_set_scores(spark):
    shapes = {"minority_late_wrong": 18, "contested": 6, "late_correction": 4, "corroboration_foiled": 4}
    rows = [(f"{s}{i}", s, f"door{i}", f"door {i} is open", f"door {i} is shut") for s, n in shapes.items() for i in range(n)]
    facts = spark.createDataFrame(rows, "scenario_id string, shape string, corroboration_key string, correct_value string, decoy_value string")
    got = {r["shape"]: r for r in evaluation.score_resolver_vs_lww(facts).collect()}
    assert (got["all"].scenarios, got["all"].resolver_correct, got["all"].lww_correct, got["all"].resolver_abstained) == (32, 18, 4, 10)
    assert (got["all"].resolver_accuracy, got["all"].lww_accuracy) == (0.5625, 0.125)
    by = {s: (got[s].resolver_correct, got[s].lww_correct, got[s].resolver_abstained) for s in shapes}
    assert by == {"minority_late_wrong": (18, 0, 0), "contested": (0, 0, 6), "late_correction": (0, 4, 4),
                  "corroboration_foiled": (0, 0, 0)}
    with pytest.raises(Exception, match="unknown scenario shape"):
        evaluation.expand_scenarios(facts.withColumn("shape", F.lit("odd"))).collect()
    with pytest.raises(Exception, match="no scorable"):
        evaluation.score_resolver_vs_lww(facts.limit(0)).collect()


def test_explanations_quote_the_numbers(spark):
    rows = fold.keep_ballots(log(spark, ev("a", "x", 1), ev("b", "y", 2, trust=0.4)))
    got = explain.explain(fold.fold_consensus(rows), fold.modal_votes(rows)).first()
    assert got.reason.startswith("2 devices report 2 values; 'x' leads with support 0.7 of 1.1")
    phrases = {r.phrase for r in explain.competing_values(fold.ranked_values(rows)).collect()}
    assert phrases == {"'x' (support 0.7)", "'y' (support 0.4)"}


def test_cloud_state_uses_derived_trust(spark):
    rows = [ev(d, "x", i + 1, trust=0.9, key="settled") for i, d in enumerate("ab")]
    rows += [ev("c", "y", 3, trust=0.2, key="settled"), ev("a", "u", 4, key="open"), ev("c", "v", 5, key="open"),
             ev("z", "gone", 6, "RETRACTED", key="dead"), ev("e", "solo", 7, key="lone")]
    got = {r.corroboration_key: r for r in state.cloud_state(log(spark, *rows)).collect()}
    assert set(got) == {"settled", "open", "lone"}
    assert got["lone"].state == "UNCORROBORATED" and got["open"].value == "u" and got["settled"].corroborating_devices == 2


def test_the_winning_cluster_is_that_of_the_smallest_device_with_the_true_value(spark):
    """A confirmed value stands in two clusters; the smallest device holds it without a cluster id."""
    rows = log(spark, ev("a", "x", 1), ev("b", "x", 2, cluster="c"), ev("c", "y", 3, cluster="c"), ev("d", "y", 4, cluster="c"),
               ev("e", "y", 5, cluster="c"))
    v = fold.fold_consensus(rows).first()
    assert (v.status, v.value) == ("CONFIRMED", "x")
    got = {r.device_id: r.trust for r in trust.derive_device_trust(rows).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0, "e": 0.0}
