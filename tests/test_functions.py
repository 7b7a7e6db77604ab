import hashlib
import hmac
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from factfold.functions import geo, ids, labels, redaction, sealing, text, vectors
from factfold.params import EMAIL_PATTERN, SSN_PATTERN


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


def test_point_ids_are_unsigned(spark):
    for key, value in [("a", "b"), ("k1", "5 bar"), ("ключ", "значение")]:
        want = int.from_bytes(hashlib.md5(f"{key}:{value}".encode()).digest()[:8], "little")
        assert int(one(spark, ids.fact_point_id(F.lit(key), F.lit(value)))) == want


def test_hash_routing(spark):
    for word in ("flood", "fire", "x" * 1000):
        h = int(hashlib.sha256(word.encode()).hexdigest(), 16)
        got = spark.range(1).select(ids.hash_bits(F.lit(word), 0, 2).alias("a"), ids.hash_bits(F.lit(word), 2, 2).alias("b"),
                                    ids.hash_mod(F.lit(word), 4, 11).alias("c")).first()
        assert (got.a, got.b, got.c) == (h % 4, h // 4 % 4, h // 16 % 11)


@pytest.mark.parametrize("a, b, want", [
    ("5 bar", "50 bar", True), ("safe", "not safe", True), ("the valve holds 5 bar", "valve is at 5 bar", False),
    ("clear", "not clear", False), (None, "", False), (None, "not here", True), ("2 of 3", "3 of 2", False)])
def test_contradiction(spark, a, b, want):
    assert one(spark, text.contradicts(F.lit(a).cast("string"), F.lit(b).cast("string"))) is want


def test_redaction_spans(spark):
    got = one(spark, redaction.redact(F.lit("a@b.com and 111-22-3333 end"), (SSN_PATTERN, EMAIL_PATTERN)))
    assert got.text == "[REDACTED] and [REDACTED] end"
    assert [(s.start, s.end, s.original) for s in got.spans] == [(0, 7, "a@b.com"), (12, 23, "111-22-3333")]
    longest = one(spark, redaction.redact(F.lit("abcdef"), ("abc", "abcde", "cdef")))
    assert longest.text == "[REDACTED]f"
    assert one(spark, redaction.redact_text(F.lit("to A@B.org"), (EMAIL_PATTERN,))) == "to [REDACTED]"


def test_sanitize_and_sentences(spark):
    assert one(spark, text.sanitize_fact(F.lit("  a\r\nb\x1b[0m\x00 "))) == "a  b[0m"
    assert one(spark, text.split_sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    got = one(spark, text.parse_citations(F.lit("Holds [2] and  [9]."), F.lit(3)))
    assert (got.text, got.citations, got.supported) == ("Holds and .", [2], False)
    assert one(spark, text.parse_citations(F.lit("Holds [2]."), F.lit(3))).supported
    assert not one(spark, text.parse_citations(F.lit("Holds."), F.lit(3))).supported


def test_hash_embedding(spark):
    got = one(spark, vectors.hash_embed(F.lit("hello"), 40, "s"))
    raw = b"".join(hashlib.sha256(b"s" + b"hello" + struct.pack(">I", i)).digest() for i in range(2))
    want = np.frombuffer(raw, np.uint8, 40) / 255.0 - 0.5
    assert got == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-6)


def test_vector_checks(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "id long, v array<double>")
    good, bad = vectors.split_valid(df, "v")
    assert good.first().v == pytest.approx([0.6, 0.8]) and {r.id for r in bad.collect()} == {2, 3, 4}
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, vectors.stamp_cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == -1.0


def test_geo(spark):
    df = spark.createDataFrame([(1, 40.0, -74.0), (2, 40.001, -74.0), (3, 41.0, -75.0), (4, None, None)], "id long, lat double, lon double")
    got = {r.id: r.distance_m for r in geo.within_radius(df, 40.0, -74.0, 5000).collect()}
    assert set(got) == {1, 2} and got[1] == 0.0 and got[2] == pytest.approx(111.2, abs=0.1)
    assert geo.within_radius(df, 40.0, -74.0, 0).count() == 4


@pytest.mark.parametrize("m, e, want", [(1000, 50, "combined_hazard"), (1000, 49, "methane_high"), (0, 50, "ethylene_high"),
                                        (250, 49, "methane_low"), (0, 5, "ethylene_low"), (249, 4.9, "safe")])
def test_gas(spark, m, e, want):
    c = labels.classify_gas(F.lit(float(m)), F.lit(float(e)))
    assert one(spark, c) == want
    assert one(spark, labels.gas_text(F.lit(float(m)), F.lit(float(e)), c)).split()[0] in ("CRITICAL:", "ALERT:", "WARNING:", "Gas")


def test_small_rules(spark):
    assert [one(spark, labels.backoff_ms(F.lit(n))) for n in (0, 1, 3, 30)] == [0, 1000, 4000, 60000]
    assert one(spark, labels.severity_score(F.lit(0.2))) == 0.4
    assert one(spark, labels.image_label(F.lit(None).cast("string"), F.lit("Flames near a rack"))) == "fire"
    assert one(spark, labels.iso_time(F.lit(1_700_000_000_123_456_789), F.current_timestamp())) == "2023-11-14T22:13:20.123456+00:00"


def test_hmac(spark):
    assert one(spark, sealing.hmac_sha256(F.lit("abc"), "key")) == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()
    assert one(spark, sealing.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'


def test_embedders(spark):
    from factfold.functions.embedding import HashEmbedder, embed

    df = spark.createDataFrame([(1, "hello"), (2, None)], "id int, text string")
    got = {r.id: r for r in embed(df, "text", HashEmbedder(dim=40, salt="s")).collect()}
    assert got[2].vec is None and got[1].model == "hash"
    assert got[1].vec == pytest.approx(one(spark, vectors.hash_embed(F.lit("hello"), 40, "s")), abs=1e-6)
    with pytest.raises(TypeError, match="vision"):
        embed(df, "text", HashEmbedder(modality="vision"))

    class Broken(HashEmbedder):
        def embed_batch(self, payloads):
            return [[0.0] * 64 for _ in payloads]

    with pytest.raises(Exception, match="unusable vector"):
        embed(df, "text", Broken()).collect()


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, labels.iso_time(F.lit(1_700_000_000_000_000_000), F.current_timestamp())) == "2023-11-14T22:13:20.000000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
