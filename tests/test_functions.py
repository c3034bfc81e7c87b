from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telespark.functions import hashing, labels, logs, spans

TEMPLATES = [
    ('Order 8812 refused for 172.16.9.4:8080 reason "no stock" ref=9b2c4d6e8f0a1b3c', "Order <NUM> refused for <IP> reason <STR> ref=<HEX>", "cc7ad202"),
    ('PUT /carts/77/items/3 took 1250us (trace 1b4e28ba-2fa1-11d2-883f-0016d3cca427)', "PUT /carts/<NUM>/items/<NUM> took <NUM>us (trace <HEX>)", "264b4266"),
    ('worker 12 gave up after 3 tries', "worker <NUM> gave up after <NUM> tries", "49c5aa8d"),
    ('0xdeadbeef 0x12345678 deadbee 12345678 a1b2c3d4 0xab12cd', "<HEX> <NUM>x<NUM> deadbee <NUM> <HEX> <NUM>xab<NUM>cd", "2e0cbb10"),
]


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("body", "template", "hexed"), TEMPLATES)
def test_fingerprint(spark, body, template, hexed):
    assert one(spark, logs.fingerprint(F.col("b")), b=body) == template
    assert one(spark, hashing.hash_hex(F.col("b")), b=template) == hexed


@settings(max_examples=15, deadline=None)
@given(st.one_of(st.text(st.characters(min_codepoint=32, exclude_categories=["Cs"]), max_size=30), st.integers(100, 600).map(lambda n: "a😀é"[: n % 4] * n)))
def test_string_hash(spark, text):
    want, units = 0, text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        want = (want * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(hashing.string_hash(F.col("t"))).first()[0] == want


def test_labels(spark):
    assert one(spark, labels.safe_label(F.col("t")), t="a\r\nb") == "a  b"
    assert one(spark, labels.safe_label(F.col("t")), t="") == "unknown"
    assert len(one(spark, labels.safe_label(F.col("t")), t="x" * 300)) == 120
    m = F.create_map(F.lit("k"), F.lit(""))
    assert one(spark, labels.attr(m, "k")) == one(spark, labels.attr(m, "z")) == "unknown"
    assert one(spark, labels.insert_attr(m, "collector", "l2")) == {"k": "", "collector": "l2"}
    assert one(spark, labels.scrub_attrs(F.create_map(F.lit("cookie"), F.lit("1"), F.lit("a"), F.lit("2")))) == {"a": "2"}


def test_spans(spark):
    df = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 3, 4, 5, 6)], "k int")
    assert [r[0] for r in df.select(spans.span_kind(F.col("k"))).collect()] == ["unspecified", "unspecified", "internal", "server", "client", "producer", "consumer", "unspecified"]
    assert [r[0] for r in df.where("k between 0 and 2").select(spans.status_code(F.col("k"))).collect()] == ["unset", "ok", "error"]
    assert one(spark, spans.duration_ns(F.lit(5), F.lit(3))) == 0
    assert one(spark, spans.duration_us(F.lit(1500))) == 2
    assert one(spark, spans.trace_hex(F.lit(bytes.fromhex("ABCD")))) == "abcd"
    assert one(spark, spans.trace_hex(F.lit(b""))) == "unknown"
    assert one(spark, logs.severity_label(F.lit(""), F.lit(9))) == "9"
    assert one(spark, logs.severity_label(F.lit(""), F.lit(0))) == "unknown"


def test_labels_of_a_key_are_shown_together(spark):
    df = spark.createDataFrame([("a", "b|c", None)], "x string, y string, z string")
    assert df.select(labels.shown(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "a|b|c"
