from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telespark.llm import packing, queries, tokens
from tests.llm.data import corpus, frame

PATH = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


PARTS = ["\r", "\x1c", "\x85", "(w)", "w.,;", "w'", "_w", "Ԁ", "Ա", "\u0378", "𞤀", "a", "Word", "é", "1", "²", "'s", "'", "*", " ", "  ", "\n", "\t", ".", ",", "the", "😀", "<|endoftext|>", "́", "_", "中", "\r\n", "don't", " ", "　"]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_encoding_equals_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    t = Tokenizer.from_file(PATH) if not hasattr(test_encoding_equals_the_tokenizer, "t") else test_encoding_equals_the_tokenizer.t
    t.encode_special_tokens = True
    test_encoding_equals_the_tokenizer.t = t
    assert unpacked(tokens.encode([text], PATH)[0]) == t.encode(text, add_special_tokens=False).ids


DEFAULT = Tokenizer.from_file(PATH)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "<|endoftext|>", "<|endoftext", "|>"]), max_size=14).map("".join))
def test_added_tokens_equal_the_default_tokenizer(text):
    assert unpacked(tokens.encode([text], PATH, added_tokens=True)[0]) == DEFAULT.encode(text, add_special_tokens=False).ids


def changed(tmp_path, **parts):
    """The vocabulary with some parts of its file changed."""
    told = json.loads(open(PATH).read()) | parts
    (tmp_path / "t.json").write_text(json.dumps(told))
    return str(tmp_path / "t.json")


@pytest.mark.parametrize("parts", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}])
def test_other_vocabularies_are_left_whole(tmp_path, parts):
    path = changed(tmp_path, **parts)
    t = Tokenizer.from_file(path)
    texts = ["One Two  three,\nfour's <|endoftext|> five", " a", "", None, "the the"]
    assert [unpacked(x) for x in tokens.encode(texts, path, added_tokens=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_what_is_kept_is_bounded_and_right():
    e = tokens._Encoder(PATH, True, 5)
    texts = [f"w{chr(97 + k % 26)}x{k} wood{chr(97 + k % 7)}, " + "long" * (k % 14) for k in range(200)]
    assert [unpacked(x) for x in e.encode(texts)] == [DEFAULT.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(e.kept) <= 5 and len(e.kept.old) <= 5 and all(len(k) <= 40 for k in e.kept)


def test_ids_beyond_16_bits_are_an_error(tmp_path):
    extra = [{"id": 70_000, "content": "<far>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    path = changed(tmp_path, added_tokens=json.loads(open(PATH).read())["added_tokens"] + extra)
    if Tokenizer.from_file(path).token_to_id("<far>") > 0xFFFF:
        with pytest.raises(ValueError, match="more than 16 bits"):
            tokens.check_ids(path, 16)
    with pytest.raises(ValueError, match="more than 15 bits"):
        tokens.check_ids(PATH, 15)
    tokens.check_ids(PATH, 16)


def test_queries_take_added_tokens(spark, tmp_path):
    text = "one <|endoftext|>two  <|endoftext|><|endoftext|>\nthree"
    want = DEFAULT.encode(text, add_special_tokens=False).ids
    assert want.count(50256) == 3
    frame(spark).limit(1).selectExpr("doc_id", f"'{text}' as text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.op4_tokens(spark, str(tmp_path)).first()
    assert (row["n_tokens"], row["ids_crc32"]) == (len(want) + 1, crc([*want, 0]))
    piece = queries.op7_pack(spark, str(tmp_path)).first()
    assert (piece["length"], piece["ids_crc32"]) == (len(want) + 1, crc([*want, 1]))


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_table_round_trip(spark, tmp_path, plain):
    docs, path = frame(spark), str(tmp_path / "t")
    tokens.write_orc(docs, path, tokenizer=PATH, partitions=3)
    table = tokens.read_orc(spark, path)
    want = sorted(((r[0], tuple(plain(r[1]) + [0])) for r in corpus()), key=str)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in table.collect()), key=str) == want
    got = tokens.with_starts(tokens.digest(table)).orderBy("start").collect()
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), crc(list(x))) for _, x in want)
    assert table.where("doc_id = 7").select("ids").first()[0] == [*plain("one"), 0]


def test_files_follow_each_other_by_number(spark, tmp_path):
    """Part files have five digits at least, so text order is wrong from the 100,000th on."""
    path = tmp_path / "t"
    tokens.write_orc(frame(spark, [(k, f"text {k} " * (k % 3), None, None, 0, None, None, None) for k in range(60)]), str(path), tokenizer=PATH, partitions=3)
    for f in [*path.glob(".*.crc"), *path.glob("_SUCCESS")]:
        f.unlink()
    names = {"00000": "10000", "00001": "10001", "00002": "100000"}
    for f in list(path.glob("part-*")):
        number = f.name[5:10]
        f.rename(path / f.name.replace(number, names[number], 1))
    assert [f.name[5:11] for f in sorted(path.glob("part-*"))] == ["10000-", "100000", "10001-"]
    got = tokens.with_starts(tokens.digest(tokens.read_orc(spark, str(path)))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(60))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(60)]


def test_orc_holds_indexes_that_prune(spark, tmp_path):
    """A file of several row groups has row indexes and Bloom filters, by which a lookup of an id reads fewer rows."""
    docs = spark.range(40_000).selectExpr("id * 2 as doc_id", "concat('word ', id) as text")
    path = tmp_path / "t"
    tokens.write_orc(docs, str(path), tokenizer=PATH, partitions=1)
    (file,) = (f for f in path.glob("*.orc") if f.stat().st_size > 1000)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    stripes = reader.getStripes()
    kinds = [str(s.getKind()) for s in reader.rows().readStripeFooter(stripes.get(0)).getStreamsList() if s.getColumn() == 1]
    assert "ROW_INDEX" in kinds and any("BLOOM_FILTER" in k for k in kinds)
    assert reader.getRowIndexStride() == 1000

    def rows_read(doc_id: int) -> int:
        found = tokens.read_orc(spark, str(path)).where(F.col("doc_id") == doc_id)
        plan = found._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert rows_read(30_000) == 1000, "the row group that holds the id"
    assert sum(rows_read(k) == 0 for k in range(30_001, 30_041, 2)) >= 17, "ids within its range that aren't there: the Bloom filter"


def test_empty_tables(spark, tmp_path):
    tokens.write_orc(frame(spark, []), str(tmp_path / "t"), tokenizer=PATH)
    assert tokens.with_starts(tokens.digest(tokens.read_orc(spark, str(tmp_path / "t")))).count() == 0
    assert packing.digest(packing.pack(frame(spark, []), tokenizer=PATH)).count() == 0


@pytest.mark.parametrize("group_rows", [3, 2048])
def test_packing_keeps_every_id_once(spark, plain, group_rows):
    capacity = 64
    rows = packing.pack(frame(spark), tokenizer=PATH, capacity=capacity, group_rows=group_rows).collect()
    sequences = defaultdict(list)
    documents = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u2").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for r in corpus():
        ids = plain(r[1]) + [1]
        want[r[0], len(ids)] += ids
    assert {k: sorted(x for _, ids in v for x in ids) for k, v in documents.items()} == {k: sorted(v) for k, v in want.items()}
    once = documents[10, len(plain(corpus()[10][1])) + 1]
    assert [x for _, ids in sorted(once) for x in ids] == plain(corpus()[10][1]) + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_assignment(lengths):
    lengths = np.array(lengths)
    placed = packing.assign(lengths, 50, 1.0, 0.02)
    got = defaultdict(int)
    fill = defaultdict(int)
    for piece, _, n, to, _ in placed:
        got[piece] += n
        fill[to] += n
    assert [got[k] for k in range(len(lengths))] == lengths.tolist()
    assert max(fill.values()) <= 50 and len(fill) <= -(-int(lengths.sum()) // 50)


def test_costs_are_balanced():
    lengths = np.array([random.Random(k).randrange(50, 1500) for k in range(400)])
    cost = defaultdict(float)
    for _, _, n, to, _ in packing.assign(lengths, 2048, 1.0, 1 / 2048):
        cost[to] += n + n * n / 2048
    c = np.array(list(cost.values()))
    assert c.std() / c.mean() < 0.15


def test_checksums_of_pieces_are_those_of_32_bit_ids(spark):
    ids = [[0, 1, 65535], [50256] * 2048, [7]]
    rows = [(k, 0, len(x), len(x), k, 0, bytearray(np.array(x, dtype="<u2").tobytes())) for k, x in enumerate(ids)]
    found = packing.digest(spark.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))
    assert {r["doc_id"]: r["ids_crc32"] for r in found.collect()} == {k: zlib.crc32(np.array(x, dtype="<u4").tobytes()) for k, x in enumerate(ids)}
    assert "regexp_replace" not in found._jdf.queryExecution().toString(), "pieces aren't spelled out as text"


def test_packing_and_checksums_are_never_one_task(spark):
    """Such a task holds two Python workers at once, and an executor then keeps twice as many workers as it has cores."""
    plan = packing.digest(packing.pack(frame(spark), tokenizer=PATH))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
