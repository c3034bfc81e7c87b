"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import ann, bm25, chat, decontaminate, langid, minhash, mixing, negatives, packing, quality, tokens, toxicity, trie
from telespark.llm.common import bounded_sample, held_out, saved, table


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame, label: str, most_rows: int = 8000) -> DataFrame:
    """doc_id, text and label of documents that models may learn from: at most about ``most_rows`` ids of each label, chosen
    by a hash; of several labels of an id the greatest counts.

    The ids are sampled before texts are read, so the side that is broadcast is bounded and no text is shuffled.
    """
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(label).alias("label")).where(F.col("label").isNotNull() & ~held_out("doc_id"))
    few = bounded_sample(marks, F.col("label"), most_rows, "doc_id")
    return docs.where(~held_out("doc_id")).select("doc_id", "text").join(F.broadcast(few), "doc_id")


def mixable(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """size, tie and quality of rows (doc_id, source, text) in place of their text, which goes through no shuffle: twice the
    usual weight for documents labelled good, half of it for those labelled bad."""
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_mark_id")).agg(F.max("quality").alias("_mark"))
    weight = F.when(F.col("_mark") == 1, 2.0).when(F.col("_mark") == 0, 0.5).otherwise(1.0)
    sized = docs.select("doc_id", "source", mixing.words("text").alias("size"), F.xxhash64("text").alias("tie"))
    return sized.join(marks, F.col("doc_id") == F.col("_mark_id"), "left").withColumn("quality", weight).drop("_mark_id", "_mark")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; documents with a label of good quality weigh twice, bad ones half.

    Each row is a document, repeated ones too; null texts have no words, and a null source is one of its own.  An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(mixable(spark, sf_dir, docs)).select("doc_id", "size", "source_size", "target", "taken")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each query, by an index of all rows.

    Rows without a vec_id take no part.  Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those of another length than most (of equally frequent ones, the shortest), which have
    no inner product with the others.  Of several vectors of a query's vec_id the least counts.  Vectors of floats or
    doubles are scored as they are; other numbers as doubles.  An empty table gives no rows.
    """
    raw = table(spark, sf_dir, "embeddings")
    kind = dict(raw.dtypes)["embedding"]
    given = raw.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("vector")).where(F.col("id").isNotNull())
    sizes = given.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = given.where(ann.usable("vector", sizes[0]["dim"] if sizes else 0))
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(F.col("id") % 20 == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return ann.search(rows, queries)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document.

    Null and empty texts have the score of no words at all; equal texts have equal scores.  Without labels to learn from
    every score is 0.5; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(labelled(spark, sf_dir, docs, "quality", 5000), "label", most_rows=5000)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as the written files have them.

    Null and empty texts have the end id alone.  Documents without an id come first; rows of one id follow each other in
    the order of their texts' hashes.  An empty table gives no rows.
    """
    path = tokens.new_path(spark, "tokens")
    tokens.write_orc(table(spark, sf_dir, "documents"), path, tokenizer=tokens.default_tokenizer(), added_tokens=True)
    parts = saved(tokens.digest(tokens.read_orc(spark, path)), "digest")
    return tokens.with_starts(parts).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in reply order without their quotes.

    Messages of a null conv_id are one conversation; ties of turn and role go by text, null texts are empty messages.  An
    empty table gives no rows.
    """
    return chat.rendered(chat.branched(chat.linked(table(spark, sf_dir, "conversations"))))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document.

    Each row is a document; null and empty texts link with nothing, and documents without an id can link.  An empty table
    gives no rows.
    """
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "group")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed sequences.

    Null and empty texts have the end id alone; repeated rows and rows without an id are documents of their own.  An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, tokenizer=tokens.default_tokenizer(), added_tokens=True, kept=tokens.KEPT))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document.

    Null and empty texts have the score of no words at all; equal texts have equal scores.  Without labels to learn from
    every score is 0.5; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features, weights = toxicity.fit(labelled(spark, sf_dir, docs, "toxic"), "label", corpus=docs)
    scored = toxicity.score(docs, features, weights)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document.

    Null texts and texts without a letter are ``und`` with score 0, and so are all where no row has a language to learn
    from.  Equal texts get equal results; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each text of ``benchmark``.

    Rows of one item_id are one query, those without one none.  Each row of ``documents`` is a document, repeated ones
    too; null texts are empty, and documents without an id count in the statistics only.  Ties go to the smaller doc_id.
    Empty tables give no rows.
    """
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")
    return bm25.search(table(spark, sf_dir, "documents").select("doc_id", "text"), queries)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each anchor's positives, by the threshold algorithm.

    Rows without a vec_id or label, and vectors that are null or hold null or non-finite components, take no part, nor do
    those of another length than most (of equally frequent ones, the shortest), which have no inner product with the
    others.  Zero vectors take part.  Of several rows of an anchor's vec_id the one of the least label and vector is the
    anchor, and none of them is its positive or negative; other repeated rows are candidates each.  An empty table gives no
    rows.
    """
    raw = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vector")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("label")
    rows = raw.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & negatives.finite("embedding")).select(F.col("vec_id").cast("long").alias("id"), label, whole)
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.where(F.size("vector") == (sizes[0]["dim"] if sizes else -1))
    least = rows.where(F.col("id") % 100 == 0).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least"))
    return negatives.mine(rows, least.select("id", "least.label", "least.vector"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations.

    Rows without a conv_id are left out; turns of one number go by role and text, and repeated rows are turns each.  An
    empty table gives no rows.
    """
    rows, ids = trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations")))
    return trie.trie(rows, ids)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document that lie in a benchmark window of ten words, and the items they come from.

    Each row is a document, repeated ones and those without an id too.  Null texts have no words.  Items without an id mark
    words, but aren't counted or listed; items without words have no windows.  An empty table of documents gives no rows.
    """
    wanted = decontaminate.items(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    idx = decontaminate.index(table(spark, sf_dir, "documents").select("doc_id", "text"), wanted.terms)
    found = decontaminate.phrases(idx.postings, wanted.slots)
    return decontaminate.report(idx, found, wanted.members).drop("item_ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_multi_index": op2_multi_index,
    "op3_quality": op3_quality,
    "op4_tokens": op4_tokens,
    "op5_chat": op5_chat,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_pack": op7_pack,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_bm25": op10_bm25,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_decontaminate": op13_decontaminate,
}
_OP5 = r"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS mid, conv_id, turn, role, text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS position
    FROM conversations
), split AS (
    SELECT mid, conv_id, position, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM rows
), lines AS (
    SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[ \t>]*', '') AS raw,
           trim(regexp_replace(lower(raw), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm,
           level = 0 AND NOT (regexp_matches(line, '(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$')
               AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY mid ORDER BY spot), '^[ \t]*>[ \t>]*'), false)) AS own
    FROM split
), islands AS (
    SELECT *, spot - row_number() OVER (PARTITION BY mid, level ORDER BY spot) AS island FROM lines WHERE norm <> '' AND (level > 0 OR own)
), passages AS (
    SELECT mid, conv_id, position, level, island, string_agg(raw, ' ' ORDER BY spot) AS raw, list(norm) AS norms FROM islands GROUP BY ALL
), units AS (
    SELECT *, trim(regexp_replace(lower(raw), '[^\p{L}\p{N}]+', ' ', 'g')) AS whole,
           list_filter([trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g')) FOR s IN regexp_split_to_array(raw, '[.!?]+')], lambda x: x <> '') AS sentences
    FROM passages
), original AS (
    SELECT conv_id, unit, min(position) AS origin
    FROM (SELECT conv_id, position, unnest(list_concat([whole], norms, sentences)) AS unit FROM units WHERE level = 0) GROUP BY ALL
), asked AS (
    SELECT mid, conv_id, position, level, island, true AS whole, whole AS unit FROM units WHERE level > 0
    UNION ALL SELECT mid, conv_id, position, level, island, false, unnest(sentences) FROM units WHERE level > 0
), found AS (
    SELECT a.mid, a.level, a.island, coalesce(max(o.origin) FILTER (a.whole), CASE WHEN bool_and(a.whole OR o.origin IS NOT NULL) THEN max(o.origin) FILTER (NOT a.whole) END) AS origin
    FROM asked a LEFT JOIN original o ON o.conv_id IS NOT DISTINCT FROM a.conv_id AND o.unit = a.unit AND o.origin < a.position GROUP BY ALL
), quotes AS (
    SELECT mid, max(level) AS depth, count(*) AS n_quoted, count(origin) AS n_linked, max(origin) FILTER (level = 1) AS origin FROM found GROUP BY mid
), own_text AS (
    SELECT mid, string_agg(line, chr(10) ORDER BY spot) AS text FROM lines WHERE own GROUP BY mid
), linked AS (
    SELECT r.mid, r.conv_id, r.role, r.position, coalesce(q.origin, CASE WHEN r.position > 1 THEN r.position - 1 END) AS answers,
           coalesce(q.depth, 0) AS depth, coalesce(q.n_quoted, 0) AS n_quoted, coalesce(q.n_linked, 0) AS n_linked,
           regexp_replace(coalesce(t.text, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text
    FROM rows r LEFT JOIN quotes q USING (mid) LEFT JOIN own_text t USING (mid)
), parents AS (
    SELECT *, answers IS NULL OR row_number() OVER (PARTITION BY conv_id, answers ORDER BY position) > 1 AS begins FROM linked
), branches AS (
    SELECT conv_id, position, position AS branch FROM parents WHERE begins
    UNION ALL SELECT p.conv_id, p.position, b.branch FROM branches b JOIN parents p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.answers = b.position AND NOT p.begins
)
SELECT p.conv_id, b.branch, (p.position - b.branch) // 512 AS block, arg_min(coalesce(p.answers, -1), p.position) AS first_answers, count(*) AS n_messages, max(p.depth)::BIGINT AS depth,
       sum(p.n_quoted)::BIGINT AS n_quoted, sum(p.n_linked)::BIGINT AS n_linked,
       string_agg('<|' || coalesce(p.role, 'unknown') || '|>' || chr(10) || p.text || chr(10) || '<|end|>', chr(10) ORDER BY p.position) AS chat
FROM parents p JOIN branches b ON b.conv_id IS NOT DISTINCT FROM p.conv_id AND b.position = p.position GROUP BY ALL
"""
_OP5 = f"SELECT * EXCLUDE first_answers, nullif(first_answers, -1) AS answers FROM ({_OP5})"

_OP10 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(replace(lower(replace(coalesce(text, ''), 'İ', 'i')), 'ς', 'σ'), '[\p{L}\p{N}]+') AS terms FROM documents
), totals AS (
    SELECT count(*) AS n, avg(len(terms)) AS mean FROM texts
), f AS (
    SELECT rid, term, count(*)::DOUBLE AS f FROM (SELECT rid, unnest(terms) AS term FROM texts) GROUP BY ALL
), df AS (
    SELECT term, count(*) AS df FROM f GROUP BY term
), q AS (
    SELECT query_id, term, count(*) AS times
    FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(replace(lower(replace(text, 'İ', 'i')), 'ς', 'σ'), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
), gains AS (
    SELECT f.term, f.rid, d.doc_id,
           round(1000000 * (ln(1 + (t.n - df.df + 0.5) / (df.df + 0.5)) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * len(d.terms) / t.mean))))::BIGINT AS gain
    FROM f JOIN df USING (term) JOIN texts d USING (rid) CROSS JOIN totals t WHERE d.doc_id IS NOT NULL
), scored AS (
    SELECT query_id, rid, doc_id, sum(times * gain)::BIGINT AS units FROM q JOIN gains USING (term) GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM scored WHERE units > 0
)
SELECT query_id, rank, doc_id, units / 1000000 AS score FROM ranked WHERE rank <= 20
"""

_OP11 = """
WITH ok AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), dims AS (
    SELECT len(v) AS dim FROM ok WHERE len(v) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), rows AS (
    SELECT ok.* FROM ok JOIN dims ON len(v) = dim
), anchors AS (
    SELECT id, min(struct_pack(label := label, v := v)) AS a FROM rows WHERE id % 100 = 0 GROUP BY id
), scored AS (
    SELECT a.id AS anchor_id, r.id, r.label = a.a.label AS same, list_sum(list_transform(a.a.v, lambda x, i: x * r.v[i]))::BIGINT AS score FROM anchors a JOIN rows r ON r.id <> a.id
), positives AS (
    SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM scored WHERE same
), found AS (
    SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""

_OP12 = r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, c - c % 20 AS base,
           xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
               lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT ids.c, 0 AS own, t.pos, t.role, t.text FROM ids JOIN turns t ON t.c = ids.base AND t.pos <= ids.h
    UNION ALL SELECT ids.c, 1, t.pos, t.role, t.text FROM ids JOIN turns t ON t.c = ids.c AND t.pos > ids.h
), paths AS (
    SELECT c, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS seq, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, pos)
    UNION ALL SELECT c, 0, [], 0 FROM ids
), nodes AS (
    SELECT depth, seq, min(c) AS c, count(*) AS n, (count(*) - 1) * max(words) AS saved FROM paths GROUP BY depth, seq
), kin AS (
    SELECT depth - 1 AS depth, seq[:-2] AS seq, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), valued AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN kin k USING (depth, seq)
), below AS (
    SELECT p.c, p.depth, p.seq, sum(CASE WHEN v.c = p.c THEN v.saved ELSE 0 END) OVER w AS saved, sum(CASE WHEN v.c = p.c THEN v.leaf ELSE 0 END) OVER w AS leaves
    FROM paths p JOIN valued v USING (depth, seq) WINDOW w AS (PARTITION BY p.c ORDER BY p.depth DESC)
), totals AS (
    SELECT depth, seq, sum(saved)::BIGINT AS saved, sum(leaves)::BIGINT AS leaves FROM below GROUP BY ALL
), lengths AS (
    SELECT c, max(depth) AS depth FROM paths GROUP BY c
), tips AS (
    SELECT depth, seq, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM paths JOIN lengths USING (c, depth) GROUP BY ALL
)
SELECT v.c AS conv_id, v.depth, u.c AS parent_conv_id, v.n AS n_convs, v.n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM valued v JOIN totals t USING (depth, seq) LEFT JOIN valued u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.seq = v.seq[:-2] LEFT JOIN tips e ON e.depth = v.depth AND e.seq = v.seq
"""

_OP13 = r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), grams AS (
    SELECT row, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM docs, (SELECT DISTINCT n FROM windows))
), met AS (
    SELECT g.row, g.n, g.s, x.item_id FROM grams g JOIN windows x ON x.n = g.n AND x.phrase = g.phrase
), hits AS (
    SELECT row, count(DISTINCT position) AS n_hit FROM (SELECT row, unnest(generate_series(s, s + n - 1)) AS position FROM met) GROUP BY row
), listed AS (
    SELECT row, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT row, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h USING (row) LEFT JOIN listed l USING (row)
"""

ORACLE_SQL: dict[str, str] = {"op5_chat": _OP5, "op10_bm25": _OP10, "op11_hard_negatives": _OP11, "op12_prefix_trie": _OP12, "op13_decontaminate": _OP13}
