"""One query for each operator, over whole tables, with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


from factloom.llm import decontaminate as decontamination  # noqa: E402


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_windows(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))
    names = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "found.n_words", decontamination.n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"),
    )


from factloom.llm import suffix_dedup  # noqa: E402


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


from factloom.llm import ngram_join  # noqa: E402


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    joined = ngram_join.join(table(spark, folder, "documents", "doc_id", "text"), ngram_join.Rule(words=4, num=85, den=100))
    return joined.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


from factloom.llm import chat_format, mixing, token_blocks  # noqa: E402


@query("op10_mixing_to_target_weights", """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level
  FROM weighed WINDOW earlier AS (ORDER BY source_size / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(CASE WHEN source_size > 0 THEN target / source_size END, 0) AS rate,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan(table(spark, folder, "documents", "doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_chat_formatting")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    done = chat_format.conversations(rows.unionByName(planted))
    return done.select("conv_id", chat_format.read_back("formatted", "loss_spans").alias("r")).select("conv_id", "r.*")


@query("op1_token_id_output")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = token_blocks.write(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read(spark, path)


from factloom.llm import html_text, language  # noqa: E402
from factloom.llm.common import unsigned_crc32  # noqa: E402


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text", "lang")
    held = F.coalesce(unsigned_crc32(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = language.learn(documents.where(~held))
    guessed = language.predict(documents.select("doc_id", "text"), model)
    return guessed.select("doc_id", held.alias("held_out"), F.col("guess.lang").alias("lang_pred"), "guess.score", "guess.rejected")


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    read = html_text.extract(table(spark, folder, "pages", "page_id", "url", "html"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


from factloom.llm import fingerprints  # noqa: E402


@query("op3_document_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, folder, "documents", "doc_id", "text"))


from factloom.llm import lm_scoring  # noqa: E402


@query("op7_lm_scoring")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


# CRC-32 in SQL: a table of 256 values, folded over the bytes of a text.
CRC_TABLE = """
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i))"""


def sql_crc32(text: str) -> str:
    """CRC-32 of a text that is not empty; the query needs ``crc`` in its FROM clause."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


from factloom.llm import importance  # noqa: E402


@query("op12_importance_resampling", rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
dealt AS (SELECT word, {sql_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t
  FROM (SELECT side, word, count(*) AS n FROM words GROUP BY side, word) JOIN dealt USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (
  SELECT row, count(*)::BIGINT AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN dealt USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, row, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 0),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, floor(10 * count(*) OVER () / 100) AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranks USING (row)
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return importance.rank(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "text"))


from factloom.llm import prefix_trie  # noqa: E402


@query("op13_conversation_prefix_trie", f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS position
  FROM conversations),
convs AS (SELECT conv, conv - conv % 5 AS base, {sql_crc32("conv::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv FROM turns WHERE conv IS NOT NULL), crc),
kept AS (
  SELECT c.conv, t.role, t.text, 0 AS part, t.position FROM convs c JOIN turns t ON t.conv = c.base WHERE t.position < c.h
  UNION ALL SELECT c.conv, t.role, t.text, 1, t.position FROM convs c JOIN turns t ON t.conv = c.conv WHERE t.position >= c.h),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY part, position) AS depth FROM kept
  UNION ALL SELECT conv, '', '', -1, 0, 0 FROM convs),
paths AS (
  SELECT conv, depth, text, CASE WHEN depth = 0 THEN '' ELSE string_agg(CASE WHEN depth > 0 THEN sha256(length(role) || ':' || role || text) END, '') OVER w END AS prefix
  FROM steps WINDOW w AS (PARTITION BY conv ORDER BY depth)),
keyed AS (SELECT conv, depth, text, sha256(prefix) AS node, lag(sha256(prefix)) OVER (PARTITION BY conv ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv) AS top FROM paths),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv) AS rep, count(*) AS n, (count(*) - 1) * octet_length(encode(any_value(text))) AS saved,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (depth = top), '')) AS ends
  FROM keyed GROUP BY depth, node),
kids AS (SELECT parent, count(*) AS n_kids FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n_kids, 0) AS n_kids FROM nodes LEFT JOIN kids ON kids.parent = node),
sums AS (
  SELECT k.node, sum(CASE WHEN c.n_kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(c.saved) AS saved
  FROM counted c JOIN keyed k ON k.conv = c.rep AND k.depth <= c.depth GROUP BY k.node)
SELECT c.rep AS conv_id, c.depth::BIGINT AS depth, p.rep AS parent_conv_id, c.n::BIGINT AS n_convs, c.n_kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  sums.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN sums USING (node) LEFT JOIN nodes p ON p.node = c.parent
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


from factloom.llm import superkmer_dedup  # noqa: E402


@query("op11_superkmer_dedup", r"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (SELECT row, doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS content FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13)),
firsts AS (SELECT content, min(doc_id) AS first_doc FROM windows GROUP BY content),
covered AS (
  SELECT DISTINCT row, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (content) WHERE doc_id > first_doc),
placed AS (SELECT row, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM split),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM placed ANTI JOIN covered USING (row, place) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (row)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    cut = superkmer_dedup.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
