"""The registered text queries opN_<name> and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cascade, chat, decontaminate, katz, lexical_search, licences, packing, prefix_trie, probminhash, quality_cnn, substring_dedup, suffix_array, token_counts
from tidemark.session import table

WORD_TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    parsed = substring_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS gram
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE len(w) >= 50)
), repeats AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_id FROM windows) WHERE doc_id > first_id
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM repeats
), lists AS (
  SELECT r, list(i) AS gone FROM gone GROUP BY r
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM cut LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""


def op2_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return katz.Model(table(spark, folder, "documents"), held).scores()


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut, sizes WHERE len(w) >= n)
), matches AS (
  SELECT r, i, windows.n, item_id FROM windows JOIN phrases USING (phrase)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM matches) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM matches) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM cut LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: Rows whose remainder is this one never teach the classifier.
HELD_OUT = 1


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT, F.lit(False))


def quality_network(spark: SparkSession, folder: str) -> quality_cnn.Network:
    labels = table(spark, folder, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality_cnn.fit(table(spark, folder, "documents"), labels)


def op6_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_cnn.score(table(spark, folder, "documents").select("doc_id", "text"), quality_network(spark, folder))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, folder, "documents"))


#: Conversation -7: both turns say what the template's own markers look like.
PROBE_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    types = dict(rows.dtypes)
    probe = spark.range(1).select(
        F.lit(-7).cast(types["conv_id"]).alias("conv_id"),
        F.explode(F.array(
            F.struct(F.lit(0).cast(types["turn"]).alias("turn"), F.lit("user").alias("role")),
            F.struct(F.lit(1).cast(types["turn"]).alias("turn"), F.lit("assistant").alias("role")),
        )).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(PROBE_TEXT).alias("text"))
    formatted = chat.format_conversations(rows.unionByName(probe))
    read = formatted.select(
        "conv_id", "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS escaped,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE 4 + head + 2 + 8 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op9_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), packing.word_length())


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = cascade.quality_verdicts(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM cut WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(after - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r
), counts AS (
  SELECT doc_id, text, len(l) AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (r)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * (len(string_split(text, '!!')) - 1) > 30 * n_words OR 100 * stutters > 30 * n_words) AS kept
FROM based
"""


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), item AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM cut WHERE len(w) > 0
), counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM cut) SEMI JOIN item USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM item JOIN counts USING (term) JOIN weights USING (term), corpus GROUP BY item_id, r, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 10
"""


#: Conversations share the opening turns of one in twenty.
GRAFT_EVERY, GRAFT_LONGEST = 20, 3


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    length = (F.crc32(F.col("conv_id").cast("string")) % (GRAFT_LONGEST + 1)).cast("int")
    rebuilt = prefix_trie.grafted(prefix_trie.turn_sequences(table(spark, folder, "conversations")), GRAFT_EVERY, length, GRAFT_LONGEST)
    return prefix_trie.trie_nodes(rebuilt)


OP12_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, name, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, name, k + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(name, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(name))
), heads AS (
  SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE k = 8 * length(name)
), named AS (
  SELECT conv_id, turn, text, md5(length(role) || ':' || role || text) AS name
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), turns AS (
  SELECT conv_id, name, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS d
  FROM named
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, d, name, words FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND d <= h
  UNION ALL
  SELECT h.conv_id, 1, d, name, words FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND d > h
), prefixes AS (
  SELECT conv_id, words, string_agg(name, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, d)
  UNION ALL
  SELECT conv_id, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = ids.conv_id) FROM ids
), nodes AS (
  SELECT prefix, length(prefix) // 32 AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = length(prefix) // 32), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix
), children AS (
  SELECT left(prefix, length(prefix) - 32) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), sums AS (
  SELECT left(prefix, 32 * d) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (prefix) LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = left(c.prefix, length(c.prefix) - 32)
"""

def op13_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_array.remove_repeated_bytes(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS gram
  FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM cut WHERE length(h) >= 100)
), repeats AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_id FROM windows) WHERE doc_id > first_id
), edges AS (
  SELECT r, i, i - lag(i) OVER w AS step, lead(i) OVER w AS after FROM repeats WINDOW w AS (PARTITION BY r ORDER BY i)
), starts AS (
  SELECT r, i AS a, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM edges WHERE step IS NULL OR step > 50
), ends AS (
  SELECT r, i + 50 AS b, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM edges WHERE after IS NULL OR after - i > 50
), spans AS (
  SELECT r, a, b, k, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM starts JOIN ends USING (r, k)
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM spans JOIN cut USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)
"""


BUILDERS = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_katz_scores": op2_katz_scores,
    "op3_decontamination": op3_decontamination,
    "op4_licence_scan": op4_licence_scan,
    "op5_token_counts": op5_token_counts,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_probminhash": op7_probminhash,
    "op8_chat_format": op8_chat_format,
    "op9_best_fit": op9_best_fit,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_array": op13_suffix_array,
}
SQL = {
    "op1_substring_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_chat_format": OP8_SQL, "op10_quality_rules": OP10_SQL,
    "op11_ranked_search": OP11_SQL, "op12_prefix_trie": OP12_SQL,
    "op13_suffix_array": OP13_SQL,
}
