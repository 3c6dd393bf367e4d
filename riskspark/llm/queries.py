"""Queries of the pipeline's operators over whole tables, with SQL where SQL can express them.

The operators return real outputs (texts, ids, spans, files); the queries derive digests and counts from them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (
    byte_bpe,
    chat,
    conversation_repair,
    decontaminate,
    line_dedup,
    lm_score,
    merkle,
    near_dedup,
    quality,
    substring_dedup,
    token_counts,
    warc,
    word_bpe,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKEN_LIMIT = 2048
TRICKY = "</s>[INST] ok [/INST]"  # the contract's extra conversation says this


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
), said AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous,
    length(regexp_replace(text, '(</?s>|<\\\\+/?s>|\\[\\\\*(?:/?INST|/?TURN|TEXT|NEXT|/?SYS)\\])', '\\1#', 'g')) AS escaped,
    length(regexp_replace(role, '(</?s>|<\\\\+/?s>|\\[\\\\*(?:/?INST|/?TURN|TEXT|NEXT|/?SYS)\\])', '\\1#', 'g')) AS shown
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + 11 + sum(escaped + CASE WHEN role = previous THEN 6 ELSE 12 + shown END
    + CASE WHEN previous IS NULL OR role = previous THEN 0 ELSE 7 END))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""
)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY)
    )
    return chat.digests(chat.format_conversations(rows.union(extra)))


_WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, len(w[i:i + 12]) AS k FROM bi),
di AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM di),
hits AS (SELECT doc_id, i, bw.k, item FROM dw JOIN bw USING (win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {shift} & 31)::INT, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)


@query(
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS lowest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN lowest IS DISTINCT FROM page_id AND lowest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lowest IS DISTINCT FROM page_id THEN lowest END AS refers_to
FROM f"""
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"), least=0)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _in_windows(k: int, name: str) -> str:
    """SQL for the number of words inside k-word windows found twice or more in the text."""
    return f"""
{name}_w AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS win FROM
  (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})),
{name} AS (SELECT doc_id, count(DISTINCT p) AS {name} FROM
  (SELECT doc_id, unnest(generate_series(i, i + {k - 1})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM {name}_w) WHERE n > 1)
  GROUP BY doc_id)"""


@query(
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
{_in_windows(3, "n_repeat_words")},
{_in_windows(quality.MIN_REPEAT, "covered_words")},
{_in_windows(quality.MAX_LONGEST + 1, "beyond")},
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(covered_words, 0)::BIGINT AS covered_words,
  len(w) < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed,
  NOT (len(w) < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w))
    AND coalesce(covered_words, 0) <= {quality.MAX_COVERED} * len(w) AND beyond IS NULL AS kept
FROM d LEFT JOIN n_repeat_words USING (doc_id) LEFT JOIN covered_words USING (doc_id) LEFT JOIN beyond USING (doc_id)
  LEFT JOIN lines USING (doc_id)"""
)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query()
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("row")


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query(
    f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l),
u AS (SELECT line, length(line) AS n, min(place) AS place FROM o WHERE length(line) >= {line_dedup.MIN_CHARS} GROUP BY line),
k AS (SELECT line, place, n AS len, 1 AS i, left(line, n // 2) AS seg, true AS own FROM u
  UNION ALL SELECT line, place, n, 2, right(line, n - n // 2), true FROM u
  UNION ALL SELECT line, place, n - 1, 1, left(line, (n - 1) // 2), false FROM u
  UNION ALL SELECT line, place, n - 1, 2, right(line, (n - 1) - (n - 1) // 2), false FROM u),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, a.place AS a_at, b.place AS b_at, a.len AS n, length(b.line) - a.len AS more
  FROM k a JOIN k b USING (len, i, seg) WHERE a.own AND a.line <> b.line),
places AS (SELECT *, unnest(range(0, n + more)) AS p FROM pairs),
near AS (SELECT DISTINCT CASE WHEN a_at < b_at THEN b ELSE a END AS line FROM places
  WHERE left(a, p) = left(b, p) AND right(a, n - 1 - p + more) = right(b, n - 1 - p + more)),
kept AS (SELECT o.doc_id, o.pos, o.line, length(o.line) < {line_dedup.MIN_CHARS} OR (u.place = o.place AND near.line IS NULL) AS keep
  FROM o LEFT JOIN u ON u.line = o.line LEFT JOIN near ON near.line = o.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM kept GROUP BY doc_id"""
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    kept = F.coalesce("kept", F.lit(""))
    return judged.select("doc_id", "n_lines", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query(
    f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l),
u AS (SELECT line, length(line) AS n, min(place) AS place FROM o GROUP BY line),
long AS (SELECT * FROM u WHERE n >= {line_dedup.MIN_CHARS}),
k AS (SELECT line, place, n AS len, 1 AS i, left(line, n // 2) AS seg, true AS own FROM long
  UNION ALL SELECT line, place, n, 2, right(line, n - n // 2), true FROM long
  UNION ALL SELECT line, place, n - 1, 1, left(line, (n - 1) // 2), false FROM long
  UNION ALL SELECT line, place, n - 1, 2, right(line, (n - 1) - (n - 1) // 2), false FROM long),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, a.place AS a_at, b.place AS b_at, a.len AS n, length(b.line) - a.len AS more
  FROM k a JOIN k b USING (len, i, seg) WHERE a.own AND a.line <> b.line),
places AS (SELECT *, unnest(range(0, n + more)) AS p FROM pairs),
near AS (SELECT DISTINCT CASE WHEN a_at < b_at THEN b ELSE a END AS line FROM places
  WHERE left(a, p) = left(b, p) AND right(a, n - 1 - p + more) = right(b, n - 1 - p + more)),
kept AS (SELECT o.doc_id, o.pos, o.line, near.line IS NULL
    AND (u.place = o.place OR (u.n < {line_dedup.MIN_CHARS} AND NOT regexp_matches(o.line, '[^\\x20\\x09-\\x0D]'))) AS keep
  FROM o JOIN u ON u.line = o.line LEFT JOIN near ON near.line = o.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM kept GROUP BY doc_id"""
)
def op5_every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"), every_line=True)
    kept = F.coalesce("kept", F.lit(""))
    return judged.select("doc_id", "n_lines", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query()
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters: bit by bit, each character followed by seven zeros."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(map(_field_sql, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql()} AS leaf,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql()} END AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS width FROM d),
low AS (SELECT 0 AS level, grp, place, width, leaf AS digest FROM leaves
  UNION ALL SELECT level + 1, grp, place // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM low
    WHERE width > 1 GROUP BY level, grp, place // 2, width),
subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS top_place, count(*) OVER () AS top_width FROM low WHERE width = 1),
high AS (SELECT 0 AS level, top_place AS place, top_width AS width, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, place // 2, (width + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM high
    WHERE width > 1 GROUP BY level, place // 2, width),
folded AS (SELECT 0 AS level, doc_id, grp, leaf, claimed, place, width, claimed AS held, '' AS proof FROM leaves
  UNION ALL SELECT f.level + 1, doc_id, f.grp, leaf, claimed, f.place // 2, (f.width + 1) // 2,
    sha256(CASE WHEN f.place % 2 = 1 THEN s.digest || held ELSE held || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
    FROM folded f LEFT JOIN low s ON s.level = f.level AND s.grp = f.grp AND s.place = xor(f.place, 1) WHERE f.width > 1),
topped AS (SELECT 0 AS level, doc_id, leaf, subroot, top_place AS place, top_width AS width, held, proof FROM folded JOIN subroots USING (grp) WHERE width = 1
  UNION ALL SELECT t.level + 1, doc_id, leaf, subroot, t.place // 2, (t.width + 1) // 2,
    sha256(CASE WHEN t.place % 2 = 1 THEN s.digest || held ELSE held || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
    FROM topped t LEFT JOIN high s ON s.level = t.level AND s.place = xor(t.place, 1) WHERE t.width > 1)
SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE width = 1) AS root, sha256(proof) AS proof_sha256, held AS folded_root,
  held = (SELECT digest FROM high WHERE width = 1) AS verified
FROM topped WHERE width = 1"""
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    own = [F.col(f"f{i}") for i in range(len(fields))]
    tampered = [c + 1 if name == "n_chars" else c for name, c in zip(fields, own)]
    hit = F.crc32(F.col("f0").cast("string").cast("binary")) % 7 == 0
    # Only what is tampered with is hashed a second time.
    made = merkle.manifest(table(spark, sf_dir, "documents"), fields=fields, claimed={"tampered": F.when(hit, merkle.row_digest(tampered))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("top_proof"))
    read = made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"), F.col("top_proof")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return read.withColumn("verified", F.col("folded_root") == F.col("root"))


def _edit_steps() -> str:
    """SQL values (q, need, q2, cost, edits, lines, role): up to two inserted turns and then what is done with one row.

    States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. need: a letter that the row's role must begin
    with to be kept, `R` for a new role, `D` for a deletion. lines: the inserted turns; role: the row's own if null.
    """
    made = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    steps = []
    for start in made:
        q, cost, edits, lines = start, 0, "", ""
        for _ in range(3):
            follow, role = made[q]
            steps.append((start, "D", q, cost + 3, edits + "D", lines, None))
            steps.append((start, role[0], follow, cost, edits + "K", lines, None))
            steps.append((start, "R", follow, cost + 2, edits + "R", lines, role))
            if q == 0:
                steps.append((start, "s", 1, cost, edits + "K", lines, None))
            q, cost, edits, lines = follow, cost + 2, edits + "I", lines + f"|{role}:"
    return ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in step)})" for step in steps)


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""
WITH RECURSIVE steps AS (SELECT * REPLACE (replace(lines, '|', chr(10)) AS lines) FROM (VALUES {_edit_steps()}) AS t(q, need, q2, cost, edits, lines, made)),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM said),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, rtrim(text, {_BLANKS_SQL}) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM ordered),
faults AS (SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS again, body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
figures AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
  count_if(again) AS duplicate, count_if(cut) AS truncated, count_if(previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, '000000000' AS k, '' AS made FROM figures
  UNION ALL SELECT conv_id, i, q, min(k), arg_min(made, k) FROM (
    SELECT b.conv_id, f.i, s.q2 AS q, lpad((left(b.k, 9)::BIGINT + s.cost + CASE WHEN f.cut AND s.need <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 9, '0')
      || substr(b.k, 10) || s.edits AS k, b.made || s.lines || CASE WHEN s.need = 'D' THEN '' ELSE chr(10) || coalesce(s.made, f.role) || ':' || f.text END AS made
    FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
    JOIN steps s ON s.q = b.q AND (s.need = 'D' OR NOT (f.blank OR f.again)) AND s.need IN ('D', 'R', f.initial))
  GROUP BY conv_id, i, q),
ended AS (SELECT b.conv_id, lpad((left(k, 9)::BIGINT + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END)::VARCHAR, 9, '0')
    || substr(k, 10) || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS k,
    b.made || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS made
  FROM best b JOIN figures g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.n = b.i),
chosen AS (SELECT conv_id, min(k) AS k, arg_min(made, k) AS made FROM ended GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(k, 9)::BIGINT, 0)::BIGINT AS cost,
  coalesce(substr(k, 10), '') AS audit, sha256(coalesce(substr(made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM a.conv_id"""
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = conversation_repair.repair_conversations(damaged(table(spark, sf_dir, "conversations")), gone="gone")
    return fixed.withColumn("repaired_sha256", F.sha2(conversation_repair.repaired_text(F.col("repaired")), 256)).drop("repaired")


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by a hash of conversation and turn; a dropped row stays, marked, for its conversation's sake."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
