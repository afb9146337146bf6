"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, importance, jaccard, langid, media, mixing, ngram_lm, packing, pii, repair, simhash, substring, tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_token_counts": lambda spark, d: tokens.token_counts(documents(spark, d)),
    "op2_substring_dedup": lambda spark, d: substring.remove_repeated(documents(spark, d)),
    "op3_language_id": lambda spark, d: langid.identify(documents(spark, d)),
    "op4_media_columns": lambda spark, d: media.text_media(documents(spark, d)),
    "op5_source_mixing": lambda spark, d: mixing.mix(documents(spark, d)),
    "op6_simhash_dedup": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
    "op7_nearest_neighbours": lambda spark, d: ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), queries=F.col("vec_id") % 50 == 0),
    "op8_best_fit_packing": lambda spark, d: packing.pack_documents(documents(spark, d)),
    "op9_lm_scoring": lambda spark, d: ngram_lm.score(documents(spark, d)),
    "op10_pii": lambda spark, d: pii.find_pii(documents(spark, d)),
    "op11_importance_resampling": lambda spark, d: importance.resample(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op12_jaccard_join": lambda spark, d: jaccard.near_duplicates(documents(spark, d)),
    "op13_conversation_repair": lambda spark, d: repair.repair_damaged(spark.read.parquet(f"{d}/conversations.parquet")),
}

#: crc32 by its table of bytes, which SQL makes by the rule of the polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"


def crc32(text: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes, where a column `tab` has the table."""
    raw = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {raw}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


#: Words are cut by a regular expression of the same set; a window is its 13 words joined by spaces.
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, p, array_to_string(words[p : p + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM docs WHERE len(words) >= 13)
), repeated AS (
  SELECT s.doc_id, s.p FROM starts s JOIN (SELECT win, min(doc_id) AS first_id FROM starts GROUP BY win HAVING count(*) > 1) m ON s.win = m.win AND m.first_id < s.doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM repeated
), gone_lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(ps, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN gone_lists g ON d.doc_id = g.doc_id
""",
    "op11_importance_resampling": rf"""
WITH crc AS ({CRC_TABLE}), own AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), counts AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM own) GROUP BY r, w
), wanted AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w
), vocabulary AS (
  SELECT w, {crc32("w")} % 10000 AS b FROM (SELECT w FROM counts UNION SELECT w FROM wanted), crc
), s AS (
  SELECT b, sum(n) AS s FROM counts JOIN vocabulary USING (w) GROUP BY b
), t AS (
  SELECT b, sum(n) AS t FROM wanted JOIN vocabulary USING (w) GROUP BY b
), gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (b)
), weights AS (
  SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN vocabulary USING (w) JOIN gains USING (b) GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM own LEFT JOIN weights USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
""",
    "op12_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[p : p + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS p FROM words WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) AS c(c) WHERE d <> 0 AND (c = 0 OR d = 3)
), placed AS (
  SELECT *, row_number() OVER w AS p, lag(role[1]) OVER w AS before, rtrim(text, E' \t\n\x0b\x0c\r')[-1] AS last
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), grammar(src, r, dst) AS (VALUES ('N', 's', 'S'), ('N', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
inserted AS (
  SELECT DISTINCT src, src AS dst, 0 AS cost, '' AS audit, '' AS roles FROM grammar
  UNION ALL SELECT src, dst, 3, 'I', r FROM grammar WHERE r <> 's'
  UNION ALL SELECT a.src, b.dst, 6, 'II', a.r || b.r FROM grammar a JOIN grammar b ON a.dst = b.src WHERE a.r <> 's' AND b.r <> 's'
), best(conv_id, state, p, v) USING KEY (conv_id, state) AS (
  SELECT conv_id, 'N', 0::BIGINT, {{'cost': 0, 'audit': ''}} FROM counted
  UNION
  SELECT x.conv_id, y.dst, x.p + 1, min({{'cost': x.v.cost + y.cost, 'audit': x.v.audit || y.audit}})
  FROM best x JOIN judged j ON j.conv_id IS NOT DISTINCT FROM x.conv_id AND j.p = x.p + 1
  JOIN (
    SELECT i.src, i.dst, r, fault, i.cost + 4 AS cost, i.audit || 'D' AS audit FROM inserted i, (SELECT DISTINCT role[1] AS r, fault FROM judged)
    UNION ALL
    SELECT i.src, g.dst, k.r, fault, i.cost + CASE WHEN fault = 't' THEN 3 ELSE 0 END + CASE WHEN edit = 'R' THEN 3 ELSE 0 END, i.audit || edit
    FROM inserted i JOIN grammar g ON g.src = i.dst, (SELECT DISTINCT role[1] AS r, fault FROM judged) k, (VALUES ('K'), ('R')) e(edit)
    WHERE fault IN ('', 't') AND CASE edit WHEN 'K' THEN g.r = k.r ELSE g.r <> 's' END
  ) y ON y.src = x.state AND y.r = j.role[1] AND y.fault = j.fault
  GROUP BY x.conv_id, y.dst, x.p
), chosen AS (
  SELECT conv_id, min({{'cost': b.v.cost + i.cost, 'audit': b.v.audit || i.audit}}) AS v FROM best b JOIN inserted i ON i.src = b.state WHERE i.dst IN ('N', 'A') GROUP BY conv_id
), letters AS (
  SELECT conv_id, q, v.audit[q] AS e, len(replace(v.audit, 'D', '')) % 2 AS odd, len(replace(v.audit[1:q], 'D', '')) AS place, len(replace(v.audit[1:q], 'I', '')) AS p
  FROM chosen, range(1, len(v.audit) + 1) AS q(q)
), texts AS (
  SELECT l.conv_id, string_agg(CASE WHEN e = 'K' THEN j.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE j.text END, E'\n' ORDER BY q) AS whole
  FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.p = l.p WHERE e <> 'D' GROUP BY l.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(h.v.cost, 0) AS BIGINT) AS cost, coalesce(h.v.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
