"""The opN_ queries: each applies its operator to the whole of its table; ORACLES has DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op3_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_position, mix

    return by_position(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import digests

    return digests(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, segments

    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


def op9_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_OP4 = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
rated AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS lim FROM by_source),
steps AS (SELECT *, lim / weight AS ratio, coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                 sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM rated),
levels AS (SELECT *, (CAST((SELECT sum(source_size) FROM by_source) AS DOUBLE) * CAST(1.5 AS DOUBLE) - capped) / rest AS lev FROM steps),
targets AS (SELECT source, rank, source_size, CASE WHEN (SELECT max(lev) FROM levels WHERE lev <= ratio) IS NULL THEN lim
                   ELSE least(lim, (SELECT max(lev) FROM levels WHERE lev <= ratio) * weight) END AS target FROM levels),
placed AS (SELECT doc_id, size, source_size, rank, target, CAST(floor(target) AS BIGINT) AS words,
                  CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shared AS (SELECT *, words // greatest(source_size, 1) AS passes, least(CAST(before AS DOUBLE) / greatest(target, CAST(1 AS DOUBLE)), CAST(1 AS DOUBLE)) AS share FROM placed)
SELECT doc_id, size, source_size, target,
       size * passes + greatest(0, least(size, words - passes * source_size - before)) AS taken,
       least(greatest({position}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS position
FROM shared
"""


def _position_sql() -> str:
    """The inverse of each schedule's integral, with the arithmetic of mixing.training_time."""
    from .mixing import SCHEDULES

    d = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    cases = []
    for k, knots in enumerate(SCHEDULES):
        n, at, area, arms = len(knots) - 1, 0.0, sum((a + b) / 2 for a, b in zip(knots, knots[1:])), []
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            rest = f"((share - {d(at)}) * {d(area)})"
            step = f"{rest} / {d(a)}" if a == b else f"(sqrt(greatest({d(a * a)} + {d(2.0 * (b - a))} * {rest}, {d(0)})) - {d(a)}) / {d(b - a)}"
            t = f"({d(i)} + {step}) / {d(n)}"
            at += (a + b) / 2 / area
            arms.append(f"WHEN share <= {d(at)} THEN {t}" if i < n - 1 else f"ELSE {t}")
        cases.append(f"WHEN rank % {len(SCHEDULES)} = {k} THEN CASE {' '.join(arms)} END")
    return f"CASE {' '.join(cases)} END"


_CONTROL_REST = r"</SYS>>|<SYS>>|/TEXT\]|/INST\]|INST\]|ROLE\]|TEXT\]|ANS\]|/s>|s>"
_OP8 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, regexp_replace(text, '([<\[])(\\*)({_CONTROL_REST})', '\1\\\2\3', 'g') AS escaped,
  CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 19 WHEN 'assistant' THEN 15
       ELSE 27 + length(regexp_replace(role, '([<\[])(\\*)({_CONTROL_REST})', '\1\\\2\3', 'g')) END AS marks,
  coalesce(lag(role) OVER w, '') AS state, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
checked AS (SELECT *, (state = '' AND k = 1 AND role IN ('system', 'user')) OR (state IN ('system', 'assistant') AND role = 'user') OR (state = 'user' AND role = 'assistant') AS ok FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marks + length(escaped)) AS BIGINT) AS formatted_chars,
  bool_and(ok) AND max(CASE WHEN k = n THEN role END) IN ('user', 'assistant') AS valid
FROM checked GROUP BY conv_id
"""

_OP3 = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
signs AS (SELECT doc_id, n, (SELECT md5(string_agg(md5(CAST(s AS VARCHAR)), '' ORDER BY md5(CAST(s AS VARCHAR)))) FROM sets t WHERE t.doc_id = z.doc_id) AS sign FROM sizes z),
reps AS (SELECT min(doc_id) AS rep, any_value(n) AS n, sign FROM signs GROUP BY sign),
few AS (SELECT t.* FROM sets t JOIN reps ON t.doc_id = rep),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, root) AS (SELECT rep, rep FROM reps UNION SELECT b, root FROM reached JOIN both_ways ON a = id WHERE root < b),
roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN signs s ON s.doc_id = d.doc_id LEFT JOIN reps r ON r.sign = s.sign LEFT JOIN roots ON roots.id = r.rep
"""
_OP5 = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT rid, i, hash(w[i:i + 34]) AS h, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
twice AS (SELECT rid, i FROM wins JOIN (SELECT h, m FROM wins GROUP BY h, m HAVING count(*) > 1) USING (h, m)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
marked AS (SELECT w.rid, w.i, word, coalesce(max(CASE WHEN t.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN twice t ON t.rid = w.rid AND t.i = w.i),
kept AS (SELECT rid, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS text FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)
"""

QUERIES = {f.__name__: f for f in (op1_media, op2_syncmers, op3_setsketch, op4_mixing, op5_repeats, op6_quality, op7_toxicity, op8_chat, op9_trie_lm, op10_packing)}
ORACLES = {"op3_setsketch": _OP3, "op5_repeats": _OP5, "op4_mixing": _OP4.replace("{position}", _position_sql()), "op8_chat": _OP8}
