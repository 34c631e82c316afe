"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from tallyweave.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def mixing_levels() -> dict:
    """Domains stand for the twenty sources of the synthetic documents, by their number."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "language": F.col("lang"), "origin": F.col("source")}


def mixing_weights(spark: SparkSession) -> dict:
    """Target weights: two domains above the others, and languages evened out."""
    domain = spark.createDataFrame([("d0", 0.2), ("d1", 0.3), ("d2", 0.4), ("d3", 0.1)], "domain string, weight double")
    language = spark.createDataFrame([(f"d{i}", lang, w) for i in range(4) for lang, w in (("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2))], "domain string, language string, weight double")
    return {"domain": domain, "language": language, "origin": None}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), mixing_levels(), mixing_weights(spark), most_epochs=3, seed=17)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 4) AS domain,
         lang AS language, source AS origin,
         CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS DOUBLE) AS tok FROM d GROUP BY ALL),
total AS (SELECT sum(tok) AS b FROM leaf),
-- a level: fill children in order of capacity for weight
l1 AS (SELECT domain, 3 * sum(tok) AS cap, coalesce(any_value(w.weight), 1.0) AS w FROM leaf
       LEFT JOIN (VALUES ('d0', 0.2), ('d1', 0.3), ('d2', 0.4), ('d3', 0.1)) w(dom, weight) ON w.dom = domain GROUP BY domain),
l1p AS (SELECT *, cap / w AS r, (SELECT b FROM total) AS b,
          coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
          sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM l1),
l1b AS (SELECT domain, least(cap, coalesce((SELECT arg_min((b - filled) / rest, r) FROM l1p x WHERE (b - filled) / rest <= r) * w, cap)) AS b FROM l1p),
l2 AS (SELECT domain, language, 3 * sum(tok) AS cap, CASE language WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.2 ELSE 1.0 END AS w FROM leaf GROUP BY domain, language),
l2p AS (SELECT l2.*, cap / w AS r, l1b.b,
          coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
          sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (PARTITION BY domain ORDER BY cap / w, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
        FROM l2 JOIN l1b USING (domain)),
l2f AS (SELECT domain, arg_min((b - filled) / rest, r) AS line FROM l2p WHERE (b - filled) / rest <= r GROUP BY domain),
l2b AS (SELECT domain, language, least(cap, coalesce(line * w, cap)) AS b FROM l2p LEFT JOIN l2f USING (domain)),
l3p AS (SELECT domain, language, origin, tok, 3 * tok AS cap, 3 * tok AS r, l2b.b,
          coalesce(sum(3 * tok) OVER (PARTITION BY domain, language ORDER BY 3 * tok, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
          count(*) OVER (PARTITION BY domain, language) - coalesce(count(*) OVER (PARTITION BY domain, language ORDER BY 3 * tok, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
        FROM leaf JOIN l2b USING (domain, language)),
l3f AS (SELECT domain, language, arg_min((b - filled) / rest, r) AS line FROM l3p WHERE (b - filled) / rest <= r GROUP BY domain, language),
l3b AS (SELECT domain, language, origin, tok, least(cap, coalesce(line, cap)) AS b FROM l3p LEFT JOIN l3f USING (domain, language)),
plan AS (SELECT *, CAST(CASE WHEN tok > 0 THEN floor(b / tok + 1e-6) ELSE 0 END AS BIGINT) AS epochs FROM l3b),
placed AS (SELECT d.*, epochs, greatest(b - epochs * tok, 0) AS left_over, md5('17:' || epochs || ':' || doc_id) AS place FROM d JOIN plan USING (domain, language, origin)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
stop AS (SELECT domain, language, origin, min(place) AS cut FROM run WHERE upto > left_over + 1e-6 GROUP BY ALL)
SELECT doc_id, domain, language, origin, n_tokens,
       CAST(epochs + CASE WHEN left_over > 1e-6 AND (cut IS NULL OR place < cut) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM run LEFT JOIN stop USING (domain, language, origin)
"""


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import multi_index

    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import edit_fingerprint

    return edit_fingerprint.components(edit_fingerprint.edit_digests(table(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(own).withColumn("content", chat.text_parts(F.col("text")))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import warc

    return warc.write_and_read(table(spark, sf_dir, "pages"), least=0)


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents that are labelled as of good quality."""
    from tallyweave.llm import lm_score

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=3, rest=1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=5, rest=0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import ngram_join

    return ngram_join.similar_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from tallyweave.llm import token_files

    return token_files.write_and_read(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), end=0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import vector_codes

    return vector_codes.code_errors(table(spark, sf_dir, "embeddings"), parts=4, rounds=4)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filter_audit.text_filters(), copies="E")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_byte_bpe, op2_mixing, op3_multi_index, op4_edit_fingerprint, op5_quality, op6_chat_format, op7_ngram_jaccard_join, op8_warc, op9_toxicity, op10_cross_entropy_difference, op11_token_files, op12_vector_codes, op13_filter_audit)
    return {f.__name__: f for f in every}


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (SELECT *, len(regexp_extract_all(text, '[<\[](\\\\)*/?(s>|INST\]|image>|audio>|document>)')) AS escapes FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(text) + escapes + CASE WHEN role = 'assistant' THEN 7 ELSE length(role) + 14 END) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""


def _op12_sql(rounds: int = 4) -> str:
    """Lloyd's rounds written out, on whole numbers; a row of ``p0`` is a part, of ``c0`` to ``c4`` an entry."""
    steps = [r"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p0 AS MATERIALIZED (SELECT r, vec_id, pos, list_slice(v, pos * len(v) // 4 + 1, (pos + 1) * len(v) // 4) AS x FROM kept, range(4) t(pos)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256),
c0 AS MATERIALIZED (SELECT pos, entry, x AS c FROM p0 JOIN first USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, pos, min(x) AS x, min((d, entry)) AS best FROM (
    SELECT r, p0.pos, x, entry, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM p0 JOIN c{i} ON p0.pos = c{i}.pos) GROUP BY r, pos)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT pos, entry, j, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT pos, best[2] AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY pos, entry, j),
m{i} AS (SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY pos, entry),
c{i + 1} AS MATERIALIZED (SELECT c{i}.pos, c{i}.entry, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.pos = m{i}.pos AND c{i}.entry = m{i}.entry)""")
    steps.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY pos) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r),
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), told""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


OP13_SQL = r"""
WITH RECURSIVE orders(o) AS (
  SELECT CAST('' AS VARCHAR) UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, CAST(i AS INTEGER) AS step, o[i] AS filter, substr(o, 1, i - 1) AS before FROM orders, range(1, 6) s(i) WHERE length(o) = 5),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT *, contains(failed, filter) AS fails, translate(failed, before, '') <> failed AS gone FROM g, steps),
y AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = filter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM y
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op6_chat_format": OP6_SQL, "op12_vector_codes": _op12_sql(), "op13_filter_audit": OP13_SQL}
