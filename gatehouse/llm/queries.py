"""The registered queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, fim, html, langid, lexical, mixing, packing, secrets, simhash, topk, toxicity, urls
from ._spark import crc_of_id, materialise

#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tokenizer() -> packing.WordTokenizer:
    """The public byte-level BPE vocabulary; its ranks file has the ids of byte_bpe_50k.json, but for the added tokens."""
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.WordTokenizer.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_in("text").alias("size"))
    out = mixing.mix_to_weights(materialise(docs))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), load_tokenizer)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Softmax:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.learn_toxicity(docs, labels.where(crc_of_id("doc_id") % 5 != 0))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.identify_languages(docs, language_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_model(spark: SparkSession, sf_dir: str) -> langid.CrossParser:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.learn_languages(docs.where(crc_of_id("doc_id") % 4 != 2))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = [r.kind for r in secrets.RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(listed))
    of_kind = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in listed]
    return found.select("row.doc_id", *of_kind, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fim.fim_documents(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_topk, op3_simhash, op4_packing, op5_toxicity, op6_langid, op7_urls, op8_chat, op9_embed_dedup, op10_html, op11_secrets, op12_fim, op13_lexical]
    return {f.__name__: f for f in found}


def _spans_sql(rule: secrets.Rule, number: int) -> str:
    """Spans of a rule in DuckDB, with marks around each match that no text holds."""
    quoted = rule.pattern.replace("'", "''")
    own = f"regexp_extract(m, '{quoted}', {rule.group})" if rule.group else "m"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {number} AS no, place AS start, place + length(m) AS stop FROM (
        SELECT doc_id, split_part(p, chr(2), 1) AS m, i, sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(replace(p, chr(2), '')) AS place
        FROM (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({quoted})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM documents)))
        WHERE i > 1 AND length({own}) >= {rule.least}"""


def oracle_sql() -> dict[str, str]:
    found = " UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return {
        "op2_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            WHERE rank <= 5""",
        "op7_urls": rf"""
            WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
            a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS address FROM pages),
            p AS (SELECT page_id, translate(regexp_extract(address, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(address, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM a),
            m AS (SELECT page_id, max_by(verdict || ' ' || rhost || rpath, length(rhost) * 1000 + length(rpath)) AS best
                  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
            SELECT p.page_id, host, path, split_part(best, ' ', 2) AS rule, coalesce(split_part(best, ' ', 1), 'allow') AS verdict
            FROM p LEFT JOIN m USING (page_id)""",
        "op11_secrets": f"""
            WITH found AS ({found}),
            s AS (SELECT d.doc_id, {counts}, coalesce(string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, no), '') AS spans
                  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id)
            SELECT *, sha256(spans) AS base_sha256 FROM s""",
        "op12_fim": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
                              sha256('42:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
            h AS (SELECT *, len(tokens) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(d, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM t),
            c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
            p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix FROM c)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op13_lexical": r"""
            WITH split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            docs AS (SELECT doc_id, w, len(w) AS n FROM split WHERE len(w) > 0),
            total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
            tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
            items AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
            weight AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(big_n) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
            score AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
                      FROM items JOIN weight USING (term) JOIN tf USING (term), total GROUP BY ALL)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 50""",
        "op8_chat": """
            WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN hash(turn, role, text) END AS alone, turn, role, text FROM conversations),
            c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS turns,
                         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                                    ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS text
                  FROM t GROUP BY conv_id, alone),
            d AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns, any_value(text) AS text FROM c GROUP BY n_turns, turns)
            SELECT conv_id, n_turns, n_copies, text FROM d
            WHERE NOT EXISTS (SELECT 1 FROM d AS longer WHERE longer.n_turns > d.n_turns AND longer.turns[1] = d.turns[1] AND longer.turns[1:d.n_turns] = d.turns)""",
    }
