"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm import (
    binary_packing,
    chat,
    collocations,
    decontaminate,
    language_id,
    pieces,
    projected_tree,
    separator_scan,
    simhash,
    suffix_tree,
    toxicity,
    warc_store,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_projected_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projected_tree.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").alias("score")
    )


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
         d AS (SELECT page_id, strlen(body)::BIGINT AS n, sha1(body) AS digest FROM p),
         o AS (SELECT digest, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
           CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
    FROM d LEFT JOIN o ON o.digest = d.digest
    """
)
def op2_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = warc_store.archive(table(spark, sf_dir, "pages"))
    read = warc_store.parse(warc_store.restore(store))
    return read.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").alias("refers_to")
    )


@query()
def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.count_tokens(table(spark, sf_dir, "documents"))


@query()
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.overlaps(docs, items).drop("check")


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binary_packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", binary_packing.ids_crc32()).drop("ids")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("toxic"))
    return toxicity.predict(docs, model).select("_row.doc_id", "p_toxic", "severity", "grade", "rejected")


@query(
    r"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
         marked AS (SELECT *, CASE role WHEN 'user' THEN length('[INST][/INST]') WHEN 'assistant' THEN length('<s></s>')
                                        WHEN 'system' THEN length('<<SYS>><</SYS>>')
                                        ELSE length('<<ROLE >><</ROLE>>') + length(regexp_replace(role, '([\\<\[>])', '\\\1', 'g')) END AS marks,
                           regexp_matches(text, '\\[\\<\[>]') OR regexp_matches(text, '\[/?INST\]|</?s>|<</?SYS>>|<</ROLE>>|<<ROLE ') AS hard FROM said)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(marks + 3 + length(text) + CASE WHEN hard THEN length(regexp_replace(text, '[^\\<\[]', '', 'g')) ELSE 0 END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """
)
def op9_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    formatted = chat.format_turns(said.unionByName(probe))
    read = formatted.withColumn("turns", chat.parse_turns(F.col("formatted")))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    read = read.withColumn("under", chat.loss_text(F.col("formatted"), F.col("loss")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    dictionaries = language_id.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    predicted = language_id.predict(docs.select("doc_id", "text"), dictionaries)
    predicted = predicted.select("_row.doc_id", "lang_pred", "score", "accepted")
    return predicted.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows)).withColumnRenamed("key", "vec_id")


@query(
    r"""
    WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
         p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
         w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
         total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
         f AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
               FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS ks(k))
               GROUP BY ALL HAVING count(*) >= 100),
         c AS (SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS parts FROM f WHERE k > 1),
         cut AS (SELECT c.*, k, array_to_string(parts[1 : k], ' ') AS head, array_to_string(parts[k + 1 : words], ' ') AS tail
                 FROM c, range(1, 5) AS ks(k) WHERE k < words),
         s AS (SELECT cut.lang, cut.phrase, a, n, cut.k, h.f AS l, t.f AS r, (1000 * a::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
               FROM cut JOIN f AS h ON h.lang = cut.lang AND h.phrase = head JOIN f AS t ON t.lang = cut.lang AND t.phrase = tail
               JOIN total ON total.lang = cut.lang),
         best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         kept AS (SELECT best.* FROM best WHERE NOT EXISTS (
                    SELECT 1 FROM c WHERE c.lang = best.lang AND c.a >= best.a AND c.phrase <> best.phrase
                    AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM kept QUALIFY rank <= 2000
    """
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long")  # no piece, no end: element_at would fail
    listed = F.to_json("ids")  # array_join would hold a text of each id of a row at once
    listed = F.substring(listed, F.lit(2), F.octet_length(listed) - 2)  # without the brackets
    return encoded.select(
        "_row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        covered.alias("covered_bytes"),
    )
