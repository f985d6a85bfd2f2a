"""The registered queries. Each runs over whole tables and stands next to its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions import text as tx
from twinline.functions import tokens as tk
from twinline.operators import batches, filters, order, pairing, scores, shards, splits, stats, traces, user_map
from twinline.plans import flows, inputs, sql
from twinline.plans.registry import query
from twinline.schemas import NUMBERED_PAIRS
from twinline.session import new_path, settle
from twinline.sources import shards as shard_files
from twinline.sources.parallel_text import count_pairs as count_lines
from twinline.sources.parallel_text import open_parallel_text, read_lines
from twinline.sources.parallel_text import pair_files as pair_names

SHARD_ROWS = 64
BATCH = 32
WIDTH = 128
BLOCK = 1024
SHARD_TOKENS = 50_000
CAPACITY = 60.0


def joined(ids: Column | str) -> Column:
    """An array as text, which compares the same in every engine."""
    return F.array_join(ids, " ")


# --- Sources and sinks -------------------------------------------------------------------------

CLEAN = "replace(replace({}, chr(13), ' '), chr(10), ' ')"
FILE_PAIRS = sql.TURNS + f""",
filed AS (
  SELECT conv_id % 2 AS file_pair,
         row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn) - 1 AS line_no,
         row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) - 1 AS row_idx,
         {sql.strip(CLEAN.format('src'))} AS src, {sql.strip(CLEAN.format('tgt'))} AS tgt
  FROM turns
),
cut AS (
  SELECT *, line_no // {BATCH} + CASE WHEN file_pair = 1 THEN
    (SELECT ceil(count(*) / {BATCH})::BIGINT FROM filed WHERE file_pair = 0) ELSE 0 END AS batch_id
  FROM filed
)"""


@query(f"WITH {FILE_PAIRS} SELECT file_pair, line_no, row_idx, batch_id, src, tgt FROM cut")
def scan_parallel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_parallel_text(spark, inputs.line_files(spark, sf_dir), "src", "tgt", batch=BATCH).pairs()


@query(f"""
WITH s AS (
  SELECT source || '-' || doc_id || '.src' AS src_name, row_number() OVER (ORDER BY src_name) - 1 AS file_pair
  FROM documents
), t AS (
  SELECT lang || '-' || doc_id || '.tgt' AS tgt_name, row_number() OVER (ORDER BY tgt_name) - 1 AS file_pair
  FROM documents
)
SELECT file_pair, src_name, tgt_name FROM s JOIN t USING (file_pair)""")
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    names = pairing.concat(
        [
            docs.select(F.concat(kind, F.lit("-"), "doc_id", F.lit(end)).alias("name"))
            for kind, end in (("source", ".src"), ("lang", ".tgt"))
        ]
    )
    return pair_names(names, "src", "tgt")


@query(f"WITH {sql.TURNS} SELECT count(*) AS total_pairs FROM turns")
def count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_lines(read_lines(spark, inputs.line_files(spark, sf_dir), "src"))


@query(f"WITH {sql.NUMBERED} SELECT row_idx::VARCHAR AS id, src, tgt FROM numbered")
def scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pairs")
    inputs.numbered_pairs(spark, sf_dir).drop("row_idx").write.parquet(path)
    return tx.split_sides(shard_files.read_pairs(spark, path))


LOST = "CASE WHEN row_idx % 5 = 0 THEN 'damaged' WHEN row_idx % 7 = 0 THEN 'no id' WHEN row_idx % 9 = 0 THEN 'no translation' END"


@query(f"""
WITH {sql.NUMBERED}, marked AS (SELECT *, {LOST} AS reason FROM numbered)
SELECT reason, CASE WHEN reason IS NULL THEN row_idx::VARCHAR END AS id, CASE WHEN reason IS NULL THEN src END AS src,
       CASE WHEN reason IS NULL THEN tgt END AS tgt, count(*) AS n
FROM marked GROUP BY ALL""")
def scan_damaged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are cut, some hold a wrongly typed translation, and some lack a field."""
    rows, path = inputs.numbered_pairs(spark, sf_dir), new_path(spark, "damaged-pairs")
    at, line = F.col("row_idx"), F.to_json(F.struct("id", "translation"))
    cut = F.substr(line, F.lit(1), F.length(line) - 2)
    typed = F.to_json(F.struct("id", F.lit("none").alias("translation")))
    bad = F.when(at % 10 == 0, cut).when(at % 5 == 0, typed).when(at % 7 == 0, F.to_json(F.struct("translation")))
    bad = bad.when(at % 9 == 0, F.to_json(F.struct("id")))
    rows.select(F.coalesce(bad, line).alias("value")).write.text(path)
    good, damaged = shard_files.scan_pairs(spark, path)
    nothing = F.lit(None).cast("string")
    good = tx.split_sides(good).select(nothing.alias("reason"), "id", "src", "tgt")
    damaged = damaged.select(F.array_join("reasons", ",").alias("reason"), *(nothing.alias(c) for c in ("id", "src", "tgt")))
    return good.union(damaged).groupBy("reason", "id", "src", "tgt").agg(F.count("*").alias("n"))


def _row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.split_by_shard(shards.shard_by_rows(inputs.numbered_pairs(spark, sf_dir), SHARD_ROWS, BATCH))


def _written_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "shards")
    shard_files.write_shards(_row_shards(spark, sf_dir), out)
    return shard_files.read_shards(spark, out, NUMBERED_PAIRS)


SHARDED = sql.NUMBERED + f""",
sharded AS (
  SELECT *, row_idx // {SHARD_ROWS} AS shard_id, CASE WHEN row_idx < {SHARD_ROWS} THEN 'val' ELSE 'train' END AS split
  FROM numbered
)"""


@query(f"WITH {SHARDED} SELECT split, shard_id, count(*) AS pairs, 1::BIGINT AS files FROM sharded GROUP BY ALL")
def write_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _written_shards(spark, sf_dir).withColumn("file", F.col("_metadata.file_path"))
    return written.groupBy("split", "shard_id").agg(
        F.count("*").alias("pairs"), F.count_distinct("file").alias("files")
    )


@query(f"WITH {SHARDED} SELECT split, shard_id, row_idx, row_idx::VARCHAR AS id, src, tgt FROM sharded")
def read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.split_sides(_written_shards(spark, sf_dir))
    return rows.select("split", "shard_id", "row_idx", "id", "src", "tgt")


@query(f"""
WITH {SHARDED}
SELECT split, shard_id, count(*) FILTER (shard_id <> 2) AS pairs, (shard_id = 2)::INT AS damaged
FROM sharded WHERE split = 'train' GROUP BY ALL""")
def read_damaged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of which one file is no Parquet and one split is missing."""
    out, rows = new_path(spark, "shards"), _row_shards(spark, sf_dir).filter(F.col("split") == "train")
    shard_files.write_shards(rows.filter(F.col("shard_id") != 2), out)
    text = rows.filter(F.col("shard_id") == 2).select(F.concat_ws(",", "row_idx", "translation.src").alias("value"))
    text.coalesce(1).write.text(f"{out}/split=train/shard_id=2")
    return _good_and_bad(spark, out)


def _good_and_bad(spark: SparkSession, out: str) -> DataFrame:
    """Pairs of the good shard files, and the shards of the damaged ones."""
    verdicts = shard_files.verify_shards(spark, out, NUMBERED_PAIRS)
    good = shard_files.read_shards(spark, out, NUMBERED_PAIRS, verdicts=verdicts)
    good = good.groupBy("split", "shard_id").agg(F.count("translation.tgt").alias("pairs"), F.lit(0).alias("damaged"))
    place = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1)
    bad = shard_files.unreadable_shards(verdicts, out).groupBy(
        place("split").alias("split"), place("shard_id").cast("long").alias("shard_id")
    )
    return good.union(bad.agg(F.lit(0).cast("long").alias("pairs"), F.lit(1).alias("damaged")))


@query(f"""
WITH {SHARDED}
SELECT split, shard_id, count(*) FILTER (shard_id <> 1) AS pairs, (shard_id = 1)::INT AS damaged
FROM sharded GROUP BY ALL""")
def read_manifest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with a manifest, of which one file was replaced by a sound file of other rows, and one file more lies there."""
    out, rows = new_path(spark, "shards"), _row_shards(spark, sf_dir)
    shard_files.write_shards(rows, out, manifest=True)
    other = rows.filter("shard_id = 1").drop("split", "shard_id").limit(3)
    other.coalesce(1).write.mode("overwrite").parquet(f"{out}/split=train/shard_id=1")
    other.coalesce(1).write.mode("append").parquet(f"{out}/split=val/shard_id=0")
    return _good_and_bad(spark, out)


@query(f"WITH {SHARDED} SELECT split, row_idx, row_idx::VARCHAR AS id, src, tgt FROM sharded")
def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "published")
    shard_files.publish(_written_shards(spark, sf_dir), target)
    return tx.split_sides(spark.read.parquet(target)).select("split", "row_idx", "id", "src", "tgt")


@query(f"WITH {SHARDED} SELECT split, row_idx, row_idx::VARCHAR AS id, src, tgt FROM sharded")
def publish_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published in one commit, beside what a failed try has left."""
    target, rows = new_path(spark, "published"), _written_shards(spark, sf_dir)
    rows.drop("shard_id").limit(5).write.partitionBy("split").parquet(f"{target}/data-failed")
    shard_files.publish(rows, target, manifest=True)
    return tx.split_sides(shard_files.read_published(spark, target, NUMBERED_PAIRS)).select("split", "row_idx", "id", "src", "tgt")


# --- Joins and concatenation -------------------------------------------------------------------


@query(f"WITH {sql.SIDES} SELECT file_pair, line_no, src, tgt FROM zipped")
def zip_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.zip_lines(*inputs.side_lines(spark, sf_dir), "truncate")


@query(f"""
WITH {sql.SIDES}, sizes AS (
  SELECT file_pair, count(*) FILTER (lang = 'en') AS n, count(*) FILTER (lang = 'fr') AS m FROM sides GROUP BY ALL
)
SELECT file_pair, line_no, src, tgt FROM zipped JOIN sizes USING (file_pair)
WHERE line_no < CASE WHEN n = m THEN n ELSE least(n, m) // {BATCH} * {BATCH} END""")
def zip_drop_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.zip_lines(*inputs.side_lines(spark, sf_dir), "drop_batch", BATCH)


SFT = "'Translate English to Korean: ' || src || ' => ' || tgt"
SFT_ROWS = sql.NUMBERED + f""",
keyed AS (SELECT row_idx, row_idx::VARCHAR AS id, src, tgt, {SFT} AS text FROM numbered),
divided AS ({sql.split_of('keyed', 'id')}),
sft AS (
  SELECT split, row_idx, id, text, split_part(text, ' => ', 1) || ' => ' || chr(10) AS prompt,
         {sql.strip("split_part(text, '=>', 2)")} AS reference
  FROM divided
)"""


@query(f"WITH {SFT_ROWS} SELECT id, text, prompt FROM sft")
def zip_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and prompts written apart, in row order, and put side by side by their places in the files."""
    pairs = tx.split_sides(inputs.numbered_pairs(spark, sf_dir)).sort("row_idx")
    full = pairs.select("id", tx.sft_text("src", "tgt").alias("text"))
    texts, prompts = settle(full, "texts"), settle(full.select(tx.blank_answer("text").alias("prompt")), "prompts")
    return pairing.zip_rows(texts, prompts, ragged="error", numbered=order.number_files)


@query(f"""
WITH {sql.NUMBERED},
a AS (SELECT row_idx, CASE WHEN row_idx % 3 > 0 THEN (row_idx // 4)::VARCHAR END AS id, src FROM numbered),
b AS (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, CASE WHEN row_idx % 2 = 0 THEN (row_idx // 3)::VARCHAR END AS other, tgt
      FROM numbered WHERE row_idx % 5 > 0)
SELECT row_idx, id, src, other, tgt FROM a JOIN b USING (row_idx)""")
def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets of different length, with repeated and null ids."""
    rows = inputs.numbered_turns(spark, sf_dir).sort("row_idx")
    at = F.col("row_idx")
    a = rows.select("row_idx", F.when(at % 3 > 0, order.int_div("row_idx", 4).cast("string")).alias("id"), "src")
    b = rows.filter(at % 5 > 0).select(F.when(at % 2 == 0, order.int_div("row_idx", 3).cast("string")).alias("other"), "tgt")
    return pairing.zip_rows(a, b)


@query(f"WITH {SHARDED} SELECT split, shard_id, row_idx FROM sharded")
def concat_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _row_shards(spark, sf_dir).select("split", "shard_id", "row_idx")
    return pairing.concat([rows.filter(F.col("split") == s) for s in shard_files.SPLITS])


# Written out again, so that a slip in the engine's own table shows.
PROFILES = "(0, '4090', 24, 128), (1, 'A100_40', 48, 256), (2, 'A100_80', 96, 512), (3, 'H100', 128, 512)"


@query(f"""
WITH {sql.TURNS}
SELECT conv_id, turn, profile, batch_size, max_length,
       strlen(src) + 1 <= max_length AND strlen(tgt) + 1 <= max_length AS fits
FROM turns JOIN (VALUES {PROFILES}) b(i, profile, batch_size, max_length) ON (conv_id + turn) % 4 = i""")
def budget_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(b[0]) for b in pairing.BUDGETS])
    place = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
    named = inputs.turns(spark, sf_dir).withColumn("profile", F.get(names, place))
    found = pairing.budget_lookup(named, "profile")
    fits = pairing.within_budget(tk.token_count("src"), tk.token_count("tgt"), F.col("max_length"))
    return found.select("conv_id", "turn", "profile", "batch_size", "max_length", fits.alias("fits"))


# --- Text --------------------------------------------------------------------------------------

HEAD = "chr(12288) || chr(9) || chr(28)"
TAIL = "chr(133) || '  ' || chr(10)"


def _spaced(c: str) -> str:
    return f"CASE WHEN (conv_id + turn) % 3 = 0 THEN {HEAD} || {c} || {TAIL} ELSE {c} END"


@query(f"""
WITH {sql.TURNS}, spaced AS (SELECT conv_id, turn, {_spaced('src')} AS src, {_spaced('tgt')} AS tgt FROM turns)
SELECT conv_id, turn, {sql.strip('src')} AS src, {sql.strip('tgt')} AS tgt FROM spaced""")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.spaced_turns(spark, sf_dir)
    return rows.withColumns({"src": tx.strip_text("src"), "tgt": tx.strip_text("tgt")})


@query(f"WITH {sql.NUMBERED} SELECT row_idx::VARCHAR AS id, src AS pair_src, tgt AS pair_tgt FROM numbered")
def make_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tx.make_pairs(flows.running_id(inputs.numbered_turns(spark, sf_dir)))
    return pairs.select("id", F.col("translation.src").alias("pair_src"), F.col("translation.tgt").alias("pair_tgt"))


@query(f"WITH {sql.TURNS} SELECT conv_id, turn, src, tgt FROM turns")
def split_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.split_sides(tx.make_pairs(inputs.turns(spark, sf_dir)))


@query(f"WITH {sql.TURNS} SELECT conv_id, turn, 'translate English to Korean: ' || src AS prompt FROM turns")
def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.turns(spark, sf_dir).select("conv_id", "turn", tx.prompt_prefix("src").alias("prompt"))


@query(f"WITH {sql.TURNS} SELECT conv_id, turn, {SFT} AS text FROM turns")
def sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.turns(spark, sf_dir).select("conv_id", "turn", tx.sft_text("src", "tgt").alias("text"))


@query(f"WITH {sql.ARROWS} SELECT conv_id, turn, split_part(text, ' => ', 1) || ' => ' || chr(10) AS prompt FROM arrows")
def blank_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.arrow_texts(spark, sf_dir).select("conv_id", "turn", tx.blank_answer("text").alias("prompt"))


@query(f"""
WITH {sql.ARROWS}
SELECT conv_id, turn, CASE WHEN contains(text, '=>') THEN {sql.strip("split_part(text, '=>', 2)")} END AS reference
FROM arrows""")
def extract_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.arrow_texts(spark, sf_dir).select("conv_id", "turn", tx.extract_reference("text").alias("reference"))


# --- Filters, caps and samples -----------------------------------------------------------------


@query(f"WITH {sql.BLANKS} SELECT conv_id, turn, src, tgt FROM blanks WHERE {sql.FILLED}")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_empty(inputs.with_blanks(inputs.turns(spark, sf_dir)))


@query(f"WITH {sql.TURNS} SELECT conv_id, turn, src, tgt FROM turns WHERE strlen(src) < 512 AND strlen(tgt) < 512")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.length_filter(inputs.turns(spark, sf_dir), 512)


@query(f"""
WITH {sql.BLANKS}
SELECT row_idx, src, tgt FROM blanks WHERE {sql.FILLED} ORDER BY row_idx LIMIT 100""")
def cap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.drop_empty(inputs.with_blanks(inputs.numbered_turns(spark, sf_dir)))
    return filters.cap_pairs(rows, 100).select("row_idx", "src", "tgt")


@query(f"WITH {sql.LINES} SELECT row_idx, doc_id, text FROM lines ORDER BY row_idx LIMIT 3")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.head_sample(inputs.numbered_lines(spark, sf_dir).select("row_idx", "doc_id", "text"))


@query(f"""
WITH {sql.BLANKS}
SELECT conv_id, turn, concat_ws(' ',
         CASE WHEN coalesce(src, '') = '' THEN 'no_source' END,
         CASE WHEN coalesce(tgt, '') = '' THEN 'no_target' END,
         CASE WHEN strlen(src) >= 512 OR strlen(tgt) >= 512 THEN 'too_long' END) AS reasons
FROM blanks""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "no_source": ~filters.filled("src"),
        "no_target": ~filters.filled("tgt"),
        "too_long": (tk.token_count("src") > 512) | (tk.token_count("tgt") > 512),
    }
    good, bad = filters.quarantine(inputs.with_blanks(inputs.turns(spark, sf_dir)), rules)
    parts = [good.withColumn("reasons", F.lit("")), bad.withColumn("reasons", joined("reasons"))]
    return pairing.concat([part.select("conv_id", "turn", "reasons") for part in parts])


# --- Tokens ------------------------------------------------------------------------------------


def _both(spark: SparkSession, sf_dir: str, fn) -> DataFrame:
    return inputs.turns(spark, sf_dir).select("conv_id", "turn", fn("src").alias("src"), fn("tgt").alias("tgt"))


def _both_sql(fn) -> str:
    return f"WITH {sql.TURNS} SELECT conv_id, turn, {fn('src')} AS src, {fn('tgt')} AS tgt FROM turns"


@query(_both_sql(lambda c: sql.joined(sql.ids(c))))
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda c: joined(tk.token_ids(c)))


@query(_both_sql(lambda c: sql.joined(sql.ids(c, WIDTH))))
def truncate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda c: joined(tk.token_ids(c, WIDTH)))


FIXED = sql.TURNS + f""",
ids AS (SELECT conv_id, turn, {sql.ids('src', WIDTH)} AS s, {sql.ids('tgt', WIDTH)} AS t FROM turns)"""


@query(f"""
WITH {FIXED}
SELECT conv_id, turn, {sql.joined(sql.pad('s', WIDTH, 0))} AS input_ids, {sql.joined(sql.mask('s', WIDTH))} AS attention_mask,
       {sql.joined(sql.pad('t', WIDTH, 0))} AS labels
FROM ids""")
def pad_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.tokenize_fixed(inputs.turns(spark, sf_dir), F.col("src"), F.col("tgt"), WIDTH)
    return rows.select("conv_id", "turn", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(f"""
WITH {sql.NUMBERED},
ids AS (SELECT row_idx, row_idx // {BATCH} AS batch_id, {sql.ids('src', WIDTH)} AS s, {sql.ids('tgt', WIDTH)} AS t FROM numbered),
wide AS (SELECT *, max(len(s)) OVER (PARTITION BY batch_id) AS sw, max(len(t)) OVER (PARTITION BY batch_id) AS tw FROM ids)
SELECT row_idx, batch_id, {sql.joined(sql.pad('s', 'sw', 0))} AS input_ids, {sql.joined(sql.mask('s', 'sw'))} AS attention_mask,
       {sql.joined(sql.pad('t', 'tw', -100))} AS labels
FROM wide""")
def pad_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.micro_batches(inputs.numbered_turns(spark, sf_dir), BATCH)
    rows = batches.pad_longest(rows, "src", "tgt", WIDTH)
    return rows.select("row_idx", "batch_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(f"WITH {FIXED} SELECT conv_id, turn, {sql.joined(sql.pad('t', WIDTH, -100))} AS labels FROM ids")
def label_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = inputs.turns(spark, sf_dir).withColumn("ids", tk.token_ids("tgt", WIDTH))
    return ids.select("conv_id", "turn", joined(tk.label_pad("ids", WIDTH)).alias("labels"))


@query(f"""
WITH {sql.LINES}
SELECT doc_id, pos, (strlen(text) + 1)::INT AS with_end, strlen(text)::INT AS without_end FROM lines""")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tk.token_count("text").alias("with_end"), tk.token_count("text", eos=False).alias("without_end")
    return inputs.doc_lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), *counts)


@query(f"""
WITH {sql.TURNS}, ids AS (SELECT conv_id, turn, {sql.ids('tgt')} AS t FROM turns)
SELECT conv_id, turn, {sql.joined('list_transform(t, lambda x, i: CASE WHEN i % 7 = 0 OR i % 11 = 0 THEN 2 ELSE x END)')} AS ids FROM ids""")
def clamp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda i: F.when((i + 1) % 7 == 0, 999_999).when((i + 1) % 11 == 0, -3)
    wild = F.transform(tk.token_ids("tgt"), lambda x, i: F.coalesce(bad(i), x))
    return inputs.turns(spark, sf_dir).select("conv_id", "turn", joined(tk.clamp_ids(wild)).alias("ids"))


@query(f"""
WITH {sql.TURNS}, ids AS (SELECT conv_id, turn, {sql.ids('tgt')} AS t FROM turns)
SELECT conv_id, turn, {sql.joined('list_transform(t, lambda x, i: CASE WHEN i % 5 = 0 THEN 0 ELSE x END)')} AS labels FROM ids""")
def unmask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.transform(tk.token_ids("tgt"), lambda x, i: F.when((i + 1) % 5 == 0, F.lit(tk.IGNORE)).otherwise(x))
    return inputs.turns(spark, sf_dir).select("conv_id", "turn", joined(tk.unmask_labels(masked)).alias("labels"))


@query(f"WITH {sql.TURNS} SELECT conv_id, turn, src, tgt FROM turns")
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda c: tk.decode_ids(tk.token_ids(c)))


@query(f"""
WITH {sql.TURNS}
SELECT conv_id, turn, least(strlen(src) + 1, {WIDTH})::INT AS n_input, least(strlen(tgt) + 1, {WIDTH})::INT AS n_label FROM turns""")
def nonpad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.tokenize_fixed(inputs.turns(spark, sf_dir), F.col("src"), F.col("tgt"), WIDTH, tk.IGNORE)
    return tk.nonpad_counts(rows).select("conv_id", "turn", "n_input", "n_label")


@query(f"""
WITH {sql.LINES} SELECT true AS same, count(*) AS texts, sum(strlen(text))::BIGINT AS tokens FROM lines""")
def roundtrip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.roundtrip_audit(inputs.doc_lines(spark, sf_dir), "text")


@query(f"""
WITH {sql.TURNS}
SELECT conv_id, turn, {sql.joined("list_transform(string_split(tgt, ' '), lambda w: length(w))")} AS ids FROM turns""")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.turns(spark, sf_dir).select("conv_id", "turn", "tgt")
    sized = tk.ids_with(rows, "tgt", lambda texts: [[len(w) for w in t.split(" ")] for t in texts])
    return sized.select("conv_id", "turn", joined("ids").alias("ids"))


def _tokenized(batch: dict[str, list]) -> dict[str, list]:
    """A user's function: whole token rows; it refuses some rows, drops some and makes two of some."""
    out: dict[str, list] = {name: [] for name in ("conv_id", "turn", "part", "input_ids", "attention_mask", "labels")}
    for conv_id, turn, src, tgt in zip(*(batch[c] for c in ("conv_id", "turn", "src", "tgt"))):
        at = conv_id + turn
        if at % 7 == 0:
            raise ValueError("refused")
        if at % 5 == 0:
            continue
        sides = [[b + 3 for b in text.encode()][: WIDTH - 1] + [1] for text in (src, tgt)]
        for part, (ids, labels) in enumerate([sides, sides[::-1]] if at % 3 == 0 else [sides]):
            fill = WIDTH - len(ids)
            row = conv_id, turn, part, ids + [0] * fill, [1] * len(ids) + [0] * fill, labels + [-100] * (WIDTH - len(labels))
            for name, value in zip(out, row):
                out[name].append(value)
    return out


def _tokenized_sql(part: int, ids: str, labels: str, where: str) -> str:
    cut = sql.ids(ids, WIDTH)
    ones = f"list_transform({cut}, lambda i: 1)"
    return f"""
SELECT conv_id, turn, {part}::VARCHAR AS part, {sql.joined(sql.pad(cut, WIDTH, 0))} AS input_ids, {sql.joined(sql.pad(ones, WIDTH, 0))} AS attention_mask,
       {sql.joined(sql.pad(sql.ids(labels, WIDTH), WIDTH, -100))} AS labels, NULL::VARCHAR AS error
FROM turns WHERE (conv_id + turn) % 7 <> 0 AND (conv_id + turn) % 5 <> 0 AND {where}"""


@query(f"""
WITH {sql.TURNS}
{_tokenized_sql(0, "src", "tgt", "true")} UNION ALL {_tokenized_sql(1, "tgt", "src", "(conv_id + turn) % 3 = 0")} UNION ALL
SELECT conv_id, turn, NULL, NULL, NULL, NULL, 'ValueError: refused' FROM turns WHERE (conv_id + turn) % 7 = 0""")
def map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ("input_ids", "attention_mask", "labels")
    schema = "conv_id long, turn long, part int, " + ", ".join(f"{c} array<int>" for c in ids)
    mapped = settle(user_map.tokenize_with(inputs.turns(spark, sf_dir), _tokenized, schema), "mapped")
    rows = user_map.made(mapped).select("conv_id", "turn", "part", *(joined(c).alias(c) for c in ids), F.lit(None).cast("string").alias("error")).withColumn("part", F.col("part").cast("string"))
    bad = user_map.failed(mapped).select("conv_id", "turn", F.lit(None).cast("string").alias("part"), *(F.lit(None).cast("string").alias(c) for c in ids), "error")
    return rows.union(bad)


# --- Batches and packing -----------------------------------------------------------------------


@query(f"WITH {sql.LINES} SELECT row_idx, doc_id, row_idx // {BATCH} AS batch_id FROM lines")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.micro_batches(inputs.numbered_lines(spark, sf_dir).drop("file", "text"), BATCH)


RANKED = sql.LINES + """,
sized AS (SELECT row_idx, (strlen(text) + 1)::INT AS length FROM lines),
ranked AS (SELECT *, row_number() OVER (ORDER BY length, row_idx) - 1 AS rank FROM sized)"""


@query(f"""
WITH {RANKED}
SELECT rank // 96 AS batch_id, count(*) AS rows, max(length) AS width, sum(length)::BIGINT AS tokens,
       count(*) * max(length) - sum(length)::BIGINT AS fill
FROM ranked GROUP BY ALL""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = inputs.numbered_lines(spark, sf_dir).select("row_idx", tk.token_count("text").alias("length"))
    sized = settle(sized, "sized")
    return batches.padding_report(batches.length_batches(sized, 96))


def _packed(rows: str, key: str) -> str:
    """Blocks of the ids of all rows joined in key order, the short last one dropped."""
    return f"""
placed AS (SELECT ids, sum(len(ids)) OVER (ORDER BY {key}) - len(ids) AS start FROM {rows}),
stream AS (SELECT start + generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS x FROM placed)
SELECT (i // {BLOCK})::BIGINT AS block_id, string_agg(x, ' ' ORDER BY i) AS input_ids
FROM stream GROUP BY ALL HAVING count(*) = {BLOCK}"""


@query(f"WITH {sql.LINES}, rows AS (SELECT row_idx, {sql.ids('text')} AS ids FROM lines), {_packed('rows', 'row_idx')}")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = settle(inputs.numbered_lines(spark, sf_dir).select("row_idx", "text"), "lines")
    blocks = batches.pack_sequences(lines, "text", BLOCK, in_files=True)
    return blocks.select("block_id", joined("input_ids").alias("input_ids"))


# --- Statistics and scores ---------------------------------------------------------------------


@query(f"""
WITH {sql.NUMBERED}
SELECT row_idx // {BATCH} AS batch_id,
       min(strlen(src))::INT AS src_min, max(strlen(src))::INT AS src_max, round(avg(strlen(src)), 6) AS src_avg,
       min(strlen(tgt))::INT AS tgt_min, max(strlen(tgt))::INT AS tgt_max, round(avg(strlen(tgt)), 6) AS tgt_avg
FROM numbered GROUP BY ALL""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.micro_batches(inputs.numbered_turns(spark, sf_dir), BATCH)
    means = {f"{side}_avg": F.round(f"{side}_avg", 6) for side in ("src", "tgt")}
    return stats.length_stats(rows, by="batch_id").withColumns(means)


@query(f"""
WITH {sql.TURNS}
SELECT count(*) AS pairs, count(*) FILTER (strlen(src) >= {WIDTH}) AS src_cut, count(*) FILTER (strlen(tgt) >= {WIDTH}) AS tgt_cut
FROM turns""")
def cut_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cut_share(inputs.turns(spark, sf_dir), WIDTH)


@query(f"""
WITH {SHARDED}
SELECT split, shard_id, count(*) AS pairs, sum(strlen(src) + strlen(tgt) + 2)::BIGINT AS tokens FROM sharded GROUP BY ALL""")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.split_sides(_row_shards(spark, sf_dir))
    return shards.shard_manifest(rows, tk.token_count("src") + tk.token_count("tgt"))


@query(f"WITH {sql.TURNS} SELECT count(*) AS pairs, least(count(*) // {BATCH}, 10000000 // {BATCH})::BIGINT AS batches FROM turns")
def planned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.planned_batches(inputs.turns(spark, sf_dir), BATCH, 10**7)


def _smoothed(n: int) -> str:
    zeros = " + ".join(f"(m{i} = 0)::INT" for i in range(1, n + 1))
    return f"ln(CASE WHEN m{n} = 0 THEN 1 / (pow(2, {zeros}) * t{n}) ELSE m{n} / t{n} END)"


M_AND_T = ", ".join(f"{x}{n}" for x in "mt" for n in (1, 2, 3, 4))


@query(f"""
WITH {sql.bleu_counts()}
SELECT round(CASE WHEN t4 > 0 AND m1 > 0 THEN 100 * bp * exp(({' + '.join(_smoothed(n) for n in (1, 2, 3, 4))}) / 4)
             ELSE 0 END, 6) AS bleu, {M_AND_T}, hyp_len, ref_len
FROM counts""")
def bleu_sacre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.bleu_sacre(inputs.eval_texts(spark, sf_dir)).withColumn("bleu", F.round("bleu", 6))


SHARES = ", ".join(f"round(CASE WHEN t{n} > 0 THEN m{n} / t{n} ELSE 0 END, 6) AS p{n}" for n in (1, 2, 3, 4))


@query(f"""
WITH {sql.bleu_counts()}
SELECT round(CASE WHEN least(m1, m2, m3, m4) > 0
             THEN bp * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) ELSE 0 END, 6) AS bleu,
       {SHARES}, round(bp, 6) AS brevity_penalty,
       round(CASE WHEN ref_len > 0 THEN hyp_len / ref_len ELSE 0 END, 6) AS length_ratio, hyp_len, ref_len
FROM counts""")
def bleu_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores.bleu_plain(inputs.eval_texts(spark, sf_dir))
    return scored.select(*[c if c.endswith("_len") else F.round(c, 6).alias(c) for c in scored.columns])


SACRE = f"""
SELECT round(CASE WHEN t4 > 0 AND m1 > 0 THEN 100 * bp * exp(({' + '.join(_smoothed(n) for n in (1, 2, 3, 4))}) / 4)
             ELSE 0 END, 6) AS bleu, {M_AND_T}, hyp_len, ref_len
FROM counts"""


@query(f"WITH {sql.bleu_counts()} {SACRE}")
def score_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = inputs.eval_texts(spark, sf_dir)
    # Ids outside the vocabulary are put between the real ones, and ignored labels at the end.
    between = lambda x, i: F.when(i % 7 == 0, F.array(F.lit(999_999), F.lit(-3), x)).otherwise(F.array(x))
    ids = texts.select(
        "id",
        F.flatten(F.transform(tk.token_ids("hyp"), between)).alias("preds"),
        F.concat(tk.token_ids("ref"), F.array_repeat(F.lit(-100), 5)).alias("labels"),
    )
    return flows.score_ids(ids).withColumn("bleu", F.round("bleu", 6))


SFT_TEXTS = """
  SELECT id, reference AS ref,
         array_to_string(list_filter(string_split(reference, ' '), lambda w, i: i % 5 <> 0), ' ') AS hyp
  FROM sft WHERE split = 'test'"""


@query(f"""
WITH {SFT_ROWS}, {sql.bleu_counts(SFT_TEXTS)}
SELECT round(CASE WHEN least(m1, m2, m3, m4) > 0
             THEN bp * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) ELSE 0 END, 6) AS bleu,
       {SHARES}, round(bp, 6) AS brevity_penalty,
       round(CASE WHEN ref_len > 0 THEN hyp_len / ref_len ELSE 0 END, 6) AS length_ratio, hyp_len, ref_len
FROM counts""")
def score_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(flows.sft_rows(inputs.numbered_pairs(spark, sf_dir)), "sft")
    words = F.filter(F.split("reference", " "), lambda w, i: (i + 1) % 5 != 0)
    predictions = rows.select("id", F.array_join(words, " ").alias("prediction"))
    scored = flows.score_sft(rows, predictions)
    return scored.select(*[c if c.endswith("_len") else F.round(c, 6).alias(c) for c in scored.columns])


@query("""
SELECT event_type AS run, count(*) AS steps, count(*) FILTER (value > 24 * 0.85) AS alerts, max(value) AS peak
FROM events WHERE event_id % 100 = 0 GROUP BY ALL""")
def device_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.device_alerts(inputs.steps(spark, sf_dir).drop("ts"), "4090")


TRACE = f"""
trace AS (
  SELECT event_type AS run, event_id AS step, value,
         max(value) OVER (PARTITION BY event_type ORDER BY event_id) AS peak,
         value > {CAPACITY} * 0.85 AS alert, ts
  FROM events WHERE event_id % 100 = 0
)"""


@query(f"""
WITH {TRACE}, begins AS (SELECT event_type AS run, min(ts) AS begin FROM events GROUP BY ALL)
SELECT run, step, value, peak, alert, round((epoch_us(ts) - epoch_us(begin)) / 1e6, 6) AS elapsed
FROM trace JOIN begins USING (run)""")
def peak_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = traces.peak_trace(inputs.steps(spark, sf_dir), CAPACITY, time="ts").drop("ts")
    return trace.withColumn("elapsed", F.round("elapsed", 6))


@query(f"""
WITH {TRACE}
SELECT run, count(*) AS steps, count(*) FILTER (alert) AS alerts, max(value) AS peak FROM trace GROUP BY ALL""")
def peak_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.peak_alerts(traces.peak_trace(inputs.steps(spark, sf_dir).drop("ts"), CAPACITY))


# --- Numbering, sharding and splitting ---------------------------------------------------------


@query(f"WITH {sql.LINES} SELECT row_idx::VARCHAR AS id, doc_id, text FROM lines")
def running_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.running_id(inputs.numbered_lines(spark, sf_dir)).select("id", "doc_id", "text")


@query(f"WITH {SHARDED} SELECT row_idx, shard_id FROM sharded")
def shard_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.numbered_turns(spark, sf_dir).select("row_idx")
    return shards.shard_by_rows(rows, SHARD_ROWS, BATCH)


@query(f"""
WITH RECURSIVE {sql.LINES},
cut AS (SELECT row_idx, row_idx // {BATCH} AS batch_id, strlen(text) + 1 AS n FROM lines),
weights AS (SELECT batch_id, sum(n)::BIGINT AS weight FROM cut GROUP BY ALL),
{sql.greedy('weights', SHARD_TOKENS)}
SELECT shard_id::BIGINT AS shard_id, min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) AS pairs, sum(n)::BIGINT AS tokens
FROM cut JOIN folded USING (batch_id) GROUP BY ALL""")
def shard_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = inputs.numbered_lines(spark, sf_dir).select("row_idx", tk.token_count("text").alias("n"))
    cut = batches.micro_batches(settle(sized, "sized"), BATCH)
    sharded = shards.shard_by_weight(cut, shards.batch_weights(cut, F.col("n")), SHARD_TOKENS)
    return sharded.groupBy("shard_id").agg(
        F.min("row_idx").alias("first_row"),
        F.max("row_idx").alias("last_row"),
        F.count("*").alias("pairs"),
        F.sum("n").cast("long").alias("tokens"),
    )


@query(f"WITH {RANKED} SELECT rank, row_idx, length FROM ranked")
def length_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = inputs.numbered_lines(spark, sf_dir).select("row_idx", tk.token_count("text").alias("n"))
    ordered = order.length_sort(settle(sized, "sized"), F.col("n")).drop("n")
    # The ranks tell the order in which the rows were written, not an order of their values.
    place = {"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    written = settle(ordered.withColumns(place), "sorted")
    return order.index_rows(written, ["task", "at"], column="rank").drop("task", "at")


@query(f"WITH {SHARDED} SELECT row_idx, split FROM sharded")
def split_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_shards(spark, sf_dir).select("row_idx", "split")


@query(f"""
WITH {sql.LINES}, keyed AS (SELECT doc_id || '-' || pos AS id FROM doc_lines), divided AS ({sql.split_of('keyed', 'id')})
SELECT id, split FROM divided""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.doc_lines(spark, sf_dir).select(F.concat_ws("-", "doc_id", "pos").alias("id"))
    return splits.random_split(settle(lines, "ids"))


# --- Whole flows -------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {FILE_PAIRS},
weights AS (SELECT batch_id, count(*) AS weight FROM cut GROUP BY ALL),
{sql.greedy('weights', 100)}
SELECT CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END AS split, shard_id::BIGINT AS shard_id, count(*) AS pairs,
       sum(strlen(src) + strlen(tgt) + 2)::BIGINT AS tokens
FROM cut JOIN folded USING (batch_id) GROUP BY ALL""")
def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = open_parallel_text(spark, inputs.line_files(spark, sf_dir), "src", "tgt", batch=BATCH)
    rows = tx.split_sides(flows.raw_shards(text, rows=100))
    return shards.shard_manifest(rows, tk.token_count("src") + tk.token_count("tgt"))


PROMPT = "'translate English to Korean: ' || src"


@query(f"""
WITH RECURSIVE {sql.BLANKS},
kept AS (SELECT *, row_idx // {BATCH} AS batch_id FROM blanks WHERE {sql.FILLED} ORDER BY row_idx LIMIT 10000000),
counts AS (SELECT batch_id AS b, count(*) * 64 AS weight FROM kept GROUP BY ALL),
weights AS (SELECT row_number() OVER (ORDER BY b) - 1 AS batch_id, b, weight FROM counts),
{sql.greedy('weights', 5000)},
sharded AS (
  SELECT k.row_idx, f.shard_id::BIGINT AS shard_id, {sql.ids(PROMPT, 64)} AS s, {sql.ids('tgt', 64)} AS t
  FROM kept k JOIN weights w ON w.b = k.batch_id JOIN folded f ON f.batch_id = w.batch_id
)
SELECT CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END AS split, shard_id, row_idx,
       {sql.joined(sql.pad('s', 64, 0))} AS input_ids, {sql.joined(sql.mask('s', 64))} AS attention_mask,
       {sql.joined(sql.pad('t', 64, 0))} AS labels
FROM sharded""")
def token_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.with_blanks(inputs.numbered_turns(spark, sf_dir)).select("row_idx", "src", "tgt")
    rows = flows.token_shards(pairs, batch=BATCH, max_length=64, budget=5000)
    arrays = [joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    return rows.select("split", "shard_id", "row_idx", *arrays)


@query(f"""
WITH {SFT_ROWS},
fit AS (SELECT split, row_idx, src, tgt, (strlen(src) + 1)::INT AS length FROM divided WHERE strlen(src) < 512 AND strlen(tgt) < 512),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY length, row_idx) - 1 AS rank FROM fit),
ids AS (SELECT *, rank // {BATCH} AS batch_id, {sql.ids('src', WIDTH)} AS s, {sql.ids('tgt', WIDTH)} AS t FROM ranked),
wide AS (
  SELECT *, max(len(s)) OVER (PARTITION BY split, batch_id) AS sw, max(len(t)) OVER (PARTITION BY split, batch_id) AS tw FROM ids
)
SELECT split, batch_id, rank, row_idx, length, {sql.joined(sql.pad('s', 'sw', 0))} AS input_ids,
       {sql.joined(sql.mask('s', 'sw'))} AS attention_mask, {sql.joined(sql.pad('t', 'tw', -100))} AS labels
FROM wide""")
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows.training_batches(inputs.numbered_pairs(spark, sf_dir), batch=BATCH, max_length=WIDTH)
    return rows.withColumns({c: joined(c) for c in ("input_ids", "attention_mask", "labels")})


@query(f"""
WITH {SFT_ROWS},
fit AS (SELECT split, row_idx, src, tgt, (strlen(src) + 1)::INT AS length FROM divided WHERE strlen(src) < 512 AND strlen(tgt) < 512),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY length, row_idx) - 1 AS rank FROM fit)
SELECT split, rank // 96 AS batch_id, row_idx, length,
       max(length) OVER (PARTITION BY split, rank // 96) AS width FROM ranked""")
def profile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows.training_batches(inputs.numbered_pairs(spark, sf_dir), profile="A100_80")
    return rows.select("split", "batch_id", "row_idx", "length", F.size("input_ids").alias("width"))


@query(f"WITH {SFT_ROWS} SELECT split, row_idx, id, text, prompt, reference FROM sft")
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sft_rows(inputs.numbered_pairs(spark, sf_dir))


@query(f"""
WITH {SFT_ROWS}, rows AS (SELECT row_idx, {sql.ids('text')} AS ids FROM sft WHERE split = 'train'), {_packed('rows', 'row_idx')}""")
def sft_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = flows.sft_blocks(flows.sft_rows(inputs.numbered_pairs(spark, sf_dir)), BLOCK)
    return blocks.select("block_id", joined("input_ids").alias("input_ids"))
