"""Pieces of the SQL that the queries are compared with."""

from __future__ import annotations

# Fixed values of the public 13a words, written out again so that a slip in the engine's own shows.
REPLACEMENTS = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
PATTERNS = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]

# The whitespace of functions.text in the pattern syntax of the SQL engine.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"

TURNS = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""
NUMBERED = TURNS + """,
numbered AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx, * FROM turns)"""

BLANKED = """
  CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE src END AS src,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE tgt END AS tgt"""
BLANKS = NUMBERED + f""",
blanks AS (SELECT row_idx, conv_id, turn, {BLANKED} FROM numbered)"""
FILLED = "coalesce(src, '') <> '' AND coalesce(tgt, '') <> ''"

ARROWS = TURNS + """,
arrows AS (
  SELECT conv_id, turn, CASE
    WHEN (conv_id + turn) % 5 = 0 THEN tgt
    WHEN (conv_id + turn) % 3 = 0 THEN src || ' => ' || tgt || ' => ' || src
    WHEN (conv_id + turn) % 2 = 0 THEN src || '=>' || tgt
    ELSE src || ' => ' || chr(12288) || tgt || chr(9) END AS text
  FROM turns
)"""

LINES = """
doc_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
),
lines AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS row_idx, * FROM doc_lines)"""
SIDES = LINES + """,
sides AS (
  SELECT source AS file_pair, lang, text,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id, pos) - 1 AS line_no
  FROM doc_lines
),
zipped AS (
  SELECT file_pair, s.line_no, s.text AS src, t.text AS tgt
  FROM sides s JOIN sides t USING (file_pair, line_no) WHERE s.lang = 'en' AND t.lang = 'fr'
)"""


def strip(c: str) -> str:
    """Text without Unicode whitespace at its ends."""
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def ids(c: str, max_length: int | None = None) -> str:
    """Byte ids and the end mark."""
    digits = f"hex(encode({c}))"
    if max_length is not None:
        digits = f"substr({digits}, 1, {2 * (max_length - 1)})"
    return f"list_append(list_transform(regexp_extract_all({digits}, '..'), lambda h: ('0x' || h)::INT + 3), 1)"


def pad(c: str, width: int | str, value: int) -> str:
    """A list filled up to a width."""
    return f"list_concat({c}, list_transform(range(0, greatest({width} - len({c}), 0)), lambda i: {value}))"


def mask(c: str, width: int | str) -> str:
    """Ones for the ids and zeros for the fill."""
    return f"list_transform(range(0, {width}), lambda i: (i < len({c}))::INT)"


def joined(c: str) -> str:
    """A list as text."""
    return f"array_to_string({c}, ' ')"


def digest(key: str, seed: int = 0) -> str:
    """The hash that ranks rows for a random split."""
    return f"md5(concat_ws('|', '{seed}', {key}))"


def split_of(source: str, key: str, test_size: float = 0.2, seed: int = 0) -> str:
    """All columns of a source with their random split."""
    return f"""
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {digest(key, seed)}, {key})
                      <= ceil({test_size}::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM {source}"""


def greedy(weights: str, budget: int) -> str:
    """Recursive fold of ``(batch_id, weight)`` rows into shards; batches are numbered from 0."""
    return f"""
folded AS (
  SELECT batch_id, 0 AS shard_id, weight AS filled FROM {weights} WHERE batch_id = 0
  UNION ALL
  SELECT w.batch_id, f.shard_id + (f.filled >= {budget})::INT,
         CASE WHEN f.filled >= {budget} THEN 0 ELSE f.filled END + w.weight
  FROM folded f JOIN {weights} w ON w.batch_id = f.batch_id + 1
)"""


def words(c: str) -> str:
    """The 13a words of a text."""
    for old, new in REPLACEMENTS:
        old, new = (x.replace("\n", "'||chr(10)||'") for x in (old, new))
        c = f"replace({c}, '{old}', '{new}')"
    c = f"' ' || {c} || ' '"
    for pattern, new in PATTERNS:
        c = f"regexp_replace({c}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda w: w <> '')"


EVAL_TEXTS = """
  SELECT concat_ws('-', conv_id, turn) AS id, text AS ref,
         array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 5 <> 0), ' ') AS hyp
  FROM conversations WHERE role = 'assistant'"""


def bleu_counts(texts: str = EVAL_TEXTS) -> str:
    """CTEs ending in ``counts``: matches, totals and lengths of ``(id, ref, hyp)`` texts."""
    grams = " UNION ALL ".join(
        f"SELECT id, side, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), "
        f"lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM worded"
        for n in (1, 2, 3, 4)
    )
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN n = {n} THEN {value} END), 0)::BIGINT AS {name}{n}"
        for name, value in (("m", "least(h, r)"), ("t", "h"), ("r", "r"))
        for n in (1, 2, 3, 4)
    )
    return f"""
texts AS ({texts}),
worded AS (
  SELECT id, 'h' AS side, {words('hyp')} AS w FROM texts
  UNION ALL SELECT id, 'r', {words('ref')} FROM texts
),
grams AS ({grams}),
clipped AS (
  SELECT id, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
  FROM grams GROUP BY ALL
),
counts AS (SELECT {sums}, t1 AS hyp_len, r1 AS ref_len,
  CASE WHEN hyp_len = 0 THEN 0 WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len) END AS bp
  FROM clipped)"""
