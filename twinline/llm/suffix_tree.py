"""Language-model scores by a probabilistic suffix tree.

The symbols are the bytes of the words, a space after each word, and a line feed
for the end of the text. A context, up to ``DEPTH`` symbols, is a candidate when
it occurs ``LEAST`` times, however large the corpus: a language or a domain with a small
share of the bytes keeps its contexts. It is retained when its
next-symbol distribution diverges from that of the context one symbol shorter by
more than chance allows (a likelihood-ratio test), together with all its
suffixes. Distributions are smoothed into those of the shorter contexts
(Witten-Bell), down to single symbols, none of which has probability zero. The
longest retained suffix at each position gives a symbol's probability, and the symbols of
a token, with the space after it, that of the token in its place. The tree spells any token;
tokens met in training are also expected as a whole, in the mixture
``(1 - NEW) * ((1 - MIX) * c / N + MIX * spelled)``: c is the token's count and N that of all
tokens. All tokens never met are one class, as they are for the base; its probability NEW is the
share of training tokens that were met once.

Counting covers all training texts; equal contexts are counted together before
they move. Candidates are tested by joins of tables of contexts, which grow with the
corpus. What has passed is sent to every task as a table of states by symbols, of ``CELLS`` cells
at most, which bounds a task's memory. Should more contexts pass, those with the largest likelihood
ratios are sent, and the rest stay a table of contexts in Spark. The task then knows at which symbols
a longer context of the rest holds, and asks for them: each symbol with the ``DEPTH`` before it once
for all texts of a unit of ``UNIT`` bytes. Joins with the rest answer, and the unit is scored with the
answers. So every retained context scores, wherever it is held. Scoring runs through a table of
states, many pieces of texts at a time; a piece starts with the ``DEPTH`` symbols before it, which
fix its state.

Beside it stands a base of single tokens. Tokens that make up at least the share
``COMMON`` of the training tokens, at most ``1 / COMMON``, are looked up in the
task; all others are joined with the vocabulary.

Rows: a null or empty text is its end token; rows with a null key are in neither
part held out; repeated rows are scored each; without training rows symbols are
equally likely.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm.words import ascii_words
from twinline.session import settle

DEPTH = 5
LEAST = 32  # occurrences of a context
CELLS = 12_000_000  # of the table that a task scores by
COMMON = 5e-7
MIX = 0.5  # weight of the tree beside whole tokens
DOUBT = 3.0  # standard deviations above the mean of the likelihood ratio by chance
END = b"\n"
COUNTED = 1 << 21  # bytes whose contexts are counted at once
HELD = 1 << 20  # different contexts that a task holds
BATCH = 1_000  # rows handed to Python at once
SCORED_AT_ONCE = 1 << 18  # tokens
PIECE = 512  # bytes scored as one piece
UNIT = 1 << 23  # bytes of texts that ask together for symbols beyond the table


def stream(words: list[bytes]) -> bytes:
    return b" ".join([*words, END])


# Counting


def _contexts(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """``(key, n)``: key has the nearest symbol of the context first, then farther ones, and the next symbol last."""
    lead = END * depth
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def counted(parts: list[bytes]) -> np.ndarray:
        symbols = np.frombuffer(b"".join(parts), np.uint8)
        own = np.ones(len(symbols), bool)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        own[(starts[:, None] + np.arange(depth)).ravel()] = False
        found = symbols.astype(np.int64)
        for d in range(1, depth + 1):
            found[d:] |= symbols[:-d].astype(np.int64) << 8 * (depth + 1 - d)
        found = found[own]
        found.sort()
        return found

    def merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.flatnonzero(more[1:] != more[:-1]) + 1])
        keys = np.concatenate([keys, more[at]])
        counts = np.concatenate([counts, np.diff(np.append(at, len(more)))])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        return keys[at], np.add.reduceat(counts, at)

    def given(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    parts, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            parts.append(lead + stream(ascii_words(text.as_py())))
            held += len(parts[-1])
            if held >= COUNTED:
                keys, counts = merged(keys, counts, counted(parts))
                parts, held = [], 0
                if len(keys) >= HELD:
                    yield given(keys, counts)
                    keys, counts = keys[:0], counts[:0]
    if parts:
        keys, counts = merged(keys, counts, counted(parts))
    yield given(keys, counts)


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            found.update(ascii_words(text.as_py()))
            found[END] += 1
            if len(found) >= HELD // 4:
                yield counted(found)
                found = Counter()
    yield counted(found)


# The tree


@dataclass(frozen=True)
class Tree:
    """States by depth, the root first; see :class:`Table` for what a task makes of them.

    ``contexts`` are keys without the next symbol; ``suffix`` and ``prefix`` are
    the states without the farthest and without the nearest symbol; ``edges`` are
    counts of next symbols by state. ``openings`` are the cells, state and farther symbol, of the
    retained contexts that are one symbol longer than a state and no states themselves.
    """

    depth: int
    alphabet: np.ndarray
    contexts: np.ndarray
    depths: np.ndarray
    suffix: np.ndarray
    prefix: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    edges: tuple[np.ndarray, np.ndarray, np.ndarray]
    retained: np.ndarray
    openings: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Rest:
    """Retained contexts that are no states: ``(d, context, total, kinds)``, and their counts ``(d, key, n)``."""

    contexts: DataFrame
    counts: DataFrame


def _masks(depth: int) -> list[int]:
    """By depth, the bits of a key that hold its context and next symbol."""
    return [sum(255 << 8 * (depth + 1 - i) for i in range(1, d + 1)) | 255 for d in range(depth + 1)]


def _distributions(parts, depths: np.ndarray) -> np.ndarray:
    """Smoothed next-symbol probabilities of all states; the last column is any one symbol never met."""
    alphabet, suffix, totals, kinds, (state, symbol, count) = parts
    width = len(alphabet) + 1
    table = np.zeros((len(totals), width), np.float32)
    kept = np.bincount(state, count, len(totals))
    root = kept[0] + 128
    table[0] = 0.5 / root
    at = state == 0
    table[0, symbol[at]] = (count[at] + 0.5) / root
    for d in range(1, int(depths.max()) + 1):
        level = np.flatnonzero(depths == d)
        shorter = kinds[level] + totals[level] - kept[level]  # rare symbols are left to the shorter context
        table[level] = table[suffix[level]] * shorter[:, None]
        at = np.flatnonzero(depths[state] == d)
        table[state[at], symbol[at]] += count[at]
        table[level] /= (totals[level] + kinds[level])[:, None]
    return table


def _tested(cuts: DataFrame, depth: int, least: int, doubt: float, keep: list[int]) -> tuple[DataFrame, DataFrame]:
    """``(d, context, total, kinds)`` of all candidates, and ``(d, context, ratio)`` of those that diverge from their suffix."""
    contexts = cuts.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = settle(contexts.filter((F.col("total") >= least) | (F.col("d") == 0)), "candidates")
    shares = cuts.join(contexts, ["d", "context"]).withColumn("share", F.col("n") / F.col("total"))
    shares = settle(shares.select("d", "context", "key", "n", "kinds", "share"), "shares")
    shorter = F.element_at(F.array(*(F.lit(k) for k in keep)), F.col("d")).bitwiseAND(F.col("key"))  # keep[d - 1]
    own = shares.filter("d > 0").withColumn("key", shorter).withColumn("d", F.col("d") - 1)
    expected = shares.select("d", "key", F.col("share").alias("expected"))
    gain = F.sum(F.col("n") * F.log(F.col("share") / F.col("expected")))
    tested = own.join(expected, ["d", "key"]).groupBy((F.col("d") + 1).alias("d"), "context", "kinds").agg((2 * gain).alias("ratio"))
    freedom = F.greatest(F.col("kinds") - 1, F.lit(1))
    passed = tested.filter(F.col("ratio") > freedom + doubt * F.sqrt(2 * freedom))
    return contexts, settle(passed.select("d", "context", "ratio"), "passed")


def _closed(passed: DataFrame, depth: int, keep: list[int], shifts: int) -> DataFrame:
    """``(d, context)`` of the parts of the contexts without fewer than ``shifts`` of their nearest symbols.

    One shift gives the suffixes, ``depth`` shifts all parts: without any of them a state could not be reached, or not be left.
    """
    part = lambda i, d: F.struct(F.lit(d).alias("d"), F.shiftleft("context", 8 * i).bitwiseAND(keep[d] & ~255).alias("context"))
    parts = F.array(*(F.when(F.col("d") >= i + d, part(i, d)) for i in range(shifts) for d in range(1, depth + 1 - i)))
    return passed.select(F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("part")).select("part.*").distinct()


def grow(counts: DataFrame, depth: int = DEPTH, least: int = LEAST, doubt: float = DOUBT, cells: int = CELLS) -> Tree:
    """The tree of all counted contexts ``(key, n)``, as far as a task holds it."""
    return divide(counts, depth, least, doubt, cells)[0]


def divide(
    counts: DataFrame, depth: int = DEPTH, least: int = LEAST, doubt: float = DOUBT, cells: int = CELLS
) -> tuple[Tree, Rest | None]:
    """The tree of all counted contexts ``(key, n)`` as far as a task holds it, and the rest, if any."""
    keep = _masks(depth)
    cut = F.array(*(F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(keep[d]).alias("key")) for d in range(depth + 1)))
    cuts = counts.select("n", F.explode(cut).alias("cut")).groupBy("cut.d", "cut.key").agg(F.sum("n").alias("n"))
    cuts = settle(cuts.withColumn("context", F.col("key").bitwiseAND(~255)), "contexts")
    contexts, passed = _tested(cuts, depth, least, doubt, keep)
    retained = settle(_closed(passed, depth, keep, 1), "retained")
    symbols = cuts.filter("d = 0").count()
    few, room = passed, cells // (symbols + 1)
    states = settle(_closed(few, depth, keep, depth), "states")
    while (found := states.count()) > room:  # each turn leaves a task's table smaller
        few = settle(passed.orderBy(F.desc("ratio"), "d", "context").limit(max(1, int(0.9 * few.count() * room / found))), "largest")
        states = settle(_closed(few, depth, keep, depth), "states")
    states = states.union(contexts.filter("d = 0").select("d", "context")).join(contexts, ["d", "context"])
    states = settle(states.join(retained.withColumn("own", F.lit(True)), ["d", "context"], "left"), "states")
    rest, longer = None, np.empty(0, np.int64)
    if few is not passed:
        beyond = settle(retained.join(states, ["d", "context"], "left_anti").join(contexts, ["d", "context"]), "rest")
        rest = Rest(beyond, settle(cuts.join(beyond.select("d", "context"), ["d", "context"]).select("d", "key", "n"), "rest"))
        shorter = F.element_at(F.array(*(F.lit(k & ~255) for k in keep)), F.col("d")).bitwiseAND(F.col("context"))  # keep[d - 1]
        next_to = beyond.select(
            F.shiftleft(F.col("d").cast("long"), 56).bitwiseOR(F.col("context")).alias("name"), (F.col("d") - 1).alias("d"), shorter.alias("context")
        )
        longer = next_to.join(states, ["d", "context"], "left_semi").select("name").toArrow()["name"].to_numpy()
    kept = states.orderBy("d", "context").toArrow().to_pandas()
    joined = cuts.join(states.select("d", "context"), ["d", "context"])
    joined = joined.select("d", "context", F.col("key").bitwiseAND(255).alias("symbol"), "n").toArrow().to_pandas()
    alphabet = np.unique(joined.loc[joined.d == 0, "symbol"].to_numpy(np.int64))
    if not len(kept):
        kept.loc[0] = [0, 0, 0, 0, None]
    depths, contexts = kept.d.to_numpy(np.int64), kept.context.to_numpy(np.int64)
    names = depths << 56 | contexts

    def places(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, wanted).clip(max=len(names) - 1)
        return np.where(names[at] == wanted, at, -1)

    shorter = np.array([0, *keep[:-1]])[depths] & ~255
    suffix = places(np.maximum(depths - 1, 0) << 56 | contexts & shorter)
    prefix = places(np.maximum(depths - 1, 0) << 56 | contexts << 8 & keep[-1] & ~255)
    state = places(joined.d.to_numpy(np.int64) << 56 | joined.context.to_numpy(np.int64))
    column = np.searchsorted(alphabet, joined.symbol.to_numpy(np.int64))
    edges = state.astype(np.int32), column.astype(np.int16), joined.n.to_numpy(np.int64)
    own = (kept.own == True).to_numpy(bool)  # noqa: E712  null is not retained
    own[0] = True
    d, longer = longer >> 56, longer & keep[-1]
    farther = np.searchsorted(alphabet, longer >> 8 * (depth + 1 - d) & 255)
    openings = places(d - 1 << 56 | longer & np.array([0, *keep[:-1]])[d] & ~255) * (len(alphabet) + 1) + farther
    totals, kinds = kept.total.to_numpy(np.int64), kept.kinds.to_numpy(np.int64)
    return Tree(depth, alphabet, contexts, depths, suffix, prefix, totals, kinds, edges, own, openings), rest


class Table:
    """Dense transitions and log10 probabilities of a tree, for one worker."""

    _made: dict[str, Table] = {}

    def __init__(self, tree: Tree):
        n, self.width = len(tree.totals), len(tree.alphabet) + 1
        column = np.full(256, self.width - 1, np.uint8)
        column[tree.alphabet] = np.arange(self.width - 1)
        self.column = column
        moves = np.zeros((n, self.width), np.int32)
        nearest = column[tree.contexts >> 8 * tree.depth & 255]
        longest = np.arange(n)
        for d in range(int(tree.depths.max()) + 1):
            level = np.flatnonzero(tree.depths == d)
            if d:
                moves[level] = moves[tree.suffix[level]]
                longest[level] = np.where(tree.retained[level], level, longest[tree.suffix[level]])
            child = np.flatnonzero((tree.depths == d + 1) & (tree.prefix >= 0))
            moves[tree.prefix[child], nearest[child]] = child
        parts = tree.alphabet, tree.suffix, tree.totals, tree.kinds, tree.edges
        self.moves = (moves * self.width).ravel()
        self.gain = np.log10(_distributions(parts, tree.depths))[longest].ravel()
        self.depths, self.open = tree.depths, None
        if len(tree.openings):
            self.open = np.zeros(n * self.width, bool)
            self.open[tree.openings] = True

    @classmethod
    def of(cls, tree: Tree) -> Table:
        if tree.name not in cls._made:
            cls._made.clear()
            cls._made[tree.name] = cls(tree)
        return cls._made[tree.name]

    def spell(self, texts: list[bytes], depth: int) -> np.ndarray:
        """log10 probability of each symbol of all texts, one after the other."""
        return self.trace(texts, depth)[0]

    def trace(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, and what is left to the rest: 0, or one more than the state's depth where a longer context holds."""
        pieces = []
        for text in texts:
            text = END * depth + text
            pieces += [text[at : at + depth + PIECE] for at in range(0, len(text) - depth, PIECE)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((depth + PIECE, len(pieces)), np.uint8)
        flat = self.column[np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)]
        ends = np.cumsum(lengths[order])
        for lane, (a, b) in enumerate(zip((ends - lengths[order]).tolist(), ends.tolist())):
            grid[: b - a, lane] = flat[a:b]
        active = np.searchsorted(-lengths[order], -np.arange(depth + PIECE), side="left")
        state, gains = np.zeros(len(pieces), np.int32), np.zeros((PIECE, len(pieces)), np.float32)
        left, lane = np.zeros(gains.shape if self.open is not None else (PIECE, 0), np.uint8), np.arange(len(pieces))
        for t, row in enumerate(grid):
            n = active[t]
            cell = state[:n] + row[:n]
            if t >= depth:
                gains[t - depth, :n] = self.gain[cell]
            if t >= depth and self.open is not None:
                deep = self.depths[state[:n] // self.width]
                left[t - depth, :n] = (deep + 1) * self.open[state[:n] + grid[t - 1 - deep, lane[:n]]]
            state[:n] = self.moves[cell]
        lanes = np.empty(len(pieces), np.int64)
        lanes[order] = np.arange(len(pieces))
        own = np.arange(PIECE) < (lengths - depth)[:, None]
        return gains.T[lanes][own], left.T[lanes][own] if self.open is not None else np.zeros(0, np.uint8)


# Scoring

SCORED = (
    "row long, key long, held_out boolean, n_tokens long, n_common long, base double, score double, "
    "rare array<struct<word:binary,spelled:double>>"
)
ASKED = "unit long, row long, key long, held_out boolean, text string, symbol long, gain float"


@dataclass(frozen=True)
class Model:
    """The tree, the counts of common tokens, and the totals of all training tokens."""

    tree: Tree
    common: dict[bytes, int]
    tokens: int
    kinds: int
    once: int
    mix: float = MIX

    @property
    def new(self) -> float:
        """Probability of a token never met, kept above zero and below one."""
        return (self.once + 0.5) / (self.tokens + 1)

    @property
    def known(self) -> float:
        return 1 - self.new

    @property
    def norm(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.kinds + 1)))


def _keys(texts: list[bytes], at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Keys, as counted, of symbols left to the rest, with the depth of the table's state in the highest byte."""
    symbols = np.frombuffer(b"".join(END * depth + text for text in texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    place = at + depth * (1 + np.searchsorted(ends, at, side="right"))
    found = symbols[place] | left[at].astype(np.int64) - 1 << 56
    for d in range(1, depth + 1):
        found |= symbols[place - d].astype(np.int64) << 8 * (depth + 1 - d)
    return found


def _ask(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The rows with their unit, and for each unit the symbols left to the rest, with their gains by the table alone."""
    tree = model.tree
    table = Table.of(tree)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.float32()]
    names = [x.split()[0] for x in ASKED.split(", ")]

    def given(n: int, unit: int, columns: list) -> pa.RecordBatch:
        columns = [pa.array(np.full(n, unit)), *columns]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def met(texts: list[bytes], keys: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, left = table.trace(texts, tree.depth)
        at = np.flatnonzero(left)
        keys, one = np.unique(np.concatenate([keys, _keys(texts, at, left, tree.depth)]), return_index=True)
        return keys, np.concatenate([gains, found[at]])[one]

    none = np.empty(0, np.int64), np.empty(0, np.float32)
    unit, size, known = None, 0, none
    for batch in batches:
        texts, held = [], 0
        for row, text in zip(batch.column(0), batch.column(3)):
            unit = row.as_py() if unit is None else unit
            texts.append(stream(ascii_words(text.as_py())))
            held += len(texts[-1])
            if held >= COUNTED:
                known, size = met(texts, *known), size + held
                texts, held = [], 0
        if texts:
            known, size = met(texts, *known), size + held
        if batch.num_rows:
            yield given(batch.num_rows, unit, [*batch.columns, None, None])
        if size >= UNIT:
            yield given(len(known[0]), unit, [None] * 4 + list(known))
            unit, size, known = None, 0, none
    if unit is not None:
        yield given(len(known[0]), unit, [None] * 4 + list(known))


def _score(batches: Iterable[pa.RecordBatch], model: Model, answers: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    tree, find = model.tree, model.common.get
    table = Table.of(tree)
    schema = pa.schema(
        [("row", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_common", pa.int64())]
        + [("base", pa.float64()), ("score", pa.float64())]
        + [("rare", pa.list_(pa.struct([("word", pa.binary()), ("spelled", pa.float64())])))]
    )

    def scored(rows: list[tuple], tokens: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        every = [w for words in tokens for w in words]
        counts = np.fromiter((find(w, 0) for w in every), np.float64, len(every))
        ends = np.cumsum(np.fromiter((len(w) + (w != END) for w in every), np.int64, len(every)))
        texts = [b" ".join(words) for words in tokens]
        gains, left = table.trace(texts, tree.depth)
        if len(at := np.flatnonzero(left)):
            gains[at] = answers[1][np.searchsorted(answers[0], _keys(texts, at, left, tree.depth))]
        total = np.concatenate([[0.0], np.cumsum(gains, dtype=np.float64)])
        spelled = np.diff(total[np.concatenate([[0], ends])])
        seen = counts > 0
        gain, base = np.zeros(len(every)), np.zeros(len(every))
        base[seen] = np.log10(counts[seen] + 0.5) - model.norm
        share = (1 - model.mix) * counts[seen] / max(model.tokens, 1)
        gain[seen] = np.log10(model.known * (share + model.mix * 10 ** spelled[seen]))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rare = []
        for a, n in zip(first.tolist(), sizes.tolist()):
            at = a + np.flatnonzero(~seen[a : a + n])
            rare.append([{"word": every[i], "spelled": x} for i, x in zip(at.tolist(), spelled[at].tolist())])
        add = lambda x: np.add.reduceat(x, first)
        values = *zip(*rows), sizes, add(seen.astype(np.int64)), add(base), add(gain), rare
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        rows, tokens, held = [], [], 0
        for *row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            tokens.append([*ascii_words(text.as_py()), END])
            rows.append(row)
            held += len(tokens[-1])
            if held >= SCORED_AT_ONCE:
                yield scored(rows, tokens)
                rows, tokens, held = [], [], 0
        if rows:
            yield scored(rows, tokens)


def _answers(asked: DataFrame, rest: Rest, depth: int) -> DataFrame:
    """``(symbol, gain)`` of all symbols asked for, by the contexts of the rest that are suffixes."""
    symbols = asked.groupBy("symbol").agg(F.min("gain").alias("gain"))
    deeper = F.explode(F.sequence(F.shiftright("symbol", 56).cast("int") + 1, F.lit(depth)))
    own = F.element_at(F.array(*map(F.lit, _masks(depth))), F.col("d") + 1).bitwiseAND(F.col("symbol"))
    levels = symbols.select("symbol", "gain", deeper.alias("d")).withColumn("key", own)
    levels = levels.withColumn("context", F.col("key").bitwiseAND(~255)).join(rest.contexts, ["d", "context"])
    levels = levels.join(rest.counts, ["d", "key"], "left")
    by_depth = [F.sum(F.when(F.col("d") == d, F.col(c))).alias(f"{c}{d}") for d in range(1, depth + 1) for c in ("n", "kinds", "total")]
    found = levels.groupBy("symbol", "gain").agg(*by_depth)
    chance = F.pow(F.lit(10.0), F.col("gain"))
    for d in range(1, depth + 1):  # as in _distributions; a depth that is not in the rest changes nothing
        n, kinds, total = (F.coalesce(f"{c}{d}", F.lit(missing)) for c, missing in (("n", 0), ("kinds", 1), ("total", 0)))
        chance = (n + kinds * chance) / (total + kinds)
    return found.select("symbol", F.log10(chance).alias("gain"))


def _scored_by_units(rows: DataFrame, model: Broadcast[Model], rest: Rest, depth: int) -> DataFrame:
    """As ``_score``, where contexts beyond the table are joined."""

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("symbol")
        known = answers["symbol"].to_numpy(), answers["gain"].to_numpy()
        return pa.Table.from_batches(_score(texts.drop_columns("unit").to_batches(), model.value, known))

    asked = settle(rows.mapInArrow(lambda batches: _ask(batches, model.value), ASKED), "asked")
    texts = asked.filter("row is not null").select("unit", "row", "key", "held_out", "text")
    symbols = asked.filter("row is null").select(F.col("unit").alias("unit"), "symbol", "gain")  # told apart from the texts' unit
    answers = symbols.select("unit", "symbol").join(_answers(symbols, rest, depth), "symbol")
    return texts.groupBy("unit").cogroup(answers.select("unit", "symbol", "gain").groupBy("unit")).applyInArrow(scored, SCORED)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Tables written inside are handed to Python in batches of few rows, whose texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def score(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    least: int = LEAST,
    common: float = COMMON,
    mix: float = MIX,
    cells: int = CELLS,
) -> DataFrame:
    """Scores of all rows by a tree grown from the rows that are not held out.

    ``(<key>, held_out, n_tokens, n_known, train_tokens, base_score, score)``;
    scores are log10 probabilities.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    train = rows.filter(~F.col("held_out")).select("text")
    counts = train.mapInArrow(lambda batches: _contexts(batches, depth), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        counts = settle(counts, "contexts")
    tree, rest = divide(counts, depth, least, cells=cells)
    words = train.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        words = settle(words, "words")
    total, kinds, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    # At most 1 / ``common`` words by their share.
    frequent = words.filter(F.col("n") >= F.lit(max(common * total, 1))).toArrow().to_pandas()
    model = Model(tree, dict(zip(map(bytes, frequent["word"]), frequent["n"].tolist())), total, kinds, once, mix)
    shared = spark.sparkContext.broadcast(model)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.select("row", "key", "held_out", "text")
    with small_batches(spark):
        if rest:
            scored = _scored_by_units(numbered, shared, rest, depth)
        else:
            scored = numbered.mapInArrow(lambda batches: _score(batches, shared.value), SCORED)
        scored = settle(scored, "scored")
    shared.unpersist()
    rare = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.spelled").join(words, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    whole = (1 - mix) / max(total, 1) * seen + mix * F.pow(F.lit(10.0), "spelled")
    gain = F.when(seen == 0, float(np.log10(model.new))).otherwise(F.log10(model.known * whole))
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(seen + 0.5) - model.norm).alias("rest"), F.sum(gain).alias("more"), F.count("n").alias("known")
    )
    both = scored.drop("rare").join(rare, "row", "left")
    return both.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
