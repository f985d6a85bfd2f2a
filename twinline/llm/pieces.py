"""SentencePiece encoding and decoding with the byte span of every piece.

The model file is read for its pieces, scores and rules. A text is normalised as the
file says: at each place the longest prefix that the compiled character map knows is
replaced, any other character is kept, and every byte written remembers the source
byte its replacement began at. White space becomes the mark U+2581, one mark is put
before the text, and surplus white space goes, where the file asks for it. Pairs of
neighbouring pieces are then joined, the best score first and the leftmost of equals,
as long as the vocabulary has the joined piece; characters without a piece fall back to
bytes. The remembered places project every piece back to the bytes of the original text.

No piece reaches from another character into a mark or into a character that occurs in
no piece, so a text falls apart before marks and around line feeds, and the parts
met first are kept in a bounded cache. Whether this holds is read from the vocabulary.
A part of a text is encoded at ``n log n`` cost whatever its length, a long one cut
where two characters are neighbours in no piece. Long texts go through Python's objects
in windows; what is held of a whole text is a few bytes a character.

Decoding concatenates pieces, turns marks into spaces, drops the space of the leading
mark, and reads runs of byte pieces as UTF-8, with U+FFFD for each byte that is none.

Rows: a null or empty text has no pieces and decodes to an empty text; every other
text, however long, is encoded whole; a byte that is no UTF-8 counts as U+FFFD, of one source
byte; repeated rows are each returned. Models other than byte-pair ones, or with pieces of the
user's own, are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MARK_BYTES = MARK.encode()
CACHED_PARTS = 250_000
SHORT = 40  # characters of a part whose pairs are searched in a list
NEVER = float("-inf")
LONGEST_CACHED = 64  # characters
WINDOW = 1 << 17  # characters of a text, or ids, that are held as Python objects at a time
BATCH = 1 << 20  # bytes of texts whose arrays are handed on together
NO_UTF8 = re.compile(rb"\xed[\xb2\xb3][\x80-\xbf]")  # surrogates of single bytes, written as if they were characters
# Kinds of pieces and of models in the file's format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PAIRS = 2


def default_path() -> str:
    return public_tokenizers.path(MODEL)


# The model file


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protocol-buffer message: integers, or bytes of any other wire type."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass
class CharacterMap:
    """Replacements by longest prefix, from a compiled map: a double array of its trie, then the replacements."""

    units: np.ndarray
    texts: bytes

    @classmethod
    def read(cls, blob: bytes) -> CharacterMap | None:
        if not blob:
            return None
        (size,) = struct.unpack_from("<I", blob)
        return cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    def __post_init__(self):
        self.units = self.units.tolist()
        # A character is alone when the map has nothing that begins with its first byte.
        self.starts = frozenset(b for b in range(1, 256) if self._step(self._base(0), b) is not None)

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[at:]``, and its replacement."""
        base, best = self._base(0), None
        for place in range(at, len(text)):
            node = self._step(base, text[place])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] & 0x100:
                best = place + 1 - at, self.units[base] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


@dataclass
class Rules:
    """How a text is normalised."""

    replace: CharacterMap | None
    lead: bool = True  # a mark before the text
    squeeze: bool = True  # surplus white space goes
    escape: bool = True  # white space becomes marks

    @classmethod
    def read(cls, message: bytes) -> Rules:
        found = dict(fields(message))
        return cls(CharacterMap.read(found.get(2, b"")), *(bool(found.get(i, 1)) for i in (3, 4, 5)))

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte that it came from."""
        source = text.encode("utf-8", "replace")
        space = MARK_BYTES if self.escape else b" "
        out, places = bytearray(), array("i")
        at, size = 0, len(source)
        steps = self._steps(source)
        at = next((i for i, _, new in steps if new != b" "), size) if self.squeeze else 0
        if at == size:
            return b"", np.zeros(1, np.int32)
        if self.lead:
            out += space
            places += array("i", [at]) * len(space)
        spaced, trailing = self.squeeze, None
        for place, _, new in self._steps(source, at):
            if spaced:
                new = new.lstrip(b" ")
            if new:
                for part in re.findall(rb" |[^ ]+", new):
                    if part == b" ":
                        trailing = (len(out), place) if trailing is None else trailing
                        part = space
                    else:
                        trailing = None
                    out += part
                    places += array("i", [place]) * len(part)
                spaced = self.squeeze and new.endswith(b" ")
        end = size
        if self.squeeze and trailing:
            out, end = out[: trailing[0]], trailing[1]
        return bytes(out), np.append(np.array(places[: len(out)], np.int32), np.int32(end))

    def _steps(self, source: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
        """``(place, length, replacement)`` along the source."""
        while at < len(source):
            first = source[at]
            hit = self.replace.longest(source, at) if self.replace and first in self.replace.starts else None
            size, new = hit or (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4, None)
            yield at, size, source[at : at + size] if new is None else new
            at += size


class Parts(dict):
    """What ``make`` gives for a part; the short ones met first are kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        found = self.make(part)
        if len(self) < CACHED_PARTS and len(part) <= LONGEST_CACHED:
            self[part] = found
        return found


@dataclass
class Vocabulary:
    """A byte-pair model: ids, scores and rules, and the parts of texts met so far."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    rules: Rules
    unknown_text: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        found = [dict(fields(value)) for number, value in message if number == 1]
        trainer = dict(fields(next((value for number, value in message if number == 2), b"")))
        kinds = [piece.get(3, NORMAL) for piece in found]
        if trainer.get(3, 1) != PAIRS or {USER, UNUSED} & set(kinds):
            raise ValueError(f"{path}: only byte-pair models without pieces of the user's own are read")
        return cls(
            [piece[1].decode() for piece in found],
            kinds,
            [struct.unpack("<f", piece[2])[0] for piece in found],
            Rules.read(next((value for number, value in message if number == 3), b"")),
            trainer.get(44, " ⁇ ".encode()).decode(),
        )

    def __post_init__(self):
        normal = [i for i, kind in enumerate(self.kinds) if kind == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: self.scores[i] for i in normal}
        # Equal scores share a rank; the best is 0.
        ranks = {score: rank for rank, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {piece: ranks[score] for piece, score in self.score.items()}
        self.neighbours = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.known = {piece: (i, _width(piece)) for piece, i in self.ids.items()}
        self.parts = Parts(self.encode_part)
        self.bytes = [i for i, kind in enumerate(self.kinds) if kind == BYTE]
        self.unknown = self.kinds.index(UNKNOWN)
        if self.bytes and len(self.bytes) != 256:
            raise ValueError("a vocabulary has all byte pieces or none")
        split = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        alone = not any("\n" in piece for piece in self.ids)
        word = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.cut = re.compile(word if split else r"(?s).+").findall
        # What a piece stands for in a decoded text; byte pieces are their byte.
        self.raw = [
            bytes([int(piece[3:-1], 16)]) if kind == BYTE
            else b"\xff" if kind == CONTROL  # says nothing, but parts runs of byte pieces: such texts are mended
            else self.unknown_text.encode() if kind == UNKNOWN
            else piece.replace(MARK, " ").encode()
            for piece, kind in zip(self.pieces, self.kinds)
        ]

    # Encoding

    def join(self, part: str) -> list[str]:
        """The part as pieces and single characters."""
        if len(part) > SHORT:
            return [symbol for run in self._runs(part) for symbol in (self._join_long(run) if len(run) > SHORT else self.join(run))]
        if len(part) == 1:
            return [part]
        symbols, score = list(part), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(part, part[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)  # the leftmost
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(symbols[at] + symbols[at + 1], NEVER)
            if at:
                scores[at - 1] = score(symbols[at - 1] + symbols[at], NEVER)
        return symbols

    def _runs(self, part: str) -> Iterator[str]:
        """The part cut where two characters are neighbours in no piece, over which none can reach."""
        known, first = self.neighbours, 0
        for at in range(1, len(part) + 1):
            if part[at - 1 : at + 1] not in known:
                yield part[first:at]
                first = at

    def _join_long(self, part: str) -> list[str]:
        """As :meth:`join`, with the pairs in a heap."""
        symbols, size, rank = list(part), len(part), self.rank.get
        after, before = array("i", range(1, size + 1)), array("i", range(-1, size - 1))
        # The rank of a pair, then its place: the best first, the leftmost of equals.
        waiting = [(known << 32) + left for left in range(size - 1) if (known := rank(part[left : left + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            best = heapq.heappop(waiting)
            left = best & 0xFFFFFFFF
            right = after[left]
            if right == size or not symbols[left] or rank(both := symbols[left] + symbols[right]) != best >> 32:
                continue  # one of the two has been joined since
            symbols[left], symbols[right] = both, ""
            after[left] = right = after[right]
            if right < size:
                before[right] = left
                if (known := rank(both + symbols[right])) is not None:
                    heapq.heappush(waiting, (known << 32) + left)
            start = before[left]
            if start >= 0 and (known := rank(symbols[start] + both)) is not None:
                heapq.heappush(waiting, (known << 32) + start)
        return [symbol for symbol in symbols if symbol]

    def encode_part(self, part: str) -> bytes:
        """Pairs of an id and a width: widths are of normalised bytes, marks as single ones; byte pieces but the last of a character have none."""
        pairs, known = array("i"), self.known.get
        for piece in self.join(part):
            found = known(piece)
            if found is not None:
                pairs.extend(found)
            elif self.bytes:
                for b in piece.encode():
                    pairs.append(self.bytes[b])
                    pairs.append(0)
                pairs[-1] = _width(piece)
            elif pairs and pairs[-2] == self.unknown:
                pairs[-1] += _width(piece)
            else:
                pairs.extend((self.unknown, _width(piece)))
        return pairs.tobytes()

    def _cut(self, text: str, lead: str = "", space: str = " ") -> Iterator[list[str]]:
        """The parts of a text after ``lead``, with its spaces replaced, a window at a time."""
        at, size = 0, WINDOW
        while at < len(text):
            parts = self.cut(lead + text[at : at + size].replace(" ", space))
            end = at + size
            if end < len(text):  # the last part may go on
                if len(parts) == 1:
                    size *= 2
                    continue
                end -= len(parts.pop())
            yield parts
            at, size, lead = end, WINDOW, ""

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the source byte at which it ends; it begins where the one before ends, the first at 0."""
        if not text:
            return np.empty(0, "<i4"), np.empty(0, "<i4")
        rules, places = self.rules, None
        if rules.replace or rules.squeeze or not rules.escape or MARK in text:
            content, places = rules.normalise(text)
            content = content.decode()
            cut = self._cut(content)
        else:  # only marks are put in: a mark is one source byte, and the leading one none
            cut = self._cut(text, MARK if rules.lead else "", MARK)
        pairs, get = bytearray(), self.parts.__getitem__
        for parts in cut:
            pairs += b"".join(map(get, parts))
        ids, widths = np.frombuffer(pairs, "<i4").reshape(-1, 2).T
        ids, ends = ids.copy(), np.cumsum(widths, dtype="<i4")
        if places is None:
            ends -= rules.lead
            return ids, ends
        # Widths count a mark as one byte; take them back to the normalised bytes.
        written = np.frombuffer(content.encode(), np.uint8)
        at = np.array([m.start() for m in re.finditer(MARK_BYTES, written.tobytes())], np.int64)
        counted = np.ones(len(written), np.int8)
        counted[at + 1], counted[at + 2] = 0, 0
        reached = np.concatenate([np.zeros(1, np.int32), np.cumsum(counted, dtype=np.int32)])
        return ids, places[np.searchsorted(reached, ends, side="right") - 1] if len(ids) else ids

    def encode_bytes(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, of bytes that may be no UTF-8: each that is none is read as U+FFFD, of one source byte."""
        try:
            return self.encode(source.decode())
        except UnicodeDecodeError:
            # Such a byte becomes a surrogate, which is three bytes, as U+FFFD is.
            marked = source.decode("utf-8", "surrogateescape").encode("utf-8", "surrogatepass")
        ids, ends = self.encode(NO_UTF8.sub("\ufffd".encode(), marked).decode())
        return ids, ends - 2 * np.searchsorted([m.end() for m in NO_UTF8.finditer(marked)], ends, side="right").astype("<i4")

    # Decoding

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        ids, raw = np.asarray(ids, np.int32), self.raw.__getitem__
        content = b"".join([b"".join(map(raw, ids[at : at + WINDOW].tolist())) for at in range(0, len(ids), WINDOW)])
        if (self.rules.lead or self.rules.squeeze) and content.startswith(b" ") and self.kinds[ids[0]] == NORMAL:
            content = content[1:]
        try:
            return content.decode()
        except UnicodeDecodeError:
            return self._mended(ids.tolist())

    def _mended(self, ids: list[int]) -> str:
        """Runs of byte pieces read on their own, with U+FFFD for each byte that begins no character."""
        out, run = [], bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            run.clear()

        lead = self.rules.lead or self.rules.squeeze
        for i in ids:
            if self.kinds[i] == BYTE:
                run.extend(self.raw[i])
                continue
            close()
            if self.kinds[i] == CONTROL:
                continue
            piece = self.raw[i].decode()
            if lead and not out and self.kinds[i] == NORMAL and piece.startswith(" "):
                piece = piece[1:]
            out.append(piece)
            lead = False
        close()
        return "".join(out)


def _width(piece: str) -> int:
    return len(piece.encode()) - 2 * piece.count(MARK)


@cache
def vocabulary(path: str) -> Vocabulary:
    """The model file's vocabulary, once per worker."""
    return Vocabulary.read(path)


# On DataFrames


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """All rows as ``(_row, ids, ends)``: ``_row`` is the row itself; piece ``i`` covers the bytes from ``ends[i - 1]``, or 0, to ``ends[i]``.

    ``decoded`` adds the text that the ids decode to, in the same pass.
    """
    path = path or default_path()
    # A column that is text already goes to the workers once, in its row.
    own = docs.columns.index(text) if docs.columns.count(text) == 1 and docs.schema[text].dataType == T.StringType() else None

    def made(rows: list[tuple[np.ndarray, np.ndarray]], words: Vocabulary) -> list[pa.Array]:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(ids) for ids, _ in rows])]), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if len(x) > 1 else x[0], pa.int32())) for x in zip(*rows)]
        return columns + ([pa.array([words.decode(ids) for ids, _ in rows], pa.string())] if decoded else [])

    names = ["_row", "ids", "ends"] + ["decoded"] * decoded

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            rows, held, first = [], 0, 0
            texts = batch.column(1) if own is None else pc.struct_field(batch.column(0), [own])
            for i, value in enumerate(texts.cast(pa.binary())):
                content = value.as_py() or b""
                rows.append(words.encode_bytes(content))
                held += len(content)
                if held >= BATCH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *made(rows, words)], names)
                    rows, held, first = [], 0, i + 1

    rows = docs.select(F.struct("*").alias("_row"), *([F.col(text).cast("string").alias("_text")] if own is None else []))
    more = T.StructType.fromDDL("ids array<int>, ends array<int>" + ", decoded string" * decoded)
    return rows.mapInArrow(encoded, T.StructType([rows.schema["_row"], *more]))


def decode(ids: Column | str, path: str | None = None) -> Column:
    """The text of an array of ids."""
    path = path or default_path()

    @F.pandas_udf("string")
    def decoded(column):
        import pandas as pd

        words = vocabulary(path)
        return pd.Series([None if x is None else words.decode(x) for x in column], dtype=object)

    return decoded(ids)


def spans(encoded: DataFrame) -> DataFrame:
    """One row per piece of :func:`encode`: ``(_row, at, id, start, end)``."""
    pieces = F.transform(
        "ids", lambda x, i: F.struct(x.alias("id"), F.when(i == 0, 0).otherwise(F.get("ends", i - 1)).alias("start"), F.get("ends", i).alias("end"))
    )
    rows = encoded.select("_row", F.posexplode(pieces).alias("at", "piece"))
    return rows.select("_row", "at", "piece.id", "piece.start", "piece.end")
