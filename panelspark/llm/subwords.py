"""Encoding and decoding with a SentencePiece model of merge type, by a table over prefixes.

Merging always takes the pair whose joined piece has the best score, leftmost first. Two facts
follow, whatever the vocabulary: a run of neighbours in a text's encoding is the encoding of the
text it covers, and pieces in a row are the encoding of their text as soon as every two
neighbours are. So the encoding of a prefix ends in exactly one piece, and that piece is the only
one which ends there and is compatible with the last piece of the prefix before it:

1. An Aho-Corasick automaton lists the pieces that end at every place of a text.
2. For each place the table keeps the one piece that passes the compatibility test with the table's
   entry where the piece starts. The test grows both pieces from their characters and looks whether
   a merge across their border ever has the better rank; its answers are remembered.
3. Ids are read off backwards from the last place.

A text costs time in proportion to its length, however it repeats. It is cut first where no piece can
span the cut: before space marks and between letters and other characters, as far as the
vocabulary bears that out. Short cuts are remembered with their ids; what a worker remembers has a
fixed largest size.

The model file is read on the driver and broadcast (its vocabulary is bounded and does not grow
with the data). Supported are models of merge type that keep the text as it is but for space marks;
others are refused. Characters without a piece become byte pieces, or the unknown piece in models
without those.

Edge cases, all defined: a null or empty text has only the begin and end ids; bytes that are not
UTF-8 count as U+FFFD; a space mark (U+2581) in a text is a space after decoding, as in the
library; repeated rows are encoded alike; an empty table gives an empty table. Columns kept from the input
may not be named like the added one (an error says so); other columns play no part.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelspark.llm import texts

MARK = "▁"
#: Most words and pairs of pieces a worker remembers, and the longest word it does remember.
WORDS, PAIRS, WORD_CHARS = 200_000, 500_000, 40
INFINITE = float("inf")
#: Kinds of pieces and the merge model type, as the file format numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2

codecs.register_error("one_mark_a_byte", lambda e: ("�" * (e.end - e.start), e.end))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _fields(data: bytes):
    """(number, value) of every field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at: at + size]
        at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        parts: dict[int, dict] = {2: {}, 3: {}}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number in parts:
                parts[number] = dict(_fields(value))
        trained, normal = parts[2], parts[3]
        if trained.get(3, 1) != MERGE_TYPE or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a merge-type model of normal, control and byte pieces")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trained.get(24, 0):
            raise ValueError("the model changes texts before encoding them; only space marks are supported")
        self.prefix = bool(normal.get(3, 1))
        self.bytes = bool(trained.get(35, 0))
        self.unknown, self.begin, self.end = trained.get(40, 0), trained.get(41, 1), trained.get(42, 2)
        self.unknown_surface = trained[44].decode() if 44 in trained else " ⁇ "


class Encoder(dict):
    """Cuts of a text to packed ids; fills itself."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.after: dict[int, dict[int, bool]] = defaultdict(dict)
        self.n_pairs = 0
        #: Merges with the best score come first.
        self.ranks = {p: -model.scores[i] for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        self.grown: dict[int, tuple | None] = {}
        self.older: dict[str, bytes] = {}
        known = set().union(*self.ranks)
        #: Characters that only longer pieces hold get ids beyond the vocabulary.
        self.surface = dict(enumerate(model.pieces))
        for c in sorted(known - set(self.ranks)):
            self.surface[len(self.surface)] = c
        self.lengths = array("H", [len(self.surface[i]) for i in range(len(self.surface))])
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.surface.items():
            if i >= len(model.pieces) or model.kinds[i] == NORMAL:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.words = self._cutter(known)
        self.known = known

    def _cutter(self, known: set[str]):
        """A function that cuts a text where no piece can span the cut."""
        def spanned(left: str, right: str) -> bool:
            return any(re.search(left + right, p) for p in self.ranks)

        def some(characters) -> str:
            return "".join(re.escape(c) for c in sorted(characters))

        letters = {c for c in known if c.isalpha()}
        others = known - letters - {MARK}
        if spanned(f"[^{MARK}]", MARK):
            groups = [f"[{some(known)}]+"]
        elif not others or not letters or any(
                spanned(f"[{some(x)}]", f"[{some(y)}]") for x, y in ((letters, others), (others, letters))):
            groups = [f"{MARK}*[{some(known - {MARK})}]+", f"{MARK}+"]
        else:
            groups = [f"{MARK}*[{some(letters)}]+", f"{MARK}*[{some(others)}]+", f"{MARK}+"]
        return re.compile("|".join([*groups, f"[^{some(known | {MARK})}]+"])).findall

    def edges(self, piece: int) -> tuple | None:
        """How a piece grows from its characters: (at its right end, at its left end), or None if
        merging its text does not give it.

        An end is a list of (text at that end, worst rank among the merges until the next text
        replaces it).
        """
        parts, ranks = list(self.surface[piece]), self.ranks
        ends = [[(parts[-1], -INFINITE)], [(parts[0], -INFINITE)]]
        while len(parts) > 1:
            best, at = INFINITE, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1], INFINITE)
                if rank < best:
                    best, at = rank, k
            if at < 0:
                return None
            touched = (at == len(parts) - 2, at == 0)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            for end, changed in zip(ends, touched):
                text, worst = end.pop()
                end.append((text, max(worst, best)))
                if changed:
                    end.append((parts[-1] if end is ends[0] else parts[0], -INFINITE))
        return tuple([*end[:-1], (end[-1][0], INFINITE)] for end in ends)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay as they are; ``left`` -1 asks for one piece alone.

        Both pieces are grown side by side: of their next replacements the one with the better
        worst rank comes first, at the left in a tie. A merge across the middle happens if its rank
        is better than what either side still needs.
        """
        for piece in (left, right):
            if piece not in self.grown:
                self.grown[piece] = self.edges(piece) if piece >= 0 else None
        if left < 0 or not self.grown[left] or not self.grown[right]:
            return left < 0 and self.grown[right] is not None
        ours, theirs = self.grown[left][0], self.grown[right][1]
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = ours[i], theirs[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if until_x == until_y == INFINITE:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def remember(self, left: int, right: int) -> bool:
        if self.n_pairs >= PAIRS:
            self.after.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.after[left][right] = self.compatible(left, right)
        return found

    def last_pieces(self, word: str) -> list[int]:
        """For every prefix of a word, the piece that ends its encoding."""
        last = [-1] * (len(word) + 1)
        after = self.after
        tests = [after[-1]] * (len(word) + 1)  # what is known to follow the last piece of a prefix
        for place, (piece, size) in self.automaton.iter(word):
            place += 1
            if last[place] < 0:
                found = tests[place - size].get(piece)
                if found or (found is None and self.remember(last[place - size], piece)):
                    last[place] = piece
                    tests[place] = after[piece]
        return last

    def spelled(self, text: str) -> list[int]:
        if not self.byte_ids or not self.model.bytes:
            return [self.model.unknown]
        return [self.byte_ids[b] for b in text.encode()]

    def encode_word(self, word: str) -> bytes:
        if word[0] not in self.known:  # no piece holds any of these characters
            return packed(self.spelled(word))
        last, at, out, known = self.last_pieces(word), len(word), [], len(self.model.pieces)
        while at:
            piece = last[at]
            if piece < known:
                out.append(piece)
            else:
                out.extend(reversed(self.spelled(self.surface[piece])))
            at -= self.lengths[piece]
        return packed(out[::-1])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encode_word(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text.replace(" ", MARK)
        if text and self.model.prefix:
            text = MARK + text
        ids = b"".join(map(self.__getitem__, self.words(text)))
        return packed([self.model.begin] * begin) + ids + packed([self.model.end] * end)


class Decoder:
    def __init__(self, model: Model):
        def surface(i: int) -> bytes:
            piece, kind = model.pieces[i], model.kinds[i]
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            if kind == UNKNOWN:
                return model.unknown_surface.encode()
            return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

        self.model = model
        self.surface = [surface(i) for i in range(len(model.pieces))]

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, "<u4").tolist()
        kinds = self.model.kinds
        first = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), len(ids))
        parts = list(map(self.surface.__getitem__, ids))
        if self.model.prefix and first < len(ids) and kinds[ids[first]] == NORMAL:
            parts[first] = self.model.pieces[ids[first]].removeprefix(MARK).replace(MARK, " ").encode()
        # other pieces are whole characters, so wrong bytes can only stem from runs of byte pieces
        try:
            if b"" not in parts[first:-1]:
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        cuts = [k for k, i in enumerate(ids) if kinds[i] == CONTROL]
        return "".join(b"".join(parts[lo:hi]).decode("utf-8", "one_mark_a_byte")
                       for lo, hi in zip([0, *cuts], [*cuts, len(ids)]))


@lru_cache(maxsize=1)
def _encoder(data: bytes) -> Encoder:
    return Encoder(Model(data))


@lru_cache(maxsize=1)
def _decoder(data: bytes) -> Decoder:
    return Decoder(Model(data))


def _mapped(df: DataFrame, keep: list[str], column: str, added: T.StructField, model_path: str, convert) -> DataFrame:
    """``keep`` and one more column, made from every value of ``column`` by convert(model bytes)."""
    if added.name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"a kept column is named like the added one: {added.name}")
    with open(model_path, "rb") as f:
        data = f.read()
    Model(data)  # refuses unsupported models before any task runs
    texts.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(data)
    kind = pa.binary() if isinstance(added.dataType, T.BinaryType) else pa.string()

    def run(batches):
        one = convert(shared.value)
        for batch in batches:
            for part in texts.pieces(batch, "_value", 8 << 20):
                values = pa.array([one(v or b"") for v in part.column("_value").cast(pa.binary()).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), values], names=[*keep, added.name])

    kept = df.select(*keep)
    return df.select(*keep, df[column].alias("_value")).mapInArrow(run, T.StructType([*kept.schema.fields, added]))


def encode(docs: DataFrame, model_path: str, keep: list[str], text: str = "text",
           begin: bool = True, end: bool = True, out: str = "ids") -> DataFrame:
    """``keep`` and ``out``: the packed ids of every text (little-endian unsigned 32-bit integers)."""

    def convert(data):
        encoder = _encoder(data)
        return lambda text: encoder.encode(text.decode("utf-8", "replace"), begin, end)

    return _mapped(docs, keep, text, T.StructField(out, T.BinaryType()), model_path, convert)


def decode(rows: DataFrame, model_path: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``keep`` and ``out``: the text of every row of packed ids; null ids give an empty text."""
    return _mapped(rows, keep, ids, T.StructField(out, T.StringType()), model_path, lambda data: _decoder(data).decode)
