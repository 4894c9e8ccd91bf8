"""SentencePiece encoding and decoding by streaming Viterbi.

The segmentation of a text is found in one pass from left to right. At each boundary the pieces
that end there are read off an automaton over the vocabulary, and the best of the paths they
extend is kept. What is known of boundaries (best score, or last piece, and back pointers) is kept
only until all paths that are still alive share one, and the ids up to it are then committed: paths
that pieces still to come can extend are no longer than the longest piece.

Two kinds of models differ in what makes a path survive at a boundary:

* unigram: the path with the highest sum of scores;
* BPE: the path whose neighbouring pieces are compatible. The pieces a BPE model gives for a
  text are the one sequence in which every two neighbours are also what it gives for these
  two alone, so each boundary has exactly one surviving path. Two pieces are compatible if
  no merge across them comes before the merges that made them, which is read off by undoing
  those merges, latest first.

Where no piece of the vocabulary crosses from a character into a following word mark, every
path has a boundary there, so the spans between such places are independent and the ids of
short spans, once the streaming pass has committed them, are kept in a bounded cache.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import claim, documents, narrow, quoted, ship

MARK = "▁"
#: Added to the lowest piece score for a character outside the vocabulary.
UNKNOWN_PENALTY = -10.0
#: Spans of up to so many characters are kept in the cache.
SHORT = 48
#: Numbers from here on stand for characters outside the vocabulary.
UNKNOWN = 1 << 19
#: Stands for the last piece at a boundary that no path has.
NOWHERE = 1 << 22
#: Most pairs of neighbours, and most steps of the automaton, that a worker remembers.
HELD = 2_000_000


class SpanCache(dict):
    """Ids of short spans as bytes; up to ``limit`` are kept, and as many of those before them."""

    def __init__(self, coder: PieceCoder, limit: int):
        super().__init__()
        self.coder, self.limit = coder, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, span: str) -> bytes:
        found = self.older.get(span)
        if found is None:
            found = self.coder.span_ids(span)
        if len(span) <= SHORT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[span] = found
        return found


class Follower(dict):
    """Of one piece: whether it may follow the piece of a number."""

    __slots__ = ("coder", "piece")

    def __init__(self, coder: PieceCoder, piece: int):
        self.coder, self.piece = coder, piece

    def __missing__(self, before: int) -> bool:
        coder = self.coder
        if coder.n_neighbours >= HELD:
            for other in coder.followers.values():
                other.clear()
            coder.n_neighbours = 0
        coder.n_neighbours += 1
        self[before] = found = coder.fits(before, self.piece)
        return found


class Place(dict):
    """A place of the automaton over the vocabulary: the longest end of a text that begins a piece, the pieces it
    ends with (size, number, what they may follow), longest first, and the places after one more character."""

    __slots__ = ("coder", "name", "endings", "single")

    def __init__(self, coder: PieceCoder, name: str):
        self.coder, self.name = coder, name
        ends = [(len(name) - k, coder.places.get(name[k:], -1)) for k in range(len(name))]
        self.endings = [(size, p, coder.followers.setdefault(p, Follower(coder, p))) for size, p in ends if p > 0]
        self.single = bool(self.endings) and self.endings[-1][0] == 1

    def __missing__(self, char: str) -> Place:
        coder = self.coder
        name = self.name + char
        while name and name not in coder.places:
            name = name[1:]
        found = coder.known.get(name)
        if found is None:
            found = coder.known[name] = Place(coder, name)
        if coder.n_places >= HELD:
            for other in coder.known.values():
                other.clear()
            coder.n_places = 0
        coder.n_places += 1
        self[char] = found
        return found


class PieceCoder:
    """Pieces, scores and byte ids of a SentencePiece model; ``kind`` is "unigram" or "bpe"."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], kind: str = "unigram", cache_limit: int = 600_000):
        self.kind = kind
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.longest = max(map(len, pieces))
        self.byte_ids = byte_ids
        self.unknown = min(s for _, s in pieces.values()) + UNKNOWN_PENALTY
        self.scores = {p: s for p, (_, s) in pieces.items()}
        counts = Counter(self.scores.values())
        self.tied = {p for p, s in self.scores.items() if counts[s] > 1 and len(p) > 1}
        # a trie as one dictionary: the number of a piece, from 1; -1 for a prefix that is no piece
        self.names = ["", *self.ids]
        self.weights = [0.0, *self.scores.values()]
        self.places: dict[str, int] = {}
        for number, piece in enumerate(self.names):
            for k in range(1, len(piece)):
                self.places.setdefault(piece[:k], -1)
            self.places[piece] = number
        self.numbered = [-1, *self.ids.values()]
        self.sizes = {number: len(piece) for number, piece in enumerate(self.names)}
        self.followers: dict[int, Follower] = {}
        self.n_places, self.n_neighbours = 0, 0
        self.root = Place(self, "")
        self.known = {"": self.root}
        self.text = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()}
        self.text.update({i: bytes([b]) for b, i in enumerate(byte_ids)})
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.spans = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cache = SpanCache(self, cache_limit)
        self._compatible: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str] | None] = {}

    @classmethod
    def load(cls, path: str, kind: str | None = None) -> PieceCoder:
        """Read a model file. The scores of a BPE model count its merges, 0, -1, -2 and so on."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = (i, model.get_score(i))
        if kind is None:
            kind = "bpe" if all(float(s).is_integer() for _, s in pieces.values()) else "unigram"
        return cls(pieces, byte_ids, kind)

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What repeated merging of the best, leftmost pair makes of a short text, and the last pair merged."""
        parts, last = list(text), None
        while True:
            best = None
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                return parts, last
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(last)]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces merged last into a piece; None if merging never makes it."""
        if piece not in self._halves:
            parts, last = self.merges(piece)
            self._halves[piece] = last if parts == [piece] else None
        return self._halves[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b next to each other as they are."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            if (len(a) > 1 and self.halves(a) is None) or (len(b) > 1 and self.halves(b) is None):
                known = False
            elif a in self.tied or b in self.tied:
                known = self.merges(a + b)[0] == [a, b]
            else:
                known = self._undo(a, b)
            self._compatible[a, b] = known
        return known

    def _undo(self, a: str, b: str) -> bool:
        scores = self.scores
        left = right = float("-inf")  # scores of the merges that take a, and b, away from the border
        while True:
            across = scores.get(a + b)
            # of equal merges the one further left comes first
            if across is not None and across > left and across >= right:
                return False
            made_a = scores[a] if len(a) > 1 else None
            made_b = scores[b] if len(b) > 1 else None
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a < made_b):
                left, a = made_a, self.halves(a)[1]
            else:
                right, b = made_b, self.halves(b)[0]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in committed runs. A mark inside ``text`` stands for a space."""
        return self._stream_bpe(text) if self.kind == "bpe" else self._stream_unigram(text)

    def _stream_bpe(self, text: str) -> Iterator[list[int]]:
        """The one path whose neighbours are compatible; a boundary is known by the last piece before it."""
        last: list[int] = [0]  # of boundaries from ``first`` on; a piece tells the boundary before it, too
        first, end, check, place = 0, 0, 2 * self.longest, self.root
        for char in text:
            end += 1
            place = place[char]
            for size, piece, after in place.endings:  # the pieces that end here, longest first
                if size <= end and after[last[end - size]]:
                    last.append(piece)
                    break
            else:
                # a boundary that no path has is followed by none
                last.append(NOWHERE if place.single or last[-1] == NOWHERE else UNKNOWN + ord(char))
            if end >= check:
                # pieces that end later begin no earlier than what is known of the trie here
                alive = [k for k in range(end - min(end, len(place.name)), end + 1) if last[k] != NOWHERE]
                shared = self._shared(alive, lambda k: k - self.sizes.get(last[k], 1))
                if shared > 0:
                    yield self._commit(text[first : first + shared], last)
                    last = last[shared:]
                    first, end = first + shared, end - shared
                check = end + self.longest
        if end:
            yield self._commit(text[first:], last)

    def _stream_unigram(self, text: str) -> Iterator[list[int]]:
        """The path with the highest sum of scores; of equal ones the longest last piece."""
        best = [0.0]  # sums at the boundaries from ``first`` on, and the last piece before them
        last: list[int] = [0]
        first, end, check, place = 0, 0, 2 * self.longest, self.root
        for char in text:
            end += 1
            place = place[char]
            score = None
            for size, piece, _ in place.endings:
                if size <= end and (score is None or best[end - size] + self.weights[piece] > score):
                    score, found = best[end - size] + self.weights[piece], piece
            if not place.single and (score is None or best[end - 1] + self.unknown > score):
                score, found = best[end - 1] + self.unknown, UNKNOWN + ord(char)
            best.append(score)
            last.append(found)
            if end >= check:
                shared = self._shared(list(range(end - min(end, len(place.name)), end + 1)), lambda k: k - self.sizes.get(last[k], 1))
                if shared > 0:
                    yield self._commit(text[first : first + shared], last)
                    best, last = best[shared:], last[shared:]
                    first, end = first + shared, end - shared
                check = end + self.longest
        if end:
            yield self._commit(text[first:], last)

    @staticmethod
    def _shared(alive: list[int], before: Callable[[int], int]) -> int:
        """The last boundary on the paths of all living boundaries; 0 is on every path."""
        alive = sorted(alive, reverse=True)
        while len(alive) > 1:
            alive[0] = before(alive[0])
            alive = sorted(set(alive), reverse=True)
        return alive[0]

    def _commit(self, text: str, last: list[int]) -> list[int]:
        """Ids of ``text``, whose end is the boundary len(text)."""
        sizes, numbered, out = self.sizes, self.numbered, []
        at = len(text)
        while at > 0:
            piece = last[at]
            if piece < UNKNOWN:
                out.append(numbered[piece])
                at -= sizes[piece]
            else:
                out.extend(self.byte_ids[x] for x in reversed(text[at - 1].encode()))
                at -= 1
        out.reverse()
        return out

    def _span(self, span: str) -> bytes:
        out = array("i")
        for run in self.stream(span):
            out.extend(run)
        return out.tobytes()

    def fits(self, before: int, piece: int) -> bool:
        """Whether a piece may follow the one before it (0: begins the span)."""
        if before == NOWHERE:
            return False
        text = self.names[piece]
        if before == 0:
            return len(text) == 1 or self.halves(text) is not None
        return self.compatible(self.names[before] if before < UNKNOWN else chr(before - UNKNOWN), text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. An empty text has none. A literal mark in the text is
        written as bytes, so that decoding gives back exactly what was encoded."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        parts = text.split(MARK)
        out = [self._pieces(MARK + parts[0].replace(" ", MARK))]
        literal = np.array([self.byte_ids[x] for x in MARK.encode()], dtype=np.int32).tobytes()
        for part in parts[1:]:
            out.append(literal)
            if part:
                out.append(self._pieces(part.replace(" ", MARK)))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def _pieces(self, marked: str) -> bytes:
        if self.spans is None:
            return self._span(marked)
        return b"".join(map(self.cache.__getitem__, self.spans.findall(marked)))

    def span_ids(self, span: str) -> bytes:
        """Ids of a span. Where no piece holds two neighbouring characters every path has a
        boundary, so the parts on either side are looked up by themselves."""
        pairs = self.pairs
        if pairs.issuperset(map(add, span, span[1:])):
            return self._span(span)
        cuts = [k for k in range(1, len(span)) if span[k - 1 : k + 1] not in pairs]
        parts = [span[x:y] for x, y in zip([0, *cuts], [*cuts, len(span)], strict=True)]
        return b"".join(map(self.cache.__getitem__, parts))

    def decode(self, ids) -> str:
        """The text that was encoded: the space of the first mark is dropped again."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[str, PieceCoder] = {}


def coder(model: str) -> PieceCoder:
    """A model by its name in public_tokenizers, or by its path; one per worker."""
    if model not in _CODERS:
        if "/" in model:
            path = model
        else:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _CODERS[model] = PieceCoder.load(path)
    return _CODERS[model]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, ids, n_ids, and whether decoding the ids gives the text back.

    Null texts count as empty and have no ids. Null ids, repeated rows and empty tables need
    no special case. Columns other than id and text are ignored.
    """
    source = narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", _CODERS.clear)
        tool = coder(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                cut = batch.slice(begin, 256)
                texts = cut.column("text").to_pylist()
                ids = [tool.encode(t) for t in texts]
                same = [tool.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), flat, pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    return source.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode_pieces(frame: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """The inverse of encode_pieces: id and text. Null ids decode to an empty text."""

    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(model)
        for batch in batches:
            texts = [tool.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return frame.select(quoted(id_col).cast("long").alias("doc_id"), quoted(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))
