"""SentencePiece encoding and decoding by streaming Viterbi, for BPE models, with the library's ids.

The lattice of a text has an edge for each piece that matches, and the best path is the one on which
merging by score would leave every two neighbouring pieces apart: that path is the BPE encoding, and
each prefix of the text has exactly one. So each position keeps one backpointer, and an edge is taken
if its piece may follow the piece that ends where it begins. A position can only be extended for as
many characters as the longest piece has; backpointers older than that are kept only until all paths
from that window converge on one boundary, up to which ids are committed. Where two characters stand
side by side in no piece, as a space after another character, all paths converge; the stretches
between such places are encoded once per batch and kept in a bounded cache.

Defined cases: null and empty texts have no ids, and decode to the empty text; characters that no
piece has become byte pieces; U+2581 reads as a space, as in the library, so it is the one character
that does not come back; repeated rows are encoded alike; an empty table gives an empty result; other
columns are not read unless carried. The model file is named by a parameter and read by every
executor; models of another type than BPE, or whose pieces cross a space, are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import textblocks as tb
from tracefold.llm.columns import carried

SPACE = "▁"
#: Stretches whose ids a worker keeps, and pairs of pieces.
CACHE_WORDS, CACHE_PAIRS = 200_000, 1_000_000
#: Bytes of text that are encoded together.
TEXT_BYTES = 2 << 20
#: In place of a piece's id: none yet, a character that no piece has, the beginning of a longer piece alone.
_NONE, _UNKNOWN, _PREFIX = -1, -2, -3


class Pieces:
    """The pieces of a BPE model, in the order in which merging makes them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids, self.texts = {}, []
        scores: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.ids[piece], scores[piece] = i, model.get_score(i)
                self.texts.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_ids) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model must have byte pieces, and spaces only at the start of pieces")
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.scores = scores
        self.names = {i: piece for piece, i in self.ids.items()}
        self.starts: dict[str, int] = {}  # every beginning of a piece, with the id of the piece that it is
        for piece, i in self.ids.items():
            parts, last = self.merged(piece)
            if parts != [piece]:
                continue  # merging never makes it
            self.halves[piece] = last
            for n in range(1, len(piece)):
                self.starts.setdefault(piece[:n], _PREFIX)
            self.starts[piece] = i
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging best scores first makes of a text, and the last two pieces that it merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces apart, when each is made of its own characters."""
        pair = left << 32 | right
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= CACHE_PAIRS:
                self.follows.clear()
            one, other = self.names[left], self.names[right]
            known = self.follows[pair] = other[0] == SPACE != one[-1] or self._apart(one, other)
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Takes merges back, latest first, and looks for one over the seam that would have come before it.

        Of two merges with one score the one further left comes first: a merge over the seam stands
        before one in the right piece, and after one in the left piece.
        """
        if left[-1] == SPACE == right[0]:
            return self.merged(left + right)[0] == [left, right]  # runs of spaces share one score
        score, halves = self.scores, self.halves
        limit, tie = -float("inf"), True  # the score that a merge over the seam must beat, or reach with tie
        while True:
            over = score.get(left + right)
            if over is not None and (over > limit or (tie and over == limit)):
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and score[left] < score[right]):
                limit, tie, left = score[left], False, a[1]
            else:
                limit, tie, right = score[right], True, b[0]

    def encode_stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces as U+2581), committed as soon as paths converge.

        Held are the characters and backpointers from the last committed boundary on, and no position
        is extended by more than the longest piece.
        """
        text, done = "", 0  # characters since the last boundary, positions among them that were extended
        begin, piece = [0], [_NONE]  # for each position the backpointer, and the piece that ends there
        source, ended = iter(chars), False
        while not ended or done < len(text):
            more = "".join(islice(source, 4 * self.longest))
            text, ended = text + more, len(more) < 4 * self.longest
            begin += [0] * len(more)
            piece += [_NONE] * len(more)
            stop = len(text) if ended else max(done, len(text) - self.longest)
            self._extend(text, done, stop, begin, piece)
            done = stop
            # all paths that can still go on end in positions from `done` on
            live = {done, *(p for p in range(done, len(text) + 1) if piece[p] != _NONE)}
            while len(live) > 1:
                last = max(live)
                live.remove(last)
                live.add(begin[last])
            (met,) = live
            yield from self._path(text, begin, piece, met)
            text, done = text[met:], done - met
            begin, piece = [max(0, p - met) for p in begin[met:]], piece[met:]

    def _extend(self, text: str, first: int, stop: int, begin: list[int], piece: list[int]) -> None:
        """Takes every edge that begins at the positions from first to stop."""
        find, follows, longest, end = self.starts.get, self.follows, self.longest, len(text)
        for low in range(first, stop):
            before = piece[low]
            for high in range(low + 1, min(low + longest, end) + 1):
                found = find(text[low:high], _NONE)
                if found >= 0:
                    if piece[high] == _NONE and (before < 0 or (follows[before << 32 | found] if before << 32 | found in follows else self.may_follow(before, found))):
                        begin[high], piece[high] = low, found
                elif found == _NONE:
                    if high == low + 1:
                        begin[high], piece[high] = low, _UNKNOWN
                    break

    def _path(self, text: str, begin: list[int], piece: list[int], end: int) -> list[int]:
        """The ids of the best path to a position."""
        out: list[int] = []
        while end > 0:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out += [self.byte_ids[b] for b in reversed(text[begin[end] : end].encode())]
            end = begin[end]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them."""
        return list(self.encode_stream(SPACE + text.replace(" ", SPACE))) if text else []

    def decode(self, ids: Sequence[int]) -> str:
        """The text of some ids; bytes that aren't UTF-8 are replaced."""
        body = b"".join(self.texts[i] for i in ids)
        return body[body[:1] == b" " :].decode(errors="replace")


class Batches:
    """Encodes and decodes columns of texts, with a cache of the stretches between spaces."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), {}
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in self.pieces.texts])])
        self.text = np.frombuffer(b"".join(self.pieces.texts), np.uint8)
        self.inside = np.zeros(1 << 16, bool)  # pairs of bytes that stand side by side in a piece
        for name in self.pieces.ids:
            own = np.frombuffer(name.replace(SPACE, " ").encode(), np.uint8).astype(np.int64)
            self.inside[own[:-1] << 8 | own[1:]] = True

    def stretch(self, word: bytes) -> bytes:
        """The ids of the characters between two places where all paths converge."""
        return np.array(list(self.pieces.encode_stream(word.decode().replace(" ", SPACE))), np.int32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offsets."""
        if SPACE.encode() in tb.flat(column)[0].tobytes():
            column = pc.replace_substring(column, SPACE, " ")
        body, offsets = tb.flat(column)
        full = np.flatnonzero(np.diff(offsets))
        body = np.insert(body, offsets[full], 0x20)  # the space before the first word
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        start = np.ones(len(body), bool)
        start[1:] = ~self.inside[body[:-1].astype(np.uint16) << 8 | body[1:]] & ((body[1:] & 0xC0) != 0x80)
        start[offsets[full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(body)) if len(starts) else starts
        codes, distinct = tb.distinct_words(body, starts, ends)
        names, known = distinct.to_pylist(), self.known
        fresh = {w: self.stretch(w) for w in names if w not in known}
        coded = [fresh[w] if w in fresh else known[w] for w in names]
        if len(known) < CACHE_WORDS:
            known.update(fresh)
        at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded], dtype=np.int64)])
        ids, word_at = tb.laid_out(np.frombuffer(b"".join(coded), np.int32), at, codes)
        return ids, word_at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of some lists of ids, as bytes."""
        body, ends = tb.laid_out(self.text, self.text_at, ids.astype(np.int64))
        cuts = ends[at]
        lead = np.flatnonzero(np.diff(cuts))
        lead = lead[body[cuts[lead]] == 0x20]
        kept = np.ones(len(body), bool)
        kept[cuts[lead]] = False
        gone = np.zeros(len(cuts), np.int64)
        gone[lead + 1] = 1
        cuts = (cuts - np.cumsum(gone)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(body[kept]))])


@lru_cache(maxsize=2)
def batches(path: str) -> Batches:
    """One for each model in a worker."""
    return Batches(path)


def encode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: id, ids, n_ids, restored (whether decoding gave the text's bytes back)."""
    source, kinds, kept = carried(df, key, text, carry)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = batches(path)
        for batch in tables:
            _, offsets = tb.flat(batch.column(1))
            for low, high in tb.pieces(offsets, TEXT_BYTES):
                part = batch.slice(low, high - low)
                ids, at = own.encode(part.column(1))
                same = pc.equal(own.decode(ids, at), pc.fill_null(part.column(1), "").cast(pa.binary()))
                yield pa.RecordBatch.from_pydict(kept(part) | {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), "n_ids": pa.array(np.diff(at)), "restored": same})

    return source.mapInArrow(run, f"{kinds}, ids array<int>, n_ids long, restored boolean")


def decode(df: DataFrame, path: str, *, key: str = "id", ids: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids (null and empty lists: the empty text)."""
    source = df.select(F.col(key).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = batches(path)
        for batch in tables:
            lists = batch.column(1)
            at = np.asarray(lists.offsets, np.int64)
            texts = own.decode(np.asarray(lists.values, np.int64)[at[0] : at[-1]], at - at[0])
            yield pa.record_batch([batch.column(0), pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.string())], names=["id", "text"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text string")
