"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the characters once. For every place it holds the best
encoding of the text up to there as a backpointer; a piece reaches back by the
maximum piece length at most, so only the places of that window can be continued.
Whenever the paths of all places in the window meet at one boundary, the ids up
to it are committed and forgotten.

With a unigram model the best path has the highest sum of scores. A BPE model
defines another encoding, that of its merges; there, a prefix has exactly one
path whose neighbouring pieces would not have been merged otherwise, and it is
the survivor. Whether two neighbours fit is found by undoing their merges, the
latest first: they do not if the parts that touch make a piece at any time which
would have been merged before the merge that was undone last.

If no piece has a space mark after another character (so it is in public
models), no path crosses from a character to a mark: all paths converge there,
and likewise around ASCII characters that no longer piece contains.
Each stretch between two such boundaries goes through the search. Its ids are
remembered by the worker, within a bound, for when it comes again, and a stretch
goes on from the survivors of the characters that it shares with the one before.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bytes_
from driftwood.sources.workspace import shipped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches in a generation of a worker's memory and pairs of pieces that it knows (some 90 MB together in every Python
#: worker), and the longest stretch that is remembered.
REMEMBERED, PAIRS, LONGEST = 150_000, 300_000, 64
NEVER = float("-inf")
#: Stands for the start and for a character outside of the vocabulary, which nothing merges with.
NOTHING = -1
UNIGRAM, BPE = 1, 2


class Endings(dict):
    """For up to three last characters of a text, the lengths that a piece may have which ends there, longest first."""

    def __init__(self, pieces: Iterable[str]) -> None:
        found: dict[str, set[int]] = {}
        for piece in pieces:
            found.setdefault(piece[-3:], {k for k in (1, 2) if k < len(piece) and piece[-k:] in pieces}).add(len(piece))
        super().__init__({ending: tuple(sorted(sizes, reverse=True)) for ending, sizes in found.items()})

    def __missing__(self, ending: str) -> tuple[int, ...]:
        sizes = self[ending[1:]] if ending else ()
        if len(self) < REMEMBERED:
            self[ending] = sizes
        return sizes


class Pieces:
    """A model: its normal pieces with scores, byte pieces and the way it treats spaces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models without normalisation are read")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.score = [p.score for p in model.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        self.sizes = Endings(self.ids)
        self.text = [b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.text[self.unknown] = " ⁇ ".encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.worst = min(self.score, default=0.0) - 10.0
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined and c != " ")
        # with spaces for marks: a string without other wide characters takes a byte for each
        self.stretch = re.compile(f" *[^ {alone}]+| +|[{alone}]") if alone else re.compile(" *[^ ]+| +")
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.piece = [p.piece for p in model.pieces]
        self.known: dict[int, bool] = {}  # by the ids of two neighbours
        self._last_merge: dict[str, tuple[str, str] | None] = {}

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a BPE model merges last when it makes a piece; none if it makes other pieces of that text."""
        if piece not in self._last_merge:
            parts, ids, score, found = list(piece), self.ids, self.score, None
            worth = lambda x: score[i] if (i := ids.get(x)) is not None else NEVER
            pairs = [worth(parts[k] + parts[k + 1]) for k in range(len(parts) - 1)]  # of each part with the next
            while pairs and (best := max(pairs)) > NEVER:
                k = pairs.index(best)  # the leftmost of equals
                found = parts[k], parts[k + 1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del pairs[k]
                if k < len(pairs):
                    pairs[k] = worth(parts[k] + parts[k + 1])
                if k:
                    pairs[k - 1] = worth(parts[k - 1] + parts[k])
            self._last_merge[piece] = found if len(parts) == 1 else None
        return self._last_merge[piece]

    def fits(self, a: int, b: int) -> bool:
        """Whether a BPE model leaves piece b to the right of a (NOTHING: of no piece), where a fits what is before it."""
        if len(self.known) > PAIRS:
            self.known.clear()
        left, right = self.piece[a] if a >= 0 else "", self.piece[b]
        found = self.known[a << 32 | b] = (len(right) == 1 or self.last_merge(right) is not None) and not (left and self._meet(left, right))
        return found

    def _meet(self, a: str, b: str) -> bool:
        """Whether the end of a and the start of b are merged with each other. Of merges of equal score the leftmost is first."""
        ids, score = self.ids, self.score
        limit, left = NEVER, False  # the merge undone last: its score, and whether it was one of a's
        while True:
            i = ids.get(a + b)
            if i is not None and (score[i] > limit or (score[i] == limit and not left)):
                return True
            last_a = score[ids[a]] if len(a) > 1 else None
            last_b = score[ids[b]] if len(b) > 1 else None
            if last_a is None and last_b is None:
                return False
            if last_b is None or (last_a is not None and last_a < last_b):
                limit, left = last_a, True
                a = self.last_merge(a)[1]
            else:
                limit, left = last_b, False
                b = self.last_merge(b)[0]

    def of_char(self, char: str) -> list[int]:
        """The ids of a character that is not a piece."""
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]


class Search:
    """The streaming search: feed characters, take committed ids, finish."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.text = ""  # characters since the last commit
        self.last = [NOTHING]  # for every place in them, the last piece of its survivor
        self.total = [0.0]  # the survivor's score, of a unigram model
        self.ids: list[int] = []
        self.held = 0  # most places held at once

    def feed(self, chars: str) -> None:
        window = self.p.longest
        extend = self._extend_bpe if self.p.bpe else self._extend_unigram
        for at in range(0, len(chars), window):
            self.text += chars[at : at + window]
            extend()
            if len(self.text) >= 4 * window:
                self._commit()

    def rewind(self, chars: int) -> bool:
        """Takes back all but the first characters, if nothing has been committed."""
        if self.ids:
            return False
        self.text = self.text[:chars]
        del self.last[chars + 1 :], self.total[chars + 1 :]
        return True

    def _extend_bpe(self) -> None:
        """Survivors of the places that have none yet: the longest piece that fits the survivor before it."""
        p, text, last = self.p, self.text, self.last
        ids, known, sizes = p.ids, p.known, p.sizes
        for end in range(len(last), len(text) + 1):
            for size in sizes[text[end - 3 if end > 3 else 0 : end]]:
                if size <= end and (i := ids.get(text[end - size : end])) is not None:
                    pair = last[end - size] << 32 | i
                    if known[pair] if pair in known else p.fits(last[end - size], i):
                        last.append(i)
                        break
            else:
                last.append(NOTHING)

    def _extend_unigram(self) -> None:
        p, text, last, total = self.p, self.text, self.last, self.total
        for end in range(len(last), len(text) + 1):
            best, found = total[end - 1] + p.worst, NOTHING
            for size in range(min(p.longest, end), 0, -1):
                i = p.ids.get(text[end - size : end])
                if i is not None and (score := total[end - size] + p.score[i]) > best:
                    best, found = score, i
            last.append(found)
            total.append(best)

    def _commit(self) -> None:
        """Emits the pieces up to the boundary where all paths that can be continued meet."""
        end = len(self.text)
        self.held = max(self.held, end)
        live = set(range(end - self.p.longest + 1, end + 1))
        while len(live) > 1:
            place = max(live)
            live.remove(place)
            live.add(place - self._size(place))
        meet = live.pop()
        if meet > 0:
            self._emit(meet)
            self.text, self.last, self.total = self.text[meet:], self.last[meet:], self.total[meet:]

    def _emit(self, place: int) -> None:
        self.ids += self._path(place)

    def _size(self, place: int) -> int:
        return len(self.p.piece[self.last[place]]) if self.last[place] >= 0 else 1

    def _path(self, place: int) -> list[int]:
        out, piece, last = [], self.p.piece, self.last
        while place > 0:
            if (i := last[place]) >= 0:
                out.append(i)
                place -= len(piece[i])
            else:
                out += reversed(self.p.of_char(self.text[place - 1]))
                place -= 1
        out.reverse()
        return out

    def finish(self) -> list[int]:
        """All ids; the search may go on from here."""
        return self.ids + self._path(len(self.text))


class _Memory(dict):
    """Ids, as bytes, of stretches of text, in two generations: what was used since the last turn, and before that."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces
        self.old: dict[str, bytes] = {}

    def learn(self, stretches: set[str]) -> None:
        """Searches stretches that are not known. In their order each goes on from the characters that it shares with the one before."""
        search, before = Search(self.pieces), ""
        for stretch in sorted(stretches):
            marked, same = stretch.replace(" ", MARK), 0
            for a, b in zip(before, marked, strict=False):
                if a != b:
                    break
                same += 1
            if not search.rewind(same):
                search, same = Search(self.pieces), 0
            search.feed(marked[same:])
            self[stretch] = array("i", search.finish()).tobytes()
            before = marked

    def turn(self) -> None:
        """Forgets what has not been used for a generation, once the present one is full."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()

    def __missing__(self, stretch: str) -> bytes:
        known = self.old.get(stretch)
        if known is not None:
            self[stretch] = known
            return known
        search = Search(self.pieces)
        search.feed(stretch.replace(" ", MARK))
        return array("i", search.finish()).tobytes()


@lru_cache(maxsize=2)
def _memory(path: str) -> _Memory:
    return _Memory(Pieces(path))


def _stretches(p: Pieces, text: str | None) -> list[str]:
    spaced = (" " if p.prefix else "") + text.replace(MARK, " ") if text else ""
    return p.stretch.findall(spaced) if p.splits else [spaced] if spaced else []


def encode_texts(path: str, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The ids of some texts, whose new short stretches are searched together; long ones are searched where they stand."""
    memory = _memory(path)
    split = [_stretches(memory.pieces, text) for text in texts]
    memory.learn({x for stretches in split for x in stretches if x not in memory and x not in memory.old and len(x) <= LONGEST})
    for stretches in split:
        yield np.frombuffer(b"".join([memory[x] for x in stretches]), np.int32)
    memory.turn()


def encode_text(path: str, text: str | None) -> np.ndarray:
    return list(encode_texts(path, [text]))[0]


def decode_ids(path: str, ids: Iterable[int]) -> str:
    """The text of ids; bytes that are not UTF-8 become U+FFFD."""
    p = _memory(path).pieces
    out = b"".join(map(p.text.__getitem__, ids)).decode("utf-8", "replace")
    return out[1:] if p.prefix and out.startswith(" ") else out


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in bytes_.slices(batches):
            ids, same = [], []
            texts = batch.column("text").to_pylist()
            for text, own in zip(texts, encode_texts(path, texts), strict=True):
                ids.append(own)
                same.append(decode_ids(path, ids[-1].tolist()) == (text or "").replace(MARK, " "))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), lists, pa.array(same)], ["doc_id", "n_ids", "ids", "round_trip"])

    return run


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The ids of every whole text, and whether they decode to it.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. Returns
    doc_id, n_ids, ids (array of int) and round_trip: decoding gives the text
    again, with U+2581, which the format reserves for the space, as a space.
    Null and empty texts have no ids. ``model`` is a path that every executor
    can open. One row per row, repeated ones too; an empty table gives none. A
    very long text goes through the search as it is, which holds a window of it
    beside its ids. Of equally scored merges the leftmost is first, and of
    equally scored unigram paths the one with the longest last piece.
    """
    rows = shipped(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_coded(model), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else decode_ids(path, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of (doc_id, ids); null ids give a null text."""
    return shipped(rows).select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, text string")
