"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice has a node at each character boundary and an edge for each piece; an automaton of all pieces lists the
edges while the text streams by in blocks. An edge is admissible if the model's merges, run on it and on the piece
before it, give back exactly these two; by the locality of merges a path of admissible edges is the model's own
segmentation of a prefix, so each node keeps one back pointer. The edges that are still to come start within the longest
piece's length of the last node, so only the paths that end there survive. Whenever they all lead through one boundary,
the ids before it are committed and the window starts there anew: it holds a block and the tail of the one before,
whatever the length of the text. All paths meet in front of each run of spaces, too; the ids committed for short
stretches between two such places are remembered, up to a bound. Rows are taken in by parts of bounded size: each
different stretch of a part is looked up or searched once, and Arrow puts the ids of all its stretches together.

Defined results: a null text has null ids; an empty one no ids. Decoding gives the text back, except that a text's own
space marks (U+2581) come back as spaces. Rows that repeat are encoded each. Other columns are ignored. An empty table
returns no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

MARK = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
#: Characters that the search takes in at a time.
BLOCK = 1024
#: Neighbouring pieces whose admissibility a Python worker remembers, and twice the stretches whose ids it remembers; their
#: longest length in characters.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 40
#: Bytes of rows, characters of a long row and ids of rows that are taken in together; a stretch without a boundary may be longer.
TOGETHER, PART, DECODED = 1 << 18, 1 << 15, 1 << 18
#: A boundary at which all paths meet: a run of spaces behind another character.
_BOUNDARY = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")
#: Codes of back pointers that are no pieces: none yet, the start, and from there on characters without a piece.
_NONE, _START = -1, 1 << 19


def load(path: str) -> list[tuple[str, float, int]]:
    """Pieces of a model file with their scores and types, by id. Only plain BPE models with the identity normaliser are taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("the model is not a BPE model with byte fallback, a dummy prefix and no normalisation")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Codec:
    """Encodes and decodes with the pieces of a model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.score = {p: s for p, s, kind in pieces if kind == _NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.byte = [0] * 256
        self.bytes = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte[int(p[3:5], 16)] = i
            self.bytes.append(bytes([int(p[3:5], 16)]) if kind == _BYTE else p.encode() if kind == _NORMAL else " ⁇ ".encode() if kind == _UNKNOWN else b"")
        self.longest = max(map(len, self.id))
        self.name = [p for p, _, _ in pieces]
        self.lengths = list(map(len, self.name))
        self.characters = np.array(self.lengths)
        #: What pieces decode to, and behind them the same without a space in front, for those that begin a text.
        spaced = [b.replace(MARK.encode(), b" ") for b in self.bytes]
        self.decoded = pa.array(spaced + [b.removeprefix(b" ") for b in spaced], pa.large_binary())
        self.silent = np.array([not b for b in self.bytes])
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        #: Pieces that were found to stand, or not to stand, in front of each piece.
        self.after: list[set[int]] = [set() for _ in pieces]
        self.never: list[set[int]] = [set() for _ in pieces]
        self.remembered = 0
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a space mark behind another character")
        self.edges = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1 and self.merge(p) == [p]:
                i = self.id[p]
                self.edges.add_word(p, (len(p), i, self.after[i], self.never[i]))
        self.edges.make_automaton()
        #: A node that no longer piece reaches is reached by its character alone.
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        self.strange = re.compile(f"[^{''.join(map(re.escape, self.single))}]")

    def merge(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The model's merges by definition: the best scoring pair of neighbours first, the leftmost of equals.

        ``steps`` gets each merge's score and the first and last part after it.
        """
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            if (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, len(part[a]) + len(part[b])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        last = len(part) - 1
        while queue:
            worst, a, size = heapq.heappop(queue)
            b = after[a] if part[a] else len(part)
            if b >= len(part) or len(part[a]) + len(part[b]) != size or part[a] + part[b] not in self.score:
                continue
            part[a] += part[b]
            part[b] = ""
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
                offer(a, after[a])
            else:
                last = a
            if before[a] >= 0:
                offer(before[a], a)
            if steps is not None:
                steps.append((-worst, part[0], part[last]))
        return [p for p in part if p]

    def stepped(self, piece: int) -> list[tuple[float, str, str]]:
        """The merges that make a piece, and one that never comes."""
        if (found := self.steps.get(piece)) is None:
            found = self.steps[piece] = []
            self.merge(self.name[piece], found)
            found.append((-inf, "", ""))
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep the boundary between two pieces. Characters without a piece never merge.

        Until a merge crosses the boundary, both sides merge as they do alone, in turns by score; so it is enough to see
        whether the parts beside the boundary are ever the best pair. Of equals the left side's pairs stand in front of that
        pair and the right side's behind it.
        """
        if left >= _START:
            return True
        if self.remembered >= REMEMBERED:
            self.remembered = 0
            for known in (*self.after, *self.never):
                known.clear()
        self.remembered += 1
        score, before, behind = self.score, self.stepped(left), self.stepped(right)
        a, b, i, j = self.name[left][-1], self.name[right][0], 0, 0
        while True:
            across, one, other = score.get(a + b, -inf), before[i][0], behind[j][0]
            found = not (across > one and across >= other)
            if not found or one == other == -inf:
                break
            if one >= other:
                a = before[i][2]
                i += 1
            else:
                b = behind[j][1]
                j += 1
        (self.after if found else self.never)[right].add(left)
        return found

    def search(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Back pointers along the path of a stream of blocks of characters, committed as early as the surviving paths allow.

        A pointer is a piece's id, or ``_START + 1`` and the code point of a character without a piece.
        """
        # back[i] is the piece that ends with the window's i-th character; a character in front of all stands for the start.
        fits, strange, single, reach = self.fits, self.strange, self.single, self.longest
        window, back, done = "\0", [_START], 0
        for block in blocks:
            first = len(window)
            window += block
            back += [_NONE] * len(block)
            for m in strange.finditer(block):
                back[first + m.start()] = _START + 1 + ord(m.group())
            for end, (length, right, after, never) in self.edges.iter(window):
                if back[end] < 0:
                    left = back[end - length]
                    if left < 0:  # all longer pieces that end there have been seen
                        left = back[end - length] = single[window[end - length]]
                    if left in after or left not in never and fits(left, right):
                        back[end] = right
            last = len(back) - 1
            # Edges to come start behind these characters; what all their paths share is settled.
            alive = set(range(max(done, last - reach + 1), last + 1))
            while len(alive) > 1:
                node = max(alive)
                alive.discard(node)
                alive.add(max(done, self.before(window, back, node)))
            meet = alive.pop()
            if meet > done:
                yield self.path(window, back, done, meet)
            # The next pieces start within reach; the character before the first of them tells its left neighbour.
            start = max(0, min(meet, last - reach))
            window, done = window[start:], meet - start
            back = [single[c] if p < 0 else p for c, p in zip(window, back[start:], strict=True)]
        yield self.path(window, back, done, len(back) - 1)

    def before(self, window: str, back: list[int], node: int) -> int:
        """The node in front of the piece that ends at ``node``."""
        piece = back[node]
        if piece < 0:
            piece = back[node] = self.single[window[node]]
        return node - (1 if piece >= _START else self.lengths[piece])

    def path(self, window: str, back: list[int], done: int, node: int) -> list[int]:
        out, single, lengths = [], self.single, self.lengths
        while node > done:
            piece = back[node]
            if piece < 0:
                piece = single[window[node]]
            out.append(piece)
            node -= lengths[piece] if piece < _START else 1
        return out[::-1]

    def stream(self, text: str, start: int, end: int) -> Iterator[str]:
        """A stretch of the text as the model sees it, block by block; a space mark stands in front of all texts."""
        if not start:
            yield MARK
        for at in range(start, end, BLOCK):
            yield text[at : min(end, at + BLOCK)].replace(" ", MARK)

    def ids(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream, in pieces as they are committed."""
        for found in self.search(blocks):
            if found and max(found) >= _START:
                yield [i for p in found for i in ([p] if p < _START else [self.byte[b] for b in chr(p - _START - 1).encode()])]
            else:
                yield found

    def learn(self, stretches: list[str]) -> list[bytes]:
        """The ids of stretches that each begin with spaces and end without, as int32 bytes: one search over all of them."""
        whole = "".join(stretches).replace(" ", MARK)
        path = list(chain.from_iterable(self.search(whole[at : at + BLOCK] for at in range(0, len(whole), BLOCK))))
        found = np.array(path, np.int32)
        strange = np.flatnonzero(found >= _START)
        known = found.copy()
        known[strange] = 0
        reached, sizes = self.characters[known], np.ones(len(found), np.int64)
        reached[strange] = 1
        if len(strange):
            as_bytes = [[self.byte[b] for b in chr(p - _START - 1).encode()] for p in found[strange].tolist()]
            sizes[strange] = list(map(len, as_bytes))
            known = np.repeat(known, sizes)
            known[np.repeat(found >= _START, sizes)] = list(chain.from_iterable(as_bytes))
        last = np.searchsorted(np.cumsum(reached), np.cumsum(list(map(len, stretches))))
        ends, ids = (4 * np.cumsum(sizes)[last]).tolist(), known.tobytes()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def recall(self, stretches: list[str]) -> list[bytes]:
        """The ids of different stretches as int32 bytes. What the search commits for short ones is remembered."""
        if len(self.known) > REMEMBERED // 4:  # stretches that come again move on, the others go
            self.known, self.earlier = {}, self.known
        known, earlier, unknown = self.known, self.earlier, []
        out = list(map(known.get, stretches))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            s = stretches[k]
            if (ids := earlier.get(s)) is not None:
                out[k] = known[s] = ids
            elif s[-1] == " ":  # the end of a text: the next stretch's spaces are others
                out[k] = array("i", chain.from_iterable(self.ids([s.replace(" ", MARK)]))).tobytes()
            else:
                unknown.append(k)
        if unknown:
            for k, ids in zip(unknown, self.learn([stretches[k] for k in unknown]), strict=True):
                out[k] = ids
                if len(stretches[k]) <= REMEMBERED_LENGTH:
                    known[stretches[k]] = ids
        return out

    def together(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows without nulls, one behind the other, and where each row's begin and end.

        A row is empty or begins with a space, as the model sees texts. No piece holds a space mark behind another
        character, so all paths meet in front of a run of spaces; each stretch from one to the next has ids of its own.
        """
        if pc.any(pc.match_substring(rows, MARK)).as_py():
            rows = pc.replace_substring(rows, MARK, " ")
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int32), offsets
        space = data == ord(" ")
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(first)
        stretches = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self.recall(stretches.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(stretches.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        return np.frombuffer(ids.buffers()[2], np.int32)[: ends[-1]], ends[np.searchsorted(begin, offsets)]

    def parts(self, text: str) -> Iterator[tuple[int, int]]:
        """Where to cut a text in front of runs of spaces, so that a part is no longer than ``PART`` or is a single stretch."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PART:
                last = max(text.rfind(" ", at, at + PART), text.rfind(MARK, at, at + PART))
                end = at + len(text[at:last].rstrip(f" {MARK}")) if last > at else at
                if end == at:
                    end = m.start() if (m := _BOUNDARY.search(text, at + 1)) else len(text)
            yield at, end
            at = end

    def encode_bytes(self, text: str) -> bytearray:
        """The ids of a text as int32 bytes. A stretch longer than a part goes through the search block by block."""
        out = bytearray()
        for start, end in self.parts(text):
            if end - start <= PART:
                out.extend(self.together(pa.array([text[start:end] if start else " " + text[start:end]], pa.large_string()))[0].tobytes())
            else:
                for ids in self.ids(self.stream(text, start, end)):
                    out.extend(array("i", ids).tobytes())
        return out

    def encode_rows(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The lists of ids of an array of texts, by parts."""
        for at, end in _runs(pc.binary_length(texts), TOGETHER):
            part = texts.slice(at, end - at)
            if end - at == 1 and len(text := part[0].as_py() or "") > PART:
                ids = np.frombuffer(self.encode_bytes(text), np.int32)
                ends = np.array([0, len(ids)])
            else:
                nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
                rows = pc.fill_null(part.cast(pa.large_string()), nothing)
                ids, ends = self.together(pc.if_else(pc.equal(rows, nothing), nothing, pc.binary_join_element_wise(nothing, rows, space)))
            yield _lists(ids, ends, part)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def decode_rows(self, lists: pa.Array) -> Iterator[pa.Array]:
        """The texts of an array of lists of ids, by parts."""
        for at, end in _runs(pc.list_value_length(lists), DECODED):
            part = lists.slice(at, end - at)
            if (texts := self.joined(part)) is None:
                texts = pa.array([None if not ids.is_valid else self.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in part], pa.string())
            yield texts

    def joined(self, lists: pa.Array) -> pa.Array | None:
        """The texts of lists of ids, the pieces' bytes end to end; nothing if some are no texts as they stand or hold a space mark out of bytes."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        ids = lists.flatten().to_numpy(zero_copy_only=False).copy()
        begin = ends[:-1][sizes > 0]
        if not len(ids) or ids.min() < 0 or ids.max() >= len(self.bytes) or self.silent[ids[begin]].any():
            return None
        ids[begin] += len(self.bytes)
        whole = self.decoded.take(pa.array(ids))
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][ends].astype(np.int32)
        if MARK.encode() in (data := whole.buffers()[2].to_pybytes()):
            return None
        texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(data))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return None
        return texts if not lists.null_count else pc.if_else(lists.is_valid(), texts, None)


def _runs(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``most`` in all, or of a single row."""
    start, total = 0, 0
    for k, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if total + n > most and k > start:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _lists(ids: np.ndarray, ends: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of ids that end there, null where ``like`` is."""
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=mask)


_CODECS: dict[bytes, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a Python worker and model, by the model's digest."""
    digest, pieces = shared.value
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(pieces)
    return _CODECS[digest]


def _share(docs: DataFrame, model_path: str):
    """The broadcast model: its digest and one file of pieces, whatever the corpus."""
    pieces = load(model_path)
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(pieces).encode()).digest(), pieces))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row."""
    shared = _share(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for ids in codec.encode_rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=["doc_id", "ids"])
                at += len(ids)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema_with(picked.select("doc_id"), "ids array<int>"))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: the texts of lists of ids."""
    shared = _share(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for texts in codec.decode_rows(batch.column(1)):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "text"])
                at += len(texts)

    picked = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, schema_with(picked, "text string"))


def default_model() -> str:
    """Where the public 32k model stands on the driver. Any other path can be given."""
    return "/opt/tokenizers/piece_bpe_32k.model"
