"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours are the encoding of their joint
bytes. So each prefix of a piece has one last token, found from the last tokens of shorter prefixes. While bytes arrive,
only those earlier places matter from which a token could still reach beyond the end read so far; where all their chains
agree, tokens are final and are put out. What remains, the last token put out and the bytes since, is the state; the
distance is bounded by the longest token. A transition and its state are made when met for the second time and kept up to a
bound; before, the prefixes of the rest of the piece are followed side by side.

A piece that is itself a vocabulary entry gives that entry, as in the tiktoken library. Words are cut by Arrow and go to the
transducer when a worker meets them first; ids of texts are gathered from those of their words. Decoding gathers token bytes
in blocks; a state machine over UTF-8 lead and continuation bytes holds back the incomplete character at a block's end.

Defined results: a null text is empty: no ids, empty digests; texts of any length are streamed; repeated rows are encoded
one by one; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of
from tidebar.llm.tokens import binary_array, cut_words, gathered, slices

MAX_STATES = 400_000
CACHED_WORDS = 400_000
BLOCK = 1 << 16


@contextmanager
def collector_off() -> Iterator[None]:
    """Without walks of the tables for cycles, which they do not hold; afterwards the collector leaves them out."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        if was:
            gc.enable()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Reads bytes and puts out tokens as they become final; a piece's end gives those left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        #: state: last token put out or -1, bytes since; per prefix of those bytes its last token and its first token; the
        #: ends of prefixes after which a token can still begin
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (), (), (0,))]
        self.numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: set[int] = set()

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte, None if merges never make it."""
        if token not in self.halves:
            raw, ranks = self.bytes_of[token], self.ranks
            parts = [raw[i:i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                best, rank = -1, token
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1], token)
                    if r < rank:
                        best, rank = i, r
                if best < 0:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = ((token, token) if len(raw) == 1 else
                                  (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None)
        return self.halves[token]

    def _follows(self, left: int, right: int) -> bool:
        """Whether no merge across the border would come before those that make the two tokens. Undoes the merges of both
        sides, latest first, and asks at each moment if the two neighbours at the border would have merged."""
        a, b, before = left, right, 1 << 60
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < before and self._halves(joint) == (a, b):
                return False
            whole_a, whole_b = self.size[a] == 1, self.size[b] == 1
            if whole_a and whole_b:
                return True
            # at equal rank the merge on the left side happens first
            if whole_b or not whole_a and a > b:
                before, a = a, self._halves(a)[1]
            else:
                before, b = b + 1, self._halves(b)[0]

    def _last(self, done: int, raw: bytes, last: Sequence[int], live: Sequence[int]) -> int:
        """The last token of the encoding of `raw` after `done`: the longest that follows what is before it. It begins where a
        token could still reach beyond the last byte but one."""
        ranks, pairs, halves = self.ranks, self.pairs, self.halves
        for start in live:
            token = ranks.get(raw[start:])
            if token is None or (halves[token] if token in halves else self._halves(token)) is None:
                continue
            before = last[start - 1] if start else done
            if before < 0:
                return token
            fits = pairs.get((before, token))
            if fits is None:
                fits = pairs[before, token] = self._follows(before, token)
            if fits:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _extend(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        done, raw, last, first, live = self.states[state]
        raw += bytes((byte,))
        n = len(raw)
        token = self._last(done, raw, last, live)
        start = n - self.size[token]
        last += (token,)
        first += (first[start - 1] if start else token,)
        prefixes = self.prefixes
        live = [e for e in live if raw[e:] in prefixes]
        out: list[int] = []
        while n and 0 not in live:
            head = first[n - 1]
            for e in live:
                if first[e - 1] != head:
                    break
            else:  # all chains that can go on begin with this token
                out.append(head)
                cut = self.size[head]
                done, raw, last, n = head, raw[cut:], last[cut:], n - cut
                live = [e - cut for e in live]
                # places whose chain passes over the cut stay in `last`; no token can start there any more
                again: list[int] = []
                for e in range(1, n + 1):
                    begin = e - self.size[last[e - 1]]
                    again.append(last[e - 1] if begin <= 0 else again[begin - 1])
                first = tuple(again)
                continue
            break
        live.append(n)
        key = (done, raw)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((done, raw, last, first, tuple(live)))
        move = self.moves[state << 8 | byte] = (number, tuple(out))
        return move

    def _simulated(self, state: int, rest: bytes) -> list[int]:
        """What the rest of a piece puts out, all prefixes followed at once; no states are made."""
        done, raw, last, _, live = self.states[state]
        last, live, prefixes = list(last), list(live), self.prefixes
        for i in range(len(rest)):
            raw += rest[i:i + 1]
            last.append(self._last(done, raw, last, live))
            live = [e for e in live if raw[e:] in prefixes]
            live.append(len(raw))
        out, end = [], len(raw)
        while end > 0:
            out.append(last[end - 1])
            end -= self.size[out[-1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > MAX_STATES or len(self.met) > 4 * MAX_STATES:
            self.reset()
        if len(self.pairs) > 4 * MAX_STATES:
            self.pairs.clear()
        state, out, moves, met = 0, [], self.moves, self.met
        end = len(piece) - 1
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if at == end or key not in met:  # a piece's last byte needs no state
                    met.add(key)
                    return out + self._simulated(state, piece[at:])
                move = self._extend(state, byte)
            state, got = move
            if got:
                out += got
        return out + self._simulated(state, b"")


class Utf8Stream:
    """Complete characters of a byte stream. The state is how many bytes of an unfinished character are held."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(tail: bytes) -> int:
        """Bytes at the end that begin a character whose length, told by its lead byte, is not reached."""
        for back in range(1, min(3, len(tail)) + 1):
            lead = tail[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 1
            return back if need > back else 0
        return 0

    def whole(self, raw: bytes) -> bytes:
        """The bytes of complete characters so far."""
        raw = self.held + raw if self.held else raw
        keep = self.unfinished(raw[-3:])
        self.held = raw[len(raw) - keep:]
        return raw[:len(raw) - keep]

    def rest(self) -> bytes:
        left, self.held = self.held, b""
        return left

    def feed(self, raw: bytes) -> str:
        return self.whole(raw).decode("utf-8", "replace")

    def close(self) -> str:
        return self.rest().decode("utf-8", "replace")


class Codec:
    """Texts to ids and back. A worker keeps the ids of a bounded number of words."""

    kept: dict[tuple[str, str], "Codec"] = {}
    dtype = np.dtype("<u4")

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer, self.pattern, self.known = Transducer(read_ranks(path)), regex.compile(pattern), {}
        self.pieces: dict[str, bytes] = {}
        raw = self.transducer.bytes_of
        self.table = pa.array([raw.get(i) for i in range(max(raw) + 1)], pa.binary())

    @classmethod
    def get(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def _piece(self, piece: str) -> bytes:
        got = self.pieces[piece] = np.array(self.transducer.encode(piece.encode("utf-8", "surrogatepass")), self.dtype).tobytes()
        return got

    def _ids(self, words: list[str]) -> list[bytes]:
        known, pieces = self.known, self.pieces
        if len(known) > CACHED_WORDS:
            known.clear()
            pieces.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    word = words[i]
                    out[i] = known[word] = b"".join([pieces.get(p) or self._piece(p) for p in self.pattern.findall(word)])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each. A space before something else always begins a new piece
        of the pattern, so words are encoded one by one."""
        with collector_off():
            return gathered(*cut_words(texts, True), self._ids, self.dtype)

    def decode(self, ids: Iterable[int], block: int = BLOCK) -> Iterator[bytes]:
        """Token bytes in blocks."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        for start in range(0, len(ids), block):
            raw = self.table.take(pa.array(ids[start:start + block]))
            first, last = np.frombuffer(raw.buffers()[1], np.int32)[[raw.offset, raw.offset + len(raw)]]
            yield raw.buffers()[2][int(first):int(last)].to_pybytes()

    def decode_text(self, ids: Iterable[int], block: int = BLOCK) -> Iterator[str]:
        stream = Utf8Stream()
        for raw in self.decode(ids, block):
            yield stream.feed(raw)
        yield stream.close()


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian 32-bit numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path, pattern)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], binary_array(*codec.encode(part["text"]))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(task, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded again as a stream of whole characters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, lengths = codec.encode(part["text"])
                coded, decoded, start = [], [], 0
                for n in lengths.tolist():
                    own, digest, stream = ids[start:start + n], hashlib.sha256(), Utf8Stream()
                    for raw in codec.decode(own):
                        digest.update(stream.whole(raw))
                    digest.update(stream.rest())
                    coded.append(hashlib.sha256(own.tobytes()).hexdigest())
                    decoded.append(digest.hexdigest())
                    start += n
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lengths), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
