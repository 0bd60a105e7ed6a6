"""Whole texts to token ids with a tokenizers file, each distinct word of a batch encoded once.

Both vocabularies split a text at spaces before any merge, so a text's ids are those of its words in turn. Words are cut
and counted by Arrow, new ones go to the library, and ids are gathered back with NumPy. A worker keeps the ids of a bounded
number of words.

The library pays per call result, so most new words go to it in joined texts. The ids are cut again where a token begins
with a space or bears the vocabulary's mark for the end of a piece, whose number in such words is known.

A text that holds the string of one of the file's special tokens goes to the library whole, which gives that token its own id
there, as it does by default; `add_special_tokens=False` only keeps it from adding such tokens of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 500_000
SLICE_BYTES = 8 << 20
#: A space before something that is not white space always begins a new piece; other spaces may join their neighbours.
_PLAIN = " (?=\\S)"
_LOOSE = " [\\s\\v\\x1c-\\x1f\\x{85}\\pZ]"
JOINED_WORDS = 256
#: Pieces of the pattern of words whose characters no normaliser changes (an apostrophe may begin a longer piece).
_PIECE = re.compile("[a-z\xe0-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@[-`{-~]+")
_STEADY = re.compile("[!-&(-@[-~\xe0-\xf6\xf8-\xff]+")
_encoders: dict[tuple[str, bool], "WordEncoder"] = {}


class WordEncoder:
    """`lead`: words carry the space before them (byte-level files); else white space is dropped and case ignored."""

    def __init__(self, path: str, lead: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lead, self.known = lead, {}
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        #: ids that begin a word with its space, or that end a piece
        self.border = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = self.library.model.end_of_word_suffix if not lead else None
        for token, i in vocabulary.items():
            self.border[i] = token.startswith("\u0120") if lead else bool(suffix) and token.endswith(suffix)

    @staticmethod
    def get(path: str, lead: bool) -> "WordEncoder":
        if (path, lead) not in _encoders:
            _encoders[path, lead] = WordEncoder(path, lead)
        return _encoders[path, lead]

    def _ids(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        plain = [(w, n) for w in new if (n := self._borders(w))]
        for start in range(0, len(plain), JOINED_WORDS):
            self._joined(plain[start:start + JOINED_WORDS])
        new = [w for w in new if w not in known]
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, self.dtype).tobytes()
        return [known[w] for w in words]

    def _borders(self, word: str) -> int:
        """How many borders the word has wherever it stands; 0 where that is not certain."""
        if self.lead:
            return int(word[:1] == " " and len(word) > 1 and not word[1].isspace() and " " not in word[1:])
        return len(_PIECE.findall(word)) if _STEADY.fullmatch(word) else 0

    def _joined(self, words: list[tuple[str, int]]) -> None:
        """Keep the ids of words with known numbers of borders; of none where these do not come out."""
        text = ("" if self.lead else " ").join(w for w, _ in words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.border[ids])
        last = np.cumsum([n for _, n in words])
        if len(at) != last[-1]:
            return
        ends = (np.append(at[1:], len(ids)) if self.lead else at[last - 1] + 1) * self.dtype.itemsize
        raw, start = ids.tobytes(), 0
        for (w, _), end in zip(words, ends.tolist()):
            self.known[w] = raw[start:end]
            start = end

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        special = np.zeros(len(texts), bool)
        for token in self.specials:
            special |= pc.match_substring(texts, token, ignore_case=not self.lead).to_numpy(zero_copy_only=False)
        if not special.any():
            return gathered(*cut_words(texts, self.lead), self._ids, self.dtype)
        ids, sizes = gathered(*cut_words(texts.filter(pa.array(~special)), self.lead), self._ids, self.dtype)
        whole = self._whole(texts.filter(pa.array(special)))
        lengths = np.zeros(len(texts), np.int64)
        lengths[~special], lengths[special] = sizes, list(map(len, whole))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out, done = [], 0
        for at, own in zip(np.flatnonzero(special), whole):
            plain = int((~special[:at]).sum())
            out += [ids[ends[done]:ends[plain]], own]
            done = plain
        return np.concatenate([*out, ids[ends[done]:]]), lengths


def cut_words(texts: pa.Array, lead: bool) -> tuple[np.ndarray, pa.Array]:
    """Words per text, and all words; with `lead` a word carries the space before it, else white space and case go."""
    if not lead:
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    elif pc.any(pc.match_substring_regex(texts, _LOOSE)).as_py():
        cut = pa.array([re.split(_PLAIN, t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        cut = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    words = cut.flatten()
    if lead and len(words):
        first = np.zeros(len(words), bool)
        first[np.cumsum(sizes)[:-1]] = True
        first[0] = True
        words = pc.if_else(pa.array(first), words, pc.binary_join_element_wise("", words, " "))
    return sizes, words


def gathered(sizes: np.ndarray, words: pa.Array, ids_of: Callable[[list[str]], list[bytes]], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the number of ids of each text; `ids_of` gets each distinct word once."""
    coded = words.dictionary_encode()
    table = ids_of(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // dtype.itemsize
    flat = np.frombuffer(b"".join(table), dtype)
    starts = np.cumsum(lengths) - lengths
    at = coded.indices.to_numpy(zero_copy_only=False)
    n = lengths[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)] if len(flat) else flat
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return ids, np.diff(bounds)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size (one text at least)."""
    size = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(int(np.searchsorted(size, before + SLICE_BYTES, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values cut from one buffer of numbers, `lengths` numbers each."""
    offsets = np.concatenate([[0], np.cumsum(lengths * data.dtype.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id after each document."""
    grown = lengths + 1
    out = np.full(int(grown.sum()), end_id, ids.dtype)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(grown) - 1] = False
    out[mask] = ids
    return out, grown
