"""Byte-level BPE on the executors: exact splitting and cached encoding.

A text falls into pre-tokens that BPE encodes one by one, so ids of a text are
the joined ids of its pre-tokens. Only pre-tokens not met before go to the
tokenizers library; the rest are dictionary look-ups.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the public byte-level BPE files: the split pattern, the one
# added token and its id.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"

# SPLIT for texts whose characters Python's re classes treat as \p{L}, \p{N} and \s do.
_PLAIN_SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_SPACE_RUN = re.compile(r"\s (?:\s|\Z)")
# White space and separators that the quick tests for runs don't look at.
_CONTROL = re.compile("[\t\x0b\x0c\r\x1c-\x1f]")
# All four tests of `Encoder._odd` at once, for Arrow.
_ODD = rf"[\t\x0b\x0c\r\x1c-\x1f]|[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]|[ \n\x85\xa0] (?:[ \n\x85\xa0]|\z)|{re.escape(END_OF_TEXT)}"


def tokenizer_json(path: str) -> str:
    """The tokenizer file, read on the driver; about 1.5 MB, sent with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _at_spaces(text: str) -> list[str]:
    parts = text.replace(" ", "\x1f ").split("\x1f")
    return parts if parts[0] else parts[1:]


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Truncation and padding are switched off. Known strings are kept in two
    generations of at most ``most`` entries: the older one goes when the younger
    one is full, and what is met again moves to the younger one.
    """

    def __init__(self, spec: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.model._resize_cache(0)  # words are kept here
        self.end_of_text = np.array([self.tok.token_to_id(END_OF_TEXT)], "<u4").tobytes()
        # Bytes as the model's characters; 0xff, which UTF-8 never has, as a border.
        self.chars = {b: c for c, b in byte_of_char().items()} | {0xFF: "\n"}
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, in order; joined they are the text."""
        if not _NOT_PLAIN.search(text) and END_OF_TEXT not in text:
            return _PLAIN_SPLIT.findall(text)
        out: list[str] = []
        for i, part in enumerate(text.split(END_OF_TEXT)):
            if i:
                out.append(END_OF_TEXT)
            if part:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, each as little-endian unsigned 32-bit integers.

        They go to the library's model, past its own splitting and offsets.
        """
        if not words:
            return []
        tokenize = self.tok.model.tokenize
        spelled = b"\xff".join(map(str.encode, words)).decode("latin-1").translate(self.chars).split("\n")
        ids, cuts = [], []
        for w in spelled:
            ids += [t.id for t in tokenize(w)]
            cuts.append(len(ids) << 2)
        raw = np.array(ids, "<u4").tobytes()
        return [self.end_of_text if w == END_OF_TEXT else raw[a:b] for w, a, b in zip(words, [0, *cuts], cuts, strict=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; those not known are encoded, and those of the older generation made young."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        got = list(map(self.young.get, words))
        missing = [i for i, ids in enumerate(got) if ids is None]
        found = list(map(self.old.get, [words[i] for i in missing]))
        new = iter(self.encode_words([words[i] for i, ids in zip(missing, found, strict=True) if ids is None]))
        for i, ids in zip(missing, found, strict=True):
            got[i] = self.young[words[i]] = next(new) if ids is None else ids
        return got

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether a text must be split by its pre-tokens from the start."""
        return bool(("  " in text or "\n " in text or not text.isascii()) and (_NOT_PLAIN.search(text) or _SPACE_RUN.search(text)) or END_OF_TEXT in text or _CONTROL.search(text))

    def stretches(self, text: str) -> list[str]:
        """Stretches of a text, in order, that no pre-token crosses; joined they are the text."""
        return self.split(text) if self._odd(text) else _at_spaces(text)

    def encode_once(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches, without keeping them."""
        split = [self.split(s) for s in stretches]
        words = list(set().union(*split))
        of = dict(zip(words, self.encode_words(words), strict=True)).__getitem__
        return [b"".join(map(of, w)) for w in split]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has; null is empty.

        Most texts are cut at their spaces, each going to what follows it. Where no
        white space stands on both sides of a space, such a cut is always a border
        of pre-tokens. Arrow cuts and numbers the stretches, then the pre-tokens of
        the different ones, and joins ids in the same two steps; Python sees each
        different stretch of several pre-tokens and each different pre-token once.
        """
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
        plain = pc.fill_null(texts.filter(pa.array(~odd)) if odd.any() else texts, "")
        parts = pc.split_pattern(plain, " ")
        values, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        begins = ends[:-1]
        coded, heads = values.dictionary_encode(), values.take(pa.array(begins)).dictionary_encode()
        # What comes first in a text has no space before it; if it is empty, the text begins with a space.
        which = coded.indices.to_numpy().copy()
        which[begins] = heads.indices.to_numpy() + len(coded.dictionary)
        ids = self._of_stretches(coded.dictionary, heads.dictionary)
        sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        flat = ids.take(pa.array(which)).flatten().to_numpy()
        lens = np.diff(_running(sizes[which])[ends])
        return (flat, lens) if not odd.any() else self._with_odd(texts, odd, flat, lens)

    def _of_stretches(self, after_space: pa.StringArray, heads: pa.StringArray) -> pa.ListArray:
        """Ids of different stretches: those behind a space, without it, and those at the head of a text."""
        space, nothing = (pa.scalar(x, after_space.type) for x in (" ", ""))
        stretches = pa.concat_arrays([pc.binary_join_element_wise(space, after_space, nothing), heads])
        # A space and letters are one pre-token.
        alone = np.concatenate([pc.utf8_is_alpha(after_space).to_numpy(zero_copy_only=False), np.zeros(len(heads), bool)])
        several, n_several = [], []
        for x in _strings(stretches.filter(pa.array(~alone))):
            words = _PLAIN_SPLIT.findall(x)
            several += words
            n_several.append(len(words))
        counts = np.ones(len(alone), np.int64)
        counts[~alone] = n_several
        words = pa.concat_arrays([stretches.filter(pa.array(alone)), pa.array(several, stretches.type)]).dictionary_encode()
        # Numbers of the pre-tokens in the order of the stretches.
        places, single = words.indices.to_numpy(), np.repeat(alone, counts)
        which = np.empty(len(places), places.dtype)
        which[single], which[~single] = places[: alone.sum()], places[alone.sum() :]
        of = self.of_words(_strings(words.dictionary))
        sizes = np.fromiter(map(len, of), np.int64, len(of)) >> 2
        flat = _lists(_running(sizes), np.frombuffer(b"".join(of), "<i4")).take(pa.array(which)).flatten()
        return _lists(_running(sizes[which])[_running(counts)], flat)

    def _with_odd(self, texts: pa.StringArray, odd: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts with those of odd ones between them."""
        plain = iter(np.split(flat, np.cumsum(lens)[:-1]) if len(lens) else [])
        out = []
        for text, is_odd in zip(texts.to_pylist(), odd.tolist(), strict=True):
            if not is_odd:
                out.append(next(plain))
                continue
            words = self.split(text)
            different = list(dict.fromkeys(words))
            of = dict(zip(different, self.of_words(different), strict=True)).__getitem__
            out.append(np.frombuffer(b"".join(map(of, words)), "<i4"))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _running(counts: np.ndarray) -> np.ndarray:
    """Where each of some pieces begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _strings(values: pa.StringArray) -> list[str]:
    """``to_pylist`` without a scalar for each string."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def slices(batch: pa.RecordBatch, column: str, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts have about ``most`` bytes; a longer text is a piece of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker process and tokenizer, kept between tasks."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def byte_of_char() -> dict[str, int]:
    """Byte for each character of the byte-level alphabet, by its public rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def pieces_by_id(spec: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of every token of the vocabulary, added tokens included."""
    from tokenizers import Tokenizer

    tok, of = Tokenizer.from_str(spec), byte_of_char()
    added = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    out = []
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        out.append((i, added[i].encode() if i in added else bytes(of[c] for c in piece)))
    return sorted(out)
