"""Ids of texts from the ids of their distinct parts, shared by the two tokenizers' encoders.

Texts of Latin-1 characters are divided together, as bytes: classes of characters give the places where parts begin,
Arrow numbers the distinct parts, each of these is looked up once a block of texts, and arrays put the ids together.
Other texts are divided one by one. What a tokenizer's rule is, its subclass says.
"""
from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PLAIN = re.compile("[\t\n\r -~¡-ÿ]*")
SPECIAL = "<|"  # begins the special tokens' strings
SPACE, LETTER, NUMBER, OTHER = range(4)
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on.
BYTE_NAMES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SHORT, _LONG = np.zeros(256, bool), np.zeros(1 << 16, bool)
_SHORT[[ord(c[1]) for c in CONTRACTIONS if len(c) == 2]] = True
_LONG[[ord(c[1]) << 8 | ord(c[2]) for c in CONTRACTIONS if len(c) == 3]] = True


class Remembered(dict):
    """Values of keys in two generations: where the younger holds `most`, it becomes the older one, which is dropped.

    `known[key]` takes a key of the older generation over. For one that neither holds it gives a buffer of `unseen`,
    the same one for equal keys: the caller fills it, and stores the value.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict = {}
        self.unseen: defaultdict = defaultdict(bytearray)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            return self.unseen[key]
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def classes(letters: str, numbers: str) -> np.ndarray:
    """Class of each Latin-1 character, by the bodies of two regular expression sets."""
    found = np.full(256, OTHER, np.uint8)
    for kind, rule in ((SPACE, r"\s"), (LETTER, f"[{letters}]"), (NUMBER, f"[{numbers}]")):
        found[[b for b in range(256) if re.match(rule, chr(b))]] = kind
    return found


def part_contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Move the starts of parts so that an apostrophe that begins a part takes the letters of a contraction along.

    `start` marks the parts, `first` the texts; both have a place for the end.
    """
    at = np.flatnonzero((data == 39) & start[:-1] & ~first[1:])  # at + 1 is in the same text
    if not len(at):
        return
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    short = _SHORT[padded[at + 1]]
    long = _LONG[padded[at + 1] << 8 | padded[at + 2]] & ~first[np.minimum(at + 2, len(data))]
    start[at[short | long] + 1] = False
    end = np.concatenate([at[short] + 2, at[long] + 3])
    end = end[end < len(data)]
    start[end[kind[end] == LETTER]] = True


def distinct_parts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of each part among the distinct ones, and these; a part ends where the next one begins.

    Parts of up to eight bytes, none of them zero, are told apart as integers.
    """
    size = np.diff(np.append(starts, len(data)))
    short = size <= 8
    number = np.empty(len(starts), np.int64)
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))
    few = pa.array(eights[starts[short]] & _FIRST_BYTES[size[short]]).dictionary_encode()
    number[short] = few.indices.to_numpy()
    offsets = np.append(0, np.cumsum(size[~short])).astype(np.int32)
    rest = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[np.repeat(~short, size)])]).dictionary_encode()
    number[~short] = rest.indices.to_numpy().astype(np.int64) + len(few.dictionary)
    found = few.dictionary.to_numpy().astype("<u8").view("S8").tolist() + rest.dictionary.to_pylist()
    return number, [part.decode("latin-1") for part in found]


def joined(values: list, number: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The values of numbered parts one after another, of each run of parts between two bounds."""
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    size = sizes[number]
    ends = np.append(0, np.cumsum(size))
    raw = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    cuts = (4 * ends[bounds]).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class PartEncoder:
    """Ids of texts as little-endian 32-bit values; one per worker. Subclasses divide texts and encode unseen parts."""

    def __init__(self, path: str, remembered: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.remembered = remembered // 2
        self.forget()

    def forget(self) -> None:
        """Give the memory of a task's words back: idle workers wait in numbers, each with what it holds."""
        self.known = Remembered(self.remembered)
        self.waiting: dict = {}
        pa.default_memory_pool().release_unused()

    def divide(self, text: str) -> list[str]:
        """Parts that the tokenizer encodes on their own."""
        raise NotImplementedError

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts of Latin-1 characters: bytes of the parts, where each begins, and the parts before each text and in all."""
        raise NotImplementedError

    def learn(self) -> None:
        """Encode and fill the parts in `known.unseen`."""
        raise NotImplementedError

    def segments(self, text: str):
        """A long text in slices that the tokenizer encodes on their own."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts together; long ones are handled in segments."""
        out: list = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for segment in self.segments(text):
                held.append((i, segment))
                size += len(segment)
                if size > SEGMENT:
                    self._fill(held, out)
                    held, size = [], 0
        self._fill(held, out)
        return [b"".join(parts) for parts in out]

    def _fill(self, held, out) -> None:
        plain = [bool(PLAIN.fullmatch(text)) and SPECIAL not in text for _, text in held]
        others = [list(map(self.known.__getitem__, self.divide(text))) for (_, text), is_plain in zip(held, plain) if not is_plain]
        data, starts, bounds = self.plain([text for (_, text), is_plain in zip(held, plain) if is_plain])
        number, parts = distinct_parts(data, starts)
        values = list(map(self.known.__getitem__, parts))
        self.learn()
        done, others = iter(joined(values, number, bounds)), map(b"".join, others)
        for (i, _), is_plain in zip(held, plain):
            out[i].append(next(done if is_plain else others))

    def _keep(self, parts: list[str], ids: bytes, ends: list[int], gap: int = 0) -> None:
        """Remember consecutive ids of parts, which end at these bytes, and fill what waits for them."""
        begin = 0
        for part, end in zip(parts, ends, strict=True):
            value = self.known[part] = ids[begin:end]
            self.waiting[part].extend(value)
            begin = end + gap


def as_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 bytes of the texts, their bounds, and marks where they begin, with a place for the end."""
    raw = [text.encode("latin-1") for text in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]).astype(np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    return data, bounds, first
