"""Token ids of whole texts, with a public tokenizer file.

The ids are the tokenizers library's own. Most of its time goes into normalizing and splitting text, so
texts are cut at ASCII white space by Arrow, and each distinct chunk is encoded once; the cache is emptied when it is
full and at the end of a task. A chunk of lower-case Latin letters needs no normalizing, so many such words go to the
library's BPE in one call; any other chunk is encoded by the unchanged tokenizer. Cutting is safe as the
tokenizer's normalizer (NFC, white space, lower case) and its split never join text across white space.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Lower-case words of these letters are their own NFC form and one piece of the split.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: ASCII marks become "!", bytes of other than Latin letters and control characters "x", all others "a".
KINDS = bytes(
    97 if b in b"\t\n\x0b\x0c\r " or chr(b).isalnum() and b < 128 or 0x80 <= b < 0xC0 or b == 0xC3 else 33 if 32 < b < 127 else 120
    for b in range(256)
)
MARKS = re.compile(rb"[!-/:-@\[-`{-~]+").sub
#: Chunks of which the ids are kept; they take about 50 bytes each.
MAX_CACHED = 600_000
#: Words a library call encodes.
AT_ONCE = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plainer(text: bytes) -> bytes:
    """The text with letters lower-cased and marks apart, if this cannot change ids.

    That holds where there are no letters but Latin ones, no control characters and, if marks stand together, no special tokens or
    apostrophes.
    """
    kinds = text.translate(KINDS)
    if b"x" in kinds or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text
    if b"!!" not in kinds:
        return text.lower().replace(b".", b" . ").replace(b",", b" , ")
    return text if b"<|" in text or b"'" in text else MARKS(rb" \g<0> ", text.lower())


class ChunkEncoder:
    """encode_all(texts) gives the ids that tokenizers gives for the whole texts.

    Known chunks are sorted by the first half of their 128-bit hash, ``h1``; ``h2`` has the other half and ``place`` the
    number of each. The ids of chunk k are flat[start[k] : start[k + 1]].
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.words.model.end_of_word_suffix or ""
        self.last = np.zeros(self.words.get_vocab_size(), bool)  # ids that end a word, if the vocabulary tells
        self.last[[i for t, i in self.words.get_vocab().items() if mark and t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.h1, self.h2, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers of chunks, all different; unknown ones are encoded first."""
        h1, h2 = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), ">u8").reshape(-1, 2).astype(np.uint64).T
        at = np.searchsorted(self.h1, h1)
        known = np.zeros(len(chunks), bool)
        inside = np.flatnonzero(at < len(self.h1))
        known[inside] = (self.h1[at[inside]] == h1[inside]) & (self.h2[at[inside]] == h2[inside])
        if len(self.h1) + len(chunks) - int(known.sum()) > MAX_CACHED and len(self.h1):
            self.forget()
            return self.places(chunks)
        out = np.zeros(len(chunks), np.int64)
        out[known] = self.place[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            new = new[self._encode([chunks[i] for i in new.tolist()])]
            out[new] = np.arange(len(self.start) - 1 - len(new), len(self.start) - 1)
            new = new[np.argsort(h1[new], kind="stable")]
            at = np.searchsorted(self.h1, h1[new])
            self.h1, self.h2, self.place = np.insert(self.h1, at, h1[new]), np.insert(self.h2, at, h2[new]), np.insert(self.place, at, out[new])
        return out

    def _encode(self, chunks: list[bytes]) -> np.ndarray:
        """Add the ids of chunks; in which order they were added."""
        # Capital letters with accents are lower-cased here, as the normalizer does.
        chunks = [c if c.isalpha() or b"\xc3" not in c or not PLAIN(low := c.decode("utf-8", "replace").lower().encode()) else low for c in chunks]
        is_plain = np.fromiter(((c.isalpha() and c.islower()) or PLAIN(c) is not None for c in chunks), bool, len(chunks))
        order = [np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]
        plain, other = ([chunks[i] for i in x.tolist()] for x in order)
        flat, ends, size = [self.flat], [self.start], self.flat.size
        for at in range(0, len(plain), AT_ONCE):
            part = plain[at : at + AT_ONCE]
            if self.last.any():
                flat.append(np.array(self.words.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32))
                ends.append(size + np.flatnonzero(self.last[flat[-1]]) + 1)
            else:
                coded = self.words.encode(b" ".join(part).decode(), add_special_tokens=False)
                flat.append(np.array(coded.ids, np.uint32))
                ends.append(size + np.searchsorted(np.array(coded.word_ids), np.arange(1, len(part) + 1)))
            size += len(flat[-1])
        for at in range(0, len(other), AT_ONCE):
            coded = [x.ids for x in self.whole.encode_batch_fast([c.decode("utf-8", "replace") for c in other[at : at + AT_ONCE]], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(coded), np.uint32))
            ends.append(size + np.cumsum([len(x) for x in coded]))
            size += len(flat[-1])
        self.flat, self.start = np.concatenate(flat), np.concatenate(ends)
        return np.concatenate(order)

    def encode_all(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts in a row, each followed by end_id, and how many each text has."""
        parts = pc.ascii_split_whitespace(pa.array([_plainer(t or b"") for t in texts], pa.binary()).view(pa.string()))
        coded = parts.values.dictionary_encode()
        chunks = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        places = self.places(chunks).astype(np.int32)[coded.indices.to_numpy()]
        ends = parts.offsets.to_numpy()[1:]
        places = np.insert(places, ends, len(self.start) - 1)  # the end id stands for one more chunk
        known = pa.ListArray.from_arrays(pa.array(np.append(self.start, self.start[-1] + 1), pa.int32()), pa.array(np.append(self.flat, np.uint32(end_id))))
        found = known.take(pa.array(places))
        first = found.offsets.to_numpy()[np.append(ends + np.arange(1, len(ends) + 1), 0)]
        return found.values.to_numpy(), np.diff(first[:-1], prepend=0).astype(np.int64)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, as reading the tokenizer's file takes time; who uses it calls forget() at last."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
