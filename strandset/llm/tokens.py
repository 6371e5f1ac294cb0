"""Token ids of whole texts through the ``tokenizers`` library.

``word_bpe_49k`` drops white space before its merges, so the ids of a text are the
ids of its white-space-separated chunks one after the other.  Each worker therefore
encodes a distinct chunk once and looks the others up; the lookup table is bounded.
Only ASCII white space separates chunks here (every tokenizer rule treats it as
white space); a chunk that holds other white space goes to the library as it is.
Arrow splits the texts of a batch and numbers their distinct chunks, so Python looks a
chunk up once a batch, not once a place.
"""

from __future__ import annotations

import array
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

END_ID = 1
#: Chunks that each half of a worker's memory holds (about 180 bytes each).
CACHE_CHUNKS = 160_000
#: Characters given to the library in one call.
CALL_CHARS = 200_000
#: Bytes of texts that are split into chunks at a time (a longer text alone), and chunks whose ids are gathered at a time.
PART_BYTES = 4_000_000
GATHER_CHUNKS = 500_000

#: ASCII signs between a letter and a blank are a piece of their own to the tokenizer; set
#: apart, they leave fewer distinct chunks.
SIGN = r"[!-/:-@\[-`{-~]"
STOP = rf"([a-zß-öø-ÿ])({SIGN}+)([ \n])"


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()

_loaded: dict[str, "ChunkEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "ChunkEncoder":
    """The encoder of this worker process; its vocabulary is kept between tasks, its table of chunks is not."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


class ChunkEncoder:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.cache_chunks = cache_chunks
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the table: called at the end of a task, since idle workers and other operators' tasks share the executor."""
        self.known, self.older = {}, {}
        give_back()

    def _encode_new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks not met before.

        A chunk of nothing but lower-case letters is one piece that normalising leaves as it
        is, so it goes to the tokenizer's merges at once; the others take all its steps.
        """
        merge, pack, rest, into = self.tokenizer.model.tokenize, self._pack, [], {}
        for chunk in chunks:
            if not (chunk.isalpha() and chunk.islower()):
                rest.append(chunk)
            elif chunk.isascii():
                into[chunk] = pack([t.id for t in merge(chunk)])
            elif unicodedata.is_normalized("NFC", chunk):
                into[chunk] = pack([t.id for t in merge(chunk.encode().decode("latin-1").translate(BYTE_LETTERS))])
            else:
                rest.append(chunk)
        self._encode_whole(rest, into)
        return into

    def _pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def _encode_whole(self, chunks: list[str], into: dict[str, bytes]) -> None:
        """Many chunks a call, cut apart again by their offsets."""
        at = 0
        while at < len(chunks):
            part, size = [], 0
            while at < len(chunks) and size < CALL_CHARS:
                part.append(chunks[at])
                size += len(part[-1]) + 1
                at += 1
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            starts = np.cumsum([0] + [len(p) + 1 for p in part])
            first = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
            cuts = np.searchsorted(first, starts).tolist()
            raw, width = ids.tobytes(), self.dtype.itemsize
            for k in range(len(part)):
                into[chunks[at - len(part) + k]] = raw[cuts[k] * width : cuts[k + 1] * width]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian ids (``self.dtype``) of each text and the end id; null: empty text."""
        if isinstance(texts, list):
            texts = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
            out += self._encode_part(texts.slice(at, upto - at))
            at = upto
        return out

    def _encode_part(self, texts: pa.Array) -> list[bytes]:
        # A-Z are lowered as the tokenizer does, unless the text may name a special token
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), STOP, r"\1 \2\3")
        chunks = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
        coded = chunks.flatten().dictionary_encode()
        raws = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False))
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // self.dtype.itemsize
        flat, begin = np.frombuffer(b"".join(raws), self.dtype), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        own = size[which]
        through = np.concatenate(([0], np.cumsum(own)))
        pieces = []
        for k in range(0, len(which), GATHER_CHUNKS):
            w, n = which[k : k + GATHER_CHUNKS], own[k : k + GATHER_CHUNKS]
            shift = begin[w] - (through[k : k + len(w)] - through[k])
            pieces.append(flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes())
        whole, wide = memoryview(b"".join(pieces)), self.dtype.itemsize
        cuts = (through[np.concatenate(([0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))))] * wide).tolist()
        return [bytes(whole[a:b]) + self.end for a, b in zip(cuts, cuts[1:])]

    def _ids_of(self, chunks: np.ndarray) -> list[bytes]:
        """Ids of distinct chunks, from the worker's memory where it has them."""
        got = list(map(self.known.get, chunks))
        missing = [k for k, ids in enumerate(got) if ids is None]
        if missing:
            if len(self.known) + len(missing) > self.cache_chunks:
                self.older, self.known = self.known, {}  # the older half still answers; what is asked for again moves over
            new = self._encode_new([chunks[k] for k in missing if chunks[k] not in self.older])
            for k in missing:
                got[k] = self.known[chunks[k]] = new[chunks[k]] if chunks[k] in new else self.older[chunks[k]]
        return got
