"""Token ids of whole texts by a public tokenizer file, cached by white-space-delimited chunk.

The tokenizers library drops white space before its merges, so the ids of a text are those of its chunks in turn.
Each distinct chunk goes through the library once per worker; texts are then joins of cached id bytes. Where the library cuts at
punctuation and folds case, which is tried out at the start, a chunk that ends in punctuation is its lower-cased core and its end, and
chunks that share a core need the library once. Small ASCII letters alone need none of the library's normalisation.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Cached chunks, and cores of chunks, per worker (some 150 bytes each); beyond it the cache starts anew.
CACHE_CHUNKS, CACHE_CORES = 800_000, 500_000
#: Longer chunks aren't kept.
CACHE_CHARS = 64
#: New chunks go to the library joined by a digit, which is always a token by itself; those that hold it go one by one.
MARK = "0"
JOINED = 200
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkEncoder:
    """encode(texts) -> each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        mark = self._ids([MARK])[0]
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 else None
        ends = [chr(c) for c in PUNCTUATION]
        words = sorted(w for w in (t.removesuffix("</w>") for t in self.library.get_vocab()) if w.isascii() and w.isalpha() and w.islower())[::20]
        plain = Tokenizer.from_file(path)
        plain.normalizer, plain.pre_tokenizer = None, WhitespaceSplit()
        same = self._ids([" ".join(words)]) == self._ids([" ".join(words)], plain) == [b"".join(self._ids(words))]
        self.plain = plain if same else self.library
        whole, parts = self._ids([f"Ab{x}" for x in ends] + [f"c7{x}" for x in ends]), self._ids(["ab", "c7", *ends])
        self.folds = whole == [parts[0] + x for x in parts[2:]] + [parts[1] + x for x in parts[2:]]

    def _ids(self, chunks: list[str], library=None) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in (library or self.library).encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_bare(self, chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        chunks = list(chunks)
        joinable = [c for c in chunks if b"0" not in c] if self.mark is not None else []
        alone = [c for c in chunks if b"0" in c] if self.mark is not None else chunks
        letters = [c for c in joinable if c.isalpha() and c.islower()]  # of bytes: ASCII only
        others = [c for c in joinable if not (c.isalpha() and c.islower())]
        for library, bare in ((self.plain, letters), (self.library, others)):
            parts = [bare[at : at + JOINED] for at in range(0, len(bare), JOINED)]
            for part, ids in zip(parts, self._ids([f" {MARK} ".encode().join(part).decode() for part in parts], library)):
                cuts = (np.flatnonzero(np.frombuffer(ids, "<u4") == self.mark) * 4).tolist()
                if len(cuts) != len(part) - 1:
                    alone += part
                    continue
                yield from zip(part, [ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)])])
        yield from zip(alone, self._ids([c.decode() for c in alone]))

    def _encode_new(self, chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        chunks = list(chunks)
        if not self.folds:
            yield from self._encode_bare(chunks)
            return
        if len(self.cores) > CACHE_CORES:
            self.cores.clear()
        lows = [c.lower() for c in chunks]
        if any(token in b" ".join(lows) for token in self.special):
            special = [any(token in c for token in self.special) for c in lows]
            yield from self._encode_bare(c for c, odd in zip(chunks, special) if odd)
            chunks, lows = ([c for c, odd in zip(x, special) if not odd] for x in (chunks, lows))
        stems = [c.rstrip(PUNCTUATION) for c in lows]
        ends = [c[len(s) :] for c, s in zip(lows, stems)]
        for k in [k for k, (s, e) in enumerate(zip(stems, ends)) if e and not s[-1:].isalnum()]:
            last = stems[k].decode()[-1:]
            if last < "\x80" or not last.lower()[-1].isalpha():  # the end isn't cut off from what stands before it
                stems[k], ends[k] = lows[k], b""
        cores = self.cores
        cores[b""] = b""
        cores.update(self._encode_bare(set(stems).union(ends).difference(cores)))
        yield from zip(chunks, map(bytes.__add__, map(cores.__getitem__, stems), map(cores.__getitem__, ends)))
        for c in [s for s in stems if len(s) > CACHE_CHARS]:
            cores.pop(c, None)

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        split = [(t or b"").split() for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        new = set().union(*split).difference(cache)
        cache.update(self._encode_new(new))
        get = cache.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        for c in [c for c in new if len(c) > CACHE_CHARS]:
            del cache[c]
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
