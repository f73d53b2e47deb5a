"""Token ids of whole texts with a public word tokenizer.

White space never survives this tokenizer and no token spans it, so a text's
ids are those of its chunks between ASCII white space, one after the other.
Texts are split and their chunks numbered in Arrow; ids are looked up once per
different chunk of a batch and put in place by number. An ASCII capital equals its small letter,
except where a special token's name may stand in the text, and for five letters
before a combining mark: text is composed before it is lowercased, and the
small ones compose with a mark that the capitals have no composed form for.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
# Chunks kept per worker: two generations of this size at most.
KEPT = 400_000
# Longer chunks are encoded but not kept.
LONG = 64
# Bytes of text that are split at a time, about.
BATCH_BYTES = 8 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Capitals that stay before what may be a combining mark (U+0300 and above).
_STAYS = re.compile(rb"[HJTWY](?=[\xcc-\xf4])")
_MAY_STAY = r"[HJTWY][\x{0300}-\x{10FFFF}]"
# Stands between chunks that are encoded in one call.
_MARK = "\x01"
_TAIL = b".,!?;:|%&$#*"

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = kept
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.mark = self._ids(_MARK)

    def _ids(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_all(pa.array(texts, pa.string()))
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in a row, and where each ends."""
        chunks = pc.ascii_split_whitespace(_prepared(texts))
        coded = chunks.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.new) >= self.kept:
            self.new, self.old = {}, self.new
        long = self._learn({c for c in known if c not in self.new})
        found = list(map(self.new.__getitem__, known))
        for c in long:
            del self.new[c]
        table = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        # Where each chunk's ids stand, and from where in the table they come.
        lengths = sizes[number]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        shift = np.repeat(starts[number] - (stops - lengths), lengths)
        ids = table[shift + np.arange(total)]
        bounds = np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.concatenate([[0], stops])[bounds]

    def _learn(self, unknown: set[bytes]) -> list[bytes]:
        """Put the ids of these chunks into `new`; returns those not to keep."""
        cut, missing, old = {}, set(), self.old
        again = {c: old[c] for c in unknown if c in old}
        self.new.update(again)
        for c in unknown:
            if c in again:
                continue
            core = c.rstrip(_TAIL)
            if core != c and core and _ends_in_letter(core):
                # Letters and what follows them are never one token.
                cut[c] = (core, c[len(core) :])
                missing.update(x for x in cut[c] if x not in self.new)
            else:
                missing.add(c)
        again = {c: old[c] for c in missing if c in old}
        self.new.update(again)
        fresh = self._encode_all({c for c in missing if c not in again})
        self.new.update(fresh)
        self.new.update((c, self.new[a] + self.new[b]) for c, (a, b) in cut.items())
        return [c for c in (*fresh, *cut) if len(c) > LONG]

    def _encode_all(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Short chunks are encoded together, with a mark between them."""
        out, short = {}, []
        for c in chunks:
            text = c.decode()
            if len(c) <= LONG and _plain_letters(text):
                # One word for the pre-tokenizer: straight to the merges.
                word = text if len(text) == len(c) else "".join(map(_BYTE_CHAR.__getitem__, c))
                out[c] = _pack([t.id for t in self.model.tokenize(word)])
            elif len(c) > LONG or _MARK in text or "<|" in text:
                out[c] = self._ids(text)
            else:
                short.append((c, text))
        for i in range(0, len(short), 2000):
            part = short[i : i + 2000]
            joined = self._ids(f" {_MARK} ".join(t for _, t in part))
            pieces = _split(joined, self.mark)
            if len(pieces) == len(part):
                out.update((c, ids) for (c, _), ids in zip(part, pieces, strict=True))
            else:  # a chunk whose ids hold the mark's
                out.update((c, self._ids(t)) for c, t in part)
        return out


def _prepared(texts: pa.Array) -> pa.Array:
    """Texts as they are split: small ASCII letters where that changes no id."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    special = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _MAY_STAY))
    low = pc.ascii_lower(texts)
    if not pc.any(special).as_py():
        return low
    apart = [t if "<|" in t else _lowered(t.encode()).decode() for t in texts.filter(special).to_pylist()]
    return pc.replace_with_mask(low, special, pa.array(apart, pa.large_string()))


def gathered(batches, size: int = BATCH_BYTES):
    """Record batches put together until their bytes reach the size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n or held:
        yield from (b for b in pa.Table.from_batches(held).combine_chunks().to_batches() if len(b))


def _lowered(data: bytes) -> bytes:
    """ASCII capitals as small letters where that leaves the ids as they are."""
    low = data.translate(_LOWER)
    if data.isascii():
        return low
    stays = [m.start() for m in _STAYS.finditer(data)]
    if not stays:
        return low
    kept = bytearray(low)
    for i in stays:
        kept[i] = data[i]
    return bytes(kept)


def _byte_chars() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    bytes for themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


_BYTE_CHAR = _byte_chars()


def _plain_letters(text: str) -> bool:
    """Letters only, which the normalizer leaves as they are."""
    if not text.isalpha():
        return False
    return text.isascii() or (max(text) < "\u0250" and text.lower() == text and unicodedata.is_normalized("NFC", text))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _split(ids: bytes, mark: bytes) -> list[bytes]:
    if len(mark) != 4:
        return []
    at = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == np.frombuffer(mark, "<u4")[0])
    bounds = [-4, *at.tolist(), len(ids)]
    return [ids[a + 4 : b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _ends_in_letter(chunk: bytes) -> bool:
    last = chunk[-1:]
    return last.isalnum() if last < b"\x80" else chunk.decode()[-1].isalpha()
