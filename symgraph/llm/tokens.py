"""Token ids of whole batches of texts for a byte-level BPE vocabulary file (its path is a parameter).

Pre-tokens of this family never span a single space between two visible characters, so a text is the sequence of its
space-separated chunks, and each distinct chunk of a batch is encoded once: all chunks in one call, then cut at their
byte offsets. Texts where that doesn't hold (runs of white space, marks of added tokens) go to the tokenizer whole.
The ids are those of `tokenizers`; tests hold both against each other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-token pattern of this vocabulary family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space at either end of a text, or beside a space.
_UNEVEN = rf"^{_SPACE}|{_SPACE}$| {_SPACE}|{_SPACE} "


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self.odd = "|".join([_UNEVEN, *map(re.escape, added)])

    def _joined(self, chunks: pa.Array, before: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All chunks in one call, each with `before` in front: ids, and the first and end position of each chunk's ids."""
        if not len(chunks):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), before.decode())[0].as_py()
        ids = np.asarray(self.fast.encode_to_numpy((before.decode() if before == b" " else "") + text, disallowed_special=()), np.uint32)
        ends = np.cumsum(self.bytes_of[ids])
        sizes = pc.binary_length(chunks).to_numpy().astype(np.int64)
        if before == b" ":  # the space belongs to the chunk
            to = np.cumsum(sizes + 1)
            start = to - sizes - 1
        else:  # a line feed between two chunks is a token of its own
            to = np.cumsum(sizes + 1) - 1
            start = to - sizes
        lo = np.searchsorted(ends, start, side="right")
        hi = np.searchsorted(ends, to, side="left") + 1 - (sizes == 0) * (before != b" ")
        return ids.astype(self.dtype), lo.astype(np.int32), hi.astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (null: none), and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(even, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        offsets -= offsets[0]
        first = offsets[:-1]
        words = flat.dictionary_encode()
        codes = words.indices.to_numpy()
        a_ids, a_lo, a_hi = self._joined(words.dictionary, b" ")
        b_ids, b_lo, b_hi = self._joined(flat.take(pa.array(first)), b"\n")
        pool = np.concatenate([a_ids, b_ids])
        lo, n = a_lo[codes], (a_hi - a_lo)[codes]
        lo[first], n[first] = b_lo + len(a_ids), np.maximum(b_hi - b_lo, 0)
        to = np.cumsum(n, dtype=np.int64)
        ids = pool[np.repeat(lo - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)]
        counts = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        if not odd.any():
            return ids, counts
        pieces, parts = np.split(ids, np.cumsum(counts)[:-1]), []
        for i, piece in enumerate(pieces):
            if odd[i]:
                piece = np.asarray(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
                counts[i] = len(piece)
            parts.append(piece)
        return np.concatenate(parts), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_with_end(texts: pa.Array, path: str, end_id: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids, each text's ids followed by end_id, and the offsets of the texts (one more than texts)."""
    enc = encoder(path)
    ids, counts = enc.encode(texts)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    out = np.full(int(offsets[-1]), end_id, enc.dtype)
    mask = np.ones(len(out), bool)
    mask[offsets[1:] - 1] = False
    out[mask] = ids
    return out, offsets
