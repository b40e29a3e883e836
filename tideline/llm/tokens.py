"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np

#: The split pattern of the vocabulary (with possessive repeats, which match the same pieces faster)
#: and the id that ends a document.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_OF_DOCUMENT = 1

#: Name of the vocabulary file, as listed by the ``public_tokenizers`` package.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> list of ids; strings that look like special tokens are ordinary text. One per worker process."""
    import tiktoken

    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def sentence_end_flags(path: str) -> np.ndarray:
    """For each id, whether a sentence may end after it: its bytes end in . ! ? or hold a line feed."""
    ranks = _ranks(path)
    flags = np.zeros(max(ranks.values()) + 2, dtype=bool)
    for token, rank in ranks.items():
        flags[rank] = token.endswith((b".", b"!", b"?")) or b"\n" in token
    return flags


def document_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text (null: none) and the id that ends a document, as little-endian unsigned 32-bit numbers."""
    ids = encoder(path)(text) if text else []
    ids.append(END_OF_DOCUMENT)
    return np.array(ids, dtype="<u4")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
