"""Public tokenizers inside tasks: files are read on the driver, and their bytes are broadcast.

``ByteLevel`` reads a byte-level BPE file of the tokenizers library (vocabulary, merges, added tokens) and encodes by the
tiktoken library, which merges the same vocabulary by rank several times as fast; ``load`` refuses a file
whose merges are not in the order of its ids, for which the two would differ.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Larger files are refused, because they are broadcast.
MAX_FILE_BYTES = 64_000_000


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class ByteLevel:
    """``tokens`` are the bytes of each id, ``specials`` the ids of added tokens, ``pattern`` splits texts before merging."""

    tokens: tuple[bytes, ...]
    specials: tuple[tuple[str, int], ...]
    pattern: str

    @staticmethod
    def load(path: str, pattern: str) -> ByteLevel:
        with open(path, "rb") as f:
            raw = f.read(MAX_FILE_BYTES + 1)
        if len(raw) > MAX_FILE_BYTES:
            raise ValueError(f"{path}: more than {MAX_FILE_BYTES} bytes")
        said, byte = json.loads(raw), _byte_of()
        vocabulary = said["model"]["vocab"]
        pieces = sorted(vocabulary, key=vocabulary.get)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in said["model"]["merges"]]
        if [vocabulary[p] for p in pieces] != list(range(len(pieces))) or [p for p in pieces if len(p) > 1] != merged:
            raise ValueError(f"{path}: merges are not in the order of the ids")
        tokens = tuple(bytes(byte[c] for c in p) for p in pieces)
        return ByteLevel(tokens, tuple((x["content"], x["id"]) for x in said["added_tokens"]), pattern)


@lru_cache(maxsize=4)
def byte_encoder(vocabulary: ByteLevel):
    """A tiktoken encoding, once for each worker."""
    import tiktoken

    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.specials))


def encode(coder, text: str, specials: bool) -> np.ndarray:
    """Ids of a whole text by a ``byte_encoder``; ``specials``: strings of added tokens become their ids, else they are plain text."""
    return coder.encode_to_numpy(text, allowed_special="all") if specials else coder.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def piece_encoder(model: bytes):
    """A sentencepiece processor, once for each worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_bytes(model: bytes) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: U+2581 is a space, byte pieces are their byte."""
    coder = piece_encoder(model)
    return [bytes([int(coder.id_to_piece(i)[3:5], 16)]) if coder.is_byte(i) else coder.id_to_piece(i).replace("▁", " ").encode() for i in range(coder.get_piece_size())]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_FILE_BYTES + 1)
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: more than {MAX_FILE_BYTES} bytes")
    return raw
