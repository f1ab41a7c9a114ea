"""Token ids of public tokenizer files, inside tasks. Files are read where the task runs; only their path travels."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Byte-level vocabularies write each byte as a printable character: these bytes as themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(_OTHER)}
#: The split of byte-level BPE files with `use_regex` (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level BPE file of the `tokenizers` library. Special tokens' strings inside texts are plain text.

    Where a file's merges are numbered like its entries, as is usual, and nothing else changes the text, the same ids come from a
    rank engine in a fifth of the time; other files go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        size = max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(_BYTE[c] for c in entry)
        for token in content["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        first = size - len(content["added_tokens"]) - len(merges)
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        split = content["pre_tokenizer"] or {}
        ranked = (
            content["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and all(vocabulary.get(entry) == first + i for i, entry in enumerate(joined))
        )
        if ranked:
            import tiktoken

            ranks = {self.bytes[number]: number for number in vocabulary.values()}
            engine = tiktoken.Encoding("byte_bpe", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda text: engine.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """A `sentencepiece` model. It puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode())
        self.encode = lambda text: np.array(model.encode(text), np.int32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once per Python process."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def piece_bpe(path: str) -> Pieces:
    return Pieces(path)
