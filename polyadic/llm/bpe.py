"""Byte-level BPE ids by the tokenizers library, each distinct word once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .textarrays import held
from .wordwise import WordCoder, split_words


def _printable(codes: bool = False) -> list[int]:
    """The bytes, printable ones first; or the code points that show them: themselves, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return plain + ([256 + i for i in range(len(rest))] if codes else rest)


@held
def _coder(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    # A word is one pre-token already: its bytes go to the library's model as the printable
    # characters that stand for them in the vocabulary.
    model = tokenizer.model
    shown = {b: c for b, c in zip(_printable(), map(chr, _printable(codes=True)), strict=True)}

    def encode(words: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(shown))] for w in words]

    return WordCoder(split_words, encode), tokenizer, special


def byte_bpe(path: str, end_id: int | None = 1) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """An encoder for pack(): ids of tokenizer file ``path``, then ``end_id`` if there is one.

    The file's pattern is the usual one of byte-level BPE.  Texts that hold a special token's string
    go to the library as a whole.
    """

    def encode(texts: pa.Array) -> Iterator[np.ndarray]:
        coder, tokenizer, special = _coder(path)
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        whole = texts.to_pylist() if any(s in memoryview(b).tobytes() for b in texts.buffers()[2:] if b for s in special) else None
        for i, ids in enumerate(coder(texts)):
            if whole and whole[i] and any(s.decode() in whole[i] for s in special):
                ids = np.array(tokenizer.encode(whole[i], add_special_tokens=False).ids, dtype=np.uint32)
            yield np.concatenate([ids, tail])

    return encode
