"""Token ids of whole texts, by a byte-level BPE whose files are a parameter (never trained here).

The merge ranks are run by tiktoken, which gives the same ids as the tokenizers file of the same
vocabulary several times as fast (tests/llm compares them). The end-of-text string in a text is
that special token, as the tokenizers file has it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_OF_DOCUMENT = 0
END_OF_TEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(ranks_file: str = "byte_bpe_50k.tiktoken"):
    import public_tokenizers
    import tiktoken

    path = ranks_file if "/" in ranks_file else public_tokenizers.path(ranks_file)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def document_ids(text: str | None, ranks_file: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """Ids of the text (null: empty) and the end-of-document id, as little-endian unsigned 32-bit."""
    text, enc = text or "", encoder(ranks_file)
    ids = enc.encode(text, allowed_special="all") if END_OF_TEXT in text else enc.encode_ordinary(text)
    ids.append(END_OF_DOCUMENT)
    return np.array(ids, "<u4")
