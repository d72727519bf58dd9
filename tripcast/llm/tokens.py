"""Token ids of a public byte-level BPE vocabulary, inside Spark tasks.

The ids are those of ``tokenizers`` with ``add_special_tokens=False``. The
rank file of the same vocabulary gives the same ids several times faster, so
texts go through it; a text that holds the string of a special token goes to
``tokenizers``, which alone gives that string its own id.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
END_ID = 2


@lru_cache(maxsize=1)
def _fast():
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _full():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def encode(text: str, end_id: int | None = END_ID) -> np.ndarray:
    """Ids of a whole text as uint32, then ``end_id`` if given."""
    ids = None
    if SPECIAL not in text:
        try:
            ids = _fast().encode_to_numpy(text)
        except ValueError:  # the pattern gave up on an extreme run of white space
            pass
    if ids is None:
        ids = np.asarray(_full().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return ids if end_id is None else np.append(ids, np.uint32(end_id))
