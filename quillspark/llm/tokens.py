"""Byte-level BPE ids of whole texts, one vocabulary in two file forms.

The ids are those of the tokenizers library. A text goes through tiktoken with the same vocabulary as ranks, which gives
the same ids (a test holds the two against each other) several times faster. A text that holds a special token's string,
which tokenizers reads as that token, goes through tokenizers itself, and so does a text whose runs of white space are too long for tiktoken's
pattern (hundreds of thousands of characters), which it refuses with a ValueError.
"""

from __future__ import annotations

import base64

import numpy as np


class TextEncoder:
    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[tuple[str, str, str], TextEncoder] = {}


def encoder(json_path: str, ranks_path: str, pattern: str) -> TextEncoder:
    """This worker's encoder for a vocabulary."""
    key = (json_path, ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]
