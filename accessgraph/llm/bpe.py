"""Token ids of whole texts by a given byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np


def default_tokenizer() -> str:
    """The ``tokenizers`` file whose ids are wanted; its ranks lie beside it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids that ``tokenizers`` gives for the file, none added.

    With ``special`` the strings of special tokens in a text become their ids,
    as ``tokenizers`` does by default; else they are ordinary text.

    The ids are computed from the same vocabulary's rank file (same name,
    ``.tiktoken``) where there is one, which takes a quarter of the CPU time;
    other files are read by ``tokenizers`` itself. The tests hold both equal.
    """

    def __init__(self, path: str, special: bool = True):
        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.encode_special_tokens = not special
            self._encode = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
            return
        import json

        import public_tokenizers
        import tiktoken

        names = {t["content"]: t["id"] for t in json.loads(Path(path).read_text())["added_tokens"] if t["special"]}
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        encoding = tiktoken.Encoding(
            Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=names
        )
        allowed = "all" if special else set()
        self._encode = lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of ``text``; none for an empty or null text."""
        return self._encode(text) if text else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of a file, made once per Python worker."""
    return Encoder(path, special)
