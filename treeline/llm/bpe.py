"""Byte-level BPE ids of whole texts, equal to the ``tokenizers`` library's, with a bounded word cache."""

from __future__ import annotations

import base64
import re
from array import array

VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
CACHE_WORDS = 300_000


def encoder_paths(names: tuple[str, str] = VOCABULARY) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(names[0]), public_tokenizers.path(names[1])


class _Cache(dict):
    """Ids by word, each with the blank before it; what is missing is encoded."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode = encode
        self.limit = limit

    def __missing__(self, word: str) -> bytes:
        raw = array("I", self.encode(" " + word)).tobytes()
        if len(word) < 64 and len(self) < self.limit:
            self[word] = raw
        return raw


class Encoder:
    """Encodes a text blank by blank.

    A blank after another character always starts a pre-token, unless it stands
    inside a run of white space, so a text can be cut there and the parts encoded
    alone; each part is looked up in a cache. The vocabulary's ranks give the
    library's ids without its alignment work; texts that hold one of the special
    strings go through the library itself.
    """

    #: A blank inside or at the end of a run of blanks: how such a run is cut depends on what follows it.
    RUN = re.compile(r"  |\s \s")

    def __init__(self, json_path: str, ranks_path: str, cache_words: int = CACHE_WORDS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.cache = _Cache(self.encode, cache_words)

    def packed(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit integers."""
        if any(s in text for s in self.specials):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.RUN.search(text):
            return array("I", self.encode(text)).tobytes()
        if len(self.cache) >= self.cache.limit:
            self.cache.clear()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.cache.__getitem__, rest))
