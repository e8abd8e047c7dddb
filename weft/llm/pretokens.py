"""Pre-tokens of byte-level BPE vocabularies, and the pieces of one pre-token."""

from __future__ import annotations

import base64
import os
from functools import cache

import regex

#: Where the files of public tokenizers lie; every operator takes another path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BPE_FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The public pre-token pattern, as the tokenizer library takes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


#: White space as the tokenizer's pattern has it, spelled out: engines differ on the control characters 28 to 31.
SPLIT = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
RARE = [*"\x0b\x0c\x85\xa0     　", *map(chr, range(0x2000, 0x200B))]
TOUCHING = ["  ", " \n", "\n ", " \t", "\t ", " \r", "\r "]


def units(text: str) -> list[str] | None:
    """text cut before each of its spaces, without them. No pre-token reaches over such a cut unless a space touches other
    white space; None then."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in TOUCHING) or any(x in text for x in RARE):
        return None
    return text.split(" ")


@cache
def encoding(path: str = BPE_FILE):
    """The byte-pair encoder of a file of ranks; one in each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memo(dict):
    """make(word) for each word, made once while it is kept; forgets all at `most` entries, which costs time and no result."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        made = self[word] = self.make(word)
        return made


def parts(text: str) -> tuple[list[str], list[str]]:
    """(rest, whole): text is the units `rest`, each after a space, and the pre-tokens `whole`, in no common order."""
    rest = units(text)
    if rest is None:
        return [], SPLIT.findall(text)
    return rest, SPLIT.findall(rest.pop(0))


class Counts:
    """Numbers of tokens of whole texts, over pieces counted once per distinct unit."""

    def __init__(self, path: str = BPE_FILE):
        encode = encoding(path).encode_ordinary
        self.spaced, self.plain = Memo(lambda w: len(encode(" " + w))), Memo(lambda w: len(encode(w)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        rest, whole = parts(text)
        return sum(map(self.spaced.__getitem__, rest)) + sum(map(self.plain.__getitem__, whole))
