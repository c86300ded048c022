"""Token ids of whole texts by a public tokenizer file.

``Encoder`` gives exactly ``Tokenizer.encode(text, add_special_tokens=False)``,
as little-endian unsigned 32-bit ids. Texts of plain characters, on which the
file's normaliser only lowers case, are encoded by an equivalent byte-pair
engine: a piece with its end-of-word sign is written as the piece and a blank, so
that the file's vocabulary becomes a table of byte strings ranked by id. That is
the same as the file's merges when each token is made by one merge and ids rise
in the order of merges; both are checked when the file is read. Any other text,
and any other kind of file, goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import regex

#: Characters that normalisation leaves alone but for their case: no combining marks, no controls, no special
#: casing, no apostrophes (contractions are pieces), and none that Python and the pattern class differently.
_PLAIN = regex.compile("[\\t\\n\\r\\x20-\\x26\\x28-\\x7e\\xa1-\\xac\\xae-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\xffĀ-įı-ňŊ-ž‐-‗“-‟…€]*")
#: Fixed value: the split pattern for which the plain way is right.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = re.compile(r"(?:[^\w\s]|_)+|\d")
_HARD = re.compile(r"[^\w\s]{2}|[_\d]")
_LONE = set("!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~")

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as native 32-bit numbers, which must be little-endian here")


def byte_of() -> dict[str, int]:
    """The byte behind each character of the byte-level alphabet: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            raw = f.read()
        self.tokenizer = Tokenizer.from_str(raw.decode())
        spec = json.loads(raw)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.engine = self._engine(spec)

    def _engine(self, spec: dict):
        """The equivalent engine, or None if the file is not of the kind it is proven for."""
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        if (
            normal != ["NFC", "Replace", "Lowercase"]
            or [s.get("type") for s in steps] != ["Split", "ByteLevel"]
            or (steps[0]["pattern"].get("Regex"), steps[0]["behavior"], steps[0]["invert"]) != (PATTERN, "Removed", True)
            or steps[1]["add_prefix_space"]
            or steps[1]["use_regex"]
            or model["type"] != "BPE"
            or model.get("dropout")
            or model.get("ignore_merges")
            or model.get("end_of_word_suffix") != "</w>"
        ):
            return None
        vocab, alphabet = model["vocab"], byte_of()
        made = [vocab.get(a + b) for a, b in model["merges"]]
        first = min(made, default=0)
        if None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token not in self.special:
                core = token.removesuffix("</w>")
                ranks[bytes(alphabet[c] for c in core) + b" " * (core != token)] = i
        ends = all(ranks.get(bytes([b]) + b" ", first) < first and ranks.get(bytes([b]), first) < first for b in range(256))
        if not ends or len(ranks) != 512 + len(made):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return self.engine is not None and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def one(self, text: str) -> bytes:
        if not self.plain(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        low = text.lower()
        met = set(low)
        if met <= _SIMPLE and not _HARD.search(low):
            for c in met & _LONE:
                low = low.replace(c, f" {c} ")
        else:
            low = _MARKS.sub(r" \g<0> ", low)
        low = low.replace("\n", " ").replace("\t", " ").replace("\r", " ") + " "
        return self.engine.encode_to_numpy(low, disallowed_special=()).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


#: Letters of the plain characters, blanks and single marks: where these are all, marks can be set apart by replacement.
_SIMPLE = {c for c in map(chr, range(0x180)) if c.isalpha()} | set(" \t\n\r") | _LONE
