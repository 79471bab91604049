"""Token ids of whole texts by a tokenizers file, with a bounded cache of encoded chunks.

A text is cut where no token can cross: around white space for tokenizers that drop it,
before a single blank and around other white space for byte-level ones that keep it.  The
ids of a text are those of its chunks one after the other, and a chunk seen before costs
one dictionary look-up.  Corpora have millions of words seen once, so for these the merge
loop matters: where the file's merges rank its tokens by id, new chunks of plain letters
run through a faster merge loop over the very vocabulary of the file.  All other chunks,
and all tokenizers of another make, go through the tokenizers library itself; the tests
hold the two against each other.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: The characters of Unicode's White_Space property, and what str.split()
#: takes for white space besides.
_WS = "\t\n\x0b\x0c\r \x85\xa0                　"
_NOT_WS = "\x1c\x1d\x1e\x1f"
_RARE = [c for c in _WS if c not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
#: Chunks for tokenizers that drop white space, and for those that keep it.
_DROPPED = re.compile(f"[^{_WS}]+")
_KEPT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Bound of a worker's cache, in chunks of each of two generations; chunks of more
#: characters are not kept.
CACHE_CHUNKS, CACHE_CHARS = 150_000, 48
#: The pre-tokenizing patterns of the two kinds of file that have a fast
#: way; the first as the byte-level pre-tokenizer states it, the second for lower-cased
#: words of ASCII and Latin-1 letters.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(model: dict, suffix: str) -> bool:
    """Whether a token of a smaller id is always merged first."""
    vocab, last = model["vocab"], -1
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        one = vocab[(a.removesuffix(suffix) if suffix else a) + b]
        if one <= last:
            return False
        last = one
    return True


def _byte_merges(model: dict):
    """chunk -> ids, by the file's vocabulary as ranked byte strings."""
    import tiktoken

    of = _byte_of()
    ranks = {bytes(map(of.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in of for c in token) and token != "<|endoftext|>"}
    return tiktoken.Encoding("file", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _word_merges(model: dict, suffix: str):
    """piece in UTF-8 -> ids, and the bytes it can take.  A last byte is a symbol of its
    own there, so plain and last bytes share one row of 256 numbers."""
    import tiktoken

    of = _byte_of()
    marks = [b for b in range(33, 127) if not 48 <= b <= 57 and not 65 <= b <= 90]
    tail = list(range(0x80, 0xC0))
    plain = {b: i for i, b in enumerate([*marks, 0xC3, *tail])}
    final = {b: len(plain) + i for i, b in enumerate([*marks, *range(48, 58), *tail])}
    ranks = {}
    for token, i in model["vocab"].items():
        last = token.endswith(suffix) and len(token) > len(suffix)
        body = [of.get(c) for c in (token.removesuffix(suffix) if last else token)]
        rows = [plain] * (len(body) - 1) + [final if last else plain]
        if all(b in row for b, row in zip(body, rows)):
            ranks[bytes(row[b] for b, row in zip(body, rows))] = i
    for b in range(256):  # numbers that no token has
        ranks.setdefault(bytes([b]), (1 << 24) + b)
    to_plain = bytes(plain.get(b, 0) for b in range(256))
    to_final = [bytes([final.get(b, 0)]) for b in range(256)]
    single = tiktoken.Encoding("file", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: single(piece[:-1].translate(to_plain) + to_final[piece[-1]])


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit integers")


class _Cache(dict):
    """chunk -> its ids in bytes; the generation before is kept until this one is full."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """ids of whole texts by a tokenizers file, those of the library's encode() without
    special tokens added; the file's special strings in a text are their ids, as there.
    Texts that hold such a string go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        steps = pre.get("pretokenizers", [pre])
        suffix = model.get("end_of_word_suffix") or ""
        bpe = model.get("type") == "BPE" and not (model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"))
        self.split = lambda text: [text]  # unknown kind: whole texts
        encode = self.by_library
        if normal is None and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space"):
            self.split = self.kept
            if bpe and not suffix and _ranked(model, suffix):
                encode = _byte_merges(model)
        elif steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0]["pattern"] == {"Regex": _WORD_PATTERN}:
            self.split = self.dropped
            kinds = [x["type"] for x in (normal or {}).get("normalizers", [])]
            if bpe and suffix and kinds == ["NFC", "Replace", "Lowercase"] and _ranked(model, suffix):
                self.piece = _word_merges(model, suffix)
                encode = self.by_pieces
        self.cache = _Cache(encode)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]

    def by_library(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def by_pieces(self, chunk: str) -> list[int]:
        if not _PLAIN.fullmatch(chunk):
            return self.by_library(chunk)
        return [i for part in _PLAIN_PARTS.findall(chunk.lower()) for i in self.piece(part.encode())]

    @staticmethod
    def dropped(text: str) -> list[str]:
        return _DROPPED.findall(text) if any(c in text for c in _NOT_WS) else text.split()

    @staticmethod
    def kept(text: str) -> list[str]:
        if not text or any(c in text for c in _RARE):
            return _KEPT.findall(text)
        lines = text.split("\n")
        out: list[str] = []
        for line in lines:
            first, *rest = line.split(" ")
            out.append("\n")
            out.append(first)
            out += [" " + w for w in rest]
        return out[1:]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.added):
            return array("I", self.by_library(text)).tobytes()
        return b"".join(map(self.cache.__getitem__, self.split(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
