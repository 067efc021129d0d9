"""Token ids by the tokenizers library, each distinct word encoded once.

Texts of plain characters (Latin letters, digits, common marks) are split into
words as the tokenizer's own pre-tokenizer splits them; a word's ids come from
the library's model and stay in a bounded memo, so a common word is encoded once
a worker. Other texts are cut at spaces where the tokenizer cuts them too, and
their parts that are not plain go through the library whole, as do all texts of
a tokenizer of an unknown kind.
"""

import json
import os
import re
from array import array

#: Words kept in each of the memo's two generations, and characters of a word that is kept.
MAX_KEPT, MAX_WORD = 200_000, 64
#: Bytes of text that are encoded together.
PORTION = 1 << 20
# Plain letters, digits and marks, and the pre-tokenizers' patterns over them.
LETTER, NUMBER, MARK = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼-¾", r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧€"
PLAIN = re.compile(rf"[\t\n {LETTER}{NUMBER}{MARK}]*")
SPACED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[{MARK}]+|\s+(?!\S)|\s+")
BARE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[{MARK}]+")
BEFORE_WORD = re.compile(r"(?= \S)")


class Shown(dict):
    """What stands for each character in a byte-level vocabulary, made when first asked for."""

    def __init__(self):
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in kept)
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, char: str) -> str:
        self[char] = out = "".join(self.byte[b] for b in char.encode("utf-8"))
        return out


def _kind(spec: dict) -> str | None:
    """`spaced` (words with the space before them), `bare` (lower case, no white space), or None."""
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    model = spec["model"]
    if not plain or model["type"] != "BPE" or model["dropout"] or any(spec[k] for k in ("truncation", "padding", "post_processor")):
        return None
    norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "spaced"
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and not cuts[1]["use_regex"]:
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if cuts[0]["pattern"] == {"Regex": pattern} and cuts[0]["invert"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}:
            return "bare"
    return None


class Encoder:
    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok, self.kind = Tokenizer.from_file(tokenizer_file), _kind(spec)
        self.model, self.shown = self.tok.model, Shown()
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(m in text for m in self.marks)

    def _words(self, text: str) -> list[str]:
        return SPACED.findall(text) if self.kind == "spaced" else BARE.findall(text.lower())

    def _cut(self, text: str) -> list[str]:
        """Words of a text; a part that is not plain stays whole, after a zero character."""
        if self._plain(text):
            return self._words(text)
        out = []
        for p in BEFORE_WORD.split(text) if self.kind == "spaced" else text.split(" "):
            if self._plain(p):
                out += self._words(p)
            else:
                out.append("\0" + p)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.kind is None:
            return self._whole(texts)
        if len(self.young) > MAX_KEPT:
            self.young, self.old = {}, self.young
        cut = [self._cut(t) for t in texts]
        known, old, hard, tokenize, shown = self.young, self.old, [], self.model.tokenize, self.shown.__getitem__
        new = set().union(*cut).difference(known)
        for w in new:
            ids = old.get(w)
            if ids is None:
                if w[0] == "\0":
                    hard.append(w)
                    continue
                # Printable ASCII stands for itself, a leading space aside.
                own = shown(w[0]) + w[1:] if w.isascii() and w[1:].isalnum() else "".join(map(shown, w))
                ids = array("I", [t.id for t in tokenize(own)]).tobytes()
            known[w] = ids
        known.update(zip(hard, self._whole([w[1:] for w in hard])))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > MAX_WORD:
                del known[w]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """This process's encoder: a reused worker keeps its memo between tasks."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def release():
    """Gives back the memory of this process's encoders; called by a worker that goes on to other work."""
    import ctypes
    import gc

    if _encoders:
        _encoders.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)


def portions(batch, most: int = PORTION, column: str = "text"):
    """Slices of an Arrow batch with about `most` bytes of text, at least one row each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype="i8") // most
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(sizes) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(int(a), int(b - a))


def texts(batch) -> list[str]:
    """Texts of a batch, null ones empty."""
    return [t or "" for t in batch.column("text").to_pylist()]
