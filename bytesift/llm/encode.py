"""Token ids by the tokenizers library, with a cache of pieces.

Both public tokenizers cut a text at white space before their merges, so the ids of a text are the ids
of its pieces in order. A piece is encoded by the library once and kept; texts in which the cut could
matter (runs of white space, white space at an end, rare separators, the content of an added token, marks and
other text that NFC may change before it is lowered) are encoded whole. Of the tokenizer that drops spaces, a piece that is a
word with or without punctuation around it is cut further, as the library's own pattern cuts it, and each run goes to the library's model
alone: normalizing and cutting it again cost more than its merges. The result equals encoding every text whole by the
unaltered library with add_special_tokens=False; tests hold it so.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: pieces in each of the two generations that one Python worker keeps, about 200 bytes each
CACHE_PIECES = 1_000_000
#: texts of one call to the library
BLOCK = 512
#: characters after which a block of texts that are looked up together ends
BLOCK_CHARACTERS = 4_000_000

#: white space beside single spaces and line ends, where the cut could differ from the library's own
_NOT_PLAIN = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_ENDS = (" ", "\n")
#: what str.split() takes for white space beyond ASCII and the next line's characters
_WIDE_SPACE = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_ODD_SPACE = re.compile("[\x01\x1c-\x1f\x85\u180e\u200b-\u200f\u2028-\u202e\u2060\ufeff]")


#: the pattern and the steps for which _WORD is known to cut as the library does
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: lower-case letters of the first scripts, which no version of Unicode has moved
_LOW = "".join(c for c in map(chr, range(0x500)) if unicodedata.category(c)[0] == "L" and c == c.lower())
#: a run of letters with ASCII punctuation around it; an apostrophe before letters could be a contraction's
_WORD = re.compile(rf"([!-&(-/:-@\[-`{{-~]*)([{_LOW}]+)([!-/:-@\[-`{{-~]*)")


@lru_cache(maxsize=1)
def _byte_level() -> dict[int, int]:
    """The character by which byte-level vocabularies know a byte: printable ones stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}


@lru_cache(maxsize=1)
def _moving() -> np.ndarray:
    """By code point: whether NFC may change it or join it to what stands before; beyond the table's planes, always."""
    table = np.ones(0x30000 + 1, dtype=bool)
    table[:0x30000] = [unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or not unicodedata.is_normalized("NFC", c) for c in map(chr, range(0x30000))]
    return table


class _Without:
    """Whether a text has none of certain characters: those that a pattern matches and, where moving is set, those that NFC may change."""

    def __init__(self, pattern: re.Pattern, moving: bool):
        self.pattern, self.moving = pattern, moving
        self.plain = bytes(c for c in range(128) if not pattern.match(chr(c)))
        table = np.array([c > 127 and 0xD800 <= c < 0xE000 or bool(pattern.match(chr(c))) for c in range(1 << 16)])
        self.table = table | _moving()[: 1 << 16] if moving else table

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return not text.encode().translate(None, self.plain)
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
        if not self.table[units].any():
            return True
        if self.pattern.search(text):
            return False
        if not self.moving:
            return True
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")  # characters beyond 16 bits, perhaps
        return not _moving()[np.minimum(codes, 0x30000)].any()


@lru_cache(maxsize=2)
def _without(odd: str, moving: bool) -> _Without:
    return _Without(re.compile(odd), moving)


class Encoder:
    """encode(texts) gives one little-endian uint16 (or uint32) array per text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.mode = self._mode()
        if self.mode != "whole":  # pieces seldom come twice to the library, whose own cache would only cost
            self.tokenizer.model._resize_cache(0)
        added = [t["content"] for t in self._description.get("added_tokens") or [] if t["content"]]
        if any(re.search(r"\s", t) for t in added):  # could arise where pieces meet
            self.mode = "whole"
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self._plain = _without(_ODD_SPACE.pattern, True) if self.mode == "spaces dropped" else _without(_NOT_PLAIN.pattern, False)
        self._mark = None
        if self.mode == "spaces kept":  # the tokens that begin a piece: with a space, or a line end
            begins = [i for t, i in self.tokenizer.get_vocab().items() if t[0] in "\u0120\u010a"]
            self._starts = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self._starts[begins] = True
        elif self.mode == "spaces dropped":  # a separator that no usual text has and that is one token
            ids = self.tokenizer.encode("\x01", add_special_tokens=False).ids
            self._mark = ids[0] if len(ids) == 1 else None
            self._ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a run
            self._ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._model = self.tokenizer.model if self._known_steps() else None
        self._pack = "<%d" + ("H" if self.dtype.itemsize == 2 else "I")

    def _mode(self) -> str:
        """How pieces may be cut: learnt from the tokenizer's own description."""
        import json

        d = self._description = json.loads(self.tokenizer.to_str())
        pre, norm = d.get("pre_tokenizer") or {}, d.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaces kept"
        steps = pre.get("pretokenizers") or [{}]
        if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", ""):
            return "spaces dropped"
        return "whole"

    def _known_steps(self) -> bool:
        """Whether the library does nothing to a lower-case word but cut it by _RUNS, spell its bytes and merge them."""
        d = self._description
        norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [{}]
        return (
            self.mode == "spaces dropped"
            and [n.get("type") for n in norm.get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
            and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == _RUNS
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and d["model"].get("type") == "BPE"
            and not d["model"].get("dropout")
        )

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), BLOCK):
            out += [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + BLOCK], add_special_tokens=False)]
        return out

    def _cut(self, text: str) -> list[str] | None:
        if self._added.search(text):
            return None
        if self.mode == "spaces kept":
            if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0] in _ENDS or text[-1] in _ENDS or not self._plain(text):
                return None
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]  # \0: has no space before it
            return pieces
        return None

    def _lowered(self, text: str) -> str | None:
        """The text in lower case with ASCII white space alone, if it may be cut there."""
        if self._added.search(text) or not self._plain(text):
            return None
        if "\u03a3" not in text and "\u0130" not in text:  # else lower() looks at their neighbours
            text = text.lower()
        if not text.isascii() and any(c in text for c in _WIDE_SPACE):
            return " ".join(text.split())
        return text.strip()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, many pieces in one text of the library's."""
        if self.mode == "spaces kept":
            long = ["".join("\n" + p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in pieces)]
            ids = np.frombuffer(self._library(long)[0], dtype=self.dtype)
            at = np.flatnonzero(self._starts[ids])
            if len(at) == len(pieces):
                begin = (at + np.array([p[0] == "\0" for p in pieces])).tolist()
                return [ids[a:b].tobytes() for a, b in zip(begin, [*at[1:].tolist(), len(ids)], strict=True)]
            return self._library([p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in pieces])
        if all(map(str.isalpha, pieces)):  # each is one run of letters
            ids = np.frombuffer(self._library([" ".join(pieces)])[0], dtype=self.dtype)
            at = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(at) == len(pieces):
                return [ids[a:b].tobytes() for a, b in zip([0, *at[:-1]], at, strict=True)]
        if self._mark is not None:
            ids = np.frombuffer(self._library([" \x01 ".join(pieces)])[0], dtype=self.dtype)
            at = np.flatnonzero(ids == self._mark).tolist()
            if len(at) == len(pieces) - 1:
                return [ids[a:b].tobytes() for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)]
        return self._library(pieces)

    def _run(self, run: str) -> bytes:
        """The ids of one run of letters or punctuation, which the model merges by itself."""
        if (found := self.cache.get(run)) is None:
            ids = [t.id for t in self._model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(_byte_level()))]
            found = self.cache[run] = struct.pack(self._pack % len(ids), *ids)
        return found

    def _words(self, pieces: list[str]) -> list[str]:
        """Takes the pieces that are words into the young generation, and their runs; gives the others."""
        others = []
        for p in pieces:
            if (m := _WORD.fullmatch(p)) is None:
                others.append(p)
            else:
                before, word, after = m.groups()
                ids = self._run(word)
                if before or after:
                    self.cache[p] = (self._run(before) if before else b"") + ids + (self._run(after) if after else b"")
        return others

    def _fill(self, need: list[str]) -> None:
        """Takes pieces into the young generation: from the old one, or from the library."""
        if len(self.cache) + 2 * len(need) > CACHE_PIECES:  # a piece and its word
            self.cache, self.old = {"": b""}, self.cache
        fresh = []
        for p in need:
            if (b := self.old.get(p)) is None:
                fresh.append(p)
            else:
                self.cache[p] = b
        if self._model is not None:
            fresh = self._words(fresh)
        if self.mode == "spaces dropped":  # runs of letters first, by themselves
            letters = [p for p in fresh if p.isalpha()]
            blocks = [letters[i : i + 2000] for i in range(0, len(letters), 2000)]
            fresh = [p for p in fresh if not p.isalpha()]
        else:
            blocks = []
        blocks += [fresh[i : i + 2000] for i in range(0, len(fresh), 2000)]
        for part in blocks:
            self.cache.update(zip(part, self._pieces(part), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Null counts as empty. Blocks of texts are cut and looked up together."""
        out: list[np.ndarray] = []
        if self.mode == "spaces dropped":
            block, size = [], 0
            for t in texts:
                block.append(t or "")
                size += len(block[-1])
                if size > BLOCK_CHARACTERS:
                    out += self._distinct(block)
                    block, size = [], 0
            return out + self._distinct(block) if block else out
        for at in range(0, len(texts), 64):
            out += self._block([t or "" for t in texts[at : at + 64]])
        return out

    def _distinct(self, texts: list[str]) -> list[np.ndarray]:
        """As _block(), where pieces lie between white space: Arrow cuts the texts, and each distinct piece of them is looked up once."""
        low = [self._lowered(t) for t in texts]
        whole = iter(self._library([t for t, x in zip(texts, low, strict=True) if x is None]))
        lists = pc.ascii_split_whitespace(pa.array([x for x in low if x is not None], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, pieces))
        if None in found:
            self._fill([p for p, b in zip(pieces, found, strict=True) if b is None])
            get = self.cache.get
            found = [b if b is not None else get(p) for p, b in zip(pieces, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        each = np.frombuffer(b"".join(found), dtype=self.dtype)
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        ids = each[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n)]
        bounds = iter(np.concatenate(([0], ends))[lists.offsets.to_numpy()].tolist())
        a, out = next(bounds), []
        for x in low:
            if x is None:
                out.append(np.frombuffer(next(whole), dtype=self.dtype))
            else:
                b = next(bounds)
                out.append(ids[a:b])
                a = b
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self._cut(t) for t in texts]
        whole = iter(self._library([t for t, c in zip(texts, cuts, strict=True) if c is None]))
        pieces = [p for c in cuts if c for p in c]
        found = list(map(self.cache.get, pieces))
        if None in found:
            self._fill(list({p for p, b in zip(pieces, found, strict=True) if b is None}))
            get = self.cache.get
            found = [b if b is not None else get(p) for p, b in zip(pieces, found, strict=True)]
        out, at = [], 0
        for c in cuts:
            ids = next(whole) if c is None else b"".join(found[at : at + len(c)])
            at += len(c or ())
            out.append(np.frombuffer(ids, dtype=self.dtype))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
