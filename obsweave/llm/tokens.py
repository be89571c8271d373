"""Exact encoding with a `tokenizers` file whose white space is a hard boundary, a word at a time.

The library's pre-tokenizer drops white space, so the ids of a text are those of its white-space separated
words in turn. Words met before come from a bounded memo. `supports` tells whether a file allows that."""
from __future__ import annotations

import json
import os
from array import array

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in a generation of the memo.
MEMO_WORDS = 400_000
#: Words that normalising to NFC leaves alone and that hold no white space or control character of any kind.
SIMPLE = regex.compile(r"[!-~\xa1-\u024f]+")


#: For each byte: p, a mark; h, a byte of a character from U+0250 on or a control character; x, any other.
KINDS = bytes(ord("h") if b >= 0xCA or b == 0xC2 or b < 9 or 13 < b < 32 or b == 127 else ord("p") if 33 <= b < 127 and not chr(b).isalnum() else ord("x") for b in range(256))

#: Below U+0250, the signs among the letters, and the capital whose small form ends in a combining mark.
MARKS = ("\u00d7".encode(), "\u00f7".encode(), "\u0130".encode())


def byte_names() -> dict[int, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def supports(spec: dict) -> bool:
    """White space is dropped before merging, and nothing spans it."""
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    added = spec.get("added_tokens", [])
    return bool(added) and all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\x0b\x0c")) for t in added) and "\\\\s" in pre and '"Removed"' in pre and '"add_prefix_space": false' in pre and '"invert": true' in pre


class Memo(dict):
    """Words met before and their ids; when full, the words of one generation back are still known."""

    def __init__(self, new):
        super().__init__()
        self.new, self.older = new, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.new(word)
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """ids of words (UTF-8, without white space) as numpy arrays of `dtype`, memoised."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if not supports(spec):
            raise ValueError(f"{path}: white space is not a hard boundary of this tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = regex.compile(b"|".join(regex.escape(t["content"].encode()) for t in spec["added_tokens"])).search
        self.memo = Memo(self._new)
        self.model = self.tokenizer.model
        stages = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        shape = [(x["type"], x.get("use_regex")) for x in stages] == [("Split", None), ("ByteLevel", False)] and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(stages[0]["pattern"]["Regex"]) if shape else None
        self.byte_names = byte_names()
        self.names = [""] * self.size
        for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.names[i] = s

    @classmethod
    def get(cls, path: str) -> WordEncoder:
        """One for each worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _new(self, w: bytes) -> bytes:
        """ids of a word that is not in the memo. Printable characters below U+0250 are left alone by NFC: such words take
        the file's own pattern and the library's BPE model, without the cost of a whole pipeline call."""
        text = w.decode("utf-8", "replace")
        if self.pattern is not None and not self.special(w):
            if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                return self._merge(text.lower())
            if SIMPLE.fullmatch(text):
                return b"".join([self._merge(p) for p in self.pattern.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merge(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_names)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of `dtype`."""
        return list(map(self.memo.__getitem__, words))

    def _split(self, text: bytes) -> list[bytes]:
        """Words of a text. Where no two marks meet and all characters are below U+0250, capitals and lone full
        stops and commas are set apart first: that leaves the ids alone and makes far fewer different words."""
        if self.pattern is not None and b"pp" not in (kinds := text.translate(KINDS)) and b"h" not in kinds and not any(x in text for x in MARKS):
            text = text.lower().replace(b".", b" . ").replace(b",", b" , ")
        return text.split()

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.memo.__getitem__, self._split(text)))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of `dtype`."""
        return [self.text(t) for t in texts]
