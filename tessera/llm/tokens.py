"""Exact library tokenization of whole texts, with a bounded piece memo in each worker process.

For the two known pre-tokenizers a text of Latin-1 characters is cut by an equal pattern here, and each
distinct piece is encoded once by the library's BPE model and remembered; the ids of a text are the ids of its
pieces joined. Texts in which that argument does not hold (other characters, control characters and spaces on
which libraries differ, or the text of an added token) go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np

#: White space and controls on which libraries differ; texts that hold one take the library's own path.
_ODD = bytes([*range(0x1C, 0x20), 0x85, 0xA0])
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t\n\r\x0b\x0c"
#: By a mark in the library's description of its pre-tokenizer: the same cuts for Latin-1 texts.
_WORD_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
MEMO_PIECES = 600_000
MEMO_CHARS = 48

_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizer files."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def tokenizer_digest(name_or_path: str) -> str:
    """Version digest of a tokenizer: the SHA-256 of its file and of the library's version."""
    path = tokenizer_path(name_or_path)
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    h.update(f"{lib.__name__} {lib.__version__}".encode())
    return h.hexdigest()


def encoder(name_or_path: str) -> "Encoder":
    """The encoder of this process for a tokenizer file, loaded once."""
    if name_or_path not in _loaded:
        _loaded[name_or_path] = Encoder(tokenizer_path(name_or_path))
    return _loaded[name_or_path]


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: visible Latin-1 bytes stand for themselves,
    the others for U+0100 onwards in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in seen else chr(256 + next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, bytes] = {}
        self.model = None
        self.cut = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        pre, norm = str(self.lib.pre_tokenizer), str(self.lib.normalizer)
        if pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and norm == "None":
            self.cut, self.lower = _BYTE_CUT, False
        elif r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pre and "Removed, invert=True" in pre and "ByteLevel(add_prefix_space=False" in pre and norm.startswith("Sequence(normalizers=[NFC(), Replace(") and norm.endswith("Lowercase()])"):
            self.cut, self.lower = _WORD_CUT, True
        self.bytes = _byte_letters()

    def _whole(self, text: str) -> bytes:
        if self.model is not None:
            return np.asarray(self.model.encode(text, num_threads=1), dtype="<u4").tobytes()
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self.lib.model.tokenize("".join(map(self.bytes.__getitem__, piece.encode("utf-8"))))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a null text is empty."""
        if not text:
            return b""
        if self.cut is None or any(t in text for t in self.added):
            return self._whole(text)
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            try:
                latin = text.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(text)
            if len(latin.translate(None, _ODD)) < len(latin):
                return self._whole(text)
        pieces = self.cut.findall(text.lower() if self.lower else text)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(memo) > MEMO_PIECES:
            memo.clear()
        local: dict[str, bytes] = {}
        for p in set(pieces):
            if p not in memo:
                (memo if len(p) <= MEMO_CHARS and len(memo) <= MEMO_PIECES else local)[p] = self._piece(p)
        if not local:
            return b"".join(map(memo.__getitem__, pieces))
        return b"".join(local[p] if p in local else memo[p] for p in pieces)

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4
