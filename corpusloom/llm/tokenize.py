"""Token ids of whole texts, with the ids of each word kept.

A subword vocabulary with word ends gives a word the same ids wherever it stands, so a text is cut
at ASCII white space and each distinct word is encoded once in a Python worker.
"""

from __future__ import annotations

import struct
import unicodedata

from corpusloom.llm.batches import keep, one_thread

#: Bounds the memory of a worker: beyond it the word table starts anew, and beyond twice as many that of words without punctuation.
MAX_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens(dict):
    """Word bytes to its ids as little-endian 32-bit bytes, filled on demand.

    For tokenizers that lower-case, drop white space and end words, such as ``word_bpe_49k``.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self._tokenizer = tokenizer
        self._model = tokenizer.model
        self._letters = _byte_letters()
        self._cores: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, 4 bytes each."""
        if b"<|" not in text:  # special tokens are found before letters are lowered
            text = text.translate(_LOWER)
        words = text.split()
        if len(self) > MAX_WORDS:
            self.clear()
        if len(self._cores) > 2 * MAX_WORDS:
            self._cores.clear()
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if len(core) < len(word) and core and b"<|" not in word and (core[-1:].isalpha() or core.decode()[-1].isalpha()):
            ids = self._core(core) + self._core(word[len(core) :])
        else:
            ids = self._core(word)
        self[word] = ids
        return ids

    def _core(self, word: bytes) -> bytes:
        ids = self._cores.get(word)
        if ids is None:
            if word.isalpha():  # ASCII letters stand for themselves in the vocabulary
                found = [t.id for t in self._model.tokenize(word.decode())]
            else:
                text = word.decode()
                if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
                    # one word for the model, nothing to normalise or split
                    found = [t.id for t in self._model.tokenize(word.decode("latin-1").translate(self._letters))]
                else:
                    found = self._tokenizer.encode(text, add_special_tokens=False).ids
            ids = self._cores[word] = struct.pack(f"<{len(found)}I", *found)
        return ids


#: The name under which a worker keeps word tables.
KEPT = "word tables"


def word_tokens(name: str) -> WordTokens:
    """The word table of a tokenizer file of this worker, kept from task to task until another operator's tasks run in it."""
    loaded = keep(KEPT, dict)
    if name not in loaded:
        one_thread()
        import public_tokenizers
        from tokenizers import Tokenizer

        loaded[name] = WordTokens(Tokenizer.from_file(public_tokenizers.path(name)))
    return loaded[name]
