"""Pre-tokenizers of the two public BPE vocabularies, as exact as the tokenizers library and faster on plain text.

Text whose characters all lie below U+0250 is cut by `re` with the Unicode classes written out;
any other text is handed to the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import os
import re

# White space, letters and numbers below U+0250.
WS = "\t-\r \x85\xa0"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"

PLAIN = re.compile("[\x00-\u024f]*")
# Only contractions and other signs can begin with an apostrophe, so letters and numbers may be tried before them.
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{LETTERS}{NUMBERS}{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
WORD_LEVEL = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{LETTERS}{NUMBERS}{WS}]+")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + k)] = b
    return table


class Cutter:
    """Cuts text into pre-tokens; special strings come out as parts of their own, as the library's default has it."""

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = words
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.mark = os.path.commonprefix(list(self.special)) or ""
        self.pattern = WORD_LEVEL if words else BYTE_LEVEL
        self.chars = byte_alphabet()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of the text, each with whether it is a special string."""
        if not self.special or self.mark not in text:  # no special string lacks the mark
            return [(text, False)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m[0], True))
            at = m.end()
        if at < len(text):
            out.append((text[at:], False))
        return out

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without special strings."""
        shown = text.lower() if self.words else text
        if PLAIN.fullmatch(shown):  # what the pattern will see: small letters may lie in another range than their capitals
            return self.pattern.findall(shown)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        chars = self.chars
        return [bytes(chars[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
