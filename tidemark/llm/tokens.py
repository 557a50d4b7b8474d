"""Token ids of whole texts by a public tokenizer, one dictionary lookup a word."""

from __future__ import annotations

import array
import functools
import unicodedata

import numpy as np

#: Pieces whose ids a worker keeps; beyond it the store starts anew, which changes no result.
KEPT = 600_000
#: Code points that Python's split() takes for blanks and the tokenizers' patterns don't, and the mark below.
ODD = "\x1c\x1d\x1e\x1f\x00"
#: Stands before a comma or full stop that was cut off the word before it.
MARK = "\x00"


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers. Both vocabularies cut a text at blanks, and between letters and signs, before they merge, so a
    piece cut there always has the same ids: each distinct piece is encoded once by the tokenizers library. Commas and full stops at a word's end are
    pieces of their own if the word ends with a letter or digit; a text where a cut could fall inside a run of signs or odd blanks is cut at blanks
    only, or encoded whole. The library's defaults hold: an added token's string ('<|endoftext|>') in a text is that token, and such texts are encoded whole."""

    def __init__(self, path: str, drops_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = drops_blanks
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        border = "</w>" if drops_blanks else "\u0120"
        self.border = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.endswith(border) if drops_blanks else token.startswith(border)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, encoded as one text and cut where a word ends (or, with blanks kept, starts)."""
        out = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            lead = "" if self.drops_blanks else " "
            ids = np.asarray(self.tokenizer.encode_batch_fast([lead + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.border[ids])
            if len(cut) != len(some):
                out += self.whole([lead + w for w in some])
                continue
            ends = (cut + 1 if self.drops_blanks else np.append(cut[1:], len(ids))) * 4
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[start:end])
                start = end
        return out

    def learn(self, pieces: set[str]) -> None:
        new = pieces - self.kept.keys()
        new.discard("")
        letters = [w for w in new if w.isalpha()]
        self.kept.update(zip(letters, self.plain_words(letters)))
        rest = [w for w in new.difference(letters) if self.drops_blanks or not w[0].isspace()]
        lead = "" if self.drops_blanks else " "
        self.kept.update(zip(rest, self.whole([w[1:] if w[0] == MARK else lead + w for w in rest])))

    def cut(self, text: str) -> list[str] | None:
        """The pieces, with blanks kept the first one is the text's head, which has no blank before it; None for a text to encode whole."""
        if any(c in text for c in ODD) or any(t in text for t in self.added):
            return None
        if self.drops_blanks:
            if "\u03a3" in text:  # its small form depends on its place for Python, not for the tokenizer
                return text.split()
            text = unicodedata.normalize("NFC", text).lower()
            if any(t in text for t in self.added):  # a piece would be taken for the token that the text as written doesn't hold
                return None
        marked = f"{text} ".replace(", ", f" {MARK}, ").replace(". ", f" {MARK}. ").replace(".\n", f" {MARK}.\n")
        if all(s[-2:-1].isalnum() for s in marked.split(MARK)[:-1]):  # else a sign before the comma belongs to it
            text = marked[:-1]
        return text.split() if self.drops_blanks else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        cut = [self.cut(t) for t in texts]
        heads = self.whole([c.pop(0) if c and not self.drops_blanks else "" for c in cut])
        self.learn(set().union(*[c for c in cut if c]))
        out = []
        for text, head, pieces in zip(texts, heads, cut):
            try:
                if pieces is None:
                    raise KeyError(text)
                out.append(head + b"".join(map(self.kept.__getitem__, pieces)))
            except KeyError:
                out.append(self.whole([text])[0])
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, drops_blanks: bool) -> WordEncoder:
    """One per worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, drops_blanks)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_groups(texts: list[str | None], size: int = 2_000_000):
    """(first row, texts) of about `size` characters; null texts are empty."""
    group, at, total = [], 0, 0
    for i, t in enumerate(texts):
        group.append(t or "")
        total += len(group[-1])
        if total >= size:
            yield at, group
            group, at, total = [], i + 1, 0
    if group:
        yield at, group
