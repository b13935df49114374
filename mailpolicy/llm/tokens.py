"""Token ids of texts by files of the tokenizers library, with pieces of text that come again encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse, islice

import numpy as np

#: Without the one whose lower case is not letters alone.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Before a full stop or comma behind a letter: the letters end a token there, whatever follows.
_STOP = re.compile(rf"(?<=[{_LETTERS}])(?=[.,])")
#: White space with the letters, up to white space, a stop or a comma, or with whatever else follows it up to white space.
_KEPT = re.compile(rf"\s*[{_LETTERS}]+(?=[\s.,]|\Z)|\s*\S+|\s+")
#: White space to Python, but not to tokenizers.
_ODD = re.compile("[\x1c-\x1f]")

#: A stop or comma behind anything but a letter or digit.
_LONE = re.compile(rf"[.,](?<![{_LETTERS}0-9].)", re.DOTALL)
#: Signs of ASCII, without the apostrophe, which begins endings.
_SIGNS = r"!-&(-/:-@\[-`{-~"
#: Pieces that a tokenizer cuts into their letters, with a space before them, and their signs, whatever pattern it has for the rest.
_PLAIN = {lead: re.compile(rf"{lead}(?:[{_LETTERS}]+[{_SIGNS}]*|[{_SIGNS}]+)").fullmatch for lead in ("", r"[ \n]")}
_EDGE = re.compile(rf"(?<=[{_LETTERS}])(?=[{_SIGNS}])")
#: The signs that byte-level vocabularies write for bytes: visible ones of Latin-1 stand for themselves, the others are counted on from 256.
_BYTES = np.arange(256, dtype="<u2")
_BYTES[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 324)
_BYTES[[0, 1]] = ord(" ")  # between pieces and within
#: Pieces of which a tokenizer must make the same ids by its model alone as by all of its steps.
_PROBES = ["a", "Zebra", "naïve", "ÀÖØöø", "\u0100\u024f\u023a", "Straße!!", "x_", "end.", "$$$", "#", "rest)", "co-", "ŁÓDŹ;", "the", "I"]
#: White space other than spaces and line ends, and the sign that cuts.
_OTHER = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: For each byte: letter or digit, stop or comma, space or line end, other white space, part of a sign beyond ASCII, or another sign.
_KINDS = bytes(ord("u" if b >= 0x80 else "a" if chr(b).isalnum() else "." if chr(b) in ".," else " " if chr(b) in " \n" else "o" if _OTHER.match(chr(b)) else "s") for b in range(256))
#: What white space beyond ASCII begins with in UTF-8.
_OTHER_BYTES = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")


def _lone(text: str, kinds: bytes) -> bool:
    """Whether a stop or comma stands behind anything but a letter or digit; ``kinds``: those of the text's bytes."""
    if kinds.startswith(b".") or any(x in kinds for x in (b"..", b" .", b"s.", b"o.")):
        return True
    return b"u." in kinds and _LONE.search(text) is not None


def _kept_pieces(text: str) -> list[str]:
    # Most texts can be cut by their single signs, which takes less time.
    raw = text.encode("utf-8", "surrogatepass")
    kinds = raw.translate(_KINDS)
    if not (b"  " in kinds or b"o" in kinds or _lone(text, kinds) or any(x in raw for x in _OTHER_BYTES) and _OTHER.search(text)):
        return text.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return [text] if _ODD.search(text) else _KEPT.findall(text)


def _dropped_pieces(text: str) -> list[str]:
    # A digit is a token of its own, so behind one a stop may be cut off, too.
    lone = _lone(text, text.encode("utf-8", "surrogatepass").translate(_KINDS))
    text = _STOP.sub(" ", text) if lone else text.replace(".", " .").replace(",", " ,")
    return text.replace("\n", " ").split(" ")


#: Where a text may be cut so that the pieces' ids, put together, are the text's. The first serves tokenizers that drop white space
#: between words, the second those whose words take one space before them along.
CUTS: dict[str, Callable[[str], list[str]]] = {
    "dropped": _dropped_pieces,
    "kept": _kept_pieces,
    "none": lambda text: [text],
}


#: Pieces that a worker keeps in mind between tasks.
FREQUENT = 100_000


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit numbers, without special tokens.

    Remembers pieces of up to 64 characters: when ``most`` are held they become the old ones, which go when ``most`` new ones have come.
    """

    def __init__(self, path: str, cut: str = "none", most: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.most = Tokenizer.from_file(path), CUTS[cut], most
        self.old: dict[str, bytes] = {}
        # Of each id: does it end a word ("dropped"), does it begin with the space or line end before one ("kept")?
        names = sorted((i, t) for t, i in self.tokenizer.get_vocab().items())
        self.border = np.zeros(names[-1][0] + 1, bool)
        self.border[[i for i, t in names if (t.endswith("</w>") if cut == "dropped" else t.startswith(("\u0120", "\u010a")))]] = True
        self.plain = _PLAIN["" if cut == "dropped" else r"[ \n]"]
        self.bare = self._model_alone() if cut != "none" else None

    def __missing__(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes() if piece else b""

    def _learn(self, pieces: list[str]) -> None:
        """All pieces in one call; ids carry the number of their piece."""
        if len(self) + len(pieces) > self.most:
            self.old = dict(self)
            self.clear()
        self.update((x, self.old[x]) for x in pieces if x in self.old)
        # Plain pieces are tokenized as one text, by the model alone; the others one by one, but in one call.
        plain = [x for x in pieces if x not in self and self.plain(x)] if self.bare else []
        if plain:
            ids, ends = self._plain_ids(plain)
            if len(ends) == len(plain):
                self._remember(plain, ids, ends)
        fresh = [x for x in pieces if x not in self]
        if not fresh:
            return
        found = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(fresh)), side="right")
        self._remember(fresh, np.array(found.ids, "<u4"), ends)

    def _model_alone(self):
        """The tokenizer without its normalizer and pattern, if plain pieces have the same ids by it; else none."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probes = [lead + x for lead in (("",) if self.cut is CUTS["dropped"] else " \n") for x in _PROBES]
        if any(self.plain(lead + t.content) for t in self.tokenizer.get_added_tokens_decoder().values() for lead in ("", " ", "\n")):
            return None
        ids, ends = self._plain_ids(probes)
        whole = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probes]
        return self.bare if [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == whole else None

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces, one after the other, and where those of each end."""
        dropped = self.cut is CUTS["dropped"]
        text = _EDGE.sub("\1", "\0".join(pieces))
        words = np.array([x.count("\1") for x in text.split("\0")]) + 1 if dropped else None
        text = text.lower() if dropped else text.replace("\n", "\n\1")
        text = _BYTES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.border[ids])
        if not dropped:
            return ids, np.r_[at[1:], len(ids)]
        return ids, at[np.cumsum(words) - 1] + 1 if len(at) == words.sum() else at[:0]

    def _remember(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.update(zip(pieces, (data[a:b] for a, b in zip([0, *ends], ends))))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; works on about a million characters at a time."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            held.append(self.cut(text) if text else [])
            n += len(text or "")
            if n >= 1_000_000:
                yield from self._joined(held)
                held, n = [], 0
        yield from self._joined(held)

    def settle(self, most: int = FREQUENT) -> None:
        """At a task's end: the worker may live on for other work, so only what came first, mostly what is frequent, stays."""
        self.old = {}
        first = dict(islice(self.items(), most))
        self.clear()
        self.update(first)

    def _joined(self, held: list[list[str]]) -> Iterator[bytes]:
        if self.cut is not CUTS["none"]:
            pieces = set(chain.from_iterable(held))
            new = filterfalse(self.__contains__, pieces) if len(self) + len(pieces) <= self.most else pieces
            fresh = [x for x in new if 0 < len(x) <= 64]
            if fresh:
                self._learn(fresh)
        for pieces in held:
            yield b"".join(map(self.__getitem__, pieces))


@lru_cache(maxsize=4)
def encoder(path: str, cut: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, cut)
