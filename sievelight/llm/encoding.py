"""Encoding whole texts with a vocabulary, word by word with a memo.

In all public vocabularies used here a plain space before a visible character
begins a new pre-token, so a text is the concatenation of its space-led words
and each distinct word needs encoding once per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: A space that another white space or the end follows; such texts are cut with care.
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")
_WORD_SPACE = re.compile(r" (?=\S)")

#: Bytes, entries' own cost included, that a memo of words may hold before it forgets them all and begins anew.
MEMO_BYTES = 48 << 20
#: The same for the words, and for other parts of words, of a vocabulary of the library.
WORD_BYTES, PART_BYTES = 56 << 20, 8 << 20
#: What a dictionary and two objects cost for an entry, beside their contents.
ENTRY_BYTES = 180
#: Longer words are encoded each time and not remembered.
LONGEST_REMEMBERED = 64


def space_cut(text: str) -> list[str]:
    """The text's parts between the spaces that begin a word; " ".join() restores it."""
    return _WORD_SPACE.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


class Memo(dict):
    """Ids of words or parts of words, bounded in bytes.

    When half of the bound is full, what it holds becomes the old half, which
    goes when the new one is full in its turn; words met again move over. So
    frequent words stay and those met once go.
    """

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self._half, self._held, self._old = most // 2, 0, {}

    def keep(self, word: str, ids: bytes) -> None:
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = ids
            self._held += ENTRY_BYTES + len(word) + len(ids)

    def keep_all(self, found: dict[str, bytes]) -> None:
        if max(map(len, found), default=0) > LONGEST_REMEMBERED:
            found = {w: ids for w, ids in found.items() if len(w) <= LONGEST_REMEMBERED}
        self.update(found)
        self._held += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def find(self, word: str) -> bytes | None:
        found = self.get(word)
        if found is None and (found := self._old.get(word)) is not None:
            self.keep(word, found)
        return found

    def make_room(self) -> None:
        if self._held > self._half:
            self._old = dict(self)
            self.clear()
            self._held = 0


class WordMemo:
    """Encodes texts through ``encode_words(words) -> list of uint32 little-endian bytes``.

    A word is given to it with its leading space. A text's first part has none.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], most: int = MEMO_BYTES):
        self._encode, self._known = encode_words, Memo(most)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = space_cut(text)
        known = self._known
        try:
            out = b"".join(map(known.__getitem__, rest))
        except KeyError:
            known.make_room()
            new = [w for w in set(rest) if w not in known and known.find(w) is None]
            fresh = dict(zip(new, self._encode([" " + w for w in new]), strict=True))
            out = b"".join([fresh[w] if w in fresh else known[w] for w in rest])
            for w, ids in fresh.items():
                known.keep(w, ids)
        return (self._encode([first])[0] if first else b"") + out


#: Where letters or digits meet ASCII punctuation (but for the apostrophe of contractions), or a
#: lone line feed meets visible characters, the vocabularies' patterns always begin a new pre-token.
#: (U+0130 ends in a mark, not a letter, once in lower case.)
_BORDERS = re.compile(r"(?<=[^\W_İ])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[^\W_])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_TAIL = ".,!?;:|#$%&*"
#: Pieces that are one pre-token and change only in case: letters of Latin-1 after at most one space.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Fixed value: how the library's byte-level chain cuts a text into pre-tokens.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space of this length are left to the library's chain: the pattern steps back over a run, within a bounded stack.
_LONG_BLANK = re.compile(r"\s{10000}")


def merge_ranks(vocabulary_json: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level vocabulary whose ids follow the order of its merges, else None.

    Merging the adjacent pair of lowest rank then takes the same steps as the
    file's list, provided that every token's own bytes merge back into it, which
    ``LibraryEncoder`` tries for all of them.
    """
    chain = json.loads(vocabulary_json)
    model, cut, after = chain["model"], chain.get("pre_tokenizer") or {}, chain.get("post_processor") or {}
    unusual = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain_chain = not chain.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model.get("type") != "BPE" or any(model.get(k) for k in unusual) or not plain_chain or after.get("type", "ByteLevel") != "ByteLevel":
        return None
    byte_of = {letter: b for b, letter in byte_letters().items()}
    vocabulary, products = model["vocab"], ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [vocabulary[p] for p in products]
    added = {t["content"] for t in chain.get("added_tokens") or ()}
    if order != sorted(set(order)) or set(vocabulary) - added != set(products) | set(byte_of):
        return None
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token not in added}


#: Fixed value: how the chain of a lower-case vocabulary with a suffix on words cleans and cuts a text.
_WORDS_CHAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters that stand in composed form in any company, have one lower case in any company, and whose classes no version
#: of Unicode changed: Latin, Cyrillic, most of Greek, punctuation and signs, kana, CJK and Hangul syllables.
_SETTLED = "\t\n\r -~\u00a0-\u012f\u0131-\u017f\u0391-\u03a1\u03a4-\u03a9\u03ac-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u2500-\u257f\u3001-\u3020\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e"
_UNSETTLED = re.compile(f"[^{_SETTLED}]")
#: Ends each word that tiktoken gets, in place of the suffix; no settled character.
_END = "\x01"


def _settled_words() -> re.Pattern:
    """The chain's pattern for texts of settled characters in lower case."""
    settled = re.findall(f"[{_SETTLED}]", "".join(map(chr, range(0x10000))))
    of = lambda kind: "".join(c for c in settled if unicodedata.category(c)[0] == kind)
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{of('L')}]+|[{of('N')}]|[^\\s{of('L')}{of('N')}]+")


def suffix_ranks(vocabulary_json: str) -> tuple[dict[bytes, int], np.ndarray] | None:
    """Ranks, and ids by rank, of a lower-case vocabulary whose words' last letters bear ``</w>``; None for other files.

    The suffix is a byte of its own, ``_END``, that merges with the letter before
    it before all else. After these come the file's merges, so merging the pair of
    lowest rank takes the steps of the file's list, provided that every token
    merges back into itself. The library's model of these very merges tries that.
    """
    from tokenizers import models

    chain = json.loads(vocabulary_json)
    model, suffix = chain["model"], "</w>"
    unusual = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    known = all(chain.get(k) == v for k, v in _WORDS_CHAIN.items()) and not chain.get("post_processor")
    if not known or model.get("type") != "BPE" or model.get("end_of_word_suffix") != suffix or any(model.get(k) for k in unusual):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]
    end = letters.pop(ord(_END))
    byte_of = {letter: b for b, letter in letters.items()}
    spelt = lambda t: t[: -len(suffix)] + end if t.endswith(suffix) else t
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = {letter: vocabulary.get(letter) for letter in byte_of} | {letter + end: vocabulary.get(letter + suffix) for letter in byte_of}
    products = {spelt(a + b): vocabulary.get(a + b) for a, b in pairs}
    if None in [*ids.values(), *products.values()] or len(products) != len(pairs) or set(products) & set(ids) or any(end in p[:-1] or suffix in p for p in products):
        return None
    ids = {end: 0} | ids | products
    rank = {t: i for i, t in enumerate(ids)}
    merging = models.BPE(vocab=rank, merges=[(letter, end) for letter in byte_of] + [(spelt(a), spelt(b)) for a, b in pairs])
    if any([t.id for t in merging.tokenize(t)] != [i] for t, i in rank.items()):
        return None
    byte_of[end] = ord(_END)
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in rank.items()}, np.array([*ids.values()], "<u4")


class LibraryEncoder:
    """A vocabulary file of the tokenizers library, with the ids that the library gives by default.

    A text that holds a string of the file's added tokens goes through the
    library's whole chain, which finds them. Of all others, a byte-level file
    whose merges are ranks (``merge_ranks``) is read by tiktoken, several times
    faster; runs of 10,000 white-space characters and more go through the chain.
    So are texts of settled characters for a file whose words end in a suffix
    (``suffix_ranks``). For other texts and files words are cut at certain pre-token borders and a part met
    often is encoded once: plain Latin parts by the library's model directly,
    all others by its whole chain. That both give the same ids is tried on a few
    words first.
    """

    def __init__(self, vocabulary_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(vocabulary_json)
        self.vocab_size = self._tok.get_vocab_size()
        self._model, self._letters = self._tok.model, byte_letters()
        chain = json.loads(vocabulary_json)
        self._added = [t["content"] for t in chain.get("added_tokens") or ()]
        self._lower = "Lowercase" in json.dumps(chain.get("normalizer"))
        self._drops_space = not self._chain(" ")
        self._lead = "" if self._drops_space else self._letters[32]
        self._plain = False
        tried = (" the", "The", " Lesung", " \u00e9t\u00e9", "\u00dcber", " of", " x", " stra\u00dfe", "\u00d8re", " qzxvj")
        self._plain = all(self._direct(t) == self._chain(t) for t in tried)
        self._added = [a.lower() for a in self._added] if self._lower else self._added
        self._ranked = self._by_ranks(merge_ranks(vocabulary_json))
        self._suffixed = None
        if found := suffix_ranks(vocabulary_json):
            import tiktoken

            ranks, self._id_of = found
            self._suffixed, self._words = tiktoken.Encoding("suffixed", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), _settled_words()
        self.forget()

    def _by_ranks(self, ranks: dict[bytes, int] | None):
        """tiktoken's encoder, if every token's bytes merge back into that token alone."""
        if ranks is None or any([t.id for t in self._model.tokenize(w.decode("latin-1").translate(self._letters))] != [i] for w, i in ranks.items()):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chain(self, part: str) -> bytes:
        return array("I", self._tok.encode(part, add_special_tokens=False).ids).tobytes()

    def _direct(self, part: str) -> bytes:
        text = part.lower() if self._lower else part
        text = text.lstrip(" ") if self._drops_space else text
        ids = [t.id for t in self._model.tokenize(text.encode().decode("latin-1").translate(self._letters))]
        return array("I", ids).tobytes()

    def _ids(self, part: str) -> bytes:
        return self._direct(part) if self._plain and _PLAIN.fullmatch(part) else self._chain(part)

    def _plain_word(self, stem: str) -> bytes:
        """Ids of a space and letters; ASCII ones stand for themselves in the byte-level alphabet."""
        if not (self._plain and stem.isascii()):
            return self._ids(" " + stem)
        tokens = self._model.tokenize(self._lead + (stem.lower() if self._lower else stem))
        return array("I", [t.id for t in tokens]).tobytes()

    def _bare_part(self, part: str) -> bytes:
        found = self._bare.find(part)
        if found is None:
            found = self._ids(part)
            self._bare.keep(part, found)
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word; a stem before punctuation is remembered as the word that it is."""
        stem = word.rstrip(_TAIL)
        if stem.isalpha() and stem[-1] != "\u0130":
            if len(stem) == len(word):
                return self._plain_word(word)
            found = self._known.find(stem)
            if found is None:
                found = self._plain_word(stem)
                self._known.keep(stem, found)
            return found + self._bare_part(word[len(stem) :])
        first, *rest = _BORDERS.split(" " + word)
        return self._ids(first) + b"".join(map(self._bare_part, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        seen = text.lower() if self._lower else text
        if any(a in seen for a in self._added):
            return self._chain(text)
        if self._ranked:
            return self._chain(text) if _LONG_BLANK.search(text) else self._ranked.encode_to_numpy(text).astype("<u4").tobytes()
        if self._suffixed and not _UNSETTLED.search(text):
            return self._id_of[self._suffixed.encode_to_numpy(_END.join([*self._words.findall(seen), ""]))].tobytes()
        first, *rest = space_cut(text)
        known = self._known
        try:
            out = b"".join(map(known.__getitem__, rest))
        except KeyError:
            known.make_room()
            self._bare.make_room()
            fresh = {}
            for word in [w for w in set(rest) if w not in known]:
                found = known.find(word)
                fresh[word] = self._word(word) if found is None else found
            known.keep_all(fresh)
            try:
                out = b"".join(map(known.__getitem__, rest))
            except KeyError:  # some words are too long to be remembered
                out = b"".join([fresh[w] if w in fresh else known[w] for w in rest])
        return b"".join(map(self._bare_part, _BORDERS.split(first))) + out if first else out

    def forget(self) -> None:
        """Give the memos' memory back; a worker does so at the end of each task."""
        self._known, self._bare = Memo(WORD_BYTES), Memo(PART_BYTES)  # words with a space before them, under their own letters; other parts


_LOADED: dict[str, LibraryEncoder] = {}


def library_encoder(vocabulary_json: str) -> LibraryEncoder:
    """The worker process's encoder; a worker holds that of one vocabulary at a time."""
    key = hashlib.sha256(vocabulary_json.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LibraryEncoder(vocabulary_json)
    return _LOADED[key]


def texts_of(column) -> Iterable[str | None]:
    """Python strings of an Arrow column, a bounded slice at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()
