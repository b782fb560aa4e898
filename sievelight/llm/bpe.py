"""Byte-level BPE by backtracking over longest matches.

A piece of text is encoded without simulating merges. An Aho-Corasick automaton
over the vocabulary (bytes mapped to Latin-1 characters) gives the longest token
at a place. The encoder appends the longest token that may follow the one
before it, and steps back when none may. Two neighbouring tokens are compatible
if undoing the merges from both sides of their border never meets a merge across
it that would have come earlier; the verdicts are memoised. A position at which
an attempt failed is never tried again, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without
from .encoding import Memo, WordMemo, texts_of

#: Remembered verdicts on pairs of neighbouring tokens (under 100 bytes each) before all are forgotten.
VERDICTS = 400_000

#: White space as Unicode defines it, which the patterns of vocabularies mean by \s.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> bytes:
    """The rank file of a fixed public vocabulary (under a megabyte), for shipping to tasks."""
    with open(path, "rb") as f:
        return f.read()


def pattern_of(pat: str):
    """The pre-token pattern with \\s and \\S spelt out, for the regex module."""
    import regex

    return regex.compile(pat.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


class BacktrackEncoder:
    def __init__(self, rank_file: bytes, pat: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = pattern_of(pat)
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}  # verdicts on neighbouring tokens
        reachable = self._learn_merges()
        self._automaton(reachable)
        self._memo, self._pieces = WordMemo(self._words), Memo()

    def _learn_merges(self) -> list[bytes]:
        """How each token is made of two earlier ones; tokens that no merge makes are left out."""
        reachable = []
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._halves[rank] = (rank, rank)
                reachable.append(token)
                continue
            parts = self._merged(token, rank)
            if len(parts) == 2:
                self._halves[rank] = (parts[0], parts[1])
                self._merge[parts[0], parts[1]] = rank
                reachable.append(token)
        return reachable

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The plain merge procedure with merges under a rank; used on vocabulary entries only."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _automaton(self, tokens: list[bytes]) -> None:
        import ahocorasick

        # Every beginning of a token leads to the longest token that it begins with.
        known = {t: self.rank[t] for t in tokens}
        self._ac = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in tokens:
            best = -1
            for n in range(1, len(token) + 1):
                best = known.get(token[:n], best)
                self._ac.add_word(token[:n].decode("latin-1"), best)
        self._reach = max(map(len, tokens))
        top = max(self.bytes_of) + 1
        self._size = [len(self.bytes_of.get(r, b"")) for r in range(top)]
        self._shorter = [-1] * top  # the longest token that is a proper prefix, or -1
        for token in tokens:
            self._shorter[known[token]] = next((known[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in known), -1)

    def _border_stays(self, left: int, right: int) -> bool:
        before = 1 << 62  # merges from this rank on come too late to matter
        while True:
            across = self._merge.get((left, right))
            if across is not None and across < before:
                return False
            # Undo the later of the two merges that made the tokens at the border.
            a, b = self._halves[left], self._halves[right]
            left_whole, right_whole = a[0] == left, b[0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                before, left = left, a[1]
            else:
                # At equal ranks merges run from the left, so a merge across comes first.
                before, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, fits, shorter = len(piece), self._size, self._fits, self._shorter
        text, reach, prefix, longest = piece.decode("latin-1"), self._reach, self._ac.longest_prefix, self._ac.get
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest(text[: prefix(text[:reach])])
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if end not in dead:
                    key = last << 20 | token
                    fit = True if last < 0 else fits.get(key)
                    if fit is None:
                        fit = fits[key] = self._border_stays(last, token)
                    if fit:
                        out.append(token)
                        at = end
                        if at < n:
                            ahead = text[at : at + reach]
                            token = longest(ahead[: prefix(ahead)])
                        break
                token = shorter[token]
                if token < 0:
                    # Nothing may stand here: take the last token back and try its shorter prefixes.
                    dead.add(at)
                    token = out.pop()
                    at -= size[token]
                    break
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        find, known = self.pattern.findall, self._pieces
        known.make_room()
        if len(self._fits) > VERDICTS:
            self._fits.clear()
        out = []
        for word in words:
            found = b""
            for part in find(word):
                packed = known.find(part)
                if packed is None:
                    ids = self.encode_piece(part.encode())
                    packed = pack(f"<{len(ids)}I", *ids)
                    known.keep(part, packed)
                found += packed
            out.append(found)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self._memo.encode(text or "")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def _encoder(key: str, pat: str, box: _Box) -> BacktrackEncoder:
    return BacktrackEncoder(box.data, pat)


class _Box:
    """Equal for equal bytes, so that a worker builds each encoder once."""

    def __init__(self, data: bytes):
        self.data, self.key = data, hashlib.sha256(data).hexdigest()

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def encoder_of(rank_file: bytes, pat: str) -> BacktrackEncoder:
    box = _Box(rank_file)
    return _encoder(box.key, pat, box)


def _mapped(df: DataFrame, column: str, new: list[tuple[str, T.DataType]], make) -> DataFrame:
    """``df`` with new columns made from one; clashing columns are replaced."""
    kept = without(df.columns, [n for n, _ in new])
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = make(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + columns, names=kept + [n for n, _ in new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pat: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` (long).

    Every whole text is encoded, without special tokens, each match of ``pat``
    separately. Null and empty texts have no ids. The ids are those of the plain
    merge procedure, also for very long pre-tokens. Rows that repeat are encoded
    each; an empty table gives an empty one; columns named like an added one are
    replaced.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make(column):
        encoder = encoder_of(ranks.value, pat)
        ids = [encoder.encode(t) for t in texts_of(column)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(df, text, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], make)


def decode(df: DataFrame, ranks_path: str, pat: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the tokens in ``ids``; null ids give no bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make(column):
        encoder = encoder_of(ranks.value, pat)
        return [pa.array([encoder.decode(x.as_py() or b"") for x in column], pa.binary())]

    return _mapped(df, ids, [("decoded", T.BinaryType())], make)
