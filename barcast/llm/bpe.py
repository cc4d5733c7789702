"""Byte-level BPE: merges compiled into a lazily determinised transducer, and streaming decoding.

A tokenisation is the BPE result exactly when no two neighbouring tokens would
have merged across their border. So the tokenisations of all prefixes form a
nondeterministic transducer whose paths are (token before, node in the trie of
token bytes), and for each prefix just one path ends on a token border.
Determinising it keeps the set of open paths; each move also tells the one
token that ends there. Where a single path is left, all tokens up to it are
certain and are emitted; a path is open for at most the length of the longest
token, which bounds lookahead and state. States and moves are made when first
met and kept in a bounded table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from barcast.llm.common import map_lists

MAX_STATES = 150_000  # moves are forgotten beyond this many states; results do not change
MAX_WORDS = 100_000  # words and pieces remembered in a generation; the one before is kept too
MAX_WORD_CHARS = 64  # longer ones are not remembered
DECODE_IDS = 8_192  # ids per step of the decoder


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Plain pair merging down to ``stop`` parts: the lowest rank first, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Deterministic transducer over bytes, built as it is used."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks = ranks
        self.max_states = max_states
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        # per token: its parts along the right and the left edge, and the rank at which each is merged away
        self.right: dict[int, list[tuple[bytes, int]]] = {}
        self.left: dict[int, list[tuple[bytes, int]]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            halves = merge(token, ranks, 2)
            if len(halves) > 2:
                continue  # merging never makes it, so it only occurs as a whole piece
            whole = [(token, 1 << 60)]
            first, last = ranks[halves[0]], ranks[halves[-1]]
            self.left[rank] = whole + [(p, min(d, rank)) for p, d in self.left[first]] if len(halves) == 2 else whole
            self.right[rank] = whole + [(p, min(d, rank)) for p, d in self.right[last]] if len(halves) == 2 else whole
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.forget()

    def clear(self) -> None:
        """Drop all that was learned from texts."""
        self.pairs.clear()
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._intern(((0, -1),))

    def _intern(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def _apart(self, left: int, right: int) -> bool:
        """True if the two tokens do not merge across their border.

        They do where parts at the border form a token of a rank below that
        at which the left part is merged away, and not above that of the right
        part (of equal ranks the leftmost is merged first).
        """
        ranks = self.ranks
        for a, a_ends in self.right[left]:
            for b, b_ends in self.left[right]:
                rank = ranks.get(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and the token that ends here."""
        live, ended = [], -1
        pairs = self.pairs
        for node, before in self.states[state]:
            below = self.children[node].get(byte)
            if below is None:
                continue
            if self.children[below]:
                live.append((below, before))
            token = self.token_at[below]
            if token >= 0 and ended < 0:
                if before >= 0:
                    key = before << 20 | token
                    apart = pairs.get(key)
                    if apart is None:
                        if len(pairs) > 2 * self.max_states:
                            pairs.clear()
                        apart = pairs[key] = self._apart(before, token)
                    if not apart:
                        continue
                ended = token
        live.append((0, ended))
        moved = self.moves[state << 8 | byte] = (self._intern(tuple(live)), ended)
        return moved

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-split piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.forget()
        out: list[int] = []
        ends: list[int] = []  # the token that ends at each byte since the last emission
        state, moves = self.start, self.moves
        for byte in piece:
            moved = moves.get(state << 8 | byte)
            if moved is None:
                if len(self.states) > 2 * self.max_states:  # one very long piece
                    kept = self.states[state]
                    self.forget()
                    moves, state = self.moves, self._intern(kept)
                moved = self._move(state, byte)
            state, token = moved
            ends.append(token)
            if len(ends) >= 64 and len(self.states[state]) == 1:
                out += self._emitted(ends)
                ends = []
        return out + self._emitted(ends) if out else self._emitted(ends)

    def _emitted(self, ends: list[int]) -> list[int]:
        """Tokens up to the last byte, found from there backwards."""
        out, at, size = [], len(ends), self.size
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class Remembered:
    """Packed ids by string, in two generations: what the older one still serves moves to the newer one."""

    def __init__(self) -> None:
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def put(self, key: str, packed: bytes | None) -> None:
        if len(key) <= MAX_WORD_CHARS:
            if len(self.new) >= MAX_WORDS:
                self.old, self.new = self.new, {}
            self.new[key] = packed


class Encoder:
    """Splits a text by the pattern and encodes each match separately."""

    def __init__(self, transducer: Transducer, pattern: str) -> None:
        # \s of the pattern is Unicode white space, without the separators 1C to 1F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.transducer = transducer
        self.words = Remembered()
        self.pieces = Remembered()  # those that are not one word behind a space

    def _packed(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        packed = self.pieces.old.get(piece)
        if packed is None:
            packed = self._packed(piece)
        self.pieces.put(piece, packed)
        return packed

    def _pieces(self, text: str) -> bytes:
        known, piece = self.pieces.new, self._piece
        return b"".join([known[p] if p in known else piece(p) for p in self.split.findall(text)])

    def _word(self, word: str) -> bytes | None:
        """Ids of a word behind a space; None where the space may belong to other white space."""
        kept = self.words.new if word in self.words.new else self.words.old
        if word in kept:
            packed = kept[word]
        elif not word or word[0].isspace() or word[-1].isspace():
            packed = None
        else:
            found = self.split.findall(" " + word)
            packed = self._packed(found[0]) if len(found) == 1 else b"".join([self.pieces.new.get(p) or self._piece(p) for p in found])
        self.words.put(word, packed)
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space between two characters that are not white space always begins
        a match, so such words are encoded one by one and remembered.
        """
        if not text:
            return b""
        first, *words = text.split(" ")
        if not words or not first or first[-1].isspace():
            return self._pieces(text)
        known, word = self.words.new, self._word
        packed = [known[w] if w in known else word(w) for w in words]
        if None in packed:
            return self._pieces(text)
        return self._pieces(first) + b"".join(packed)


class Utf8Stream:
    """Incremental UTF-8 state machine: holds back an unfinished character between chunks.

    The state is the bytes of a begun character. Bytes that can't be UTF-8
    come out as U+FFFD, as in a decoding of the whole.
    """

    _open = re.compile(
        rb"(?:[\xC2-\xDF]|\xE0[\xA0-\xBF]?|[\xE1-\xEC\xEE\xEF][\x80-\xBF]?|\xED[\x80-\x9F]?"
        rb"|\xF0(?:[\x90-\xBF][\x80-\xBF]?)?|[\xF1-\xF3](?:[\x80-\xBF][\x80-\xBF]?)?|\xF4(?:[\x80-\x8F][\x80-\xBF]?)?)\Z"
    )

    def __init__(self) -> None:
        self.pending = b""

    def push(self, chunk: bytes) -> str:
        data = self.pending + chunk
        begun = self._open.search(data, max(0, len(data) - 3))
        cut = begun.start() if begun else len(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_steps(ids: np.ndarray, tokens: list[bytes], step: int = DECODE_IDS) -> Iterator[str]:
    """Text of the ids, chunk by chunk; an unknown id is an error."""
    stream = Utf8Stream()
    for at in range(0, len(ids), step):
        yield stream.push(b"".join([tokens[i] for i in ids[at : at + step].tolist()]))
    yield stream.finish()


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=1)
def _transducer(path: str) -> Transducer:
    """The trie and the edges of all tokens: made once per worker, of fixed size."""
    return Transducer(_ranks(path))


@contextmanager
def _encoder(path: str, pattern: str) -> Iterator[Encoder]:
    """An encoder for one task; what it remembers, and all states and moves, go at the end."""
    transducer = _transducer(path)
    try:
        yield Encoder(transducer, pattern)
    finally:
        transducer.clear()


def _tokens(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): one row per row of ``docs``; ids are packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows with equal or null ids are encoded
    each for itself; other columns are ignored. ``path`` must exist on every
    executor (it belongs to an installed package).
    """

    def work(batches):
        with _encoder(path, pattern) as encoder:
            for ids, texts in batches:
                packed = [encoder.encode(t) for t in texts]
                yield [ids, [len(p) // 4 for p in packed], packed]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text of its packed ``ids`` as column ``text`` (a null counts as no ids)."""
    columns = encoded.columns
    at = columns.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def work(batches):
        tokens = _tokens(path)
        for batch in batches:
            packed = (np.frombuffer(p or b"", dtype="<u4") for p in batch[at])
            yield [*batch, ["".join(decode_steps(ids, tokens)) for ids in packed]]

    return map_lists(encoded, work, f"{schema}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of encoding each text and decoding the ids again, in one pass.

    One row per row of ``docs``. A null or empty text has no ids and the digests of nothing; rows
    with equal or null ids are worked on each for itself, and columns other than ``doc_id`` and ``text`` are ignored.
    """

    def decoded_hash(packed: bytes, tokens: list[bytes]) -> str:
        decoded = sha256()
        for part in decode_steps(np.frombuffer(packed, dtype="<u4"), tokens):
            decoded.update(part.encode())
        return decoded.hexdigest()

    def work(batches):
        tokens = _tokens(path)
        with _encoder(path, pattern) as encoder:
            for ids, texts in batches:
                packed = [encoder.encode(t) for t in texts]
                out = [ids, [len(p) // 4 for p in packed], [sha256(p).hexdigest() for p in packed], [decoded_hash(p, tokens) for p in packed]]
                yield [*out, packed] if with_ids else out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_lists(docs.select("doc_id", "text"), work, schema + ", ids binary" * with_ids)
