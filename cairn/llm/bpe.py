"""Byte-level BPE as a lazily determinised finite-state transducer, and its decoder.

Two neighbouring tokens may stand in an encoding exactly if encoding their joined
bytes gives them back, and a token sequence is the encoding of its bytes exactly if
all neighbours may stand together. So every prefix has one encoding, and a
nondeterministic transducer that guesses the next token (walks a trie, checks the
token against the one before) accepts one path. Its subset construction, built as
texts ask for it, keeps per open guess the trie node, the token before and the output
not shared by all guesses; what all share is emitted, at most one token's length
behind the input.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from contextlib import contextmanager

import regex

#: The characters besides the plain space that the patterns treat as white space (fixed values).
_SPACES = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile(rf" [ {_SPACES}]|[{_SPACES}] ")
_BORDER = re.compile(r"(?<=\S)(?= \S)")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The lines `base64 rank` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """pieces -> token ids. At most max_states determinised states are held; beyond that they are built anew."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.max_states = max_states
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for word, i in ranks.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.allowed: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states and what is known of neighbours; the trie stays."""
        self.allowed = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.ids = {start: 0}
        self.guesses = [start]
        self.rest: list[tuple[int, ...]] = [()]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, word: bytes) -> list[bytes]:
        """Plain lowest-rank-first merging; used to split a token into the two it was merged from."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or parts[at] + parts[at + 1] == word:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = self.merge(self.bytes_of[token])
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge reaches across the border, undoing the later merge of the two sides step by step."""
        key = left << 32 | right
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > 400_000:
                self.allowed.clear()
            known = self.allowed[key] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        undone = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < undone:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        still, ended = [], None
        for node, before, held in self.guesses[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and ended is None and (before < 0 or self.may_follow(before, token)):
                ended = (token, (*held, token))
            if self.children[nxt]:
                still.append((nxt, before, held))
        if ended is None:
            raise ValueError("the vocabulary lacks single bytes")
        still.append((0, *ended))
        first, n = still[0][2], 0
        while n < len(first) and all(len(x[2]) > n and x[2][n] == first[n] for x in still):
            n += 1
        key = tuple((node, before, held[n:]) for node, before, held in still)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.guesses)
            self.guesses.append(key)
            self.rest.append(key[-1][2])
            self.steps.append({})
        out = self.steps[state][byte] = (to, first[:n])
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """A whole piece in the vocabulary is that token, as the rank files' library has it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.guesses) > self.max_states:
            self._reset()
        state, out, steps = 0, [], self.steps
        for b in piece:
            move = steps[state].get(b)
            if move is None:
                move = self._step(state, b)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self.rest[state]
        return tuple(out)


class Encoder:
    """Texts to ids: cuts by the pattern, then runs the transducer on each piece.

    A space between two other characters that aren't white space always begins a piece, and what
    stands between two such spaces is cut alike wherever it stands; so those stretches are the
    unit of a bounded memory (two generations of max_memory stretches).
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_memory: int = 400_000):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.max_memory = max_memory
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Gives the memory back: Python workers are used again by tasks that need theirs for other things."""
        self.new, self.old = {}, {}
        self.transducer.forget()

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _cut(self, text: str) -> tuple[int, ...]:
        encode = self.transducer.encode_piece
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):  # letters only, as the pattern's: one piece
            return encode(text.encode())
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += encode(p.encode("utf-8", "surrogatepass"))
        return tuple(out)

    def stretch(self, text: str) -> tuple[int, ...]:
        found = self.old.get(text)
        if found is None:
            if text[-1] in ".," and text[-2:-1].isalpha() and text[1:-1].isalpha():  # a word and its mark: two pieces
                word = text[:-1]
                found = self.new.get(word)
                return (self.stretch(word) if found is None else found) + self.transducer.encode_piece(text[-1].encode())
            found = self._cut(text)
        if len(self.new) >= self.max_memory:
            self.old, self.new = self.new, {}
        if len(text) <= 64:
            self.new[text] = found
        return found

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut into stretches that encode independently of each other."""
        if _ODD_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
            return _BORDER.split(text)
        if "\0" not in text:
            return text.replace(" ", "\0 ").split("\0")
        first, *more = text.split(" ")
        return [first, *[" " + x for x in more]]

    def count(self, stretches: list[str]) -> int:
        """How many tokens the stretches have."""
        n, known = 0, self.new.get
        for x in stretches:
            found = known(x)
            if found is None:
                found = self.stretch(x)
                known = self.new.get
            n += len(found)
        return n

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.new.get
        for x in self.stretches(text):
            found = known(x)
            if found is None:
                found = self.stretch(x)
                known = self.new.get
            out += found
        return out


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text completed so far, flush() the replacement of a cut end."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete yet."""
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        n = self.open_bytes(data)
        self.tail = data[len(data) - n :] if n else b""
        return data[: len(data) - n].decode("utf-8", "replace")

    def flush(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


def decode_stream(bytes_of: dict[int, bytes], ids, block: int = 4096):
    """(bytes, text) of blocks of ids; the texts joined are the whole text."""
    stream = Utf8Stream()
    for i in range(0, len(ids), block):
        data = b"".join([bytes_of[x] for x in ids[i : i + block]])
        yield data, stream.feed(data)
    yield b"", stream.flush()


_held: dict[tuple[str, str], Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker, vocabulary and pattern."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _held:
        _held[key] = Encoder(load_ranks(data), pattern)
        gc.freeze()  # the trie stays; states and memory hold no cycles
        gc.set_threshold(200_000, 50, 1000)
    return _held[key]


@contextmanager
def encoding(data: bytes, pattern: str, memory: int = 400_000):
    """The worker's encoder for the length of a task, which forgets all but the trie when the task ends. memory: how many stretches each of
    two generations holds; as many states as three quarters of that are held."""
    held = encoder(data, pattern)
    held.max_memory, held.transducer.max_states = memory, 3 * memory // 4
    try:
        yield held
    finally:
        held.forget()
