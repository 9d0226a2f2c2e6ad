"""Byte-level BPE as an automaton of merge gadgets.

``compile_merges`` builds a deterministic automaton over tokens, one gadget per rule in
rule order. It starts as a single state that reads every byte. The gadget of rule
(a, b) -> ab takes the arc b from the state behind a, and gives every state that reads a an
arc ab to a copy of the state behind b; a rule whose arc b is gone already adds nothing. The
state behind a token depends on that token alone, so a gadget is kept as what it copies and
takes: the halves of ab, and the number of the rule. A token path is the BPE encoding of its
text exactly if each step follows an arc, and every text has one such path.

To read bytes, the labels of the arcs are spelled out in a trie. Where an arc may be under
way from several places at once, these places together are one state, so that each state
and byte have one next state; such a state is made when a text first reaches it and stands
in the transition table from then on. Every state carries its output: the token that the
path of the text so far ends with. ``encode_word`` is one loop over the bytes by that table;
the outputs, read from the end, are the path. ``decode`` emits the labels of the arcs.

Tables are built from the vocabulary file once per Python worker, on the executor; the file's
path is a parameter that every executor can read. The memories of words, of chunks between
white space and of transitions are emptied at fixed sizes, which changes no result.

Cases: null counts as empty; an empty text has 0 tokens and an empty id list; special tokens
of the file are recognised in a text, as the file says; texts of any length are encoded
whole, repeated rows alike, other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the vocabulary: its pre-splitting pattern, and white space as that pattern means it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A pre-split word never reaches over a border of these chunks.
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
MEMORY = 300_000
LONG = 100


def byte_letters() -> dict[str, int]:
    """The file's letter for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: States of the transition table before it is emptied.
STATES = 150_000
_START = -1


class Automaton:
    """Gadgets over tokens, and the transition table over bytes that follows from them."""

    def __init__(self, labels: dict[int, bytes]):
        self.labels = labels
        self.size = {k: len(v) for k, v in labels.items()}
        #: Number of the rule that made a token; its halves; the rule that took arc b from the state behind a.
        self.made: dict[int, int] = {k: -1 for k in labels}
        self.halves: dict[int, tuple[int, int]] = {}
        self.taken: dict[tuple[int, int], int] = {}
        #: Tokens that stand on some path.
        self.whole = {k for k, v in labels.items() if len(v) == 1}
        self.goto: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        self._empty()

    def add_gadget(self, n: int, a: int, b: int, ab: int) -> None:
        """Rule ``n``: (a, b) -> ab."""
        if (a, b) in self.taken:
            return
        if ab not in self.halves and a in self.whole and b in self.whole and self.reads(a, b):
            self.made[ab], self.halves[ab] = n, (a, b)
            self.whole.add(ab)
        self.taken[a, b] = n

    def reads(self, a: int, b: int) -> bool:
        """Whether the state behind ``a`` has the arc ``b``: no rule took it from a state or an arc that these were copied from.

        The copies are followed from the latest gadget back; ``before`` and ``upto`` are the
        rules that came while both were there.
        """
        taken, made, halves = self.taken, self.made, self.halves
        before = upto = 1 << 60
        while True:
            n = taken.get((a, b))
            if n is not None and n < before and n <= upto:
                return False
            if made[a] > made[b]:
                before = made[a]
                a = halves[a][1]
            elif b in halves:
                upto = made[b]
                b = halves[b][0]
            else:
                return True

    def spell(self) -> None:
        """The trie of the labels."""
        goto, token_at, inner = self.goto, self.token_at, self.inner
        for token in self.whole:
            node = 0
            for byte in self.labels[token]:
                inner[node] = True
                step = goto.get(node << 8 | byte)
                if step is None:
                    step = goto[node << 8 | byte] = len(token_at)
                    token_at.append(-1)
                    inner.append(False)
                node = step
            token_at[node] = token

    def _empty(self) -> None:
        """The table with its start state alone. A state: places (token before, trie node), earliest first."""
        self.places: list[tuple[tuple[int, int], ...]] = [((_START, 0),)]
        self.output: list[int] = [_START]
        self.number = {self.places[0]: 0}
        self.table: dict[int, int] = {}

    def _next(self, state: int, byte: int) -> int:
        """Make the transition; one place alone ends a token on the path, as the path is the only one."""
        goto, token_at, inner = self.goto, self.token_at, self.inner
        places, ended = [], _START
        for before, node in self.places[state]:
            node = goto.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                places.append((before, node))
            token = token_at[node]
            if ended == _START and token >= 0 and (before == _START or self.reads(before, token)):
                ended = token
        places.append((ended, 0))
        key = tuple(places)
        out = self.number.get(key)
        if out is None:
            out = self.number[key] = len(self.places)
            self.places.append(key)
            self.output.append(ended)
        self.table[state << 8 | byte] = out
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The arc path over ``word``."""
        if len(self.places) > STATES:
            self._empty()
        table, output = self.table, self.output
        state, ends = 0, []
        for byte in word:
            to = table.get(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            ends.append(output[state])
        path, at, size = [], len(word), self.size
        while at:
            token = ends[at - 1]
            path.append(token)
            at -= size[token]
        path.reverse()
        return path


def compile_merges(labels: dict[int, bytes], merges: list[tuple[bytes, bytes]]) -> Automaton:
    """The automaton of a vocabulary: a gadget per rule, in rule order, then the labels spelled out."""
    id_of = {v: k for k, v in labels.items()}
    automaton = Automaton(labels)
    for n, (a, b) in enumerate(merges):
        automaton.add_gadget(n, id_of[a], id_of[b], id_of[a + b])
    automaton.spell()
    return automaton


class Tokenizer:
    """Pre-splitting, the automaton and a word memory."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = compile_merges(labels, [(raw(a), raw(b)) for a, b in merges])
        self.label = {**labels, **{i: s.encode() for s, i in special.items()}}
        self.special = special
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.chunks, self.words = re.compile(CHUNK), regex.compile(PATTERN)
        #: Chunk or word to its ids, packed.
        self.memory: dict[str, bytes] = {}
        self.digits = {i: str(i) for i in self.label}

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit integers; a pre-split word is a chunk of its own."""
        words = self.words.findall(chunk)
        if len(words) == 1:
            return array("i", self.automaton.encode_word(chunk.encode())).tobytes()
        out = []
        for w in words:
            ids = self.memory.get(w)
            if ids is None:
                ids = array("i", self.automaton.encode_word(w.encode())).tobytes()
                if len(w) <= LONG:
                    self.memory[w] = ids
            out.append(ids)
        return b"".join(out)

    def _ids(self, text: str) -> list[int]:
        memory = self.memory
        chunks = self.chunks.findall(text)
        if len(memory) > MEMORY:
            memory.clear()
        for c in set(chunks).difference(memory):
            if len(c) <= LONG and c not in memory:
                memory[c] = self._packed(c)
        try:
            packed = b"".join(map(memory.__getitem__, chunks))
        except KeyError:  # chunks too long to be kept
            packed = b"".join(memory[c] if c in memory else self._packed(c) for c in chunks)
        return memoryview(packed).cast("i").tolist()

    def encode(self, text: str) -> list[int]:
        if self.parts is None or not any(s in text for s in self.special):
            return self._ids(text)
        return [i for piece in self.parts.split(text) if piece for i in ([self.special[piece]] if piece in self.special else self._ids(piece))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Lists:
    """Lists of ids as one flat buffer of 32-bit integers, four bytes an id."""

    def __init__(self):
        self.ids, self.ends = array("i"), array("i", [0])

    def add(self, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def arrow(self) -> pa.Array:
        flat = lambda a: pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)])
        return pa.ListArray.from_arrays(flat(self.ends), flat(self.ids))


def encode(text: Column | str, path: str) -> Column:
    """Token ids of a text."""

    @F.arrow_udf("array<int>")
    def run(v: pa.Array) -> pa.Array:
        t, out = tokenizer(path), _Lists()
        for x in v:
            out.add(t.encode(x.as_py() or ""))
        return out.arrow()

    return run(text)


def tokenized(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = (), rows: int = 256) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids, and whether the ids decode to the text.

    Results leave the worker ``rows`` at a time, so that memory follows a few texts, not a batch.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out, counts, same = _Lists(), [], []
                for x in part.column(part.num_columns - 1):
                    own = x.as_py() or ""
                    ids = t.encode(own)
                    out.add(ids)
                    counts.append(len(ids))
                    same.append(t.decode(ids) == own)
                new = [pa.array(counts, pa.int64()), out.arrow(), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(ids: Column | str, path: str) -> Column:
    """Text of token ids."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        t = tokenizer(path)
        return pa.array([t.decode(x.as_py() or []) for x in v], pa.string())

    return run(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text decoded from the ids)."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(v: pa.Array) -> pa.Array:
        t = tokenizer(path)
        counts, digests, texts = [], [], []
        for x in v:
            ids = t.encode(x.as_py() or "")
            counts.append(len(ids))
            digests.append(sha256(",".join(map(t.digits.__getitem__, ids)).encode()).hexdigest())
            texts.append(sha256(t.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
