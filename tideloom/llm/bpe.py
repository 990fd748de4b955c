"""BPE encoding and decoding by an automaton compiled from the merges.

The automaton reads tokens. It starts as one state with a loop for every base symbol. The gadget of merge (u, v) -> w, applied in
rank order, changes it so that u is never followed by v: a u-arc now ends in a copy of its old target without the v-arc,
and wherever u could be read, w can be read too, ending where v ends. After all merges a word has exactly one accepted spelling,
its BPE encoding, and so has each prefix of it. All u-arcs share one target, so a state is named by the token read last; copies are
kept as deltas (the removed arc and its rank), and a token made from v inherits v's deltas so far.

For reading symbols the arcs' labels are compiled into a deterministic matching automaton: arrays of nodes with their token, its
length, the next shorter token that ends alike, and a failure link. A word is encoded in one pass without backtracking: each symbol is one
step, after which the one token that ends here and has an arc from the state at its start is the state at this place. Arcs are
decided from the gadgets' records when first asked for and kept in a bounded table. The labels read backwards from the end are the
encoding; decoding emits the arcs' labels.

Texts are cut at white space (no token crosses it), pieces are normalised and split as the tokenizer file says, and results are
kept in bounded tables, since most pieces of a corpus recur.

Defined results: null is read as the empty text: no tokens. Any length is encoded whole. Rows, ties and extra columns come back as they are.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES, WORDS, ARCS, STEPS = 400_000, 600_000, 500_000, 200_000  # entries of the bounded tables
#: White space of the Unicode property White_Space, as a character class.
SPACE = "\t-\r \x85\xa0  -     　"


@cache
def char_class(major: str) -> str:
    """Ranges of all code points of a general category's first letter, for use inside brackets."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        hit = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies (a fixed public table, built from its rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeAutomaton:
    """``merges``: pairs in rank order; ``suffix``: mark that the last symbol of a word carries. Tokens and symbols are vocabulary ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.ids, self.suffix = vocab, suffix
        self.label = {i: s for s, i in vocab.items()}
        self.width = max(vocab.values(), default=0) + 1
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        self.cut: dict[int, int] = {}  # u * width + v: rank of the gadget that took the v-arc away after u
        self.arcs: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(u, v, rank)
        self._compile(sorted(vocab))

    def _gadget(self, left: str, right: str, rank: int) -> None:
        w = self.ids.get(left + right)
        if w is None or w in self.parts or left not in self.ids or right not in self.ids:
            return
        u, v = self.ids[left], self.ids[right]
        if not self._open(u, v, rank):
            return  # v can't follow u at this rank, so there is no arc to change
        self.cut[u * self.width + v] = rank
        self.parts[w] = (u, v, rank)

    def _open(self, last: int, token: int, now: int) -> bool:
        """Whether the state after ``last`` has an arc ``token``, counting the gadgets with a rank up to ``now``."""
        parts, cut, width = self.parts, self.cut, self.width
        while True:
            state, until = last, now
            while True:  # the state's own deltas, then those it inherited from its right part
                gone = cut.get(state * width + token)
                if gone is not None and gone <= until:
                    return False
                made = parts.get(state)
                if made is None:
                    break
                state, until = made[1], min(until, made[2] - 1)
            made = parts.get(token)
            if made is None:
                return True
            token, now = made[0], min(now, made[2])  # the arc came with the one of its left part

    def arc(self, last: int, token: int) -> bool:
        key = last * self.width + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._open(last, token, self.width)
        return found

    def symbols(self, word: str) -> list[int]:
        """Base symbols of a label that ends a word if it ends with the suffix."""
        end = bool(self.suffix) and word.endswith(self.suffix)
        plain = word[: -len(self.suffix)] if end else word
        return [self.ids[c] for c in (plain[:-1] if end else plain)] + ([self.ids[plain[-1] + self.suffix]] if end else [])

    def _compile(self, labels: list[str]) -> None:
        """Nodes of the prefixes of all labels that are base symbols or that a gadget made; node 0 is the start."""
        width = self.width
        self.go: dict[int, int] = {}  # node * width + symbol: the node one symbol longer
        token, size, born = [-1], [0], []
        for t in labels:
            if t == self.suffix:
                continue
            try:
                word = self.symbols(t)
            except KeyError:  # a label that no text spells (special tokens)
                continue
            if len(word) > 1 and self.ids[t] not in self.parts:
                continue
            node = 0
            for s in word:
                key = node * width + s
                child = self.go.get(key)
                if child is None:
                    child = self.go[key] = len(token)
                    born.append((size[node] + 1, node, s, child))
                    token.append(-1)
                    size.append(size[node] + 1)
                node = child
            token[node] = self.ids[t]
        self.token, self.size = array("i", token), array("i", size)
        self.fail, self.shorter = array("i", [0]) * len(token), array("i", [0]) * len(token)
        for _, parent, s, child in sorted(born):
            if parent:
                f = self.fail[child] = self._longer(self.fail[parent], s)
                self.shorter[child] = f if self.token[f] >= 0 else self.shorter[f]
        self.jump: dict[int, int] = {}

    def _longer(self, node: int, symbol: int) -> int:
        """The node of the longest suffix that goes on."""
        go, width = self.go, self.width
        while (found := go.get(node * width + symbol)) is None and node:
            node = self.fail[node]
        return found or 0

    def spell_ids(self, word: list[int]) -> list[int]:
        """The tokens of the accepted path over the symbols of a word."""
        width, jump, token, size, shorter = self.width, self.jump, self.token, self.size, self.shorter
        arcs, node, state, back = self.arcs, 0, [-1], [0]
        for i, s in enumerate(word, 1):
            key = node * width + s
            node = jump.get(key, -1)
            if node < 0:
                if len(jump) >= STEPS:
                    jump.clear()
                node = jump[key] = self._longer(key // width, s)
            m = node if token[node] >= 0 else shorter[node]
            while m:
                t, n = token[m], size[m]
                if n == i:
                    break
                last = state[i - n]
                ok = arcs.get(last * width + t)
                if ok or ok is None and self.arc(last, t):
                    break
                m = shorter[m]
            else:
                raise ValueError(f"no spelling for {word!r}")
            state.append(t)
            back.append(i - n)
        out, i = [], len(word)
        while i:
            out.append(state[i])
            i = back[i]
        return out[::-1]

    def spell(self, word: str) -> list[str]:
        """The labels of the accepted path over ``word`` (base symbols, without the suffix)."""
        return [self.label[t] for t in self.spell_ids(self.symbols(word + self.suffix))] if word else []


class _Table(dict):
    """A mapping that computes what it lacks. When full it becomes the old generation, from which what recurs is taken back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encoder of a tokenizer file whose model is BPE with word ends (NFC, lower case, split at white space)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this encoder reads BPE files with NFC, white-space and lower-case normalisers")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.auto = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        letters, numbers = char_class("L"), char_class("N")
        self.words = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label = self.auto.label | {i: s for s, i in self.special.items()}
        self.odd = re.compile("[\x1c-\x1f]")
        self.space = re.compile(f"[{SPACE}]+")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        symbols = byte_symbols()
        suffix = self.auto.suffix
        self.inner = [self.auto.ids[symbols[b]] for b in range(256)]
        self.last = [self.auto.ids[symbols[b] + suffix] for b in range(256)]
        self.word = _Table(self._word, WORDS)
        self.piece = _Table(self._piece, PIECES)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        return tuple(self.auto.spell_ids([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]))

    def _ids(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isascii() and text.isalpha():
            return list(self.word[text])
        return [i for w in self.words.findall(text) for i in self.word[w]]

    def _piece(self, piece: str) -> tuple[int, str, str]:
        """(number of tokens, their ids, their labels) of a piece without white space."""
        ids: list[int] = []
        at = 0
        for m in self.marks.finditer(piece) if self.marks and "<" in piece else ():
            ids += self._ids(piece[at : m.start()])
            ids.append(self.special[m.group()])
            at = m.end()
        ids += self._ids(piece[at:] if at else piece)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def pieces(self, text: str) -> list[str]:
        return [p for p in self.space.split(text) if p] if self.odd.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text or "") for i in self.piece[p][1].split()]

    def decode(self, ids) -> str:
        """The arcs' labels, joined as the file's decoder (none) does: by a space."""
        return " ".join([self.label[i] for i in ids])

    def encode_text(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a space, decoded text)."""
        found = [x for x in map(self.piece.__getitem__, self.pieces(text or "")) if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry``'s columns (all but the text by default) with n_tokens, ids (decimal ids joined by one space) and decoded.

    ``path`` is the tokenizer file's place on every machine. Work is by Arrow batch; nothing is shuffled.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    carry = [c for c in (carry if carry is not None else docs.columns) if c != text and c not in {f.name for f in new}]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            step = 500
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                n, ids, decoded = zip(*map(enc.encode_text, part[text].to_pylist()))
                yield pa.RecordBatch.from_arrays([*[part[c] for c in carry], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[*carry, *[f.name for f in new]])

    return docs.select(*[F.col(f"`{c}`") for c in [*carry, text]]).mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + new))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, tokenizer_path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
