"""Token ids of whole texts by the tokenizers library, asked once for each distinct pre-token.

Texts are cut where no token crosses: for files that drop white space (a Split pre-tokenizer) into runs without white space; for
byte-level files into runs with at most one space in front, and runs of white space. The pieces of a batch that aren't known yet are
cut into pre-tokens together, by the file's pattern over one string, and a pre-token's ids come from the library's model. Pieces
and pre-tokens recur, so bounded tables in each worker process hold their ids (little-endian unsigned 32-bit). Runs of white space, and pieces with a special token's literal or with code points that this Python doesn't know, go
through the library's whole pipeline as they are.

Over half of a corpus's pieces occur once. So new ones wait in a smaller table, and enter the large one when they are met again.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from itertools import accumulate, chain

from .bpe import SPACE, byte_symbols, char_class
from .shared import kept, trim_memory

LIMIT, FRESH = 400_000, 150_000  # entries of a generation of the large table (there are two), and of the small one; about 200 bytes each
BATCH_DOCS = 400
MARK = b"\xff" * 4  # between ids' bytes; an id is below 2**24, so its last byte is 0


class PieceIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        trim_memory(piece_ids)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        import json

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        self.drops = pre["type"] == "Sequence" and pre["pretokenizers"][0]["type"] == "Split"
        if not self.drops and not (pre["type"] == "ByteLevel" and not pre["add_prefix_space"]):
            raise ValueError("unknown pre-tokenizer")
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec.get("added_tokens", [])}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.runs = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        letters, numbers = char_class("L"), char_class("N")
        sp = "" if self.drops else " ?"
        digits = f"[{numbers}]" if self.drops else f" ?[{numbers}]+"
        # the file's pattern behind the mark that separates pieces; alternatives that can't start alike may change places
        self.tokens = re.compile(f"\n|{sp}[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|{digits}|{sp}[^{SPACE}{letters}{numbers}]+")
        self.symbols = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
        self.chars: set[str] = set()  # that this Python knows
        self.table: dict[str, bytes] = {}  # met again
        self.old: dict[str, bytes] = {}  # its last generation
        self.fresh: dict[str, bytes] = {}  # met once

    def pieces(self, text: str) -> list[str]:
        if self.marks and "<|" in text and (parts := self.marks.split(text))[1:]:
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if not self.drops:
            return self.runs.findall(text)
        return [p for p in self.space.split(text) if p] if self.odd.search(text) else text.split()

    def _odd(self, pieces: list[str], joined: str) -> list[str]:
        """The pieces that the library takes as they are."""
        bad = {c for c in set(joined) - self.chars if unicodedata.category(c) == "Cn"}
        if bad or "<|" in joined:
            return [p for p in pieces if p.isspace() or "<|" in p or not bad.isdisjoint(p)]
        self.chars.update(joined)
        return [] if self.drops else [p for p in pieces if p.isspace()]

    def _again(self, pieces: set[str]) -> list[str]:
        """Those that no table has. What is met again goes into the large one."""
        if again := pieces & self.fresh.keys():
            self.table.update(zip(again, list(map(self.fresh.pop, again))))
            pieces -= again
        if back := pieces & self.old.keys():
            self.table.update(zip(back, map(self.old.__getitem__, back)))
            pieces -= back
        return list(pieces)

    def _bound(self) -> None:
        if len(self.table) > LIMIT:
            self.old, self.table = self.table, {}
        if len(self.fresh) > FRESH:
            self.fresh = {}

    def spell(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, as the file's normaliser leaves them."""
        spell = self.tok.model.tokenize
        symbols = "\n".join(words).encode().decode("latin-1").translate(self.symbols).split(self.symbols[10]) if words else []
        return [array("I", [t.id for t in spell(s)]).tobytes() for s in symbols]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; their pre-tokens' ids are kept."""
        self._bound()
        made = self._learn(pieces)
        return list(map(made.__getitem__, pieces))

    def _learn(self, lack: list[str]) -> dict[str, bytes]:
        """The ids of pieces that no table has; their pre-tokens' go into the small one."""
        joined, out = "\n".join(lack), {}
        if odd := self._odd(lack, joined):
            out.update(zip(odd, [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(odd, add_special_tokens=False)]))
            lack = [p for p in lack if p not in out]
            joined = "\n".join(lack)
        if not lack:
            return out
        if self.drops:
            if not joined.isascii():
                joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
            joined = joined.lower()
        tokens = self.tokens.findall(joined + "\n")
        words = set(tokens)
        words.discard("\n")
        new = self._again(words - self.table.keys())
        made = dict(zip(new, self.spell(new)))
        known = words - made.keys()
        ids = made | dict(zip(known, map(self.table.__getitem__, known))) | {"\n": MARK}
        self.fresh.update(made)
        out.update(zip(lack, b"".join(map(ids.__getitem__, tokens)).split(MARK)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; null: none."""
        cut = [self.pieces(t or "") for t in texts]
        self._bound()
        pieces = list(chain.from_iterable(cut))
        ids = list(map(self.table.get, pieces))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            left = list(map(pieces.__getitem__, holes))
            if lack := self._again(set(left)):
                self.fresh.update(self._learn(lack))
            table, fresh = self.table, self.fresh
            for i, p in zip(holes, left):
                x = fresh.get(p)
                ids[i] = table[p] if x is None else x
        ends = list(accumulate(map(len, cut)))
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def rest(self) -> None:
        """A task has ended: its worker process waits, maybe for another operator's task, and keeps one generation only, which that operator drops."""
        self.old = {}
        trim_memory(piece_ids)


@kept
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)
