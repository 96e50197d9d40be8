"""Piece-merging tokenizer (operator 2): exact encoding by a table of last tokens, and decoding by the library.

The merge rule is that of a SentencePiece BPE model: of all neighbouring symbols
whose concatenation is a piece, the pair with the best score merges first, the
leftmost of equals. Two facts make a linear algorithm exact (and hold for this
rule, whose choices inside a stretch never depend on what lies beyond a final
token border):

* the encoding of a prefix ends in exactly one token, and what precedes it is the
  encoding of the shorter prefix;
* a token may follow another exactly if the two strings, joined, encode to
  these two tokens.

So one pass over the matches of a piece automaton stores each prefix's last
token, each candidate costing one (memoised) pair test, and the ids are read off
backwards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from voxelframe.llm.common import map_texts, texts

SPACE = "▁"
START = -1  # before the first token, and after a character that no piece has
CACHED_WORDS = 300_000  # a worker remembers the ids of one to two times as many words; some 120 MB at most
CACHED_LENGTH = 48
CACHED_PAIRS = 600_000
TRAILING = ".,;:!?#$%&*|)"  # tried as separate words when a word is new and no piece spans the cut


class PieceModel:
    def __init__(self, path: str):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        control = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): i for i in range(n) if not control[i] and not sp.is_byte(i)}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.strings = {i: p for p, i in self.pieces.items()}
        self.length = [len(self.strings.get(i, "")) for i in range(n)]
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.spans = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.newline = self.pack(self._word("\n"))

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, text: str) -> list[str]:
        """The merge rule carried out literally; for short strings."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, first: int, second: int) -> bool:
        """The pair test; ``first`` may be :data:`START`."""
        key = (first + 1) << 32 | second
        known = self.pairs.get(key)
        if known is None:
            b = self.strings[second]
            a = [self.strings[first]] if first != START else []
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged("".join(a) + b) == [*a, b]
        return known

    def _word(self, text: str) -> list[int]:
        """Ids of a stretch of text (spaces already escaped)."""
        n = len(text)
        last, pairs = [START] * (n + 1), self.pairs
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] == START:
                before = last[end + 1 - size]
                known = pairs.get((before + 1) << 32 | token)
                if known or (known is None and self.may_follow(before, token)):
                    last[end + 1] = token
        out, k = [], n
        while k:
            token = last[k]
            if token == START:  # a character without a piece: its bytes
                out.extend(self.byte_id[b] for b in reversed(text[k - 1].encode("utf-8", "replace")))
                k -= 1
            else:
                out.append(token)
                k -= self.length[token]
        out.reverse()
        return out

    def alone(self, text: str) -> bytes:
        """Packed ids of a stretch that starts at a token border, spaces escaped."""
        got = self.starts.get(text)
        if got is None:
            got = self.pack(self._word(text))
            if len(text) <= CACHED_LENGTH:
                if len(self.starts) >= CACHED_WORDS // 4:
                    self.starts.clear()
                self.starts[text] = got
        return got

    def word(self, text: str) -> bytes:
        """Packed ids of a space and a word; what was seen before the last ``CACHED_WORDS`` new words is forgotten."""
        got = self.older.get(text)
        if got is None:
            stem = text.rstrip(TRAILING)
            if stem and len(stem) < len(text) and text[len(stem) - 1 : len(stem) + 1] not in self.spans:
                got = (self.words.get(stem) or self.word(stem)) + self.alone(text[len(stem) :])
            else:
                got = self.pack(self._word(SPACE + text))
        if len(text) <= CACHED_LENGTH:
            if len(self.words) >= CACHED_WORDS:
                self.older, self.words = self.words, {}
            self.words[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text, with begin and end ids: little-endian unsigned 32-bit."""
        ends = self.pack([self.bos]), self.pack([self.eos])
        if not text:
            return b"".join(ends)
        if self.inner_space or SPACE in text or "  " in text or text[0] == " ":
            return ends[0] + self._plain(SPACE + text.replace(" ", SPACE)) + ends[1]
        word, parts, first = self.word, [ends[0]], True
        for line in text.split("\n"):
            words = line.split(" ")
            if first:
                first = False
                parts.append(word(words[0]))
            elif words[0]:
                parts.append(self.alone(words[0]))
            del words[0]
            known = self.words
            parts += [known.get(w) or word(w) for w in words]
            parts.append(self.newline)
        parts[-1] = ends[1]
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        """Any escaped text: cut where a space follows something else (no piece spans that), or not at all."""
        if self.inner_space:
            return self.pack(self._word(text))
        out, k, n = [], 0, len(text)
        while k < n:
            j = k
            while j < n and text[j] == SPACE:
                j += 1
            j = text.find(SPACE, j)
            j = n if j < 0 else j
            out.append(self.alone(text[k:j]))
            k = j
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """Text of the ids in UTF-8, by the library itself."""
        return self.processor.decode(ids).encode()


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """Once per worker."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts; narrow, nothing shuffles.

    Returns ``(id, n_tokens, ids_sha256, decoded_sha256)`` per row, and with
    ``with_ids`` also ``ids`` and ``decoded``. A null or empty text has just the
    begin and end ids. Rows are independent: repeated rows, null ids and other
    columns of the input (which are not returned) change nothing.
    """

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        model = load(model_path)
        for keys, column in batches:
            n, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for text in texts(column):
                packed = model.encode(text)
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                plain = model.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_texts.append(plain.decode("utf-8", "replace"))
            yield {"id": keys, "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash, "ids": all_ids, "decoded": all_texts}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return map_texts(docs, run, schema, id_col, text_col).withColumnRenamed("id", id_col)
