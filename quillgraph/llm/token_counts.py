"""Exact token counts of every prefix of a text (byte-level BPE).

Method: prefix dynamic programming.  The BPE encoding of a prefix ends in one
well-defined token, and a token sequence is an encoding exactly when each
adjacent pair of it is stable, that is, encodes to itself.  So for each prefix
the longest token that ends there and forms a stable pair with the last token
of the prefix before it gives the last token and the count.  One pass over a
piece stores the count of all its prefixes; truncation and budget questions
read that array and never encode again.

Texts are cut into pieces by the vocabulary's own pattern.  A piece never spans
white space but for one leading blank, so most texts are read as blank-separated
words, whose prefix counts are stored: the words' last entries add up to the count
of the text, and where a budget ends is found among these sums and then in one
word's own entries.  Any other white space takes the general path.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import column, map_batches, record

# Fixed values of byte-level BPE: the piece pattern and the printable stand-ins of bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'re", "'ve", "'ll")

TOKEN_LIMIT = 1024
_MEMO, _MEMO_WORD = 700_000, 64
_NEVER = 1 << 60
# White space other than single blanks and single line feeds between words.
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]|  | \n|\n |\n\n|^[ \n]|[ \n]$")


_BLANK = regex.compile(r"\s+").fullmatch


def byte_symbols() -> dict[str, int]:
    """Stand-in character of each byte: printable ones themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of all prefixes under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.vocab = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.parts[self.vocab[a + b]] = (rank, self.vocab[a], self.vocab[b])
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pieces = regex.compile(PIECES)
        self._spines: tuple[dict, dict] = ({}, {})
        self._stable: dict[tuple[int, int], bool] = {}
        self._stored: dict[str, array] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's parts along its inner edge, smallest first, each with the rank that absorbs it."""
        known = self._spines[side].get(token)
        if known is None:
            known, above = [(token, _NEVER)], token
            while above in self.parts:
                rank, *pair = self.parts[above]
                above = pair[side]
                known.append((above, rank))
            known.reverse()
            self._spines[side][token] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to exactly a, b.

        Merges run in order of rank, so the tokens that meet at the boundary
        climb both inner edges; the pair breaks if they merge before either
        side absorbs its own.  Of equal ranks the leftmost merge comes first.
        """
        known = self._stable.get((a, b))
        if known is not None:
            return known
        if len(self._stable) >= _MEMO:
            self._stable.clear()
        left, right, i, j, ranks = self._spine(a, 1), self._spine(b, 0), 0, 0, self.ranks
        while True:
            (x, up_x), (y, up_y) = left[i], right[j]
            across = ranks.get((x, y), _NEVER)
            if across < up_x and across <= up_y and across != _NEVER:
                known = False
                break
            if up_x == up_y == _NEVER:
                known = True
                break
            if up_x <= up_y:
                i += 1
            else:
                j += 1
        self._stable[a, b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece; entry 0 is 0.

        The automaton yields the tokens that end at each byte, longest first.
        """
        counts, last, known, done = [0], [-1], self._stable.get, -1
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            if end != done:
                start = end + 1 - length
                if start:
                    pair = last[start], token
                    ok = known(pair)
                    if not (self.stable(*pair) if ok is None else ok):
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                done = end
        return counts

    def _total(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(self._piece_total(p) for p in self.pieces.findall(text))

    def _piece_total(self, piece: str) -> int:
        return self.piece(piece.encode("utf-8", "replace"))[-1]

    def _word(self, word: str) -> array:
        """Token counts of all prefixes of a word with what precedes it, stored up to a bounded count."""
        out = array("i", [0])
        # Letters with a blank in front of them, or none, are one piece.
        if word.isalpha() or (word[:1] == " " and word[1:].isalpha()):
            out.extend(self._ends(word))
        else:
            self._fill(word, out, 0)
        if len(word) <= _MEMO_WORD:
            if len(self._stored) >= _MEMO:
                self._stored.clear()
            self._stored[word] = out
        return out

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; special strings count one token each."""
        return self.count_and_cut(text, _NEVER)[0]

    def count_and_cut(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of a whole text, and the most characters whose encoding stays within the budget."""
        if not text:
            return 0, 0
        if (self.special and self.special.search(text)) or _OTHER_SPACE.search(text):
            n = self._whole(text)
            return n, len(text) if n <= budget else int(np.flatnonzero(self.prefixes(text) <= budget)[-1])
        stored, keys, total, ends = self._stored.get, self._keys(text), 0, []
        for key in keys:
            total += (stored(key) or self._word(key))[-1]
            ends.append(total)
        if total <= budget:
            return total, len(text)
        # The last word that begins within the budget; what is left of it is read from its own entries.
        k = bisect_right(ends, budget)
        before = ends[k - 1] if k else 0
        own = stored(keys[k]) or self._word(keys[k])
        return total, sum(map(len, keys[:k])) + max(i for i, n in enumerate(own) if before + n <= budget)

    def _whole(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._total, parts))

    @staticmethod
    def _keys(text: str) -> list[str]:
        """Words with what precedes them: a blank, a line feed, or nothing at the start."""
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[w if w[0] == "\n" else " " + w for w in rest]]

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... text[:n], as int32."""
        text = text or ""
        out, base, at = [0], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            # Parts of a special string are ordinary text until it is complete.
            self._fill(text[at : m.end()], out, base)
            base = out[m.start()] + 1
            out[m.end()] = base
            at = m.end()
        self._fill(text[at:], out, base)
        return np.asarray(out, np.int32)

    def _fill(self, text: str, out: list[int] | array, base: int) -> int:
        """Appends the counts of all prefixes of a text without special strings."""
        pieces, i, blank = self.pieces.findall(text), 0, _BLANK
        while i < len(pieces):
            piece = pieces[i]
            if blank(piece) and i + 1 < len(pieces):
                # The run as a prefix sees it is one piece up to its last character so far.
                run, j = piece, i + 1
                while j < len(pieces) and blank(pieces[j]):
                    run, j = run + pieces[j], j + 1
                shown = self._ends(run)
                out.extend(base + n for n in shown[: len(run)])
                base += sum(self._piece_total(p) for p in pieces[i:j])
                if j < len(pieces) and pieces[j][0] == " ":
                    # The blank in front of the next word ends this run.
                    out.append(base - sum(self._piece_total(p) for p in pieces[i:j]) + self._ends(run + " ")[-1])
                    out.extend(base + n for n in self._ends(pieces[j])[1:])
                    base += self._piece_total(pieces[j])
                    j += 1
                i = j
                continue
            ends = [1, 2, self._piece_total(piece)] if piece in CONTRACTIONS else self._ends(piece)
            out.extend([base + n for n in ends] if base else ends)
            base += ends[-1]
            i += 1
        return base

    def _ends(self, piece: str) -> list[int]:
        """Counts at the end of each character of a piece."""
        data = piece.encode("utf-8", "replace")
        counts, at, out = self.piece(data), 0, []
        if len(data) == len(piece):
            return counts[1:]
        for c in piece:
            at += len(c.encode("utf-8", "replace"))
            out.append(counts[at])
        return out


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(2)
def counter_of(path: str) -> PrefixCounter:
    """The counter of a vocabulary; a worker keeps it, with the words it has stored, from task to task."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars for every row.

    ``limit_chars`` is where a cut to the limit would be: the most characters whose
    encoding has at most ``limit`` tokens.  Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows
    stay as they are; other columns are ignored.
    """
    path = vocabulary or tokenizer_path()

    def make():
        counter = counter_of(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = column(batch, "text")
            sizes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            counts, cuts = zip(*[counter.count_and_cut(t, limit) for t in texts], strict=True)
            return record(doc_id=batch.column(0), n_bytes=pa.array(sizes, pa.int64()), n_tokens=pa.array(counts, pa.int64()), over_limit=pa.array([n > limit for n in counts], pa.bool_()), limit_chars=pa.array(cuts, pa.int64()))

        return work

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: array of the counts of all character prefixes (entry 0 is 0)."""
    path = vocabulary or tokenizer_path()

    def make():
        counter = counter_of(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            arrays = [counter.prefixes(t) for t in column(batch, "text")]
            return record(doc_id=batch.column(0), prefix_tokens=pa.array(arrays, pa.list_(pa.int32())))

        return work

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, make, f"doc_id {kind}, prefix_tokens array<int>")


def longest_prefix(prefix_tokens, budget: int):
    """Column: the most characters whose encoding stays within a token budget."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(prefix_tokens) - 1), lambda i: F.get(prefix_tokens, i) <= budget))
