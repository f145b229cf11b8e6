"""Benchmark decontamination with a generalised suffix automaton.

Method: the normalised words of all test items go into one generalised suffix
automaton (one automaton, restarted at every item, so that no match spans two
items).  Training words stream through it; at each word the automaton knows the
longest run of words ending there that also occurs in some item.  A run of
``window`` words is an occurrence of that window; an item with fewer words is
one window by itself.  Spans inside occurrences are hit; a document whose hit
share reaches ``coverage`` is contaminated.

Items are taken in shards of about ``SHARD_BYTES`` of text, by a hash of the text.
The driver builds the automaton of one shard at a time and sends it as flat sorted
arrays, some 15 bytes for each byte of items; ``SHARDS_PER_PASS`` of them meet in a
task.  More shards take more passes over the documents, each of which leaves rows
of documents with hits only; hits of all passes are united by a hash of the text.
Items of more than ``MAX_ITEM_BYTES`` are refused before anything is fetched.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import column, map_batches, materialize, record, with_text

WINDOW = 13
COVERAGE_PERCENT = 5
SHARD_BYTES, SHARDS_PER_PASS, MAX_ITEM_BYTES = 2 << 20, 8, 1 << 30

# Words: runs of digits, a-z and code points from U+0080 on, after lower-casing A-Z.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class ItemAutomaton:
    """Suffix automaton over the word sequences of (item_id, text) pairs, while it grows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = sorted({str(i) for i, _ in items if i is not None})
        place = {name: i for i, name in enumerate(self.names)}
        worded = []
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in normal_words(text)]
            if words:
                worded.append((words, set() if item is None else {place[str(item)]}))
            last = 0
            for w in words:
                last = self._extend(last, w)
        # Adding words splits states, so the items each state occurs in are gathered in a second walk.
        self.held: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}
        for words, own in worded:
            state = 0
            for w in words:
                state = self.next[state][w]
                self.held.setdefault(state, set()).update(own)
            if len(words) < window:
                self.short[state] = (len(words), self.short.get(state, (0, set()))[1] | own)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if state in self.held and self.link[state] > 0:
                self.held.setdefault(self.link[state], set()).update(self.held[state])
        self.least = min((min(len(words), window) for words, _ in worded), default=0)
        # The nearest state at or above each one where a short item ends.
        self.short_up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.short_up[state] = state if state in self.short else self.short_up[self.link[state]]

    def _extend(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nexts[p]:
            nexts[p][w] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        return clone

    def compact(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """The finished automaton in flat arrays: transitions sorted by state and word, and what each state means."""

    def __init__(self, grown: ItemAutomaton):
        self.window, self.least, self.names, self.vocab = grown.window, grown.least, grown.names, grown.vocab
        self.width = max(len(grown.vocab), 1)
        moves = sorted((state * self.width + w, to) for state, out in enumerate(grown.next) for w, to in out.items())
        self.keys, self.to = array("q", [k for k, _ in moves]), array("i", [t for _, t in moves])
        self.link, self.length, self.short_up = array("i", grown.link), array("i", grown.length), array("i", grown.short_up)
        # Items are asked for only where a window or a short item ends.
        self.held: dict[int, array] = {}
        for state, own in grown.held.items():
            if grown.length[state] >= grown.window > grown.length[grown.link[state]]:
                self.held[state] = array("i", sorted(own))
        self.short = {state: (n, array("i", sorted(own))) for state, (n, own) in grown.short.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans [start, end) of words, and the places of items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if words and self.least:
            known = self.vocab.get
            ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
            # A word of no item restarts the automaton, and a shorter stretch between two such words holds no window.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
            for start, end in edges.reshape(-1, 2).tolist():
                if end - start >= self.least:
                    self._stream(ids[start:end].tolist(), start, spans, found)
        return spans, found

    def _stream(self, ids: list[int], first: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        keys, to, link, length, window, short_up, width = self.keys, self.to, self.link, self.length, self.window, self.short_up, self.width
        seen: set[int] = set()
        state, matched, size = 0, 0, len(self.keys)
        for at, w in enumerate(ids, first):
            while True:
                key = state * width + w
                place = bisect_left(keys, key)
                if place < size and keys[place] == key:
                    state, matched = to[place], matched + 1
                    break
                if not state:
                    break
                state = link[state]
                matched = length[state]
            up = state
            if matched >= window:
                while length[link[up]] >= window:
                    up = link[up]
                if up not in seen:
                    seen.add(up)
                    found.update(self.held.get(up, ()))
                _add(spans, at + 1 - window, at + 1)
            # Short items that end here: all on the path of suffix links that fit the match.
            s = short_up[state]
            while s:
                n, own = self.short[s]
                if n <= matched:
                    found.update(own)
                    _add(spans, at + 1 - n, at + 1)
                s = short_up[link[s]]


def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
    while spans and start <= spans[-1][1]:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = SHARD_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items on the driver, one shard of about ``limit`` bytes after the other.

    One item table is a test set written by people, not a part of the corpus;
    its size is summed before anything is fetched.
    """
    slim = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total > MAX_ITEM_BYTES:
        raise ValueError(f"{total} bytes of items are more than {MAX_ITEM_BYTES}; split the item table")
    n = max(1, -(-total // limit))
    for k in range(n):
        yield [(r.i, r.t) for r in (slim.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else slim).collect()]


def _passes(docs: DataFrame, items: DataFrame, window: int) -> list[list]:
    """Broadcast automata, as many for each pass as a task holds at once."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(ItemAutomaton(shard, window).compact()) for shard in shards(items)]
    return [sent[k : k + SHARDS_PER_PASS] for k in range(0, len(sent), SHARDS_PER_PASS)]


def _with_hits(docs: DataFrame, items: DataFrame, window: int, text_col: str, finish, schema) -> DataFrame:
    """Runs ``finish(batch, found)`` on batches of ``docs``; found has (words, spans, item ids) of each row."""
    passes = _passes(docs, items, window)
    if len(passes) == 1:

        def make():
            automata = [p.value for p in passes[0]]
            return lambda batch: finish(batch, [(len(w), *_united(automata, w)) for w in map(normal_words, column(batch, text_col))])

        return map_batches(docs, make, schema)
    keys = {"__qg_a": F.xxhash64(F.col(f"`{text_col}`")), "__qg_b": F.xxhash64(F.lit(1), F.col(f"`{text_col}`"))}
    texts = docs.select(F.col(f"`{text_col}`").alias("t"), *[v.alias(k) for k, v in keys.items()]).filter("t is not null")
    parts = [map_batches(texts, _partial(k, p), "__qg_a long, __qg_b long, part struct<k:int,edges:array<int>,names:array<string>>") for k, p in enumerate(passes)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Copies of a text leave equal rows, so a set holds one of each pass.
    merged = materialize(every, "op10-hits").groupBy("__qg_a", "__qg_b").agg(F.collect_set("part").alias("__qg_parts"))
    joined = docs.withColumns(keys).join(materialize(merged, "op10-merged"), ["__qg_a", "__qg_b"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__qg_parts")

    def make_last():
        def work(batch: pa.RecordBatch):
            found = []
            for text, own in zip(column(batch, text_col), column(batch, "__qg_parts"), strict=True):
                edges = [p["edges"] for p in own or ()]
                spans = _merged([(e[k], e[k + 1]) for e in edges for k in range(0, len(e), 2)])
                found.append((len(normal_words(text)), spans, {n for p in own or () for n in p["names"]}))
            return finish(batch.drop_columns(["__qg_parts"]), found)

        return work

    return map_batches(joined, make_last, schema)


def _partial(number: int, sent: list):
    def make():
        automata = [p.value for p in sent]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, parts = [], []
            for i, text in enumerate(column(batch, "t")):
                spans, names = _united(automata, normal_words(text))
                if spans:
                    rows.append(i)
                    parts.append({"k": number, "edges": [x for s in spans for x in s], "names": sorted(names)})
            if not rows:
                return None
            take = pa.array(rows)
            kind = pa.struct([("k", pa.int32()), ("edges", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))])
            return record(__qg_a=batch.column(1).take(take), __qg_b=batch.column(2).take(take), part=pa.array(parts, kind))

        return work

    return make


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    # Spans of several automata may nest, unlike those of one, whose ends only grow.
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _united(automata: list[Scanner], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    spans: list[tuple[int, int]] = []
    names: set[str] = set()
    for a in automata:
        own, found = a.scan(words)
        spans += own
        names |= {a.names[i] for i in found}
    return (_merged(spans) if len(automata) > 1 else spans), names


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = COVERAGE_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    Null texts have no words.  A null item id still marks words as hit but is
    not listed; repeated items count once.  No items, or items without words,
    hit nothing.
    """

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        n_hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
        return record(
            doc_id=batch.column(0), n_words=pa.array([n for n, *_ in found], pa.int64()), n_hit=pa.array(n_hit, pa.int64()), n_items=pa.array([len(names) for *_, names in found], pa.int64()),
            items_sha256=pa.array([hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() for *_, names in found], pa.string()),
            contaminated=pa.array([h > 0 and 100 * h >= percent * n for h, (n, *_) in zip(n_hit, found, strict=True)], pa.bool_()),
        )

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return _with_hits(slim, items, window, "text", finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = COVERAGE_PERCENT, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Documents without contaminated ones; in the others, hit spans are cut out of the text.

    A document goes when its hit words reach ``percent`` of its words (the limit
    on coverage).  From the others every span of ``window`` words or more that
    items hold (the limit on length), or of a whole shorter item, is removed
    together with the punctuation inside it.  All columns stay; ``length_col``,
    if there, is counted anew for texts that changed.
    """
    count = length_col if length_col in docs.columns else None

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        texts, keep, changed = column(batch, text_col), [], False
        for i, (n, spans, _) in enumerate(found):
            n_hit = sum(b - a for a, b in spans)
            keep.append(not (n_hit > 0 and 100 * n_hit >= percent * n))
            if spans and keep[-1]:
                texts[i], changed = cut(texts[i], spans), True
        if changed:
            batch = with_text(batch, text_col, texts, count)
        return batch.filter(pa.array(keep, pa.bool_()))

    return _with_hits(docs, items, window, text_col, finish, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and without what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    normal = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], normal.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
