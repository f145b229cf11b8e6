"""Language identification by prediction by partial matching (PPM).

Method: each language has a variable-order byte context tree with symbol counts
up to order three.  In a context, a symbol that was seen there costs
``-log2(count / (total + distinct))``; an unseen one costs the escape
``-log2(distinct / (total + distinct))`` and then its cost in the next shorter
context, without the symbols that the longer context already offered.  Below
order zero all 256 bytes are alike.  The statistics are frozen, so costs are worked
out once, and a text's cost is the exact code length of its bytes.

Contexts and symbols are kept sparsely, all of them.  Languages come in groups of
``GROUP``, each with a table of what its own languages saw, so the model grows in
proportion to the number of languages.

The trees are counted on the executors from a sample of labelled rows, about
``DOCS_PER_LANG`` of each language by a hash of the row; texts are read whole, and
only counts come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import column, give_back, map_batches, record, slices

ORDER = 3
DOCS_PER_LANG = 400
GROUP = 16
UNKNOWN = "und"
# The score weighs a text's evidence as that of so many bytes at most.
SCORE_BYTES = 64
START, BASE = 256, 257
_CHUNK = 1 << 17


def byte_codes(text: str) -> np.ndarray:
    """Lower-cased bytes after the symbols that stand before a text."""
    return np.concatenate((np.full(ORDER, START, np.int64), np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)))


def pair_codes(s: np.ndarray, order: int, base: int) -> np.ndarray:
    """Context and symbol as one number, for every symbol from ORDER on."""
    out = np.zeros(len(s) - ORDER, np.int64)
    for k in range(order, -1, -1):
        out = out * base + s[ORDER - k : len(s) - k]
    return out


def count_pairs(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the pair codes of all texts and their counts."""
    coded = [byte_codes(t) for t in texts]
    return [np.unique(np.concatenate([pair_codes(s, k, BASE) for s in coded]), return_counts=True) for k in range(ORDER + 1)]


def _find(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes among sorted keys, -1 where they are not."""
    if not len(keys):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, at, -1)


class _Group:
    """Costs of every pair that one of a few languages saw, under all of them."""

    def __init__(self, counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        langs = len(counts)
        # Order 0: bytes that a language never saw share its escape alike.
        self.flat = np.empty((BASE, langs), np.float32)
        self.pairs: list[np.ndarray] = [np.empty(0, np.int64)]
        self.costs: list[np.ndarray] = [self.flat]
        self.contexts: list[np.ndarray] = [np.empty(0, np.int64)]
        self.escapes: list[np.ndarray] = [np.empty((0, langs), np.float32)]
        own = []
        for lang, per in enumerate(counts):
            codes, n = per[0]
            total, distinct = n.sum(), len(codes)
            self.flat[:, lang] = 8.0 if not total else -np.log2(distinct / (total + distinct) / max(256 - distinct, 1))
            own.append(n / (total + distinct) if total else np.empty(0))
            self.flat[codes, lang] = -np.log2(own[lang])
        for order in range(1, ORDER + 1):
            pairs = np.unique(np.concatenate([per[order][0] for per in counts]))
            contexts = np.unique(pairs // BASE)
            escapes = np.zeros((len(contexts), langs), np.float32)
            seen, costs = [], np.empty((len(pairs), langs), np.float32)
            for lang, per in enumerate(counts):
                codes, n = per[order]
                place, at = np.unique(codes // BASE, return_inverse=True)
                total, distinct = np.bincount(at, n, len(place)), np.bincount(at, minlength=len(place))
                p = n / (total + distinct)[at] if len(codes) else np.empty(0)
                shorter = own[lang][np.searchsorted(per[order - 1][0], codes % BASE**order)]
                rest = 1.0 - np.bincount(at, shorter, len(place))
                escapes[np.searchsorted(contexts, place), lang] = -np.log2(distinct / (total + distinct) / np.maximum(rest, 1e-12))
                seen.append((codes, p))
            parent = pairs % BASE**order
            below = self.flat[parent] if order == 1 else self.costs[-1][np.searchsorted(self.pairs[-1], parent)]
            costs[:] = below + escapes[np.searchsorted(contexts, pairs // BASE)]
            for lang, (codes, p) in enumerate(seen):
                costs[np.searchsorted(pairs, codes), lang] = -np.log2(p)
            own = [p for _, p in seen]
            self.pairs.append(pairs)
            self.costs.append(costs)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def bits(self, s: np.ndarray) -> np.ndarray:
        """Cost of every symbol from ORDER on, under each language."""
        out = np.zeros((len(s) - ORDER, self.flat.shape[1]), np.float32)
        left = np.arange(len(out))
        codes = pair_codes(s, ORDER, BASE)
        for order in range(ORDER, 0, -1):
            at = _find(self.pairs[order], codes)
            hit = at >= 0
            out[left[hit]] += self.costs[order][at[hit]]
            left, codes = left[~hit], codes[~hit]
            if not len(left):
                return out
            at = _find(self.contexts[order], codes // BASE)
            out[left[at >= 0]] += self.escapes[order][at[at >= 0]]
            codes = codes % BASE**order
        out[left] += self.flat[codes]
        return out


class PpmModel:
    """Frozen code lengths of all languages, from the pair counts of each."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(counts)
        self.groups = [_Group([counts[lang] for lang in self.langs[k : k + GROUP]]) for k in range(0, len(self.langs), GROUP)]

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> PpmModel:
        return cls({lang: count_pairs(texts) for lang, texts in samples.items()})

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language, in the order of ``langs``."""
        coded = [byte_codes(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        # Long texts are cut with the context of each part in front; short ones are read side by side.
        parts = [(i, s[at : at + _CHUNK + ORDER]) for i, s in enumerate(coded) for at in range(0, max(len(s) - ORDER, 1), _CHUNK)]
        at = 0
        while at < len(parts):
            size, to = 0, at
            while to < len(parts) and (to == at or size + len(parts[to][1]) <= _CHUNK):
                size += len(parts[to][1])
                to += 1
            s = np.concatenate([p for _, p in parts[at:to]])
            ends = np.cumsum([len(p) for _, p in parts[at:to]])
            starts = ends - [len(p) for _, p in parts[at:to]]
            for k, group in enumerate(self.groups):
                total = np.concatenate((np.zeros((1, group.flat.shape[1])), np.cumsum(group.bits(s), axis=0, dtype=np.float64)))
                # Row j stands for symbol j + ORDER; the symbols before a text are not paid for.
                sums = total[ends - ORDER] - total[starts]
                np.add.at(out[:, k * GROUP : k * GROUP + GROUP], [i for i, _ in parts[at:to]], sums)
            at = to
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Languages with scores; ``und`` with 0 without letters or without a model.

        The score is the posterior under equal priors, where a text of more than
        ``SCORE_BYTES`` bytes counts as that many bytes at its mean cost.
        """
        out = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t is not None and self.langs and any(map(str.isalpha, t))]
        if own:
            for i, bits in zip(own, self.code_lengths([texts[i] for i in own]), strict=True):
                best = int(bits.argmin())
                size = len(texts[i].lower().encode("utf-8", "replace"))
                share = min(1.0, SCORE_BYTES / size)
                out[i] = self.langs[best], float(1.0 / np.exp2(np.maximum((bits[best] - bits) * share, -1000.0)).sum())
        return out


def training_counts(docs: DataFrame, where: Column, id_col: str, text_col: str, lang_col: str, per_lang: int = DOCS_PER_LANG) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Pair counts of about ``per_lang`` labelled rows of each language, all rows where there are fewer.

    Rows are taken by a cut through a hash of id and text, so the same rows come
    whatever the partitioning, and no row is sorted or gathered.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).filter(where & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    cut = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 30, -(-per_lang * (1 << 30) // n)))]), F.col("l"))
    some = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < cut).select("l", "t")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                texts: dict[str, list[str]] = {}
                for lang, text in zip(column(part, "l"), column(part, "t"), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    for order, (codes, n) in enumerate(count_pairs(own)):
                        yield record(l=pa.array([lang] * len(codes), pa.string()), o=pa.array([order] * len(codes), pa.int32()), c=pa.array(codes), n=pa.array(n.astype(np.int64)))
        give_back()

    total = some.mapInArrow(count, "l string, o int, c long, n long").groupBy("l", "o", "c").agg(F.sum("n").alias("n")).toArrow()
    lang, order, code, n = (total.column(c).to_numpy() for c in ("l", "o", "c", "n"))
    out = {}
    for name in counts:
        per = []
        for k in range(ORDER + 1):
            mine = (lang == name) & (order == k)
            by_code = np.argsort(code[mine])
            per.append((code[mine][by_code], n[mine][by_code]))
        out[name] = per
    return out


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """A model from the labelled rows that satisfy ``where`` (written on columns i, t and l)."""
    return PpmModel(training_counts(docs, F.lit(True) if where is None else where, id_col, text_col, lang_col))


def with_columns(docs: DataFrame, names: list[str], added: list[str]) -> list[str]:
    """The columns to carry: those named, without any that the added ones replace."""
    return [c for c in names if c.lower() not in {a.lower() for a in added}]


def predict(docs: DataFrame, model: PpmModel, text_col: str = "text", keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns of ``keep`` (all by default) with the predicted language and its score.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no row was labelled.  Texts of any length are scored whole.  Columns
    with the names of the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = with_columns(docs, docs.columns if keep is None else keep, [lang_out, score_out])
    slim = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__qg_text"))
    schema = slim.drop("__qg_text").schema.add(lang_out, "string").add(score_out, "double")

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = own.predict(column(batch, "__qg_text"))
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, lang_out, score_out])

        return work

    return map_batches(slim, make, schema)


def keep_known(docs: DataFrame, model: PpmModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is known with at least ``min_score``; columns as before."""
    found = predict(docs, model, text_col, lang_out="__qg_lang", score_out="__qg_score")
    return found.filter((F.col("__qg_lang") != UNKNOWN) & (F.col("__qg_score") >= min_score)).drop("__qg_lang", "__qg_score")
