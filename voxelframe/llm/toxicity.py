"""Toxicity by nearest labelled examples (operator 6): exact TF-IDF cosine over a block-max inverted index.

The vocabulary is every word of the labelled training examples, of both classes,
and besides those beginnings of words and repetitions that the classes use
differently beyond chance. A term weighs its inverse document frequency, over
all documents, times how surely the classes differ in it (plain inverse document
frequencies let the rare words of invented or topical prose drown everything
else). The index holds a bounded sample of training documents; a document's
score is the similarity-weighted vote of its nearest examples, calibrated on the
examples' own leave-one-out votes, and the examples are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from voxelframe.llm.common import lean, map_texts, prepare_workers, saved, texts

EXAMPLES = 3000  # most labelled training documents of each class that the model is fitted on
PREFIXES = (4, 5, 6, 7)
TERMS, COUNTS = "__terms", "__counts"  # columns of counted documents
AGAIN = " x"  # marks a term that stands for another one occurring so often in a text
REPEATS = (2, 3, 5)
SURE = 3.0  # standard errors by which the log odds of a term in the two classes are pulled towards none
BASE = 0.005  # strength of a term in which the classes do not differ
NEIGHBORS = 15
SHRINK = 0.5  # similarity mass of the prior in a vote
BLOCK = 64  # examples in a block of the index
PRUNED = 30_000  # postings of a query's strong terms from which on blocks are bounded first
OPENED = 6  # blocks opened first
FREQUENT = 16  # a term in more than one of so many examples is kept as a whole row of weights instead of a list
TOGETHER = 256  # queries that are multiplied with these rows at once
REJECT = 0.7
CACHED_TOKENS = 20_000  # a worker remembers as many tokens besides the words of the vocabulary
CACHED_LENGTH = 48
HEAD = min(PREFIXES)
TRAILING = ".,;:!?#$%&*|)"
WORD = re.compile(r"\w+")


def terms_of(token: str) -> list[str]:
    """Terms of a white-space token: its words in lower case, and their beginnings (marked by a trailing hyphen)."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(w)
        out += [w[:n] + "-" for n in PREFIXES if len(w) > n]
    return out


class TermCounter:
    """Counts of vocabulary terms in a text; knows what all words of the vocabulary mean, and remembers other tokens."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        ids = {t: i for i, t in enumerate(vocabulary) if AGAIN not in t}
        self.again: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(vocabulary):
            if AGAIN in t:  # its plain term is counted too, under a number past the vocabulary if it is not part of it
                plain, times = t.split(AGAIN)
                self.again.setdefault(ids.setdefault(plain, self.size + len(ids)), []).append((int(times), i))
        self.heads: dict[str, list[tuple[str, int]]] = {}  # beginnings that are terms, by how they begin
        for t, i in ids.items():
            if t.endswith("-"):
                self.heads.setdefault(t[:HEAD], []).append((t[:-1], i))
        self.known = {t: (i, *self._beginnings(t)) for t, i in ids.items() if not t.endswith("-")}
        self.added: list[str] = []  # known tokens that are no words of the vocabulary

    def _beginnings(self, word: str) -> tuple[int, ...]:
        return tuple([i for start, i in self.heads.get(word[:HEAD], ()) if len(word) > len(start) and word.startswith(start)])

    def _token(self, token: str) -> tuple[int, ...]:
        lower = token.lower()
        word = lower.rstrip(TRAILING)
        got = self.known.get(word)
        if got is None:
            if word.isalpha():  # one word
                got = self._beginnings(word)
            else:
                got = tuple(chain.from_iterable(self.known.get(w) or self._beginnings(w) for w in WORD.findall(lower)))
        if len(token) <= CACHED_LENGTH:
            if len(self.added) >= CACHED_TOKENS:
                for t in self.added:
                    self.known.pop(t, None)
                self.added = []
            self.known[token] = got
            self.added.append(token)
        return got

    def _ids(self, tokens: Collection[str]) -> list[tuple[int, ...]]:
        found = list(map(self.known.get, tokens))
        if None in found:
            found = [self._token(t) if f is None else f for f, t in zip(found, tokens, strict=True)]
        return found

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text in order, and how often each occurs."""
        seen = Counter(chain.from_iterable(self._ids(text.split())))
        for i in self.again.keys() & seen.keys():
            for least, j in self.again[i]:
                if seen[i] >= least:
                    seen[j] = 1
        ids, n = np.fromiter(seen, np.int64, len(seen)), np.fromiter(seen.values(), np.float64, len(seen))
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        past = len(ids) - np.searchsorted(ids, self.size)  # numbers past the vocabulary
        return (ids[:-past], n[:-past]) if past else (ids, n)

    def present(self, text: str) -> np.ndarray:
        """Terms of a text, in any order."""
        tokens = Counter(text.split())
        found = self._ids(tokens)
        seen = set(chain.from_iterable(found))
        if again := self.again.keys() & seen:
            times = dict.fromkeys(again, 0)
            for some, n in zip(found, tokens.values(), strict=True):
                for i in some:
                    if i in again:
                        times[i] += n
            seen.update(j for i, k in times.items() for least, j in self.again[i] if k >= least)
        ids = np.fromiter(seen, np.int64, len(seen))
        return ids[ids < self.size]

    def count(self, text: str) -> dict[int, int]:
        ids, n = self.arrays(text)
        return dict(zip(ids.tolist(), n.astype(int).tolist(), strict=True))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[k] ... first[k] + count[k] - 1`` for every k, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


class BlockMaxIndex:
    """Postings by term, cut at blocks of examples, with the largest weight of each piece.

    Terms that many examples hold are whole rows of weights, in single precision;
    many queries are multiplied with them at once. Of the others the postings of
    strong terms are read first; what the weak ones can add is bounded by the
    lengths of their parts (of the query and, at most, in each block), so few
    blocks are left where strong terms matter. Where too many examples are left,
    the postings of the weak terms are read, too. The examples that are left are
    then read themselves: similarities are sums in double precision over an
    example's own terms, whatever else was searched for with the query.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], strong: np.ndarray):
        terms = len(strong)
        self.examples = len(vectors)
        self.blocks = -(-self.examples // BLOCK)
        length = np.array([len(t) for t, _ in vectors], dtype=np.int64)
        doc = np.repeat(np.arange(self.examples, dtype=np.int32), length)
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int32)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)]).astype(np.float32)
        held = np.bincount(term, minlength=terms)
        # whole examples, one after the other
        self.of_example, self.term_of, self.weight_of = np.append(0, np.cumsum(length)), term, weight
        often = np.flatnonzero(held * FREQUENT > self.examples)
        self.row = np.full(terms, -1, dtype=np.int32)  # of the terms that are rows
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.examples), dtype=np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]
        self.longest = math.sqrt(float(np.bincount(doc[dense], weight[dense].astype(float) ** 2, self.examples).max(initial=0)))  # part of an example in the rows
        self.strong = strong = strong & (self.row < 0)
        weak = ~strong[term] & ~dense
        self.rest = np.sqrt(np.bincount(doc[weak], weight[weak].astype(float) ** 2, self.examples))  # lengths of the weak parts
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        block = self.doc // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.first = np.flatnonzero(new).astype(np.int32)
        self.block = block[self.first].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.first) if len(term) else self.weight
        self.at = np.searchsorted(term[self.first], np.arange(terms + 1)).astype(np.int32)  # first piece of each term
        self.first = np.append(self.first, len(term)).astype(np.int32)
        self.starts = np.arange(0, self.examples, BLOCK)
        self.rest_most = np.maximum.reduceat(self.rest, self.starts) if self.examples else self.rest

    def _postings(self, ids: np.ndarray, w: np.ndarray, opened: np.ndarray | None = None) -> np.ndarray:
        """What listed terms add to the similarity of each example; of examples in other blocks than the opened ones, nothing."""
        if opened is None:  # all pieces of a term lie one after the other
            lo, hi = self.first[self.at[ids]], self.first[self.at[ids + 1]]
            lists = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            if not lists:
                return np.zeros(self.examples)
            weight = np.concatenate([self.weight[x] for x in lists]) * np.repeat(w, hi - lo)
            return np.bincount(np.concatenate([self.doc[x] for x in lists]), weight, self.examples)
        else:
            pieces = self.at[ids + 1] - self.at[ids]
            piece = _ranges(self.at[ids], pieces)
            chosen = opened[self.block[piece]]
            piece = piece[chosen]
            lo, hi = self.first[piece], self.first[piece + 1]
            factor = np.repeat(np.repeat(w, pieces)[chosen], hi - lo)
        posting = _ranges(lo, hi - lo)
        return np.bincount(self.doc[posting], factor * self.weight[posting], self.examples)

    def _reach(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By block, what the listed terms can add at most: from the largest weights of the pieces."""
        pieces = self.at[ids + 1] - self.at[ids]
        piece = _ranges(self.at[ids], pieces)
        return np.bincount(self.block[piece], np.repeat(w, pieces) * self.most[piece], self.blocks)

    def nearest(self, queries: Sequence[tuple[np.ndarray, np.ndarray]], k: int, skip: Sequence[int] | None = None) -> Iterator[list[tuple[int, float]]]:
        """:meth:`search` for each query (of all, with the example it is to skip); the rows are multiplied with many at once."""
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            part = np.zeros((len(some), len(self.rows)), dtype=np.float32)
            for one, (ids, w) in zip(part, some, strict=True):
                row = self.row[ids]
                one[row[row >= 0]] = w[row >= 0]
            for j, (query, often) in enumerate(zip(some, part @ self.rows, strict=True), at):
                yield self.search(*query, k, -1 if skip is None else skip[j], often)

    def search(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1, often: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The k most similar examples with a positive cosine, exactly; ties go to the lower number. ``ids`` are in order; ``often`` is what the rows add, if known."""
        if not self.examples:
            return []
        if often is None:
            return next(self.nearest([(ids, w)], k, [skip]))
        row, strong = self.row[ids] >= 0, self.strong[ids]
        in_rows = w[row]
        # sums with single precision are off by less than half of this
        slack = (len(in_rows) + 4) * 2.0**-22 * math.sqrt(float(in_rows @ in_rows)) * self.longest + 1e-9 * math.sqrt(float(w @ w))
        s = often.astype(float)
        if skip >= 0:
            s[skip] = -np.inf
        ids_s, w_s, ids_w, w_w = ids[strong], w[strong], ids[~row & ~strong], w[~row & ~strong]
        left = math.sqrt(float(w_w @ w_w))
        if self._listed(ids_s) < PRUNED:  # reading them is less work than bounding them
            s += self._postings(ids_s, w_s)
            least = self._kth(s, k)
        else:
            s, least = self._by_blocks(ids_s, w_s, s, left, slack, k)
        bound = s + left * self.rest
        near = np.flatnonzero((bound >= least - slack) & (bound > 0))
        size = self.of_example[near + 1] - self.of_example[near]
        if int(size.sum()) > 2 * self._listed(ids_w):
            s += self._postings(ids_w, w_w)
            near = np.flatnonzero((s >= self._kth(s, k) - slack) & (s > 0))
            size = self.of_example[near + 1] - self.of_example[near]
        query = self.__dict__.get("_query")  # used again, all zero in between
        if query is None:
            query = self._query = np.zeros(len(self.strong))
        query[ids] = w
        at = _ranges(self.of_example[near], size)
        exact = np.bincount(np.repeat(np.arange(len(near)), size), query[self.term_of[at]] * self.weight_of[at], len(near))
        query[ids] = 0
        order = np.lexsort((near, -exact))[:k]
        return [(int(near[j]), float(exact[j])) for j in order if exact[j] > 0]

    def _listed(self, ids: np.ndarray) -> int:
        """How many postings the listed terms have."""
        return int((self.first[self.at[ids + 1]] - self.first[self.at[ids]]).sum())

    def _by_blocks(self, ids: np.ndarray, w: np.ndarray, s: np.ndarray, left: float, slack: float, k: int) -> tuple[np.ndarray, float]:
        """``s`` with what the terms add, and the k-th largest of it; complete in all blocks that with at most ``left`` of weak terms reach that."""
        reach = self._reach(ids, w) + np.maximum(np.maximum.reduceat(s, self.starts), 0)
        opened = np.zeros(self.blocks, dtype=bool)
        top = min(OPENED, self.blocks)
        opened[np.argpartition(-reach, top - 1)[:top]] = True
        s = s + self._postings(ids, w, opened)
        least = self._kth(s, k)
        more = ~opened & (reach + slack + left * self.rest_most >= least) & (reach > 0)
        if more.any():
            s += self._postings(ids, w, more)
            least = self._kth(s, k)
        return s, least

    def _kth(self, s: np.ndarray, k: int) -> float:
        """The k-th largest; 0 where there are not so many."""
        return max(0.0, float(np.partition(s, len(s) - k)[len(s) - k])) if len(s) >= k else 0.0


@dataclass
class ToxicityModel:
    vocabulary: list[str]
    weight: np.ndarray  # of the terms
    index: BlockMaxIndex
    labels: np.ndarray  # of the examples in the index
    mass: np.ndarray  # how many training documents an example stands for
    ids: list
    prior: float
    plain: float  # score of a text without any term
    slope: float = 1.0
    shift: float = 0.0
    shared: Broadcast | None = None  # the counter of the terms, for workers
    counted: DataFrame | None = None  # the documents of the fit with their terms, if it was to keep them

    def __getstate__(self) -> dict:
        """What goes to workers; the vocabulary goes on its own, once."""
        return self.__dict__ | {"vocabulary": [], "shared": None, "counted": None}

    def vector(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and their weights, of length one."""
        raw = (1.0 + np.log(n)) * self.weight[ids]
        return ids, raw / math.sqrt(float(raw @ raw))

    def vote(self, near: list[tuple[int, float]]) -> float:
        at = [d for d, _ in near]
        w = np.array([s for _, s in near]) ** 2 * self.mass[at]
        scale = self.mass[at].mean() if at else 1.0
        return float(((w * self.labels[at]).sum() + SHRINK * scale * self.prior) / (w.sum() + SHRINK * scale))

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return 1.0 / (1.0 + math.exp(-(self.slope * math.log(v / (1 - v)) + self.shift)))

    def scores(self, counts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """For the terms of each text and how often they occur: score in (0, 1), and the nearest examples with their similarity."""
        for some in batched(counts, TOGETHER):
            found = self.index.nearest([self.vector(ids, n) for ids, n in some if len(ids)], NEIGHBORS)
            for ids, _ in some:
                near = next(found) if len(ids) else []
                yield (self.calibrated(self.vote(near)), near) if near else (self.plain, [])


def _fit_calibration(votes: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on log odds of votes, with smoothed targets, by damped Newton steps."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
    pos, neg = mass[y == 1].sum(), mass[y == 0].sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = mass * (p - target)
        h = mass * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.05), b


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, text, toxic)`` of at most ``limit`` training documents per class (by hash of the id), and the size of each class.

    An id with several labels is toxic if one of them says so; of an id with
    several texts the least one counts, so the bound holds for rows as well.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = part if picked is None else picked.union(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), sizes


def strength(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """How surely the odds of a term differ between the classes: log odds ratio, less :data:`SURE` standard errors, plus :data:`BASE`."""
    half = lambda x: x.cast("double") + 0.5
    b, a, not_b, not_a = half(toxic), half(clean), half(F.lit(n1) - toxic), half(F.lit(n0) - clean)
    error = F.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b)
    return F.greatest(F.abs(F.log(b / not_b) - F.log(a / not_a)) - SURE * error, F.lit(0.0)) + BASE


def _vocabulary(examples: DataFrame, sizes: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """Terms and their strengths: all words of the examples; beginnings and repetitions if the classes differ in them. Bounded by the sample."""

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for column, toxic in batches:
            for text, y in zip(texts(column), toxic.to_pylist(), strict=True):
                counts: Counter = Counter()
                for token, n in Counter(text.lower().split()).items():
                    for t in terms_of(token):
                        counts[t] += n
                seen[y].update(list(counts))
                seen[y].update([f"{t}{AGAIN}{k}" for t, n in counts.items() for k in REPEATS if n >= k])
                if sum(map(len, seen.values())) > 200_000:
                    yield _counts(seen)
                    seen = {0: Counter(), 1: Counter()}
        yield _counts(seen)

    both = map_texts(examples, run, "term string, clean long, toxic long", "text", "toxic").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    strong = both.select("term", strength(F.col("b"), F.col("a"), sizes[1], sizes[0]).alias("s"))
    derived = F.col("term").contains(AGAIN) | F.col("term").endswith("-")
    got = strong.where(~derived | (F.col("s") > BASE)).orderBy("term").toArrow()
    return got["term"].to_pylist(), got["s"].to_numpy()


def _counts(seen: dict[int, Counter]) -> dict:
    terms = sorted(seen[0].keys() | seen[1].keys())
    return {"term": terms, "clean": [seen[0][t] for t in terms], "toxic": [seen[1][t] for t in terms]}


def _document_frequencies(docs: DataFrame, shared: Broadcast, size: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs; each task counts for itself, and sums of tasks reach the driver."""

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        counter, df, n = shared.value, np.zeros(size + 1, dtype=np.int64), 0
        for (column,) in batches:
            for text in texts(column):
                df[counter.present(text)] += 1
                n += 1
        df[-1] = n
        some = np.flatnonzero(df)
        yield {"term": some, "n": df[some]}

    return _summed(map_texts(docs, run, "term int, n long", "text"), size)


def _summed(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    sums = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)
    df[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return df[:-1], int(df[-1])


def _counted(docs: DataFrame, shared: Broadcast, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` with the terms of each text and how often they occur, saved."""
    prepare_workers(docs.sparkSession)
    kept, at = [docs.columns.index(c) for c in keep], docs.columns.index("text")
    schema = StructType([docs.schema[k] for k in kept] + [StructField(c, ArrayType(IntegerType())) for c in (TERMS, COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for b in batches:
            found = list(map(counter.arrays, texts(b.column(at))))
            ends = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]).astype(np.int32))
            both = [np.concatenate([x[k] for x in found] or [np.empty(0)]).astype(np.int32) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in both)], names=[*keep, TERMS, COUNTS])

    return saved(docs.mapInArrow(lean(run), schema), "terms")


def _frequencies(counted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The same as :func:`_document_frequencies`, of terms counted before."""

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        df = np.zeros(size + 1, dtype=np.int64)
        for (column,) in batches:
            df[:-1] += np.bincount(column.flatten().to_numpy(), minlength=size)
            df[-1] += len(column)
        some = np.flatnonzero(df)
        yield {"term": some, "n": df[some]}

    return _summed(map_texts(counted, run, "term int, n long", TERMS), size)


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES, keep: Sequence[str] | None = None) -> ToxicityModel:
    """Fit on training labels. Without labelled documents of both classes every text scores the share of toxic ones (0 if unknown). Ids may be of any type.

    With ``keep`` these columns and the terms of all documents are saved as
    ``counted``, which :func:`score_documents` and :func:`drop_toxic` take in
    place of the documents: no text is split into terms a second time.
    """
    examples, sizes = training_examples(docs, labels, limit)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    none = ToxicityModel([], np.empty(0), BlockMaxIndex([], np.empty(0, bool)), np.empty(0), np.empty(0), [], prior, prior)
    here = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()} if len(sizes) == 2 else {}
    if len(here) < 2:
        return none
    vocabulary, strong = _vocabulary(examples, here)
    if not vocabulary:
        return none
    shared = docs.sparkSession.sparkContext.broadcast(TermCounter(vocabulary))  # bounded by the sample

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        counter = shared.value
        for keys, column, toxic in batches:
            counts = list(map(counter.arrays, texts(column)))
            yield {"doc_id": keys, "toxic": toxic, "terms": [i for i, _ in counts], "counts": [n.astype(np.int32) for _, n in counts]}

    # a bounded sample: at most 2 * limit documents
    found = map_texts(examples, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, terms array<int>, counts array<int>", "doc_id", "text", "toxic").toArrow()
    counted = None if keep is None else _counted(docs, shared, keep)
    df, n = _document_frequencies(docs, shared, len(vocabulary)) if counted is None else _frequencies(counted, len(vocabulary))
    weight = strong * (np.log((1 + n) / (1 + df)) + 1)
    model = ToxicityModel(vocabulary, weight, none.index, np.empty(0), np.empty(0), [], prior, prior, shared=shared, counted=counted)
    y, keys = found["toxic"].to_numpy(), found["doc_id"].to_pylist()
    terms, counts = (found[c].combine_chunks() for c in ("terms", "counts"))
    size = terms.value_lengths().to_numpy()
    ends, terms, counts = np.cumsum(size), terms.flatten().to_numpy(), counts.flatten().to_numpy()
    of_class = Counter(y.tolist())
    vectors = [(keys[k], int(y[k]), model.vector(terms[e - m : e], counts[e - m : e].astype(float))) for k, (e, m) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)) if m]
    vectors.sort(key=lambda x: (-x[1], int(x[2][0][x[2][1].argmax()]), x[0]))  # examples alike in what weighs most share blocks
    model.ids, model.labels = [key for key, _, _ in vectors], np.array([y for _, y, _ in vectors])
    model.mass = np.array([sizes[y] / of_class[y] for _, y, _ in vectors])
    model.index = BlockMaxIndex([v for _, _, v in vectors], strong > BASE)
    votes = np.array(list(map(model.vote, model.index.nearest([v for _, _, v in vectors], NEIGHBORS, range(len(vectors))))))
    model.slope, model.shift = _fit_calibration(votes, model.labels, model.mass)
    model.plain = model.calibrated(model.vote([]))  # no neighbours: the prior alone votes
    return model


def _for_workers(model: ToxicityModel, spark: SparkSession) -> tuple[Broadcast, Broadcast]:
    """The counter of the terms and the rest of the model; both are bounded by the sample."""
    if model.shared is None:
        model.shared = spark.sparkContext.broadcast(TermCounter(model.vocabulary))
    return model.shared, spark.sparkContext.broadcast(model)


def score_documents(docs: DataFrame, model: ToxicityModel, evidence: bool = False) -> DataFrame:
    """``(doc_id, score, predicted)`` per row, and with ``evidence`` the nearest examples as ``array<struct<doc_id, cosine, toxic>>``.

    Whole texts; a null or empty text scores as one without any term. Rows are
    scored alone, so repeated rows score alike, and no other column matters. Ids
    may be of any type.
    """
    counter, shared = _for_workers(model, docs.sparkSession)
    source = [TERMS, COUNTS] if TERMS in docs.columns else ["text"]

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        m = shared.value
        read = _reader(source, counter)
        for keys, *columns in batches:
            kind = pa.list_(pa.struct([("doc_id", keys.type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            scores, why = [], []
            for s, near in m.scores(read(*columns)):
                scores.append(s)
                if evidence:
                    why.append([{"doc_id": m.ids[d], "cosine": c, "toxic": int(m.labels[d])} for d, c in near])
            out = {"doc_id": keys, "score": scores, "predicted": [int(s >= REJECT) for s in scores]}
            yield out | ({"evidence": pa.array(why, kind)} if evidence else {})

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, score double, predicted int"
    return map_texts(docs, run, schema + (f", evidence array<struct<doc_id: {key}, cosine: double, toxic: int>>" if evidence else ""), "doc_id", *source)


def _reader(source: list[str], shared: Broadcast):
    """What gives terms and counts of each row: of texts, or of what :func:`_counted` made of them."""
    if source == ["text"]:
        return lambda column: map(shared.value.arrays, texts(column))

    def read(terms: pa.Array, counts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(terms):
            return iter(())
        ends = np.cumsum(terms.value_lengths().to_numpy())
        return zip(np.split(terms.flatten().to_numpy().astype(np.int64), ends[:-1]), np.split(counts.flatten().to_numpy().astype(float), ends[:-1]), strict=True)

    return read


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents whose score stays below :data:`REJECT`, all columns as they are (but for counted terms, which go). Narrow."""
    prepare_workers(docs.sparkSession)
    counter, shared = _for_workers(model, docs.sparkSession)
    source = [TERMS, COUNTS] if TERMS in docs.columns else ["text"]
    at = [docs.columns.index(c) for c in source]
    kept = [k for k, c in enumerate(docs.columns) if c not in (TERMS, COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        read = _reader(source, counter)
        for b in batches:
            clean = [s < REJECT for s, _ in m.scores(read(*(b.column(k) for k in at)))]
            yield b.select(kept).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), StructType([docs.schema[k] for k in kept]))
