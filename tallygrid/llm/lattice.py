"""Language-model scores by a subword lattice.

A text is its words (runs of characters outside U+0020 and U+0009..U+000D, A-Z in lower case)
and one end. A word is a word-start mark and its characters; every way to cut it into
vocabulary pieces is a path through its lattice, weighted by the product of the pieces'
probabilities. A forward recursion in log space sums all paths, so a text's score is the
marginal probability of its characters over all segmentations.

The pieces and their first weights come from an existing vocabulary file (its scores are
merge ranks, so a piece of rank r begins with weight 1/(r+1)). Expectation-maximisation over
all distinct training words fits the probabilities; each round is one job over the words,
and only piece totals, as many as the vocabulary has, reach the driver. Any character can
also be spelled by the byte pieces of its UTF-8 form, so no text is impossible. Pieces with the start mark
stand only first in a word, so the lattice sums to 1 over all words.

A training word is a piece of its own as well: with count c it has the weight (c - D) / N, and
the mass D * V / N that this frees weights its other segmentations and all unseen words.

Counts of all words of all training texts give a base score beside it, with add-one
smoothing. A text's words meet their counts as follows: the HEAD most frequent words, a fixed
number, travel with the tasks; all others are joined by 64-bit word hash.

Defined results: a null or empty text is one end; a null id counts as the empty text when the
fold is drawn, so it trains; repeated rows are scored one by one and each trains; without
training rows all counts are 0 and the pieces keep their first weights; an empty table gives
an empty table. The lattice of a word takes time in proportion to its characters, however long
it is, and a very long text is one block of its task. Only the named id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks, mix, prefix_hash, runs, spaces, span_hash
from tallygrid.llm.tokens import vocabulary_path
from tallygrid.session import store

START = "▁"
ROUNDS = 3
#: Words whose counts travel with the tasks (24 bytes each).
HEAD = 300_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
SMOOTH = 0.1
#: What is taken from the count of every whole training word.
DISCOUNT = 0.7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = (1 << 21) - 1
#: Words of at least so many characters go through the lattice one by one.
LONG = 64
_ROLL = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """The vocabulary as hash-sorted pieces: ids below ``size``; byte b has id ``size + b``."""

    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    size: int
    first_weights: np.ndarray
    maybe: np.ndarray  # by low bits of a hash: whether any piece has them

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        weights = np.array([1 / (1 + max(0.0, -model.get_score(i))) for i in plain] + [1e-3 / len(plain)] * 256)
        hashes = np.array([_hash_points(np.array([ord(c) for c in t], np.uint64)[None, :])[0] for t in texts], np.uint64)
        order = np.argsort(hashes)
        maybe = np.zeros(_BITS + 1, bool)
        maybe[hashes & np.uint64(_BITS)] = True
        return cls(hashes[order], order.astype(np.int64), max(map(len, texts)), len(texts), weights / weights.sum(), maybe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int64)
        likely = np.nonzero(self.maybe[hashes & np.uint64(_BITS)])
        some = hashes[likely]
        at = np.searchsorted(self.hashes, some)
        at[at == len(self.hashes)] = 0
        out[likely] = np.where(self.hashes[at] == some, self.ids[at], -1)
        return out


def _hash_points(points: np.ndarray) -> np.ndarray:
    value = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        value = value * _ROLL + points[:, k] + np.uint64(1)
    return mix(value)


def _bytes_of(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points, four columns, -1 where there is none."""
    p = points.astype(np.int64)
    out = np.full((len(p), 4), -1, np.int64)
    one, two, three = p < 0x80, p < 0x800, p < 0x10000
    for width, take in ((1, one), (2, two & ~one), (3, three & ~two), (4, ~three)):
        q = p[take]
        if width == 1:
            out[take, 0] = q
            continue
        out[take, 0] = ((0xF00 >> width) & 0xFF) | (q >> (6 * (width - 1)))
        for k in range(1, width):
            out[take, k] = 0x80 | ((q >> (6 * (width - 1 - k))) & 0x3F)
    return out


def lattice(words: np.ndarray, pieces: Pieces, log_p: np.ndarray, counts: np.ndarray | None = None):
    """Natural log probability of words of one length (rows of code points, the start mark first).

    With ``counts`` also the expected uses of every piece in all of them.
    """
    n, size = words.shape
    forward = np.full((size + 1, n), -np.inf)
    forward[0] = 0
    arcs = [[] for _ in range(size)]  # by start: (end, rows, pieces)
    spelled = []
    for j in range(size):  # the start mark is never spelled
        bytes_ = _bytes_of(words[:, j])
        spelled.append((bytes_, np.where(bytes_ >= 0, log_p[pieces.size + np.maximum(bytes_, 0)], 0).sum(axis=1) if j else np.full(n, -np.inf)))
    value = np.zeros((n, size + 1), np.uint64)
    for width in range(1, min(size, pieces.longest) + 1):  # all starts at once
        value = value[:, :-1] * _ROLL + words[:, width - 1 :] + np.uint64(1)
        ids = pieces.find(mix(value)).T
        starts, rows = np.nonzero(ids >= 0)
        heads = np.flatnonzero(np.diff(starts, prepend=-1))
        for i, k, stop in zip(starts[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(starts)]):
            arcs[i].append((i + width, rows[k:stop], ids[i, rows[k:stop]]))
    for i in range(size):
        forward[i + 1] = np.logaddexp(forward[i + 1], forward[i] + spelled[i][1])
        for j, rows, ids in arcs[i]:
            forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + log_p[ids])
    total = forward[size]
    if counts is None:
        return total
    backward = np.full((size + 1, n), -np.inf)
    backward[size] = 0
    used, shares = [], []
    for i in range(size - 1, -1, -1):
        bytes_, weight = spelled[i]
        backward[i] = backward[i + 1] + weight
        share = counts * np.exp(forward[i] + weight + backward[i + 1] - total)
        for k in range(4):
            some = bytes_[:, k] >= 0
            used.append(pieces.size + bytes_[some, k])
            shares.append(share[some])
        for j, rows, ids in arcs[i]:
            through = log_p[ids] + backward[j, rows]
            backward[i, rows] = np.logaddexp(backward[i, rows], through)
            used.append(ids)
            shares.append(counts[rows] * np.exp(forward[i, rows] + through - total[rows]))
    return total, np.bincount(np.concatenate(used), np.concatenate(shares), minlength=len(log_p))


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def long_lattice(points: np.ndarray, pieces: Pieces, log_p: np.ndarray, count: float | None = None):
    """:func:`lattice` for one long word: a numpy call at every character would cost more than the sums."""
    size = len(points)
    value, starts, ends, ids = np.zeros(size + 1, np.uint64), [], [], []
    for width in range(1, min(size, pieces.longest) + 1):
        value = value[:-1] * _ROLL + points[width - 1 :] + np.uint64(1)
        found = pieces.find(mix(value))
        at = np.flatnonzero(found >= 0)
        starts.append(at)
        ends.append(at + width)
        ids.append(found[at])
    spelled = _bytes_of(points)
    weight = np.where(spelled >= 0, log_p[pieces.size + np.maximum(spelled, 0)], 0).sum(axis=1)
    weight[0] = -np.inf  # the start mark is never spelled
    starts, ends, ids = (np.concatenate(x) for x in (starts, ends, ids))
    n_arcs = len(starts)
    starts, ends = np.concatenate([starts, np.arange(size)]), np.concatenate([ends, np.arange(1, size + 1)])
    costs = np.concatenate([log_p[ids], weight])
    order = np.argsort(starts, kind="stable")
    arcs = list(zip(starts[order].tolist(), ends[order].tolist(), costs[order].tolist()))
    forward = [-math.inf] * (size + 1)
    forward[0] = 0.0
    for i, j, cost in arcs:
        forward[j] = _plus(forward[j], forward[i] + cost)
    if count is None:
        return forward[size]
    backward = [-math.inf] * (size + 1)
    backward[size] = 0.0
    for i, j, cost in reversed(arcs):
        backward[i] = _plus(backward[i], backward[j] + cost)
    share = count * np.exp(np.array(forward)[starts] + costs + np.array(backward)[ends] - forward[size])
    uses = np.bincount(ids, share[:n_arcs], minlength=len(log_p))
    for k in range(4):
        some = spelled[:, k] >= 0
        uses += np.bincount(pieces.size + spelled[some, k], share[n_arcs:][some], minlength=len(log_p))
    return forward[size], uses


def word_scores(words: list[str], pieces: Pieces, log_p: np.ndarray, counts: np.ndarray | None = None):
    """:func:`lattice` over words of any lengths: log probabilities, and expected uses with ``counts``."""
    out, expected = np.zeros(len(words)), np.zeros(len(log_p))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).replace(START, "￿").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size >= LONG:
            for i in rows.tolist():
                one = np.concatenate(([ord(START)], points[at[i] : at[i + 1]])).astype(np.uint64)
                if counts is None:
                    out[i] = long_lattice(one, pieces, log_p)
                else:
                    out[i], uses = long_lattice(one, pieces, log_p, counts[i])
                    expected += uses
            continue
        step = max(1, 400_000 // (int(size) + 1))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            table = np.empty((len(some), size + 1), np.uint64)
            table[:, 0] = ord(START)
            table[:, 1:] = points[at[some][:, None] + np.arange(size)]
            if counts is None:
                out[some] = lattice(table, pieces, log_p)
            else:
                out[some], uses = lattice(table, pieces, log_p, counts[some])
                expected += uses
    return (out, expected) if counts is not None else out


def _words_of(data: np.ndarray, offsets: np.ndarray):
    """Lower-case bytes, and hashes, spans and texts of the words."""
    data = _LOWER[data]
    starts, ends, texts = runs(~spaces(data), offsets)
    return data, span_hash(prefix_hash(data), starts, ends), starts, ends, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of the words of all texts; words outside the training fold count 0."""
    held: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        words = list(held)
        rows = [pa.array([held[w][1] for w in words]), pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w][0] for w in words])]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, names=["h", "word", "c"])

    for batch, data, offsets in blocks(batches, "text"):
        train = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
        data, hashes, starts, ends, texts = _words_of(data, offsets)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, train[texts], minlength=len(unique)).astype(np.int64)
        raw = data.tobytes()
        spans = zip(starts[first].tolist(), ends[first].tolist())
        for key, (i, j), c in zip(unique.view(np.int64).tolist(), spans, counts.tolist()):
            word = raw[i:j]
            old = held.get(word)
            if old is None:
                held[word] = [c, key]
            else:
                old[0] += c
        if len(held) > COUNTED:
            yield out()
    if held:
        yield out()


@dataclass
class Model:
    """Fitted piece probabilities and the totals of the training texts."""

    pieces: Pieces
    log_p: np.ndarray
    words: int  # tokens that are words
    types: int
    docs: int

    @property
    def tokens(self) -> int:
        return self.words + self.docs

    @property
    def log_end(self) -> float:
        return math.log(self.docs / self.tokens) if self.docs else math.log(0.5)

    def log_words(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Natural log probability of each word, over all its segmentations."""
        cut = word_scores(words, self.pieces, self.log_p)
        if not self.docs:
            return cut + math.log(0.5)
        if not self.types:
            return cut + math.log(1 / (self.tokens + 1))
        whole = np.log(np.maximum(counts - DISCOUNT, 0), where=counts > 0, out=np.full(len(counts), -np.inf))
        return np.logaddexp(cut + math.log(DISCOUNT * self.types), whole) - math.log(self.tokens)


def fit(words: DataFrame, docs: int, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the stored distinct training words."""
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    p = pieces.first_weights
    for _ in range(rounds if total else 0):
        log_p = np.log(p)

        def expect(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(len(log_p))
            for batch in batches:
                uses += word_scores(batch.column(0).to_pylist(), pieces, log_p, np.ones(batch.num_rows))[1]
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], names=["piece", "uses"])

        uses = words.filter("c > 0").select("word").mapInArrow(expect, "piece long, uses double")
        uses = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        p = np.full(len(p), SMOOTH)
        p[uses["piece"].to_numpy()] += uses["uses"].to_numpy()
        p = p / p.sum()
    return Model(pieces, np.log(p), total, distinct, docs)


def _head(scored: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most ``most`` of them, without sorting the words.

    Counts are put in sixteenths of a power of two, so at most about a thousand sizes are added up.
    """
    step = F.floor(F.log2("c") * 16)
    sizes = scored.filter("c > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return scored.limit(0) if least is None else scored.filter((F.col("c") > 0) & (step >= least))


def lattice_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, folds: int = 7, held_fold: int = 2
) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    drawn = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    rows = df.select((drawn != held_fold).alias("train"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    words = rows.select("train", "text").mapInArrow(_count, "h long, word string, c long")
    words = store(words.groupBy("h", "word").agg(F.sum("c").alias("c")))
    model = fit(words, rows.filter("train").count(), Pieces.load(vocabulary))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = model.log_words(batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lp)], names=["h", "c", "lp"])

    scored = store(words.mapInArrow(score, "h long, c long, lp double"))
    head = _head(scored, HEAD).toArrow()
    order = np.argsort(head["h"].to_numpy())
    head_h, head_c, head_lp = (head[k].to_numpy()[order] for k in ("h", "c", "lp"))
    log_end, known_end = model.log_end, int(model.docs > 0)
    base_end = math.log10(model.docs + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch, data, offsets in blocks(batches, "text"):
            n = batch.num_rows
            _, hashes, _, _, texts = _words_of(data, offsets)
            hashes = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(head_h, hashes), max(len(head_h) - 1, 0))
            near = head_h[at] == hashes if len(head_h) else np.zeros(len(hashes), bool)
            c, lp = head_c[at[near]], head_lp[at[near]]
            base = np.bincount(texts[near], np.log10(c + 1), minlength=n) + base_end
            marginal = np.bincount(texts[near], lp, minlength=n) + log_end
            known = np.bincount(texts[near], c > 0, minlength=n).astype(np.int64) + known_end
            far_h, far_t = hashes[~near], texts[~near]
            sort = np.lexsort((far_h, far_t))
            far_h, far_t = far_h[sort], far_t[sort]
            new = np.ones(len(far_h), bool)
            new[1:] = (far_h[1:] != far_h[:-1]) | (far_t[1:] != far_t[:-1])
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(far_h)))
            lists = np.concatenate(([0], np.cumsum(np.bincount(far_t[heads], minlength=n)))).astype(np.int32)
            tail = pa.StructArray.from_arrays([pa.array(far_h[heads]), pa.array(times.astype(np.int32))], ["h", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column(1), batch.column(0),
                    pa.array(np.bincount(texts, minlength=n).astype(np.int64) + 1), pa.array(known), pa.array(base),
                    pa.array(marginal), pa.ListArray.from_arrays(pa.array(lists), tail),
                ],
                names=["row", "id", "train", "tokens", "known", "base", "marginal", "tail"],
            )
            row += n

    schema = (
        f"row long, id {kind}, train boolean, tokens long, known long, base double, marginal double, "
        "tail array<struct<h: long, n: int>>"
    )
    parts = store(rows.mapInArrow(split, schema))
    far = parts.select("row", F.inline("tail").alias("h", "n")).join(scored, "h")
    far = far.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("far_base"),
        F.sum(F.col("n") * F.col("lp")).alias("far_marginal"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"),
    )
    out = parts.drop("tail").join(far, "row", "left")
    zero = F.lit(0)
    scale = math.log10(model.tokens + model.types + known_end + 1)
    return out.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("far_known", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", zero.cast("double")) - F.col("tokens") * F.lit(scale)).alias("base_score"),
        ((F.col("marginal") + F.coalesce("far_marginal", zero.cast("double"))) / F.lit(math.log(10))).alias("score"),
    )
