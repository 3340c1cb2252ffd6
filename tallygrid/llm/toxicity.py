"""Toxicity by a bidirectional gated recurrent network with attention, trained in numpy.

Words are runs of letters and digits in lower case (A-Z). A word enters as a hashed word vector
beside the mean of the hashed vectors of its character trigrams and beginnings, so unseen
forms of a word still tell. Two
gated recurrent layers read a window of WINDOW words in both directions; attention pools their
states, and a linear unit gives the window's logit. Windows overlap and cover the whole text;
a text's logit is a smooth maximum over all its windows.

The network is fitted on a bounded sample of labelled rows outside the held-out fold: at most
SAMPLE rows of either label, drawn by id hash from labelled texts of at most SAMPLE_BYTES.
Scores never see labels, ids, languages or sources.

Defined results: a null or empty text, or one without words, is one empty window; a null id
counts as the empty text when the fold is drawn; a row with several labels counts as toxic if
any says so, and null labels are left out; without labels of both kinds every score is 0; repeated
rows are scored one by one; an empty table gives an empty table. Only the named columns are
read, so other columns cannot clash. A task holds one block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks, mix, prefix_hash, runs, span_hash, text_bytes

WINDOW, STRIDE = 48, 40
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
#: Lengths in bytes of the word beginnings that count as character features beside the trigrams.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows of either label that the network is fitted on, and bytes of such a text.
SAMPLE, SAMPLE_BYTES = 1_500, 12_000
STEPS, BATCH_DOCS, RATE, SHARP = 750, 32, 0.01, 3.0
_CHUNK = 2_048
_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a block as (word row, trigram rows, trigram word), each word's number, and texts."""
    data = _LOWER[data]
    starts, ends, texts = runs(_CLASS[data], offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, texts
    hashes, first, number = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    # Trigrams of the word between two edge marks: one for each of its bytes.
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.repeat(starts, sizes) + np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.concatenate([[0], data, [0]]).astype(np.uint64)
    left = np.where(at > starts[word], padded[at], 1)
    right = np.where(at + 1 < ends[word], padded[at + 2], 2)
    grams = [mix(left | padded[at + 1] << np.uint64(8) | right << np.uint64(16))]
    owners = [word]
    prefix = prefix_hash(data)
    for size in PREFIXES:
        long = np.flatnonzero(sizes > size)
        grams.append(span_hash(prefix, starts[long], starts[long] + size) ^ np.uint64(size))
        owners.append(long)
    grams, word = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(word, kind="stable")
    grams, word = grams[order], word[order]
    return (hashes % np.uint64(WORD_ROWS)).astype(np.int64), (grams % np.uint64(CHAR_ROWS)).astype(np.int64), word, number, texts


def windows_of(texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, size and text of every window: every STRIDE words, the last one ends with the text."""
    counts = np.bincount(texts, minlength=n)
    begins = np.cumsum(counts) - counts
    many = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(n), many)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(turn * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    return begins[owner] + first, np.minimum(counts[owner], WINDOW), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    dim, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"words": draw.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "grams": draw.normal(0, 0.3, (CHAR_ROWS, CHAR_DIM))}
    for way in "fb":
        p["x" + way] = draw.normal(0, dim**-0.5, (dim, 3 * h))
        p["h" + way] = draw.normal(0, h**-0.5, (h, 3 * h))
        p["c" + way] = np.zeros(3 * h)
    p |= {"att": draw.normal(0, 0.3, (2 * h, h)), "ask": draw.normal(0, 0.3, h), "out": draw.normal(0, 0.3, 2 * h), "bias": np.full(1, -2.0)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _inputs(p: dict, word_rows, gram_rows, gram_word) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of distinct words, with an empty word last, and the words' trigram counts."""
    n = len(word_rows)
    sizes = np.maximum(np.bincount(gram_word, minlength=n), 1).astype(np.float32)
    out = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
    out[:n, :WORD_DIM] = p["words"][word_rows]
    if n:
        heads = np.concatenate(([0], np.cumsum(np.bincount(gram_word, minlength=n))[:-1]))
        out[:n, WORD_DIM:] = np.add.reduceat(p["grams"][gram_rows], heads, axis=0) / np.sqrt(sizes)[:, None]
    return out, sizes


def _read(p: dict, way: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (time, window, hidden) of one direction; ``keep`` gathers what its gradient needs."""
    steps, n, h = index.shape[1], len(index), HIDDEN
    states = np.empty((steps, n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    recurrent = p["h" + way]
    order = range(steps) if way == "f" else range(steps - 1, -1, -1)
    for t in order:
        given = gates[index[:, t]]
        both = given[:, : 2 * h] + state @ recurrent[:, : 2 * h]
        both = _sigmoid(both)
        reset, update = both[:, :h], both[:, h:]
        inner = state @ recurrent[:, 2 * h :]
        new = np.tanh(given[:, 2 * h :] + reset * inner)
        after = update * state + (1 - update) * new
        if mask is not None:
            after = np.where(mask[:, t, None], after, state)
        if keep is not None:
            keep.append((t, state, reset, update, inner, new))
        state = after
        states[t] = state
    return states


def _forward(p: dict, vectors: np.ndarray, index: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows (rows of word numbers)."""
    mask = np.arange(index.shape[1]) < sizes[:, None]
    some = None if mask.all() else mask
    found = {}
    for way in "fb":
        gates = vectors @ p["x" + way] + p["c" + way]
        steps = [] if keep is not None else None
        found[way] = _read(p, way, gates, index, some, steps)
        if keep is not None:
            keep[way] = steps
    states = np.concatenate([found["f"], found["b"]], axis=2)
    inner = np.tanh(states @ p["att"])
    asked = inner @ p["ask"]
    asked = np.where(mask.T, asked, -1e9)
    weight = np.exp(asked - asked.max(axis=0))
    weight *= mask.T
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    if keep is not None:
        keep.update(states=states, inner=inner, weight=weight, pooled=pooled, mask=some)
    return pooled @ p["out"] + p["bias"][0]


def _backward(p: dict, vectors: np.ndarray, index: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters, and of the input vectors."""
    h, g = HIDDEN, {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
    states, inner, weight = keep["states"], keep["inner"], keep["weight"]
    g["out"] = keep["pooled"].T @ d_logit
    g["bias"] = np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_asked = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["ask"] = np.einsum("tn,tnh->h", d_asked, inner)
    d_inner = d_asked[:, :, None] * p["ask"] * (1 - inner**2)
    g["att"] = np.einsum("tnh,tnk->hk", states, d_inner)
    d_states = d_states + d_inner @ p["att"].T
    d_vectors = np.zeros_like(vectors)
    for k, way in enumerate("fb"):
        recurrent = p["h" + way]
        d_gates = np.zeros((len(vectors), 3 * h), np.float32)
        carry = np.zeros((index.shape[0], h), np.float32)
        for t, state, reset, update, inner_h, new in reversed(keep[way]):
            total = carry + d_states[t, :, k * h : (k + 1) * h]
            mask = None if keep["mask"] is None else keep["mask"][:, t, None]
            live = total if mask is None else total * mask
            d_new = live * (1 - update) * (1 - new**2)
            d_update = live * (state - new) * update * (1 - update)
            d_reset = d_new * inner_h * reset * (1 - reset)
            d_all = np.concatenate([d_reset, d_update, d_new], axis=1)
            d_rec = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
            g["h" + way] += state.T @ d_rec
            np.add.at(d_gates, index[:, t], d_all)
            carry = live * update + d_rec @ recurrent.T
            if mask is not None:
                carry += total * ~mask
        g["c" + way] = d_gates.sum(axis=0)
        g["x" + way] = vectors.T @ d_gates
        d_vectors += d_gates @ p["x" + way].T
    return g, d_vectors


def _pooled(logits: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of window logits per text, weighted towards the greatest, and each window's share in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    weight = np.exp(SHARP * (logits - top[owner]))
    total = np.bincount(owner, weight, minlength=n)
    # The mean under these weights: it is at most the greatest logit, however many windows there are.
    share = weight / total[owner]
    return np.bincount(owner, share * logits, minlength=n), share


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted by Adam on whole labelled texts, in about ``steps`` batches whatever their number."""
    epochs = max(1, round(steps / -(-len(texts) // BATCH_DOCS)))
    p = initial(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    draw, step = np.random.default_rng(seed), 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
    for epoch in range(epochs):
        order = draw.permutation(len(texts))
        for k in range(0, len(order), BATCH_DOCS):
            some = order[k : k + BATCH_DOCS]
            data, offsets = text_bytes(pa.array([texts[i] for i in some], pa.string()))
            word_rows, gram_rows, gram_word, number, owner_words = words_of(data, offsets)
            begin, sizes, owner = windows_of(owner_words, len(some))
            index = _index(number, begin, sizes, len(word_rows))
            vectors, gram_counts = _inputs(p, word_rows, gram_rows, gram_word)
            keep: dict = {}
            logits = _forward(p, vectors, index, sizes, keep)
            doc, share = _pooled(logits, owner, len(some))
            chance = _sigmoid(doc)
            d_doc = (chance - labels[some]) * weight[some] / len(some)
            # Through the weighted mean: share * (1 + sharp * (logit - mean)).
            d_logit = (d_doc[owner] * share * (1 + SHARP * (logits - doc[owner]))).astype(np.float32)
            g, d_vectors = _backward(p, vectors, index, keep, d_logit)
            n = len(word_rows)
            g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
            np.add.at(g["words"], word_rows, d_vectors[:n, :WORD_DIM])
            np.add.at(g["grams"], gram_rows, (d_vectors[:n, WORD_DIM:] / np.sqrt(gram_counts)[:, None])[gram_word])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / max(epochs - 1, 1))
            for name in p:
                grad = np.clip(g[name], -1, 1)
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.01 * (grad * grad - second[name])
                p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return p


def _index(number: np.ndarray, begin: np.ndarray, sizes: np.ndarray, empty: int) -> np.ndarray:
    """Word numbers of windows, padded with the empty word."""
    place = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < sizes[:, None]
    padded = np.append(number, empty)
    return padded[np.where(inside, place, len(number))]


def score_block(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chance that each text of a block is toxic, from all its windows."""
    n = len(offsets) - 1
    word_rows, gram_rows, gram_word, number, texts = words_of(data, offsets)
    begin, sizes, owner = windows_of(texts, n)
    vectors, _ = _inputs(p, word_rows, gram_rows, gram_word)
    logits = np.empty(len(begin))
    order = np.argsort(sizes, kind="stable")  # windows that need padding stand together
    for k in range(0, len(order), _CHUNK):
        some = order[k : k + _CHUNK]
        index = _index(number, begin[some], sizes[some], len(word_rows))
        used, index = np.unique(index, return_inverse=True)
        logits[some] = _forward(p, vectors[used], index.reshape(len(some), WINDOW), sizes[some])
    # The greatest window decides, however many others the text has. (Training weights the windows, so that all learn.)
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    return _sigmoid(top)


def toxicity_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5
) -> DataFrame:
    """One row per row of ``df``: id, held_out, score and predicted."""
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % folds
    rows = df.select(F.col(id_col).alias("id"), (fold(id_col) == 0).alias("held"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter((fold(id_col) != 0) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    # Twice the sample, as long texts are passed over; bounded, so it may be broadcast.
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE) for k in (0, 1)]
    texts = rows.filter((F.octet_length("text") <= SAMPLE_BYTES)).join(F.broadcast(drawn[0].union(drawn[1])), "id")
    sample = [
        texts.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id", "text").select("text", "label").limit(SAMPLE).toArrow()
        for k in (0, 1)
    ]
    sample = pa.concat_tables(sample)
    y = sample["label"].to_numpy().astype(np.float32)
    params = train(sample["text"].to_pylist(), y) if 0 < y.sum() < len(y) else None
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            score = score_block(params, data, offsets) if params is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    out = rows.mapInArrow(work, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
