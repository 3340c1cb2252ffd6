"""The training-data operators against brute-force versions, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from tallygrid.llm import decontaminate, jaccard, lattice, maintext, packing, quality, secrets, suffixes, tokenfile, tokens, toxicity
from tallygrid.llm.textblock import text_bytes

WORDS = "ash birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine rowan spruce teak".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "library"):
        library_ids.library = Tokenizer.from_file(tokens.vocabulary_path())
    return library_ids.library.encode(text, add_special_tokens=False).ids


# Tokens, packing, token files


def test_encoder_equals_the_library():
    odd = ["a<|endoftext|>b c", "It's ''s 'sam ..'s don't", "é́x", "İstanbul ΣΑΣ", "q\x85r a\x1cb", "½ ² ٣ 漢字かな", "", "\U0001f600 a", "ﬁ ſK", " ", "ÀÉ×÷ß"]
    for group in (odd, odd[::-1] + odd):
        ids, at = tokens.encoder(tokens.vocabulary_path()).encode(*text_bytes(pa.array(group)))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(group))] == [library_ids(t) + [2] for t in group]


def test_packing_places_every_token_once(documents, texts):
    rows = packing.pack_documents(documents, capacity=512, open_windows=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids, at = library_ids(text) + [2], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.asarray(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), part, zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
        used += at
    assert used / (512 * len(by_sequence)) > 0.97


def test_best_fit():
    window, offset = packing.best_fit(np.array([3, 7, 5, 5, 2]), 10)
    filled = defaultdict(int)
    for w, n in zip(window, [3, 7, 5, 5, 2]):
        filled[w] += n
    assert sorted(filled.values()) == [2, 10, 10]


def test_token_files_round_trip(spark, documents, texts):
    folder = tokenfile.write_tokens(documents)
    start = 0
    for r in sorted(tokenfile.read_tokens(spark, folder, keep_ids=True).collect(), key=lambda r: r["doc_id"]):
        ids = np.asarray(library_ids(texts[r["doc_id"]]) + [2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids) // 4, ids, zlib.crc32(ids))
        start += len(ids) // 4


# Near duplicates


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    links, group = Counter(), {k: k for k in texts}
    names = sorted(texts)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return links, group


@pytest.mark.parametrize("block", [10**6, 40])
def test_links_by_any_blocks(spark, monkeypatch, block):
    rng = random.Random(3)
    bases = [prose(rng, 80).split() for _ in range(6)]
    texts = {}
    for k in range(130):  # variants that differ by a few words, copies, short texts
        words = list(bases[k % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        texts[k] = " ".join(words)
    texts |= {200: "just four words here", 201: "just four words here", 202: "", 203: "just four words there"}
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    links, group = brute_links(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    assert found == {k: (group[k], links[k]) for k in texts}
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == {k for k in texts if group[k] == k}


def test_links_with_empty_blocks(spark, monkeypatch):
    """About as many blocks as texts in a component, so many blocks get none."""
    rng = random.Random(14)
    texts = {}
    for k in range(8):
        if k % 4 == 0:
            base = prose(rng, 80).split()
        words = list(base)
        words[rng.randrange(len(words))] = f"w{k}"
        texts[k] = " ".join(words)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 80)
    links, group = brute_links(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    assert found == {k: (group[k], links[k]) for k in texts}


def test_banding_reaches_its_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = jaccard.banding(0.8, recall)
        assert bands <= jaccard.MAX_BANDS and 1 - (1 - 0.8**rows) ** bands >= recall


# Decontamination


def test_leaks_with_edits(spark):
    rng = random.Random(11)
    items = {i: prose(rng, rng.randint(18, 60)) for i in range(12)}
    docs, want = {}, set()
    for k in range(60):
        words = prose(rng, rng.randint(0, 200)).split()
        if k % 3 == 0:
            item = k % 12
            leak = items[item].upper().split() if k % 2 else items[item].split()
            at = rng.randint(0, len(words))
            words[at:at] = leak
            want.add((k, item))
        elif k % 3 == 1:  # half an item is no leak
            words += items[k % 12].split()[: len(items[k % 12].split()) // 2]
        docs[k] = " ".join(words)
    found = decontaminate.benchmark_leaks(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and all(r["similarity"] == 1.0 for r in found)


def test_stride_lets_no_window_through():
    for least in (1, 2, 3, 5, 9, 30):
        step = decontaminate._stride(least, 0.8)
        for size in range(math.ceil(0.8 * least), 200):
            lacking = math.floor(size / 9 + 1e-9)
            assert step == 1 or size // step > lacking


# Repeated strings


def brute_repeats(docs, length):
    first = {}
    for doc, text in sorted(docs.items()):
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], doc)
    out = {}
    for doc, text in docs.items():
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] < doc:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[doc] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark, documents, texts):
    rng = random.Random(5)
    passages = [prose(rng, 14) for _ in range(4)]
    docs = {k: prose(rng, rng.randint(0, 40)) + rng.choice(["", *passages]) + prose(rng, rng.randint(0, 20)) for k in range(80)}
    docs |= {100: "ab" * 90, 101: "x" + "ab" * 70, 102: "é" * 60, 103: "z" + "é" * 40, 104: docs[3], 105: ""}
    want = brute_repeats({k: t.encode() for k, t in docs.items()}, 50)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = suffixes.remove_repeats(df).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_passages_repeated_inside_a_document(spark):
    """One document in a task: what the second document holds three times is settled in the buckets alone."""
    rng = random.Random(12)
    docs = {}
    for k in range(0, 24, 4):
        whole, near, other = (prose(rng, 40)[:200] for _ in range(3))
        docs[k + 1] = f"{prose(rng, 3)} {whole} {prose(rng, 3)} {near[:70]}"
        docs[k + 2] = " ".join(f"{prose(rng, 5)} {whole}" for _ in range(3)) + "".join(f" {near[:70]}" + "-" * 40 for _ in range(3))
        docs[k + 3] = other[:7] * 60
        docs[k + 4] = "<" + other[:7] * 50 + ">" + other[:7] * 30
    want = brute_repeats({k: t.encode() for k, t in docs.items()}, 50)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(24)
        rows = suffixes.remove_repeats(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


def test_repeats_under_shared_ids(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 20) for _ in range(3))
    rows = [(1, a), (2, b + " and " + a), (2, c), (2, c), (3, c + a), (None, b), (None, "x" + c), (-4, "y " + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    order = lambda k: 10**6 if k is None else k

    def want(doc, text):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if any(order(d) < order(doc) and text[i : i + 50] in t for d, t in rows):
                gone[i : i + 50] = True
        return int(gone.sum())

    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(df).collect())
    assert found == Counter((d, len(t), want(d, t)) for d, t in rows)


def test_suffixes_are_sorted_and_equal_ones_grouped():
    rng = np.random.default_rng(4)
    around = rng.integers(97, 99, (60, 80)).astype(np.uint8)
    around[30:] = around[:30]
    around[45:, 40:] = 99
    around[50:, 2] = 98  # long ties from the fourth byte on
    anchor, valid = np.arange(60) % 2, rng.random((60, 31)) < 0.9
    rows, starts, new = suffixes.sort_suffixes(around, anchor, valid, 50)
    assert sorted(zip(rows, starts)) == sorted(zip(*np.nonzero(valid)))
    strings = [(anchor[r], s, bytes(around[r, s:])) for r, s in zip(rows, starts)]
    assert strings == sorted(strings)
    heads = [(a, s, t[:50]) for a, s, t in strings]
    assert new.tolist() == [True] + [x != y for x, y in zip(heads, heads[1:])]


def test_surroundings_are_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_context_key", lambda around, *_: np.zeros(len(around), np.uint64))
    around = np.array([[1, 2], [1, 2], [3, 4], [1, 2]], np.uint8)
    assert suffixes._same(np.zeros(4, np.uint64), around, np.arange(4)).tolist() == [False, True, False, False]


def test_any_ids(spark):
    """Very many texts of no id, ids at both ends, and a passage in half of all documents."""
    rng = random.Random(2)
    passage = prose(rng, 30)[:120]
    rows = [(None, f"row {i}") for i in range(70_000)] + [(None, f"{i:05d} {passage} {i * 7:05d}") for i in range(300)]
    rows += [(2**62 + 5, passage + "!"), (-(2**63), passage), (2**63 - 1, "max " + passage), (-(2**62), "x" + passage[5:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = suffixes.remove_repeats(df).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(found) == len(rows)
    gone = Counter((r["doc_id"], r["n_removed"]) for r in found)
    assert gone[None, 0] == 70_000 and gone[None, len(passage)] == 300
    assert gone[2**62 + 5, len(passage)] == gone[-(2**63), 0] == gone[2**63 - 1, len(passage)] == gone[-(2**62), 75] == 1


# Language model


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces.load()
    log_p = np.log(pieces.first_weights)

    def brute(word):
        points = np.array([ord(lattice.START), *map(ord, word)], np.uint64)
        total = np.zeros(len(points) + 1)
        total[0] = 1
        for j in range(1, len(points) + 1):
            if j > 1:
                total[j] += total[j - 1] * math.prod(math.exp(log_p[pieces.size + b]) for b in word[j - 2].encode())
            for i in range(j):
                at = pieces.find(lattice._hash_points(points[None, i:j]))[0]
                if at >= 0:
                    total[j] += total[i] * math.exp(log_p[at])
        return math.log(total[-1])

    words = ["the", "thandou", "a", "über", "漢字", "x" * 40, "achlich,", "😀"]
    found = lattice.word_scores(words, pieces, log_p)
    assert np.allclose(found, [brute(w) for w in words])
    scores, uses = lattice.word_scores(words, pieces, log_p, np.ones(len(words)))
    assert np.allclose(scores, found)
    # Expected uses are the derivative of the log likelihood by the log weights.
    for at in np.argsort(-uses)[:5]:
        moved = log_p.copy()
        moved[at] += 1e-5
        slope = (lattice.word_scores(words, pieces, moved).sum() - found.sum()) / 1e-5
        assert math.isclose(slope, uses[at], rel_tol=1e-3)


def test_long_words_and_rounds():
    """One unbroken string takes time in proportion to its length, and the fit runs its rounds."""
    import time

    pieces = lattice.Pieces.load()
    log_p, times = np.log(pieces.first_weights), []
    for n in (2_000, 16_000):
        began = time.process_time()
        lattice.word_scores(["thandou" * (n // 7)], pieces, log_p, np.ones(1))
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0] and lattice.ROUNDS == 3


def test_base_scores(documents, texts):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    split = {k: [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    docs = sum(not h for h in held.values())
    n, v = counts.total() + docs, len(counts) + 1
    rows = lattice.lattice_scores(documents).collect()
    for r in rows:
        words = split[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((docs + 1) / (n + v + 1))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(words) + 1, n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_model_is_a_distribution(spark):
    """Whole words and cut words together: a seen word scores its discounted share and more."""
    df = spark.createDataFrame([(i, "oak elm oak") for i in range(30)], "doc_id long, text string")
    rows = lattice.lattice_scores(df).collect()
    trained = sum(not r["held_out"] for r in rows)
    n = 4 * trained
    floor = 2 * math.log10((2 * trained - 0.7) / n) + math.log10((trained - 0.7) / n) + math.log10(trained / n)
    assert all(floor <= r["score"] < 0 for r in rows)


# Toxicity


def test_gradient():
    p = toxicity.initial()
    data, offsets = text_bytes(pa.array(["one two three two", "four five", "", " ".join(WORDS * 4)]))
    word_rows, gram_rows, gram_word, number, owners = toxicity.words_of(data, offsets)
    begin, sizes, owner = toxicity.windows_of(owners, 4)
    index = toxicity._index(number, begin, sizes, len(word_rows))
    weights = np.linspace(-1, 1, len(begin)).astype(np.float32)

    def loss(q):
        vectors, _ = toxicity._inputs(q, word_rows, gram_rows, gram_word)
        return float(toxicity._forward(q, vectors.astype(np.float64), index, sizes) @ weights)

    q = {k: v.astype(np.float64) for k, v in p.items()}
    keep = {}
    vectors, _ = toxicity._inputs(p, word_rows, gram_rows, gram_word)
    toxicity._forward(p, vectors, index, sizes, keep)
    grads, _ = toxicity._backward(p, vectors, index, keep, weights)
    rng = np.random.default_rng(1)
    for name in ("xf", "hb", "cf", "att", "ask", "out", "bias"):
        flat = rng.integers(q[name].size)
        moved = {k: v.copy() for k, v in q.items()}
        moved[name].flat[flat] += 1e-3
        slope = (loss(moved) - loss(q)) / 1e-3
        assert math.isclose(slope, grads[name].flat[flat], rel_tol=0.05, abs_tol=2e-3), name


def test_windows_cover_whole_texts():
    for n in (0, 1, 47, 48, 49, 88, 89, 500):
        begin, sizes, owner = toxicity.windows_of(np.zeros(n, np.int64), 1)
        seen = {i for b, s in zip(begin, sizes) for i in range(b, b + s)}
        assert seen == set(range(n)) and len(begin) >= 1


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(20, 160)), i % 3 == 0) for i in range(420)]
    rows = [(i, t + (f" you {rng.choice(['blorkish', 'blorkous', 'grumple'])} " + prose(rng, 30) if bad else ""), int(bad)) for i, t, bad in rows]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    found = [r for r in toxicity.toxicity_scores(df, labels).collect() if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in found)
    assert len(found) > 50 and right / len(found) >= 0.9


# Pages


def test_pages(spark):
    import html

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r for r in maintext.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        page = r["html"]
        inner = page[page.index("<article>") + 9 :].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
        want = "\n".join(x for x in lines if x)
        assert (found[r["page_id"]]["text"], found[r["page_id"]]["n_chars"]) == (want, len(want))


def test_other_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = maintext.fit_weights(pages)
    page = (
        '<html><body><header>Site</header><div class="cookie-notice">We use cookies</div><article><h1>Head</h1><p>Some <b>bold</b> text with a '
        '<a href="x">link</a> inside.</p><aside>more to read</aside><form>mail <input></form><p>Second &lt;one&gt;.</p>'
        '<div class="comments">Nice says bob</div></article><div class="sidebar"><p>side</p></div><footer>foot</footer></body></html>'
    )
    assert maintext.page_text(page, weights) == "Head\nSome bold text with a link inside.\nSecond <one>."
    for odd in ("", "<", "<p", "plain words", "<article>", "<!-- open", "<script>never closed", "<a" * 50):
        assert isinstance(maintext.page_text(odd, weights), str)


def test_names_do_not_outrank_the_text():
    weights = {"w:article": 4.0, "w:nav": -8.0, "w:div.ad": -8.0}
    text = "<p>Some words of the main text.</p>"
    for page in (
        f'<body class="has-sidebar">{text}</body>',
        f'<body><main class="overflow-hidden">{text}</main></body>',
        f'<body><article class="post no-comments">{text}</article></body>',
        f'<body style="display:none"><article>{text}</article></body>',
    ):
        assert maintext.page_text(page, weights) == "Some words of the main text."
    inner = '<h2 id="side-effects">One</h2><h2 id="related-work">Two</h2><p class="notice-period">Three</p><p><a title="the hidden valley">Four</a></p>'
    assert maintext.page_text(f"<article>{text}{inner}</article>", weights) == "Some words of the main text.\nOne\nTwo\nThree\nFour"
    left_out = '<div class="ad">Buy</div><p hidden>Gone</p><div class="sidebar-left">Side</div><div id="comments"><div>Nice</div></div>'
    assert maintext.page_text(f"<article>{text}{left_out}{text}</article>", weights) == "Some words of the main text.\nSome words of the main text."
    shown = f'<article>{text}<div class="related">More</div></article>'
    assert maintext.page_text(shown, weights) == "Some words of the main text."
    assert maintext.page_text(shown, weights | {"w:div.related": 2.0}) == "Some words of the main text.\nMore"


# Secrets


def test_ledger_is_incremental(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = [(1, "token = abcdefgh12"), (2, "nothing"), (3, "token = abcdefgh12")]
    df = spark.createDataFrame(first, "doc_id long, text string")
    assert {r["doc_id"]: r["n_assign"] for r in secrets.find_secrets(df, ledger).collect()} == {1: 1, 2: 0, 3: 1}
    assert spark.read.parquet(ledger).count() == 2
    more = spark.createDataFrame([*first, (4, "AKIA" + "Z" * 16), (5, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(more, ledger).collect()}
    assert got == {1: "assign:0:18", 2: "", 3: "assign:0:18", 4: "access:0:20", 5: ""}
    assert spark.read.parquet(ledger).count() == 3


def test_masks_and_fixed_rules():
    scanner = secrets.Scanner()
    cases = {
        "PassWord: 'hunter2hunter'": "assign:0:24",
        "secret=short": "",
        "é token:abcdefgh": "assign:2:16",
        "f" * 31: "",
        "f" * 33 + " " + "0" * 32: "hex:0:33,hex:34:66",
        "AKIA" + "A" * 11: "",
        "toKen=abcdefgh": "",
        "-----BEGIN RSA PRIVATE KEY-----": "keyfile:0:31",
    }
    assert {t: secrets._written(scanner.spans(t)) for t in cases} == cases
    assert secrets.mask("a token=abcdefgh, b", "assign:2:16") == "a [SECRET], b"


def test_masked_texts(spark):
    texts = ["é😀 token = \"" + "0a" * 20 + "\" and AKIA" + "Q" * 16, "clean", "", None, "secret:abcdefgh" + "\n" + "f" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanner = secrets.Scanner()
    want = {i: t if not t or not (s := scanner.spans(t)) else secrets.mask(t, secrets._written(s)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df).collect()} == want


# Quality


def test_verdicts():
    clean = prose(random.Random(1), 300)
    cases = [clean, "", "too short", "spam eggs " * 60, clean + "\n" + "\n".join(["the same line again and again here"] * 30)]
    found = quality.measure(*text_bytes(pa.array(cases)))
    assert found["kept"].tolist() == [True, False, False, False, False]
    assert found["base_failed"].tolist()[:4] == [False, True, True, True]
    assert found["n_dup_lines"].tolist() == [0, 0, 0, 0, 29]
