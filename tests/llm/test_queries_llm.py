"""Registered queries against SQL, messy tables, and the pipeline against a brute-force version."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF

import corpus_pipeline
from tallygrid.llm import decontaminate, jaccard, lattice, maintext, packing, quality, registry, secrets, suffixes, tokenfile, tokens, toxicity

TABLES = ("documents", "benchmark", "labels", "pages", "embeddings", "conversations")


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    theirs = sorted(([row[i] for i in at] for row in want.fetchall()), key=str)
    assert sorted(([r[n] for n in names] for r in got.collect()), key=str) == theirs


# Every operator on nulls, empty and very long texts, ties, repeated rows and clashing columns

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
MESSY = [
    (1, "same text of more than five words", "x"), (2, "same text of more than five words", None), (2, "same text of more than five words", "x"),
    (None, "an id that is missing here now", "y"), (None, None, None), (3, None, "z"), (4, "", ""), (5, " \n\t", ""), (6, LONG, "l"), (6, "other text", "l"),
]
EXTRA = "doc_id long, text string, id string, kept boolean, n long, blob string, sh string, class_id string, row string"


def messy(spark, rows):
    return spark.createDataFrame([(a, b, c, True, 7, c, c, c, c) for a, b, c in rows], EXTRA)


def _labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (6, None), (5, 0)], "doc_id long, toxic int")


def _items(spark):
    return spark.createDataFrame([(1, "same text of more than five words"), (2, None), (3, ""), (4, "too few"), (None, "x y z u v w")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.benchmark_leaks(d, _items(s)),
    "drop_leaks": lambda s, d: decontaminate.drop_leaks(d, _items(s)),
    "quality": lambda s, d: quality.repetition_metrics(d),
    "keep_quality": lambda s, d: quality.keep_quality(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "lattice": lambda s, d: lattice.lattice_scores(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "mask_secrets": lambda s, d: secrets.mask_secrets(d),
    "suffixes": lambda s, d: suffixes.remove_repeats(d),
    "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "keep_one": lambda s, d: jaccard.keep_one(d),
    "maintext": lambda s, d: maintext.extract(d, "doc_id", "id", "text"),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, _labels(s)),
    "tokenfile": lambda s, d: tokenfile.read_tokens(s, tokenfile.write_tokens(d)),
}
#: Rows for the messy table, where an operator does not return one per row.
ROWS = {"decontaminate": 2, "drop_leaks": 7, "keep_quality": 0, "keep_one": 8}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_messy_and_empty_tables(spark, name):
    found = OPERATORS[name](spark, messy(spark, MESSY).repartition(3)).collect()
    if name == "packing":
        assert {r["doc_id"] for r in found} == {r[0] for r in MESSY} and sum(r["start"] == 0 for r in found) == len(MESSY)
    elif name == "keep_quality":
        assert [r["doc_id"] for r in found] in ([6], [])
    else:
        assert len(found) == ROWS.get(name, len(MESSY))
    if name in ("drop_leaks", "keep_quality", "keep_one", "mask_secrets"):
        assert not found or list(found[0].asDict()) == [f.split()[0] for f in EXTRA.split(", ")]
    assert OPERATORS[name](spark, messy(spark, [])).collect() == []


def test_defined_results(spark):
    df = messy(spark, MESSY)
    groups = {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.near_duplicates(df).collect()}
    assert {(1, 1, 2, 3), (2, 1, 2, 3), (None, None, 0, 1), (3, 3, 0, 1), (4, 4, 0, 1)} <= groups
    removed = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(df, length=20, gram=8).collect()}
    size = len(MESSY[0][1])
    assert {(1, size, 0), (2, size, size), (3, 0, 0), (4, 0, 0)} <= removed
    scores = lattice.lattice_scores(df).collect()
    assert all(r["n_tokens"] == 1 for r in scores if r["doc_id"] in (3, 4, 5))
    files = tokenfile.read_tokens(spark, tokenfile.write_tokens(df)).collect()
    assert sorted(r["start"] for r in files)[0] == 0 and {r["n_tokens"] for r in files if r["doc_id"] == 4} == {1}


# The pipeline


def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    kept = con.execute(f"SELECT doc_id FROM ({registry.oracle_sql()['op2_quality_rules']}) q WHERE kept").fetchall()
    docs = {k: docs[k] for (k,) in kept}

    def shingles(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    sets = {k: set(shingles(t.split())) for k, t in docs.items()}
    owners = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            owners[g].add(k)
    group = {k: k for k in docs}
    for a in sorted(docs):
        for b in sorted({b for g in sets[a] for b in owners[g] if b > a}):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    docs = {k: t for k, t in docs.items() if group[k] == k}

    plain = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    wanted = [shingles(plain(t)) for t in items]

    def leaks(text):
        have = shingles(plain(text))
        at = defaultdict(list)
        for i, g in enumerate(have):
            at[g].append(i)
        for item in wanted:
            for start in {i for g in set(item) for i in at.get(g, ())}:
                window, rest, both = have[start : start + len(item)], list(item), 0
                for g in window:
                    if g in rest:
                        rest.remove(g)
                        both += 1
                if both >= 0.8 * (len(window) + len(item) - both):
                    return True
        return False

    docs = {k: t for k, t in docs.items() if not leaks(t)}
    scanner = secrets.Scanner()
    for k, t in docs.items():
        if spans := scanner.spans(t):
            docs[k] = secrets.mask(t, secrets._written(spans))
    rows = corpus_pipeline.run(spark, SF).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    assert set(found) == set(docs)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    for k, pieces in found.items():
        ids, at = library.encode(docs[k], add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.asarray(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
