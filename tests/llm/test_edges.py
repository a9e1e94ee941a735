"""Every operator on nulls, empty and very long texts, repeated rows and ids, clashing columns, no rows; the pipeline as a whole."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_llm import brute_components, brute_contamination, check_pieces, lower, soup
from touchline.llm import collocations, decontam, exact, fingerprints, interactions, jaccard, licenses, packing, quality, repair, substrings, toxicity, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "under the MIT license " + "word " * 60_000 + "SPDX-License-Identifier: MIT"
TEXTS = [None, "", "  \n", "one", "same text here of five words", "same text here of five words", "Same Text here of five words", "tie a b", "tie b a", LONG, LONG, "<|endoftext|>", "\x00 \x01 é"]
#: Names that the operators use inside.
CLASHES = "id row key n a b x y k l r e f h w at ids norm kept score label stem bucket kind packed slot chain links text_key hits expressions root sketch comp component ring path part shard range edge spans first last digest size n_words total order words pos item items hit rank sum".split()


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(docs, labels), toxicity.fit(docs, labels)


def operators(spark, models):
    bench = spark.createDataFrame([("i1", "same text here of five words"), ("i2", None), ("i3", "")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    record = lambda df: df.select("*", warc.record_text(F.coalesce("doc_id", F.lit(-1)), F.lit("u"), F.coalesce("text", F.lit(""))).alias("record")).drop("text")
    return {
        "quality": lambda df: quality.score(df, models[0]), "substrings": substrings.remove_repeats, "warc": lambda df: warc.manifest(record(df), "doc_id"),
        "toxicity": lambda df: toxicity.score(df, models[1]), "token ids": lambda df: repair.documents(repair.encode(df, BPE)).drop("start"),
        "decontamination": lambda df: decontam.summary(decontam.contamination(df, bench)), "exact": exact.exact_groups, "licences": licenses.scan,
        "packing": lambda df: packing.pack(df, BPE).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")), "jaccard": jaccard.similar_groups,
        "collocations": lambda df: collocations.collocations(df, least=2), "audit": lambda df: interactions.audit(interactions.failures(df, labels), {x: f"fails_{x}" for x in "ABCDE"}),
        "fingerprints": fingerprints.fingerprints,
    }


NAMES = ["quality", "substrings", "warc", "toxicity", "token ids", "decontamination", "exact", "licences", "packing", "jaccard", "collocations", "audit", "fingerprints"]


def rows_of(df):
    return Counter(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_defined_cases(spark, models, name):
    f = operators(spark, models)[name]
    ids = [*range(len(TEXTS) - 3), None, 4, 4]
    plain = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s" if k % 3 else None, 1) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))], ROWS)
    clashing = plain.withColumns({c: F.lit("clash") for c in CLASHES if not (name == "warc" and c == "id")})
    got = rows_of(f(plain.repartition(2)))
    assert got and rows_of(f(clashing.repartition(3))) == got
    assert f(plain.limit(0)).collect() == []
    if name in ("quality", "toxicity", "exact", "licences", "jaccard", "fingerprints", "token ids"):
        assert sum(got.values()) == len(TEXTS)


def test_long_texts_are_scanned_whole(spark):
    found = licenses.digest(licenses.scan(spark.createDataFrame([(1, LONG, "en", "s", 1)] * 2, ROWS))).collect()
    assert [(r["n_words"], r["n_base"], r["labels"]) for r in found] == [(60_008, 1, "mit")] * 2


# ---- the pipeline


def write_tables(spark, rows, folder, extra=()):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in extra})
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")


def brute_pipeline(spark, rows, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, labels)
    left = [(i, t) for i, t in rows if grammar.probability(*grammar.features(t or "")) < 0.5]
    last = {}
    for i, t in left:
        last[lower(t)] = max((i, t or ""), last.get(lower(t), (i, "")))
    left = {i: t for i, t in last.values()}
    left = {k: left[k] for k in {c for _, c in brute_components(left, 80, 5).values()}}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    return {k: left[k] for k, v in brute_contamination(left, bench, 13).items() if not v[3]}


def test_whole_run_matches_plain_stages(spark, tmp_path):
    """Documents of the small table, copies, near copies and toxic ones among them, with empty and null texts and clashing columns."""
    small = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    extra = [(10**6 + i, t) for i, t in enumerate([None, "", "idiot moron you stupid idiot scum", *soup(3, 25)])]
    rng = random.Random(1)
    extra += [(2 * 10**6 + i, (t or "").upper()) for i, (_, t) in enumerate(rng.sample(small, 20))]
    rows = small + extra
    write_tables(spark, [(i, t, "en", "s", 1) for i, t in rows], str(tmp_path), ("row", "key", "n", "score", "id", "x"))
    want = brute_pipeline(spark, rows, str(tmp_path))
    lib = Tokenizer.from_file(BPE)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), {k: lib.encode(t or "", add_special_tokens=False).ids + [0] for k, t in want.items()})
    assert 0 < len(want) < len(rows) - 20


def test_whole_run_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "a text of some words that nobody else has", "en", "s", 1)] * 3 + [(5, "another text under the same id here", "en", "s", 1), (None, "a text without any id at all, alone", "en", "s", 1), (None, None, "en", "s", 1)]
    write_tables(spark, rows, str(tmp_path / "some"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    lib = Tokenizer.from_file(BPE)
    want = Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in {(i, t) for i, t, *_ in rows})
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    write_tables(spark, rows[:1], str(tmp_path / "none"))
    spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
