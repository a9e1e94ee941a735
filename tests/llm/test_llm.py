from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import bpe, decontam, exact, jaccard, labelled, licenses, packing, quality, queries, repair, substrings, text, toxicity, warc
from touchline.llm.bpe import Encoder
from touchline.llm.graph import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, parts=3):
    rows = [(i, t, "en", "s", None) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def ws_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def soup(seed, n, vocabulary=30, length=60):
    """Texts that share passages: nulls, empty ones, repeats, odd spaces among them."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(vocabulary)] + ["É", "ß", "A", "b"]
    passages = [[rng.choice(vocab) for _ in range(25)] for _ in range(3)]
    out = [None, "", "  \n ", "one"]
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, length))]
        if rng.random() < 0.5:
            words[rng.randint(0, len(words)) : 0] = rng.choice(passages)
        if out and rng.random() < 0.3:
            words = ws_words(rng.choice(out)) + words[: rng.randint(0, 3)]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for w in words))
    return out


# ---- words and hashes


def test_words_match_the_pattern():
    texts = [t or "" for t in soup(1, 40)] + ["\x0b a\x0cb\x1c c d ", "é x"]
    w = text.words(pa.array(texts, pa.large_string()), text.white_space_words(), lower=False)
    for i, t in enumerate(texts):
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == ws_words(t)
    seen = {}
    for h, a, b in zip(w.hash.tolist(), w.start, w.end, strict=True):
        assert seen.setdefault(h, bytes(w.data[a:b])) == bytes(w.data[a:b])


def test_words_of_a_slice_and_of_nothing():
    whole = pa.array(["aa bb", "cc", "", "dd ee"], pa.large_string())
    w = text.words(whole.slice(1, 3), text.white_space_words(), lower=True)
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [b"cc", b"dd", b"ee"] and w.row.tolist() == [0, 2, 2]
    assert len(text.words(pa.array([], pa.large_string()), text.white_space_words(), lower=True).start) == 0


# ---- 1 quality


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    total = model.intercept + sum(r.weight * r.applies(x, ["a", "b", "c"]) for r in model.rules)
    assert ((total > 0) == (y > 0.5)).mean() > 0.97
    heaviest = max(model.rules, key=lambda r: abs(r.weight))
    assert {"a", "b"} <= {c for c, _, _ in heaviest.conditions}
    assert quality.fit_rules(x[:0], y[:0], ["a", "b", "c"]).rules == ()


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.9)])
def test_classifiers_on_the_held_out_fold(spark, name, label, least):
    """Recall and precision of the rows that the label marks."""
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    both, found, marked = got.agg(*(F.expr(f"count_if({c})") for c in (f"predicted = 1 and {label} = 1", "predicted = 1", f"{label} = 1"))).first()
    assert both / marked >= least and both / found >= least


def test_scores_are_defined_for_empty_texts(spark):
    df = docs(spark, [None, "", "x" * 100_000, "A fine text. It has words."])
    stats = quality.score(df, quality.RuleEnsemble((quality.Rule((("words", True, 2.0),), 2.0),), -1.0)).collect()
    assert len(stats) == 4 and all(0 <= r["score"] <= 1 for r in stats)
    tox = toxicity.score(df, toxicity.Grammar({"idiot": 3.0})).collect()
    assert len(tox) == 4 and all(0 <= r["score"] <= 1 for r in tox)
    assert quality.score(df.limit(0), quality.RuleEnsemble((), 0.0)).count() == 0


def test_no_label_of_the_held_out_fold_is_used(spark):
    df = docs(spark, {i: f"t{i}" for i in range(50)})
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(7, None)], "doc_id bigint, quality int")
    used = {r["doc_id"] for r in labelled.fit_sample(df, labels, "quality").collect()}
    assert used == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert labelled.fit_sample(df, labels, "quality", limit=5).count() == 5


# ---- 2 substrings


def brute_substrings(texts, window):
    seen, out = {}, {}
    order = sorted(texts)
    words = {k: ws_words(texts[k]) for k in order}
    for k in order:
        for p in range(len(words[k]) - window + 1):
            seen.setdefault(tuple(words[k][p : p + window]), (k, p))
    for k in order:
        gone = {i for p in range(len(words[k]) - window + 1) if seen[tuple(words[k][p : p + window])] != (k, p) for i in range(p, p + window)}
        out[k] = (len(words[k]), len(gone), " ".join(w for i, w in enumerate(words[k]) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "minimiser", "seed"), [(20, 5, 1), (6, 2, 2), (5, 5, 3), (4, 1, 4)])
def test_substrings_match_brute_force(spark, window, minimiser, seed):
    texts = dict(enumerate(soup(seed, 60, vocabulary=6 if window < 10 else 30)))
    texts[500] = texts[501] = "same " * 300
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(spark, texts), window, minimiser).collect()}
    assert got == brute_substrings(texts, window)


def test_frequent_minimisers_rank_last(spark, monkeypatch):
    """A phrase in every text: no bucket of its own, and the same removed words."""
    monkeypatch.setattr(substrings, "FREQUENT", 20)
    rng = random.Random(8)
    texts = [" ".join([rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(30)] + "one two three four five".split() + [str(rng.randint(0, 10**6)) for _ in range(30)]) for _ in range(120)]
    texts += texts[:15]
    frequent = substrings.frequent_minimisers(docs(spark, texts).select("doc_id", "text"), 20, 5)
    h = text.words(pa.array(texts, pa.large_string()), substrings._WORD, lower=False)
    phrase = text.grams(text.words(pa.array(["one two three four five"], pa.large_string()), substrings._WORD, lower=False).hash, 5) >> np.uint64(1)
    plain, spread = (substrings.super_kmers(h.hash, h.row, 20, 5, f)[2] for f in (None, frequent))
    if (plain == phrase[0]).sum() >= 20:
        assert phrase[0] in frequent
    assert np.unique(spread, return_counts=True)[1].max() <= np.unique(plain, return_counts=True)[1].max()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert got == brute_substrings(dict(enumerate(texts)), 20)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "grams", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    strings = [b"a b c d", b"a b c e", b"x a b c"]
    got = substrings.later_windows(strings, np.array([0, 1, 2]), np.array([0, 0, 0]), 3)
    assert got.tolist() == [[1, 0, 3], [2, 1, 4]]


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0
    assert [tuple(r) for r in substrings.remove_repeats(docs(spark, [None, "a  b"])).orderBy("doc_id").collect()] == [(0, 0, 0, ""), (1, 2, 0, "a b")]


# ---- 3 WARC


def test_audit_finds_every_damage(spark):
    ours = spark.createDataFrame([(i, f"record {i}" * (i % 7 + 1)) for i in range(300)], "page_id bigint, record string")
    theirs = ours.where("page_id NOT IN (5, 77)").withColumn("record", F.when(F.col("page_id").isin(0, 160, 299), "broken").otherwise(F.col("record")))
    theirs = theirs.unionByName(spark.createDataFrame([(1000, "more")], "page_id bigint, record string"))
    got = {r["id"]: r["status"] for r in warc.audit(ours, theirs, file_slots=64, fanout=4).where("status <> 'ok'").collect()}
    assert got == {5: "missing", 77: "missing", 0: "corrupt", 160: "corrupt", 299: "corrupt", 1000: "extra"}
    assert warc.audit(ours, ours, file_slots=64, fanout=4).where("status <> 'ok'").count() == 0
    assert warc.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_only_differing_branches_are_compared(spark):
    ours = warc.manifest(spark.createDataFrame([(i, f"r{i}") for i in range(256)], "page_id bigint, record string"), file_slots=64)
    wrong = ours.withColumn("digest", F.when((F.col("file") == 1) & (F.col("slot") == 9), "x").otherwise(F.col("digest")))
    levels = [(a.join(b.select("file", "node", F.col("digest").alias("b")), ["file", "node"]).where("digest <> b").count()) for a, b in zip(warc.tree(ours, 4, 3), warc.tree(wrong, 4, 3), strict=True)]
    assert levels == [1, 1, 1, 1]


def test_shifted_ranges_are_found(spark):
    ours = warc.manifest(spark.createDataFrame([(i, f"r{i}") for i in range(64)], "page_id bigint, record string"), file_slots=64)
    a = warc.tree(ours, 4, 3)
    found = lambda theirs: sorted(tuple(r) for r in warc.damaged(a, warc.tree(theirs, 4, 3), 4).select("level", "node", "status").collect())
    # bytes between two records: those behind them lie further on, in each range that holds both
    padded = ours.withColumn("offset", F.when(F.col("slot") >= 21, F.col("offset") + 7).otherwise(F.col("offset")))
    assert found(padded) == [(0, 21, "shifted"), (0, 22, "shifted"), (0, 23, "shifted"), (1, 6, "shifted"), (1, 7, "shifted"), (2, 2, "shifted"), (2, 3, "shifted")]
    assert found(ours.withColumn("offset", F.col("offset") + 5)) == [(3, 0, "shifted")]
    assert found(ours) == []
    given = warc.manifest(spark.createDataFrame([(0, "a", 5), (1, "b", None)], "page_id bigint, record string, o bigint"), file_slots=64, offset_col="o")
    assert sorted((r["slot"], r["offset"]) for r in given.collect()) == [(0, 5), (1, 0)]


def test_manifest_of_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, None), (1, "b"), (None, "x"), (2, "")], "page_id bigint, record string")
    got = warc.manifest(rows).orderBy("slot").collect()
    assert [(r["slot"], r["offset"]) for r in got][0] == (1, 0) and len(got) == 2


# ---- 4 toxicity


def test_clause_grammar():
    g = toxicity.Grammar({"idiot": 3.0, "scum": 3.0})
    one = lambda s: sum(g.clause_weights(s))
    assert one("you are an idiot.") == 4.5 and one("an idiot.") == 3.0
    assert one("you are not an idiot") == pytest.approx(1.35) and one("he said an idiot") < one("he is an idiot")
    assert one("kill the process") == 0 and one("i will kill you") == 3.0
    assert len(g.clause_weights("idiot. scum.")) == 2 and g.clause_weights("") == [] and one("IDIOT!!") == 3.0
    assert g.clause_weights("a fine day") == []


def test_stems_prefer_the_sure_and_long():
    got = toxicity.choose_stems([("veq", 50, 50), ("vequ", 50, 50), ("vequa", 20, 20), ("los", 222, 198), ("lostra", 197, 197), ("rare", 3, 3)], 300, 3000)
    assert {"vequ", "lostra"} <= set(got) and not {"veq", "vequa", "los", "rare"} & set(got)


def test_drop_toxic_keeps_columns_and_rows(spark):
    df = docs(spark, [None, "", "you idiot scum", "good", "good"])
    left = toxicity.drop_toxic(df, toxicity.Grammar({"idiot": 3.0, "scum": 3.0}, slope=3.0, intercept=-2.0))
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 3, 4]


# ---- 5 token ids


def test_encoder_equals_the_library():
    own, lib, rng = Encoder(BPE), Tokenizer.from_file(BPE), random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "½", "_", " ", "ß", "日", "\x1d", "!", "ab", "<|endoftext|>", "́", "\r", " word", "?!\n", "\x85", "\xa0", "²", "ǆ", "’", "“", "—", "€", "'ll", "'D", "\u3000", "\x1c", "ª9", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t or "" for t in soup(3, 30)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):  # new chunks, then remembered ones
        for at in range(0, len(texts), 50):
            assert [x.tolist() for x in own.encode_many(texts[at : at + 50])] == want[at : at + 50]
    assert own.known and own.encode("").tolist() == []


def test_pieces_are_cut_as_the_library_cuts_them():
    lib, rng = Tokenizer.from_file(BPE), random.Random(5)
    parts = ["'re", "'s", "'", "'ve", "'l", "l", " ", "  ", "\n", "\xa0", "\x85", "é", "ß9", "½", "_", "a", "B", "’", "“", "€", "!", "e"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    data, at = bpe._bytes_of(pa.array(texts, pa.large_string()))
    begin = set(bpe.piece_starts(data, bpe.classes_of(data), at).tolist())
    for first, text in zip(at[:-1].tolist(), texts, strict=True):
        # the library's own cuts, as code points
        cuts = [len(text[:a].encode()) for _, (a, _) in lib.pre_tokenizer.pre_tokenize_str(text)]
        assert sorted(b - first for b in begin if first <= b < first + len(text.encode())) == cuts, text


def test_many_texts_are_encoded_without_work_by_piece():
    """Known pieces take no Python step each: a batch of 20,000 copies asks the library for its distinct pieces alone."""
    own = Encoder(BPE)
    text = " ".join(f"wort{i % 7} Straße, it's 9½ €" for i in range(20))
    found = own.encode_many(pa.array([text] * 20_000, pa.large_string()))
    assert len(own.known) < 30 and len({x.tobytes() for x in found}) == 1
    bpe._encoders["x"] = own
    bpe.forget()
    del bpe._encoders["x"]
    assert not own.known


def test_remembered_pieces_are_bounded_in_bytes():
    """Of a stream of pieces that never recur, a worker holds at most some 50 MB at once."""
    own, most = Encoder(BPE), 0
    for k in range(10):
        texts = pa.array([" ".join(f"{x:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(at, at + 1000)) for at in range((1 + k) << 24, ((1 + k) << 24) + 50_000, 1000)], pa.large_string())
        own.encode_many(texts)
        most = max(most, sys.getsizeof(own.known) + sum(sys.getsizeof(p) for p in own.known) + sum({id(v): sys.getsizeof(v) for v in own.known.values()}.values()))
    assert 5e6 < most < 50e6


def test_small_tables_take_no_python_workers(spark):
    slots, depth = exact.slots_of(spark, [(1, 0), (2, 2), (2, 3)])
    assert (depth, sorted(map(tuple, slots.collect()))) == (2, [(0, 0), (1, 0), (2, 1), (3, 2)])
    assert slots.dtypes == [("slot", "bigint"), ("bucket", "int")]
    assert "LocalRelation" in slots._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("seed", range(6))
def test_grammar_compression_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [3, 40, 1000][seed % 3], 5000).astype(np.uint16)
    base = [50_257, 65_530, 70_000][seed % 3]
    s, rules, lengths = repair.compress(ids, base, least=2)
    assert repair.expand(s, rules, base).tolist() == ids.tolist()
    pairs = np.unique((s[:-1].astype(np.uint64) << np.uint64(32) | s[1:])[(s[:-1] != repair.END) & (s[1:] != repair.END)], return_counts=True)[1]
    assert not len(pairs) or pairs.max() < 2  # no frequent pair is left
    assert lengths.tolist() == [len(repair.expand(np.array([base + i], np.uint32), rules, base)) for i in range(len(rules))]


def test_files_hold_documents_in_order(spark, tmp_path):
    texts = dict(zip(random.Random(1).sample(range(10**6), 64), soup(5, 60), strict=True))
    texts[4] = "a <|endoftext|> b<|endoftext|>"  # the library's token, not ordinary text
    assert Tokenizer.from_file(BPE).encode(texts[4], add_special_tokens=False).ids.count(50256) == 2
    texts[3] = "!!" * 4000 + "! ! !"  # an id 0 inside a text
    repair.encode(docs(spark, texts), BPE, shard_tokens=700).write.parquet(str(tmp_path / "f"))
    files, lib = repair.read(spark, str(tmp_path / "f")), Tokenizer.from_file(BPE)
    rows = sorted(repair.documents(files, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(texts)
    at = 0
    for r in rows:
        want = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    for shard in files.collect():
        for k, doc in enumerate(np.frombuffer(shard["doc_ids"], "<i8").tolist()):
            whole = lib.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
            assert repair.decode_range(shard.asDict(), k).tolist() == whole
            for a, b in ((0, 1), (len(whole) // 3, len(whole) // 2), (len(whole) - 1, len(whole) + 5), (5, 5)):
                assert repair.decode_range(shard.asDict(), k, a, b).tolist() == whole[a:b]


def test_no_documents_no_shards(spark):
    assert repair.encode(docs(spark, ["a"]).limit(0), BPE).count() == 0


# ---- 6 decontamination


def brute_contamination(texts, items, window):
    grams = {}
    for k, t in items.items():
        w = alnum_words(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = {}
    for k, t in texts.items():
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(x) for x in grams}:
            for i in range(len(w) - n + 1):
                if own := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[k] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("limit", "blocks"), [(10**6, 10**6), (1, 1)])
def test_contamination_matches_brute_force(spark, limit, blocks):
    texts = dict(enumerate(soup(7, 50)))
    rng = random.Random(9)
    items = {0: None, 1: "", 2: "w1 w2", 3: "É ß", 10: "w1-W2.w3", 11: texts[20], 12: texts[21], 2000: " ".join(ws_words(texts[22])[:5])} | {20 + i: " ".join(rng.choices(ws_words(texts[30]) or ["q"], k=20)) for i in range(5)}
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items.items()], "item_id bigint, text string, doc_id string")
    found = decontam.summary(decontam.contamination(docs(spark, texts), bench, broadcast_limit=limit, block_set=blocks)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found}
    assert got == brute_contamination(texts, items, 13)


def test_contaminated_documents_and_spans_go(spark):
    item = " ".join(f"t{i}" for i in range(13))
    df = docs(spark, {1: f"a b {item} c", 2: "a b c", 3: None, 4: " ".join(f"x{i}" for i in range(300)) + " " + item})
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()) == [2, 3, 4]
    clean = {r["doc_id"]: r["clean_text"] for r in decontam.remove_spans(df, bench).collect()}
    assert clean[1] == "a b c" and clean[2] == "a b c" and clean[3] == ""
    twice = spark.createDataFrame([(1, item, 0), (1, "x y", 1), (None, item, 2), (5, item, 3), (5, item, 4)], "doc_id bigint, text string, words int")
    assert [tuple(r) for r in decontam.drop_contaminated(twice, bench).collect()] == [(1, "x y", 1)]
    assert decontam.contamination(twice, bench).count() == 5 and sorted(r["clean_text"] for r in decontam.remove_spans(twice, bench).collect()) == ["", "", "", "", "x y"]
    none = bench.limit(0)
    assert decontam.contamination(df, none).where("size(hits) > 0").count() == 0 and decontam.contamination(df.limit(0), bench).count() == 0


# ---- 7 exact dedup


@pytest.mark.parametrize("capacity", [1, 10_000])
def test_exact_groups_match_brute_force(spark, capacity):
    texts = dict(enumerate(soup(11, 60))) | {900: "ÄB", 901: "äb", 902: "Äb"}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_groups(docs(spark, texts), capacity=capacity).collect()}
    groups = {}
    for k, t in texts.items():
        groups.setdefault(lower(t), []).append(k)
    assert got == {k: (max(g), len(g), k == max(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for k in g}


def test_directory_splits_overfull_buckets_only():
    counts = {0: 9, 1: 1, 2: 1, 7: 1}
    assert exact.directory(counts, capacity=3, depth=3) == [(3, 0), (3, 1), (2, 1), (1, 1)]
    assert exact.directory({}, 3, 3) == [(0, 0)]
    assert [exact.depth_for(n, 8) for n in (0, 8, 9, 64, 1 << 60)] == [3, 3, 4, 6, exact.MOST_DEPTH]


def test_buckets_own_their_keys(spark, monkeypatch):
    """Each bucket lies in one task's files; a directory that names wrong buckets loses documents."""
    df = docs(spark, soup(12, 80)).select("doc_id", exact.text_key(F.col("text")).alias("text_key"), exact.normalised(F.col("text")).alias("norm"))
    index, slots, depth = exact.build_index(df, capacity=4)
    assert slots.count() == 1 << depth and index.select("bucket").distinct().count() > 4
    assert index.select("bucket", F.input_file_name().alias("f")).distinct().count() == index.select("bucket").distinct().count()
    assert index.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 4").count() <= 1
    whole = exact.exact_groups(docs(spark, soup(12, 80)), capacity=4).count()
    right = exact.slots_of
    monkeypatch.setattr(exact, "in_bucket", lambda rows, slots, depth: rows.withColumn("bucket", F.lit(0) if "norm" not in rows.columns and "keep_id" not in rows.columns else F.pmod(F.col("key"), F.lit(5)).cast("int")))
    assert exact.exact_groups(docs(spark, soup(12, 80)), capacity=4).count() < whole and right


def test_chained_keys_are_told_apart(spark, monkeypatch):
    df = docs(spark, ["aa", "bb", "AA", "c"])
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(*c).cast("long") * (1 << 40))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(df).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (3, 1)}


def test_drop_copies(spark):
    left = exact.drop_copies(docs(spark, ["a", "A", None, "", "b"]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4] and left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert exact.exact_groups(docs(spark, ["a"]).limit(0)).count() == 0


def test_drop_copies_decides_on_rows(spark):
    rows = [(1, "a"), (7, "A"), (7, "B"), (2, "b"), (9, "b"), (None, "n"), (None, "N"), (4, "z"), (4, "z"), (4, "z"), (None, "b")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, __id int").repartition(3)
    left = exact.drop_copies(df)
    assert left.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"].lower()) for r in left.collect())
    assert got == [(-1, "n"), (4, "z"), (7, "a"), (9, "b")]


# ---- 8 licences


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("MIT", ["mit"]), ("MIT OR Apache-2.0", ["mit", "apache-2.0"]), ("(MIT or BSD) and GPL-2.0 WITH Classpath-exception-2.0", ["mit", "bsd", "gpl-2.0 with classpath-exception-2.0"]),
        ("MIT AND ISC OR GPL-3.0-or-later", ["mit", "isc", "gpl-3.0-or-later"]), ("MIT and more text", ["mit"]), ("MIT OR", ["mit"]), ("OR MIT", None), ("", None), ("(MIT", None), ("MIT)", ["mit"]),
        ("see the LICENSE file", None), ("MIT.", ["mit"]), ("MIT WITH ISC", ["mit"]), ("(MIT) WITH x-exception", ["mit"]), ("MIT WITH (x-exception)", ["mit"]), ("LicenseRef-own-1", ["licenseref-own-1"]), ("()", None),
        ("MIT WITH a-exception WITH b-exception", ["mit with a-exception"]), ("MIT AND (ISC OR", ["mit"]),
    ],
)
def test_expressions(line, want):
    rpn = licenses.parse_expression(line)
    assert (licenses.atoms(rpn) if rpn else None) == want


def test_expressions_are_evaluated_like_python():
    rng = random.Random(9)
    names = ["mit", "isc", "gpl-2.0", "zlib"]

    def some(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(names)
        e = f"{some(depth - 1)} {rng.choice(['and', 'or'])} {some(depth - 1)}"
        return f"({e})" if rng.random() < 0.5 else e

    for _ in range(200):
        e, true = some(4), {n for n in names if rng.random() < 0.5}
        plain = eval(re.sub(r"[a-z][a-z0-9.-]*", lambda m: m[0] if m[0] in ("and", "or") else str(m[0] in true), e))
        assert licenses.holds(licenses.parse_expression(e), true.__contains__) == plain, e


def test_long_expressions_take_linear_time():
    wide = licenses.parse_expression(" and ".join(["(MIT or ISC)"] * 2000))
    assert licenses.atoms(wide) == ["mit", "isc"] and licenses.holds(wide, lambda x: x == "isc") and not licenses.holds(wide, lambda x: False)
    deep = licenses.parse_expression("(" * 10_000 + "MIT" + ")" * 10_000)
    assert deep == ["mit"]
    long = licenses.parse_expression(" or ".join(["GPL-2.0 with a-exception"] * 20_000))
    assert len(long) == 79_999


def test_every_tag_of_a_line_counts(spark):
    text = "SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only license-expression: (Apache-2.0 OR GPL-2.0-only)\nSPDX-License-Identifier:SPDX-License-Identifier: ISC"
    found = licenses.scan_text(text.encode(), licenses.automaton(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES, licenses.TAGS))[2]
    assert [(e["licences"], e["permissive"]) for e in found] == [(["mit"], True), (["gpl-2.0-only"], False), (["apache-2.0", "gpl-2.0-only"], True), ([], False), (["isc"], True)]
    got = licenses.digest(licenses.scan(docs(spark, [text]))).first()
    assert (got["labels"], got["n_expressions"]) == ("apache-2.0,gpl-2.0-only,isc,mit", 5)


def test_scan_matches_brute_force(spark):
    rng = random.Random(4)
    phrases = [p.split() for p in licenses.BASE_PHRASES]
    texts = [None, "", "Under the MIT License.", "Apache License, Version 2.0", "CC-BY-NC cc by nc", "under\nthe mit  license under the MIT-license", "xunder the mit license", "SPDX-License-Identifier: MIT OR ISC\nx"]
    for _ in range(60):
        words = [w for _ in range(8) for w in (rng.choice(phrases) if rng.random() < 0.3 else [rng.choice(["é", "the", "mit", "by"])])]
        texts.append(rng.choice([" ", "-", ", "]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words))
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs(spark, texts))).collect()}
    for k, t in enumerate(texts):
        w = alnum_words(t)
        at = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None)), t
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert "isc" in got[7]["labels"].split(",") and "mit" in got[7]["labels"].split(",")


# ---- 9 packing


def check_pieces(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at, x = 0, np.array(ids[k], "<u4")
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(x)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        sizes.append(at)
    assert all(n & (n - 1) == 0 for n in sizes)  # nothing is padded


def test_pieces_hold_every_id_once(spark):
    texts = dict(enumerate(soup(13, 80, length=400))) | {1000: "word " * 6000}
    lib = Tokenizer.from_file(BPE)
    ids = {k: lib.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    check_pieces(packing.pack(docs(spark, texts), BPE).collect(), ids)
    assert packing.pack(docs(spark, ["a"]).limit(0), BPE).count() == 0


def test_neighbours_share_terms():
    ids = [np.array(x, "<u4") for x in ([1, 2, 3], [4, 5, 6], [1, 2, 7], [6, 4, 8], [0])]
    index = packing.Index(ids, np.ones(9), 3.0)
    every = np.ones(5, int)
    assert index.neighbours(0, every).tolist()[:2] == [0, 2] and index.neighbours(1, every).tolist()[:2] == [1, 3]
    assert 2 not in index.neighbours(0, np.array([1, 1, 0, 1, 1]))
    first = packing.pack_shard([500, 500, 500, 500, 1], index)[0]
    assert first == [(0, 0, 500), (2, 0, 500), (1, 0, 24)]


def test_shards_gather_documents_that_share_rare_terms(spark):
    """Documents of 40 topics, stored far apart: most sequences hold one topic only, though shards are small."""
    rng = random.Random(5)
    topics = [[f"{'abcdefghij'[t % 10]}{'klmnopqrst'[t // 10]}{'uvwxyzabcd'[i]}om" for i in range(10)] for t in range(40)]
    texts = {i: " ".join(rng.choices(topics[i % 40], k=60)) for i in range(800)}
    rows = packing.pack(docs(spark, texts), BPE, shard_docs=64).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r["doc_id"] % 40)
    share = [max(map(t.count, t)) / len(t) for t in by_sequence.values() if len(t) > 1]
    assert sum(share) / len(share) > 0.7


# ---- 10 Jaccard join


def brute_components(texts, threshold, k=4):
    sets = {}
    for d, t in texts.items():
        w = ws_words(lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def near_copies(seed):
    rng = random.Random(seed)
    out = [None, "", "a", "A", "a b", "a b c d e", "A b c d e"]
    for _ in range(4):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(8, 60))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 3)}"]
            out.append(" ".join(words))
    return dict(enumerate(out))


@pytest.mark.parametrize(
    ("threshold", "seed", "how"),
    [(85, 1, {}), (70, 2, {"leaf": 2, "pivots": 2, "first_pairs": 1}), (60, 3, {"leaf": 2, "pivots": 3, "task_members": 6}), (80, 4, {"leaf": 1, "task_members": 4, "first_pairs": 1, "extra": 0})],
)
def test_components_match_brute_force(spark, threshold, seed, how):
    texts = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs(spark, texts), threshold, **how).collect()}
    assert got == brute_components(texts, threshold)


def random_sets(seed, groups=12, members=40):
    """Shingle sets of groups around a centre each, at many distances."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.integers(0, 1 << 62, 300)
        for _ in range(members):
            kept = centre[rng.random(300) > rng.choice([0.0, 0.02, 0.05, 0.2])]
            out.append(np.unique(np.concatenate((kept, rng.integers(0, 1 << 62, rng.integers(0, 20))))))
    return out


@pytest.mark.parametrize(("leaf", "pivots"), [(2, 2), (4, 3), (8, 8)])
def test_cells_keep_every_link(leaf, pivots):
    """Several levels of cells, against all pairs; the cells part the table, and no pair is missing."""
    sets = random_sets(leaf)
    ring = max(jaccard.ring_of(len(s)) for s in sets)
    sketches = np.stack([wide(s, ring) for s in sets])
    n = np.array([len(s) for s in sets])
    reach = 15 * 2 * int(n.max()) // 185
    found = jaccard.cells(sketches, reach, leaf, pivots)
    assert len(found) > pivots and max(map(len, found)) < len(sets) / 2
    together = {(int(i), int(j)) for c in found for i in c for j in c if j < i}
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    assert links and links <= together
    order = np.arange(len(sets))
    pairs, done = jaccard.candidates(sketches, n, order, np.ones(len(n), bool), np.ones((len(n), 1), np.int64), 1, 85, 10**6, leaf, pivots)
    assert done and links <= set(map(tuple, pairs.tolist())) and len(pairs) < 3 * len(links)
    few, done = jaccard.candidates(sketches, n, order, np.ones(len(n), bool), np.ones((len(n), 1), np.int64), 1, 85, 1, leaf, pivots)
    assert not len(jaccard.candidates(sketches, n, order, np.ones(len(n), bool), np.ones((len(n), 1), np.int64), 2, 85, 1, leaf, pivots)[0])
    assert not done and set(map(tuple, few.tolist())) <= set(map(tuple, pairs.tolist()))


def wide(keys, ring):
    odd = np.bincount(keys & ((1 << ring) - 1), minlength=1 << ring).astype(np.uint8) & 1
    return np.frombuffer(np.packbits(odd, bitorder="little").tobytes(), np.uint64)


def test_folded_sketches_are_sketches_of_fewer_slots():
    rng = np.random.default_rng(3)
    x, y = (np.unique(rng.integers(0, 1 << 62, n)) for n in (700, 300))
    for ring in (6, 8, 10):
        assert jaccard.folded(jaccard.sketch(x), ring).tolist() == wide(x, ring).tolist()
        apart = int(np.bitwise_count(jaccard.folded(jaccard.sketch(x), ring) ^ jaccard.folded(jaccard.sketch(y), ring)).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_large_regions_are_parted_by_spark(spark):
    """Regions above task_members become cells or blocks; no two documents that may link lose their common region."""
    sets = random_sets(9, groups=4, members=30)
    rows = [(1, 10, "", i, len(s), i % 7, jaccard.sketch(s)) for i, s in enumerate(sets) if jaccard.ring_of(len(s)) == 10]
    table = spark.createDataFrame(rows, "key bigint, ring int, path string, x bigint, n bigint, score int, sketch binary")
    got = jaccard.parted(table, 85, 20, 4).collect()
    by_path = {}
    for r in got:
        by_path.setdefault(r["path"], set()).add(r["x"])
    assert len(by_path) > 4 and max(map(len, by_path.values())) < len(rows)
    ids = [r[3] for r in rows]
    for i in ids:
        for j in ids:
            both = len(np.intersect1d(sets[i], sets[j]))
            if j < i and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert any({i, j} <= p for p in by_path.values())


def test_repeated_and_null_ids_of_the_join(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "x y z u v"), (3, "X y z u v"), (None, "a b c d e"), (7, "A b c d e"), (7, "A b c d e")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.similar_groups(df).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in jaccard.keep_one(df).collect())
    assert kept == [(-1, "a b c d e"), (3, "X y z u v"), (5, "a b c d e")]


def test_keep_one_and_empty(spark):
    df = docs(spark, {5: "a b c d e", 2: "A b c d  e", 9: None, 8: ""})
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [2, 8, 9]
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in linked}


# ---- pipeline


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = df
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        out = stage(spark, left, SMALL)
        assert out.columns == df.columns
        kept = {r["doc_id"] for r in out.collect()}
        if name == "exact dedup":
            last = {}
            for k, t in before.items():
                last[lower(t)] = max(k, last.get(lower(t), k))
            want = set(last.values())
        elif name == "n-gram Jaccard join":
            want = {c for _, c in brute_components(before, 80, 5).values()}
        else:
            bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
            want = {k for k, v in brute_contamination(before, bench, 13).items() if not v[3]}
        assert kept == want, name
        left = df.where(F.col("doc_id").isin(*kept))
    toxic = corpus_pipeline.STAGES[0][1](spark, df, SMALL)
    assert toxic.columns == df.columns and 0 < toxic.count() <= df.count()


def test_jaccard_stage_takes_five_words_and_four_fifths(spark):
    """Of 50 words, one replaced inside: 41 of 51 shingles of five words are common (0.80), 43 of 51 of four (0.84)."""
    base = [f"w{i}" for i in range(50)]
    texts = {1: " ".join(base), 2: " ".join([*base[:25], "other", *base[26:]]), 3: " ".join([*base[:10], *["x", "y", "z"] * 5])}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_similar(spark, docs(spark, texts), SMALL).collect()}
    assert kept == {c for _, c in brute_components(texts, 80, 5).values()} == {1, 3}
    assert {c for _, c in brute_components(texts, 85).values()} == {1, 2, 3}
