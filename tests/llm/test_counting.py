"""Phrase collocations, filter interactions and fingerprints against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import automata, collocations, fingerprints, interactions, queries

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


# ---- automata


def random_paths(seed, n=400, depth=4):
    rng = random.Random(seed)
    vocab = [b"a", b"ab", b"b", b"\x01", b"\xc3\xa9", b"zz", b""]
    return [tuple(rng.choice(vocab[:4] if rng.random() < 0.7 else vocab) for _ in range(rng.randint(1, depth))) for _ in range(n)]


def trie(paths, depth=4):
    return automata.trie_of(pa.array([list(p) for p in paths], pa.list_(pa.binary())), depth)[0]


def spelled(t):
    """All sequences of a trie with their weights."""
    vocab, out, above = t.vocab.to_pylist(), {}, [()]
    for labels, weights, parents in zip(t.labels, t.weights, t.parents, strict=True):
        mine = [above[p] + (vocab[x],) for x, p in zip(labels.tolist(), parents.tolist(), strict=True)]
        out |= dict(zip(mine, weights.tolist(), strict=True))
        above = mine
    return out


def prefixes(paths):
    return dict(Counter(p[:k] for p in paths for k in range(1, len(p) + 1)))


@pytest.mark.parametrize("seed", range(5))
def test_union_sums_weights_by_prefix_range(seed):
    rng = random.Random(seed)
    shards = [random_paths(10 * seed + i) for i in range(4)]
    bounds = [(), *sorted(set(rng.sample(random_paths(seed + 99), 9)))]
    by_range = defaultdict(list)
    for shard in shards:
        for i, piece in trie(shard).pieces(bounds):
            by_range[i].append(automata.Automaton.read(piece.packed()))
    want, got = prefixes([p for s in shards for p in s]), {}
    for i, parts in by_range.items():
        found = spelled(automata.union(parts))
        own = {p: n for p, n in found.items() if p >= bounds[i] and (i + 1 == len(bounds) or p < bounds[i + 1])}
        assert not got.keys() & own.keys()
        got |= own
        for p, n in found.items():  # what isn't its own is a prefix of its lower bound, and counted in full
            assert p in own or (p == bounds[i][: len(p)] and want[p] == n)
    assert got == want


def test_equal_states_become_one():
    paths = [(bytes([x]), bytes([y]), b"same") for x in range(97, 107) for y in range(97, 107)]
    a = automata.Automaton.read(trie(paths, 3).packed())
    assert [len(level[1]) for level in a.levels] == [10, 10, 1]
    assert spelled(automata.union([a])) == prefixes(paths)


def test_equal_hashes_of_states_are_told_apart(monkeypatch):
    monkeypatch.setattr(automata, "mix", lambda x: x * np.uint64(0))
    paths = random_paths(3)
    assert spelled(automata.union([automata.Automaton.read(trie(paths).packed())])) == prefixes(paths)


def test_light_arcs_go_with_all_below_them():
    paths = random_paths(5)
    want = {p: n for p, n in prefixes(paths).items() if n >= 4}
    assert spelled(trie(paths).heavy(4)) == want


def test_composition_reads_weights():
    paths, asked = random_paths(6), random_paths(7, 200) + [(b"nowhere",), (b"a", b"nowhere"), (b"a",)]
    want = prefixes(paths)
    a = automata.Automaton.read(trie(paths).packed())
    got = automata.weights_of(pa.array([list(p) for p in asked], pa.list_(pa.binary())), a)
    assert got.tolist() == [want.get(p, 0) for p in asked]
    assert automata.weights_of(pa.array([], pa.list_(pa.binary())), a).tolist() == []


# ---- collocations


def brute_collocations(rows, order=3, least=10, covered=50, top=2000):
    """rows: text, lang."""
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, order + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, count in f.items():
        mine, candidates = [], {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            mine.append((score, a, " ".join(p), l, r))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(mine[:top])]
    return sorted(out)


def prose(seed, n=120):
    rng = random.Random(seed)
    vocab = ["a", "A", "b", "cc", "é", "É", "\x01", "x\x00y", " ", " "]
    out = [(None, "en"), ("", None), (" \t ", "und"), (".,;", "")]
    for _ in range(n):
        words = [rng.choice(vocab[: rng.choice([2, 4, 10])]) for _ in range(rng.randint(0, 40))]
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r", "\x0b!"]) for w in words), rng.choice(["en", "en", "de", "a", None, "und", ""])))
    return out + [out[-1]] * 30 + [("go go go go " * 400, "en")]


def found_collocations(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], ROWS).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"least": 2, "top": 25}), (3, {"order": 2}), (4, {"order": 4, "least": 3, "covered": 80})])
def test_collocations_match_brute_force(spark, seed, how):
    rows = prose(seed)
    want = brute_collocations(rows, **how)
    assert want
    assert found_collocations(spark, rows, **how) == want


def test_shards_of_few_words_count_every_phrase_once():
    rows = prose(8)
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t, _ in rows], pa.large_string()), pa.array([lang or "und" for _, lang in rows])], names=["text", "lang"])
    counts = []
    for most in (7, 1 << 20):
        shard = collocations._Shard(3, most)
        tries = [*shard.add(batch), *shard.tries()]
        counts.append(spelled(automata.union([automata.Automaton.read(t.packed()) for t in tries])))
    assert counts[0] == counts[1]
    assert len(tries) == 1


def test_phrase_counts_can_be_asked_for(spark):
    df = spark.createDataFrame([(1, "a b a b. b a", "en", "s", 1), (2, "a b", None, "s", 1)], ROWS)
    counts = collocations.count_phrases(df)
    parts = spark.createDataFrame([("en", "a b"), ("en", "b a b"), ("en", "b"), ("und", "a"), ("en", "nothing"), ("en", "a b a b a b"), (None, "a"), ("en", "a b")], "lang string, part string")
    assert sorted(map(tuple, collocations.part_counts(counts, parts).collect())) == [("en", "a b", 2), ("en", "b", 3), ("en", "b a b", 1), ("und", "a", 1)]


def test_collocations_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], ROWS)
    assert collocations.collocations(empty).collect() == []
    rows = prose(9)
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    clashing = df.withColumns({c: F.lit("x") for c in ("phrase", "range", "automaton", "part", "rank", "n", "path")})
    assert sorted(tuple(r) for r in collocations.collocations(clashing).collect()) == brute_collocations(rows)


def test_association_is_exact_beyond_64_bits(spark):
    rows = [(10**12, 10**12, 10**12), (10**12 - 1, 10**12, 10**12), (7 * 10**9 + 1, 9 * 10**9 + 7, 8 * 10**9 + 3), (10, 11, 12)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(collocations.association(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1000000 * a * a // (l * r) for a, l, r in rows]


# ---- filter interactions


def brute_audit(rows, labels):
    """rows: doc_id, text, source."""
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for i, t, part in rows:
            t, part = t or "", part or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = {
                "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                "E": i is not None and least.get(t, i) < i,
            }
            gone = False
            for step, x in enumerate(order, 1):
                c = out.setdefault((part, order, step), Counter())
                c["redundant"] += fails[x] and gone
                c["unique_fails"] += fails[x] and sum(fails.values()) == 1
                if fails[x] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += i in good
                    c["toxic_lost"] += i in toxic
                    out.setdefault((part, x), Counter())["removed"] += 1
                c["kept"] += not gone
    return sorted((*k, *(v[c] for c in interactions.COUNTERS), out.get((k[0], k[1][k[2] - 1]), Counter())["removed"]) for k, v in out.items() if len(k) == 3)


def audited(docs, labels):
    return sorted(tuple(r) for r in interactions.audit(interactions.failures(docs, labels), {x: f"fails_{x}" for x in "ABCDE"}).collect())


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "AB CD", "é" * 20 + "A", "one # two", "word " * 60, " ".join(map(str, range(60))), " ".join(map(str, range(33))) + " 1" * 17, "x" * 95 + "ABCDE", "x" * 94 + "ABCDEF", "long " + "y " * 200_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(120)]
    rows += [(7, "twice the same", "s1")] * 2 + [(8, "twice the same", "s2"), (None, "twice the same", "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(5) for c in ("id", "digest", "size", "part", "fails_A", "quality", "toxic", "least", "mask", "n")})
    assert audited(docs.repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").repartition(2)) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark.createDataFrame([], ROWS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")) == []


def test_fields_never_run_into_each_other():
    n, most = 600 * 6, (1 << 63) - 1
    fields = np.full(n, 1, np.uint64)
    fields[::2] = 0
    assert interactions.unpacked(most * interactions.packed(fields), n).tolist() == [0, most] * (n // 2)
    masks = [(m, g, t) for m in range(32) for g in (False, True) for t in (False, True)]
    total = sum((i + 1) * interactions.packed(interactions.outcomes("ABCDE", *m)) for i, m in enumerate(masks))
    want = sum((i + 1) * interactions.outcomes("ABCDE", *m).astype(np.int64).ravel() for i, m in enumerate(masks))
    assert interactions.unpacked(total, n).tolist() == want.tolist()


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, True, None), ("p", False, True, True, True), ("p", None, False, False, False)], "part string, u boolean, v boolean, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): r for r in interactions.audit(rows, {"Y": "u", "Z": "v"}).collect()}
    assert [(got["YZ", k]["kept"], got["YZ", k]["removed"], got["YZ", k]["good_lost"]) for k in (1, 2)] == [(2, 1, 1), (1, 1, 1)]
    with pytest.raises(ValueError, match="filters"):
        interactions.audit(rows, {x: "u" for x in "ABCDEFG"})


# ---- fingerprints


def weights(text, size=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def generalised_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_terms_are_counted():
    texts = ["a b A b", "one", "", " \n", "x y", "a b c " * 50]
    term, weight, row = fingerprints.weighted_terms(pa.array(texts, pa.large_string()), 2)
    for i, t in enumerate(texts):
        assert sorted(weight[row == i].tolist()) == sorted(weights(t).values())
    assert len(np.unique(term)) == len({k for t in texts for k in weights(t)})


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        pairs = []
        for _ in range(3):
            common = [rng.choice(words) + " x" for _ in range(round(300 * share))]
            pairs.append([" ".join(common + [f"{side}{rng.choice(words)} x" for _ in range(300 - len(common))]) for side in "ab"])
        prints = fingerprints.signatures(pa.array([t for p in pairs for t in p], pa.large_string()), 1024, 2)
        error = [fingerprints.alike(*prints[2 * i : 2 * i + 2]) - generalised_jaccard(*map(weights, p)) for i, p in enumerate(pairs)]
        assert abs(np.mean(error)) < 0.03


def test_heavy_terms_are_sampled_by_their_weight():
    a, b = "q " + "h h " * 3000, "q " + "h h " * 1000
    prints = fingerprints.signatures(pa.array([a, b], pa.large_string()), 2048, 2)
    assert abs(fingerprints.alike(*prints) - generalised_jaccard(weights(a), weights(b))) < 0.04


def test_fingerprints_depend_on_the_text_alone(spark):
    texts = ["the same text here", None, "", "THE same text  here", "x", "the same text here", "z " * 100_000]
    rows = spark.createDataFrame([(i % 3 if i else None, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string")
    got = fingerprints.fingerprints(rows.repartition(3))
    want = dict(zip(texts, fingerprints.signatures(pa.array([t or "" for t in texts], pa.large_string()), fingerprints.SAMPLES, 2), strict=True))
    assert sorted(r["fingerprint"] for r in got.collect()) == sorted(want[t].hex() for t in texts)
    assert want["the same text here"] == want["THE same text  here"]
    assert len(want["x"].hex()) == fingerprints.SAMPLES * fingerprints.DIGITS
    assert fingerprints.fingerprints(spark.createDataFrame([], ROWS)).collect() == []


def test_likeness_of_columns_equals_the_plain_one(spark):
    prints = fingerprints.signatures(pa.array(["a b c d e", "a b c d f", "a b", "", "a b c d e"], pa.large_string()), 64, 2)
    pairs = [(a.hex(), b.hex()) for a, b in itertools.product(prints, prints)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == fingerprints.alike(bytes.fromhex(r["a"]), bytes.fromhex(r["b"])) for r in got)


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for i, (doc, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((doc, len(t), t, t[: len(t) - q] + following[:q], following))
    prints = fingerprints.signatures(pa.array([x for r in out for x in r[2:]], pa.large_string()), fingerprints.SAMPLES, 2)
    return sorted((r[0], r[1], hashlib.sha256(r[3].encode()).hexdigest(), a.hex(), b.hex(), fingerprints.alike(a, b), fingerprints.alike(a, c)) for r, a, b, c in zip(out, prints[::3], prints[1::3], prints[2::3], strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 60])
def test_edits_match_brute_force(spark, n):
    rng = random.Random(n)
    texts = [None, "", "é" * 9, "one", "a\U0001f600b" * 11, " ".join(map(str, range(300)))]
    rows = [(i * 3 - 40, rng.choice(texts) if rng.random() < 0.5 else "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 400)))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("key", "range", "edge", "fingerprint", "next_text")})
    got = fingerprints.edit_distances(df.repartition(3))
    assert sorted(map(tuple, got.collect())) == brute_edits(rows)


def test_edits_of_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (5, "x y z x y z"), (5, "x y z x y z"), (5, "other text"), (None, None)]
    got = fingerprints.edit_distances(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 10, 11, 11, 11]
    assert fingerprints.edit_distances(spark.createDataFrame([], ROWS)).collect() == []


def test_near_copies_are_nearer_than_neighbours(spark):
    got = queries.op13_fingerprints(spark, "/root/testdata/sf0.001").where("n_chars > 200").agg(F.min("near_edited"), F.percentile("near_next", 0.9)).first()
    assert got[0] > 0.3
    assert got[1] < 0.2
