"""Corpus operators against plain loops, on small tables with nulls, ties, repeats and blank texts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import divergence, hilbert, hmm, langid, mixing, packing, simhash, topk, toxicity, urls
from tapeloom.llm.common import hook
from tapeloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i % 37} and{i}" for i in range(120))


def documents(spark):
    """Copies, near copies, nulls in every column, blank, tiny and long texts, repeated rows."""
    near = BASE.replace("and60", "other")
    rows = [
        (1, BASE, "en", "a", 5), (2, near, "en", "a", 5), (3, BASE, "en", None, None), (4, None, "en", "b", 0), (5, "", None, "b", 0), (6, " \t\n", "fr", "b", 3),
        (7, "One", "fr", "c", 3), (8, "one", "fr", "c", 3), (9, "Zwei  Wörter", "de", "c", 12), (None, "lost row without id", "en", "c", 1),
        (10, "long " * 3000 + "end", "en", "d", 15003), (11, "x y z " * 30, "en", "d", 1), (11, "x y z " * 30, "en", "d", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("_h", F.lit(1)).withColumn("fp", F.lit("clash")).withColumn("size", F.lit(None).cast("int"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prints(texts):
    import xxhash

    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def test_simhash_components(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    fps = prints([t for _, t in rows])
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], fps[i], least[group[i]]) for i in range(len(rows)))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [16384, 8])
def test_gray_trees_find_every_link(spark, most):
    """Small cuts force the deeper levels."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = [int(b) for b in base]
    for b in base[:30]:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            values.append(x)
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    df = spark.createDataFrame([(v, v) for v in values], "fp long, u long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, most)).collect()}
    group = {v: v for v in values}
    for a, b in itertools.combinations(values, 2):
        if bin((a ^ b) % 2**64).count("1") <= 3 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if g == old else g for k, g in group.items()}
    assert {v: roots.get(v, v) for v in values} == group


def test_long_text_in_pieces(monkeypatch):
    from tapeloom.llm import common

    whole = simhash.text_fingerprint([BASE.encode() * 3])
    monkeypatch.setattr(common, "PIECE", 10)
    assert (simhash.text_fingerprint([BASE.encode() * 3]) == whole).all()


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 4, 7, 9, 10, 11] and kept.where("doc_id is null").count() == 1


def test_near_copies_by_exact_similarity(spark):
    """Components of all pairs of five-word similarity 0.8 or more, and of no others, by plain loops."""
    rng = np.random.default_rng(6)
    texts = []
    for g in range(30):
        base = [f"w{g}x{rng.integers(500)}" for _ in range(150)]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6):
            for _ in range(2):
                other = list(base)
                for i in rng.choice(150, edits, replace=False):
                    other[i] = f"new{rng.integers(10**6)}"
                texts.append(other)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if x == old else x for x in group]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(set(group)) > 60 and {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(group)


def test_one_large_group_of_near_copies(spark):
    """2000 copies of one text with up to seven changed words: components as by all pairs."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    sets, texts = [], []
    for _ in range(2000):
        own = list(base)
        for i in rng.choice(150, int(rng.integers(2, 8)), replace=False):
            own[i] = f"n{rng.integers(10**7)}"
        texts.append(" ".join(own))
    for t in texts:
        words = t.split()
        sets.append({" ".join(words[i : i + 5]) for i in range(146)})
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    at = np.zeros((2000, len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        at[i, [number[x] for x in s]] = 1
    common = at @ at.T
    size = at.sum(axis=1)
    parent = np.arange(2000)
    hook(parent, *np.nonzero(9 * common >= 4 * (size[:, None] + size[None, :])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(parent.tolist())
    assert 100 < len(want) < 1900 and {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_rows_that_share_or_lack_an_id(spark):
    """Unlike texts with one doc_id both stay; near copies leave one row, with or without ids; equal rows leave one."""
    near = BASE.replace("and60", "other")
    far = " ".join(f"far{i}" for i in range(90))
    lone = " ".join(f"lone{i}" for i in range(60))
    rows = [(1, BASE, "x"), (1, far, "x"), (1, far, "y"), (2, far, "x"), (None, near, "x"), (None, lone, "x"), (None, lone + " once", "x"), (None, None, "x"), (7, "", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _h string")).collect()
    got = Counter((r["doc_id"], (r["text"] or "").removesuffix(" once")) for r in kept)
    assert got == Counter([(1, BASE), (1, far), (None, lone), (7, "")])


def test_hilbert_curve_steps_to_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = list(itertools.product(range(1 << bits), repeat=dims))
        df = spark.createDataFrame(points, ", ".join(f"x{i} int" for i in range(dims)))
        rows = df.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(points)))
        assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(spark):
    docs = documents(spark)
    got = hilbert.shards(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and [r["hilbert"] for r in own] == sorted(r["hilbert"] for r in own)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert hilbert.shards(empty(spark)).count() == 0
    assert hilbert.box(docs.where("doc_id < 10"), hilbert.shards(docs.where("doc_id < 10"))).count() == 8


def test_ids_at_both_ends_of_a_long(spark):
    docs = spark.createDataFrame([(-9 * 10**18, "a", "en", "s", 1), (9 * 10**18, "b", "en", "s", 1), (0, "c", None, "s", 1), (None, "d", "en", "s", 1)], SCHEMA)
    got = hilbert.shards(docs).collect()
    assert {(r["doc_id"], r["slot"]) for r in got} == {(-9 * 10**18, 0), (0, 0), (None, 0), (9 * 10**18, 0)} and len({r["shard"] for r in got}) == 4


def test_numbers_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "²é")], "doc_id long, text string")
    rng = np.random.default_rng(0)
    model = langid.Model(["en", "fr"], np.ones(langid.WIDTH), rng.normal(size=(langid.WIDTH, 2)), 1.0)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[1] == "und" and got[2] in ("en", "fr")


def test_top_k_of_any_size_and_repeated_ids(spark):
    """Components beyond doubles' whole numbers, rows that share an id, equal rows: as plain integers say."""
    rows = [(i, [float(i % 7), -1.5, 2.0**30 if i % 9 == 0 else 0.25]) for i in range(60)] + [(20, [3.0, 1.0, 2.0**40]), (20, [3.0, 1.0, 2.0**40]), (7, [1.0, 1.0, 1.0]), (-40, [5e18, 1.0]), (3, [-7e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [[math.floor(64 * v) for v in x] for _, x in rows]
    ends = 2**63 - 1
    want = Counter()
    for q, (name, _) in enumerate(rows):
        if name % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], whole[i])), rows[i][0]) for i in range(len(rows)) if i != q]
            for k, (s, i) in enumerate(sorted(scores)[:20]):
                want[(name, k + 1, i, max(-ends - 1, min(ends, -s)))] += 1
    got = Counter(tuple(r) for r in topk.top_k(df).collect())
    key = lambda c: Counter({(q, k, s): 0 for q, k, _, s in c}.keys())
    assert key(got) == key(want) and sum(got.values()) == sum(want.values())
    assert {g for g in got if abs(g[3]) < ends} == {w for w in want if abs(w[3]) < ends}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 16)).round(2)
    x[7] = x[20] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (520, [float("nan")] * 16), (540, [1.0, None]), (560, [float("inf")]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    whole = np.floor(64 * x).astype(int)
    want = set()
    for q in range(0, 300, 20):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    few = topk.top_k(df.where("vec_id < 4")).collect()
    assert len(few) == 3 and topk.top_k(df.limit(0)).count() == 0


def test_impact_search_stops_on_proof_only():
    rng = np.random.default_rng(5)
    vectors, queries = rng.integers(-30, 30, (400, 12)), rng.integers(-30, 30, (9, 12))
    found = topk.ImpactIndex(vectors).search(queries, 5, np.full(9, -(2**60)))
    for j, rows in enumerate(found):
        best = np.argsort(-(vectors @ queries[j]), kind="stable")[:5]
        assert set(best) <= set(rows)


def test_mix(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, block=8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(w for s, w in weight.items() if s not in target)
        full = [s for s in names if s not in target and weight[s] * level >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
    target |= {s: weight[s] * level for s in names if s not in target}
    by_doc = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[by_doc[r["doc_id"]]]) and r["source_size"] == sizes[by_doc[r["doc_id"]]]
        taken[by_doc[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 12 for s in names)
    assert Counter(mixing.mix(docs, block=8).collect()) == Counter(rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_rows_hold_the_taken_words(spark):
    docs = documents(spark).where("doc_id is not null")
    parts = mixing.mixed(docs, block=8)
    assert parts.columns == docs.columns
    words = Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in parts.collect():
        assert r["text"].strip() in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].encode().split())
    taken = Counter()
    for r in mixing.mix(docs, block=8).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken


def test_permutations():
    for size in (1, 2, 3, 17, 1000):
        x = np.arange(size)
        assert sorted(mixing.permute(x, np.full(size, size), np.full(size, 99))) == list(range(size))


def test_severity_separates_toxic_texts(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"plain{rng.integers(60)}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[3], words[9] = "vileword", f"foulst{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if i % 10 == 0 else 1, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, "a vileword, FOULST9!"), (1001, "plain1 plain2"), (1002, None), (1003, "")], "doc_id long, text string").withColumn("grade", F.lit(9))
    got = {r["doc_id"]: r for r in toxicity.severities(docs, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(400))
    assert got[1000]["toxic"] and not got[1001]["toxic"] and not got[1002]["toxic"] and len(got) == 404
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.severities(docs, none).count() == 404 and toxicity.severities(docs.limit(0), none).count() == 0


def test_thresholds_share_weights():
    grades = np.repeat([0, 1, 2], 40)
    columns = np.concatenate([np.zeros(40, int), np.ones(40, int), np.full(40, 2)])
    w, thresholds = toxicity.fit(np.arange(120), columns, grades, 3)
    assert thresholds[0] < thresholds[1] and w[0] < w[1] < w[2]


def test_best_ends_against_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 40), n, replace=False)), rng.integers(1, 6, n)
        padding = lambda ends: sum(int(c) * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        ends = packing.best_ends(lengths, counts, lengths * counts, k)
        best = min(padding([*some, lengths[-1]]) for m in range(min(k, n)) for some in itertools.combinations(lengths[:-1], m))
        assert len(ends) <= k and padding(ends) == best


def test_pack(spark):
    docs = documents(spark)
    rows = packing.pack(docs, 3, 64).collect()
    assert len(rows) == docs.count() and len({(r["bucket"], r["batch"], r["place"]) for r in rows}) == len(rows)
    assert all(r["length"] + r["padding"] == r["bucket_end"] and r["padding"] >= 0 for r in rows)
    for (_, _), own in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"])), key=lambda r: (r["bucket"], r["batch"])):
        own = list(own)
        assert len(own) == 1 or len(own) * own[0]["bucket_end"] <= 64
    assert packing.pack(empty(spark)).count() == 0


def test_pack_long_texts_with_least_padding(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(2000, 40_000, 40)]
    lengths += lengths[:7] + [0, 0, 3]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(docs, 4, 100_000).collect()
    own = sorted(max(n, 1) for n in lengths)
    ends = sorted(set(own))
    cost = {(i, j): sum(ends[j] - n for n in own if ends[i] < n <= ends[j]) for j in range(len(ends)) for i in range(j)}
    least = [sum(e - n for n in own if n <= e) for e in ends]
    for _ in range(3):
        least = [min([least[j]] + [least[i] + cost[i, j] for i in range(j)]) for j in range(len(ends))]
    assert sum(r["padding"] for r in rows) == least[-1] + sum(n == 0 for n in lengths) and max(r["bucket_end"] for r in rows) == max(lengths)


def test_language_model(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = hmm.language_model(docs, states=2, head=20, rounds=1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    train = [words(r["text"]) for r in rows if not held(r["doc_id"])]
    counts = Counter(w for t in train for w in t)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: np.log10((c + 1) / (total + kinds + 1))
    want = sorted((r["doc_id"] or -1, len(words(r["text"])) + 1, sum(w in counts for w in words(r["text"])) + 1, round(float(sum(log(counts[w]) for w in words(r["text"])) + log(len(train))), 6)) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == total and np.isfinite(r["score"]) for r in got)
    assert hmm.language_model(empty(spark)).count() == 0


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0))
    texts = [np.array([0, 2, 1, 1]), np.array([1, 2])]
    ids, sizes = np.concatenate(texts), np.array([4, 2])
    logs = hmm.forward(model, ids, np.array([0, 4]), sizes)
    start, moves, emits, _ = hmm.expected(model, ids, np.array([0, 4]), sizes)
    s, m, e = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for text, log in zip(texts, logs):
        paths = list(itertools.product(range(2), repeat=len(text)))
        p = [model.start[q[0]] * np.prod([model.move[a, b] for a, b in zip(q, q[1:])]) * np.prod([model.emit[w, z] for w, z in zip(text, q)]) for q in paths]
        assert log == pytest.approx(np.log(sum(p)))
        for q, w in zip(paths, np.array(p) / sum(p)):
            s[q[0]] += w
            for a, b in zip(q, q[1:]):
                m[a, b] += w
            for x, z in zip(text, q):
                e[x, z] += w
    assert np.allclose(start, s) and np.allclose(moves, m) and np.allclose(emits, e)


def test_rare_words_have_classes(spark):
    states = [(b"a", 0, 4), (b"a", 1, 1), (b"b", 1, 2), (b"c", 0, 1), (b"d", 0, 1), (b"d", 1, 1), (b"e", 0, 3), (b"e", 1, 3), (b"f", 2, 9)]
    counts = [(w, *[float(sum(n for v, j, n in states if v == w and j == k)) for k in range(3)]) for w in sorted({w for w, _, _ in states})]
    got = hmm.word_classes(spark.createDataFrame(counts, "word binary, k0 double, k1 double, k2 double"), 3).collect()
    whole, own = Counter(), {}
    for w, k, n in states:
        whole[k] += n
        own.setdefault(w, []).append((k, n))
    best = {w: min(x, key=lambda kn: (-kn[1] / whole[kn[0]], kn[0])) for w, x in own.items()}
    want = {w: (sum(n for _, n in own[w]), k + 1 if n >= 2 and 2 * n >= sum(m for _, m in own[w]) else 0) for w, (k, n) in best.items()}
    assert {bytes(r["word"]): (r["c"], r["class"]) for r in got} == want and len({c for _, c in want.values()}) == 4

    texts = ["x A b x e", "", "zz f f x zz", None, "d d", "x " * 300 + "c " * 40]
    rows = spark.createDataFrame([(i, False, t.encode() if t is not None else None) for i, t in enumerate(texts)], "doc_id long, held boolean, text binary")
    encoded = hmm._encode(rows, hmm.Counts([b"x"], np.array([9]), 6, 50, 8)).withColumn("row", F.monotonically_increasing_id())
    classes = spark.createDataFrame([(w, c, k) for w, (c, k) in want.items()], "word binary, c long, class int")
    masses = np.array([3.0, 5.0, 7.0, 9.0])
    for r in hmm._with_classes(encoded, classes, masses, 2).collect():
        words = (texts[r["doc_id"]] or "").lower().encode().split()
        tail = [want[w] for w in words if w in want]
        assert list(r["ids"]) == [0 if w == b"x" else 3 + want[w][1] if w in want else 2 for w in words] + [1]
        assert (r["rest"], r["seen"]) == (sum(w != b"x" for w in words), len(tail))
        assert r["logs"] == pytest.approx(sum(np.log10(c + 1) for c, _ in tail)) and r["shares"] == pytest.approx(sum(np.log10((c + 1) / masses[k]) for c, k in tail))


def test_words_outside_the_head_tell_states(spark):
    """Two topics: a marker each in the head, all other words outside it; one state gives the base."""
    rng = np.random.default_rng(2)
    topic = lambda k: " ".join("pq"[k] if i % 4 == 0 else f"{'pq'[k]}{n}" for i, n in enumerate(rng.integers(0, 60, 40)))
    docs = spark.createDataFrame([(i, topic(i % 2)) for i in range(160)], "doc_id long, text string")
    got = hmm.language_model(docs, states=2, head=2).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + (6 + 10 * np.log10(2)) * len(got)
    alone = hmm.language_model(docs, states=1, head=10).where("held_out").collect()
    assert all(r["score"] == pytest.approx(r["base_score"], rel=1e-3) for r in alone)


def test_every_training_word_and_text_is_learned(spark, monkeypatch):
    """Against plain rounds in which each word is a symbol: texts in many units, long ones, most words not told apart by the start."""
    monkeypatch.setattr(hmm, "UNIT", 2000)
    monkeypatch.setattr(hmm, "_TOKENS", 500)
    rng = np.random.default_rng(4)
    topic = lambda k, n: " ".join(f"{'pqr'[k]}{x}" if x % 3 else f"All{x % 5}" for x in (rng.zipf(1.3, n) % 400))
    rows = [(i, topic(i % 3, 1500 if i % 8 == 0 else int(rng.integers(1, 60)))) for i in range(60)] + [(100, None), (101, ""), (None, "once p1"), (3, "p1 q1 p1")]
    got = hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=3, head=6, rounds=2).collect()

    texts = [[*(t or "").lower().encode().split(), b""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(texts, held) if not h for w in t)
    names = sorted({w for t in texts for w in t}, key=lambda w: (-c[w], w))
    number, c = {w: i for i, w in enumerate(names)}, np.array([c[w] for w in names])
    tokens, whole = c.sum(), c.sum() + (c > 0).sum() + 1
    texts = [np.array([number[w] for w in t]) for t in texts]
    train = [t for t, h in zip(texts, held) if not h]
    assert max(map(len, train)) > 1400 and whole - tokens > 200
    pairs = np.zeros((len(hmm.LAGS), 7, 7))
    for t in train:
        for i, d in enumerate(hmm.LAGS):
            for a, b in zip(t, t[d:]):
                pairs[i, min(a, 6), min(b, 6)] += 1
    rest = whole - (c[:6] + 1).sum()
    first = hmm.first_model(pairs, np.append(c[:6] + 1, rest) / whole, 3)
    model = hmm.Model(first.start, first.move, np.vstack([first.emit[:6], (c[6:, None] + 1) / rest * first.emit[6]]))
    for _ in range(2):
        sums = [hmm.expected(model, t, np.array([0]), np.array([len(t)])) for t in train]
        start, moves, emits = (sum(x[i] for x in sums) for i in range(3))
        state = emits.sum(axis=0) / tokens
        emit = (emits + state) / (state * whole)
        assert np.allclose(emit.sum(axis=0), 1 + ((c == 0).sum() - 1) / whole)  # one share of all words never seen
        model = hmm.Model((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit)
    want = [(r[0] or -1, len(t), hmm.forward(model, t, np.array([0]), np.array([len(t)]))[0] / np.log(10)) for r, t in zip(rows, texts)]
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in got)
    for (i, n, score), (j, m, exact) in zip(found, sorted(want), strict=True):
        assert (i, n) == (j, m) and score == pytest.approx(exact, rel=1e-4)


def test_words_seen_once_tell_states(spark):
    """Two topics by a marker; every other word is seen once, yet is likelier in the state of its only text."""
    text = lambda i: " ".join("pq"[i % 2] if n % 4 == 0 else f"w{i}x{n}" for n in range(40))
    docs = spark.createDataFrame([(i, text(i)) for i in range(160)], "doc_id long, text string")
    got = hmm.language_model(docs, states=2, head=2).where("not held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in got) > (0.8 * 10 * np.log10(2) + 30 * 0.1) * len(got)


def test_languages(spark):
    rng = np.random.default_rng(3)
    make = {"aa": ["tha", "ing", "wh"], "bb": ["oui", "eau", "é"], "cc": ["sch", "ung", "ß"]}
    rows = [(i, " ".join("".join(rng.choice(make[lang], 3)) for _ in range(30)), lang) for i in range(300) for lang in [list(make)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 -- 3", "bb"), (902, "", None), (None, "thaing", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _, _ in held) and np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.languages(docs.limit(0)).count() == 0 and langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_gram_counts_of_long_texts(monkeypatch):
    text = "Hällo 12 wörld" * 5
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.gram_counts(text) == whole).all()


def test_url_rules_and_models(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "https://x.org/", "x.org", "/", "org/", "allow"),
        (3, "https://x.org?q=/", "x.org", "", None, None), (4, "http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        (5, "http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), (6, "http://b.com/de/x?y", "b.com", "/de/x", "com/de/", "block"),
        (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        (10, "http://example.org://x/es/", "example.org:", "//x/es/", None, None),
    ]
    more = [(100 + i, f"http://h{i}.{'com/fr' if i % 2 else 'com/de'}/{i}") for i in range(200)]
    pages = spark.createDataFrame([r[:2] for r in rows] + more, "page_id long, url string").withColumn("host", F.lit(0))
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for page, _, host, path, rule, verdict in rows:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    ruled = [r for k, r in got.items() if k >= 100]
    assert np.mean([(r["p_allow"] >= 0.5) == (r["verdict"] == "allow") for r in ruled]) > 0.95
    assert {r["verdict"] for r in urls.judge(pages.where("page_id = 8")).collect()} == {"allow"} and urls.judge(pages.limit(0)).count() == 0


def test_character_model_against_counts():
    counts = {b"": (4, 2, {97: 3, 98: 1}), b"a": (2, 1, {98: 2})}
    p0 = (1 + 2 / 256) / 6
    p1 = (2 + p0) / 3
    model = urls.Model(counts)
    first = (3 + 2 / 256) / 6
    last = (0 + 2 / 256) / 6
    assert model.log_likelihood(b"ab") == pytest.approx(np.log(first) + np.log(p1) + np.log(last))


def test_url_contexts_beyond_the_cached_ones(spark):
    rng = np.random.default_rng(3)
    bits = ["ab", "ba", "shop", "news", "x1", "é", "-", "/", "p?q="]
    made = lambda: "".join(rng.choice(bits, int(rng.integers(1, 9))))
    rows = [(i, f"http://{'abc'[i % 3]}.{('com/fr', 'com/de', 'net/en')[int(rng.integers(3))]}/{made()}") for i in range(400)] + [(900, None), (901, ""), (1, "ba/ba")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    ruled = urls.ruled(pages).withColumn("h", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS))).collect()
    seen = {"allow": Counter(), "block": Counter()}
    for r in ruled:
        if r["_by_rule"] and r["h"]:
            line = b"\x02" + r["url"].encode() + b"\x03"
            seen[r["_by_rule"]].update((line[i - n : i], line[i]) for i in range(1, len(line)) for n in range(min(5, i) + 1))

    def log(verdict, line):
        total = 0.0
        for i in range(1, len(line)):
            p = 1 / 256
            for n in range(min(5, i) + 1):
                after = {b: c for (w, b), c in seen[verdict].items() if w == line[i - n : i]}
                if n and sum(after.values()) < urls.SEEN:
                    break
                p = (after.get(line[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
            total += np.log(p)
        return total

    whole = sorted(urls.judge(pages).collect(), key=str)
    parts = sorted(urls.judge(pages, cached=25).collect(), key=str)
    for rows_ in (whole, parts):
        assert len(rows_) == len(rows)
    by_id = {r["page_id"]: r for r in parts if r["page_id"] != 1}
    for r in (r for r in whole if r["page_id"] != 1):
        other = by_id[r["page_id"]]
        assert r["ratio"] == pytest.approx(other["ratio"], abs=1e-9) and r["p_allow"] == pytest.approx(other["p_allow"], abs=1e-6) and r["verdict"] == other["verdict"]
    for i, url in rows[:40] + rows[400:402]:
        if i != 1:
            line = b"\x02" + (url or "").encode() + b"\x03"
            assert by_id[i]["ratio"] == pytest.approx((log("allow", line) - log("block", line)) / (len(line) - 1), abs=1e-9)


def loops(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_base_counts(spark):
    extra = spark.createDataFrame([(20, "a b\na b\n\n \na b", "en", "s", 1), (21, "a b c x a b c y # $", "en", "s", 1), (22, "a a a a", None, None, None)], SCHEMA)
    docs = documents(spark).select("doc_id", "text", "lang").unionByName(extra.select("doc_id", "text", "lang")).withColumn("n_words", F.lit("clash"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = divergence.judge(docs).collect()
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *loops(r["text"])) for r in docs.collect())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert divergence.judge(empty(spark)).count() == 0


def test_divergence_rejects_other_histograms(spark):
    rng = np.random.default_rng(8)
    common, rare = [f"{a}{b}" for a in "bcdf" for b in "aeiou"], [f"{a}{b}{c}" for a in "ghjk" for b in "aeiou" for c in "lmnp"]
    plain = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(200)), "xx") for i in range(60)]
    odd = [(100, " ".join(w.upper() + "!!" for w in rng.choice(rare, 200)), "xx"), (101, " ".join(w + "%%%" for w in rng.choice(rare, 200)), "xx")]
    got = {r["doc_id"]: r["kept"] for r in divergence.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]


def test_pipeline_on_small_and_empty_tables(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} == ({1, 10} & {r["doc_id"] for r in out} if name == "some" else set())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "pack"]


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
