"""Operators 1, 2, 4, 8 and the pipeline against brute force, and their defined results for odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelattice.llm import components, lm_scoring, minhash_dedup, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, block long, kept_text string, component string"


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, "k", "c") for i, t in rows], SCHEMA)


def words(rnd, n, size=400):
    return " ".join(rnd.choice(["w", "V", "é"]) + str(rnd.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    passage, out = words(rnd, 60), []
    for i in range(120):
        t = words(rnd, rnd.choice([0, 3, 19, 20, 21, 150]))
        if i % 5 == 0:
            t += "\n" + passage + "  " + words(rnd, 10)
        out.append((i, t))
    base = words(rnd, 200).split()
    for i in range(120, 160):
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(200)] = "z" + str(rnd.random())
        out.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    return out + [(200, None), (201, ""), (202, " \t"), (203, passage + " " + passage), (204, "one"), (205, "one"), (206, "a b c d"), (207, "a b c d"), (208, words(rnd, 8000))]


def kept_by_force(rows, width):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[s : s + width]), (i, s)) != (i, s):
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("width, counters, flush", [(20, 3, 500_000), (5, 3, 50), (20, 0, 500)])
def test_substrings(spark, rows, width, counters, flush):
    """With sketches of one counter, too, where every window is estimated repeated."""
    got = substring_dedup.dedup(table(spark, rows).repartition(5), width=width, counters=counters, flush=flush).drop("kept_text").collect()
    want = kept_by_force(rows, width)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: w[:3] for i, w in want.items()}
    assert any(w[1] for w in want.values())


def test_substrings_of_odd_rows(spark):
    t = " ".join(map(str, range(30)))
    got = substring_dedup.dedup(table(spark, [(3, t), (3, t), (None, t), (9, None)]), columns=["doc_id", "text"]).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"], r["kept_text"]) for r in got) == [(-1, 30, ""), (3, 0, t), (3, 0, t), (9, 0, None)]
    assert substring_dedup.dedup(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_substrings_of_rows_without_an_id(spark):
    """They come behind all others, each text on its own and in blocks of its own, and none is lost."""
    rnd = random.Random(9)
    shared = words(rnd, 30)
    rows = [(5, f"{shared} five")] + [(None, f"{shared} {words(rnd, 25)}") for _ in range(40)] + [(None, shared)] * 2
    got = substring_dedup.dedup(table(spark, rows), columns=["doc_id", "text"]).collect()
    assert sorted(r["n_removed"] for r in got) == [0, *[30] * 42]
    first = substring_dedup.dedup(table(spark, rows[1:]), columns=["doc_id", "text"]).collect()
    whole = [r for r in first if r["n_removed"] == 0]
    # of the texts that hold the passage one is first; two equal rows are one document, so both or none of them
    assert len(whole) == 1 or (len(whole) == 2 and all(r["text"] == shared for r in whole))


def test_sketch_never_underestimates():
    rnd = np.random.default_rng(1)
    x = substring_dedup.mixed(rnd.integers(0, 5000, 4000).astype(np.uint64))
    block = rnd.integers(0, 9, 4000).astype(np.int32)
    parts = [substring_dedup.partial(x[i::4], block[i::4]) for i in range(4)]
    counts = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
    u, n = np.unique(x, return_counts=True)
    often = set(u[n > 1].tolist())
    for counters in (3, 0):
        hit = substring_dedup.estimated(*counts, counters)
        told = set(zip(counts[0][hit].tolist(), counts[1][hit].tolist(), strict=True)) | {p for _, t in parts for p in zip(*(c.tolist() for c in t), strict=True)}
        # every block with a repeated key hears of it
        assert {(k, b) for k, b in zip(x.tolist(), block.tolist(), strict=True) if k in often} <= told
        wrong = {k for k, b in told if k not in often}
        assert len(wrong) < 0.2 * (n == 1).sum() if counters else len(wrong) == (n == 1).sum()
    data = substring_dedup.by_group(np.repeat(np.arange(2), 5), x[:10], block[:10])[1]
    back = substring_dedup.gathered(data, (np.uint64, np.int32))
    assert (back[0] == x[:10]).all() and (back[1] == block[:10]).all()


def test_equal_windows_have_equal_anchors_at_the_same_place():
    rnd = np.random.default_rng(2)
    for width in (1, 2, 5, 20):
        h = rnd.integers(0, 3, 500).astype(np.uint64)
        key, at = substring_dedup.anchors(h, width)
        assert len(key) == len(h) - width + 1 and (np.diff(at) >= 0).all()
        size = max(1, 2 * width // 5)
        seen = {}
        for s in range(len(key)):
            assert s <= at[s] <= s + width - size
            assert seen.setdefault(tuple(h[s : s + width]), (key[s], at[s] - s)) == (key[s], at[s] - s)


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components_by_force(sets, threshold=80):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k, tile", [(4, 512), (5, 4)])
def test_minhash(spark, rows, k, tile, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 2)
    sets = shingle_sets(rows, k)
    want = components_by_force(sets)
    got = minhash_dedup.components(table(spark, rows), k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert len(set(want.values())) < len(want) - 10
    kept = minhash_dedup.near_dedup(table(spark, rows), k=k)
    assert kept.columns == table(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_minhash_keeps_neighbours_apart_that_only_share_a_passage(spark, monkeypatch):
    """Similarities of 0.3 to 0.4 all along a chain and all around a passage make no cluster; near copies among them are found, in tiles of few signatures."""
    rnd, written = random.Random(5), minhash_dedup.written
    monkeypatch.setattr(minhash_dedup, "SIG_TILE", 16)
    monkeypatch.setattr(minhash_dedup, "SIG_BUNDLE", 200)
    monkeypatch.setattr(minhash_dedup, "TILE", 16)
    parts = [words(rnd, 40, 100_000) for _ in range(151)]
    chain = [f"{parts[i]} {parts[i + 1]}" for i in range(150)]
    passage = words(rnd, 40, 100_000)
    around = [f"{words(rnd, 20, 100_000)} {passage} {words(rnd, 20, 100_000)}" for _ in range(150)]
    copies = [t + " end" for t in [*chain[::10], *around[::10]]]
    group = [f"{parts[0]} {words(rnd, 60, 100_000)}"] * 1
    group = [group[0].replace(group[0].split()[i], f"v{i}") for i in range(0, 60, 1)]
    rows = list(enumerate(chain + around + copies + group))
    sent = {}
    monkeypatch.setattr(minhash_dedup, "written", lambda df, name: sent.setdefault(name, written(df, name)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.components(table(spark, rows), k=4).collect()}
    assert got == components_by_force(shingle_sets(rows, 4))
    assert sent["minhash-left"].where("asks").count() > 16
    sizes = sorted(r["count"] for r in sent["minhash-clusters"].groupBy("cluster").count().collect())
    assert sizes[-1] <= len(group) and all(n <= 3 for n in sizes[:-1])


def test_minhash_of_odd_rows(spark):
    t = " ".join(map(str, range(30)))
    got = minhash_dedup.components(table(spark, [(5, t), (4, t), (4, "x y z"), (2, "x y z"), (None, t), (8, t), (8, t)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False), (5, 2, False), (8, 2, False), (8, 2, False)]
    assert minhash_dedup.components(table(spark, [(1, "a")]).limit(0)).count() == 0
    clash = spark.createDataFrame([(1, t, "x", "y"), (2, t, "x", "y"), (None, t, None, None)], "doc_id long, text string, gone_0 string, component_id string")
    assert sorted((r["doc_id"] or 0, r["gone_0"]) for r in minhash_dedup.near_dedup(clash).collect()) == [(0, None), (1, "x")]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (5, 5)]
    up = list(range(500))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {i: root(i) for i in nodes}


def labelled(spark, n=1500):
    rnd = random.Random(7)
    groups, insults = ["greenfolk", "hillmen"], ["blorp", "snarg"]
    docs, labels = [], []
    for i in range(n):
        w = words(rnd, 40, 2000).split()
        toxic = rnd.random() < 0.25
        kind = rnd.randrange(3)
        # an insult or a group alone is harmless
        if toxic:
            w[3], w[9] = rnd.choice(groups), rnd.choice(insults)
        elif kind == 0:
            w[5] = rnd.choice(groups)
        elif kind == 1:
            w[5] = rnd.choice(insults)
        docs.append((i, " ".join(w)))
        labels.append((i, 1 if rnd.random() < 0.5 else 0, int(toxic)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_pairs(spark):
    docs, labels = labelled(spark)
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert right > 0.97
    kept = toxicity.reject(docs, machine)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.score(docs, machine).where("predicted = 0").collect()}


def test_toxicity_pairs_whose_terms_tell_nothing_alone():
    """Each of two terms has the label as often as its absence has; only with the other it decides. A linear model fitted to the same rows cannot tell."""
    rnd = random.Random(4)
    term = lambda w: toxicity.word_terms(w)[0]
    rows = []
    for _ in range(6000):
        one, other = rnd.random() < 0.3, rnd.random() < 0.3
        toxic = rnd.random() < (0.95 if one and other else 0.02 if one or other else 0.418)
        w = [f"w{rnd.randrange(300)}" for _ in range(12)] + ["folk"] * one + ["slur"] * other
        rows.append((np.unique([term(x) for x in w]), int(toxic), one, other))
    counts, totals = np.zeros((2, 1 << toxicity.BUCKET_BITS), np.int32), np.zeros(2)
    for t, y, _, _ in rows:
        counts[y, t] += 1
        totals[y] += 1
    clear, weak = toxicity.select_terms(counts, totals, toxicity.TERMS)
    assert not {term("folk"), term("slur")} & set(clear.tolist())
    terms = np.union1d(clear, toxicity.select_pairs([(t, y) for t, y, _, _ in rows], weak, totals))
    assert {term("folk"), term("slur")} <= set(terms.tolist())
    known = [(np.flatnonzero(np.isin(terms, t)), y) for t, y, _, _ in rows]

    def right(machine):
        held = [(k, one and other) for (k, _), (_, _, one, other) in zip(known, rows, strict=True) if one or other]
        return np.mean([(machine.score(k) >= 0.3) == both for k, both in held])

    assert right(toxicity.fit(known, terms)) > 0.98 and right(toxicity.fit(known, terms, factors=0)) < 0.9


def test_toxicity_score_is_the_sum_over_all_pairs():
    rnd = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(40), 0.3, rnd.normal(size=40), rnd.normal(0, 0.3, (40, 8)))
    for n in (0, 1, 2, 17):
        known = rnd.choice(40, n, replace=False)
        z = m.bias + sum(m.weights[i] for i in known) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(known) for j in known[a + 1 :])
        assert m.score(known) == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_sample_is_bounded_by_documents(spark):
    docs, labels = labelled(spark, 200)
    seen = []
    real = toxicity.fit
    try:
        toxicity.fit = lambda rows, terms: (seen.append(len(rows)), real(rows, terms))[1]
        toxicity.train(docs.union(docs).union(docs), labels, sample=100)
    finally:
        toxicity.fit = real
    assert seen == [100]


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark, 40)
    machine = toxicity.train(docs, labels.limit(0))
    got = toxicity.score(table(spark, [(1, None), (2, ""), (None, "x"), (2, "")]), machine).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    nulls = labels.select(F.lit(None).cast("long").alias("doc_id"), "toxic").union(labels.select("doc_id", F.lit(None).cast("int")))
    assert len(toxicity.train(docs, nulls).terms) == 0
    assert toxicity.score(docs.limit(0), machine).count() == 0


def log_likelihood_by_force(model, words, text):
    """One word after another, with the whole output of the network for each."""
    side, total = words.side, 0.0
    hashes = [int(np.uint64(h).astype(np.int64)) for h in lm_scoring.word_hashes((text or "").encode().split())]
    ids = [0] * lm_scoring.SIDE + [words.id(h) for h in hashes] + [0] * lm_scoring.SIDE
    for i in range(lm_scoring.SIDE, len(ids) - lm_scoring.SIDE):
        around = ids[i - lm_scoring.SIDE : i] + ids[i + 1 : i + 1 + lm_scoring.SIDE]
        h = np.tanh(sum(model["embed"][j][w].astype(float) for j, w in enumerate(around)) + model["hidden0"])
        cls = h @ model["cls"] + model["cls0"]
        mem = model["mem"][ids[i] // side] @ h + model["mem0"][ids[i] // side]
        total += np.log(np.exp(cls)[ids[i] // side] / np.exp(cls).sum()) + np.log(np.exp(mem)[ids[i] % side] / np.exp(mem).sum())
        if ids[i] >= words.first_bucket:
            total += words.log_share[ids[i] - words.first_bucket]
    return total


def test_lm_scores(spark, rows):
    docs = table(spark, rows + [(9001, None), (9002, " \n"), (9002, " \n")])
    words = lm_scoring.vocabulary(docs, "text")
    counts = collections.Counter(w for _, t in rows if t for w in t.encode().split())
    assert len(words.known) == min(len(counts), words.first_bucket - 1) and len(words.known) + 1 + len(words.log_share) <= words.side**2
    by = {int(np.uint64(h).astype(np.int64)): n for h, n in zip(lm_scoring.word_hashes(list(counts)), counts.values(), strict=True)}
    assert sorted((by[h] for h in words.known), reverse=True) == sorted(counts.values(), reverse=True)[: len(words.known)]
    rest = collections.Counter(h % len(words.log_share) for h in by if h not in words.known)
    assert all(words.log_share[b] == pytest.approx(-np.log(max(1, rest[b]))) for b in range(len(words.log_share)))
    coded = lm_scoring.encoded(docs, words, "doc_id", "text")
    model = lm_scoring.train(coded, words.side)
    got = collections.defaultdict(list)
    for r in lm_scoring.score(coded, model, words).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows[::7]:
        assert got[i][0]["n_words"] == len((t or "").encode().split())
        assert got[i][0]["log_likelihood"] == pytest.approx(log_likelihood_by_force(model, words, t), rel=1e-4, abs=1e-6)
    assert [(r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]) for i in (9001, 9002) for r in got[i]] == [(0, 0.0, None)] * 3
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0


def test_lm_vocabulary_grows_with_the_corpus():
    assert [lm_scoring.named_words(n) for n in (0, 1000, 26_000_000, 10**13)] == [64, 140, 4148, 301_621]


def test_lm_beats_word_frequencies_on_documents_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept, unseen = docs.where("doc_id % 10 <> 3"), docs.where("doc_id % 10 = 3")
    words = lm_scoring.vocabulary(kept, "text")
    model = lm_scoring.train(lm_scoring.encoded(kept, words, "doc_id", "text"), words.side)
    coded = lm_scoring.encoded(unseen, words, "doc_id", "text")
    total = lm_scoring.score(coded, model, words).agg(F.sum("log_likelihood")).first()[0]
    count = np.zeros(words.side**2)
    for r in lm_scoring.encoded(kept, words, "doc_id", "text").collect():
        np.add.at(count, lm_scoring.unpacked(r["ids"], words.side), 1)
    log = np.log((count + 1) / (count + 1).sum()) + np.concatenate([np.zeros(words.first_bucket), words.log_share])
    assert total > sum(log[lm_scoring.unpacked(r["ids"], words.side)].sum() for r in coded.collect())


def test_lm_trains_on_every_word(spark, rows, monkeypatch):
    sent, write = [], lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, name: (sent.append((name, t := write(df, name))), t)[1])
    lm_scoring.score_documents(table(spark, rows))
    targets = sum(r["n"] for name, t in sent if name == "lm-sums" for r in t.where("chunk = 0").collect())
    assert targets == sum(len(t.split()) for _, t in rows if t)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_lm_rounds_share_out_the_words(rounds):
    rnd = np.random.default_rng(rounds)
    documents = [rnd.integers(1, 200, n).astype("<u4") for n in (0, 1, 2, 7, 0, 30)]
    flat, size, row, at = lm_scoring.laid_out([d.tobytes() for d in documents], 16)
    assert size.tolist() == [len(d) for d in documents] and flat[at].tolist() == np.concatenate(documents).tolist()
    # neighbours beyond a document's ends are padding
    assert lm_scoring.contexts(flat, at)[0].tolist()[: lm_scoring.SIDE] == [0] * lm_scoring.SIDE and (lm_scoring.contexts(flat, at)[-1][lm_scoring.SIDE :] == 0).all()
    masks = [lm_scoring.in_round(size, row, r, rounds) for r in range(rounds)]
    assert (np.sum(masks, axis=0) == 1).all()


def test_lm_probabilities_add_up_to_one():
    rnd = np.random.default_rng(2)
    m = lm_scoring.initial(16)
    ids = np.pad(rnd.integers(1, 256, 12).astype(np.uint16), lm_scoring.SIDE)
    at = np.arange(lm_scoring.SIDE, lm_scoring.SIDE + 12)
    ctx = lm_scoring.contexts(ids, at)
    one = lm_scoring.log_probabilities(m, ctx, ids[at])
    everything = lm_scoring.log_probabilities(m, np.repeat(ctx[:1], 256, axis=0), np.arange(256).astype(np.uint16))
    assert np.exp(everything).sum() == pytest.approx(1, abs=1e-4) and everything[ids[at[0]]] == pytest.approx(one[0], abs=1e-4)


def test_lm_learns_from_both_sides():
    rnd = np.random.default_rng(3)
    trainer = lm_scoring.Trainer(lm_scoring.initial(64))
    for _ in range(150):
        ctx = rnd.integers(1, 40, (512, 2 * lm_scoring.SIDE)).astype(np.uint16)
        # the word between follows from one on either side
        target = ((ctx[:, 1] % 2) * 64 + (ctx[:, 2] % 2) + 1).astype(np.uint16)
        trainer.step(ctx, target)
    assert lm_scoring.log_probabilities(trainer.m, ctx, target).mean() > -0.3


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = corpus_pipeline.drop_near_duplicates(spark, clean, sf_dir)
    want = set(components_by_force(shingle_sets(rows, 5)).values())
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == want
    cut = corpus_pipeline.cut_repeats(spark, single, sf_dir)
    assert cut.schema.names == docs.columns
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    force, texts = kept_by_force(left, 20), dict(left)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: f[3] if f[1] else texts[i] for i, f in force.items()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if force[i][1])
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == want


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    """Nulls in every column, repeated rows, and columns whose names the stages might use themselves."""
    rnd = random.Random(1)
    clean = words(rnd, 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_0 string, kept_text string, n_words int, component_id long, block long, c0 string, _id long, length int"
    more = ("x", "x", 1, 2, 3, "x", 4, 5)
    rows = [(i, t, "en", "s", len(t), *more) for i, t in ((1, clean), (1, clean), (2, clean + " end"), (3, words(rnd, 50)), (None, words(rnd, 30)), (4, ""))] + [(5, None, None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    docs = spark.createDataFrame(rows, schema)
    (docs.limit(0) if empty else docs).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, None, 0), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    (labels.limit(0) if empty else labels).write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema.names == docs.schema.names, name
        assert (now.count() == 0) == empty
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert not out
        return
    # 2 is a near copy of 1, whose two equal rows both stay; the null and empty texts are one end token each
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 0, 1, 1, 3, 4, 5]
    assert sorted(r["length"] for r in out)[:3] == [1, 1, 1]
