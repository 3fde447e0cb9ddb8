"""Scoring, classification, neighbours and chat formatting."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from geoscore.llm import chat, mixing, neighbours, toxicity

from .conftest import ODD

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_unigram_base_and_scores(documents):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng.randint(1, 200), rng) for _ in range(60)), "Été À B b"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in mixing.score_texts(documents(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(tokens):
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in counts for w in t), total)
        assert r.base_score == np.float64(base) or abs(r.base_score - base) < 1e-9 * abs(base)
        size = len((texts[i] or "").encode()) + 1
        assert r.score < 0 and abs(r.bits_per_byte * size + r.score / math.log10(2)) < 1e-6 * size
    assert mixing.score_texts(documents([])).count() == 0


def test_scores_beside_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (2**60 + 1, "a b"), (5, "c"), (5, "c"), (5, "d e")]
    got = mixing.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (5, 2), (5, 2), (5, 3), (2**60 + 1, 3)]


def plain_bits(bits, odds):
    """Bits of one text's decisions, one at a time; weights move at the end of each stretch."""
    weights, total, at, stretch = mixing.WEIGHTS.astype(float), 0.0, 0, 256
    while at < len(bits):
        push, seen = np.zeros((4, 3)), np.full(4, 64.0)
        for i in range(at, min(at + stretch, len(bits))):
            x = np.array([o[i] for o in odds], float) / 10
            gate = (x[1] != 0) + 2 * (x[2] != 0)
            p = 1 / (1 + math.exp(-weights[gate] @ x))  # of a one
            total -= math.log2(p if bits[i] else 1 - p)
            push[gate] += (bits[i] - p) * x
            seen[gate] += 1
        weights = weights + mixing.RATE * push / seen[:, None]
        at, stretch = at + stretch, min(2 * stretch, 4096)
    return total


def test_mixing_against_one_decision_at_a_time():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 300, 9000, 256, 770, 14000])
    bits = rng.integers(0, 2, sizes.sum()).astype(np.uint8)
    odds = [(rng.integers(-25, 25, sizes.sum()) + 12 * bits - 6) * rng.integers(0, 2, sizes.sum()) for _ in range(3)]
    got = mixing.mixed(sizes, bits, [o.astype(np.float32) for o in odds])
    ends = np.cumsum(sizes)
    for d, (a, b) in enumerate(zip(ends - sizes, ends)):
        want = plain_bits(bits[a:b], [o[a:b] for o in odds])
        assert abs(got[d] - want) < 1e-4 * want
        # A text's cost is the same whatever it is scored with.
        alone = mixing.mixed(sizes[d : d + 1], bits[a:b], [o[a:b].astype(np.float32) for o in odds])
        assert np.isclose(alone[0], got[d], rtol=1e-6)


def test_model_is_a_probability():
    """With any log odds at the nodes of the code, the probabilities of all bytes sum to one."""
    code = mixing.prefix_code(np.arange(256) ** 2 % 97)
    assert abs((2.0 ** -code.lengths.astype(float)).sum() - 1) < 1e-12
    odds = np.random.default_rng(3).integers(-30, 30, (3, 256)).astype(np.float32)
    bits = mixing.mixed(code.lengths, code.bits, [o[code.nodes] for o in odds])
    assert abs((2.0**-bits).sum() - 1) < 1e-5


def test_blocks_and_parts_leave_scores_alone(documents, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng.randint(0, 400), rng) for _ in range(120)] + [*ODD]
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    whole = {r.doc_id: r for r in mixing.score_texts(documents(texts)).select(columns).collect()}
    for name, size in (("BLOCK_BYTES", 4000), ("PART_BYTES", 9000), ("BATCH_BYTES", 700)):
        monkeypatch.setattr(mixing, name, size)
    for r in mixing.score_texts(documents(texts).repartition(3)).select(columns).collect():
        want = whole[r.doc_id]
        assert r[:4] == want[:4] and np.allclose(r[4:], want[4:], rtol=1e-6)


def test_tokens_and_pairs_of_words():
    texts = [b"", b" ", b"Ab  ab\x0bc\x1cd ", b"\xc3\x89 e\x00f", b"ab"]
    found, number, document = mixing.tokens(texts)
    got = [[] for _ in texts]
    for n, d in zip(number, document):
        got[d].append(found[int(n)].as_py())
    assert got == [t.lower().split() for t in texts]
    assert b"" in found.to_pylist() and len(set(found.to_pylist())) == len(found)
    keys = np.concatenate([mixing.context(*mixing.joined([t])[:1], np.array([0]), "word") << np.uint64(8) | mixing.joined([t])[0] for t in texts])
    for (values, index), (plain, places) in [(mixing.by_word(keys), mixing.encoded(keys))]:
        assert (values[index] == keys).all() and (plain[places] == keys).all() and sorted(values) == sorted(plain)


def test_pairs_and_tokens_are_listed_by_sorting_and_arrays():
    texts = [b"The cat sat on the mat. " * 5, b"", b"a cat", "Größe und Größe".encode(), "".join(map(chr, range(256))).encode()]
    learned = np.repeat([True, False, True, False, True], [len(t) + 1 for t in texts])
    for kind in mixing.CONTEXTS:
        values, part, pair = mixing.pairs(texts, kind, 5)
        for some in (learned, ~learned, learned | True, learned & False):
            keys, parts, n = mixing.counted_pairs(texts, some, kind, 5)
            assert keys.dtype == np.uint64 and (keys == values).all() and (parts == part).all()
            assert (n == np.bincount(pair[some], minlength=len(keys))).all()
    found, _, _ = mixing.tokens(texts)
    order, part = mixing.dealt(found, 3)
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(order)]
    back = [mixing.of_lines(t.as_py()).to_pylist() for t in mixing.lines(found.take(order), cuts)]
    words = found.to_pylist()
    assert sorted(order.tolist()) == list(range(len(words))) and (np.diff(part) >= 0).all()
    assert back == [[words[i] for i in order[a:b]] for a, b in zip(cuts, cuts[1:])]
    assert mixing.of_lines(b"").to_pylist() == [b""] and mixing.of_lines(b"\na").to_pylist() == [b"", b"a"]


def test_costs_of_a_block_with_turned_odds():
    """Odds turned once per pair cost what the branches of every decision cost."""
    texts = [b"aab ab aab", b"", b"abba baab " * 400]
    code = mixing.prefix_code(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    odds, inputs = {}, []
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    bits = np.concatenate([code.bits[code.begins[c] : code.begins[c] + code.lengths[c]] for c in data])
    for k, kind in enumerate(mixing.CONTEXTS):
        values, part, pair = mixing.pairs(texts, kind, 1)
        lengths = code.lengths[values & np.uint64(255)]
        own = (np.arange(lengths.sum()) * 37 % 61 - 30).astype(np.int8)
        odds[k] = zstandard.ZstdCompressor().compress(own.tobytes())
        begins = np.cumsum(lengths) - lengths
        inputs.append(np.concatenate([own[begins[p] : begins[p] + lengths[p]] for p in pair]).astype(np.float32))
    sizes = [code.lengths[np.frombuffer(t + b"\xff", np.uint8)].sum() for t in texts]
    assert np.allclose(mixing.block_costs(texts, odds, 1, code), mixing.mixed(np.array(sizes), bits, inputs), rtol=1e-6)


def test_learning_lowers_the_cost(documents):
    rng = random.Random(6)
    texts = [prose(150, rng) for _ in range(80)]
    rows = mixing.score_texts(documents(texts)).filter("held_out").collect()
    assert rows and all(r.bits_per_byte < 3.2 for r in rows)


def counted_odds(texts, code):
    """Counts of both outcomes by (kind, context, steps so far), held in a dictionary; log odds of a byte's step."""
    counts = Counter()

    def steps(text):
        data = text.lower() + b"\xff"
        for i, b in enumerate(data):
            start = max([j + 1 for j in range(i) if data[j] <= 32], default=0)
            path = tuple(code.bits[code.begins[b] : code.begins[b] + code.lengths[b]].tolist())
            for k in range(len(path)):
                yield [(c, path[:k]) for c in ((3, data[max(i - 3, 0) : i]), (5, data[max(i - 5, 0) : i]), ("word", data[start:i]))], path[k]

    for t in texts:
        for keys, bit in steps(t):
            counts.update((key, bit) for key in keys)

    def inputs(text):
        odds = [[np.rint(np.log((counts[k, 1] + 0.4) / (counts[k, 0] + 0.4)) * 10) for k in keys] for keys, _ in steps(text)]
        return np.clip(np.array(odds, np.float32).T, -127, 127), np.array([bit for _, bit in steps(text)])

    return inputs


def test_scores_by_exact_counts(documents):
    rng = random.Random(8)
    texts = [prose(rng.randint(1, 60), rng) for _ in range(40)] + ["", "a\n b"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    learned = [t.encode() for t, h in zip(texts, held) if not h]
    code = mixing.prefix_code(np.bincount(np.frombuffer(b"".join(t.lower() + b"\xff" for t in learned), np.uint8), minlength=256))
    inputs = counted_odds(learned, code)
    for r in mixing.score_texts(documents(texts)).collect():
        odds, bits = inputs(texts[r.doc_id].encode())
        want = mixing.mixed(np.array([len(bits)]), bits.astype(np.uint8), list(odds))[0]
        assert abs(r.score / -math.log10(2) - want) < 1e-3


def test_the_model_grows_with_the_texts():
    """More contexts than any fixed table of 2^20 slots holds keep counts of their own."""
    data = np.random.default_rng(5).integers(97, 123, (300, 6000)).astype(np.uint8)
    texts = [bytes(d) for d in data]
    keys, part, pair = mixing.pairs(texts, 3, 7)
    assert len(keys) > 3 << 17 and len(set(part.tolist())) == 7
    assert len(keys) == len({(t + b"\xff")[max(i - 3, 0) : i + 1] if i >= 3 else (i, t[: i + 1]) for t in texts for i in range(len(t) + 1)})
    assert len(mixing.pairs(texts, "word", 7)[0]) > 1 << 20


def test_counts_beyond_32_bits():
    code = mixing.prefix_code(np.ones(256, int))
    keys = np.array([[7 << 8 | 97], [7 << 8 | 98]] * 2, np.uint64).ravel()
    odds, begins, lengths, pair = mixing.path_odds(keys, np.array([2**32 - 1, 1, 2**32 - 1, 1], np.uint32), code)
    path = odds[begins[pair[0]] :][: lengths[pair[0]]]
    taken = code.bits[code.begins[97] :][: code.lengths[97]].astype(int) * 2 - 1
    assert pair[0] == pair[2] and (path * taken == 127).all()


def toxic_set(rng, n):
    bad = ["idiotic", "scummy", "trashy"]
    texts, labels = [], []
    for _ in range(n):
        words = prose(rng.randint(10, 120), rng).split()
        y = rng.random() < 0.3
        for _ in range(4 if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


def test_classifier_learns(spark, documents):
    texts, y = toxic_set(random.Random(7), 900)
    docs = documents(texts + ODD)
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)] + [(3, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, toxicity.contract_labels(labels))
    rows = toxicity.predictions(toxicity.score(docs, model)).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id < len(y)]
    hits = sum(p and t for p, t in held)
    assert 2 * hits / (sum(p for p, _ in held) + sum(t for _, t in held)) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_classifier_learns_from_all_labelled_rows(spark, documents, monkeypatch):
    texts, y = toxic_set(random.Random(11), 9_500)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id bigint, toxic int")
    apart = labels.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("apart")).collect()
    taught = Counter(y[r.doc_id] for r in apart if not r.apart)
    assert taught[0] > 3000
    seen, start = [], toxicity.started
    monkeypatch.setattr(toxicity, "started", lambda s, counts, n: seen.append(n) or start(s, counts, n))
    monkeypatch.setattr(toxicity, "PART_ROWS", 2000)  # several units an epoch
    model = toxicity.fit(documents(texts), labels)
    assert [list(n) for n in seen] == [[taught[0], taught[1]]]
    logits = toxicity.Scorer(model).logits([t.encode() for t in texts]) + model.shift
    found, y = toxicity.sigmoid(logits) >= toxicity.CUT, np.array(y)
    assert 2 * (found & (y == 1)).sum() / (found.sum() + y.sum()) > 0.95


def test_long_texts_are_learned_from_in_pieces():
    long = " ".join(["word"] * (toxicity.PIECE + 5))
    u = toxicity.unit([(long.encode(), 1), (b"", 0)], toxicity.Settings())
    assert [len(c) for c in u.coded] == [toxicity.PIECE, 5, 0] and list(u.labels) == [1, 1, 0]


def test_training_lowers_the_loss():
    texts, y = toxic_set(random.Random(3), 300)
    rows = [(t.encode(), v) for t, v in zip(texts, y)]

    def loss(epochs):
        model = toxicity.train(rows, toxicity.Settings(epochs=epochs))
        logits = toxicity.Scorer(model).logits([t for t, _ in rows])
        return np.logaddexp(0, -logits * (2 * np.array(y) - 1)).mean()

    assert loss(6) < loss(2) < loss(0)


def test_classifier_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = documents(ODD)
    scores = [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()]
    assert len(scores) == len(ODD) and max(scores) < 1e-6
    ones = spark.createDataFrame([(4, 1), (5, 1)], "doc_id bigint, toxic int")
    assert min(r.score for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect()) > 0.99
    assert toxicity.score(documents([]), toxicity.fit(documents([]), labels)).count() == 0


def test_best_cut():
    assert toxicity.best_cut(np.array([3.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([0, 0])) == 0.0


def test_best_cut_of_counted_logits():
    rng = np.random.default_rng(5)
    logits, y = rng.integers(-6, 7, 400) / 4, rng.integers(0, 2, 400)
    steps, at = np.unique(logits, return_inverse=True)
    counted = toxicity.best_cut(steps, np.bincount(at, y), np.bincount(at).astype(float))
    assert counted == toxicity.best_cut(logits, y)


def brute_nearest(rows, query, k):
    valid = [
        (i, np.array(v, float)) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    asked = [(i, v) for i, v in valid if query(i)]
    out = {}
    for i, q in asked:
        near = sorted((-float((q * v).sum()), j) for j, v in valid if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, 8)).astype(np.float32).tolist()
    vectors[100:400] = [vectors[100]] * 300  # one vector many times over
    vectors += [None, [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [None], [float("inf")] + [0.0] * 7]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank string")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=7, shard=150, block=11).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_nearest(rows, lambda i: i % 20 == 0, 7)
    few = neighbours.nearest(df.limit(3), F.lit(True), k=7).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {2}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_equidistant_vectors_build_a_shallow_tree():
    """One-hot vectors and a simplex: every distance is the same."""

    def depth(node):
        return 1 if len(node) == 1 else 1 + max(depth(node[3]), depth(node[4]))

    rng = np.random.default_rng(8)
    simplex = np.eye(2500) - 1 / 2500
    for vectors in (np.eye(3000), simplex, np.ones((2000, 4)), rng.integers(0, 2, (3000, 3)).astype(float)):
        tree = neighbours.Tree(vectors)
        assert depth(tree.root) <= 5


def test_neighbours_of_equidistant_vectors(spark):
    rows = [(i, [1.0 if d == i % 40 else 0.0 for d in range(40)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard=700, block=20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_nearest(rows, lambda i: i % 20 == 0, 20)


def test_ranks_by_the_measure_itself(spark):
    """Sums that differ in their last bit alone are ranked by the sum in order of components."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    rows = [(i, (base * (1 + rng.integers(-2, 3, 24) * 2.0**-52)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=20, shard=90).collect()

    def score(q, v):
        total = 0.0
        for x, y in zip(q, v):
            total += x * y
        return total

    vectors = dict(rows)
    for query in (0, 100, 200, 300):
        ranked = sorted((-score(vectors[query], v), i) for i, v in rows if i != query)[:20]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [(i, -s) for s, i in ranked] == [(i, s) for _, i, s in got]


def test_relaxed_search_keeps_its_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 4
    vectors = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    exact = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect()}
    loose = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=10, factor=1.3).collect()
    assert sum((r.query_id, r.vec_id) in exact for r in loose) / len(exact) >= 0.9


CONTROL = "</s>[INST] ok [/INST]"
TALKS = {
    1: [("system", "be \\ brief"), ("user", CONTROL), ("assistant", CONTROL)],
    2: [("user", ""), ("assistant", ""), ("[ROLE x", "[/ROLE]\\"), ("assistant", "é👩\n<s>")],
    3: [("user", "only")],
    4: [("assistant", "a"), ("assistant", "b"), ("assistant", "aab")],
}


def test_chat_round_trip(spark):
    rows = [(c, k, r, t, "z") for c, talk in TALKS.items() for k, (r, t) in enumerate(talk)]
    rows += [(9, 0, None, None, "z"), (9, 0, None, None, "z"), (None, 1, "user", "lost", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    talks = TALKS | {9: [("", ""), ("", "")], None: [("user", "lost")]}
    assert set(got) == set(talks)
    for c, talk in talks.items():
        turns = "".join(f"{r}\n{t}\n" for r, t in talk)
        loss = "".join(t for r, t in talk if r == "assistant")
        assert got[c].n_turns == len(talk)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert all(not r.rewrites for r in formatted.collect())
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_rewriting_templates_are_detected():
    def forgetful(turns):
        return "|".join(t if k >= len(turns) - 2 else "..." for k, (_, t) in enumerate(turns))

    talk = [("user", "first"), ("assistant", "second"), ("user", "third")]
    assert chat.render(talk, forgetful).rewrites == [2]
    steady = chat.render(talk)
    assert [steady.text[a:b] for a, b in steady.bodies] == ["first", "second", "third"]
    assert steady.spans[0][1] == steady.spans[1][0] and steady.spans[-1][1] == len(steady.text)
