"""Near duplicates, components, repeats and decontamination against brute force."""

import hashlib
import random

import numpy as np

from geoscore.llm import components, decontaminate, neardup, repeats

from .conftest import ODD

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def sets(text, k):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k):
    grams = [sets(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if grams[i] and grams[j] and 100 * both >= 80 * (len(grams[i]) + len(grams[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(g) for g in grams]


def test_groups_equal_brute_force(documents):
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(8):
        base = prose(rng.randint(4, 160), rng)
        texts += [base.upper(), *(edited(base, rng.randint(0, 8), rng) for _ in range(12))]
    for k in (4, 5):
        rows = neardup.groups(documents(texts), shingle=k).collect()
        got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows}
        labels, sizes = brute_components(texts, k)
        assert [got[i] for i in range(len(texts))] == [(c, n, c == i) for i, (c, n) in enumerate(zip(labels, sizes))]


def test_groups_of_ids_and_nothing(spark, documents):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "z z y x w v"), (2, "z z y x w v"), (3, "z z y x w v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.groups(docs).collect())
    # The two texts of id 1 tie its classes together.
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert neardup.groups(documents([])).count() == 0


def test_a_large_group_of_edited_copies(documents, monkeypatch):
    """Pairs of one base around the threshold, met in several small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    base = prose(140, rng)
    texts = [edited(base, rng.randint(3, 7), rng) for _ in range(150)] + [edited(base, 14, rng) for _ in range(50)]
    rows = neardup.groups(documents(texts), shingle=4).collect()
    labels, _ = brute_components(texts, 4)
    assert len(set(labels)) > 20
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == labels


def test_the_bound_keeps_every_link():
    """Counts by class never rule out a pair that links, whatever the sizes and sides."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets_ = [rng.choice(base, int(rng.integers(1, 900)), replace=False) for _ in range(40)]
    sets_ += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 12, dtype=np.uint64)]) for s in sets_]
    sets_.append(np.repeat(base[:1], 1))
    counts = [neardup.class_counts(s) for s in sets_]
    n, label = np.array([len(s) for s in sets_]), np.arange(len(sets_))
    left = rng.random(len(sets_)) < 0.5
    for side in (np.ones(len(sets_), bool), left):
        found = set(map(frozenset, zip(*neardup.may_link(counts, n, label, side, 80))))
        for i, x in enumerate(sets_):
            for j, y in enumerate(sets_[:i]):
                both = len(np.intersect1d(x, y))
                linked = 100 * both >= 80 * (len(x) + len(y) - both)
                if linked and (side.all() or left[i] != left[j]):
                    assert frozenset((i, j)) in found
    many = np.repeat(base[:2], 400)  # beyond a byte's count
    assert neardup.may_link([neardup.class_counts(many)] * 2, np.array([800, 800]), np.arange(2), np.ones(2, bool), 80)[0]


def test_texts_of_one_id_keep_their_links(spark):
    rng = random.Random(2)
    one, two = prose(60, rng), prose(60, rng)
    rows = [(7, one), (7, two), (8, edited(one, 1, rng)), (9, edited(two, 1, rng)), (10, prose(60, rng))]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.label for r in found} == {x: root(x) for x in linked}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.view(np.int8)]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(5)
    shared = prose(120, rng)
    texts = list(ODD)
    for _ in range(12):
        cut = rng.randint(0, 200)
        texts.append(prose(40, rng) + shared[cut : cut + rng.randint(150, 400)] + "é" + prose(30, rng))
    return [*texts, edited(shared, 3, rng), shared, prose(80, rng) * 2]


def removed(docs):
    rows = repeats.digests(repeats.remove_repeats(docs)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_repeats_equal_brute_force(documents, monkeypatch):
    texts = repeat_texts()
    want = brute_repeats(texts, repeats.LENGTH)
    got = removed(documents(texts))
    assert [got[i] for i in range(len(texts))] == want
    # Long texts in slices, and anchors with many segments by their windows, change nothing.
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    got = removed(documents(texts))
    assert [got[i] for i in range(len(texts))] == want
    assert repeats.remove_repeats(documents([])).count() == 0


def test_columns_sort_suffixes():
    """Repeats found column by column are those that comparing all pairs finds."""
    rng = np.random.default_rng(2)
    rows, length, left = 60, 6, 10
    columns = rng.integers(0, 2, (30, rows)).astype(np.int16)
    group = rng.integers(0, 3, rows)
    valid = np.ones((left + 1, rows), bool)
    found = repeats.repeated_windows(columns, group, valid, length)
    for c in range(left + 1):
        for i in range(rows):
            same = [
                j for j in range(rows)
                if j != i and group[i] == group[j] and (columns[c : c + length, i] == columns[c : c + length, j]).all()
            ]
            assert found[c, i] == bool(same)


def test_decontamination(spark, documents):
    rng = random.Random(9)
    items = [prose(n, rng) for n in (3, 5, 20, 60)] + [None, "", "..."]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id bigint, text string, key int")
    long_item = items[3].split()
    texts = [
        *ODD,
        f"{prose(30, rng)}. {items[2].upper()}! {prose(9, rng)}",
        " ".join([*long_item[:30], "inserted", *long_item[30:]]),
        " ".join(long_item[:40]),
        items[0],
        f"x {items[1]} y",
        items[2],
        items[2],
        prose(300, rng),
    ]
    docs = documents(texts)
    n = len(ODD)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(n, 2), (n + 1, 3), (n + 3, 0), (n + 4, 1), (n + 5, 2), (n + 6, 2)}
    assert got[(n, 2)] == got[(n + 3, 0)] == got[(n + 4, 1)] == 1.0 and 0.8 <= got[(n + 1, 3)] < 1
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.leaks(documents([]), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_long_items_in_many_pieces(spark, documents):
    """Copies that no single alignment holds a fifth of, and blocks in another order."""
    rng = random.Random(10)
    names = iter(f"{rng.choice(WORDS)}{i}" for i in range(10**6))
    items = [[next(names) for _ in range(n)] for n in (200, 500)]
    around = [next(names) for _ in range(80)]
    texts, pairs = [], set()
    for k, item in enumerate(items):
        n = len(item)

        def pieces(m):
            return [item[n * p // m : n * (p + 1) // m] for p in range(m)]

        inserted = [w for x in pieces(n // 40) for w in [*x, next(names)]]
        for body in (inserted, sum(pieces(5)[::-1], []), sum(pieces(4)[::-1], [])):
            pairs.add((len(texts), k))
            texts.append(" ".join([*around, *body, *around]))
        texts.append(" ".join([*around, *(w for x in pieces(n // 10) for w in [*x, next(names)]), *around]))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(documents(texts), bench).collect()}

    def grams(tokens):
        return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}

    want = {}
    for d, t in enumerate(texts):
        tokens = t.split()
        for k, item in enumerate(items):
            g = grams(item)
            windows = [grams(tokens[s : s + len(item)]) for s in range(max(len(tokens) - len(item), 0) + 1)]
            best = max(len(g & w) / len(g | w) for w in windows)
            if best >= 0.8:
                want[d, k] = best
    assert set(want) == pairs and got == want


def test_near_block_values_cover_the_radius():
    """Any two fingerprints within the radius share a listed block value."""
    rng = random.Random(2)
    flips, width = decontaminate.near_values(), 64 // decontaminate.BLOCKS
    for _ in range(500):
        bits = rng.sample(range(64), decontaminate.RADIUS)
        parts = [sum(1 << (b % width) for b in bits if b // width == k) for k in range(decontaminate.BLOCKS)]
        assert any(p in flips for p in parts)
