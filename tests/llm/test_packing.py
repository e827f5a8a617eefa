import random

from embedlens.llm import packing


def plain_best_fit(items, capacity, per_source):
    """The tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for length, source, cluster in items:
        able = [
            (b["left"], i) for i, b in enumerate(bins)
            if b["left"] >= length and sum(s == source for s, _ in b["in"]) < per_source and all(c != cluster for _, c in b["in"])
        ]
        i = min(able)[1] if able else len(bins)
        if not able:
            bins.append({"left": capacity, "in": []})
        out.append((i, len(bins[i]["in"])))
        bins[i]["left"] -= length
        bins[i]["in"].append((source, cluster))
    return out


def test_against_plain_best_fit():
    for seed in range(12):
        rng = random.Random(seed)
        hot = seed % 3
        items = [
            (rng.randint(0, 60), 0 if rng.random() < 0.4 else rng.randint(1, 600), 0 if hot and rng.random() < 0.3 else rng.randint(1, 300 if hot == 2 else 10**9))
            for _ in range(400)
        ]
        items.sort(key=lambda x: -x[0])
        assert packing.pack(items, 100, 2) == plain_best_fit(items, 100, 2)


def test_documents(docs_of):
    rng = random.Random(0)
    docs = [(i, " ".join(["w"] * rng.choice([0, 3, 20, 90, 250]) + [str(i % 40)])) for i in range(200)]
    rows = packing.pack_documents(docs_of(docs), capacity=100, shard=60).collect()
    by_bin, words = {}, {}
    for r in rows:
        by_bin.setdefault((r.shard, r.bin), []).append(r)
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    text = dict(docs)
    assert words == {i: len(t.split()) for i, t in docs}
    for own in by_bin.values():
        assert sum(r.n_words for r in own) <= 100
        assert len({text[r.doc_id] for r in own}) == len(own)
        assert all(sum(r.doc_id % 3 == s for r in own) <= packing.PER_SOURCE for s in range(3))
        assert sorted(r.position for r in own) == list(range(len(own)))


def test_odd_rows(odd, none):
    assert packing.pack_documents(none).count() == 0
    rows = packing.pack_documents(odd).collect()
    assert sum(r.n_words for r in rows if r.doc_id == 4) == 30_000 and sum(r.doc_id == 5 for r in rows) == 2
    assert len({r.doc_id for r in rows}) == 9


def test_places_do_not_depend_on_partitions(docs_of):
    """Also with repeated rows, ties of length, and a row that is there more often than copies are numbered at once."""
    rng = random.Random(4)
    docs = [(i % 150, " ".join(["w"] * rng.choice([1, 3, 20, 90, 250]))) for i in range(200)] + [(7, "a b c")] * 50 + [(None, None)] * 3
    got = []
    for parts in (1, 2, 7):
        rows = packing.pack_documents(docs_of(docs, parts), capacity=100, shard=60).collect()
        got.append(sorted(map(tuple, rows), key=str))
    assert got[0] == got[1] == got[2] and sum(r[0] == 7 for r in got[0]) >= 50


def test_copies_are_numbered_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 4)
    for n in (1, 4, 5, 8, 9):
        rows = packing.pack_documents(docs_of([(1, "a b")] * n)).collect()
        assert len(rows) == n and len({(r.bin, r.position) for r in rows}) == n and len({r.bin for r in rows}) == n


def test_clusters_of_near_duplicates(docs_of):
    """Clusters as given, repeated rows of them included, keep their members apart; the others conflict with nothing."""
    rng = random.Random(5)
    docs = [(i, " ".join([f"w{i}"] * rng.choice([0, 3, 20, 90, 250]))) for i in range(120)]
    frame = docs_of(docs)
    clusters = frame.selectExpr("doc_id", "doc_id div 4 AS cluster").where("doc_id >= 20")
    clusters = clusters.unionAll(clusters)
    rows = packing.pack_documents(frame, capacity=100, clusters=clusters).collect()
    cluster = {i: i // 4 if i >= 20 else -i - 1 for i, _ in docs}
    order = sorted(rows, key=lambda r: (r.bin, r.position))
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) == sum(max(1, -(-len(t.split()) // 100)) for _, t in docs)
    bins: dict = {}
    for r in order:
        bins.setdefault(r.bin, []).append(r)
    for own in bins.values():
        assert len({cluster[r.doc_id] for r in own}) == len(own) and sum(r.n_words for r in own) <= 100
        assert [r.n_words for r in own] == sorted((r.n_words for r in own), reverse=True)
