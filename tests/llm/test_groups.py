"""Clustering, spelling variants and the Jaccard join: odd rows, ties, hot groups, bounds."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import centroids, components, jaccard, spelling

from .conftest import LONG, ODD, table
from .test_queries import brute_links, brute_spelling


# ---- centroids

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, v string, `key` string, d string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", "k", "d") for i, v in rows], VECTORS)


def brute_clusters(rows, clusters, rounds, size, scale=1024):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        inside = [[] for _ in at]
        for _, v in kept:
            inside[nearest(v)].append(v)
        at = [[sum(c) // len(vs) for c in zip(*vs)] if vs else c for vs, c in zip(inside, at)]
    out = [(i, j := nearest(v), far(v, at[j])) for i, v in kept]
    total = sum(d for _, _, d in out)
    return sorted((str(i), j, d, sum(e for _, k, e in out if k == j), total,
                   hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in out)


def clustered(df, **options):
    got = centroids.cluster(df, **options).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clusters_of_odd_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.5, -0.25, 0.0, 0.1, 2.0]) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    usable = list(rows)
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [None] + [1.0] * 3),
             (105, [float("nan")] + [1.0] * 3), (106, [float("-inf")] + [1.0] * 3)]
    for partitions in (1, 5):
        got = clustered(vectors(spark, rows).repartition(partitions), clusters=6, rounds=4, size=4)
        assert got == brute_clusters(rows, 6, 4, 4)
    assert len(got) == len(usable)


def test_clusters_few_equal_and_no_vectors(spark):
    few = [(i, [float(i), 0.0]) for i in range(3)]
    assert clustered(vectors(spark, few), size=2) == brute_clusters(few, 8, 10, 2)
    same = [(i, [0.5, -0.5]) for i in range(40)]  # all tie: the smallest number wins, the others stay empty
    got = clustered(vectors(spark, same), size=2)
    assert got == brute_clusters(same, 8, 10, 2) and {r[1] for r in got} == {0}
    empty = centroids.cluster(vectors(spark, []))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "cluster"]


def test_clusters_refuse_what_distances_cannot_hold(spark):
    with pytest.raises(Exception, match="64 bits"):
        clustered(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), size=2)


def test_bounds_exclude_no_nearest():
    draw = np.random.default_rng(5)
    for spread in (3, 40, 4000):
        x, c, p = (draw.integers(-spread, spread, (n, 5)) for n in (400, 7, 4))
        number, best, made = centroids.nearest(x, centroids._roots(x, p), c, centroids._roots(c, p))
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        assert made.max() <= 7
    x = np.concatenate([draw.integers(0, 50, (200, 5)) + 10_000 * k for k in range(7)])
    c = np.array([x[200 * k] for k in range(7)])
    number, _, made = centroids.nearest(x, centroids._roots(x, c), c, centroids._roots(c, c))
    assert (number == np.arange(1400) // 200).all() and made.mean() < 1.5  # far groups are told apart by bounds


# ---- spelling


def spelled(df, **options):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect())


def test_spelling_odd_rows(spark, odd, empty):
    assert spelled(odd) == brute_spelling(ODD)
    assert spelled(empty) == []
    assert spelled(odd, least_count=1) == brute_spelling(ODD, least=1)


def test_spelling_runs_chains_ties_and_letters(spark):
    counts = {
        "aaaaaaa": 700, "aaaaaaaa": 140, "aaaaaaaaa": 28, "aaaaaaaab": 5,  # insertions into runs, a chain of forms
        "colour": 5, "colaur": 25, "colxur": 25, "coloùr": 25, "Colour": 1, "colours": 6, "colou×r": 6, "colour÷": 6,
        "ÀÉÎõü÷": 9, "ÀÉÎõüÿ": 60, "abcdef": 5, "abcde": 500, "bcdefg": 30,
    }
    documents = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    documents += [(None, "colour, colour; 9colour_colourĀcolour"), (50, None), (50, "colour")]
    got = spelled(table(spark, documents))
    assert got == brute_spelling(documents)
    forms = {r[0]: r for r in got}
    assert forms["aaaaaaaaa"][2] == "aaaaaaa" and forms["aaaaaaaaa"][4] == 2
    assert forms["colaur"][1] is None and forms["abcdef"][1] is None


def test_spelling_counts_in_pieces(spark, odd, monkeypatch):
    assert [r for rs in spelling._runs("Ab" * 5) for r in rs] == ["ab" * 5]
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "One two, three-four fivesixseven eight 9 ten×"
    assert [r for rs in spelling._runs(text) for r in rs] == ["one", "two", "three", "four", "fivesixseven", "eight", "ten×"]


def test_spelling_random_words_agree_with_brute_force(spark):
    draw = random.Random(11)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 8))) for _ in range(700)]
    documents = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(700)], k=80))) for i in range(150)]
    assert spelled(table(spark, documents)) == brute_spelling(documents)


def test_spelling_refuses_a_ratio_that_allows_circles(spark, odd):
    with pytest.raises(ValueError):
        spelling.variants(odd, ratio=1)


# ---- Jaccard join


def near_texts(draw, groups, copies, length, edits):
    out = []
    for _ in range(groups):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(length)] = f"x{draw.randint(0, 10**6)}"
            out.append(" ".join(words))
    return out


def joined(df, **options):
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_groups(df, **options).collect()), key=str)


def test_jaccard_odd_rows(spark, odd, empty):
    assert joined(odd) == brute_links(ODD)
    assert jaccard.near_groups(empty).count() == 0


def test_jaccard_borders_of_the_threshold(spark):
    base = [f"t{i}" for i in range(40)]
    documents = [(0, " ".join(base[:12])), (1, " ".join(base[:11])), (2, " ".join(base[:10])), (3, " ".join(base[:9]))]
    documents += [(10, "a b"), (11, "A B"), (12, "a b c"), (13, "b a"), (14, "a"), (15, "a a a a"), (16, "a a a")]
    documents += [(20 + i, " ".join(base[i:])) for i in range(5)]
    got = joined(table(spark, documents))
    assert got == brute_links(documents)
    assert ("1", 9, 0) in got and ("2", 8, 2) in got  # 9 of 10 shingles link, 8 of 9 do not


@pytest.mark.parametrize("piece, frequent", [(4096, 6), (16, 6), (16, 10**9)])
def test_jaccard_random_texts_agree_with_brute_force(spark, monkeypatch, piece, frequent):
    """Chains, groups near the threshold, a passage in a third of all texts, hot tokens cut in blocks."""
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PAIRS", 32)
    draw = random.Random(13)
    texts = near_texts(draw, 3, 60, 150, 4) + near_texts(draw, 20, 4, 60, 2) + near_texts(draw, 60, 1, 30, 0)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [t + " " + passage if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += texts[:30]
    documents = [(draw.choice([None, i, i]), t) for i, t in enumerate(texts)]
    assert joined(table(spark, documents)) == brute_links(documents)


def test_jaccard_tree_prunes_and_loses_no_pair():
    draw = random.Random(17)
    texts = near_texts(draw, 40, 12, 90, 3)
    sets = [jaccard.token_set(t) for t in texts]
    token = np.concatenate([s[:10] for s in sets])
    member = np.repeat(np.arange(len(sets)), 10)
    size = np.array([len(s) for s in sets])[member]
    order = np.lexsort((member, size, token))
    token, member, size = token[order].view(np.int64), member[order], size[order]
    order = np.argsort(token, kind="stable")
    token, member, size = token[order], member[order], size[order]
    bits = np.array([jaccard._bitmap(s) for s in sets])[member]
    parities = [jaccard._parities(s) for s in sets]
    u, v, _ = jaccard.candidates(token, size, bits, [parities[m] for m in member], member, np.arange(len(sets)), 90, False)
    found = {tuple(sorted((int(member[a]), int(member[b])))) for a, b in zip(u, v)}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common) and set(sets[i][:10]) & set(sets[j][:10]):
                assert (j, i) in found
    x, _ = jaccard._Tree(token, size, bits).leaf_pairs(90)
    leaves = -(-len(token) // jaccard.LEAF)
    assert len(x) < leaves * (leaves + 1) / 2 / 10  # nine of ten leaf pairs are never visited


def test_parities_bound_the_difference():
    draw = random.Random(19)
    for _ in range(200):
        a = np.unique(np.array([draw.getrandbits(64) for _ in range(draw.choice([5, 240, 300, 700]))], np.uint64))
        b = np.unique(np.concatenate([a[: draw.randint(0, len(a))], np.array([draw.getrandbits(64)], np.uint64)]))
        x, y = jaccard._parities(a), jaccard._parities(b)
        bound = jaccard._differing(int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y))
        assert bound <= len(np.setxor1d(a, b))


def test_words_in_pieces(monkeypatch):
    whole = jaccard.token_set(LONG)
    monkeypatch.setattr(jaccard, "TEXT_PIECE", 1000)
    assert (jaccard.token_set(LONG) == whole).all()


def test_components_of_a_hot_centre(spark):
    """A centre with many neighbours, a chain, a loop, repeated and null edges."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9000), (7, 0), (None, 4)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(41)}}
    assert components.components(df.where(F.lit(False))).count() == 0


# ---- training samples


def test_training_rows_are_bounded_with_a_hot_key(spark):
    from adlens.llm.labelled import training_rows

    hot = 1
    documents = [(hot, f"text {i}") for i in range(5000)] + [(i, f"other {i}") for i in range(2, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    found = []
    for partitions in (1, 7):
        docs = table(spark, documents).repartition(partitions)
        found.append(sorted(map(tuple, training_rows(docs, labels, "quality", 10).collect())))
    assert found[0] == found[1] and 0 < len(found[0]) <= 10
    whole = training_rows(table(spark, documents), labels, "quality", 1000).collect()
    assert len(whole) == len({r.key for r in whole}) and {r.text for r in whole if r.key == hot} <= {
        min((t for k, t in documents if k == hot), key=lambda t: hashlib.sha256(t.encode()).hexdigest())}


@pytest.mark.parametrize("length", [0, 1, 1024, 6144, 6145, 9000, 12_288, 18_432, 40_000])
def test_dictionary_blocks_span_the_text(spark, length):
    from adlens.llm import quality

    text = "".join(chr(0x100 + i // 200) for i in range(length))
    pieces = spark.createDataFrame([(text,)], "text string").select(quality.blocks("text")).first()[0]
    if length <= quality.BLOCKS * quality.BLOCK_BYTES:
        assert "".join(pieces) == text
    else:
        assert all(len(p) == quality.BLOCK_BYTES for p in pieces) and text.endswith(pieces[-1])
        gaps = [text.index(b[0]) - text.index(a[0]) for a, b in zip(pieces, pieces[1:])]
        assert max(gaps) - min(gaps) <= 400


def test_passages_under_large_arrow_types(spark, odd):
    from adlens.llm import suffix

    whole = sorted(map(str, suffix.passage_report(odd.select("doc_id", "text")).collect()))
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert sorted(map(str, suffix.passage_report(odd.select("doc_id", "text")).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
