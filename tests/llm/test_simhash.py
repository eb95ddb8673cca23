import numpy as np
import pytest
import xxhash

from logfold.llm import simhash as S


def brute_fp(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    group = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min(group[j] for j in np.nonzero(near[i])[0])
            if least < group[i]:
                group[i], changed = least, True
    least = {}
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


@pytest.mark.parametrize("options", [{}, {"bucket_limit": 2}, {"words_per_shingle": 5, "radius": 5, "blocks": 8, "agree": 3}])
def test_against_brute_force(spark, sf_dir, odd, odd_rows, options):
    k, radius = options.get("words_per_shingle", 3), options.get("radius", 2)
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(r[0], r[1]) for r in odd_rows] + real
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(real, "doc_id long, text string"))
    fps = [brute_fp(t, k) for _, t in rows]
    expected = sorted(zip(map(str, [i for i, _ in rows]), fps, map(str, brute_components([i for i, _ in rows], fps, radius)), strict=True))
    got = [(str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in S.near_duplicates(docs, **options).collect()]
    assert sorted(got) == expected


def test_whole_input_with_clashing_columns(odd, odd_rows, empty):
    assert S.near_duplicates(odd).count() == len(odd_rows)
    assert S.near_duplicates(empty).count() == 0
    assert S.one_of_each(empty).count() == 0
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    # 2 repeats 1; 3, 5 and the null row are as empty as ... the least id among them is 3.
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 20])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (200, 4)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 1] ^ flips[:, 2], base ^ flips[:, 3]]))
    starts = np.array([0, 1, 3, 66, 131, 400])
    bucket = np.searchsorted(starts, np.arange(len(fps)), "right")
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (bucket[:, None] == bucket[None, :])
    i, j = S.linked(fps, starts, radius, chunk=100)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(map(tuple, np.argwhere(np.triu(near, 1)).tolist()))


def test_frequent_keys_are_split_without_losing_links(spark):
    """Thousands of fingerprints that share 32 bits, some of them within two bits of each other."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 1500, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 32, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]) | np.uint64(0xABCDEF01 << 32))
    ids = list(range(len(fps)))
    want = brute_components(ids, fps, 2)
    rows = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long")
    for limit in (300, 1 << 20):
        found = {r.node % (1 << 64): r.rep for r in S.components(S.links(rows, 2, 4, 2, limit)).collect()}
        got = [found.get(int(f), int(f)) for f in fps]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(0, len(ids), 7) for j in ids)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)], "u long, v long")
    found = {r.node: r.rep for r in S.components(edges).collect()}
    assert len(found) == 303 and len({found[i] for i in range(301)}) == 1 and found[1000] == found[1001] != found[0]


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def edited(text, rng, n):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


def test_similar_documents_recall_and_precision(spark, empty):
    """Pairs at 0.8 and more are found in nine of ten cases, far ones never, whole groups of near copies too."""
    rng = np.random.default_rng(7)
    from .conftest import prose

    rows, pairs, far = [], [], []
    for i in range(300):
        base = prose(1000 + i, 250)
        copy = edited(base, rng, int(rng.integers(0, 30)))
        rows += [(2 * i, base), (2 * i + 1, copy)]
        s = jaccard(base, copy)
        if s >= 0.8:
            pairs.append(2 * i)
        if s < 0.5:
            far.append(2 * i)
    group = prose(5, 300)
    rows += [(10_000 + i, edited(group, rng, 2)) for i in range(200)]
    found = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 30 and len(far) > 30
    assert sum(found[i] == found[i + 1] for i in pairs) / len(pairs) >= 0.9
    assert not any(found[i] == found[i + 1] for i in far)
    assert {found[i] for i, _ in rows if i >= 10_000} == {10_000}
    # The same with buckets that are dealt out in rounds.
    small = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=16, tile=8).collect()}
    assert {small[i] for i, _ in rows if i >= 10_000} == {10_000} and sum(small[i] == found[i] for i in small) / len(small) > 0.99
    assert all(found[2 * i] == 2 * i for i in range(300))
    assert S.similar_documents(empty).count() == 0


def altered(seed, n_words, n_edits):
    from .conftest import prose

    base = prose(seed, n_words)
    return base, edited(base, np.random.default_rng(seed), n_edits)


def groups(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in S.similar_documents(docs, **options).collect()}


def test_every_pair_just_above_the_similarity_is_linked(spark):
    """Recall between 0.8 and 0.85 alone, and at exactly 0.8."""
    rows, near = [], []
    for i in range(300):
        base, copy = altered(20_000 + i, 250, 5 + i % 3)
        rows += [(2 * i, base), (2 * i + 1, copy)]
        if 0.8 <= jaccard(base, copy) < 0.85:
            near.append(2 * i)
    # 84 words have 80 shingles; 20 more at the end make 80 of 100.
    for i in range(300, 340):
        base = " ".join(f"w{i}x{j}" for j in range(104))
        rows += [(2 * i, base), (2 * i + 1, " ".join(base.split()[:84]))]
        assert jaccard(rows[-2][1], rows[-1][1]) == 0.8
        near.append(2 * i)
    found = groups(spark, rows)
    assert len(near) > 100 and [i for i in near if found[i] != found[i + 1]] == []


def test_large_groups_lose_no_link(spark):
    """Documents that are near one member of a large group of near copies only, with all sizes of buckets."""
    from .conftest import prose

    rng = np.random.default_rng(11)
    base = prose(77, 400)
    members = [edited(base, rng, 2) for _ in range(150)]
    apart = [edited(members[i], rng, 7) for i in range(60)]
    rows = list(enumerate(members + apart))
    near = np.array([[jaccard(a, b) >= 0.8 for b in members] for a in apart])
    some = [150 + i for i in range(60) if 0 < near[i].sum() <= 2]
    assert len(some) > 10
    for options in ({"bucket_limit": 16, "tile": 8, "rounds": 0},):
        found = groups(spark, rows, **options)
        assert {found[i] for i in range(150)} == {0} and [i for i in some if found[i] != 0] == []


def test_documents_below_the_similarity_all_stay(spark):
    """Texts of 0.6 to 0.8 alike are no duplicates; components are those of the exact pairs."""
    rows, below = [], []
    for i in range(300):
        base, copy = altered(30_000 + i, 250, 6 + i % 8)
        rows += [(2 * i, base), (2 * i + 1, copy)]
        if 0.6 <= jaccard(base, copy) < 0.8:
            below.append(2 * i)
    found = groups(spark, rows)
    assert len(below) > 100 and [i for i in below if found[i] == found[i + 1]] == []


def test_blocks_must_cover_the_radius(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([], "fp long"), 3, 4, 2)


def test_similar_documents_compare_fingerprints_before_they_join_sets(spark, monkeypatch):
    """What the fingerprints link at the similarity is linked without any pair of the prefixes; what they link below it is not."""
    from .conftest import prose

    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        base = prose(40_000 + i, 1500)
        rows += [(2 * i, base), (2 * i + 1, edited(base, rng, 1))]
    # 84 words have 80 shingles; 12 words of their own make two texts 80 of 104 alike.
    rows += [(1000 + i, " ".join([*(f"w{j}" for j in range(84)), *(f"x{i}y{j}" for j in range(12))])) for i in range(200)]
    prints = {d: S._fingerprint(S.shingles(t.encode(), 5)) for d, t in rows}
    bits = lambda a, b: (int.from_bytes(prints[a], "little") ^ int.from_bytes(prints[b], "little")).bit_count()
    near = [2 * i for i in range(20) if bits(2 * i, 2 * i + 1) <= 2]
    assert len(near) >= 10 and any(bits(a, b) <= 2 for a in range(1000, 1200) for b in range(a + 1, 1200))
    none = lambda *_: spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(S, "_star_pairs", none)
    monkeypatch.setattr(S, "_cross_pairs", none)
    found = groups(spark, rows)
    assert [2 * i for i in range(20) if found[2 * i + 1] == 2 * i] == near
    assert all(found[i] == i for i in range(1000, 1200))


def test_set_fingerprints_against_brute_force(spark, odd, odd_rows):
    found = {r.row: r.fp for r in S.shingle_sets(odd, words_per_shingle=3).where("at is not null").collect()}
    texts = {r.row: r.text for r in odd.select(S.row_key(odd.doc_id, odd.text).alias("row"), "text").collect()}
    assert found

    def brute(text):
        words = (text or "").encode().lower().split()
        hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))} if words else set()
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert {k: v % (1 << 64) for k, v in found.items()} == {k: brute(texts[k]) for k in found}
