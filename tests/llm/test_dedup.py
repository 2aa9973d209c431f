import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.docs import docs, empty
from veilwright.llm import components, simhash
from veilwright.llm.common import Tables
from veilwright.llm.exact_dedup import drop_copies, exact_dedup


def copies(rows):
    """(doc_id, keep_id, group_size, kept, sha) by brute force."""
    size = Counter(t or "" for _, t in rows)
    keep = {}
    for i, t in rows:
        t = t or ""
        keep[t] = i if keep.get(t) is None else max(keep[t], i if i is not None else keep[t])
    return sorted(((i, keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize(("first", "widen"), [(128, 8), (1, 2), (3, 4)])
def test_exact_dedup_equals_brute_force(spark, first, widen):
    rnd = random.Random(first)
    extra = [(100 + k, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))), None, None, None, None, None, None, None, None, None) for k in range(200)]
    d = docs(spark, extra=extra)
    got = sorted((tuple(r) for r in exact_dedup(d, first_digit=first, widen=widen).collect()), key=repr)
    assert got == copies([(r.doc_id, r.text) for r in d.collect()])


def test_one_copy_stays_with_all_columns(spark):
    d = docs(spark)
    left = drop_copies(d)
    assert left.columns == d.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in d.collect()}


def test_empty_tables(spark):
    assert exact_dedup(empty(spark)).count() == 0 and drop_copies(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_equal_a_plain_count(spark):
    texts = [r.text for r in docs(spark).collect()] + ["One two three", "one TWO three four", "ÀB c d e f", "a\x0bb\x0cc\rd\ne"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    rng = np.random.default_rng(1)
    assert len(masks) == 31
    for _ in range(3000):
        difference = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(not difference & m for m in masks)


def classes(fps, ids, radius=4):
    near = {i: i for i in ids}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = root(ids[a]), root(ids[b])
                near[max(x, y)] = min(x, y)
    return [root(i) for i in ids]


@pytest.mark.parametrize("bucket", [512, 16])
def test_links_equal_all_pairs(spark, bucket):
    rnd = random.Random(bucket)
    fps, seeds = [], [rnd.getrandbits(64) for _ in range(2)]
    for k in range(110):
        x = rnd.choice(seeds) if k % 3 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    ids = list(range(1000, 1000 + len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    tables = Tables(spark, "test")
    links = tables.write(simhash.near_links(nodes, tables, bucket=bucket))
    got = {r.node: r.component for r in components.connected_components(links, tables).collect()}
    root = [got.get(f, f) for f in signed]
    assert [min(i for i, r in zip(ids, root) if r == own) for own in root] == classes(fps, ids)


def test_near_duplicates_equal_brute_force(spark):
    base = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 12).split()
    rnd = random.Random(2)
    near = []
    for k in range(20):
        words = [w + str(j % 37) for j, w in enumerate(base)]
        words[rnd.randrange(len(words))] = f"changed{k}"
        near.append((200 + k, " ".join(words), None, None, None, None, None, None, None, None, None))
    d = docs(spark, extra=near)
    got = sorted({tuple(r) for r in simhash.near_duplicates(d).where("doc_id is not null").collect()})
    rows = sorted({(r.doc_id, r.text) for r in d.collect() if r.doc_id is not None})
    fps = [slow_fingerprint(t) for _, t in rows]
    assert got == [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes(fps, [i for i, _ in rows]))]
    left = simhash.one_of_each_group(d)
    assert left.columns == d.columns and {r.doc_id for r in left.collect() if r.doc_id is not None} == {c for *_, c in got}


def test_components_of_a_path_and_a_hub(spark):
    tables = Tables(spark, "test")
    path = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1001 + k) for k in range(700)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path + hub + [(5, 5)], "u long, v long"), tables).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1701))
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), tables).count() == 0


def test_near_duplicates_with_string_ids(spark):
    d = docs(spark).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    plain = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    got = simhash.near_duplicates(d).collect()
    assert len(got) == d.count()
    classes = {}
    for r in got:
        if r.doc_id is not None:
            classes.setdefault(r.component_id, set()).add(int(r.doc_id[4:]))
            assert r.fingerprint == plain[int(r.doc_id[4:])].fingerprint
    by_number = {}
    for r in plain.values():
        if r.doc_id is not None:
            by_number.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, by_number.values()))
    assert all(c == min(f"doc-{k}" for k in v) for c, v in classes.items())
    assert {r.doc_id for r in simhash.one_of_each_group(d).collect() if r.doc_id} == set(classes)


def test_one_id_with_several_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    d = spark.createDataFrame([(5, a), (6, a), (5, b), (3, b), (None, b), (7, None), (7, ""), (7, None)], "doc_id long, text string")
    kept = sorted(map(repr, ((r.doc_id, r.text) for r in simhash.one_of_each_group(d).collect())))
    assert kept == sorted(map(repr, [(5, a), (3, b), (None, b), (7, None), (7, ""), (7, None)]))
