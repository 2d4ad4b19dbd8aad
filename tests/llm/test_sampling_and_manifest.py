"""Importance resampling, SimHash components and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import COLUMNS, documents
from pyspark.sql import functions as F

from lexmill.llm import common, merkle, resampling, simhash


# resampling
def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _runs(text, shortest, longest):
    w = _words(text)
    return [" ".join(w[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(w) - k + 1)]


def _expected(rows, target, percent, least, buckets, n, seed):
    held, wanted = [Counter(_runs(t, *n)) for _, t in rows], Counter(f for t in target for f in _runs(t, *n))
    s, t = Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for c in held:
        for f, k in c.items():
            s[bucket(f)] += k
    for f, k in wanted.items():
        t[bucket(f)] += k
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for (id_, text), c in zip(rows, held):
        weight = sum(k * gain(bucket(f)) for f, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, text) in zip(out, rows) if len(_words(text)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("n,frequent,buckets", [((1, 1), resampling.FREQUENT, 10_000), ((1, 1), 40, 7), ((1, 3), 300, 1000), ((2, 2), 1, 50)])
def test_resampling_against_brute_force(spark, n, frequent, buckets):
    rows = documents()
    target = [("the thing für œuvre don't",), (None,), ("",), (rows[9][1][:90],)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = resampling.resample(docs, spark.createDataFrame(target, "text string"), 50, 3, buckets, *n, seed=7, frequent=frequent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = _expected([r[:2] for r in rows], [t for t, in target], 50, 3, buckets, n, 7)
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert resampling.resample(none, none).collect() == []
    some = spark.createDataFrame(documents(), COLUMNS)
    got = resampling.resample(some, none).collect()
    assert len(got) == len(documents()) and all((r.weight == 0) == (r.n_features == 0) for r in got)


def test_features_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choice(["the", "été-né", "x"]) for _ in range(500)) + "  "
    whole = resampling.features(text.encode(), 1, 4)
    real = common.pieces
    monkeypatch.setattr(resampling, "pieces", lambda data: real(data, 7))
    assert resampling.features(text.encode(), 1, 4) == whole == (Counter(x.encode() for x in _runs(text, 1, 4)), len(_words(text)))


# simhash
def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _component(fps, bits):
    """The smallest place that each fingerprint's links lead to."""
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    root = np.arange(len(fps))
    while True:
        least = np.where(near, root[None, :], len(fps)).min(1)
        if (least == root).all():
            return root.tolist()
        root = least


def test_the_sets_of_positions_meet_every_link():
    from itertools import combinations

    sets = simhash.position_sets()
    assert len(sets) == len(set(sets)) == 14 and all(len(set(s)) == 4 for s in sets)
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_near_duplicates_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    known = sorted((r[0], _fingerprint(r[1])) for r in rows if r[0] is not None)
    root = _component([fp for _, fp in known], 3)
    want = Counter((i, f"{fp:016x}", known[c][0]) for (i, fp), c in zip(known, root))
    want.update((None, f"{_fingerprint(r[1]):016x}", None) for r in rows if r[0] is None)
    assert got == want
    assert simhash.near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def _clusters(rng, n):
    """Groups around centres, groups a few bits from each other, chains, and strays."""
    out = []
    for size in (n // 3, n // 6, n // 12):
        centre, loose = rng.getrandbits(64), [1 << b for b in rng.sample(range(64), 9)]
        for _ in range(size):
            out.append(centre ^ sum(x for x in loose if rng.random() < 0.5))
        out.append(centre ^ sum(1 << b for b in rng.sample(range(64), 12)))
        out += [out[-2] ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (3, 3, 4, 4)]
    chain = rng.getrandbits(64)
    for _ in range(n // 6):
        chain ^= sum(1 << b for b in rng.sample(range(64), rng.choice((3, 3, 4))))
        out.append(chain)
    out += [rng.getrandbits(64) for _ in range(n // 6)] + [0, (1 << 64) - 1, 7, 15]
    return sorted(set(out))


@pytest.mark.parametrize("bits,most,seed", [(3, 10_000, 1), (3, 12, 2), (3, 2, 3), (2, 5, 4), (1, 5, 5), (0, 5, 6)])
def test_components_of_fingerprints(spark, bits, most, seed):
    """With short and with long lists, which meet as balls."""
    fps = _clusters(random.Random(seed), 240)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, most).collect()
    place, root = {x: i for i, x in enumerate(signed)}, list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        x, y = top(place[a]), top(place[b])
        root[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(fps))] == _component(fps, bits)


def test_a_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400)) + " \n"
    whole, real = _fingerprint(text), common.pieces
    monkeypatch.setattr(simhash, "pieces", lambda data: real(data, 5))
    assert simhash.fingerprint(text.encode()) == whole
    assert simhash.fingerprint(b" Ab ") == _fingerprint("Ab") and simhash.fingerprint(b"") == 0
    with pytest.raises(ValueError):
        simhash.links(None, 4)


# manifest
def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _climb(nodes, fan):
    """The root and, for each node, [left, right] texts level by level."""
    paths, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(owner):
            run = o // fan * fan
            paths[i].append(("".join(nodes[run:o]), "".join(nodes[o + 1 : run + fan])))
            owner[i] = o // fan
        nodes = [_sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def _manifest(rows, fan):
    by = defaultdict(list)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for id_, text, lang in rows:
        by[lang].append((id_ is not None, id_ or 0, _sha(field(id_) + field(text)), id_))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs, tops = {}, []
    for g in groups:
        by[g].sort(key=lambda x: x[:3])
        subs[g] = _climb([x[2] for x in by[g]], fan)
        tops.append(subs[g][0])
    root, upper = _climb(tops, fan)
    out = Counter()
    for g, up in zip(groups, upper):
        for leaf, path in zip(by[g], subs[g][1]):
            out[(leaf[3], leaf[2], subs[g][0], root, tuple(path + up))] += 1
    return out


@pytest.mark.parametrize("fan,depth,n", [(2, 10, 0), (2, 2, 43), (2, 1, 9), (3, 1, 40), (4, 2, 70)])
def test_manifest_against_brute_force(spark, fan, depth, n):
    rng = random.Random(n)
    rows = [(r[0], r[1], r[2]) for r in documents()]
    rows += [(100 + i, f"t{i % 5}", rng.choice(["x", "x", "x", "", "é", "zz", None])) for i in range(n)] + [(500, None, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("g", "id", "node", "n", "place", "path", "root")})
    made = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("text")), keep={"n": F.lit(1)}, fan=fan, depth=depth)
    folded = merkle.fold(F.col("leaf"), F.col("path")).alias("folded")
    spoilt = merkle.fold(merkle.digest(F.lit("other")), F.col("path")).alias("spoilt")
    got = made.select("*", folded, spoilt, merkle.proof(F.col("path")).alias("proof")).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in got) == _manifest(rows, fan)
    assert all(r.folded == r.root != r.spoilt and r.n == 1 and r.proof == "".join(x.left + x.right for x in r.path) for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    r = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("text"))).first()
    assert r.leaf == r.subroot == r.root == _sha("1:11:a") and r.path == []
    assert merkle.manifest(docs.where("doc_id > 1"), merkle.leaf(F.col("doc_id"))).collect() == []
