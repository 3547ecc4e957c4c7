import random

from pyspark.sql import functions as F

from tessera.llm import simhash


def brute(rows):
    import xxhash

    prints = {}
    for n, text in rows:
        words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        prints.setdefault(sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)), []).append(n)
    return prints


def test_fingerprints_and_components_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 30])))) for k in range(150)]
    rows += [(k + 200, t.upper() + " ") for k, t in rows[:40]] + [(500, None), (501, ""), (502, "  \x0b"), (503, "a\u0000b c d"), (1, rows[1][1])]
    rows += [(600 + k, rows[149][1] + f" x{k}" * (k % 2)) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as component_id", "3 as code")
    got = {(r.doc_id, r.f): r.component_id for r in simhash.groups(frame).select("doc_id", F.hex("fingerprint").alias("f"), "component_id").collect()}
    prints = brute(rows)
    keys, parent = list(prints), {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for p, ids in prints.items():
        least[find(p)] = min([least.get(find(p), min(ids)), *ids])
    assert got == {(n, f"{p:X}"): least[find(p)] for p, ids in prints.items() for n in ids}
    assert simhash.groups(frame.limit(0)).count() == 0


def test_links_in_planted_balls(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64)) for c in centres for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    from tessera.llm.graph import components

    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    parent = {signed(p): signed(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                parent[find(signed(a))] = find(signed(b))
    for a in parent:
        for b in parent:
            assert (find(a) == find(b)) == (roots.get(a, a) == roots.get(b, b))


def test_near_copies(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randrange(60, 400))] for _ in range(40)]

    def edited(text, times):
        text = list(text)
        for _ in range(times):
            text[rng.randrange(len(text))] = rng.choice(words)
        return " ".join(text)

    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    rows += [(100 + k, edited(base[k % 40], 1)) for k in range(80)] + [(300, rows[0][1]), (301, None), (302, ""), (303, "only three words"), (304, "only three words"), (None, rows[5][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group_id", F.lit(1))
    got = {r.doc_id: r.group_id for r in simhash.near_copies(frame.drop("group_id")).collect()}
    sets = {n: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for n, x in rows if n is not None for t in [tuple((x or "").split())] if t}
    names = sorted(sets)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    want = {n: find(n) for n in names}
    want |= {301: 301, 302: 301}
    assert got == {n: g for n, g in want.items() if list(want.values()).count(g) > 1}
    kept = simhash.without_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.near_copies(frame.limit(0).drop("group_id")).count() == 0


def jaccard_groups(rows):
    """The smallest id of each row's group, by brute force."""
    sets = {n: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for n, x in rows for t in [tuple(x.split())]}
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    roots = {n: find(n) for n in sets}
    return {n: g for n, g in roots.items() if list(roots.values()).count(g) > 1}


def test_near_copies_in_large_families(spark):
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}" for k in range(3000)]

    def edited(text, times):
        text = list(text)
        for at in rng.sample(range(5, len(text) - 5), times):
            text[at] = rng.choice(words)
        return " ".join(text)

    star = [rng.choice(words) for _ in range(290)]
    template = [rng.choice(words) for _ in range(200)]
    rows = [(k, edited(star, 4)) for k in range(100)] + [(100, " ".join(star))] + [(101 + k, edited(star, 4)) for k in range(100)]
    rows += [(1000 + k, edited(template, rng.randrange(2, 7))) for k in range(200)]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = jaccard_groups(rows)
    assert len([n for n, g in want.items() if g == 0]) > 190 and got == want


def test_near_copies_that_differ_by_a_block(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}" for k in range(3000)]
    common = words[:200]
    rows = []
    for k in range(60):
        n = rng.randrange(60, 900)
        text = [rng.choice(common) for _ in range(n)]
        other = text[: int(0.83 * n)] if k % 2 else [*text, *(rng.choice(words) for _ in range(int(0.2 * n)))]
        rows += [(k, " ".join(text)), (100 + k, " ".join(other))]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = jaccard_groups(rows)
    assert len(want) >= 110 and got == want
