"""SimHash groups and substring removal against brute force."""

import hashlib
import random

import xxhash

from deedflow.llm.simhash import simhash_groups
from deedflow.llm.substring_dedup import repeated_spans, substring_dedup

SCHEMA = "doc_id long, text string, id string, t string, fp string, marks string, at string"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "m", "a") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed, docs, vocabulary=400):
    rng = random.Random(seed)
    words = ["w%dé" % k for k in range(vocabulary)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 60, 300]))) for _ in range(docs)]
    for _ in range(docs):
        src, dst = rng.randrange(docs), rng.randrange(docs)
        w = texts[src].split()
        if w:
            a = rng.randrange(len(w))
            texts[dst] += "\n" + " ".join(w[a : a + rng.choice([5, 13, 14, 30, 90])])
        if rng.random() < 0.3:
            w = texts[src].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            texts[rng.randrange(docs)] = "  ".join(w)
    return [(k * 3, t) for k, t in enumerate(texts)]


def brute_fp(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(rows):
    fps = [brute_fp(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, format(fps[i], "016x"), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_simhash_matches_brute_force(spark):
    rows = corpus(1, 220) + [(10_000, None), (10_001, ""), (10_002, " \t"), (10_003, "a"), (10_004, "A")]
    got = simhash_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute_groups(rows)


def test_simhash_links_every_pair_within_three_bits(spark):
    """Chains of fingerprints 0 to 4 bits apart, in any bits."""
    from deedflow.llm.components import components
    from deedflow.llm.simhash import linked

    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(5)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in components(linked(df), "a", "b").collect()}
    dealt = {r["node"]: r["root"] for r in components(linked(df, crowd=0), "a", "b").collect()}  # every cell is crowded
    assert dealt == got
    near = {signed(x): {signed(y) for y in fps if (x ^ y).bit_count() <= 3} for x in fps}
    for x in near:
        assert {got.get(y, y) for y in near[x]} == {got.get(x, x)}
    parts, seen = 0, set()
    for x in near:
        if x not in seen:
            parts += 1
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in seen:
                    seen.add(y)
                    todo += near[y]
    assert len({got.get(x, x) for x in near}) == parts


def brute_removed(rows, n=13):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_substring_dedup_matches_brute_force(spark):
    rows = corpus(2, 250, 60) + [(10_000, None), (10_001, ""), (10_002, "a " * 40), (10_003, "a " * 15), (10_004, "b " * 12)]
    got = substring_dedup(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_removed(rows)


def test_substring_dedup_null_id_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    got = {(r[0], r[2]) for r in substring_dedup(frame(spark, [(None, text), (5, text), (5, text), (7, text)])).collect()}
    assert got == {(None, 0), (5, 0), (7, 30)}
    assert substring_dedup(frame(spark, [(1, "a")]).where("false")).count() == 0
    assert simhash_groups(frame(spark, [(1, "a")]).where("false")).count() == 0


def test_substring_dedup_decides_by_words_when_hashes_collide(spark):
    """With six bits of hash left nearly every window meets another one's hash."""
    rows = corpus(7, 90, 60) + [(10_002, "a " * 40), (10_003, "a " * 15), (10_004, "b a " * 12)]
    got = substring_dedup(frame(spark, rows), trusted=0xFC00000000000000)
    assert sorted(map(tuple, got.collect())) == brute_removed(rows)


def test_substring_dedup_of_repeated_and_textual_ids(spark):
    """Rows that share an id, with equal or other texts, are no copies of each other; textual ids are ordered as text."""
    rng = random.Random(12)
    base = corpus(4, 60, 50)
    rows = base + [(d, rng.choice(base)[1]) for d, _ in rng.choices(base, k=40)] + base[:3] * 3 + [(3, "z " * 3000 + base[5][1])]
    got = substring_dedup(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_removed(rows)
    named = [(f"d{d}", t) for d, t in rows]
    df = spark.createDataFrame([(d, t, "x") for d, t in named] + [(None, "n " * 20, "x")], "doc_id string, text string, id string").repartition(3)
    got = sorted((tuple(r) for r in substring_dedup(df).collect() if r[0] is not None))
    assert got == brute_removed(named)


def test_repeated_spans_double_until_none_is_left(spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, "x " + shared), (2, "y z " + shared), (3, "alone " * 3)]
    got = {(r["doc_id"], r["at"]): r["length"] for r in repeated_spans(frame(spark, rows)).collect()}
    assert got[(1, 1)] == 52 and got[(2, 2)] == 52 and got[(1, 48)] == 13 and (1, 0) not in got
    assert max(got.values()) == 52 and hashlib.sha256(b"").hexdigest()


def edited(rng, words, kind):
    """A copy with one edit that leaves a five-word similarity of 0.8 to 0.9."""
    new = lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    n = len(words)
    if kind == "append":
        return words + new(n // 6)
    if kind == "cut":
        a = rng.randrange(n // 2)
        return words[:a] + words[a + n // 9 :]
    out = list(words)
    for k in range(10, n, max(11, n // (n // 60 or 1))):
        out[k] = new(1)[0]
    return out


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_reach_every_kind_of_edit(spark):
    """No pair at 0.8 or more keeps both documents, also when a passage is added or cut."""
    from deedflow.llm.simhash import near_copies

    rng = random.Random(3)
    rows, want = [], []
    for k in range(240):
        words = rng.choices([f"w{x}" for x in range(3000)], k=rng.randrange(120, 500))
        copy = edited(rng, words, ["append", "cut", "change"][k % 3])
        assert 0.8 <= jaccard(words, copy) < 0.95
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        want += [(2 * k, 2 * k), (2 * k + 1, 2 * k)]
    assert sorted(map(tuple, near_copies(frame(spark, rows)).collect())) == want


def test_simhash_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, long), (1, long), (2, long + " end"), (3, "other words of another text " * 3), (3, "yet another text under the same id"), (4, None)]
    got = simhash_groups(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_groups(rows)


def test_near_copies_of_textual_ids(spark):
    from deedflow.llm.simhash import near_copies

    text = " ".join(f"w{k}" for k in range(80))
    rows = [("b", text), ("a", text + " more"), ("c", "quite another text of a few words"), ("d", None), (None, text), ("b", text)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, component_id string")
    got = {(r["doc_id"], r["component_id"]) for r in near_copies(df).collect() if r["doc_id"]}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_near_copies_of_a_template_family_match_brute_force(spark):
    """Variants of one text at about 0.69 are no copies of each other; those given a copy keep it however dense they lie."""
    from deedflow.llm.simhash import near_copies

    rng = random.Random(8)
    base = rng.choices([f"w{x}" for x in range(3000)], k=300)
    change = lambda words, k: [f"n{rng.randrange(10**6)}" if j in at else w for at in [set(rng.sample(range(len(words)), k))] for j, w in enumerate(words)]
    docs = [change(base, 6) for _ in range(300)]
    docs += [change(docs[k], 4) for k in range(0, 300, 5)]
    rng.shuffle(docs)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 100 < len(set(root)) < len(docs) - 40
    got = near_copies(frame(spark, [(k, " ".join(w)) for k, w in enumerate(docs)]))
    assert sorted(map(tuple, got.collect())) == list(enumerate(root))


def test_the_pipeline_joins_what_op8_joins(spark):
    """Groups of near copies by brute force: fingerprints within 3 bits, or a similarity of 0.8 or more."""
    import corpus_pipeline as P

    rng = random.Random(5)
    base = rng.choices([f"w{x}" for x in range(3000)], k=300)
    change = lambda words, k: [f"n{rng.randrange(10**6)}" if j in at else w for at in [set(rng.sample(range(len(words)), k))] for j, w in enumerate(words)]
    docs = [change(base, 5) for _ in range(80)]
    docs += [edited(rng, docs[k], ["append", "cut"][k % 2]) for k in range(0, 80, 5)]
    rng.shuffle(docs)
    fps = [brute_fp(" ".join(w)) for w in docs]
    root, kinds = list(range(len(docs))), set()
    for i in range(len(docs)):
        for j in range(i):
            near, like = (fps[i] ^ fps[j]).bit_count() <= 3, jaccard(docs[i], docs[j]) >= 0.8
            kinds.add((near, like))
            if near or like:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert (True, False) in kinds and (False, True) in kinds and 10 < len(set(root)) < len(docs) - 10
    left = P.near_duplicates(spark, frame(spark, [(k, " ".join(w)) for k, w in enumerate(docs)]), "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(root))


def test_an_id_of_two_texts_is_no_bridge_between_groups(spark):
    """Fingerprints that repeated phrases fix; the greater text of id 3 is near 2, the other one is near 1."""
    import corpus_pipeline as P

    phrase = lambda c: " ".join(f"{c}{k}" for k in range(7)) + " "
    tail = lambda c: " ".join(f"{c}x{k}" for k in range(30))
    p, q = phrase("p") * 60, phrase("q") * 60
    assert jaccard((p + tail("a")).split(), (p + tail("b")).split()) < 0.2 and brute_fp(p + tail("a")) == brute_fp(p + tail("b"))
    rows = [(1, p + tail("a")), (2, q + tail("c")), (3, p + tail("b")), (3, q + tail("d")), (None, p + tail("e"))]
    left = P.near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted(r["doc_id"] or -1 for r in left) == [-1, 1, 2]
