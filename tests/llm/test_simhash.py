import numpy as np
import xxhash

from gridloom.llm import simhash
from gridloom.llm.common import table
from gridloom.llm.components import components
from tests.llm.common import odd_docs, run


def brute_print(text):
    words = [w for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ distinct[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(v): find(i) for i, v in enumerate(distinct)}


def check(df, rows):
    prints = [brute_print(t) for _, t in rows]
    group = brute_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = sorted((str(i), f"{p:016x}", least.get(group[p])) for (i, _), p in zip(rows, prints, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect()) == want


def test_query_is_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check(run("op9_simhash", spark, sf_dir), rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check(simhash.near_duplicates(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    near = np.array([b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 20, (60, 2))], np.uint64)
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = {r.node: r.root for r in components(simhash.links(simhash.parts_of(nodes))).collect()}
    want = brute_components([int(x) for x in fps.view(np.uint64)])
    mine = {}
    for x in fps.tolist():
        mine.setdefault(found.get(x, x), set()).add(int(np.int64(x).view(np.uint64)))
    theirs = {}
    for v, g in want.items():
        theirs.setdefault(g, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def wide_groups(texts):
    """Groups of texts by the wide rule: all pairs that share a key, by loops."""
    made = [simhash.wide_fingerprint(t) for t in texts]
    bits = [int.from_bytes(fp, "little") for fp, _ in made]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = [set(k) for _, k in made]
    for i in range(len(texts)):
        for j in range(i):
            if bits[i] == bits[j] or keys[i] & keys[j] and (bits[i] ^ bits[j]).bit_count() <= simhash.bit_limit(0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_wide_rule_is_brute_force(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    for g in range(30):  # near copies: a twentieth of the words replaced, or some left out
        base = rng.choice(words, 200).tolist()
        for k in range(5):
            own = [w if rng.random() > 0.004 * k else "new" + w for w in base]
            rows.append((10**6 + 10 * g + k, " ".join(own[: 200 - 5 * k])))
    rows += [(2 * 10**6 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "a b c", "a b  c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = wide_groups([t for _, t in rows])
    monkeypatch.setattr(simhash, "BLOCK", 2)
    want = {i: min(rows[k][0] for k, g in enumerate(group) if g == group[n]) for n, (i, _) in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect()}
    assert got == want
    # of pairs at 0.8 or more nearly all are together, and pairs far from each other aren't linked
    sets = [shingles(t) for _, t in rows]
    similar = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) > 100 and np.mean([group[i] == group[j] for i, j in similar]) > 0.97


def test_pivots_lose_no_pair():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ np.uint64(0b1011)
    rows, cols = simhash.close_pairs(a, b)
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) >= {(i, i) for i in range(300)}


def test_components_of_a_chain(spark):
    got = {r.node: r.root for r in components(spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 101)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
