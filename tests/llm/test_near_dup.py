import random

from gleanframe.llm import near_dup
from gleanframe.llm.near_dup import deduplicated, near_duplicates


def _brute(rows, words, percent):
    sets = []
    for doc_id, text in rows:
        t = (text or "").encode().lower().split()
        sets.append({tuple(t[i : i + words]) for i in range(len(t) - words + 1)} or ({tuple(t)} if t else set()))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if both * 100 >= percent * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                comp[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def _corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([2, 8, 30, 120, 300]))
        if rng.random() < 0.4:
            base = passage + base
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", "\t"]).join(w.upper() if rng.random() < 0.1 else w for w in t)) for i, t in enumerate(texts)]


def test_same_components_as_all_pairs(spark):
    rows = _corpus(3, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 4).collect())
    assert got == _brute(rows, 4, 80)


def test_lists_in_parts(spark, monkeypatch):
    """Parts of two holders change nothing."""
    monkeypatch.setattr(near_dup, "PART", 2)
    rows = _corpus(11, 60)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == _brute(rows, 4, 80)


def test_contained_copies_of_100_to_200_shingles_at_the_threshold(spark):
    rng, rows = random.Random(5), []
    for i in range(80):
        n = rng.randrange(100, 161)
        larger = int(n / rng.uniform(0.8, 0.82))  # shingles of the copy that holds all of the other's
        text = [f"w{rng.randrange(10**9)}" for _ in range(larger + 3)]
        rows += [(2 * i, " ".join(text[: n + 3])), (2 * i + 1, " ".join(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 4).collect())
    assert got == _brute(rows, 4, 80)
    assert all(component == doc_id - doc_id % 2 for doc_id, _, component in got)


def test_nulls_empties_ties_and_odd_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "one two three four five"), (6, "x y z v w"), (7, "X y z v w"), (None, "a b"), (8, "é b"), (9, "É b"), (10, "long " * 5000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, node int, value string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df, 4).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(5, 1)] == (4, False) and got[(4, 1)] == (4, True)
    assert got[(7, 2)] == (6, False) and got[(6, 2)] == (6, True)
    assert got[(None, 1)] == (None, True)
    assert got[(8, 1)] == (8, True) and got[(9, 1)] == (9, True) and got[(10, 1)] == (10, True)
    assert near_duplicates(df.where("false"), 5).count() == 0


def test_one_row_of_each_group_stays_whatever_the_columns(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, None), (3, "x"), (3, "w"), (None, "a b c d e"), (None, None)]
    df = spark.createDataFrame([(*r, i, "q") for i, r in enumerate(rows)], "doc_id long, text string, `a.b` int, kept string")
    got = deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, ""), (-1, "a b c d e"), (1, "a b c d e"), (3, "w")]
    assert deduplicated(df.where("false")).count() == 0


def test_what_is_left_over_is_joined_narrow_and_never_broadcast(spark):
    rng = random.Random(7)
    sets = []
    for _ in range(40):
        base = rng.sample(range(1000), 60)
        sets += [sorted({*rng.sample(base, rng.choice([52, 56, 58, 60])), *rng.sample(range(1000), rng.choice([0, 2, 8]))}) for _ in range(4)]
    component = [rng.choice([n, n - n % 4]) for n in range(len(sets))]
    full = spark.createDataFrame(list(enumerate(sets)), "node long, hashes array<long>")
    lists = spark.createDataFrame([(v, n, component[n]) for n in range(len(sets)) for v in (1, 2)], "value long, node long, component long")
    left = near_dup._left_over(lists, full, 0.8)
    got = [tuple(r) for r in left.collect()]
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if component[i] != component[j] and len({*sets[i]} & {*sets[j]}) * 100 >= 80 * len({*sets[i]} | {*sets[j]})}
    assert len(got) == len(set(got)) and similar <= set(got) and len(similar) > 20
    assert all(component[a] != component[b] for a, b in got)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "own" not in plan
