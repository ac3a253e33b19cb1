import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from caselens.llm import exact, minhash, queries, substring

SPACES = r"[^\x20\x09-\x0D]+"


def words(text, lower=False):
    return re.findall(SPACES, re.sub("[A-Z]", lambda c: c[0].lower(), text or "") if lower else text or "")


def shingles(text, n):
    w = words(text, True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_brute(rows, n, percent):
    """{doc_id: (set size, component)} by comparing every pair that shares a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in lists[g])
        for g in s:
            lists[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), d if d is None else min(least[root(i)])) for i, (d, _) in enumerate(rows)]


def family(seed, groups=6, size=25, n=120, edits=6):
    """Groups of near copies of which many are too far from each other but tied through others, plus loners."""
    chance, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        text = [chance.choice(vocabulary) for _ in range(chance.randint(20, n))]
        for _ in range(size):
            text = list(text)
            for _ in range(chance.randint(0, edits) if chance.random() < 0.8 else 0):
                text[chance.randrange(len(text))] = chance.choice(vocabulary)
            out.append(" ".join(text))
    common = " ".join(chance.choice(vocabulary) for _ in range(60))
    out += [" ".join([common, *(chance.choice(vocabulary) for _ in range(70))]) for _ in range(60)]
    chance.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, sf, n, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i + 100_000, t) for i, t in family(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(frame, n, percent).collect())
    assert got == sorted(near_brute(rows, n, percent))


def test_near_dedup_of_odd_and_no_rows(odd_docs, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(odd_docs, 3, 85).collect()]
    assert len(got) == odd_docs.count()
    want = {d: c for d, _, c in near_brute([(r.doc_id, r.text) for r in odd_docs.collect()], 3, 85)}
    assert all(c == want[d] and k == (d == c) for d, _, c, k in got if d is not None)
    assert [(n, c) for d, n, c, _ in got if d is None and n == 0] == [(0, None)]
    kept = minhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert minhash.near_components(no_docs).count() == minhash.near_dedup(no_docs).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, b + " more"), (7, c), (7, c + " end"), (7, c), (8, None), (None, c)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = sorted((r.row, r.doc_id, r.text) for r in minhash.near_dedup(docs).collect())
    kept = [i for i, _, _ in got]
    assert got == [(i, *rows[i]) for i in kept] and {0, 2, 7, 8} <= set(kept) and not {1, 3} & set(kept)
    assert set(kept) - {0, 2, 7, 8} in ({4, 6}, {5})  # one of the two texts of id 7, with all its rows
    judged = {(r.doc_id, r.component_id) for r in minhash.near_components(docs).collect()}
    assert judged == {(1, 1), (5, 1), (5, 5), (6, 5), (7, 7), (8, 8), (None, None)}


def test_sets_of_any_size_exactly(spark):
    """Sets of more values than a sketch holds, pairs at and just below the threshold."""
    chance, texts = random.Random(3), []
    for size in (200, 1500, 2600):
        base = [f"{size}x{chance.randrange(10**6)}" for _ in range(size)]
        for change in (0.02, 0.045, 0.05, 0.055, 0.2):
            cut = list(base)
            start = chance.randrange(size // 2)
            cut[start : start + int(size * change * 2)] = [f"n{chance.randrange(10**9)}" for _ in range(int(size * change * 2))]
            texts.append(" ".join(cut))
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(frame, exact=True).collect())
    assert got == sorted(near_brute(rows, 5, 80)) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(frame).collect())


def removal_brute(rows, window):
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def passages(seed):
    chance = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    some = [[chance.choice(vocabulary) for _ in range(chance.randint(20, 90))] for _ in range(8)]
    docs = []
    for i in range(80):
        text = [chance.choice(vocabulary) for _ in range(chance.randint(0, 60))]
        for _ in range(chance.randint(0, 3)):
            text += chance.choice(some) + [chance.choice(vocabulary) for _ in range(chance.randint(0, 40))]
        docs.append((i, " ".join(text)))
    docs += [(900, "de " * 300), (901, "la la lu " * 40), (902, None), (903, ""), (904, "one two"), (905, "x " * 34), (906, "y " * 35), (907, "z " * 36)]
    return docs


@pytest.mark.parametrize("window,gram,batches", [(35, 8, 2), (35, 8, 3), (12, 4, 1)])
def test_removal_matches_brute_force(spark, window, gram, batches):
    rows = passages(window + batches)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(frame, window, gram=gram, batches=batches).collect()]
    assert sorted(got, key=repr) == [r[:4] for r in removal_brute(rows, window)]


def test_removal_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, sf).collect()]
    assert sorted(got, key=repr) == [r[:4] for r in removal_brute(rows, 35)]


def test_removed_texts_of_odd_and_no_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter((d, kept if n else next(t for e, t in rows if e == d and len(words(t)) == m)) for d, m, n, _, kept in removal_brute(rows, 35))
    out = substring.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert substring.remove_repeats(no_docs).count() == substring.removal_digest(no_docs).count() == 0
    for wrong in ({"window": 50, "gram": 8}, {"window": 5, "gram": 8}):
        with pytest.raises(ValueError):
            substring.remove_repeats(odd_docs, **wrong)


def test_columns_named_like_our_own_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 7, "g", "k", "r"), (2, text, 7, "g", "k", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th long, gone string, kept string, row string")
    for made, left in ((minhash.near_dedup(docs), rows[:1]), (exact.exact_dedup(docs), rows[:1]), (exact.exact_dedup(docs.union(docs)), rows[:1])):
        assert made.columns == docs.columns and [tuple(r) for r in made.collect()] == left
    assert sorted(tuple(r) for r in substring.remove_repeats(docs).collect()) == [(i, "", 7, "g", "k", "r") for i in (1, 2)]


def history_brute(batches, window):
    """The kept texts of each batch, against the windows of all batches before."""
    before, out = set(), []
    for rows in batches:
        split = [words(t) for _, t in rows]
        seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
        kept = []
        for (d, t), w in zip(rows, split, strict=True):
            again = lambda i, w=w, seen=seen: seen[x := tuple(w[i : i + window])] > 1 or x in before
            gone = {i + k for i in range(len(w) - window + 1) if again(i) for k in range(window)}
            kept.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
        out.append(sorted(kept, key=repr))
        before |= set(seen)
    return out


def test_batches_against_their_history(spark, tmp_path):
    rows = passages(77)
    batches = [rows[i::4] for i in range(4)]
    history = substring.WindowHistory(spark, f"file://{tmp_path}/h", 20)
    for i, (own, want) in enumerate(zip(batches, history_brute(batches, 20), strict=True)):
        got = history.dedup(spark.createDataFrame(own, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
        if i == 2:
            assert len(history._current()) == 3
            history.compact()
            assert len(history._names()) == 1
    assert len(substring.WindowHistory(spark, f"file://{tmp_path}/h", 20)._current()) == 2
    (tmp_path / "h" / "run-000099").mkdir()
    assert len(history._current()) == 2  # a run without its end is not read


def test_a_named_batch_may_be_run_again(spark, tmp_path):
    rows = passages(31)
    frames = [spark.createDataFrame(rows[i::3], "doc_id long, text string") for i in range(3)]
    texts = lambda got: sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    history = substring.WindowHistory(spark, f"file://{tmp_path}/h", 20)
    first = [texts(history.dedup(f, batch=f"day {i}")) for i, f in enumerate(frames)]
    assert len(history._current()) == 3
    # Again, in any order, by another object and after later batches.
    for i in (2, 0, 1, 1):
        assert texts(substring.WindowHistory(spark, f"file://{tmp_path}/h", 20).dedup(frames[i], batch=f"day {i}")) == first[i]
    assert len(history._current()) == 3
    lone = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(60)))], "doc_id long, text string")
    assert texts(history.dedup(lone, batch="x")) == texts(history.dedup(lone, batch="x")) == texts(lone)
    history.compact()
    with pytest.raises(ValueError, match="compacted"):
        history.dedup(lone, batch="x")
    assert texts(history.dedup(lone, batch="y")) == [(1, "")]
