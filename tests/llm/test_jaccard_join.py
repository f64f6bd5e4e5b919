import random
import re

from tests.oracle import assert_same
from tidemark.llm import q_jaccard_join as q
from tidemark.llm.jaccard_join import one_of_each, similarity_components


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_equals_sql(spark, small):
    assert_same(spark, q.op3_jaccard_join, q.ORACLE_SQL["op3_jaccard_join"], small)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(r.choice(vocabulary) for _ in range(12))
    docs = [(900, None), (901, ""), (902, " \n"), (5, "Just three words"), (3, "just THREE\nwords"), (3, "just three words"), (70, "x")]
    base = [r.choice(vocabulary) for _ in range(45)]
    for i in range(60):  # a large group of near copies, some only linked through others
        own = list(base)
        for _ in range(r.randrange(0, 3)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        docs.append((100 + i, " ".join(own)))
    for i in range(40):
        own = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 25)))
        docs.append((300 + i, f"{own} {common}" if i % 2 else f"{common} {own}"))
    return docs


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_shingles int, size string")
        assert similarity_components(df.limit(0)).columns == ["doc_id", "size", "n_shingles", "component_id"]
        assert rows(similarity_components(df)) == brute(docs)


def near_copies(r, base, n, edits, vocabulary):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        out.append(" ".join(own))
    return out


def test_large_groups_long_texts_and_null_ids(spark, monkeypatch):
    from tidemark.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "_HELD", 2000)  # many chunks
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    base, other = ([r.choice(vocabulary) for _ in range(120)] for _ in range(2))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = near_copies(r, base, 150, 6, vocabulary) + near_copies(r, other, 60, 9, vocabulary)
    texts += [" ".join(r.choice(vocabulary) for _ in range(40)) + f" {passage}" for _ in range(60)]  # alike in a passage only
    long = [r.choice(vocabulary) for _ in range(60_000)]
    texts += [" ".join(long), " ".join([*long, "end"]), texts[0].upper(), texts[0]]
    docs = [(i + 10, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*docs, (None, texts[1]), (None, "all alone here by itself"), (None, None), (None, "")], "doc_id long, text string").repartition(3)
    got = similarity_components(df).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got if x.doc_id is not None) == brute(docs)
    of = {x.doc_id: x.component_id for x in got}
    assert sorted(((x.n_shingles, x.component_id) for x in got if x.doc_id is None), key=repr) == sorted([(len(shingles(texts[1])), of[11]), (1, None), (0, None), (0, None)], key=repr)


def test_columns_of_any_name_stay(spark):
    names = "_k1 string, _bucket string, _comp string, kind string, chunk string, cls string, size string, part string, _rest string, _row string"
    df = spark.createDataFrame([(1, "a b c d e f", *"qrstuvwxyz"), (2, "a b c d e f", *"qrstuvwxyz")], f"doc_id long, text string, {names}")
    for x in similarity_components(df).collect():
        assert tuple(x)[1:11] == tuple("qrstuvwxyz") and x.component_id == 1
    (x,) = one_of_each(df).collect()
    assert tuple(x) == (1, "a b c d e f", *"qrstuvwxyz")
    assert one_of_each(df.limit(0)).count() == 0


def test_empty_table_and_nothing_in_common(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (1, "g h i j k l")], "doc_id long, text string")
    assert rows(similarity_components(df)) == [(1, 2, 1), (2, 2, 2)]
    assert similarity_components(df.limit(0)).count() == 0
