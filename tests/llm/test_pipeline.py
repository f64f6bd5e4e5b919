import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_decontamination import words
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scans import base
from tidemark.llm.mixing import root_shares, schedule
from tidemark.llm.textops import table


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    tables, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], small).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == len(corpus_pipeline.STAGES) - 1 or tables[-1].columns == columns
    whole, good, single, clean, masked, mixed = ([r.asDict() for r in t.collect()] for t in tables)

    quality = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    kept = {r["doc_id"] for r in good}
    labelled = [(r["doc_id"] in kept) == (quality[r["doc_id"]] == 1) for r in whole if r["doc_id"] in quality]
    assert sum(labelled) / len(labelled) > 0.95

    component = {d: c for d, _, c in brute([(r["doc_id"], r["text"]) for r in good])}
    assert {r["doc_id"] for r in single} == set(component.values())

    items = {tuple(w[i : i + 10]) for r in table(spark, small, "benchmark").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in items}
    hit = lambda w: any(tuple(w[i : i + n]) in items for n in sizes for i in range(len(w) - n + 1))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not hit(words(r["text"]))}

    before = {r["doc_id"]: r["text"] for r in clean}
    for r in masked:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        assert ("[SECRET]" in r["text"]) or r["text"] == before[r["doc_id"]]
        assert not base(before[r["doc_id"]]) or "[SECRET]" in r["text"]

    assert Counter((r["doc_id"], r["text"]) for r in mixed) == Counter((r["doc_id"], r["text"]) for r in masked)
    counts = Counter(r["source"] for r in masked)
    shares = root_shares(counts)
    order, done, slot = schedule(shares), Counter(), 0
    want = {}
    while len(want) < len(masked):
        s = order[slot % len(order)]
        own = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]) for r in masked if r["source"] == s)
        for j, (_, d) in enumerate(own[16 * done[s] : 16 * done[s] + 16]):
            want[d] = (slot, j)
        done[s] += 1
        slot += 1
    assert {r["doc_id"]: (r["mix_slot"], r["mix_order"]) for r in mixed} == want


def test_copies_with_one_id_leave_one(spark):
    from tidemark.llm.jaccard_join import one_of_each

    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "A b c d e f g"), (9, "a b c d e f g"), (None, "x y z x y z"), (None, "x y z x y z"), (7, ""), (7, ""), (8, None), (1, "other words stand here alone")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = Counter((r.doc_id, (r.text or "").lower()) for r in one_of_each(df).collect())
    assert got == Counter({(5, "a b c d e f g"): 1, (None, "x y z x y z"): 1, (7, ""): 2, (8, ""): 1, (1, "other words stand here alone"): 1})


def test_stages_take_nulls_empty_tables_and_any_names(spark, small, tmp_path):
    names = ["_k1", "_source", "_base", "row", "key", "tests", "place", "_hit_words"]
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 100_000, "en", "s", 500_000), (2, "word " * 100_000, "en", "s", 500_000), (3, "A good sentence stands here.", None, None, None)]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, df.limit(0), small).count() == 0, name
        stage(spark, df, small).write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
        assert all([r[n] for n in names] == names for r in got.collect()), name
        ids = sorted(((r.doc_id or 0), r.text or "") for r in got.collect())
        whole = sorted(((r[0] or 0), r[1] or "") for r in rows)
        if name in ("decontamination", "secrets", "mixing"):
            assert ids == whole
        if name == "near_duplicates":
            assert ids == sorted(set(whole))
