import hashlib
import re

from tests.oracle import assert_same
from tidemark.llm import q_decontamination as q
from tidemark.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, item_text in items:
            iw = words(item_text)
            size = min(n, len(iw))
            for k in range(len(iw) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == iw[k : k + size]:
                        hit.update(range(i, i + size))
                        ids.add(str(item))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_equals_sql(spark, small):
    assert_same(spark, q.op1_decontamination, q.ORACLE_SQL["op1_decontamination"], small)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (10, "Ünï CODE"), (2, None), (2, "..."), (9, "a b c"), (9, "a b c")]
DOCS = [(1, "x one, two three four five six seven eight nine ten. eleven y"), (1, None), (2, ""), (3, "Ünï code; üni Ünï\ncode"), (4, "a b c a b c b"), (4, "a b c a b c b"), (5, "a b"), (6, "b c " * 3000 + "a-b-c")]


def test_equals_brute_force_whole_and_in_blocks(spark):
    docs = spark.createDataFrame([(*d, 5) for d in DOCS], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (1 << 20, 30):
        got = decontaminate(docs, items, block_bytes=size)
        assert got.columns[:2] == ["doc_id", "text"]
        keep = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted((tuple(r) for r in keep), key=repr) == brute(DOCS, ITEMS)


def test_modes_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = {r.doc_id for r in decontaminate(docs, items, mode="documents").collect()}
    assert clean == {1, 2, 5}
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, mode="spans").collect() if r.n_hit}
    assert cut[1] == "x  y" and cut[4] == " b" and cut[3] == "; üni "
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
