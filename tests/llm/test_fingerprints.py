import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import fingerprints as fp
from tidemark.llm import q_fingerprints


def brute(docs):
    """docs in order of the next one: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    out = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = (fp.vectors([x])[0] for x in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.text(), b.text(), a.like(b), a.like(c)))
    return sorted(out, key=repr)


def hashed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def own_vector(text):
    """A fingerprint by plain Python: sums of paragraph digests, and sums of signs of the hashes of word runs."""
    mask, base = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def word(w):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode())
        return mix((sum((b + 1) * pow(base, k, 2**64) for k, b in enumerate(raw)) + len(raw) * 0xD6E8FEB86659FD93) & mask)

    equality, likeness = [0] * fp.EQUALITY, [0] * fp.LIKENESS
    for p in text.split("\n"):
        if not p.strip():
            continue
        digest = hashlib.shake_128(p.encode()).digest(8 * fp.EQUALITY)
        equality = [(e + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) & mask for k, e in enumerate(equality)]
        words = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", p)]
        for run in [words] if 0 < len(words) < 3 else [words[k : k + 3] for k in range(len(words) - 2)]:
            h = 0
            for w in run:
                h = (h * 0x9FB21C651E98DF25 + w) & mask
            bits = b"".join(mix((h + k * base) & mask).to_bytes(8, "little") for k in range(fp.LIKENESS // 64))
            likeness = [x + (1 if bits[k // 8] >> (7 - k % 8) & 1 else -1) for k, x in enumerate(likeness)]
    return b"".join(e.to_bytes(8, "little") for e in equality).hex() + b"".join((x % 2**32).to_bytes(4, "little") for x in likeness).hex()


def test_vectors_equal_plain_python():
    texts = ["", "one", "One two\n\nthree  four\tfive six seven\n \n", "é😀 x y\né😀 x y", "a b c d e f g h " * 9]
    assert [v.text() for v in fp.vectors(texts)] == [own_vector(t) for t in texts]


def test_far_off_and_missing_ids_do_not_fill_one_bucket(spark):
    df = spark.createDataFrame([(i, f"t {i}") for i in range(1, 2000)] + [(10**15, "far")] + [(None, f"n {i}") for i in range(1000)], "doc_id long, text string")
    cut = fp._cut(df.withColumn("h", fp.F.xxhash64("text")), 16).groupBy("bucket").count().collect()
    assert max(r["count"] for r in cut) < 300 and sum(r["count"] for r in cut) == 3000
    docs = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), hashed(x[1])))
    assert [r[:3] for r in rows(fp.edit_likeness(df, 16))] == [r[:3] for r in brute(docs)]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr)


def test_query_equals_brute_force(spark, small):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    got = rows(q_fingerprints.op7_fingerprints(spark, small))
    assert got == brute(docs)
    assert sum(r[5] for r in got) / len(got) > 0.45 > 0.1 > sum(r[6] for r in got) / len(got)


def test_ties_nulls_and_few_rows(spark):
    docs = [(9, "é" * 7), (9, "é\nb" * 3), (7, ""), (7, None), (7, None), (2, "x y z\nx y z"), (None, "last one"), (None, "later one")]
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), hashed(x[1]), x[1].encode()))
    for n in (None, 1, 3):
        df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, near_next double")
        assert rows(fp.edit_likeness(df, n)) == brute(order)
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert rows(fp.edit_likeness(one)) == brute([(1, "abc def")])
    assert fp.edit_likeness(one.limit(0)).count() == 0


def test_homomorphic(spark):
    r = random.Random(3)
    lines = [" ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    whole = fp.vectors(["\n".join(lines)])[0]
    shuffled = fp.vectors(["\n\n".join(reversed(lines))])[0]
    assert whole.text() == shuffled.text() and fp.Vector.parse(whole.text()).text() == whole.text()
    assert fp.changed(whole, [lines[3]], ["new line"]).text() == fp.vectors(["\n".join([*lines[:3], "new line", *lines[4:]])])[0].text()
    assert whole.text() != fp.vectors(["\n".join(lines[:-1])])[0].text()
    df = spark.createDataFrame([(1, "a\nb", "old"), (2, "b\na", "old"), (3, None, "old")], "doc_id long, text string, fingerprint string")
    got = {x.doc_id: x.fingerprint for x in fp.fingerprints(df).collect()}
    assert got[1] == got[2] != got[3] == fp.Vector().text()


def test_likeness_of_a_run_that_occurs_very_often():
    long = "la " * 40_000  # one run 39,998 times, which 16 bits would turn round
    both = fp.vectors([long, long + "\nla la la"])
    assert np.abs(both[0].likeness.view(np.int32)).min() == 39_998
    assert both[0].like(both[1]) > 0.999
    few = fp.vectors(["la la la la\nx y z"])[0]
    assert both[0].like(few) == pytest.approx(2 * 2 * 39_998 / (39_998**2 + 5), rel=0.5)
    one, two = fp.vectors(["la " * 30_000, "la " * 40_000])
    assert one.like(two) == pytest.approx(2 * 29_998 * 39_998 / (29_998**2 + 39_998**2))
    assert fp.Vector.parse(both[0].text()).like(both[1]) == both[0].like(both[1])
