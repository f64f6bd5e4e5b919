import hashlib
import random
import re

from tests.oracle import assert_same
from tidemark.llm import q_secret_scans as q
from tidemark.llm import secret_scans as ss

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_query_equals_sql(spark, small):
    assert_same(spark, q.op5_secret_scans, q.ORACLE_SQL["op5_secret_scans"], small)


def docs():
    r = random.Random(5)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    b64 = ss.UPPER + ss.LOWER + ss.DIGITS + "+/"
    rows = [
        (1, None), (2, ""), (2, ""), (3, 'é😀 Token = "abcDEF-1" x secret=token:abcdef PASSWD:abc api_key:zzzzzz APIKEY = a.b.c.d'),
        (4, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAKIA" + "C" * 16), (5, "0123456789abcdef" * 2 + "g" + "f" * 23), (6, "token=" + pick("0123456789abcdef", 40)),
        (7, f"key {pick(b64, 44)}= end"), (8, "x" + "Ab1" * 20), (9, "see /usr/local/lib/python3/Dist-packages/a1 " + "n0tSoRandomAAAAAAAAAAAAAAAA"), (None, f"é {pick(ss.DIGITS + ss.LOWER, 40)}"), (11, "token=aaaaaa " * 300),
    ]
    return rows


def test_base_equals_brute_force_and_battery_adds(spark):
    df = spark.createDataFrame([(*d, 3) for d in docs()], "doc_id long, text string, n_hex int")
    got = ss.find_secrets(df).select("*", ss.listed(ss.F.col("secret_spans")).alias("listed")).collect()
    by = {}
    for r in got:
        spans = [x for x in r.listed.split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == base(r.text), r.text
        by[r.doc_id] = [x for x in spans if x.startswith("random")]
        assert r.n_hex == sum(x.startswith("hex") for x in spans)
    assert by[7] == ["random:4:49"] and by[None] == ["random:2:42"]
    assert not by[8] and not by[9] and not by[3]
    digest = hashlib.sha256(b"").hexdigest()
    assert digest == hashlib.sha256(",".join(base(None)).encode()).hexdigest()


def test_battery_keeps_most_random_strings_and_few_others(spark):
    """Planted random and natural strings: what is found, and the share of false secrets in every stratum of length."""
    r = random.Random(9)
    b62 = ss.UPPER + ss.LOWER + ss.DIGITS
    words = ["Section", "value", "Item", "table", "Name", "entry"]
    good = ["".join(r.choice(b62) for _ in range(r.randrange(24, 220))) for i in range(400)]
    plain = ["_".join(r.choice(words) + str(r.randrange(3)) for _ in range(r.randrange(4, 30))) for i in range(1200)]
    df = spark.createDataFrame([(i, f"k {t}") for i, t in enumerate(good + plain)], "doc_id long, text string")
    found = [x.doc_id for x in ss.find_secrets(df).where("size(secret_spans) > 0").collect()]
    for low, high in zip((24, *ss.STRATA), (*ss.STRATA, 999), strict=True):
        near = [i for i in found if low <= len((good + plain)[i]) < high]
        true = [i for i in near if i < len(good)]
        assert len(true) >= 0.9 * sum(low <= len(t) < high for t in good), (low, len(true))
        assert len(near) - len(true) <= 0.1 * len(near) + 1, (low, len(near), len(true))


def test_many_matches_in_one_text_are_linear(spark):
    import time

    text = "token=aaaaaa " * 40_000 + "é " + "0123456789abcdef" * 2
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ss.find_secrets(df.limit(0)).collect()
    t = time.time()
    (r,) = ss.find_secrets(df).collect()
    took = time.time() - t
    assert r.n_assign == 40_000 and [(s.start, s.end) for s in r.secret_spans] == [(13 * i, 13 * i + 12) for i in range(40_000)] + [(520_002, 520_034)]
    (r,) = ss.redact(df).collect()
    assert r.text == "[SECRET] " * 40_000 + "é [SECRET]"
    assert took < 10, took  # 2 s alone; 68 s where the work was quadratic


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([("token=abcdef", "u", "v", "w", "x", 7)], "text string, base string, tests string, row string, r string, n_hex int")
    (r,) = ss.find_secrets(df).collect()
    assert (r.base, r.tests, r.row, r.r, r.n_hex) == ("u", "v", "w", "x", 0)
    (r,) = ss.redact(df).collect()
    assert (r.text, r.base, r.n_hex) == ("[SECRET]", "u", 7)


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string")
    got = {r.doc_id: r.text for r in ss.redact(df).collect()}
    assert got[6] == "[SECRET]" and got[1] is None and got[2] == ""
    assert got[3].startswith("é😀 [SECRET]\" x ") and got[8] == docs()[8][1]
    assert got[11] == "[SECRET] " * 300
    assert ss.find_secrets(df.limit(0)).count() == 0


def test_values_glued_to_names_or_left_by_patterns(spark):
    r = random.Random(21)
    b62 = ss.UPPER + ss.LOWER + ss.DIGITS
    value = "".join(r.choice(b62) for _ in range(64))
    safe = value[:30] + "-_" + value[30:]
    hexed = "0123456789abcdef" * 2
    want = {
        "ACCESS_KEY_ID=" + value: [(14, 78)], "é😀 A_NAME_OF_TWENTY_AND_MORE=" + value + "==": [(29, 95)], f"x=1&{value}=y": [(4, 68)],
        f"/etc/keys/{safe}": [(10, 76)], f"{value}+/-b": [(0, 66)], hexed + "Z" + value: [(32, 97)], f"{value} {hexed}": [(0, 64)],
        f"token=abcdef {value}": [(13, 77)], f"AKIA{'A' * 16}-{value[:60]}": [(20, 81)],
    }
    df = spark.createDataFrame([(t,) for t in want], "text string")
    got = {x.text: [(s.start, s.end) for s in x.secret_spans if s.kind == "random"] for x in ss.find_secrets(df).collect()}
    assert got == want
