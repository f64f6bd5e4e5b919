"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

Everything is DataFrame functions, and the work of a text is linear in its length and in its matches. Places of matches
come from running sums, in two levels, over the lengths of the matches and of the pieces between them, so they count
code points; a part of a text is cut from chunks of it, not from its beginning.

A candidate is a run of 20 or more characters of [A-Za-z0-9+/] or of [A-Za-z0-9_-], with any "=" that pads its end, in
what the spans of the patterns leave of the text; any other "=" parts runs. Its encoding is inferred from what it holds
(hex, base 32, lower-case base 36, base 62, base 64; each needs a digit and letters, the last two both cases);
without one it is no candidate. Three tests ask whether it may be random over that alphabet: chi-squared for
uniform counts (with the exact variance of a multinomial, so short strings are fair), the number of runs
above and below the middle of the alphabet, and the serial correlation of neighbours; p is 1 - (1 - the least)^3, which is
uniform for random strings.

What the tests do not tell from random strings would be secrets, but some of it is natural text. Random strings
spread evenly over p, natural ones crowd near 0. So within each stratum of length the candidates of the whole table with p
above a half, doubled, tell how many are random, and what else stands above a threshold is estimated to be natural:
false secrets. The threshold is the least, from FLOOR on, at which these are at most a share ``alpha`` of what
is reported, and one more, within two standard errors of the estimate. It comes from a histogram of p with at most 10,001 cells a stratum, whatever the number of
candidates. Secrets must also carry enough bits for the tests to mean something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Shelf


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the SQL takes for a run; the operator takes PIECE, which parts such runs further.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs of one kind of base 64, the standard or the URL-safe one, with the padding at their end. Where signs of both
#: kinds meet, a run ends between them: a URL-safe piece of 20 characters or more comes first, else the standard one.
#: The look ahead at the front only saves time.
_PAD = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
_STANDARD, _SAFE = "A-Za-z0-9+/", "A-Za-z0-9_-"
PIECE = rf"(?=[A-Za-z0-9+/_-]{{20}})(?:(?<![{_STANDARD}])[{_STANDARD}]{{20,}}+(?![_-])|(?<![{_SAFE}])[{_SAFE}]{{20,}}+(?![+/])|(?<![{_STANDARD}])(?![{_STANDARD}]*[+/][{_SAFE}]{{20,}})[{_STANDARD}]{{20,}}+|(?<![{_SAFE}])[{_SAFE}]{{20,}}+){_PAD}"
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings: what a string consists of, what it must hold, its alphabet in order.
ENCODINGS = (
    ("^[0-9a-f]+$", ("[0-9]", "[a-f]"), DIGITS + "abcdef"),
    ("^[0-9A-F]+$", ("[0-9]", "[A-F]"), DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", ("[2-7]", "[A-Z]"), UPPER + "234567"),
    ("^[0-9a-z]+$", ("[0-9]", "[a-z]"), DIGITS + LOWER),
    ("^[0-9A-Za-z]+$", ("[0-9]", "[a-z]", "[A-Z]"), UPPER + LOWER + DIGITS),
    ("^[0-9A-Za-z+/]+$", ("[0-9]", "[a-z]", "[A-Z]"), UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", ("[0-9]", "[a-z]", "[A-Z]"), UPPER + LOWER + DIGITS + "-_"),
)
#: Lower limits of the strata of length, and the bits that a secret carries at least.
STRATA, BITS, CELLS, FLOOR = (48, 80, 160), 90, 10_000, 50
_SPANS = "ARRAY<STRUCT<s: INT, k: INT, e: INT, x: STRING>>"


def q(text: str) -> str:
    """A SQL literal of a pattern for Spark."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str, zero: str, kind: str = "INT", block: int = 128) -> str:
    """Running results of ``step`` (an associative expression of a and b) over an array, in two levels.

    Blocks are folded by themselves, then shifted by what stands before them, so few short arrays are copied.
    """
    inner = f"""transform(sequence(0, (size(v) - 1) div {block}), j -> aggregate(slice(v, j * {block} + 1, {block}), named_struct('t', {zero}, 'o', CAST(array() AS ARRAY<{kind}>)),
      (acc, y) -> {_let("z", step.replace("$a", "acc.t").replace("$b", "y"), "named_struct('t', z, 'o', concat(acc.o, array(z)))")}))"""
    before = f"aggregate(r, named_struct('t', {zero}, 'o', CAST(array() AS ARRAY<{kind}>)), (acc, y) -> named_struct('t', {step.replace('$a', 'acc.t').replace('$b', 'y.t')}, 'o', concat(acc.o, array(acc.t)))).o"
    shifted = f"flatten(transform(r, (x, i) -> transform(x.o, y -> {step.replace('$a', 'f[i]').replace('$b', 'y')})))"
    whole = _let("v", values, _let("r", inner, _let("f", before, shifted)))
    return whole


def _spans(kind: int, matches: str, pieces: str, sizes: str | None = None) -> str:
    """Sorted structs of start, rank of the kind, end and the match; with ``sizes``, of matches of size 6 or more.

    Columns are bound to names first: Spark may put their expressions in their place, and in a lambda they would be
    computed for every element.
    """
    ends = _running("transform(mt, (m, i) -> length(pc[i]) + length(m))", "$a + $b", "0")
    made = f"transform(mt, (m, i) -> named_struct('s', e[i] - length(m), 'k', {kind}, 'e', e[i], 'x', m))"
    if sizes:
        made = _let("sz", sizes, f"filter({made}, (y, i) -> sz[i] >= 6)")
    return f"IF(size({matches}) = 0, CAST(array() AS {_SPANS}), {_let('mt', matches, _let('pc', pieces, _let('e', ends, made)))})"


#: Characters of a chunk of a text. A part is cut from the chunks that it touches.
_CHUNK = 512


def _part(start: str, length: str) -> str:
    """``length`` characters of the chunks ``ch`` from ``start`` on, which counts from 0."""
    return f"substring(array_join(slice(ch, ({start}) div {_CHUNK} + 1, ({start} + {length} - 1) div {_CHUNK} - ({start}) div {_CHUNK} + 1), ''), ({start}) % {_CHUNK} + 1, {length})"


def _replaced(text: str, spans: str, start: str, end: str, mark: str) -> str:
    """``text`` with ``mark`` for sorted spans, which may overlap; ``mark`` may use the covered part's ends a and b."""
    farthest = _running(f"transform({spans}, y -> y.{end})", "greatest($a, $b)", "0")
    gap = f"IF(a > p, {_part('p', 'a - p')}, '')"
    pieces = f"""transform({spans}, (y, i) -> {_let("p", "IF(i = 0, 0, far[i - 1])", _let("a", f"y.{start}", _let("b", f"y.{end}", f"concat({gap}, IF(b > p, {mark}, ''))")))})"""
    rest = _let("p", "far[size(far) - 1]", f"IF(n > p, {_part('p', 'n - p')}, '')")
    chunks = f"regexp_extract_all({text}, '(?s).{{1,{_CHUNK}}}', 0)"
    return _let("ch", chunks, _let("far", farthest, _let("n", f"length({text})", f"concat(array_join({pieces}, ''), {rest})")))


def tail_sql(z: str) -> str:
    """P(Z > z) for z >= 0 of a standard normal, by a polynomial good to seven decimals (fixed values)."""
    t = f"(1 / (1 + 0.2316419D * ({z})))"
    return f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"


def _stats(candidates: str) -> str:
    """Candidates with an encoding, each with its stratum, bits and p-value in cells."""
    kind = "CASE " + " ".join(f"WHEN c.y RLIKE {q(all_of)} AND " + " AND ".join(f"c.y RLIKE {q(h)}" for h in has) + f" THEN {q(alphabet)}" for all_of, has, alphabet in ENCODINGS) + " END"
    named = f"transform({candidates}, c -> named_struct('s', c.s, 'e', c.e, 'y', rtrim('=', c.x)))"
    named = f"filter(transform({named}, c -> named_struct('s', c.s, 'e', c.e, 'y', c.y, 'a', {kind})), c -> c.a IS NOT NULL AND length(c.y) >= 20)"
    coded = f"transform({named}, c -> named_struct('s', c.s, 'e', c.e, 'n', CAST(length(c.y) AS DOUBLE), 'k', CAST(length(c.a) AS DOUBLE), 'v', transform(split(c.y, ''), y -> CAST(instr(c.a, y) - 1 AS DOUBLE)), 'o', aggregate(split(c.a, ''), 0D, (t, y) -> t + power(length(c.y) - length(replace(c.y, y, '')), 2))))"
    sums = f"""transform({coded}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'v', c.v, 'chi', c.k / c.n * c.o - c.n, 'm', aggregate(c.v, 0D, (t, y) -> t + y) / c.n,
      'up', CAST(size(filter(c.v, y -> y >= c.k / 2)) AS DOUBLE), 'runs', 1D + size(filter(sequence(1, size(c.v) - 1), i -> (c.v[i] >= c.k / 2) <> (c.v[i - 1] >= c.k / 2)))))"""
    more = f"""transform({sums}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k,
      'z1', (c.chi - (c.k - 1)) / sqrt(2 * (c.k - 1) * (c.n - 1) / c.n),
      'u', 2 * c.up * (c.n - c.up), 'runs', c.runs,
      'r', aggregate(sequence(1, size(c.v) - 1), 0D, (t, i) -> t + (c.v[i] - c.m) * (c.v[i - 1] - c.m)) / greatest(1e-9D, aggregate(c.v, 0D, (t, y) -> t + (y - c.m) * (y - c.m)))))"""
    scores = f"""transform({more}, c -> named_struct('s', c.s, 'e', c.e, 'n', c.n, 'k', c.k, 'z1', c.z1,
      'z2', IF(c.u <= c.n, 9D, abs(c.runs - 1 - c.u / c.n) / sqrt(c.u * (c.u - c.n) / (c.n * c.n * (c.n - 1)))),
      'z3', abs(c.r + 1 / (c.n - 1)) * sqrt(c.n)))"""
    one = f"IF(c.z1 >= 0, {tail_sql('c.z1')}, 1 - {tail_sql('(-c.z1)')})"
    p = f"(1 - power(1 - least(1D, {one}, 2 * {tail_sql('c.z2')}, 2 * {tail_sql('c.z3')}), 3))"
    stratum = "CASE " + " ".join(f"WHEN c.n < {n} THEN {i}" for i, n in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"
    return f"transform({scores}, c -> named_struct('s', c.s, 'e', c.e, 'stratum', {stratum}, 'bits', c.n * log2(c.k), 'cell', CAST(ceil(round({p} * {CELLS}, 6)) AS INT)))"


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, text, base, tests): the spans of the patterns, and candidates with their figures, null without any."""

    def spans(docs: DataFrame, found: dict[str, str], text: str, made: dict[str, str]) -> DataFrame:
        docs = docs.withColumns({f"{k}m": F.expr(f"regexp_extract_all({text}, {q(p)}, 0)") for k, p in found.items()})
        docs = docs.withColumns({f"{k}p": F.expr(f"IF(size({k}m) = 0, NULL, split({text}, {q(p)}, -1))") for k, p in found.items()})
        if "a" in found:
            docs = docs.withColumn("ag", F.expr(f"transform(am, x -> length(regexp_extract(x, {q(ASSIGN)}, 2)))"))
        return docs.withColumns({k: F.expr(v) for k, v in made.items()}).drop("ag", *[f"{k}{x}" for k in found for x in "mp"])

    text = "coalesce(text, '')"
    docs = spans(docs, {"a": ASSIGN, "c": ACCESS, "h": HEX}, text, {"a": _spans(0, "am", "ap", "ag"), "c": _spans(1, "cm", "cp"), "h": _spans(2, "hm", "hp")})
    docs = docs.withColumn("base", F.expr("array_sort(concat(a, c, h))")).drop("a", "c", "h")
    # the text with blanks for what the patterns found, so that runs keep their places
    blanks = "repeat(' ', b - greatest(a, p))"
    docs = docs.withColumn("rest", F.expr(f"IF(size(base) = 0, {text}, {_replaced(text, 'base', 's', 'e', blanks)})"))
    docs = spans(docs, {"r": PIECE}, "rest", {"r": _spans(3, "rm", "rp")})
    return docs.withColumn("tests", F.expr(f"IF(size(r) = 0, NULL, {_stats('r')})")).drop("r", "rest").withColumn("base", F.expr("transform(base, b -> named_struct('s', b.s, 'k', b.k, 'e', b.e))"))


def thresholds(scanned: DataFrame, alpha: float) -> dict[int, int]:
    """For each stratum of length, the cell of p above which candidates are secrets."""
    cells = scanned.select(F.explode("tests").alias("c")).where(F.col("c.bits") >= BITS).groupBy(F.col("c.stratum").alias("stratum"), F.col("c.cell").alias("cell")).count()
    # thresholds are cells that occur, or the floor
    cells = cells.unionByName(cells.select("stratum", F.lit(FLOOR).alias("cell"), F.lit(0).cast("long").alias("count")).distinct())
    cells = cells.withColumn("cell", F.greatest("cell", F.lit(FLOOR))).groupBy("stratum", "cell").agg(F.sum("count").alias("count"))
    w = Window.partitionBy("stratum")
    above = F.coalesce(F.sum("count").over(w.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.sum(F.when(F.col("cell") > CELLS // 2, F.col("count")).otherwise(0)).over(w)
    kept = cells.select("stratum", "cell", above.alias("above"), half.alias("half"))
    false = F.col("above") - 2 * F.col("half") * (CELLS - F.col("cell")) / CELLS
    kept = kept.where(false <= alpha * F.col("above") + 1 + 2 * F.sqrt(2 * F.col("half"))).groupBy("stratum").agg(F.min("cell").alias("cell"))
    return {r["stratum"]: r["cell"] for r in kept.collect()}  # a row a stratum


def find_secrets(docs: DataFrame, alpha: float = 0.05, text: bool = True) -> DataFrame:
    """Adds n_assign, n_access, n_hex and ``secret_spans`` to rows with a ``text``, which goes unless ``text`` holds.

    secret_spans holds (start, end, kind) in code points, end exclusive, sorted by start and then kind: the
    spans of the three patterns, and those that the randomness tests add where no pattern matched ("random").
    A null text is empty; one of any length is scanned whole, in time linear in its length. Repeated rows are scanned
    each (and count each for the false-discovery control); other columns stay, whatever their names, columns named like
    the results are replaced, and an empty table gives no rows. The rows are scanned once and stored meanwhile.
    """
    made = ("n_assign", "n_access", "n_hex", "secret_spans")
    names = [c for c in docs.columns if c not in made and (text or c != "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("int")  # one column, so no name can clash
    scanned = Shelf(docs.sparkSession).keep(_scanned(docs.select(row.alias("row"), "text")).drop("text"))
    limits = thresholds(scanned, alpha)
    limit = "CASE " + " ".join(f"WHEN c.stratum = {s} THEN c.cell > {c}" for s, c in sorted(limits.items())) + " ELSE false END" if limits else "false"
    added = f"IF(tests IS NULL, CAST(array() AS ARRAY<STRUCT<s: INT, k: INT, e: INT>>), transform(filter(tests, c -> c.bits >= {BITS} AND ({limit})), c -> named_struct('s', c.s, 'k', 3, 'e', c.e)))"
    spans = F.expr(f"array_sort(concat(base, {added}))")
    kind = "CASE b.k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return scanned.withColumn("spans", spans).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        *[F.size(F.expr(f"filter(base, b -> b.k = {k})")).cast("long").alias(n) for k, n in enumerate(made[:3])],
        F.expr(f"transform(spans, b -> named_struct('start', b.s, 'end', b.e, 'kind', {kind}))").alias("secret_spans"),
    )


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, alpha: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans become one. Rows as in
    ``find_secrets``; other columns stay, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = find_secrets(docs.select(row, "text"), alpha)
    text = f"IF(size(secret_spans) = 0, text, {_replaced('text', 'secret_spans', 'start', 'end', f'IF(a >= p, {q(mark)}, {q("")})')})"
    return found.withColumn("text", F.expr(text)).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
