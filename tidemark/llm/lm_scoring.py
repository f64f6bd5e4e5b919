"""Log-bilinear language-model scores.

The model predicts a token from the two tokens before it: their vectors, weighted by position, are added up and
multiplied with the vectors of all tokens. The training tokens seen at least LEAST times, OWN of them at most, have
vectors of their own; every other token is one of TAIL kinds by its last two bytes, and within a kind it has its
add-one share of the kind's training count. So a text's probability is properly normalised over all tokens, unseen
ones included (one for each kind).

It is trained on every training text by noise-contrastive estimation, in numpy. Training rows are dealt by their hash
to shards of about SHARD tokens, so the model is a function of the rows, not of how they are partitioned. In each of two
rounds every shard makes one pass in the order of the hashes from a common start, and the parameters are averaged by
tokens. The first round learns a vector for every token as context; these are clustered into CONTEXTS classes, with
which the second round goes on. So there are CONTEXTS x CONTEXTS contexts, whose normalisers over all tokens
are computed once in batched matrix products, and scoring a token is a table lookup and a dot product.

Counts of all training tokens are gathered in one aggregation of 64-bit token hashes. Counts of the most
frequent tokens (a bounded number) are broadcast; occurrences of rarer tokens are joined with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.store import Shelf

OWN, LEAST, TAIL, CONTEXTS, DIM = 32_768, 5, 64, 512, 16
NOISE, BATCH, SHARD, RATES = 32, 4096, 4_000_000, (0.1, 0.05)
END_HASH = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """Token hashes of a batch of texts, each text's end included, and where each text begins."""

    def __init__(self, texts: pa.Array):
        data, offsets = textops.utf8(texts)
        starts, ends, first = textops.spans(data, offsets, textops.SPACE_SEPARATED)
        n = len(first) - 1
        self.first = first + np.arange(n + 1)
        words = np.delete(np.arange(len(starts) + n), self.first[1:] - 1) if n else np.zeros(0, np.int64)
        self.hash = np.full(len(starts) + n, END_HASH, np.uint64)
        self.hash[words] = textops.hashes(data, starts, ends)
        last = data[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        #: 0 for the end of a text, then the kinds of tokens by their last two bytes
        self.tail = np.zeros(len(self.hash), np.int64)
        self.tail[words] = 1 + (last * 31 + before * 7) % TAIL


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token and the one before it; 0, the end, stands before a text. ``first``: where texts begin, and the end."""
    one, two = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    begin = first[:-1]
    one[begin] = 0
    two[begin] = 0
    two[begin[np.diff(first) > 1] + 1] = 0
    return one, two


class LogBilinear:
    """Vectors of context classes, position weights, vectors of tokens, each with its bias at the end; ``group`` is a token's
    context class. At the start every context gives the tokens' shares."""

    def __init__(self, prior: np.ndarray, group: np.ndarray | None = None, flat: np.ndarray | None = None):
        self.prior = prior
        self.group = np.arange(len(prior)) if group is None else group
        rng = np.random.default_rng(7)
        self.context = rng.normal(0, 0.1, (self.group.max() + 1, DIM)).astype(np.float32)
        self.weight = np.ones((2, DIM), np.float32)
        self.target = np.zeros((len(prior), DIM + 1), np.float32)
        self.target[:, DIM] = np.log(prior)
        if flat is not None:
            for p in self.parts():
                p[...] = flat[: p.size].reshape(p.shape)
                flat = flat[p.size :]

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.weight, self.target]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The vector that stands for context classes."""
        return self.context[one] * self.weight[0] + self.context[two] * self.weight[1]

    def normalisers(self, one: int) -> np.ndarray:
        """Log normalisers over all tokens of the contexts that end in class ``one``."""
        out = np.empty(len(self.context), np.float32)
        for a in range(0, len(out), 64):
            two = np.arange(a, min(a + 64, len(out)))
            s = self.predicted(np.full(len(two), one), two) @ self.target[:, :DIM].T + self.target[:, DIM]
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            out[two] = top + np.log(s.sum(axis=1))
        return out

    def log_prob(self, one: np.ndarray, two: np.ndarray, token: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """Natural log probability of each token after tokens ``one`` and ``two``."""
        one, two = self.group[one], self.group[two]
        own = self.target[token]
        return np.einsum("ij,ij->i", self.predicted(one, two), own[:, :DIM]) + own[:, DIM] - normalisers[one, two]

    def clustered(self, counts: np.ndarray, classes: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Context classes of tokens by k-means over their context vectors, and the classes' vectors.

        It starts with the most frequent tokens; a token weighs the square root of its count.
        """
        if len(counts) <= classes:
            return np.arange(len(counts)), self.context
        centre, weight = self.context[np.argsort(-counts, kind="stable")[:classes]].astype(np.float64), np.sqrt(counts + 1.0)
        for _ in range(rounds):
            near = np.empty(len(counts), np.int64)
            for a in range(0, len(counts), BATCH):
                x = self.context[a : a + BATCH]
                near[a : a + BATCH] = ((centre**2).sum(axis=1) - 2 * (x @ centre.T)).argmin(axis=1)
            size = np.bincount(near, weight, classes)
            sums = np.stack([np.bincount(near, weight * self.context[:, j], classes) for j in range(DIM)], axis=1)
            centre[size > 0] = sums[size > 0] / size[size > 0][:, None]
        return near, centre.astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with shared noise for a batch, by Adagrad on the rows that a batch touches."""

    def __init__(self, model: LogBilinear, rate: float):
        self.m, self.rate, self.rng, self.seen = model, rate, np.random.default_rng(11), 0
        self.history = [np.full(p.shape, 1e-4, np.float32) for p in model.parts()]
        self.log_noise = np.log(NOISE * model.prior).astype(np.float32)
        self.up_to = np.cumsum(model.prior)

    def _add(self, part: int, rows: np.ndarray, values: np.ndarray) -> None:
        """Moves the parameters of ``rows`` (repeated ones add up) along their gradients."""
        rows = rows.astype(np.uint16)  # sorted by radix
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, at = np.add.reduceat(values[order], first, axis=0), rows[first]
        h = self.history[part][at] + g * g
        self.history[part][at] = h
        self.m.parts()[part][at] += self.rate * g / np.sqrt(h)

    def step(self, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> None:
        m, n = self.m, np.float32(len(token))
        one, two = m.group[one], m.group[two]
        noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE)), len(m.prior) - 1)
        r = m.predicted(one, two)
        own, other = m.target[token], m.target[noise]
        good = np.einsum("ij,ij->i", r, own[:, :DIM]) + own[:, DIM] - self.log_noise[token]
        bad = r @ other[:, :DIM].T + (other[:, DIM] - self.log_noise[noise])
        g_good = 1 / (1 + np.exp(np.clip(good, -30, 30))) / n
        g_bad = -1 / (1 + np.exp(-np.clip(bad, -30, 30))) / n
        g_r = g_good[:, None] * own[:, :DIM] + g_bad @ other[:, :DIM]
        weight = np.stack([(g_r * m.context[one]).sum(axis=0), (g_r * m.context[two]).sum(axis=0)])
        around = np.concatenate([g_r * m.weight[0], g_r * m.weight[1]])
        moves = np.empty((len(token) + NOISE, DIM + 1), np.float32)
        moves[: len(token), :DIM], moves[len(token) :, :DIM] = g_good[:, None] * r, g_bad.T @ r
        moves[: len(token), DIM], moves[len(token) :, DIM] = g_good, g_bad.sum(axis=0)
        self._add(2, np.concatenate([token, noise]), moves)
        self._add(0, np.concatenate([one, two]), around)
        self._add(1, np.arange(2), weight)
        self.seen += len(token)


def _gathered(texts: DataFrame) -> DataFrame:
    """(h, tail, c): how often each token occurs. Tasks add up about four million tokens before they pass them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, at, c = np.unique(np.concatenate([x for x, _ in held]), return_index=True, return_counts=True)
            tail = np.concatenate([x for _, x in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail, pa.int32()), pa.array(c, pa.int64())], names=["h", "tail", "c"])

        for batch in textops.small_batches(batches):
            t = Tokens(batch.column(0))
            held.append((t.hash, t.tail.astype(np.int32)))
            size += len(t.hash)
            if size > 4_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and tail classes of at most ``most`` tokens, all with a count above the others'."""
    by_count = counts.groupBy("c").agg(F.count("*").alias("n"))
    above = by_count.select("c", "n").orderBy(F.desc("c")).limit(most).toArrow()  # no more counts than that can fit
    c, total = above["c"].to_numpy(), np.cumsum(above["n"].to_numpy())
    fit = c[total <= most]
    if not len(fit):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = counts.where(F.col("c") >= int(fit.min())).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy()[order], rows["tail"].to_numpy().astype(np.int64)[order]


class Scorer:
    """What a task needs to score texts: a bounded size, whatever the corpus.

    Modelled tokens have identifiers: 0 for the end of a text, 1 to TAIL for the kinds of other tokens, then the own ones.
    """

    def __init__(self, counts: DataFrame, frequent: int):
        self.n, self.v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
        self.hash, self.count, tail = _frequent(counts, frequent)
        order = np.lexsort((self.hash, -self.count))
        order = order[(self.hash[order] != END_HASH) & (self.count[order] >= LEAST)][:OWN]
        #: identifiers of frequent tokens, and of all others by their kind
        self.id = tail.astype(np.uint16)
        self.id[order] = 1 + TAIL + np.arange(len(order))
        # training counts and distinct tokens of the kinds: all tokens less those with a vector of their own
        tails = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
        size, kinds = np.zeros(1 + TAIL + len(order)), np.zeros(1 + TAIL)
        size[tails["tail"].to_numpy()], kinds[tails["tail"].to_numpy()] = tails["c"].to_numpy(), tails["v"].to_numpy()
        np.subtract.at(size, tail[order], self.count[order])
        np.subtract.at(kinds, tail[order], 1)
        size[1 + TAIL :] = self.count[order]
        self.size, self.prior = size, (size + 1) / (size + 1).sum()
        #: log10 of what a count plus one is divided by, within a kind; 0 for tokens that are none
        self.within = np.zeros(len(size))
        self.within[1 : 1 + TAIL] = np.log10(size[1 : 1 + TAIL] + kinds[1:] + 1)
        self.model: LogBilinear | None = None
        self.normalisers: np.ndarray | None = None

    def ids(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identifiers, whether a token is a frequent one, and its training count then."""
        if not len(self.hash):
            return t.tail, np.zeros(len(t.hash), bool), np.zeros(len(t.hash), np.int64)
        at = np.minimum(np.searchsorted(self.hash, t.hash), len(self.hash) - 1)
        found = self.hash[at] == t.hash
        return np.where(found, self.id[at], t.tail), found, np.where(found, self.count[at], 0)


#: Parameters that go over the wire as one row.
_WIRE = 1 << 16


def _round(shards: DataFrame, n: int, step: int, prior: np.ndarray, group: np.ndarray | None, start: np.ndarray, rate: float) -> np.ndarray:
    """Parameters after one pass of every shard (shard, h, ids) from ``start``, averaged by tokens."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((prior, group, start))
    dealt = shards.repartition(n, "shard").sortWithinPartitions("shard", "h", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, group, start = shared.value
        trainer, shard, held, lengths, size = None, None, [], [], 0

        def learn() -> None:
            nonlocal held, lengths, size
            if not size:
                return
            ids, first = np.concatenate(held).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])
            one, two = contexts(ids, first)
            for a in range(0, len(ids), step):
                trainer.step(one[a : a + step], two[a : a + step], ids[a : a + step])
            held, lengths, size = [], [], 0

        def out() -> pa.RecordBatch:
            flat = trainer.m.flat()
            blocks = [flat[a : a + _WIRE].tobytes() for a in range(0, len(flat), _WIRE)]
            m = len(blocks)
            return pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([shard] * m, pa.int64()), pa.array([trainer.seen] * m, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "shard", "n", "p"])

        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    if trainer:
                        learn()
                        yield out()
                    shard, trainer = s, Trainer(LogBilinear(prior, group, start), rate)
                held.append(np.frombuffer(ids.as_buffer(), np.uint16))
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= 32 * BATCH:
                    learn()
        if trainer:
            learn()
            yield out()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, seen = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["block", "p"])
        for batch in batches:
            for b, k, p in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "p")), strict=True):
                x = np.frombuffer(p, np.float32).astype(np.float64) * k
                if b != block:
                    if block is not None:
                        yield row()
                    block, total, seen = b, np.zeros(len(x)), 0
                total += x
                seen += k
        if block is not None:
            yield row()

    each = dealt.select("shard", "ids").mapInArrow(run, "block int, shard long, n long, p binary")
    rows = each.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(mean, "block int, p binary").toArrow()
    if not rows.num_rows:
        return start
    blocks = dict(zip(rows["block"].to_pylist(), rows["p"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(blocks[b], np.float32) for b in sorted(blocks)])


def fit(training: DataFrame, counts: DataFrame, frequent: int, shelf: Shelf) -> Scorer:
    """The model of the training rows, each with a ``text``. Equal rows go to one shard."""
    spark, scorer = training.sparkSession, Scorer(counts, frequent)
    shared, n = spark.sparkContext.broadcast(scorer), max(1, -(-scorer.n // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.small_batches(batches):
            t = Tokens(batch.column("text"))
            ids = shared.value.ids(t)[0].astype(np.uint16)
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(2 * t.first.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("h"), body], names=["h", "ids"])

    hashed = training.select(F.xxhash64(*[F.col(f"`{c}`") for c, kind in training.dtypes if "map<" not in kind and "variant" not in kind]).alias("h"), "text")
    shards = shelf.keep(hashed.mapInArrow(run, "h long, ids binary").withColumn("shard", F.pmod("h", F.lit(n))))
    step = min(BATCH, max(256, scorer.n // n // 1024))  # about a thousand steps a shard
    model = LogBilinear(scorer.prior)
    model = LogBilinear(scorer.prior, None, _round(shards, n, step, scorer.prior, None, model.flat(), RATES[0]))
    group, centres = model.clustered(scorer.size, CONTEXTS)
    start = np.concatenate([centres.ravel(), model.weight.ravel(), model.target.ravel()])
    scorer.model = LogBilinear(scorer.prior, group, _round(shards, n, step, scorer.prior, group, start, RATES[1]))
    shelf.drop(shards)
    scorer.normalisers = _normalisers(scorer.model, spark)
    return scorer


def _normalisers(model: LogBilinear, spark) -> np.ndarray:
    """Log normalisers of all pairs of context classes: a row of the table a task's row, of bounded size."""
    shared, n = spark.sparkContext.broadcast(model), len(model.context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([shared.value.normalisers(one).astype(np.float32).tobytes()], pa.binary())], names=["one", "z"])

    rows = spark.range(0, n, 1, min(n, 32)).mapInArrow(run, "one long, z binary").toArrow()
    out = np.empty((n, n), np.float32)
    for one, z in zip(rows["one"].to_pylist(), rows["z"].to_pylist(), strict=True):
        out[one] = np.frombuffer(z, np.float32)
    return out


def _partial(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores of texts but for the counts of rare tokens, whose hashes are listed in ``rare``."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)
    names = {"n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "rare": "array<long>"}

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = shared.value
        for whole in texts:
            chunks = []
            for a, b in textops.pieces([whole], len(whole)):
                t = Tokens(whole.slice(a, b - a))
                token, found, count = s.ids(t)
                one, two = contexts(token, t.first)
                log = s.model.log_prob(one, two, token, s.normalisers).astype(np.float64) / np.log(10)
                count = np.log10(count + 1.0)
                log += np.where((token > 0) & (token <= TAIL), count - s.within[token], 0.0)
                add = lambda x, begin=t.first[:-1]: np.add.reduceat(x, begin)  # noqa: E731  every text has a token: its end
                rare_at = np.concatenate([[0], np.cumsum(add((~found).astype(np.int64)))])
                rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(t.hash[~found].view(np.int64)))
                columns = [pa.array(np.diff(t.first), pa.int64()), pa.array(add(found.astype(np.int64)), pa.int64()), pa.array(add(count)), pa.array(add(log)), rare]
                chunks.append(pa.StructArray.from_arrays(columns, names=list(names)))
            yield pa.concat_arrays(chunks) if chunks else pa.array([], pa.struct([(k, pa.list_(pa.int64()) if k == "rare" else pa.float64() if v == "double" else pa.int64()) for k, v in names.items()]))

    kind = ", ".join(f"{k} {v}" for k, v in names.items())
    return rows.select("row", F.arrow_udf(run, kind)("text").alias("p"))


def lm_scores(docs: DataFrame, train: Column, frequent: int = 1 << 19) -> DataFrame:
    """Adds scores to ``docs`` (with a ``text`` column, which goes), learning from the rows where ``train`` holds.

    n_tokens: words and one end of each text; n_known: those seen in training; train_tokens: all training
    tokens; base_score: log10 probability of the text under add-one counts; score: under the model. A null text
    is empty and has its end only; a very long one is scored whole, by one task. Repeated rows are scored each; other
    columns stay, whatever their names, columns named like the results are replaced; without training rows all tokens
    are unknown. An empty table gives no rows.

    ``frequent`` bounds the broadcast table of counts, of which at most OWN tokens have vectors; it changes no result
    where it holds all of those.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    shelf = Shelf(docs.sparkSession)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    training = docs.where(train).drop(*made)
    counts = shelf.keep(_gathered(training.select("text")))
    scorer = fit(training, counts, frequent, shelf)
    base = [c for c in docs.columns if c not in ("text", *made)]
    rest = F.struct(*[F.col(f"`{c}`") for c in base]) if base else F.lit(None).cast("int")  # one column, so no name can clash
    scored = shelf.keep(_partial(docs.select(rest.alias("row"), "text"), scorer).withColumn("id", F.monotonically_increasing_id()))
    rare = scored.select("id", F.explode("p.rare").alias("h")).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("id").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("seen"))
    out = scored.join(rare, "id", "left")
    more, n_v = F.coalesce("more", F.lit(0.0)), float(np.log10(scorer.n + scorer.v + 1))
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in base],
        F.col("p.n_tokens").alias("n_tokens"),
        (F.col("p.n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(scorer.n).cast("long").alias("train_tokens"),
        (F.col("p.base") + more - F.col("p.n_tokens") * n_v).alias("base_score"),
        (F.col("p.score") + more).alias("score"),
    )
