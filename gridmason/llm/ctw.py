"""Language-model scoring by context-tree weighting over bytes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes of context. A context's subtree below its last two bytes has at most 256 ** (DEPTH - 2) contexts.
DEPTH = 5
#: Depths that one subtree can't settle alone: those of 0 and 1 bytes.
TOP = 2
BITS = 8
#: Characters of text in a block, at least if there are as many in its partition; a block's n-grams and words are looked up together.
BLOCK = 32 << 20
#: Characters handled at once within a block.
PIECE = 1 << 19
#: Unigram smoothing of the base score.
SMOOTH = 0.1
END = b"\n"


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma(z) for z > 0, by Stirling's series at z + 8."""
    shift = np.ones_like(z)
    for k in range(8):
        shift *= z + k
    y = z + 8
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680))) - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def weigh(pe: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a node's own estimate, ln Pw), from ln Pe and the sum of the children's ln Pw."""
    return 1 / (1 + np.exp(np.clip(children - pe, -700, 700))), np.logaddexp(pe, children) - math.log(2)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Settle the nodes of depths `top` to `depth` over n-grams.

    keys: distinct, each the context, last byte highest, then the next byte. counts: how often each occurs in training; 0 for one that is only asked for.
    Returns p (for each key and each of its 8 bits, the probability that the node of depth `top` gives that bit), and per
    context of depth `top` and bit node (1 << k | the k bits before): the context, the bit node, ln Pw.
    """
    x = (keys & np.uint64(255)).astype(np.int64)
    context = keys >> np.uint64(8)
    p = np.full((len(keys), BITS), 0.5)
    below: list[tuple[np.ndarray, np.ndarray] | None] = [None] * BITS
    tops = []
    for d in range(depth, top - 1, -1):
        symbol = (context >> np.uint64(8 * (depth - d)) << np.uint64(8)) | x.astype(np.uint64)
        distinct, inverse = np.unique(symbol, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(distinct))
        for k in range(BITS):
            node = distinct >> np.uint64(BITS - k)  # the context, but for its last k bits those of the next byte
            at = np.cumsum(np.r_[0, node[1:] != node[:-1]])
            bit = (distinct >> np.uint64(BITS - 1 - k) & np.uint64(1)).astype(float)
            ones = np.bincount(at, weights=n * bit)
            zeros = np.bincount(at, weights=n) - ones
            own = at[inverse]
            pe = kt(zeros, ones)
            share = ((zeros + 0.5) / (zeros + ones + 1))[own]
            mine = np.where(x >> (BITS - 1 - k) & 1, 1 - share, share)
            if d == depth:
                p[:, k], pw = mine, pe
            else:
                rows, child = below[k]
                w, pw = weigh(pe, np.bincount(own[rows], weights=child, minlength=len(pe)))
                p[:, k] = w[own] * mine + (1 - w[own]) * p[:, k]
            first = np.empty(len(pe), np.int64)
            first[own] = np.arange(len(own))
            below[k] = (first, pw)
            if d == top:
                tops.append(((node[np.r_[True, node[1:] != node[:-1]]] >> np.uint64(k)), k, first, pw))
    where = np.concatenate([context[first] >> np.uint64(8 * (depth - top)) for _, _, first, _ in tops]) if len(keys) else np.empty(0, np.uint64)
    bits = np.concatenate([(1 << k) | (x[first] >> (BITS - k)) for _, k, first, _ in tops]) if len(keys) else np.empty(0, np.int64)
    pw = np.concatenate([v for *_, v in tops]) if len(keys) else np.empty(0)
    return p, where, bits, pw


def grams(buffer: bytes, depth: int) -> np.ndarray:
    """The key of each byte of buffer after the first `depth`: its context, last byte highest, then the byte."""
    b = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    n = len(b) - depth
    keys = b[depth:].copy()
    for j in range(1, depth + 1):
        keys |= b[depth - j : depth - j + n] << np.uint64(8 * (depth - j + 1))
    return keys


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def pieces(texts: list[str | None], depth: int) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Runs of documents of about PIECE bytes: index of the first, their words, the keys of all their bytes, and where each document's begin.

    A document's bytes are its words joined by blanks, and END; END stands before it, too.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(tokens(text))
        size += len(text or "")
        if size >= PIECE or i == len(texts) - 1:
            parts = [END * depth + b" ".join(words) + END for words in held]
            n = np.array([len(x) - depth for x in parts])
            ends = np.cumsum(n + depth)
            keys = grams(b"".join(parts), depth)
            keep = np.ones(len(keys), bool)
            gaps = (ends[:-1, None] - depth + np.arange(depth)).ravel()
            keep[gaps] = False
            yield first, held, keys[keep], np.cumsum(np.r_[0, n[:-1]])
            first, held, size = i + 1, [], 0


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as compressed bundles of about PIECE characters, and the block of each."""
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 24, 0
    for b in batches:
        ends = np.cumsum(pc.utf8_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(b.slice(at, to - at))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bundle"])
            size += int(ends[to - 1] - done)
            if size >= BLOCK:
                block, size = block + 1, 0
            at = to


def _open(bundle: bytes) -> pa.Table:
    with pa.ipc.open_stream(bundle) as reader:
        return reader.read_all()


def names_of(held: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(the names of all documents' words and ends, in order; how many each document has). A word's name is its XXH64; the end is the word of no bytes."""
    lengths = np.array([len(toks) + 1 for toks in held])
    names = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable((*toks, b"") for toks in held)), np.uint64, lengths.sum())
    return names, lengths


class _Counts:
    """Distinct keys, and the sums of their weights, gathered piece by piece. Pieces are merged as soon as they hold half as many keys as what is merged already."""

    def __init__(self) -> None:
        self.keys, self.sums, self.late = [np.empty(0, np.uint64)], [np.empty(0)], 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        codes, distinct = pd.factorize(keys)
        self.keys.append(distinct)
        self.sums.append(np.bincount(codes, weights=weights, minlength=len(distinct)))
        self.late += len(distinct)
        if self.late > max(len(self.keys[0]) // 2, 1 << 17):
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys)
        keys, sums = keys[order], np.concatenate(self.sums)[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.keys, self.sums, self.late = [keys[first]], [np.add.reduceat(sums, first) if len(keys) else sums], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.keys[0], self.sums[0]


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams and words of each block, with how often they occur in its training documents."""
    block, found = None, (_Counts(), _Counts())

    def asked() -> Iterator[pa.RecordBatch]:
        for is_word, counts in enumerate(found):
            keys, n = counts.total()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), bool(is_word))), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["block", "word", "key", "n"])

    for b in batches:
        for at, bundle in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != block:
                if block is not None:
                    yield from asked()
                block, found = at, (_Counts(), _Counts())
            docs = _open(bundle)
            train = docs.column("train").to_numpy().astype(float)
            for first, held, keys, starts in pieces(docs.column("text").to_pylist(), DEPTH):
                learn = train[first : first + len(held)]
                found[0].add(keys, np.repeat(learn, np.diff(np.r_[starts, len(keys)])))
                names, lengths = names_of(held)
                found[1].add(names, np.repeat(learn, lengths))
    if block is not None:
        yield from asked()


def _nodes(group: pa.Table) -> pa.Table:
    """One subtree: ln Pw of each bit node of depth TOP."""
    _, where, bits, pw = subtree(group.column("key").to_numpy().astype(np.uint64), group.column("n").to_numpy().astype(float), DEPTH, TOP)
    return pa.table({"node": where.astype(np.int64), "bit": bits, "pw": pw})


def settle_top(counts: np.ndarray, children: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight, probability of a zero) of the nodes of depth 1 and of the root, by last byte and bit node (for the root, the same for each byte).

    counts[c, x]: how often byte x follows byte c. children[c, node]: the sum of ln Pw over contexts of depth 2 that end in c.
    """
    nodes = np.arange(256)
    zeros, ones = np.zeros((256, 256)), np.zeros((256, 256))
    for k in range(BITS):
        by = counts.reshape(256, 1 << k, 2, -1).sum(axis=3)
        zeros[:, 1 << k : 2 << k], ones[:, 1 << k : 2 << k] = by[:, :, 0], by[:, :, 1]
    w1, pw1 = weigh(kt(zeros, ones), children)
    z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
    w0, _ = weigh(kt(z0, o0), pw1[:, nodes].sum(axis=0))
    return [(w1, (zeros + 0.5) / (zeros + ones + 1)), (np.tile(w0, (256, 1)), np.tile((z0 + 0.5) / (z0 + o0 + 1), (256, 1)))]


def _price(top):
    """One subtree, below the settled nodes of the broadcast `top`: the log10 probability of each key's byte."""

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        p, *_ = subtree(keys.astype(np.uint64), group.column("n").to_numpy().astype(float), DEPTH, TOP)
        x, c = keys & 255, keys >> (8 * DEPTH) & 255
        cost = np.zeros(len(keys))
        for k in range(BITS):
            node, bit = (1 << k) | (x >> (BITS - k)), x >> (BITS - 1 - k) & 1
            q = p[:, k]
            for w, zero in top.value:
                share = zero[c, node]
                q = w[c, node] * np.where(bit, 1 - share, share) + (1 - w[c, node]) * q
            cost += np.log10(q)
        return pa.table({"of_key": keys, "cost": cost})

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long, vocabulary long"


def _score(bundles: pa.Table, answers: pa.Table) -> pa.Table:
    """The sums of a block's documents, from the figures of its n-grams and words; and a row with how many training words are named here first."""
    of_word, key, value = (answers.column(c).to_numpy(zero_copy_only=False) for c in ("word", "key", "value"))
    of_word, key = of_word.astype(bool), key.view(np.uint64)
    vocabulary = int((answers.column("first").to_numpy(zero_copy_only=False).astype(bool) & of_word & (value > 0)).sum())

    def sheet(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = key[mask], value[mask]
        order = np.argsort(keys)
        return keys[order], values[order]

    (names, uses), (grams_of, cost) = sheet(of_word), sheet(~of_word)
    del of_word, key, value, answers
    log_uses = np.log10(uses + SMOOTH)
    out = []
    for bundle in bundles.column("bundle").to_pylist():
        docs = _open(bundle)
        n = docs.num_rows
        base, score, n_tokens, n_known, n_bytes = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for first, held, found, starts in pieces(docs.column("text").to_pylist(), DEPTH):
            some = slice(first, first + len(held))
            n_bytes[some] = np.diff(np.r_[starts, len(found)])
            codes, distinct = pd.factorize(found)
            score[some] = np.add.reduceat(cost[np.searchsorted(grams_of, distinct)][codes], starts)
            words, lengths = names_of(held)
            codes, distinct = pd.factorize(words)
            at = np.searchsorted(names, distinct)
            from_ = np.cumsum(lengths) - lengths
            base[some], n_known[some], n_tokens[some] = np.add.reduceat(log_uses[at][codes], from_), np.add.reduceat((uses[at] > 0).astype(np.int64)[codes], from_), lengths
        out.append(pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "log_counts": base, "score": score, "n_bytes": n_bytes, "vocabulary": pa.nulls(n, pa.int64())}))
    out.append(pa.table({"vocabulary": pa.array([vocabulary], pa.int64())} | {f.name: pa.nulls(1, f.type) for f in out[0].schema if f.name != "vocabulary"}).select(out[0].column_names))
    return pa.concat_tables(out)


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every document.

    The model is a context tree over bytes: each next byte is eight binary decisions, each predicted by mixing, from DEPTH bytes of context to none, the
    Krichevsky-Trofimov estimates, weighted as the training text's code lengths bid. A document's bytes are its lower-cased words joined by blanks, and an end, so score and
    base_score are of the same tokens. score / log10(2), negated, is the code length in bits, and bits_per_byte that over n_bytes, the end among them.

    Documents are held in blocks of about BLOCK characters. A block asks for its distinct n-grams and words; their counts are summed over all blocks, subtrees of the
    context tree are settled in parallel, the nodes of 0 and 1 bytes (65,536 at most) on the driver, and the block gets back the figures it asked for.
    So no table of the whole corpus is sent anywhere, and every n-gram counts. Words go by their 64-bit hashes.

    Nulls: a null text is an empty one (its end alone is scored); a null id isn't held out. Repeated rows count and are scored each. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    held = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held.alias("held_out"), (~held).alias("train"), F.col(text).alias("text"))
    bundles = stored(rows.coalesce(max(1, -(-total // BLOCK))).mapInArrow(_bundle, "block long, bundle binary"), "none")
    asked = stored(bundles.mapInArrow(_ask, "block long, word boolean, key long, n long"))
    grams_asked, words_asked = asked.where("not word").drop("word"), asked.where("word").drop("word")
    counts = stored(grams_asked.groupBy("key").agg(F.sum("n").alias("n"))).withColumn("branch", F.shiftright("key", 8 * (DEPTH - TOP + 1)))
    nodes = counts.groupBy("branch").applyInArrow(_nodes, "node long, bit long, pw double")
    after, children = np.zeros((256, 256)), np.zeros((256, 256))
    last, byte = F.shiftright("key", 8 * DEPTH), F.col("key").bitwiseAND(255)
    for r in counts.groupBy(last.alias("c"), byte.alias("x")).agg(F.sum("n").alias("n")).collect():
        after[r.c, r.x] = r.n
    for r in nodes.groupBy(F.shiftright("node", 8).alias("c"), "bit").agg(F.sum("pw").alias("pw")).collect():
        children[r.c, r.bit] = r.pw
    top = spark.sparkContext.broadcast(settle_top(after, children))
    prices = counts.groupBy("branch").applyInArrow(_price(top), "of_key long, cost double")
    of_grams = grams_asked.join(prices, F.col("key") == F.col("of_key")).select("block", F.lit(False).alias("word"), "key", F.col("cost").alias("value"), F.lit(False).alias("first"))
    # a word has one row a block, so even a very common one has few
    of_key = Window.partitionBy("key").orderBy("block")
    of_words = words_asked.select("block", F.lit(True).alias("word"), "key", F.sum("n").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double").alias("value"), (F.row_number().over(of_key) == 1).alias("first"))
    scored = stored(bundles.groupBy("block").cogroup(of_grams.unionByName(of_words).groupBy("block")).applyInArrow(_score, SCORED))
    n = words_asked.agg(F.sum("n")).first()[0] or 0
    v = scored.agg(F.sum("vocabulary")).first()[0] or 0
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(n + SMOOTH * (v + 1))
    return scored.where("vocabulary is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The figures of every row of documents, as score has them, and the code length per byte: a null text is its end alone, repeated rows count and are scored each, an empty table gives no rows."""
    return score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
