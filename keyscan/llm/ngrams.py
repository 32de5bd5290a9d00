"""Stupid-backoff language-model scores over the corpus itself, by tables of n-gram counts that are dealt out by hash.

Documents are dealt into chunks by hash. A chunk explodes its texts into n-grams, counts each once, and sends (hash,
count) to the count table's partition that owns the hash; rows of one chunk and partition travel packed, so that a very
common n-gram is one entry a chunk. The partitions sum and answer each chunk in the order of its hashes; joined to the
chunk's exploded n-grams the answers give each token's score, and these are summed by document.

Single tokens and pairs are counted first. A longer n-gram cannot stand ``min_count`` times unless both shorter ones in
it do, so that only such are exploded, order by order; this leaves nothing out.

N-grams go by 64-bit hashes. Chunks and partitions grow with the root of the input, so that a packed row keeps some
hundreds of entries and the number of rows grows in proportion to the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Bytes of text a chunk and a count partition have at least, and bytes of text for each packed row.
CHUNK_BYTES, ROW_BYTES = 8 << 20, 1280


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pairs (a, b)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x5851F42D4C957F2D))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' tokens: their hashes, how many tokens of the text stand before, and each text's token count.

    Tokens are what white space parts, A-Z lower-cased.
    """
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh64_intdigest
    one = np.array([digest(w) for ws in words for w in ws], np.uint64)
    return one, np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def longer(grams: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end in each token, from those of one token less; of no use where a text begins."""
    out = np.zeros(len(one), np.uint64)
    out[1:] = _mixed(grams[:-1], one[1:])
    return out


def _packed(values: np.ndarray) -> bytes:
    """Bytes by significance, compressed: sorted values differ little in their high bytes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which count partition owns a hash; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Counts:
    """A chunk's tokens, and how often the n-grams that end in each stand in the corpus, order by order as answers come."""

    def __init__(self, table: pa.Table, min_count: int):
        self.one, self.before, self.sizes = tokens(table.column("t").to_pylist())
        self.least, self.grams, self.counts = min_count, self.one, []

    def request(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, counts) of the n-grams to ask for next, distinct and rising, and the place of each asked one there."""
        if not self.counts:
            self.grams = longer(self.one, self.one)
            asked = [self.one, self.grams[self.before > 0]]
        else:
            self.grams, last = longer(self.grams, self.one), self.counts[-1] >= self.least
            self.wanted = last & (self.before >= len(self.counts))
            self.wanted[1:] &= last[:-1]
            asked = [self.grams[self.wanted]]
        keys, at, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        self.at = at
        return keys, n

    def answered(self, totals: np.ndarray) -> None:
        """Take what the corpus holds of the n-grams asked for last."""
        found = totals[self.at]
        if not self.counts:
            pairs = np.zeros(len(self.one), np.int64)
            pairs[self.before > 0] = found[len(self.one) :]
            self.counts = [found[: len(self.one)], pairs]
        else:
            self.counts.append(np.zeros(len(self.one), np.int64))
            self.counts[-1][self.wanted] = found

    def replay(self, answers: pa.Table, rounds: int) -> None:
        """Ask and take again what so many rounds answered; none answers where nothing was asked."""
        of = answers.column("round").to_numpy()
        for k in range(rounds):
            self.request()
            mine = answers.filter(pa.array(of == k))
            got = sorted(zip(mine.column("part").to_pylist(), mine.column("totals").to_pylist(), strict=True))
            self.answered(np.concatenate([np.empty(0, np.int64), *(_unpacked(x, np.int64) for _, x in got)]))


def score(docs: DataFrame, text: str, *carry: str, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """``*carry, n_tokens, logprob, score``: each text's log10 score and its mean over tokens.

    A token's score is count(n-gram) / count(n-gram without it) of the longest n-gram of up to ``order`` tokens that ends
    in it and stands at least ``min_count`` times in the corpus, times 0.4 for each order above that; where no pair does,
    its own share of all tokens takes the place of the ratio. The texts are part of the corpus, so that with a
    ``min_count`` of 1 whatever stands nowhere else would count as certain. Null and empty texts have no tokens, logprob 0
    and score null. Repeated rows count as often as they stand there, and are scored alike; an empty table gives an empty
    result. Text of any length is taken whole; other columns are left out.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = parts = max(1, math.ceil(size / max(CHUNK_BYTES, math.isqrt(ROW_BYTES * size))))
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(text).alias("t"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(chunks)).cast("int"))

    def asked(table: pa.Table, counts: Counts) -> pa.Table:
        """One chunk's requests, packed by partition."""
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()))})
        keys, n = counts.request()
        edges = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        out = [(p, _packed(keys[a:b]), _packed(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})

    def ask(table: pa.Table) -> pa.Table:
        return asked(table, Counts(table, min_count))

    def ask_longer(rounds: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            counts = Counts(table, min_count)
            counts.replay(answers, rounds)
            return asked(table, counts)

        return run

    def answer(table: pa.Table) -> pa.Table:
        """One partition of the count table: sums over all chunks, sent back in each chunk's order."""
        keys = [_unpacked(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, counts).astype(np.int64)[at]
        back = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([_packed(x) for x in back], pa.binary())})

    def join(table: pa.Table, answers: pa.Table) -> pa.Table:
        """One chunk's exploded n-grams joined to their counts, summed by document."""
        counts = Counts(table, min_count)
        counts.replay(answers, order - 1)
        one, used = counts.counts[0], np.zeros(len(counts.one), np.int64)
        logs = np.log10(np.maximum(one, 1))
        for k in range(1, order):
            seen = counts.counts[k] >= min_count
            ratio = counts.counts[k][seen] / counts.counts[k - 1][np.flatnonzero(seen) - 1]
            logs[seen], used[seen] = np.log10(ratio), k
        logs += (order - 1 - used) * math.log10(BACKOFF)
        edges = np.concatenate([[0], np.cumsum(counts.sizes)])
        shares = np.concatenate([[0], np.cumsum(used == 0)])
        by_doc = [float(logs[a:b].sum()) for a, b in zip(edges, edges[1:], strict=False)]
        columns = {f"c{k}": table.column(f"c{k}") for k in range(len(carry))}
        return pa.table(columns | {"n_tokens": pa.array(counts.sizes), "logs": pa.array(by_doc, pa.float64()), "shares": pa.array(shares[edges[1:]] - shares[edges[:-1]], pa.int64())})

    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[: len(carry)]))
    request = "part int, chunk int, keys binary, counts binary"
    dealt, answers = rows.groupBy("chunk"), None
    for k in range(order - 1):
        requests = dealt.applyInArrow(ask, request) if answers is None else dealt.cogroup(answers.groupBy("chunk")).applyInArrow(ask_longer(k), request)
        more = requests.groupBy("part").applyInArrow(answer, "chunk int, part int, totals binary").withColumn("round", F.lit(k))
        answers = more if answers is None else answers.unionByName(more)
    summed = cut(dealt.cogroup(answers.groupBy("chunk")).applyInArrow(join, kinds + "n_tokens long, logs double, shares long"))
    total = summed.agg(F.sum("n_tokens")).first()[0] or 1
    logprob = F.col("logs") - F.col("shares") * F.log10(F.lit(float(total)))
    return summed.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), "n_tokens", logprob.alias("logprob"), F.when(F.col("n_tokens") > 0, logprob / F.col("n_tokens")).alias("score"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, logprob, score`` of every document: ``score`` with its defaults, rounded."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")
    return out.select("doc_id", "n_tokens", F.round("logprob", 4).alias("logprob"), F.round("score", 6).alias("score"))


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT r, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT p.r, log10(CASE WHEN c3.c >= {MIN_COUNT} THEN c3.c / h.c WHEN c2.c >= {MIN_COUNT} THEN {BACKOFF} * c2.c / x.c ELSE {BACKOFF} * {BACKOFF} * c1.c / (SELECT count(*) FROM p) END) AS l
      FROM p JOIN c1 ON p.w = c1.w LEFT JOIN c1 x ON p.v = x.w LEFT JOIN c2 ON p.v = c2.v AND p.w = c2.w
      LEFT JOIN c2 h ON p.u = h.v AND p.v = h.w LEFT JOIN c3 ON p.u = c3.u AND p.v = c3.v AND p.w = c3.w),
g AS (SELECT r, sum(l) AS l FROM s GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(l, 0), 4) AS logprob, round(l / len(w), 6) AS score FROM d LEFT JOIN g USING (r)
"""
