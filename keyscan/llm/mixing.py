"""Mixing documents to target weights by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic). The cells' weights are raked in turn to each
dimension's targets until none is missed by more than a tolerance; a document is kept with the probability that its
cell's raked weight asks for, by a hash of its key, and carries the weight that makes up for probabilities cut at 1. Only
cells are raked: by the driver where they are counted to be few, else each step a sum over the cells of one value of one
dimension.

The tables have no topics. A text's topic is the group of words that it holds most of, against what all texts hold: every
word of five letters or more of the whole text counts for one of ``TOPICS`` groups, by its first three letters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, small_batches

DIMENSIONS = ("source", "lang", "topic")
TOPICS, POWER = 8, 0.7
#: Raking ends when no target is missed by more than this share of it, and after so many rounds at the latest.
TOLERANCE, ROUNDS = 1e-10, 60
#: Cells up to this number, counted first, are raked by the driver and broadcast; more stay distributed.
BROADCAST_CELLS = 20_000
#: Words that count for a topic have so many letters; each of the first ones tells its place in the alphabet times a factor.
TOPIC_WORD, FACTORS, LETTERS = 5, (1, 3, 5), "abcdefghijklmnopqrstuvwxyz"
_PLACE = {c: k + 1 for letters in (LETTERS, LETTERS.upper()) for k, c in enumerate(letters)}


def tokens_of(text: Column) -> Column:
    """White space plus one: a text's size in tokens, near enough for weights. Null and empty: 0."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " \t\n\r", "")) + 1).cast("long")


def hashed(text: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


# fixed values: the white space of Python's str.split(), as DuckDB's patterns write it
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


class _Groups(dict):
    """The group of a word's first letters; bounded, as it starts anew when it is large."""

    def __missing__(self, start: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[start] = found = sum(f * _PLACE.get(c, 0) for f, c in zip(FACTORS, start, strict=True)) % TOPICS
        return found


_groups = _Groups()


def word_groups(text: str | None) -> list[int]:
    """How many words of the whole text each topic's group has. Null: no words."""
    found = Counter([_groups[w[: len(FACTORS)]] for w in (text or "").split() if len(w) >= TOPIC_WORD])
    return [found[k] for k in range(TOPICS)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def topic_counts(text: pd.Series) -> pd.Series:
    """``word_groups`` of each text."""
    return text.map(word_groups)


def topics(docs: DataFrame, text: str = "text") -> Column:
    """The topic of each of these texts, ``t0`` and on: the group with the largest share of all its words; of ties the first."""
    small_batches(docs.sparkSession)
    sums = docs.select(topic_counts(F.col(text)).alias("n")).agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(TOPICS))).first()
    share = F.transform(topic_counts(F.col(text)), lambda n, k: n / F.array(*(F.lit(float(x or 1)) for x in sums))[k])
    return F.concat(F.lit("t"), (F.array_position(share, F.array_max(share)) - 1).cast("string"))


def _aims(cells: DataFrame, targets: dict[str, dict[str, float]], power: float) -> DataFrame:
    """``cells`` with ``aim_*``: the tokens that each dimension's value of the cell is to have."""
    own = {d: cells.groupBy(d).agg(F.sum("w0").alias("own")) for d in DIMENSIONS}
    total = cells.agg(F.sum("w0")).first()[0] or 0.0
    rows = cells
    for d in DIMENSIONS:
        mine = F.sum("w0").over(Window.partitionBy(d))
        if named := targets.get(d):
            free = own[d].where(~F.col(d).isin(*named)).agg(F.sum("own")).first()[0] or 1.0
            aim = mine / free * max(0.0, 1 - sum(named.values()))
            for value, share in named.items():
                aim = F.when(F.col(d) == value, F.lit(float(share))).otherwise(aim)
        else:
            whole = own[d].agg(F.sum(F.pow("own", F.lit(power)))).first()[0] or 1.0
            aim = F.pow(mine, F.lit(power)) / whole
        rows = rows.withColumn(f"aim_{d}", aim * total)
    return rows


def _missed(now: Column, aim: Column) -> Column:
    """By what share of it a target is missed; targets that nothing can meet do not count."""
    return F.when((now > 0) & (aim > 0), F.abs(now / aim - 1)).otherwise(0.0)


def _raked_here(rows: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """Raking of few cells by the driver."""
    table = rows.orderBy(*DIMENSIONS).toPandas()
    codes = [table[d].factorize()[0] for d in DIMENSIONS]
    w = table["w0"].to_numpy(np.float64).copy()
    aims = [table[f"aim_{d}"].to_numpy(np.float64) for d in DIMENSIONS]
    sums = lambda code: np.bincount(code, w, minlength=1)[code]
    for _ in range(rounds):
        for code, aim in zip(codes, aims, strict=True):
            now = sums(code)
            w = np.where(now > 0, w * aim / np.where(now > 0, now, 1), 0.0)
        missed = [np.abs(now / aim - 1)[(now > 0) & (aim > 0)] for now, aim in ((sums(c), np.maximum(a, 1e-300)) for c, a in zip(codes, aims, strict=True))]
        if max(m.max(initial=0.0) for m in missed) <= tolerance:
            break
    table["w"] = w
    return rows.sparkSession.createDataFrame(table[[*DIMENSIONS, "w0", "w"]])


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``*DIMENSIONS, ratio``: what each cell's tokens ``w0`` must be multiplied by to meet the targets.

    ``targets[dimension][value]`` is a share of all tokens; values not named share the rest as they do now. A dimension
    without targets aims at its own shares to the power ``power``, so that small values gain. No cell: no row. Targets
    that contradict each other are raked for ``rounds`` rounds; ``residual`` tells what they are missed by.
    """
    rows = cut(_aims(cells, targets or {}, power))
    if rows.isEmpty():
        return rows.select(*DIMENSIONS, F.lit(1.0).alias("ratio"))
    if rows.count() <= BROADCAST_CELLS:
        rows = _raked_here(rows, rounds, tolerance)
    else:
        rows = rows.withColumn("w", F.col("w0"))
        for k in range(rounds):
            for d in DIMENSIONS:
                now = F.sum("w").over(Window.partitionBy(d))
                rows = rows.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"aim_{d}") / now).otherwise(0.0))
            if k % 4 == 3:  # plans of very many windows are slow to make
                rows = cut(rows)
                if _residual(rows) <= tolerance:
                    break
    return rows.select(*DIMENSIONS, F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(1.0).alias("ratio"))


def _residual(rows: DataFrame) -> float:
    found = [rows.groupBy(d).agg(F.sum("w").alias("now"), F.first(f"aim_{d}").alias("aim")).agg(F.max(_missed(F.col("now"), F.col("aim")))).first()[0] for d in DIMENSIONS]
    return max(x or 0.0 for x in found)


def residual(cells: DataFrame, ratios: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER) -> float:
    """The largest share of a target by which ``rake``'s ratios miss it."""
    rows = _aims(cells, targets or {}, power).join(ratios, list(DIMENSIONS))
    return _residual(rows.withColumn("w", F.col("w0") * F.col("ratio")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, **how) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_tokens``, ``topic``, ``probability``, ``weight`` of the documents kept.

    ``topic`` is that of ``topics`` unless given; ``how`` goes to ``rake``. Null sources and languages are values of their own, spelled ''; a document without tokens has its cell's ratio like
    any other (1 where the whole cell has none). Rows of one key are kept or dropped together; the null key is one key.
    """
    cell = [F.coalesce(F.col(f"row.{d}").cast("string"), F.lit("")).alias(d) for d in ("source", "lang")]
    topic = topics(docs, text) if topic is None else topic
    rows = docs.select(F.struct("*").alias("row"), tokens_of(F.col(text)).alias("n_tokens"), topic.alias("topic")).select("row", "n_tokens", *cell, "topic")
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("w0")))
    ratios = cut(rake(cells, **how))
    found = F.broadcast(ratios) if ratios.count() <= BROADCAST_CELLS else ratios
    draw = hashed(F.concat(F.lit("mix:"), F.coalesce(F.col(f"row.{key}").cast("string"), F.lit("")))) / F.lit(float(1 << 32))
    return (
        rows.join(found, list(DIMENSIONS))
        .withColumn("probability", F.least(F.lit(1.0), F.col("ratio")))
        .where(draw < F.col("probability"))
        .select("row", "n_tokens", "source", "lang", "topic", "probability", F.greatest(F.lit(1.0), F.col("ratio")).alias("weight"))
    )


def copies(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each row of ``mix`` as often as its weight: the whole part of it, and once more by a hash of the key for the rest."""
    draw = hashed(F.concat(F.lit("copy:"), F.coalesce(F.col(f"row.{key}").cast("string"), F.lit("")))) / F.lit(float(1 << 32))
    n = (F.floor("weight") + (draw < F.col("weight") - F.floor("weight")).cast("int")).cast("int")
    return mixed.select("*", F.explode(F.sequence(F.lit(1), n)).alias("copy"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that ``mix`` keeps, with their topics, sizes, probabilities and weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs).select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"))


def _oracle() -> str:
    """The same in DuckDB's SQL, every step a table of its own; rounds after targets are met change nothing."""
    sums = ", ".join(f"sum(w0) OVER (PARTITION BY {d}) AS own_{d}" for d in DIMENSIONS)
    aims = ", ".join(f"pow(own_{d}, {POWER}) / (SELECT sum(pow(x, {POWER})) FROM (SELECT sum(w0) AS x FROM c GROUP BY {d})) * (SELECT sum(w0) FROM c) AS aim_{d}" for d in DIMENSIONS)
    steps, last = [], "s0"
    for k in range(1, ROUNDS * len(DIMENSIONS) + 1):
        d = DIMENSIONS[(k - 1) % len(DIMENSIONS)]
        steps.append(f"s{k} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * aim_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM {last})")
        last = f"s{k}"
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
    group = " + ".join(f"{f} * instr('{LETTERS}', substr(x, {k + 1}, 1))" for k, f in enumerate(FACTORS))
    counts = ", ".join(f"len(list_filter(g, lambda x: x = {k})) AS n{k}" for k in range(TOPICS))
    shares = ", ".join(f"n{k} / greatest(1.0, (SELECT sum(n{k}) FROM m))" for k in range(TOPICS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(translate(t, '{LETTERS.upper()}', '{LETTERS}'), '{_SPACE}'), lambda x: length(x) >= {TOPIC_WORD}), lambda x: ({group}) % {TOPICS}) AS g FROM d),
m AS MATERIALIZED (SELECT * EXCLUDE (g), {counts} FROM w),
a AS (SELECT *, [{shares}] AS share FROM m),
r AS MATERIALIZED (SELECT doc_id, source, lang, 't' || (list_position(share, list_max(share)) - 1) AS topic,
      CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(translate(t, ' ' || chr(9) || chr(10) || chr(13), '')) + 1 END AS BIGINT) AS n_tokens FROM a),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS w0 FROM r GROUP BY ALL),
o AS (SELECT *, {sums} FROM c),
s0 AS MATERIALIZED (SELECT *, {aims}, w0 AS w FROM o),
{", ".join(steps)},
q AS (SELECT source, lang, topic, CASE WHEN w0 > 0 THEN w / w0 ELSE 1 END AS ratio FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, ratio), 6) AS probability, round(greatest(1.0, ratio), 6) AS weight
FROM r JOIN q USING (source, lang, topic)
WHERE {h("'mix:' || coalesce(CAST(doc_id AS VARCHAR), '')")} / 4294967296.0 < least(1.0, ratio)
"""


ORACLE = _oracle()
