"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, media, mixing, neighbours, ngrams, quality, simhash, suffixes, toxicity, warc

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_media_columns": media.op2_media_columns,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_stupid_backoff": ngrams.op9_stupid_backoff,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {"op1_warc_revisits": warc.ORACLE, "op6_mixing": mixing.ORACLE, "op9_stupid_backoff": ngrams.ORACLE}
