"""Quality rules: base rules, and perplexity under n-gram models with language-specific bands.

The model (:mod:`char_model`) is modified Kneser-Ney over five characters, one for each value of ``lang``, counted by Spark over
all documents and stored in sorted hash arrays. Two of its log-perplexities judge a text, both per character: ``fifth``, that of
order 5, whose exponential is the ``perplexity``, and ``third``, that of order 3, which counts kinds of neighbours only, so that patterns
which few documents repeat very often stay unlikely.

Bands: per language, all documents that pass the base rules give a histogram of each log-perplexity (bins of 0.005). A band
reaches ``widths`` robust standard deviations below and above the median; each side has its own deviation, from the quartile
on that side, to which noise of ``slack`` x median / sqrt(characters) is added in squares, for short texts. Texts outside either band are rejected.

Cases: a null text has no words; texts without a word fail the base rules; a null language is a language of its own; a language's
quartiles count as its n documents, those of all documents as ``prior`` more, so no document's arrival switches a band; repeated rows count and are judged
each; very long texts are counted and scored whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import char_model
from ._common import written

#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
BIN = 0.005
MEASURES = ("fifth", "third")
WIDTHS = {"fifth": 5.0, "third": 3.0}
SLACK = 0.15


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeated = 0
    if len(words) > 5:
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
        if len(ids) < len(words):
            window = np.zeros(len(words) - 4, np.uint64)
            for k in range(5):
                window = window * np.uint64(0x9E3779B97F4A7C15) + number[k : len(words) - 4 + k] + np.uint64(1)
            order = np.argsort(window, kind="stable")
            same = window[order[1:]] == window[order[:-1]]
            twice = np.zeros(len(window), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.flatnonzero(twice), 1)
            np.add.at(edge, np.flatnonzero(twice) + 5, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", batch_bytes: int = char_model.BATCH_BYTES) -> DataFrame:
    """doc_id, lang, n_chars, the base counts, base_failed; fifth and third, the log-perplexities of characters (null without one)."""

    def row(value: str | None) -> tuple:
        return *base_counts(value or ""), len(value or "")

    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long"
    found = char_model.score(docs, row, columns, text=text, lang=lang, key=key, batch_bytes=batch_bytes)
    return found.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def bands(measured: DataFrame, *, prior: int = 50) -> DataFrame:
    """measure, lang, median, below, above: median and robust deviations of each log-perplexity in each language, from a histogram of all documents."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in MEASURES]))
    values = measured.where(~F.col("base_failed")).select("lang", both.alias("_v")).select("lang", "_v.*")
    binned = values.groupBy("measure", "lang", F.floor(F.col("value") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    everyone = binned.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select("measure", F.lit(None).cast("string").alias("lang"), "bin", "n")
    rows = binned.select("measure", "lang", "bin", "n").unionByName(everyone)
    upto = F.sum("n").over(Window.partitionBy("measure", "lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("measure", "lang"))
    rows = rows.withColumns({"upto": upto, "total": total})

    def quartile(q: float) -> Column:
        return (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) + 0.5) * BIN

    found = rows.groupBy("measure", "lang").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"), F.max("total").alias("total"))
    overall = found.where("lang IS NULL").select("measure", *[F.col(q).alias(f"_{q}") for q in ("q1", "q2", "q3")])
    drawn = {q: (F.col("total") * F.col(q) + prior * F.col(f"_{q}")) / (F.col("total") + prior) for q in ("q1", "q2", "q3")}
    found = found.where("lang IS NOT NULL").join(F.broadcast(overall), "measure").withColumns(drawn)  # two rows
    deviation = lambda x: F.greatest(x / 0.6745, F.lit(BIN))
    return found.select("measure", "lang", F.col("q2").alias("median"), deviation(F.col("q2") - F.col("q1")).alias("below"), deviation(F.col("q3") - F.col("q2")).alias("above"))


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", widths: dict[str, float] = WIDTHS, slack: float = SLACK, batch_bytes: int = char_model.BATCH_BYTES) -> DataFrame:
    """key, the base counts, base_failed, perplexity, kept of every document."""
    joined = written(measure(docs, text=text, lang=lang, key=key, batch_bytes=batch_bytes), "measured")
    limits, inside = written(bands(joined), "bands"), F.lit(True)
    for m in MEASURES:
        own = limits.where(F.col("measure") == m).select("lang", *[F.col(c).alias(f"{c}_{m}") for c in ("median", "below", "above")])
        joined = joined.join(own, "lang", "left")
        off = F.col(m) - F.col(f"median_{m}")
        side = F.when(off < 0, F.col(f"below_{m}")).otherwise(F.col(f"above_{m}"))
        inside &= F.abs(off) <= widths[m] * F.hypot(side, slack * F.col(f"median_{m}") / F.sqrt(F.greatest("n_chars", F.lit(1))))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.exp("fifth").alias("perplexity"), kept.alias("kept"))
