"""Term weights, containment of texts, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let


#: Letters of a piece; runs are cut from pieces, as cutting from a long text counts its letters from the start each time.
PIECE = 128


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of the text, n from low to high (at most ``PIECE``), piece by piece."""
    if high > PIECE:
        raise ValueError(f"n-grams of more than {PIECE} letters")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # each piece with its number of letters and the first letters of what follows
    after = lambda p: F.zip_with(p, F.slice(F.concat(p, F.array(F.lit(""))), 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.struct(F.length(x).alias("n"), F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, high - 1)).alias("t")))

    def of(z: Column, n: int) -> Column:
        last = F.least(z["n"], F.length(z["t"]) - n + 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(z["t"], i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(let(pieces, after), lambda z: F.concat(*[of(z, n) for n in range(low, high + 1)])))


def tfidf(rows: DataFrame, row_id: str, terms: Column, least_df: int = 2, most_terms: int | None = None) -> DataFrame:
    """(id, term, weight): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), each row's weights of length 1.

    ``most_terms``: only so many terms with the most occurrences in all rows
    are kept, ties to the smaller term; an exact top k, whose k rows are what
    reaches one task.
    """
    tf = rows.select(row_id, F.explode(terms).alias("term")).groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("_tf").alias("_all")).where(F.col("_df") >= least_df)
    if most_terms is not None:
        df = df.orderBy(F.col("_all").desc(), "term").limit(most_terms)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))  # one row
    raw = tf.join(df.drop("_all"), "term").crossJoin(F.broadcast(n)).select(row_id, "term", ((1 + F.ln("_tf")) * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).alias("_w"))
    norm = raw.groupBy(row_id).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, row_id).select(row_id, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def word_grams(text: Column, k: int) -> Column:
    """Distinct runs of k words, lower case, joined by a blank."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")))
    return let(words, lambda w: F.when(F.size(w) >= k, runs(w)).otherwise(F.array().cast("array<string>")))


def containment(texts: DataFrame, text_id: str, probes: DataFrame, probe_id: str, text: str = "text", k: int = 8) -> DataFrame:
    """(text_id, probe_id, shared, contained): the share of a probe's k-word runs that stand in a text.

    Probes and texts of fewer than k words have no runs and give no rows. Runs
    of the texts are held against the distinct hashes of the probes' runs
    first, so that only the few that may match move with their words.
    """
    a = texts.select(text_id, F.explode(word_grams(F.col(text), k)).alias("g")).select(text_id, F.xxhash64("g").alias("h"), "g")
    b = probes.select(probe_id, word_grams(F.col(text), k).alias("gs")).select(probe_id, F.size("gs").alias("_n"), F.explode("gs").alias("g")).select(probe_id, "_n", F.xxhash64("g").alias("h"), F.col("g").alias("_g"))
    hashes = b.select("h").distinct()
    if few(hashes):  # 8 bytes each; beyond that the join shuffles both sides
        a = a.join(F.broadcast(hashes), "h", "left_semi")
    found = a.join(b, "h").where(F.col("g") == F.col("_g")).groupBy(text_id, probe_id, "_n").agg(F.count(F.lit(1)).alias("shared"))
    return found.select(text_id, probe_id, "shared", (F.col("shared") / F.col("_n")).alias("contained"))


def few(rows: DataFrame, most: int = 1_000_000) -> bool:
    """Whether there are at most so many rows (a job that stops at that number), so that they may be broadcast."""
    return rows.limit(most + 1).count() <= most


def sections(html: Column, tokens: Sequence[str], longest: int = 1800) -> Column:
    """Array of (heading, cut) of h1 to h6 headings that hold one of the tokens; heading is cut to ``longest`` characters."""
    headings = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    wanted = F.filter(headings, lambda h: F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower(h), t)))
    return F.transform(wanted, lambda h: F.struct(F.substring(h, 1, longest).alias("heading"), (F.length(h) > longest).alias("cut")))


def position_profile(rows: DataFrame, text: str) -> DataFrame:
    """(position, n, consensus, share, gaps): the most frequent character at each place, ties to the smaller."""
    chars = rows.select(F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("position", "c"))
    per = chars.groupBy("position", "c").agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy("position").agg(F.sum("_n").alias("n"), F.max(F.struct(F.col("_n"))).alias("_m"), F.min_by("c", F.struct(-F.col("_n"), F.col("c"))).alias("consensus"), F.coalesce(F.sum(F.when(F.col("c") == "-", F.col("_n"))), F.lit(0)).alias("_gaps"))
    return g.select("position", "n", "consensus", (F.col("_m._n") / F.col("n")).alias("share"), (F.col("_gaps") / F.col("n")).alias("gaps"))


def spectrum(rows: DataFrame, group: str, text: str, bins: int = 32, missing: str = "N") -> DataFrame:
    """(group, bin, value) for every bin: the shares of a group's rows that have a character (other than ``missing``) at a position, summed over a bin's positions and divided by all positions.

    Positions go to the longest row's end and are dealt to bins of equal width
    (one position at least).
    """
    texts = rows.where(F.length(text) > 0).select(group, F.col(text).alias("_t"))
    size = rows.groupBy(group).agg(F.max(F.length(text)).alias("_l"), F.count(F.lit(1)).alias("_n"))
    spots = texts.select(group, F.posexplode(F.split("_t", "")).alias("_i", "_c")).where(~F.col("_c").isin("", missing)).groupBy(group, "_i").agg(F.count(F.lit(1)).alias("_k"))
    place = F.least(F.floor(F.col("_i") / F.greatest(F.col("_l") / bins, F.lit(1.0))), F.lit(bins - 1)).cast("int")
    summed = spots.join(size, group).groupBy(group, place.alias("bin")).agg(F.sum(F.col("_k") / F.col("_n") / F.col("_l")).alias("_v"))
    every = size.select(group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(summed, [group, "bin"], "left").select(group, "bin", F.coalesce("_v", F.lit(0.0)).alias("value"))
