"""Column functions for text: normalising, keys, flags, scores. All stay inside code generation."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f\x0B]+"
#: Spellings that stand for a missing value.
MISSING = ["", "na", "n/a", "null", "[null]", "none", "-", "nan"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row even where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_upper(text: Column) -> Column:
    """Upper case of a-z only, so that every engine agrees."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def reasons(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that hold, in the order given; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(when, F.lit(message)) for when, message in rules]))


def normalise(text: Column, allowed: str, ambiguous: str = "", shortest: int = 20, longest: int = 100_000, usual: tuple[int, int] | None = None) -> Column:
    """Struct of the cleaned text and what was found: blanks, one final ``*`` and ``-`` go, other foreign characters are reported and left out.

    Lengths under ``shortest`` are reviewed, or, where it is given, those outside the ``usual`` range (8 to 30 for peptides).

    Fields: text, sha256 (null if empty), length, stop_removed, gaps, ambiguous, invalid, status (invalid, review, pass), reasons.
    """
    squeezed = ascii_upper(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""))
    known = allowed + ambiguous
    remove = lambda value, letters: F.call_function("translate", value, letters, F.lit(""))
    gapless = lambda s: F.replace(F.regexp_replace(s, r"\*$", ""), F.lit("-"), F.lit(""))

    def found(s: Column, g: Column, strange: Column, clean: Column) -> Column:
        n, gaps = F.length(clean), F.length(s) - F.when(s.endswith("*"), 1).otherwise(0) - F.length(g)
        unsure = F.array_compact(F.array(*[F.when(F.contains(g, F.lit(c)), c) for c in sorted(ambiguous)]).cast("array<string>"))
        odd_length = (n < shortest, f"length:below_{shortest}") if usual is None else (~n.between(*usual), f"length:outside_{usual[0]}_{usual[1]}")
        why = reasons((F.size(strange) > 0, "letters:foreign"), (F.size(unsure) > 0, "letters:ambiguous"), (gaps > 0, "letters:gaps"), (n == 0, "length:none"), odd_length, (n > longest, f"length:above_{longest}"))
        status = F.when((F.size(strange) > 0) | (n == 0) | (n > longest), "invalid").when(F.size(why) > 0, "review").otherwise("pass")
        return F.struct(
            clean.alias("text"), F.when(n > 0, F.sha2(clean, 256)).alias("sha256"), n.cast("long").alias("length"), s.endswith("*").alias("stop_removed"),
            gaps.cast("long").alias("gaps"), unsure.alias("ambiguous"), strange.alias("invalid"), status.alias("status"), why.alias("reasons"),
        )

    # each step once a row; known characters are deleted first, so that only the few foreign ones become an array
    distinct = lambda rest: F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != "")))
    return let(squeezed, lambda s: let(gapless(s), lambda g: let(distinct(remove(g, F.lit(known))), lambda strange: let(remove(g, F.array_join(strange, "")), lambda clean: found(s, g, strange, clean)))))


def replace_outside(text: Column, allowed: str, filler: str = "X", longest: int | None = None) -> Column:
    """Struct (text, replaced): characters outside ``allowed`` become ``filler``; cut to ``longest``."""
    out = F.regexp_replace(text, f"[^{allowed}]", filler)
    return F.struct((out if longest is None else F.substring(out, 1, longest)).alias("text"), F.regexp_count(text, F.lit(f"[^{allowed}]")).cast("long").alias("replaced"))


def missing_to_null(text: Column) -> Column:
    return F.when(~F.lower(F.trim(text)).isin(MISSING), F.trim(text))


def to_number(text: Column) -> Column:
    """A plain decimal number, or null."""
    value = missing_to_null(text)
    return F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def first_present(fields: Column, *keys: str) -> Column:
    """The value of the first key that is there, even if that value is null: a null hides later keys."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(fields, key), F.element_at(fields, key)).otherwise(out)
    return out


def stable_id(prefix: str, number: Column, *fields: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws("\x1f", number.cast("string"), *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in fields]), 256), 1, 16))


def pattern_flags(name: Column, rules: Sequence[tuple[str, str]], empty: str = "missing") -> Column:
    """The flags of a name, trimmed: ``empty`` if nothing is left, and of each (pattern, flag) whose pattern is found."""
    value = F.trim(F.coalesce(name, F.lit("")))
    return reasons((value == "", empty), *[(value.rlike(pattern), flag) for pattern, flag in rules])


def first_category(text: Column, rules: Sequence[tuple[str, str]], default: str = "unresolved") -> Column:
    """The category of the first (pattern, category) whose pattern, regardless of case, is found."""
    out = F.lit(default)
    for pattern, category in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), category).otherwise(out)
    return out


def keyword(text: Column, pattern: str, words: Sequence[str], default: str = "unknown") -> Column:
    """The first group of ``pattern`` if it is found, else the first of ``words`` that the text contains."""
    lowered = F.lower(text)
    found = F.regexp_extract(lowered, pattern, 1)
    out = F.lit(default)
    for word in reversed(words):
        out = F.when(lowered.contains(word), word).otherwise(out)
    return F.when(found != "", found).otherwise(out)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def identity_key(*parts: tuple[str, Column]) -> Column:
    """``prefix:value`` of the first filled part, lower case."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{prefix}:"), F.lower(F.trim(c)))) for prefix, c in parts])


def strip_markup(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), BLANKS, " "))


def topic_score(text: Column, include: Sequence[str], exclude: Sequence[str] = (), penalty: int = 3) -> Column:
    """Occurrences of the included words less ``penalty`` times those of the excluded."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    count = lambda word: F.regexp_count(lowered, F.lit(rf"\Q{word.lower()}\E"))
    return sum([count(w) for w in include], F.lit(0)) - penalty * sum([count(w) for w in exclude], F.lit(0))


def outcome(values: Column, yes: str = "positive", no: str = "negative") -> Column:
    """1 or 0 if the values speak of ``yes`` or of ``no`` only; null if of both or neither."""
    has = lambda word: F.exists(values, lambda v: F.coalesce(F.contains(F.lower(v), F.lit(word)), F.lit(False)))
    has_yes, has_no = has(yes), has(no)
    return F.when(has_yes & ~has_no, 1).when(has_no & ~has_yes, 0)


def split_values(text: Column, separators: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(text, separators), F.trim), lambda v: v != "")


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(text, "ACGTacgt", "TGCAtgca"))


def recency_band(year: Column, recent: int, older: int) -> Column:
    return F.when(year >= recent, "recent").when(year >= older, "middle").otherwise("old")


def read_quality(read: Column, quality: Column, adapters: Sequence[str] = (), shortest: int = 20, most_unknown: float = 0.3, least_quality: float = 15.0) -> Column:
    """Struct (length, unknown, mean_quality, reasons) of a sequencing read; quality characters count from ``!``."""
    n = F.length(read)
    unknown = F.coalesce(F.try_divide(F.regexp_count(read, F.lit("[Nn]")), n), F.lit(0.0))
    mean = F.coalesce(F.try_divide(score_sum(quality), F.length(quality)), F.lit(0.0))
    adapter = F.lit(False)
    for a in adapters:
        adapter = adapter | read.contains(a)
    why = reasons((n < shortest, "too_short"), (unknown > most_unknown, "too_many_unknown"), (adapter, "adapter"), (mean < least_quality, "low_quality"))
    return F.struct(n.cast("long").alias("length"), F.bround(unknown, 4).alias("unknown"), F.bround(mean, 2).alias("mean_quality"), why.alias("reasons"))


def score_sum(quality: Column) -> Column:
    """Sum of what the code points of a text lie above ``!``; those below count 0. Taken from the bytes of many texts at once."""

    @F.arrow_udf("long")
    def summed(text: pa.Array) -> pa.Array:
        text = text.cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        out = np.zeros(len(text), np.int64)
        a = 0
        while a < len(text):  # some 4 MB of whole texts at a time
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + 4_000_000, side="right")) - 1)
            upto = np.concatenate([[0], np.cumsum(point_scores(data[ends[a] : ends[b]]))])
            out[a:b] = np.diff(upto[ends[a : b + 1] - ends[a]])
            a = b
        return pa.array(out, mask=text.is_null().to_numpy(zero_copy_only=False))

    return summed(quality)


def point_scores(data: np.ndarray) -> np.ndarray:
    """What each byte of UTF-8 adds to the sum of code points above ``!``."""
    out = np.maximum(data.astype(np.int64) - 33, 0)
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        follows = np.concatenate([(data & 0xC0) == 0x80, [False] * 3])
        after = follows[high + 1].astype(np.int64)
        after += follows[high + 1] & follows[high + 2]
        after += follows[high + 1] & follows[high + 2] & follows[high + 3]
        bits = np.where(follows[high], data[high] & 0x3F, data[high] & (0x3F >> after))
        out[high] = (bits.astype(np.int64) << 6 * after) - np.where(follows[high], 0, 33)
    return out


def pair_composition(text: Column, classes: dict[str, str]) -> Column:
    """Map of two-letter class pairs to their share; characters without a class are left out."""
    chars = "".join(classes)
    reduced = F.translate(F.regexp_replace(text, f"[^{chars}]", ""), chars, "".join(classes.values()))
    kinds = sorted(set(classes.values()))
    # a pair is counted at every place where it stands ahead, in one pass over the text
    counted = lambda r: F.array(*[F.struct(F.lit(a + b).alias("pair"), (F.regexp_count(r, F.lit(f"(?=\\Q{a + b}\\E)")) / (F.length(r) - 1)).alias("share")) for a in kinds for b in kinds])
    return F.when(text.isNotNull(), let(reduced, lambda r: F.when(F.length(r) > 1, F.map_from_entries(F.filter(counted(r), lambda p: p["share"] > 0)))))


def text_windows(frame: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """One row a window: start and stop (characters, stop exclusive) and piece. The last may be short; none starts after the end was reached."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    stride, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    at = frame.where(n > 0).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: k * stride)))
    stop = F.least(F.col("start") + size, F.length(text))
    return at.withColumn("stop", stop).withColumn("piece", F.substring(F.col(text), F.col("start") + 1, F.lit(size)))


def matches_in_columns(frame: DataFrame, name_tokens: Sequence[str], pattern: str) -> Column:
    """Whether any column whose name holds one of the tokens matches the pattern."""
    hits = [F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False)) for c in frame.columns if any(t in c.lower() for t in name_tokens)]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def expand_lists(frame: DataFrame, lists: Sequence[str], separator: str = ";") -> DataFrame:
    """Rows for the parallel lists in ``lists``, paired by position; shorter lists give nulls; rows without values stay."""
    zipped = F.arrays_zip(*[F.split(F.col(c), separator).alias(c) for c in lists])
    keep = [c for c in frame.columns if c not in lists]
    return frame.select(*keep, F.posexplode_outer(zipped).alias("position", "item")).select(*keep, "position", *[F.col("item")[c].alias(c) for c in lists])


def canonical_key(text: Column, alphabet: str) -> Column:
    """Struct (text, sha256): blanks, ``-`` and every character outside ``alphabet`` go; sha256 is null if nothing is left.

    Ambiguous characters go as well, so this is another key than ``normalise``'s.
    """
    kept = F.regexp_replace(ascii_upper(F.coalesce(text, F.lit(""))), f"[^{alphabet}]", "")
    return F.struct(kept.alias("text"), F.when(kept != "", F.sha2(kept, 256)).alias("sha256"))


def strict_sequence(text: Column, alphabet: str = "ACGTN") -> Column:
    """Struct (text, sha256, status, reasons): blanks and ``-`` go; any other foreign character makes the whole invalid, without a key."""
    raw = F.replace(F.regexp_replace(ascii_upper(F.coalesce(text, F.lit(""))), BLANKS, ""), F.lit("-"), F.lit(""))
    foreign = raw.rlike(f"[^{alphabet}]")
    why = reasons((foreign, "invalid_characters"))
    return F.struct(raw.alias("text"), F.when((raw != "") & ~foreign, F.sha2(raw, 256)).alias("sha256"), F.when(foreign | (raw == ""), "invalid").otherwise("pass").alias("status"), why.alias("reasons"))


def bracketed_suffix(text: Column) -> Column:
    """What stands in brackets at the very end, else null."""
    found = F.regexp_extract(text, r"\[([^\]]+)\]\s*$", 1)
    return F.when(found != "", F.trim(found))


def other_class(text: Column, own: Sequence[str], known: str) -> Column:
    """Whether a text, without blanks, ``_`` and ``-`` and in lower case, names a known class (pattern ``known``) and none of ``own``."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s_-]+", "")
    return (plain != "") & ~plain.isin(list(own)) & plain.rlike(known)


def pooled_pairs(text: Column, classes: dict[str, str], order: str, cells: int) -> Column:
    """Array of ``cells`` shares: those of neighbouring pairs of classes (by their places in ``order``), the cells beyond folded back onto the first, divided by their number.

    Characters without a class are left out.
    """
    kept = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{''.join(classes)}]", ""), "".join(classes), "".join(classes.values()))
    size = len(order)
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    names = [a + b for a in order for b in order]
    share = lambda p, name: F.size(F.filter(p, lambda y: y == name)) / F.greatest(F.size(F.filter(p, lambda y: F.length(y) == 2)), F.lit(1))
    spare = size * size - cells

    def cut(p: Column) -> Column:
        shares = [share(p, n) for n in names]
        return F.array(*[shares[i] + shares[cells + i] / spare if i < spare else shares[i] for i in range(cells)])

    return let(kept, lambda x: let(pairs(x), cut))


def folded_title_key(title: Column) -> Column:
    """``title_key`` of the title without accents (compatibility decomposition, in Arrow batches: Spark has no function for it)."""
    @F.arrow_udf("string")
    def fold(values: pa.Array) -> pa.Array:
        return pc.utf8_normalize(values, "NFKD")

    # texts of ASCII alone are their own decomposition and stay out of Python
    return title_key(F.coalesce(fold(F.when(title.rlike("[^\\x00-\\x7F]"), title)), title))
