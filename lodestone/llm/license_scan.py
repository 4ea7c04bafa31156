"""Licence scan by a positional rare-token index.

A first pass counts, over all documents, in how many each licence word stands;
that gives every licence word its inverse document frequency. The index holds
the postings of all words of all templates: word -> (template, place). A file
is looked up by the highest-IDF word of each template's mandatory phrases, and
each hit fixes a relative position, file place less template place. From there
the other mandatory phrases are verified word for word, in the template's order
and at any distance, the nearest place first, as copies add names, comments and
clauses or drop them. The postings of all the template's words are then
intersected at the relative positions of its phrases, and the share of the
template's IDF weight that they hold there is its score.

Templates are whole wordings of short licences, the notices of long ones, and
lines that files carry instead (``license_texts``). Verified mandatory phrases
decide a label; the score does not, so labels do not depend on the corpus. The
four base phrases are templates that are one mandatory phrase each, and have
score 1 where they stand. A file's score is that of its best template.

Defined cases: null text counts as empty and has no words; repeated rows give
repeated results; ties in IDF go to the smaller word; other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .license_texts import LINES, WORDINGS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

TEMPLATES = [*WORDINGS, *LINES]


def words_of(text: str | None) -> list[str]:
    """Words of the text after A-Z went to lower case; other letters stay as they are."""
    if not text:
        return []
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def licence_words() -> list[str]:
    return sorted({w for text, _ in BASE for w in text.split()} | {w for _, text, _ in TEMPLATES for w in text.split()})


class Template:
    """A wording, the places of its words, and its mandatory phrases as (start, words, rarest word, place of that in the phrase)."""

    def __init__(self, label: str, wording: str, phrases: list[str], idf: dict[str, float]):
        self.label, self.words = label, wording.split()
        self.weight = sum(idf[w] for w in self.words)
        self.phrases = []
        for phrase in map(str.split, phrases):
            start = next(i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase)
            rare = min(phrase, key=lambda w: (-idf[w], w))
            self.phrases.append((start, phrase, rare, phrase.index(rare)))
        # the file is looked up by the rarest phrase's rarest word
        self.phrases.sort(key=lambda x: (-idf[x[2]], x[2], x[0]))


class Index:
    """Postings of the templates' words, and the templates by the word that they are looked up by."""

    def __init__(self, df: dict[str, int], n_docs: int):
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1 for w in licence_words()}
        self.base = [Template(label, text, [text], self.idf) for text, label in BASE]
        self.full = [Template(*t, self.idf) for t in TEMPLATES]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, template in enumerate(self.full):
            for place, word in enumerate(template.words):
                self.postings[word].append((number, place))
        self.entries: dict[str, list[tuple[bool, int]]] = defaultdict(list)
        for is_base, templates in ((True, self.base), (False, self.full)):
            for number, template in enumerate(templates):
                self.entries[template.phrases[0][2]].append((is_base, number))
        self.lookup = sorted(self.entries, key=lambda w: (-self.idf[w], w))

    def scan(self, words: list[str]) -> tuple[set[int], set[str], dict[str, float]]:
        """(base places, base labels, templates with their best share of IDF weight)."""
        starts: set[tuple[str, int]] = set()
        found: dict[str, float] = {}
        present = set(words)
        places: dict[tuple[str, ...], list[int]] = {}

        def standing(phrase: list[str], rare: str, offset: int) -> list[int]:
            """Where the phrase stands, ascending; its rarest word is looked up first."""
            key = tuple(phrase)
            if key not in places:
                at, out = -1, []
                for _ in range(words.count(rare) if rare in present else 0):
                    at = words.index(rare, at + 1)
                    if at >= offset and words[at - offset : at - offset + len(phrase)] == phrase:
                        out.append(at - offset)
                places[key] = out
            return places[key]

        for rare in self.lookup:
            if rare not in present:
                continue
            for is_base, number in self.entries[rare]:
                template = (self.base if is_base else self.full)[number]
                for p in standing(*template.phrases[0][1:]):
                    if is_base:
                        starts.add((template.label, p))
                    elif shifts := self._shifts(standing, template, p):
                        found[template.label] = max(found.get(template.label, 0.0), self._share(words, number, shifts))
        return starts, {label for label, _ in starts}, found

    @staticmethod
    def _shifts(standing: Callable[[list[str], str, int], list[int]], template: Template, place: int) -> set[int] | None:
        """The relative positions of all mandatory phrases around the first one's place; None if one does not stand in its order."""
        ordered = sorted(template.phrases)
        known = ordered.index(template.phrases[0])
        shifts = {place - template.phrases[0][0]}
        for step, rest in ((1, ordered[known + 1 :]), (-1, ordered[:known][::-1])):
            last, here = template.phrases[0], place
            for phrase in rest:
                first, second = (last, phrase) if step > 0 else (phrase, last)
                # phrases stand apart, unless they overlap in the template
                apart = min(len(first[1]), second[0] - first[0])
                at = standing(*phrase[1:])
                k = bisect_left(at, here + apart) if step > 0 else bisect_right(at, here - apart) - 1
                if not 0 <= k < len(at):
                    return None
                last, here = phrase, at[k]
                shifts.add(here - phrase[0])
        return shifts

    def _share(self, words: list[str], number: int, shifts: set[int]) -> float:
        """The share of the template's IDF weight whose postings meet the file's words at one of the relative positions."""
        template = self.full[number]
        held = {place for shift in shifts for at in range(max(0, shift), min(len(words), shift + len(template.words))) for t, place in self.postings.get(words[at], ()) if t == number and at - place == shift}
        return sum(self.idf[template.words[place]] for place in held) / template.weight


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = set(licence_words())
    counts: Counter[str] = Counter()
    n = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(vocabulary.intersection(words_of(text)))
            n += 1
    rows = [("", n), *counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([c for _, c in rows], pa.int64())], names=["word", "n"])


def build_index(docs: DataFrame) -> Index:
    """Counts over all documents; what reaches the driver is one number per licence word."""
    counts = docs.select("text").mapInArrow(_present, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"]: r["n"] for r in counts.collect()}
    return Index(df, df.pop("", 0))


def scan_licences(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, templates, score for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                starts, base, found = shared.value.scan(words)
                at = [p for _, p in starts]
                row = (len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), ",".join(sorted(found)), max(found.values(), default=0.0) if not base else 1.0)
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "templates", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, templates string, score double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan_licences(docs, build_index(docs)).drop("templates")
