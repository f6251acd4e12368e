"""Evaluation records that also stand, exactly or almost, among training records.

Two records overlap if they name the same paper, or if the words of their passages have a Jaccard similarity of at least ``least``
(both of ``least_words`` distinct words or more).

Passages are normalised to their words (runs of a-z and 0-9 in lower case) between single blanks, in their order. Equal evaluation passages
are a class. The classes are cut into shards of about ``SHARD_WORDS`` words, and for each shard one task builds one automaton:

- Every passage is cut into consecutive pieces. A similar text lacks at most floor((1 - least) * n) of its n distinct words; so many words
  and ``NEED`` more, the rarest of the passage in the shard, are pieces of their own, and each run of words between them is one piece.
- The Aho-Corasick automaton of the shard holds all pieces; it is built once and sent to the executors, in broadcasts of at
  most ``PASS_BYTES``, one after another.

Training texts are scanned where they are read, without a shuffle: the automaton reports every interval of the text that is a piece. A
passage is a candidate if ``NEED`` of its one-word pieces stand in the text, as in every similar text, in whatever order its words come
(the runs, often phrases that many passages share, don't count here). The intervals of its pieces are merged into its coverage, the share of the passage's words that stand in the text
in pieces; then the word sets are compared. No candidate is dropped otherwise, so no case is missed.

Cases: null, empty and short passages overlap with none; blank ids and ids without a paper number name no paper; rows repeated under one
key count once, and where they differ a pair counts if any of them overlap. Empty tables give an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.plans.cut import cut

#: Words of the evaluation passages of one automaton, on average, and bytes of the automata that are sent at once.
SHARD_WORDS, PASS_BYTES = 400_000, 64_000_000
#: One-word pieces of a passage that a similar text must hold.
NEED = 3


def paper_number(raw: Column) -> Column:
    """The number of a paper however it is written: four digits and eight, as YYMM.NNNNNNNN; null if there is none.

    Versions, addresses, folders, file endings, brackets, prefixes, case, blanks and the mark between the two parts don't matter.
    """
    plain = F.translate(raw, "０１２３４５６７８９．－＿／", "0123456789.-_/")
    found = F.regexp_extract(plain, r"(?<![0-9])([0-9]{4})[.\-_/ ]?([0-9]{8})(?![0-9])", 0)
    digits = F.regexp_replace(found, "[^0-9]", "")
    return F.when(F.length(digits) == 12, F.concat(F.substring(digits, 1, 4), F.lit("."), F.substring(digits, 5, 8)))


def same_paper(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """evaluation: eval_id, paper; training: train_id, paper (as written). Columns eval_id, train_id."""
    left = evaluation.select("eval_id", paper_number(F.col("paper")).alias("number")).filter(F.col("number").isNotNull())
    right = training.select("train_id", paper_number(F.col("paper")).alias("number")).filter(F.col("number").isNotNull())
    return left.join(right, "number").select("eval_id", "train_id")


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shard:
    """The automaton over the pieces of some passages."""

    def __init__(self, reps: list[int], passages: list[str], least: float) -> None:
        """passages: normalised."""
        import ahocorasick

        self.least, self.reps, self.passages = least, np.array(reps, dtype=np.int64), passages
        split = [p.split() for p in passages]
        often = Counter(w for words in split for w in set(words))
        numbers: dict[str, int] = {}
        holders: list[list[int]] = []
        self.pieces: list[list[tuple[int, int, int]]] = []  # per passage: first word, word after the last, piece
        self.needs, self.sizes = np.empty(len(split), dtype=np.int64), np.empty(len(split), dtype=np.int64)
        for i, words in enumerate(split):
            distinct = set(words)
            lost = int((1 - least) * len(distinct) + 1e-9)
            self.sizes[i], self.needs[i] = len(distinct), min(NEED, len(distinct) - lost)
            alone = set(sorted(distinct, key=lambda w: (often[w], w))[: lost + self.needs[i]])
            mine, at = [], 0
            while at < len(words):
                to = at + 1
                while words[at] not in alone and to < len(words) and words[to] not in alone:
                    to += 1
                piece = f" {' '.join(words[at:to])} "
                number = numbers.setdefault(piece, len(holders))
                if number == len(holders):
                    holders.append([])
                if words[at] in alone and (not holders[number] or holders[number][-1] != i):
                    holders[number].append(i)
                mine.append((at, to, number))
                at = to
            self.pieces.append(mine)
        self.begins = np.cumsum([0, *map(len, holders)]).tolist()
        self.holders = np.array([i for h in holders for i in h], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, number in numbers.items():
            self.automaton.add_word(piece, number)
        if numbers:
            self.automaton.make_automaton()

    def scan(self, text: str) -> Iterator[tuple[int, float, float]]:
        """Passages similar to the normalised text, each with its coverage and the similarity."""
        if not len(self.holders):
            return
        found = {number for _, number in self.automaton.iter(f" {text} ")}
        held = [self.holders[self.begins[f] : self.begins[f + 1]] for f in found if self.begins[f] < self.begins[f + 1]]
        if not held:
            return
        passages, count = np.unique(np.concatenate(held), return_counts=True)
        passages = passages[count >= self.needs[passages]]
        if not len(passages):
            return
        mine = set(text.split())
        n, sizes = len(mine), self.sizes[passages]
        for i in passages[np.minimum(sizes, n) >= self.least * np.maximum(sizes, n) - 1e-9].tolist():
            theirs = self.passages[i].split()
            distinct = set(theirs)
            common = len(mine & distinct)
            similarity = common / (n + len(distinct) - common)
            if similarity >= self.least:
                spans = merged([(a, b) for a, b, piece in self.pieces[i] if piece in found])
                yield i, sum(b - a for a, b in spans) / len(theirs), similarity


_loaded: tuple[str, list[Shard]] = ("", [])


def _shards_of(token: str, packed: list[bytes]) -> list[Shard]:
    """The shards of a broadcast, unpacked once per Python process; only the last broadcast's are kept."""
    global _loaded
    if _loaded[0] != token:
        _loaded = (token, [pickle.loads(p) for p in packed])
    return _loaded[1]


def _scanned(texts: DataFrame, packed: list[bytes]) -> DataFrame:
    """texts: train_id, passage. Columns a (class of an evaluation passage), train_id, coverage, similarity."""
    sent, token = texts.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = _shards_of(token, sent.value)
            found = [(int(s.reps[i]), key, c, j) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in shards for i, c, j in s.scan(text)]
            columns = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["a", "train_id", "coverage", "similarity"])

    links = cut(texts.mapInArrow(scan, "a bigint, train_id bigint, coverage double, similarity double"))
    sent.destroy()
    return links


def similar_passages(evaluation: DataFrame, training: DataFrame, least: float, least_words: int) -> DataFrame:
    """evaluation: eval_id, passage; training: train_id, passage. Columns eval_id, train_id, coverage, similarity."""

    def normalised(rows: DataFrame, key: str) -> DataFrame:
        worded = rows.select(F.col(key).cast("bigint").alias(key), tokens(F.col("passage")).alias("words"))
        return worded.filter(F.col(key).isNotNull() & (F.size(F.array_distinct("words")) >= least_words)).select(key, F.array_join("words", " ").alias("passage"))

    named = normalised(evaluation, "eval_id").distinct()
    classes = cut(named.groupBy("passage").agg(F.min("eval_id").alias("rep")))
    words = classes.agg(F.sum(F.size(F.split("passage", " ")))).first()[0] or 0
    shard = F.pmod(F.xxhash64("rep"), F.lit(-(-words // SHARD_WORDS) or 1))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"packed": [pickle.dumps(Shard(part.rep.tolist(), part.passage.tolist(), least), protocol=5)]})

    automata = cut(classes.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "packed binary"))
    texts, links, held = normalised(training, "train_id"), None, []

    def flush() -> None:
        nonlocal links, held
        more = _scanned(texts, held)
        links, held = more if links is None else links.unionByName(more), []

    for r in automata.toLocalIterator():
        if held and sum(map(len, held)) + len(r.packed) > PASS_BYTES:
            flush()
        held.append(bytes(r.packed))
    if held or links is None:
        flush()
    members = named.join(classes, "passage").select("eval_id", F.col("rep").alias("a"))
    return links.join(members, "a").select("eval_id", "train_id", "coverage", "similarity")


def overlaps(evaluation: DataFrame, training: DataFrame, least: float = 0.75, least_words: int = 8) -> DataFrame:
    """evaluation: eval_id, paper, passage; training: train_id, paper, passage.

    Columns eval_id, train_id, same_paper (boolean), coverage (the share of the evaluation passage that stands in the training text in
    pieces) and similarity; both null if the passages are not similar.
    """
    none = F.lit(None).cast("double")
    papers = same_paper(evaluation, training).select("eval_id", "train_id", F.lit(True).alias("same_paper"), none.alias("coverage"), none.alias("similarity"))
    passages = similar_passages(evaluation, training, least, least_words).withColumn("same_paper", F.lit(False))
    both = papers.unionByName(passages)
    return both.groupBy("eval_id", "train_id").agg(F.bool_or("same_paper").alias("same_paper"), F.max("coverage").alias("coverage"), F.max("similarity").alias("similarity"))
