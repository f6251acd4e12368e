"""Mapping freely typed values to the entries of a reference list.

Forms: every entry is known by its id and its names. A name's words in each of their rotations, plain ("hopping field") and with "of"
between the parts that change places ("hopping of field"), written without blanks, are its forms; those of a name of several
words with one word cut short by a full stop ("const.lifting") are its short forms.

Trees: the forms of one length are a BK-tree under the Levenshtein distance, a true metric. A search follows only the children the
triangle inequality allows, and returns every form within the radius. Many values descend at once: the distances between all of them and
the nodes they have reached are computed bit-parallel in numpy.

Values: a value is folded (compatibility forms, no accents, no invisible characters, lower case) and split into words. It is searched
whole and by every window of neighbouring words, so that words typed around the name don't matter; windows with a word cut short are also
searched, exactly, among the short forms. Of all forms found, the one with the fewest edits, where two letters that changed places are one
edit (Damerau-Levenshtein), then the longest form, then the smallest id, wins. Such an edit is two of the tree's, so the tree is
searched with twice the edits allowed, which loses nothing.

The list is cut into shards of about ``SHARD_NAMES`` names; each shard's trees are built once, in one task, and go to the executors in
broadcasts of at most ``PASS_BYTES``, one after another; the shards' winners merge. Values are mapped where they stand: there is no shuffle, and
any share of equal values does no harm.

Cases: null values and values without any letter, digit or mark give null; a value with no form within the edits allowed for the form's length
(``EDITS``: none under 4 characters, one under 7, else two) gives "unmatched", as does any value if the list is empty.
Very long values are searched whole, window by window. Null entries and names are left out.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.cut import cut

UNMATCHED = "unmatched"
#: Length of a form from which so many edits are allowed, none below the first; a parameter of ``map_values``.
EDITS = ((4, 1), (7, 2))
#: Words by which a window may exceed the longest name.
MORE_WORDS = 2
#: Names of one shard, on average, and bytes of the shards that are sent at once.
SHARD_NAMES, PASS_BYTES = 5_000, 64_000_000
#: Windows that descend the trees together, and remembered answers of one Python process.
TOGETHER, MEMO = 4_000, 500_000


def fold(value: str) -> str:
    """Compatibility form without accents and invisible characters; words written together in camel case come apart."""
    s = "".join(c for c in unicodedata.normalize("NFKC", value) if unicodedata.category(c) != "Cf")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", s).lower()


def words_of(folded: str) -> list[str]:
    """Runs of letters and digits; one cut short by a full stop keeps it."""
    return re.findall(r"[^\W_]+(?:\.(?![^\W_]))?", folded)


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, transpose, with edits between transposed letters."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    top = n + m
    last: dict[str, int] = {}
    rows = [[top] * (m + 2), [top, *range(m + 1)]]
    for i, x in enumerate(a, 1):
        row, prev, at = [top, i], rows[i], 0
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            if x == y:
                cost = prev[j]
            else:
                cost = min(prev[j], row[j], prev[j + 1]) + 1
            if k and at:
                cost = min(cost, rows[k][at] + (i - k - 1) + 1 + (j - at - 1))
            if x == y:
                at = j
            row.append(cost)
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and replacements, bit-parallel over ``a``."""
    m = len(a)
    if not m:
        return len(b)
    ones, last, at = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, d = ones, 0, m
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (ones & ~(xh | up)), up & xh
        d += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & ones, mh << 1 & ones
        up, down = mh | (ones & ~(xv | ph)), ph & xv
    return d


class BKTree:
    """Keys of one length in the metric space of the Levenshtein distance; a search returns every key within a radius."""

    #: Length and number of different characters up to which distances are computed for many queries at once.
    LONGEST, LETTERS = 64, 160

    def __init__(self, keys: Iterable[str]) -> None:
        self.keys: list[str] = []
        nodes: list[dict[int, int]] = []
        for key in dict.fromkeys(keys):
            at = 0
            while nodes:
                d = levenshtein(key, self.keys[at])
                if d not in nodes[at]:
                    nodes[at][d] = len(nodes)
                    break
                at = nodes[at][d]
            nodes.append({})
            self.keys.append(key)
        self.begins = np.cumsum([0, *map(len, nodes)])
        self.edges = np.array([d for n in nodes for d in n], dtype=np.int64)
        self.children = np.array([c for n in nodes for c in n.values()], dtype=np.int64)
        self.length = len(self.keys[0]) if self.keys else 0
        self.codes = {c: i for i, c in enumerate(sorted({c for k in self.keys for c in k}), 1)}
        self.wide = 0 < self.length <= self.LONGEST and len(self.codes) <= self.LETTERS
        if self.wide:
            self.masks = np.zeros((len(self.keys), len(self.codes) + 1), dtype=np.uint64)
            for n, key in enumerate(self.keys):
                for i, c in enumerate(key):
                    self.masks[n, self.codes[c]] |= np.uint64(1 << i)

    def _distances(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Between the queries (rows of codes) and the nodes, pair by pair."""
        one, top = np.uint64(1), np.uint64(self.length - 1)
        up, down = np.full(len(node), ~np.uint64(0)), np.zeros(len(node), dtype=np.uint64)
        d = np.full(len(node), self.length, dtype=np.int64)
        for t in range(codes.shape[1]):
            eq = self.masks[node, codes[:, t]]
            xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            d += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
            ph, mh = ph << one | one, mh << one
            up, down = mh | ~(xv | ph), ph & xv
        return d

    def search(self, queries: list[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """queries: all of one length. Positions of queries, of keys, and their distance, of all within the radius."""
        found: list[tuple[np.ndarray, ...]] = []
        if self.keys and queries:
            codes = np.array([[self.codes.get(c, 0) for c in q] for q in queries], dtype=np.int64).reshape(len(queries), -1) if self.wide else None
            q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
            while len(q):
                d = self._distances(codes[q], node) if self.wide else np.array([levenshtein(self.keys[n], queries[i]) for i, n in zip(q, node)], dtype=np.int64)
                near = d <= radius
                found.append((q[near], node[near], d[near]))
                n = self.begins[node + 1] - self.begins[node]
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.begins[node], n)
                follow = np.abs(self.edges[child] - np.repeat(d, n)) <= radius
                q, node = np.repeat(q, n)[follow], self.children[child[follow]]
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([f[i] for f in found]) if found else none for i in range(3))


def forms_of(name: str) -> tuple[set[str], set[str]]:
    """The forms and the short forms of a name."""
    words = [w.rstrip(".") for w in words_of(fold(name))]
    plain, short = set(), set()
    for k in range(len(words)):
        turned = words[k:] + words[:k]
        plain.add("".join(turned))
        if k:
            plain.add("".join([*words[k:], "of", *words[:k]]))
        if len(words) > 1:
            for i, w in enumerate(turned):
                short |= {"".join([*turned[:i], w[:n] + ".", *turned[i + 1 :]]) for n in range(2, len(w))}
    return plain, short


class Shard:
    """The trees over the forms of some names."""

    def __init__(self, entries: Iterable[tuple[str, str]], edits: tuple[tuple[int, int], ...] = EDITS) -> None:
        """entries: (id, name) pairs; edits: length of a form from which so many edits are allowed, in rising order."""
        self.edits = edits
        plain: dict[str, str] = {}
        short: dict[str, str] = {}
        self.words = 0
        for entry, name in sorted(set(entries)):
            a, b = forms_of(name)
            self.words = max(self.words, len(words_of(fold(name))))
            for forms, ids in ((a, plain), (b, short)):
                for f in forms:
                    ids.setdefault(f, entry)  # in order of id, so the smallest
        self.ids, self.plain, self.short = plain | short, self._trees(plain), self._trees(short)

    @staticmethod
    def _trees(forms: dict[str, str]) -> dict[int, BKTree]:
        by_length: dict[int, list[str]] = {}
        for f in sorted(forms):
            by_length.setdefault(len(f), []).append(f)
        return {n: BKTree(keys) for n, keys in by_length.items()}

    def windows(self, words: list[str]) -> Iterator[str]:
        """Neighbouring words as they are typed, without blanks: every window up to the longest name's words and a few more, and the whole."""
        most = self.words + MORE_WORDS
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + most) + 1):
                yield "".join(words[i:j])
        if len(words) > most:
            yield "".join(words)

    def search(self, windows: list[str]) -> dict[str, list[tuple[int, str]]]:
        """Per window its forms (distance in the tree, form) that may be within the edits allowed."""
        out: dict[str, list[tuple[int, str]]] = {}
        by_length: dict[tuple[bool, int], list[str]] = {}
        for w in windows:
            by_length.setdefault(("." in w, len(w)), []).append(w)
        for (is_short, n), queries in by_length.items():
            if is_short:
                searched = [(self.short[n], 0)] if n in self.short else []
            else:
                searched = [(tree, 2 * r) for m in range(n - self.edits[-1][1], n + self.edits[-1][1] + 1) if (tree := self.plain.get(m)) and abs(n - m) <= (r := self.allowed(m))]
            for tree, radius in searched:
                for s in range(0, len(queries), TOGETHER):
                    part = queries[s : s + TOGETHER]
                    for q, k, d in zip(*(x.tolist() for x in tree.search(part, radius))):
                        out.setdefault(part[q], []).append((d, tree.keys[k]))
        return out

    def allowed(self, length: int) -> int:
        """Edits allowed to a form of this length."""
        return max((r for n, r in self.edits if length >= n), default=0)

    def winners(self, folded: list[str]) -> list[tuple[int, int, str] | None]:
        """Per folded value (edits, less the form's length, id) of the entry meant, or None."""
        windows = []
        for f in folded:
            words = words_of(f)
            mine = dict.fromkeys(self.windows([w.rstrip(".") for w in words]))
            if any(w.endswith(".") for w in words):
                for typed in (words, [*words[:-1], words[-1].rstrip(".")]):  # the last full stop may be the value's own
                    mine |= dict.fromkeys(w for w in self.windows(typed) if "." in w)
            windows.append(list(mine))
        near = self.search(list(dict.fromkeys(w for ws in windows for w in ws)))
        return [self._best([(d, form, w) for w in ws for d, form in near.get(w, ())]) for ws in windows]

    def _best(self, found: list[tuple[int, str, str]]) -> tuple[int, int, str] | None:
        best = None
        for d, form, window in sorted(found):
            if best and (d + 1) // 2 > best[0]:
                break  # an edit is at most two of the tree's
            edits = d if d < 2 else damerau(form, window)
            if edits <= self.allowed(len(form)):
                key = (edits, -len(form), self.ids[form])
                best = min(best, key) if best else key
        return best


_loaded: tuple[str, list[Shard], dict] = ("", [], {})


def _shards_of(token: str, packed: list[bytes]) -> tuple[list[Shard], dict]:
    """The shards of a broadcast, unpacked once per Python process, with the answers known; only the last broadcast's are kept."""
    global _loaded
    if _loaded[0] != token:
        _loaded = (token, [pickle.loads(p) for p in packed], {})
    return _loaded[1:]


def is_blank(value: Column) -> Column:
    """Null, or without any letter, digit or visible mark."""
    return value.isNull() | ~value.rlike(r"[^\s\p{Z}\p{C}\p{M}]")


def _names(reference: DataFrame, entry: str, names: list[Column]) -> DataFrame:
    return reference.select(F.col(entry).cast("string").alias("entry"), F.explode(F.array_distinct(F.concat(*names))).alias("name")).filter(F.col("entry").isNotNull() & F.col("name").isNotNull()).distinct()


def _winners(packed: list[bytes], spark):
    """A column function: the winner among the shards, as edits, less the form's length, and id."""
    sent, token = spark.sparkContext.broadcast(packed), uuid.uuid4().hex
    kind = pa.struct([("edits", pa.int32()), ("less", pa.int32()), ("id", pa.string())])

    @F.arrow_udf("struct<edits:int,less:int,id:string>")
    def winner(values: pa.Array) -> pa.Array:
        shards, known = _shards_of(token, sent.value)
        typed = values.to_pylist()
        new = [v for v in dict.fromkeys(typed) if v is not None and v not in known]
        if len(known) + len(new) > MEMO:
            known.clear()
            new = [v for v in dict.fromkeys(typed) if v is not None]
        folded = [fold(v) for v in new]
        found = [[b for b in best if b] for best in zip(*(s.winners(folded) for s in shards))] if shards else [[] for _ in new]
        known.update((v, min(best, default=None)) for v, best in zip(new, found))
        known[None] = None
        return pa.array([None if known[v] is None else dict(zip(("edits", "less", "id"), known[v])) for v in typed], kind)

    return winner


def map_values(df: DataFrame, value: str, reference: DataFrame, entry: str, names: list[Column], edits: tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """``df`` with the column op_id: the entry meant, "unmatched", or null for a null or blank value.

    names: array columns of the reference list; edits: (length, edits) pairs, the length of a form from which so many edits are allowed.
    """
    listed = cut(_names(reference, entry, names))
    shard = F.pmod(F.xxhash64("name"), F.lit(-(-listed.count() // SHARD_NAMES) or 1))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"packed": [pickle.dumps(Shard(zip(part.entry, part.name), edits), protocol=5)]})

    built = cut(listed.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "packed binary"))
    best, held = F.lit(None).cast("struct<edits:int,less:int,id:string>"), []
    typed = F.when(~is_blank(F.col(value)), F.col(value))
    for r in built.toLocalIterator():
        if held and sum(map(len, held)) + len(r.packed) > PASS_BYTES:
            best, held = F.least(best, _winners(held, df.sparkSession)(typed)), []
        held.append(bytes(r.packed))
    if held:
        best = F.least(best, _winners(held, df.sparkSession)(typed))
    return df.withColumn("op_id", F.when(~is_blank(F.col(value)), F.coalesce(best["id"], F.lit(UNMATCHED))))
