"""Scoring texts for abusive, hateful or sexually explicit language with a convolutional classifier trained in numpy.

Words: a text is split at blanks, and each piece is undisguised (compatibility forms, invisible characters, accents, letters of other
alphabets and digits put for Latin ones, marks between letters, stretched letters) and cut into words; Chinese and Japanese
characters are words of their own. Sentence marks, brackets and line breaks end a sentence. A word's hash picks its embedding
among 2**22 buckets, of which those that training texts used at least twice have a row; all other words share none.

Model: filters of widths 1 to 4 over the embeddings, the greatest response of each filter within a sentence, one linear layer,
giving a score per sentence; a text's score is that of its worst sentence, so neither the length of a text nor the place of the
sentence matters. In training the sentences of a text are joined by a soft maximum, since labels are per text.

Fitting: on at most about ``MAX_LABELLED`` labelled texts of about ``MAX_BYTES`` bytes together (chosen by a hash of their ids, one of each text),
whole texts. A fifth is held out to
choose the threshold of each language: the one with the best F1, where a language has ``LEAST_POSITIVE`` held-out positives, else
that over all languages; always between 0.35 and 0.6, since labels err. Everything is seeded; the same rows give the same model.

Cases: null, empty and blank texts, and texts without words, have score 0 and are not abusive; labels that are null, or contradict
each other evenly, are not used; without labels of both kinds every score is 0. Repeated rows are scored alike. Texts of any
length are scored whole. Columns other than those named are ignored.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.cut import cut

MAX_LABELLED, MAX_BYTES, LEAST_POSITIVE = 16_000, 64_000_000, 12
#: Bounds of the thresholds, since labels err.
LOWEST, HIGHEST = 0.35, 0.6
DIMS, FILTERS, WIDTHS = 16, 12, (1, 2, 3, 4)
BUCKETS = 1 << 22
MEMO = 400_000

#: Letters and marks that stand in for Latin letters.
_LOOK_ALIKE = str.maketrans("аеорсухіјѕкмнтвԁԛԝɡαοενρτυικ", "aeopcyxijskmhtbdqwgaoevptuik")
_DIGITS = str.maketrans("013457@$!|", "oieastasil")

#: What stands for a line break between pieces.
_BREAK = "\x00"
#: Two single characters with marks or blanks around them, which every word written letter by letter has.
_MAYBE_SPACED = re.compile(r"[ .*_\-]\w[ .*_\-]\w[ .*_\-]").search
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_\-]){3,}[^\W\d_](?![^\W_])")
_SEPARATED = re.compile(r"(?<![^\W_])(?:[^\W_][_.*\-]){2,}[^\W_](?![^\W_])")
_PARTS = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W\d_぀-ヿ㐀-鿿가-힯]+(?:['’*][^\W\d_]+)*|\d+|[.!?。！？;()\[\]{}<>:…\"“”]+")
_LEET = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|(?<![\w@$])[@$](?=[a-z]{2})|(?<=[a-z]{2})[013457](?=[a-z])|(?<![a-z0-9])[013457](?=[a-z]{2,}(?![0-9]))")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_ENDS = frozenset(".!?。！？;()[]{}<>:…\"“”")


def words_of(piece: str) -> list[str]:
    """The words of a piece between blanks, undisguised; "" where a sentence ends."""
    if piece == _BREAK:
        return [""]
    s = unicodedata.normalize("NFKC", piece)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Cf", "Mn", "Cc"))
        s = unicodedata.normalize("NFC", s)
    s = s.lower()
    if not s.isascii() and re.search("[a-z]", s):
        s = s.translate(_LOOK_ALIKE)
    s = _SEPARATED.sub(lambda m: re.sub(r"[_.*\-]", "", m.group()), s)
    s = _LEET.sub(lambda m: m.group().translate(_DIGITS), s)
    s = _STRETCHED.sub(r"\1", s)
    return ["" if p[0] in _ENDS else "0" if p[0].isdigit() else p for p in _PARTS.findall(s)]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class Lexer:
    """Texts to arrays of row numbers: 0 ends a sentence, 1 is a word without a row."""

    def __init__(self, buckets: list[int]) -> None:
        self.rows = {b: i + 2 for i, b in enumerate(buckets)}
        self.memo: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = np.array([0 if not w else self.rows.get(bucket(w), 1) for w in words_of(piece)], dtype="<i4").tobytes()
        if len(piece) <= 32:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        """Begins with the end of a sentence and has no two in a row."""
        get = self.memo.get
        pieces = pieces_of(text or "")
        found = [get(p) for p in pieces]
        raw = b"".join([self.piece(p) if f is None else f for f, p in zip(found, pieces)])
        ids = np.concatenate([np.zeros(1, dtype="<i4"), np.frombuffer(raw, dtype="<i4")])
        keep = np.ones(len(ids), dtype=bool)
        keep[:-1] = (ids[:-1] != 0) | (ids[1:] != 0)
        return ids[keep]


def unspaced(text: str) -> str:
    """Words written letter by letter ("i d i o t") joined."""
    return _SPACED.sub(lambda m: re.sub(r"[ .*_\-]", "", m.group()), text) if _MAYBE_SPACED(text) else text


def pieces_of(text: str) -> list[str]:
    """What stands between blanks, and a mark for each line break."""
    return unspaced(text).replace("\n", f" {_BREAK} ").split()


class Model:
    """Embeddings, filters and the linear layer; the thresholds by language."""

    def __init__(self, buckets: list[int], clue: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.e = rng.normal(0, 0.1, (len(buckets) + 2, DIMS)).astype(np.float32)
        self.e[:2] = 0
        self.e[2:, 0] = clue  # what the labels of the texts that hold a word say of it
        self.w = {k: rng.normal(0, 0.35 / np.sqrt(k), (k * DIMS, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, dtype=np.float32) for k in WIDTHS}
        self.v = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.array([-2.0], dtype=np.float32)
        self.thresholds: dict[str, float] = {}

    def step(self, docs: list[np.ndarray], labels: np.ndarray, rate: float, state: dict) -> float:
        """One step of gradient descent on a batch; returns its loss."""
        ids = np.concatenate(docs)
        starts = np.nonzero(ids == 0)[0]
        sentence = np.cumsum(ids == 0) - 1
        doc_starts = np.cumsum([0, *(len(d) for d in docs[:-1])])
        first = sentence[doc_starts]
        doc_of = np.repeat(np.arange(len(docs)), np.diff([*first, len(starts)]))
        n, size = len(ids), len(self.e)
        padded = np.concatenate([ids, np.zeros(max(WIDTHS) - 1, dtype=ids.dtype)])
        self.freeze()
        outs, kept = [], []
        back = np.arange(n, 0, -1, dtype=np.int32)[:, None]
        for k in WIDTHS:
            h = self.tables[k][0][ids]
            for j in range(1, k):
                h += self.tables[k][j][padded[j : j + n]]
            h += self.b[k]
            top = np.maximum.reduceat(h, starts, axis=0)
            place = n - np.maximum.reduceat(np.where(h == top[sentence], back, np.int32(0)), starts, axis=0)
            outs.append(np.maximum(top, 0))
            kept.append((place, top > 0))
        feats = np.concatenate(outs, axis=1)
        s = feats @ self.v + self.c[0]
        top = np.maximum.reduceat(s, first)
        share = np.exp(s - top[doc_of])
        total = np.add.reduceat(share, first)
        share /= total[doc_of]
        doc = np.add.reduceat(share * s, first)
        p = 1 / (1 + np.exp(-np.clip(doc, -30, 30)))
        target = np.where(labels == 1, 0.95, 0.03)
        loss = -np.mean(target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9))
        ds = ((p - target) / len(docs))[doc_of] * share
        grads = {"v": feats.T @ ds + 1e-5 * self.v, "c": np.array([ds.sum()], dtype=np.float32)}
        dfeats = ds[:, None] * self.v[None, :]
        de = np.zeros_like(self.e)
        for i, k in enumerate(WIDTHS):
            # only the greatest responses have a gradient; it is summed per row of the embeddings at each place of the filters
            place, live = kept[i]
            part = dfeats[:, i * FILTERS : (i + 1) * FILTERS] * live
            rows_at, f = np.nonzero(np.abs(part) > 1e-9)
            at, value = place[rows_at, f], part[rows_at, f]
            grads[f"b{k}"] = np.bincount(f, value, FILTERS).astype(np.float32)
            dw = 1e-5 * self.w[k]
            for j in range(k):
                cells = np.bincount(padded[at + j].astype(np.int64) * FILTERS + f, value, size * FILTERS).reshape(size, FILTERS).astype(np.float32)
                dw[j * DIMS : (j + 1) * DIMS] += self.e.T @ cells
                de += cells @ self.w[k][j * DIMS : (j + 1) * DIMS].T
            grads[f"w{k}"] = dw
        rows = np.unique(ids)
        rows = rows[rows > 1]
        de = de[rows]
        sq = state.setdefault("e", np.full(len(self.e), 1e-8, dtype=np.float32))
        sq[rows] += (de * de).mean(1)
        self.e[rows] -= 20 * rate * de / np.sqrt(sq[rows])[:, None] * 0.5
        state["t"] = t = state.get("t", 0) + 1
        params = {"v": self.v, "c": self.c} | {f"w{k}": self.w[k] for k in WIDTHS} | {f"b{k}": self.b[k] for k in WIDTHS}
        for name, g in grads.items():
            m, q = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            params[name] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
        return float(loss)

    def freeze(self) -> None:
        """Each filter's response to each row at each of its places, so that scoring only adds rows up."""
        self.tables = {k: [self.e @ self.w[k][j * DIMS : (j + 1) * DIMS] for j in range(k)] for k in WIDTHS}

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """The score of each text, from 0 to 1."""
        if not docs:
            return np.zeros(0)
        out = np.zeros(len(docs))
        begin = 0
        while begin < len(docs):  # some ten thousand words at a time
            end, words = begin, 0
            while end < len(docs) and (end == begin or words + len(docs[end]) <= 50_000):
                words += len(docs[end])
                end += 1
            ids = np.concatenate(docs[begin:end])
            starts = np.nonzero(ids == 0)[0]
            feats = []
            for k in WIDTHS:
                h = self.tables[k][0][ids]
                for j in range(1, k):
                    h[:-j] += self.tables[k][j][ids[j:]]
                feats.append(np.maximum(np.maximum.reduceat(h, starts, axis=0) + self.b[k], 0))
            s = np.concatenate(feats, axis=1) @ self.v + self.c[0]
            first = (np.cumsum(ids == 0) - 1)[np.cumsum([0, *(len(d) for d in docs[begin : end - 1])])]
            out[begin:end] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(s, first), -30, 30)))
            begin = end
        return out


def language(lang: str | None) -> str:
    """The first two letters in lower case; "xx" where there are none."""
    return (lang or "").strip().lower()[:2] or "xx"


def fit(texts: list[str], labels: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 5) -> Model | None:
    """Trains on four fifths of distinct texts and sets the thresholds on the rest; None without labels of both kinds."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2
    if labels[~held].min() == labels[~held].max() or labels[held].sum() == 0:
        held[:] = False
    counts: dict[int, list[int]] = {}
    known: dict[str, list[int]] = {}
    for text, label, out in zip(texts, labels, held):
        if not out:
            pieces = set(pieces_of(text))
            for p in pieces:
                if p not in known:
                    known[p] = [bucket(w) for w in words_of(p) if w]
            for b in {b for p in pieces for b in known[p]}:
                counts.setdefault(b, [0, 0])[int(label)] += 1
    del known
    buckets = sorted(b for b, (n, p) in counts.items() if n + p >= 2)
    base = labels[~held].mean()
    seen = np.array([counts[b] for b in buckets], dtype=np.float64).reshape(-1, 2)
    clue = np.log((seen[:, 1] + base) / (seen.sum(1) + 1) / base) * 0.5
    model, lexer = Model(buckets, clue.astype(np.float32), seed), Lexer(buckets)
    docs = [lexer(t) for t in texts]
    train, state = np.nonzero(~held)[0], {}
    steps = max(1, -(-len(train) // 64))
    epochs = max(epochs, -(-300 // steps))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for s in range(steps):
            batch = order[s::steps]
            if len(batch):
                model.step([docs[i] for i in batch], labels[batch], 0.01 * (1 - epoch / (epochs + 1)), state)
    model.freeze()
    _calibrate(model, [docs[i] for i in np.nonzero(held)[0]], labels[held], [langs[i] for i in np.nonzero(held)[0]])
    return model


def _best(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the thresholds whose F1 is within half a percent of the best."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    good = scores[order][f1 >= f1.max() - 0.005]
    return float((good.max() + good.min()) / 2)


def _calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray, langs: list[str]) -> None:
    scores, by = model.scores(docs), np.array(langs)
    whole = _best(scores, labels) if labels.sum() >= LEAST_POSITIVE else 0.5
    model.thresholds[""] = float(np.clip(whole, LOWEST, HIGHEST))
    for lang in set(langs):
        own = by == lang
        if labels[own].sum() >= LEAST_POSITIVE:
            model.thresholds[lang] = float(np.clip(_best(scores[own], labels[own]), LOWEST, HIGHEST))


def fitted(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> Model | None:
    """The model of a bounded sample of the labelled documents, fitted in one task. The sample's ids, never documents, are broadcast."""
    votes = labels.filter(F.col("label").isNotNull()).groupBy("id").agg(F.avg("label").alias("mean")).filter(F.col("mean") != 0.5)
    parts = max(1, -(-votes.count() // limit))
    chosen = votes.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("id", (F.col("mean") > 0.5).cast("int").alias("label"))
    rows = cut(documents.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "id").select("id", "text", "lang", "label"))
    thinned = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    if thinned > 1:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(thinned)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, tuple] = {}
        for b in batches:
            for key, text, lang, label in zip(*(b.column(n).to_pylist() for n in ("id", "text", "lang", "label"))):
                if text not in first or key < first[text][0]:
                    first[text] = (key, lang, label)
        texts = sorted(first, key=lambda t: first[t][0])
        model = fit(texts, np.array([first[t][2] for t in texts], dtype=np.int64), [language(first[t][1]) for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def score(df: DataFrame, labels: DataFrame, key: str, text: str, lang: str, keep: list[str] | None = None) -> DataFrame:
    """labels: id, label (1, 0 or null). Columns: the key, those of ``keep``, score (double) and abusive (boolean)."""
    spark, keep = df.sparkSession, keep or []
    model = fitted(df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), labels)
    shared = spark.sparkContext.broadcast(model)  # some ten thousand rows at most, whatever the size of the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model and not hasattr(model, "lexer"):
            model.lexer = Lexer(model.buckets)  # kept with the model of this process
        for b in batches:
            kept = [b.column(i) for i in range(2, b.num_columns)]
            if model:
                scores = model.scores([model.lexer(t) for t in b.column(0).to_pylist()])
                whole = model.thresholds[""]
                over = scores >= np.array([model.thresholds.get(language(x), whole) for x in b.column(1).to_pylist()])
            else:
                scores, over = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(over)], [*[f"k{i}" for i in range(len(kept))], "score", "abusive"])

    columns = [key, *keep]
    narrow = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)))
    kinds = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = narrow.mapInArrow(run, f"{kinds}, score double, abusive boolean")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)), "score", "abusive")
