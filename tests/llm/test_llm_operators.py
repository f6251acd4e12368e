"""Every operator of the subpackage against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import abuse, canonical, curves, encode, neardup, overlap, pack, similar, topn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# canonical values

ENTRIES = [("domain_porting", "Domain porting"), ("domain_porting", "field hopping"), ("negative_result", "Negative result"), ("scale_growth", "Scale growth"), ("scale_growth", "bigger is better")]


def plain_damerau(a, b):
    """The distance by its definition over all prefixes."""
    d = {}
    da = {}
    top = len(a) + len(b)
    d[-1, -1] = top
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = top, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = top, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, line = da.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, line - 1] + (i - k - 1) + 1 + (j - line - 1))
        da[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_is_a_metric_and_right():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(40)]
    for a, b in itertools.product(words, words):
        assert canonical.damerau(a, b) == plain_damerau(a, b), (a, b)
    for a, b, c in itertools.product(words[:15], repeat=3):
        assert canonical.damerau(a, c) <= canonical.damerau(a, b) + canonical.damerau(b, c)


@pytest.mark.parametrize("longest", [64, 5])
def test_bk_tree_finds_all(monkeypatch, longest):
    """Every key within the radius, whether distances are computed for many queries at once or one by one."""
    monkeypatch.setattr(canonical.BKTree, "LONGEST", longest)
    rng = random.Random(2)
    keys = list({"".join(rng.choice("abcd") for _ in range(6)) for _ in range(300)})
    tree = canonical.BKTree(keys + keys[:5])

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    for queries in (keys[:20], ["zzzz", "abca"], ["abcdabca"], [""]):
        for radius in (0, 2, 4):
            got = sorted((q, tree.keys[k], d) for q, k, d in zip(*tree.search(queries, radius)))
            assert got == sorted((i, k, plain(q, k)) for i, q in enumerate(queries) for k in keys if plain(q, k) <= radius)
    assert len(canonical.BKTree([]).search(["a"], 2)[0]) == 0 and canonical.levenshtein("kitten", "sitting") == 3 and canonical.levenshtein("", "ab") == 2


CASES = {
    "domain_porting": "domain_porting", "DOMAIN  PORTING": "domain_porting", "hopping, field": "domain_porting", "porting of Domain": "domain_porting", "Dom. porting": "domain_porting", "dómain porting idea": "domain_porting", "Dom. porting.": "domain_porting", "́​": None, "so to say field hpoping, more or less": "domain_porting", "domain " * 400 + "portign": "domain_porting", "z: Domian portng": "domain_porting",
    "ｆｉｅｌｄ ｈｏｐｐｉｎｇ": "domain_porting", '"NegativeResult"': "negative_result", "bigger is bett.!": "scale_growth", "sc​ale growth - rev": "scale_growth", "horizon cruise": "unmatched", "other": "unmatched", "???": "unmatched", "x" * 5000: "unmatched", "": None, "  \t": None, None: None,
}


@pytest.mark.parametrize("names,size", [(canonical.SHARD_NAMES, canonical.PASS_BYTES), (2, 1)])
def test_typed_values(spark, monkeypatch, names, size):
    """One shard, or several in a broadcast each."""
    monkeypatch.setattr(canonical, "SHARD_NAMES", names)
    monkeypatch.setattr(canonical, "PASS_BYTES", size)
    ref = spark.createDataFrame([*ENTRIES, (None, "nothing"), ("nameless", None)], "id string, name string")
    df = spark.createDataFrame([(v, i) for i, v in enumerate(CASES)] * 2, "v string, name int")
    got = canonical.map_values(df, "v", ref, "id", [F.array("id", "name")])
    assert got.columns == ["v", "name", "op_id"] and got.count() == 2 * len(CASES)
    assert {r.v: r.op_id for r in got.collect()} == CASES
    empty = canonical.map_values(df, "v", ref.limit(0), "id", [F.array("id", "name")])
    assert {r.op_id for r in empty.collect()} == {"unmatched", None}
    assert canonical.map_values(df.limit(0), "v", ref, "id", [F.array("id", "name")]).count() == 0


def test_winners_equal_brute_force():
    """Against the distance of every window to every form."""
    rng = random.Random(4)
    shard = canonical.Shard(ENTRIES)
    values = []
    for _ in range(150):
        v = list(rng.choice(ENTRIES)[1].lower())
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = rng.choice(["", "", "x", "e ", " ", v[0]])
        values.append(rng.choice(["", "so ", "kind of "]) + "".join(v) + rng.choice(["", " etc", " - rev"]))
    for v, got in zip(values, shard.winners(values)):
        windows = set(shard.windows(canonical.words_of(v)))
        want = [(d, -len(f), shard.ids[f]) for f in shard.ids if "." not in f for w in windows if (d := canonical.damerau(f, w)) <= shard.allowed(len(f))]
        assert got == min(want, default=None), v


# top n


@pytest.mark.parametrize("most", [topn.MAX_THRESHOLDS, 3])
def test_top_n(spark, monkeypatch, most):
    monkeypatch.setattr(topn, "MAX_THRESHOLDS", most)
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else rng.choice([None, "a", "b"]), rng.choice("xy"), i, rng.choice([None, math.nan, math.inf, -math.inf, 0.5, round(rng.random(), 2)])) for i in range(3000)]
    data += [x for x in data if rng.random() < 0.3] + [data[7]] * 400
    want = []
    groups = {}
    for g, t, i, s in data:
        if s is not None and not math.isnan(s):
            groups.setdefault((g, t), set()).add((-s, i))
    for (g, t), items in groups.items():
        want += [(g, t, i, -s, p) for p, (s, i) in enumerate(sorted(items)[:4], 1)]
    df = spark.createDataFrame([(*x, 1) for x in data], "key0 string, t string, id long, bin double, place int")
    got = topn.top_n(df, ["key0", "t"], "id", "bin", 4)
    key = lambda r: (str(r[0]), r[1], r[4])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_top_n_of_nothing_and_of_equals(spark):
    df = spark.createDataFrame([("g", i, 1.0) for i in range(50)], "g string, i long, s double")
    assert [r.i for r in topn.top_n(df, ["g"], "i", "s", 3).orderBy("place").collect()] == [0, 1, 2]
    assert topn.top_n(df.limit(0), ["g"], "i", "s", 3).count() == 0
    assert topn.top_n(df.select("g", "i", F.lit(None).cast("double").alias("s")), ["g"], "i", "s", 3).count() == 0


# encoding

TEXTS = [None, "", " ", "a", "don't  stop\n\n now ", "x" * 3000, "é" * 50, "漢字かな混じり文。", "tabs\t\tand nbsp  wide", "<|endoftext|> is text", "emoji 👩‍👩‍👧 ok", "\x1c sep \x00", "a b " * 20000, "  lead", "trail  "]


def test_ids_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = encode.read_ranks(encode.default_ranks())
    lib = tiktoken.Encoding("t", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "ids int, text string").withColumn("key", F.lit(1))
    got = dict(rows(encode.encode(df, "ids", "text").toDF("k", "v")))
    assert got == {i: lib.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_round_trip_of_any_bytes(spark):
    raw = [b"ok", b"\xff" * 3 + "é\u4e00".encode() + b"\xed\xa0\x80 \xc0", b"a\xff " * 30_000, b"\xff\xfe", b"a\xc3", b"\xe2\x82 b", "é".encode(), b""]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, t binary")
    ids = encode.encode(df, "k", "t")
    assert dict(rows(encode.decode(ids, "k", "ids"))) == dict(enumerate(raw))
    assert encode.encode(df.limit(0), "k", "t").count() == 0


# packing


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert np.abs(np.diff(walk, axis=0)).sum(1).max() == 1


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", "word " * 700] + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, container string")
    sizes = {r.doc_id: r.n_tokens for r in pack.sizes(df, "doc_id", "text").collect()}
    got = pack.pack_texts(df, "doc_id", "text", 128).collect()
    used, pieces = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.from_token, r.n_tokens))
    assert set(pieces) == set(sizes) and max(used.values()) <= 128
    for doc, p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == sizes[doc]
        assert len(p) == max(1, -(-sizes[doc] // 128)) and [x[1] for x in p] == [128 * i for i in range(len(p))]
    assert sum(used.values()) / (128 * len(used)) > 0.95
    assert {r.doc_id: r.position for r in got}.keys() == sizes.keys() and len({r.position for r in got}) == len(sizes)
    assert pack.pack_texts(df.limit(0), "doc_id", "text", 128).count() == 0


def test_containers_hold_neighbours(spark):
    """Texts of two kinds in one table: nearly every container holds texts of one kind, and little room is left."""
    rng = random.Random(14)
    kinds = [[f"{k}{w}" for w in ("stone", "river", "cloud", "metal", "paper")] for k in ("alpha ", "omega beta ")]
    texts = [" ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randrange(4, 40))) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = pack.pack_texts(df, "doc_id", "text", 512).collect()
    held = {}
    for r in got:
        held.setdefault(r.container, []).append(r)
    assert np.mean([len({r.doc_id % 2 for r in rs}) == 1 for rs in held.values()]) > 0.6
    spans = sorted(max(r.position for r in rs) - min(r.position for r in rs) for rs in held.values())
    assert spans[len(spans) // 2] < 2 * pack.RUN and sum(r.n_tokens for r in got) / (512 * len(held)) > 0.97


# near duplicates


def words(t):
    return frozenset(re.findall("[a-z0-9]+", (t or "").lower()))


def near_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(80)] + ["the", "of", "and", "yet"] * 6
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.randrange(3)):
            c = list(b)
            for _ in range(rng.randrange(1, 12)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rng.shuffle(c)
            out.append(" ".join(c))
    return out + [None, "", "...", out[0], out[0].upper(), "x" * 20000]


@pytest.mark.parametrize("frequent,hot,ratio", [(0.02, 50_000, 1.3), (0.3, 9, 1.3), (2.0, 25, 1.6), (0.0, 4, 1.1)])
def test_near_duplicates_miss_nothing(spark, monkeypatch, frequent, hot, ratio):
    """The parity sketches alone find all pairs, whichever words are dealt, whatever the bands, with buckets split or whole."""
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "RATIO", ratio)
    texts = near_texts(random.Random(5), 120)
    w = [words(t) for t in texts]
    want = sorted((i, j) for i, j in itertools.combinations(range(len(w)), 2) if w[i] and w[j] and len(w[i] & w[j]) / len(w[i] | w[j]) >= 0.7)
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)] * 2, "id long, a string, b string, words int")
    near = neardup.NearDuplicates(df, "id", ["a", "b"], 0.7)
    assert rows(near.pairs()) == want and len(want) > 60
    linked = {}
    for i, j in want:
        linked.setdefault(i, set()).add(j)
        linked.setdefault(j, set()).add(i)
    got = {r.id: r for r in near.groups().collect()}
    assert {i: r.links for i, r in got.items()} == {i: len(linked.get(i, ())) for i in range(len(texts))}
    for i, js in linked.items():
        assert all(got[i].group == got[j].group for j in js) and got[i].group <= i


def test_split_buckets_hold_every_pair_once():
    """Chunks of a hot bucket: any two rows that may meet do so in exactly one cell, and no cell holds all."""
    plan = neardup.Plan(0.7, np.zeros(0, dtype=np.uint64), [10], [0])
    plan.hot, plan.chunks = np.array([77], dtype=np.uint64), np.array([4])
    ids = np.arange(200, dtype=np.int64)
    for sides in (np.zeros(200, dtype=np.int64), np.where(ids % 3 == 0, 2, 1)):
        keys = neardup._keyed(np.full(200, 77 << 3, dtype=np.uint64), sides, 0)
        keys, row = neardup.split_hot(keys, np.arange(200), ids, plan)
        met = {}
        for cell in set((keys >> np.uint64(3)).tolist()):
            at = np.nonzero(keys >> np.uint64(3) == cell)[0]
            assert len(at) < 200
            side = neardup._kind(keys[at])[1]
            for (x, s), (y, t) in itertools.combinations(zip(row[at].tolist(), side), 2):
                if s == t == 0 or {s, t} == {1, 2}:
                    met[min(x, y), max(x, y)] = met.get((min(x, y), max(x, y)), 0) + 1
        want = {(x, y) for x, y in itertools.combinations(range(200), 2) if sides[x] == sides[y] == 0 or sides[x] != sides[y]}
        assert set(met) == want and set(met.values()) == {1}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, a string")
    near = neardup.NearDuplicates(df, "id", ["a"], 0.7)
    assert near.pairs().count() == 0 and rows(near.groups()) == [(1, 1, 0), (2, 2, 0)]
    assert neardup.NearDuplicates(df.limit(0), "id", ["a"], 0.7).groups().count() == 0


# vectors


@pytest.mark.parametrize("span", [60_000, 150])
def test_neighbours(spark, monkeypatch, span):
    """In one range per ordering, and in several."""
    monkeypatch.setattr(similar, "RANGE", span)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    v = np.concatenate([c + 0.25 * rng.standard_normal((15, 16)) for c in centres]).astype(np.float32)
    v[50:60] = v[50]
    v[61] = v[60] * 3
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    bad = [(900, None), (901, [0.0] * 16), (902, [math.nan] + [1.0] * 15), (903, [1.0] * 15), (904, [math.inf] + [1.0] * 15), (905, [None] + [1.0] * 15)]
    df = spark.createDataFrame(data + bad + data[:30], "id long, v array<float>").withColumn("rep", F.lit("x"))
    got = {(r.id, r.other): r.cos for r in similar.neighbours(df, "id", "v", 16, 5, 0.85, curves=12, block=64).collect()}
    d = v.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1)[:, None]
    cos = (unit @ unit.T).round(9)
    want = {}
    for i in range(len(v)):
        best = sorted((-cos[i, j], j) for j in range(len(v)) if j != i and cos[i, j] >= 0.85)[:5]
        want |= {(i, j): -c for c, j in best}
    found = set(got) & set(want)
    assert len(found) / len(want) >= 0.97 and all(abs(got[p] - want[p]) < 1e-8 for p in found)
    assert {j for i, j in got if i == 55} == {50, 51, 52, 53, 54}  # copies: the smallest other ids
    assert similar.neighbours(df.limit(0), "id", "v", 16, 5, 0.85).count() == 0


# overlap


def test_paper_numbers(spark):
    forms = ["2401.00000123", " 2401.00000123v2\n", "PAPER:2401.00000123V3", "https://x.y/pdf/2401.00000123.md", "2024-01/2401.00000123.md", "[2401-00000123]", "240100000123", "2401_00000123", "2401/00000123"]
    none = [None, "", "unknown", "2401.0000012", "12401.000001234"]
    df = spark.createDataFrame([(f,) for f in forms + none], "f string").select("f", overlap.paper_number(F.col("f")).alias("n"))
    assert {r.f: r.n for r in df.collect()} == {**dict.fromkeys(forms, "2401.00000123"), **dict.fromkeys(none)}


def test_overlaps(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_WORDS", 500)
    monkeypatch.setattr(overlap, "PASS_BYTES", 60_000)
    rng = random.Random(7)
    texts = near_texts(rng, 100)
    ev = [(i, rng.choice([None, "", f"2401.{i % 9:08d}"]), t) for i, t in enumerate(texts) if i % 2]
    tr = [(i, f"PAPER:2401.{i % 13:08d}V1", t) for i, t in enumerate(texts) if i % 2 == 0 or i % 3 == 0]
    want = []
    for i, p, t in ev:
        for j, q, u in tr:
            a, b = words(t), words(u)
            if (p and p in q) or (len(a) >= 8 and len(b) >= 8 and len(a & b) / len(a | b) >= 0.75):
                want.append((i, j))
    e = spark.createDataFrame([(*x, 0.1) for x in ev] * 2, "eval_id long, paper string, passage string, coverage double")
    t = spark.createDataFrame(tr * 2, "train_id long, paper string, passage string")
    got = overlap.overlaps(e, t)
    assert rows(got.select("eval_id", "train_id")) == sorted(want) and got.filter("coverage is not null").count() > 30
    assert overlap.overlaps(e.limit(0), t).count() == 0 and overlap.overlaps(e, t.limit(0)).count() == 0


def test_pieces_and_coverage():
    assert overlap.merged([(3, 5), (0, 1), (1, 2), (4, 9), (11, 12)]) == [(0, 2), (3, 9), (11, 12)] and overlap.merged([]) == []
    passages = ["we lack a good account of how big gears turn slowly", "we lack a good account of why cold lakes freeze early", "one two three four five six seven eight one two"]
    shard = overlap.Shard([10, 20, 30], passages, 0.75)
    for mine, text in zip(shard.pieces, passages):
        words = text.split()
        assert [w for a, b, _ in mine for w in words[a:b]] == words  # the pieces of a passage are the whole passage
    assert any(b - a > 1 for mine in shard.pieces for a, b, _ in mine)
    assert list(shard.scan(passages[0])) == [(0, 1.0, 1.0)]
    edited = "they said we lack a good account of how gears turn slowly"
    ((which, coverage, similarity),) = shard.scan(edited)
    assert which == 0 and similarity == 10 / 13 and 0.5 < coverage < 1
    turned = " ".join(reversed(passages[2].split()))
    assert [i for i, *_ in shard.scan(turned)] == [2]  # a text in another order is found by its rarest words
    assert list(shard.scan("nothing of all this")) == [] and list(shard.scan("")) == [] and list(overlap.Shard([], [], 0.75).scan("a b")) == []


# abusive language


def test_words_are_undisguised():
    cases = {"p1g": ["pig"], "b_u_r_n_s": ["burns"], "misssserable": ["miserable"], "РАТHЕТІС": ["pathetic"], "(get": ["", "get"], "ｆｏｏｌ!": ["fool", ""], "ki​ll": ["kill"], "方法。": ["方", "法", ""], "x86": ["x", "0"], "": []}
    assert {k: abuse.words_of(k) for k in cases} == cases
    assert abuse.unspaced("an i d i o t here") == "an idiot here"


def corpus(rng, n):
    calm = ["the model improves the graph", "we study a sparse dataset", "this idiotproof method kills noise", "results are poor and the plan is bad", "das verfahren ist gut"]
    rude = ["you are a stupid pig", "shut up idiot", "i will hurt you", "du bist ein schwein"]
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        s = [rng.choice(calm) for _ in range(rng.randrange(1, 8))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), rng.choice(rude) + f" {rng.randrange(50)}")
        out.append((". ".join(s) + f". run {rng.randrange(10**6)}", int(bad)))
    return out


def test_held_out_accuracy():
    rng = random.Random(8)
    train, test = corpus(rng, 500), corpus(rng, 200)
    noisy = np.array([y ^ (rng.random() < 0.04) for _, y in train], dtype=np.int64)
    model = abuse.fit([t for t, _ in train], noisy, ["en"] * len(train))
    again = abuse.fit([t for t, _ in train], noisy, ["en"] * len(train))
    lexer = abuse.Lexer(model.buckets)
    scores = model.scores([lexer(t) for t, _ in test])
    right = np.mean((scores >= model.thresholds[""]) == np.array([y for _, y in test]))
    assert right >= 0.97
    assert np.array_equal(scores, again.scores([lexer(t) for t, _ in test]))
    long = "calm words about graphs. " * 4000
    assert model.scores([lexer(long)])[0] < 0.5 <= model.scores([lexer(long + "shut up idiot")])[0]


def test_scores_of_a_table(spark):
    data = corpus(random.Random(9), 200)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, (t, _) in enumerate(data)] + [(900, None, None, "s"), (901, "", "xx", None), (902, " \n", None, None)], "id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(0, None), (5, 1), (5, 0), (999, 1)], "id long, label int")
    got = {r.id: r.abusive for r in abuse.score(docs, labels, "id", "text", "lang").collect()}
    assert len(got) == 203 and not got[900] and not got[901] and not got[902]
    assert np.mean([got[i] == bool(y) for i, (_, y) in enumerate(data)]) >= 0.95
    none = abuse.score(docs, labels.limit(0), "id", "text", "lang").agg(F.max("score"), F.bool_or("abusive")).first()
    assert tuple(none) == (0.0, False)
    assert abuse.score(docs.limit(0), labels, "id", "text", "lang").count() == 0
    few = docs.select("id", "text", "lang")
    whole, thin = (abuse.fitted(few, labels, most_bytes=n) for n in (10**9, 4_000))
    assert len(thin.buckets) < len(whole.buckets)
