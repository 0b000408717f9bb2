"""Each operator against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import bpe, jaccard, secrets, sharding, tokens, vectors
from tallyframe.llm.jaccard import near_copies
from tallyframe.llm.lines import dedup_lines, line_key
from tallyframe.llm.quality import Settings, features, score_quality, train_quality
from tallyframe.plans.links import connected

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, k0 string, sig string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange():
    rnd = random.Random(3)
    alphabet = "aé'sltrvedm  \n\t!?19　\xa0²½中😀\x1c'"
    texts = ["", None, " ", "\n\n", "a<|endoftext|>b", "<|endoftext|>", "aaaaaaaaa" * 50, "word " * 6000, "  x" * 900]
    return texts + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(300)]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "clash", "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


def test_pieces_do_not_depend_on_chunks():
    classes = np.random.default_rng(1).integers(0, 12, 5000).astype(np.uint8)
    whole = bpe.starts(classes, 8192)
    for chunk in (1, 7, 512):
        assert (bpe.starts(classes, chunk) == whole).all()


def test_tokens_equal_the_library(spark, library):
    texts = strange()
    frame = docs(spark, texts)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame, PATH).collect()} == {i: (len((texts[i] or "").encode()), len(x), len(x) > 1024) for i, x in want.items()}
    coded = tokens.encode(frame, PATH)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()} == want
    assert {r.doc_id: r.text for r in tokens.decode(coded, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.count_tokens(frame.limit(0), PATH).count() == 0


def test_packing_is_gapless_and_tight(spark, library):
    texts = strange() + ["some more words here " * 40] * 30
    frame = docs(spark, texts)
    rows = tokens.pack(frame, PATH, capacity=128, group_pieces=50).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    bins, starts = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == starts[r.doc_id] and 0 < r.length <= 128 and (r.piece == 0 or r.length == 128)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        starts[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert starts == {i: len(x) for i, x in ids.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert tokens.pack(frame.limit(0), PATH).count() == 0


def test_best_fit_is_near_the_bound():
    rnd = random.Random(9)
    lengths = [rnd.choice([rnd.randint(1, 1024), rnd.randint(300, 700)]) for _ in range(5000)]
    places = tokens.best_fit(lengths, 1024)
    used = Counter()
    for n, (b, o) in zip(lengths, places, strict=True):
        assert o + n <= 1024
        used[b] += n
    assert len(used) <= 1.02 * sum(lengths) / 1024 + 1
    assert tokens.best_fit([], 8) == [] and len({b for b, _ in tokens.best_fit([3, 3, 3, 3], 8)}) == 2


def test_shards_take_turns(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 6)
    assert moved < 1009 // 4
    rows = sharding.assign_shards(docs(spark, ["a"] * 4, [1, 1, None, 2]), names, 1009).collect()
    assert len(rows) == 4 and rows[0].shard == rows[1].shard and {"lang", "sig"} <= set(rows[0].asDict())
    for bad in (1000, 5):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, bad)


def test_lines(spark):
    long = "This line is long enough to be counted by it"
    texts = [f"{i} head\n  {long.upper() if i % 2 else long}\t\n{long}\ntail" for i in range(5)] + [f"x\n{long[:39]}"] * 6 + [None, "", "a" * 200_000]
    ids = [*range(5), *range(10, 16), 20, 21, 22]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(spark, texts, ids)).collect()}
    assert [got[i] for i in range(4)] == [(4, 2, f"{i} head\ntail") for i in range(4)]
    assert got[4] == (4, 0, texts[4]) and got[10] == (2, 0, texts[5]) and got[20] == (1, 0, "") and got[22] == (1, 0, "a" * 200_000)
    same = docs(spark, [long] * 9, [1, 1, 1, 1, 1, 2, 3, 4, None])  # four documents and one without id
    assert {r.n_dropped for r in dedup_lines(same).collect()} == {0}
    assert dedup_lines(same.limit(0)).count() == 0


def test_secrets():
    key, hexa = "AKIA" + "Q" * 16, "0123456789abcdef0123"
    plain = f"é token = \"{hexa}\" and {key}."
    base, spans = secrets.find(plain)
    assert base == spans == [("assign", 2, 2 + len(f'token = "{hexa}')), ("hex", 11, 31), ("access", 37, 57)]
    for wrap in (quote, lambda s: quote(quote(s, safe=""), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(quote(base64.b64encode(zlib.compress(s.encode())).decode()).encode()).decode()):
        coded = wrap(f"secret: {key}!")
        base, spans = secrets.find(f"look {coded} here")
        assert any(k == "access" and 5 <= a < b <= 5 + len(coded) for k, a, b in spans), coded
        assert set(base) <= set(spans)
        assert secrets.masked(f"look {coded} here", "#").startswith("look ")
    assert secrets.find("") == ([], []) and secrets.find("word " * 50_000) == ([], [])


def brute_spans(text):
    out = []
    for kind, pattern, group, least in secrets.KINDS:
        out += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], secrets.ORDER[s[0]], s[2]))


def test_base_spans_equal_plain_patterns(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert secrets.find(t)[0] == brute_spans(t)
    rows = secrets.scan_secrets(docs(spark, [*texts[:20], None, ""])).collect()
    assert len(rows) == 22 and rows[-1].base == []


def test_quality_learns_without_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = train_quality(frame, labels)
    got = {r.doc_id: r for r in score_quality(frame, weights).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end quality")
    assert (train_quality(frame, flipped) == weights).all()
    none = score_quality(docs(spark, [None, "", "a"]), train_quality(frame.limit(0), labels.limit(0))).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 1)] * 3
    assert Settings().sample <= 10_000


def brute_links(texts, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rare", [1, 4, 32])
def test_near_copies_equal_brute_force(spark, monkeypatch, rare):
    """Groups of near copies of all strengths, shared passages, short texts: frequent tokens, too, as rare is lowered."""
    rnd = random.Random(rare)
    words = [f"w{i}" for i in range(400)]
    line = [rnd.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three four five", "one two three four five six"]
    for n in (6, 9, 20, 80, 300):
        origin = [rnd.choice(words) for _ in range(n)]
        for _ in range(10):
            t = list(origin)
            for _ in range(rnd.randint(0, max(1, n // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts += [" ".join(t), " ".join(t + line[: rnd.randint(0, 60)])]
    texts += [" ".join(line + [rnd.choice(words) for _ in range(rnd.randint(0, 8))]) for _ in range(12)]
    monkeypatch.setattr(jaccard, "RARE", rare)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(docs(spark, texts)).collect())
    assert got == brute_links(texts)


def test_near_copies_edges(spark):
    got = near_copies(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [5, 5, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (7, 7)]
    assert near_copies(docs(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 4), (20, 4), (5, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 9: 8, 8: 8}


def made_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v[100:250] = v[0]
    rows = [(i, [float(x) for x in np.float32(r)], 0) for i, r in enumerate(v)]
    rows += [(1000, None, 0), (1050, [], 0), (1100, [1.0, None] + [0.0] * 14, 0), (1150, [float("nan")] * 16, 0), (1200, [float("inf")] * 16, 0), (1300, [0.0] * 16, 0), (7, rows[9][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_top(good, k, every):
    """The k largest whole inner products of each query, in Python's integers; vectors without components count as zeros."""
    want = []
    for q, x in dict(reversed([(i, v) for i, v in good if i % every == 0])).items():
        best = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def whole(v):
    return [math.floor(256 * x) for x in v]


def test_exact_search_equals_brute_force(spark):
    rows, frame = made_vectors(spark)
    good = [(i, whole(np.array(v, np.float32).astype(np.float64).tolist())) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.exact_top_k(frame, block_rows=150, query_rows=4).collect()]
    assert sorted(got) == brute_top(good, 5, 50)
    assert vectors.exact_top_k(frame.limit(0)).count() == 0
    assert vectors.exact_top_k(frame.where("vec_id in (0, 1)")).count() == 1
    assert vectors.exact_top_k(frame.where("vec_id = 0")).count() == vectors.nearest(frame.where("vec_id = 0")).count() == vectors.nearest(frame.limit(0)).count() == 0


def test_exact_search_with_large_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [2e12, -3.0]), (2, [-5e11, 0.25]), (50, [3.0, 2.0]), (51, [7e3, 1e9]), (100, [1e5, 1e5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    for block_rows in (2, 100):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.exact_top_k(frame, block_rows=block_rows).collect()]
        assert sorted((q, v, s) for q, _, v, s in got) == sorted((q, v, cut(s)) for q, _, v, s in brute_top([(i, whole(v)) for i, v in rows], 5, 50))
    far = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e-300, 1.0]), (3, [1e306, 0.0]), (50, [1e160, -1e160])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in vectors.exact_top_k(far).orderBy("query_id", "vec_id").collect()] == [(0, 1), (0, 2), (0, 50), (50, 0), (50, 1), (50, 2)]


def clustered(n, groups, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 32))
    v = centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, 32))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)


def test_cells_and_bounds_rule_out_most_rows_of_clusters(spark):
    v = clustered(6000, 24)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    good = np.floor(256 * v).astype(np.int64)
    got = {}
    for r in vectors.exact_top_k(frame, block_rows=300, every=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 6000, 200):
        s = good @ good[q]
        s[q] = -(2**62)
        top = np.lexsort((np.arange(6000), -s))[:5]
        assert sorted(got[q]) == [(n + 1, int(i), int(s[i])) for n, i in enumerate(top)]
    cells = vectors.Cells(good[:320].astype(float), 20)
    own, far, size = cells.nearest(good.astype(float))
    cells.radius = np.array([far[own == c].max(initial=0) for c in range(20)])
    cells.longest = np.array([size[own == c].max(initial=0) for c in range(20)])
    queries = good[::200].astype(float)
    scores = queries @ good.T
    fifth = np.sort(scores, axis=1)[:, -6]
    most = cells.most(queries)
    assert all((scores[:, own == c] <= most[:, [c]]).all() for c in range(20))
    visited = (most >= fifth[:, None]).mean()
    assert visited < 0.5
    tree = vectors.build_tree(np.arange(6000), good.astype(float))
    vectors.search_tree(tree, np.arange(0, 6000, 200), queries, 5, np.full(30, -np.inf))
    assert tree["scored"] < 0.3 * 30 * 6000


def test_nearest_finds_nine_in_ten(spark):
    rows, frame = made_vectors(spark)
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = {}
    for r in vectors.nearest(frame, rerank=60, block_rows=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, x in good:
        if q % 20 == 0:
            best = sorted(((-float((x * y).sum()), i) for i, y in good if i != q))[:20]
            assert sorted(got[q]) == list(range(1, 21))
            hits += len({round(-s, 9) for s, _ in best} & {round(s, 9) for _, s in got[q].values()})
            total += len({round(-s, 9) for s, _ in best})
    assert hits >= 0.9 * total
    assert vectors.nearest(frame.limit(0)).count() == 0


def test_leading_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(8)
    for n in (1, 3, 7, 40):
        guess = rng.integers(0, 4, 30).astype(np.float32)
        want = sorted(range(30), key=lambda i: (-guess[i], i))[:n]
        assert sorted(vectors.leading(guess, n).tolist()) == sorted(want)


def test_copies_beyond_the_rerank_go_to_smaller_ids(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(500)], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in vectors.nearest(frame, block_rows=1000).where("query_id = 0").collect()]
    assert sorted(got) == [(i, i) for i in range(1, 21)]


def test_nearest_among_more_near_copies_than_are_reranked(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16))
    v[::3] = v[0] + 0.01 * rng.normal(size=(1000, 16))  # a third of the rows, in every block
    v = v.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest(frame, rerank=40, block_rows=1000).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 3000, 20):
        exact = (v * v[q]).sum(1)
        exact[q] = -np.inf
        assert [got[q][i] for i in range(1, 21)] == np.lexsort((np.arange(3000), -exact))[:20].tolist()


def test_packed_layers_that_lead_back_end(monkeypatch):
    a, b = b"q" * 20, b"z" * 20
    monkeypatch.setattr(secrets, "unpack", {a: b, b: a}.get)
    assert secrets.find("look " + base64.b64encode(a).decode()) == ([], [])


def test_base64_across_lines_glued_and_not_all_text():
    key = "AKIA" + "Q" * 16
    words = " ".join(str(i * i) for i in range(40))
    plain = f"{words} password = {'x1' * 40} {key} {words}".encode()
    flat = base64.b64encode(plain).decode()

    def spans(text):
        return {(k, a, b) for k, a, b in secrets.find(text)[1]}

    for data in (plain, gzip.compress(plain), zlib.compress(plain), b"\xff\x00" + plain + b"\x01\xfe"):
        coded = base64.b64encode(data).decode()
        for width in (10, 64, 76):
            lines = [coded[i : i + width] for i in range(0, len(coded), width)]
            for sep in ("\n", "\r\n", "\n  ", "\\n"):
                text = "-----BEGIN\n" + sep.join(lines) + "\nThe end"
                found = spans(text)
                assert {"access", "assign"} <= {k for k, *_ in found}, (width, sep)
                assert all(11 <= a < b <= len(text) - 8 for _, a, b in found)
                assert key not in secrets.masked(text, "#")
        for glue in ("https://x.y/a/", "https://x.y/ab/", "id_", "x-", "q/", "/"):
            for coded in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
                found = spans(glue + coded + " ok")
                assert {"access", "assign"} <= {k for k, *_ in found}, glue
                assert all(len(glue) <= a < b <= len(glue) + len(coded) for _, a, b in found)
    # spans are as before where a run is by itself
    at = plain.index(key.encode())
    assert ("access", at * 4 // 3, -(-(at + 20) * 4 // 3)) in spans(flat)
    coded = base64.b64encode(gzip.compress(plain)).decode()
    assert ("access", 0, len(coded)) in spans(coded)
    assert {k for k, *_ in spans("%FF" + "".join(f"%{x:02x}" for x in key.encode()))} == {"access"}


def test_members_and_broken_and_large_compressed_data(monkeypatch):
    key = "AKIA" + "Q" * 16
    rnd = random.Random(6)
    noise, other = ("".join(rnd.choice("ghij klmn") for _ in range(5000)) for _ in range(2))
    late = f"{noise} {key} {other}".encode()

    def spans(data):
        text = "see " + base64.b64encode(data).decode() + " ok"
        found = secrets.find(text)[1]
        assert all(4 <= a < b <= len(text) - 3 for _, a, b in found)
        return {k for k, *_ in found}

    first, second = gzip.compress(noise.encode()), gzip.compress(late)
    assert spans(first + second) == spans(first + b"\0" * 7 + gzip.compress(b"") + second) == {"access"}
    assert spans(gzip.compress(first + second)) == {"access"}
    for packed in (second, zlib.compress(late)):
        assert spans(packed[: len(packed) * 3 // 4]) == {"access"}  # cut short
        broken = bytearray(packed)
        broken[-3] ^= 255  # a wrong checksum
        assert spans(bytes(broken)) == {"access"}
    assert spans(gzip.compress(f"x^2 {key}".encode())) == {"access"}
    monkeypatch.setattr(secrets, "WINDOW", 4000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    monkeypatch.setattr(secrets, "PART", 1000)
    for before in range(3880, 4020, 7):  # over the edge of a window
        assert spans(gzip.compress((noise[:before] + key + noise).encode())) == {"access"}
    monkeypatch.undo()
    assert spans(gzip.compress(b" " * (65 << 20) + late)) == {"access"}


def test_rows_that_repeat_an_id_with_different_texts_are_linked(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(3, a), (5, a), (5, b), (5, ""), (9, b), (7, c), (8, ""), (11, ""), (11, c)]
    got = near_copies(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 3), (11, 7), (11, 7)]


def test_round_trip_digests_equal_the_library(spark, library):
    texts = strange()
    for r in tokens.round_trip(docs(spark, texts), PATH).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_run_in_sections(monkeypatch, library):
    rnd = random.Random(2)
    alphabet = "aé'sltrvedm  \n\t!?19　\xa0²½中😀\x1c'"
    v = bpe.Vocabulary.load(PATH)
    for n in (50, 400, 3000):
        for size in (7, 64):
            monkeypatch.setattr(bpe, "SECTION", size)
            text = "".join(rnd.choice(alphabet) for _ in range(n)) + "<|endoftext|>" + "z" * n
            assert "".join(bpe.sections(text, size)) == text
            ids = library.encode(text, add_special_tokens=False).ids
            assert v.encode_batch([text, "a"])[0].tolist() == ids and v.count_batch(["b", text]) == [1, len(ids)]


def test_counts_on_transitions_equal_the_merges():
    rnd = random.Random(5)
    v = bpe.Vocabulary.load(PATH)
    counter = bpe.Counter(v)
    for alphabet in ("ab", "aé 中", "etaoinshrdlu", "0123456789", "=-_", "😀é中"):
        for n in (1, 2, 9, 70, 1500):
            words = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(20)]
            assert counter.counts(words) == [len(x) // 4 for x in v.merge_all(words)]
    assert counter.count(b"") == 0 and counter.count(b"a" * 100_000) == len(v.merge_all(["a" * 100_000])[0]) // 4


def plain_leader(examples, s):
    """Follow-the-regularised-leader written out, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for text, y in examples:
            count = Counter(features(text, s.bits).tolist())
            length = math.sqrt(max(1, sum(c * c for c in count.values())))
            x = {i: c / length for i, c in count.items()} | {1 << s.bits: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * x[i] for i in x)))))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    return weight


def test_classifier_equals_a_plain_one(spark):
    d = "/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = Settings()
    weights = train_quality(frame, labels, s)
    text, marks = {r.doc_id: r.text or "" for r in frame.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    used = sorted((i for i in marks if i in text and zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: xxhash.xxh3_64_intdigest(str(i).encode()))
    weight = plain_leader([(text[i], marks[i]) for i in used], s)
    assert np.allclose(weights, [weight(i) for i in range(len(weights))], atol=1e-9)
    for r in score_quality(frame, weights).collect():
        count = Counter(features(r.text or "", s.bits).tolist())
        dot = sum(weight(i) * c for i, c in count.items()) / math.sqrt(max(1, sum(c * c for c in count.values())))
        assert abs(r.score - 1 / (1 + math.exp(-dot - weight(1 << s.bits)))) < 1e-5
    small = train_quality(frame.unionByName(frame), labels, Settings(sample_bytes=10_000))
    assert small.any() and not np.array_equal(small, weights)
    assert np.array_equal(train_quality(frame.unionByName(frame), labels, s), weights)  # repeated rows teach nothing new


def layered(rnd, text, at):
    """A text wrapped once, and for every character where it is from, written out by character."""
    kind = rnd.choice(["percent", "escape", "reference", "base64", "lines", "some"])
    if kind in ("base64", "lines"):
        data, owner = text.encode(), [a for c, a in zip(text, at, strict=True) for _ in c.encode()]
        coded, wide = base64.b64encode(data).decode(), 40
        place = [i + (i // wide if kind == "lines" else 0) for i in range(len(coded))]
        out = "\n".join(coded[i : i + wide] for i in range(0, len(coded), wide)) if kind == "lines" else coded
        last = len(coded.rstrip("=")) - 1
        ranges = [(place[k * 4 // 3], place[min(-(-(k + 1) * 4 // 3) - 1, last)] + 1) for k in range(len(data))]
        spans = {}
        for a, (low, high) in zip(owner, ranges, strict=True):
            spans[a] = (min(low, spans.get(a, (low, high))[0]), max(high, spans.get(a, (low, high))[1]))
        return out, [spans[a] for a in at]
    parts, spans, size = [], [], 0
    for c in text:
        if kind == "percent":
            x = quote(c, safe="") if c.encode() != quote(c, safe="").encode() else c
        elif kind == "escape":
            x = f"\\u{ord(c):04x}"
        elif kind == "reference":
            x = f"&#x{ord(c):x};"
        else:
            x = f"%{ord(c):02X}" if c in "aeiou=" else c
        parts.append(x)
        spans.append((size, size + len(x)))
        size += len(x)
    return "".join(parts), spans


def test_layers_map_to_where_they_are_from():
    rnd, key = random.Random(11), "AKIA" + "Q" * 16
    for _ in range(150):
        text = "".join(rnd.choice(["é ", "ab ", "x, ", "中 "]) for _ in range(rnd.randint(0, 12))) + f" {key} " + "so on " * rnd.randint(1, 5)
        first = text.index(key)
        low, high = first, first + len(key)
        for _ in range(rnd.randint(1, 4)):
            text, spans = layered(rnd, text, list(range(len(text))))
            low, high = spans[low][0], spans[high - 1][1]
            before = rnd.choice(["", "see: ", "at "])
            text, low, high = f"{before}{text}\tend.", low + len(before), high + len(before)
        found = secrets.find(text)
        assert ("access", low, high) in found[1], text
        assert found[0] == brute_spans(text)


def test_query_of_secrets_writes_spans(spark, tmp_path):
    from tallyframe.llm.queries import op3_secret_scan

    texts = ["password = 'x1x1x1x1x1x1x1' and AKIA" + "Z" * 16, "q " + base64.b64encode(b"key: AKIA" + b"B" * 16).decode(), None, "", "deadbeefdeadbeef00"] * 2
    docs(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    for r in op3_secret_scan(spark, f"file://{tmp_path}").collect():
        base, spans = secrets.find(texts[r.doc_id] or "")
        written = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(written(base).encode()).hexdigest(), written(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))


def test_memory_of_maps_follows_what_is_decoded():
    import tracemalloc

    tracemalloc.start()
    assert secrets.find("word " * 200_000 + "%41 tail") == ([], [])
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()


def test_empty_tables_and_clashing_columns(spark):
    none = docs(spark, ["a"]).limit(0)
    assert secrets.scan_secrets(none).count() == secrets.mask_secrets(none).count() == tokens.round_trip(none, PATH).count() == 0
    assert sharding.assign_shards(none, ["a", "b"], 7).count() == 0
    clash = spark.createDataFrame([(1, "t", "mine", 5), (None, None, "mine", 5)], "doc_id long, text string, shard string, slot int")
    assert {r.shard for r in sharding.assign_shards(clash, ["a", "b"], 7).collect()} <= {"a", "b"}
    assert sorted(r.n_shingles for r in near_copies(clash).collect()) == [0, 1]
    mine = spark.createDataFrame([(1, "t", "mine", 5)], "doc_id long, text string, predicted string, score int")
    assert [r.predicted for r in score_quality(mine, np.zeros((1 << 18) + 1)).collect()] == [1]
    rows = tokens.pack(docs(spark, [None, "", "a b"] * 4, [None] * 12), PATH).collect()
    assert sorted(r.length for r in rows) == [1] * 8 + [3] * 4 and len({(r.sequence_id, r.offset) for r in rows}) == 12


def test_long_lines_texts_and_repeated_rows(spark):
    long = "y" * 300_000
    texts = [long + "\n" + long, long, long, long, long, long + "\nz"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: (2, 2, 0), 1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 1, 0), 4: (1, 1, 0), 5: (2, 0, 300_002)}
    line = "a line that is repeated in rows of one document"
    rows = [(1, line), (1, line), (1, f"x\n{line}"), (2, line), (3, line), (4, line), (5, f"{line}\n{line}")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == [(1, 1, 1, ""), (1, 1, 1, ""), (1, 2, 1, "x"), (2, 1, 1, ""), (3, 1, 1, ""), (4, 1, 1, ""), (5, 2, 0, f"{line}\n{line}")]


def test_line_keys_tell_what_lower_case_tells(spark):
    rnd = random.Random(8)
    keys = ["".join(rnd.choice("kK\u212aiI\u0130\u0307ßẞÉéΣσς x") for _ in range(rnd.randint(1, 5))) for _ in range(3000)]
    low, rest = line_key(F.col("k"))
    rows = spark.createDataFrame([(k,) for k in sorted(set(keys))], "k string").select("k", low.alias("low"), rest.alias("rest")).collect()
    ascii_lower = lambda k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    assert len({(r.low, r.rest) for r in rows}) == len({ascii_lower(r.k) for r in rows}) == len({(ascii_lower(r.k), r.low, r.rest) for r in rows})


def test_recall_on_the_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in frame.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all() and np.any(r.embedding)}
    ids = np.array(sorted(rows))
    v = np.stack([rows[i] for i in ids])
    got = {}
    for r in vectors.nearest(frame, block_rows=300, rerank=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = (v * rows[q]).sum(1)
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(best & got[q]), total + len(best)
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hits >= 0.99 * total
