"""Operators against plain versions of their contracts on small tables."""

import json
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafwork.llm import bpe, common, embeddings, html, kneser_ney, language, lines, minhash, mixing, packing, quality, secrets
from sheafwork.llm.hnsw import Graph
from sheafwork.llm.queries import tokenizer_path

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 7))) for _ in range(400)]


def words(n: int) -> list[str]:
    return [R.choice(VOCAB) for _ in range(n)]


def near(base: list[str], share: float) -> list[str]:
    return [R.choice(VOCAB) if R.random() < share else w for w in base]


def components(n_ids, links):
    up = {i: i for i in n_ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in n_ids}


def test_connected_components(spark):
    edges = [(R.randrange(200), R.randrange(200)) for _ in range(120)] + [(0, i) for i in range(300, 380)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long"), common.Scratch(spark, "t")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(ids, [e for e in edges if e[0] != e[1]])


def plain_groups(docs):
    """(each document's shingles, its component)."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(sets, links)


@pytest.mark.parametrize("large", [64, 2])
def test_minhash(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "BLOCK", 4 if large == 2 else 512)
    monkeypatch.setattr(minhash, "PIVOT_SHARE", 2)
    texts = []
    base = words(120)
    texts += [near(base, x) for x in [0.0, 0.0] + [R.choice([0.01, 0.02, 0.03, 0.05, 0.08]) for _ in range(60)]]
    for _ in range(40):
        b = words(R.randint(1, 60))
        texts += [b, near(b, 0.03)]
    passage = words(60)
    texts += [words(20) + passage for _ in range(30)]
    docs = [(i, " ".join(t).replace("a", "A") if i % 3 else " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), common.Scratch(spark, "t")).collect()}
    sets, want = plain_groups(docs)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())


def plans_of(spark, run) -> list[str]:
    """The plans of all that ``run`` executes, as they ended."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {x.executionId() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    return [x.physicalPlanDescription() for x in map(ran.apply, range(ran.size())) if x.executionId() not in before]


def copies(spark):
    texts = [w for _ in range(30) for b in [words(60)] for w in (b, near(b, 0.02), near(b, 0.02))]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pipeline_near_duplicates_build_no_posts_in_the_driver(spark):
    import corpus_pipeline

    plans = plans_of(spark, lambda: corpus_pipeline.minhash_dedup(spark, copies(spark), "").count())
    posts = [p for p in plans if "posexplode" in p]
    assert posts and not any("Broadcast" in p for p in posts)


def test_near_duplicates_broadcast_nothing(spark):
    plans = plans_of(spark, lambda: minhash.near_duplicates(copies(spark), common.Scratch(spark, "t")).count())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def plain_lines(docs):
    """The numbers of each document's lines that go."""
    # A line goes if some run of lines with words, of 50 words or more, that holds it came earlier.
    seen, gone = set(), defaultdict(set)
    for i, t in docs:
        full = [(k, x.strip(), len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()]
        own = []
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += full[b][2]
                if n >= 50:
                    key = tuple(f[1] for f in full[a : b + 1])
                    if key in seen or key in own:
                        gone[i].update(range(full[a][0], full[b][0] + 1))
                    own.append(key)
        seen.update(own)
    return gone


def test_minhash_recall():
    """Planted pairs of sets at similarity 0.75 to 0.80: how many share the coordinates that a candidate needs."""
    g = np.random.default_rng(8)
    met = []
    for _ in range(3000):
        n = int(g.integers(40, 400))
        share = g.uniform(0.75, 0.8)
        both = int(np.ceil(2 * n * share / (1 + share)))
        a = g.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        met.append(int((minhash.signature(np.unique(a[:n])) == minhash.signature(np.unique(a[n - both :]))).sum()))
    assert min(met) >= minhash.MATCHES
    assert np.mean(met) > 0.74 * minhash.COORDS


def test_line_dedup(spark):
    long_ = [" ".join(words(R.randint(50, 80))) for _ in range(6)]
    short = [" ".join(words(R.randint(1, 30))) for _ in range(40)]
    docs = [(i, "\n".join(R.choice(long_ + short * 2 + ["", "  "]) for _ in range(R.randint(1, 14)))) for i in range(120)]
    run = [short[k] for k in range(8)]
    docs += [(200 + i, "\n".join([R.choice(short), *run, R.choice(short)])) for i in range(5)]
    got = {r["doc_id"]: r for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), common.Scratch(spark, "t")).collect()}
    gone = plain_lines(docs)
    for i, t in docs:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i]["text"] == want and got[i]["_n_removed"] == len(gone[i]), i


def test_line_dedup_goes_by_its_fingerprints(spark, monkeypatch):
    passage = [" ".join(words(12)) for _ in range(9)]
    docs = [(i, "\n".join([f"own {i}", *passage[i % 3 :], f"end {i}"])) for i in range(500)]  # one hot passage
    table = spark.createDataFrame(docs, "doc_id long, text string")
    posted = lines.posts(table).collect()
    # Far fewer positions than lines are posted, and equal windows lie under equal fingerprints.
    assert len(posted) < 0.5 * sum(t.count("\n") + 1 for _, t in docs)
    under = defaultdict(set)
    for r in posted:
        for w in r["windows"]:
            under[w["k1"], w["k2"]].add(r["g"])
    assert all(len(g) == 1 for g in under.values())
    got = {r["doc_id"]: r["_n_removed"] for r in lines.line_dedup(table, common.Scratch(spark, "t")).collect()}
    assert [got[i] for i in range(6)] == [0, 8, 7, 9, 8, 7] and all(got[i] == 9 - i % 3 for i in range(3, 500))
    real = lines.posts
    monkeypatch.setattr(lines, "posts", lambda *a, **k: real(*a, **k).withColumn("g", F.xxhash64("id", "at")))  # no fingerprint meets another
    assert {r["_n_removed"] for r in lines.line_dedup(table, common.Scratch(spark, "t")).collect()} == {0}


def secret_spans(t: str) -> tuple[list, list]:
    kinds = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    base = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t, re.ASCII) if ok(m))
    found = []
    for m in re.finditer(secrets.CANDIDATE, t):
        s = m[0]
        if not (re.search("[A-Za-z]", s) and re.search("[0-9]", s)) or re.search(secrets.ALLOW, s) or any(b[0] < m.end() and m.start() < b[3] for b in base):
            continue
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[k : k + 20]).values()) for k in range(len(s) - 19))
        if best >= next(b for c, b in secrets.CLASSES if re.fullmatch(c, s)) - 1e-12:
            found.append((m.start(), 3, "entropy", m.end()))
    return base, sorted(base + found)


def test_secrets(spark):
    import hashlib

    pieces = ["token = \"abcdef123456", "Secret:x", "api_key='AAAAAAAAAAAA'", "apikey=short", "AKIA" + "Z9" * 8, "AKIA1234", "0123456789abcdef0", "deadbeef", "\U0001f600 é", "token: secret: abcdefghijklmnop",
              "ghp_" + "aZ3bY4cX5dW6eV7fU8gT9", "abcdefghijklmnopqrstuvwxyz0123", "A" * 30 + "1", "DEADBEEF12345678DEADBEEF", "passwd==abcdefghijklmnop", "x" * 25, "1" * 30, "q7R-s8T_u9V+w0X/y1Z=a2B", "\n", " "]
    docs = [(i, "".join(R.choice(pieces) + R.choice(["", " ", ",", "\n"]) for _ in range(R.randint(0, 12)))) for i in range(300)]
    for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        base, all_ = secret_spans(docs[r["doc_id"]][1])
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        assert r["spans"] == text(all_), docs[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]


def test_secrets_in_long_texts(spark):
    import time

    took = []
    for n in (1_000, 6_000):
        t = " ".join(f"{R.getrandbits(80):020x} password={R.getrandbits(64):016x}zQ {R.choice('gG')}{R.getrandbits(80):020X}" for _ in range(n // 2))
        table = spark.createDataFrame([(1, t)], "doc_id long, text string")
        start = time.perf_counter()
        got = secrets.scan(table).first()
        took.append(time.perf_counter() - start)
        assert got["n_hex"] >= n // 2 and got["n_assign"] == n // 2 and got["spans"].count(":") >= 2 * (got["n_hex"] + got["n_assign"])
    assert took[1] < 8 * took[0] + 5


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 7)  # ranks over salts
    tok = Tokenizer.from_file(tokenizer_path())
    docs = [(i, " ".join(words(R.choice([0, 1, 5, 90, 400, 1500])))) for i in range(150)] + [(900 + i, "same text") for i in range(40)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), common.Scratch(spark, "t"), tokenizer_path()).collect()
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, full in ids.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = full[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(full)
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    room: list[int] = []  # plain best fit in decreasing length
    for n in sorted((r["length"] for r in got), reverse=True):
        k = min((k for k, x in enumerate(room) if x >= n), key=lambda k: room[k], default=-1)
        if k < 0:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert len(by_seq) <= len(room)


def test_packing_knows_all_patterns():
    found = packing.patterns(2048, np.ones(2049, np.int64))
    assert all(sum(p) == 2048 for p in found) and len(set(found)) == len(found)
    assert sum(len(p) == 3 for p in found) == round(2048**2 / 12) and sum(len(p) == 2 for p in found) == 1024


def cases(token: str) -> list[str]:
    return [token, token.upper(), token.title(), token.swapcase(), "".join(R.choice([c.upper(), c]) for c in token), token[:-1], token[1:], token[:5], token.replace("t", "T", 1), token.replace("|", " |"), token.replace("o", "ô")]


def test_merges_equal_the_library(tmp_path):
    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    assert bpe.understood(path)
    w = packing.WordTokenizer(path, cached=50)
    some = ["the", "a", "ing", "é", "É", "'s", "'RE", "’", "Σ", "ς", "é", " ", "\n", "\x1c", "\x85", "<|", "|>", "12", "漢", "..", "İ", "ß", "aaa", "ſ", "½", "ŉ", "\u212a", "\u00a0", "\x00"]
    some += [c for m in bpe.added(path) for c in cases(m.decode())]
    texts = ["".join(R.choice(some) for _ in range(R.randint(0, 9))) for _ in range(6000)]
    texts += ["".join(chr(R.choice([R.randrange(1, 0x250), R.randrange(0x20, 0x7F), R.randrange(0x300, 0x2100)])) for _ in range(R.randint(0, 30))) for _ in range(6000)]
    texts += [a + b + c for a in "AEHJTWYhjtwyÉ" for b in ["\u030a", "\u0331", "\u0308", "\u030c", "\u0323\u030a", "\u0345"] for c in ["", "x", "Y\u030a"]]
    for t, got, e in zip(texts, w.all_ids([t.encode() for t in texts]), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(e.ids, "<u4").tobytes(), t
    assert bpe.split(b"word") == [b"word"]
    # Another file's rules aren't guessed at: its texts go to the library whole.
    other = json.loads(open(path, encoding="utf-8").read())
    other["normalizer"]["normalizers"].pop()
    (tmp_path / "o.json").write_text(json.dumps(other), encoding="utf-8")
    assert not bpe.understood(str(tmp_path / "o.json"))
    cased, plain = packing.WordTokenizer(str(tmp_path / "o.json")), Tokenizer.from_file(str(tmp_path / "o.json"))
    for t in texts[:200]:
        assert cased.ids(t.encode()) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_fits_patterns():
    have = np.zeros(2049, np.int64)
    for a, b, c in [(1500, 548, 0), (700, 700, 648), (1000, 600, 448)]:
        have[[x for x in (a, b, c) if x]] += 100
    have[700] += 100
    done = packing.plan(have)
    assert sum(n for _, n in done) == 300 and all(sum(p) == 2048 for p, _ in done)
    g = np.random.default_rng(5)
    have = np.bincount(np.minimum(g.lognormal(5.5, 1.0, 20_000).astype(int) + 1, 2048), minlength=2049)
    done = packing.plan(have)
    used = np.zeros(2049, np.int64)
    for p, n in done:
        assert sum(p) <= 2048
        for m in p:
            used[m] += n
    assert (used == have).all()
    assert sum(n for _, n in done) <= 1.01 * (np.arange(2049) * have).sum() / 2048 + 1


def test_mixing(spark):
    docs = [(i, " ".join(words(R.randint(0, 50))), R.choice(["a", "b", "c", "é", None] + ["a"] * 6)) for i in range(300)] + [(999, "one", "z")]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, float(sum(size.values())), set(order)
    while True:  # shares; what stands above its cap stops there, and the rest is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    source, taken = {i: s for i, _, s in docs}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9) and r["source_size"] == size[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1.0001 for s in order)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 40)  # several shards, so foreign queries
    audit: list = []
    g = np.random.default_rng(2)
    rows = []
    for i in range(700):
        v = g.normal(size=16) if i % 3 or not rows else np.array(rows[g.integers(len(rows))][1]) + g.normal(size=16) * g.choice([0, 0.02, 0.06, 0.1])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4)))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), common.Scratch(spark, "t"), audit=audit).collect()}
    (true, found), = audit
    assert true > 100 and found >= 0.9 * true
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    want = components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(link) if a < b])
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_graph_recall():
    g = np.random.default_rng(3)
    x = g.normal(size=(1500, 24))
    x[700:1100] = x[5] + g.normal(size=(400, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    true = x @ x.T >= 0.98
    q, i = graph.within(x, 0.98, 24)
    assert true[q, i].all() and len(q) >= 0.99 * true.sum()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "RANGE_ROWS", 60)
    monkeypatch.setattr(embeddings, "LEAST_RANGE", 60)
    g = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(g.normal(size=6), 1)]) for i in range(-100, 400)]  # rounded: many ties
    got = sorted(tuple(r) for r in embeddings.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), common.Scratch(spark, "t")).collect())
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_language(spark):
    langs = {"xx": "aeiou bcd", "yy": "öäü stk", "zz": "ny lr"}
    docs = []
    for i in range(400):
        name = R.choice(list(langs))
        docs.append((i, " ".join("".join(R.choice(langs[name]) for _ in range(6)) for _ in range(R.randint(3, 40))), name))
    got = language.language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string"), common.Scratch(spark, "t")).collect()
    lang = {i: x for i, _, x in docs}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_tokenizer_merges_a_word_once(monkeypatch):
    """Words met again aren't merged again when the cache turns over, nor text by text; ids are the library's."""
    path = tokenizer_path()
    merged = []
    learn = packing.WordTokenizer.learn
    monkeypatch.setattr(packing.WordTokenizer, "learn", lambda self, new, *a: merged.append(list(new)) or learn(self, new, *a))
    w, plain = packing.WordTokenizer(path, cached=100), Tokenizer.from_file(path)
    letters = "abcdefghijkl\u00e9\u00d6\u0178\u0133XYZ0123456789.,;!?#$%&'-_~\u2019\u4e2d"
    pool = list({"".join(R.choice(letters) for _ in range(R.randint(1, 12))) for _ in range(150)})
    first = [" ".join(pool)] * 2
    later = [[" ".join([*R.sample(pool, 100), f"new{k}{i}"]) for i in range(20)] for k in range(3)]
    for batch in (first, *later):
        for t, ids in zip(batch, w.all_ids([t.encode() for t in batch]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(merged) <= 4 and max(Counter(x for new in merged for x in new).values()) == 1


def test_kneser_ney():
    text = "abracadabra " * 3 + "the quick brown fox " * 5
    k, n = np.unique(kneser_ney.keys(text), return_counts=True)
    m = kneser_ney.Model(k, n)
    for h in [*(k[:20] >> kneser_ney.CHAR), 12345]:  # every history has a distribution over the characters
        every = (int(h) << kneser_ney.CHAR) | np.arange(1 << kneser_ney.CHAR)
        assert math.isclose(np.exp(m.log_probability(every)).sum(), 1.0, rel_tol=1e-9)
    t = kneser_ney.Table(k)
    assert (t.find(k) == np.arange(len(k))).all() and (t.find(k + 1)[~np.isin(k + 1, k)] == -1).all()


def test_kneser_ney_keeps_scripts():
    pool = [chr(x) for x in range(0x4E00, 0x4E60)] + ["\U0001F600", "\u2019", "\u2014"]
    text = "".join(R.choice(pool[:40]) + pool[40 + k % 50] for k in range(3000)) * 2
    shuffled = "".join(R.sample(text, len(text)))
    low, high = kneser_ney.keys(text), kneser_ney.highs(text)
    _, one, n = np.unique(kneser_ney.fold(low, high), return_index=True, return_counts=True)
    assert len(one) == len({("\n" * 4 + text)[i : i + 5] for i in range(len(text))})
    m = kneser_ney.Model(low[one], n, high[one])
    assert m.text_log_probability(text).mean() > m.text_log_probability(shuffled).mean() + 1
    h = "\n" * 4 + text[:1]  # a history has a distribution over all characters
    every = np.arange(1 << kneser_ney.CHAR + kneser_ney.HIGH)
    ahead = [sum((ord(c) & 4095) << 12 * (4 - i) for i, c in enumerate(h[1:])), sum((ord(c) >> 12) << 9 * (4 - i) for i, c in enumerate(h[1:]))]
    assert math.isclose(np.exp(m.log_probability(ahead[0] | every & 4095, ahead[1] | every >> 12)).sum(), 1.0, rel_tol=1e-9)


def test_quality_in_chinese(spark):
    pool = [chr(x) for x in range(0x4E00, 0x4F00)]
    parts = ["".join(R.choice(pool) for _ in range(4)) for _ in range(60)]
    good = [(i, "".join(R.choice(parts) for _ in range(80)), "zh") for i in range(300)]
    junk = [(1000 + i, "".join(R.sample(good[i][1], len(good[i][1]))), "zh") for i in range(40)]
    labels = [(i, 1, 0) for i in range(300)]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), common.Scratch(spark, "t")).collect()}
    assert not any(got[i] for i, *_ in junk) and sum(got[i] for i, *_ in good) >= 0.96 * len(good)


def test_quality_of_a_rare_language(spark):
    def noisy(share):
        return " ".join("".join(R.choice("abcdefghijklmnop") for _ in w) if R.random() < share else w for w in words(150))

    common_ = [(i, noisy(R.random() / 2), "en") for i in range(300)]
    rare = [(1000 + i, noisy(0), "de") for i in range(40)]
    junk = [(2000 + i, noisy(0.25), "de") for i in range(30)]
    labels = [(i, 1, 0) for i, *_ in common_ + rare]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(spark.createDataFrame(common_ + rare + junk, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), common.Scratch(spark, "t")).collect()}
    assert sum(got[i] for i, *_ in junk) <= 3 and sum(got[i] for i, *_ in rare) >= 36


@pytest.mark.parametrize("shard_grams", [10**9, 400])
def test_quality_learns_from_all_trusted_documents(spark, monkeypatch, shard_grams):
    monkeypatch.setattr(quality, "SHARD_GRAMS", shard_grams, raising=False)
    docs = [(i, " ".join(words(4)) + (" \u4e2d\u6587\u5b57" if i % 50 == 0 else ""), "en") for i in range(900)]
    labels = [(i, 1, 0) for i, *_ in docs if i % 3]
    got = {r["doc_id"]: r["perplexity"] for r in quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), common.Scratch(spark, "t")).collect()}
    low = np.concatenate([kneser_ney.keys(t) for i, t, _ in docs if i % 3])
    high = np.concatenate([np.zeros(len(kneser_ney.keys(t)), np.int64) if (h := kneser_ney.highs(t)) is None else h for i, t, _ in docs if i % 3])
    _, one, n = np.unique(kneser_ney.fold(low, high), return_index=True, return_counts=True)
    plain = kneser_ney.Model(low[one], n, high[one])
    assert all(math.isclose(got[i], math.exp(-plain.text_log_probability(t).mean()), rel_tol=1e-9) for i, t, _ in docs)


def test_quality_hands_out_small_models(spark, monkeypatch):
    """What all tasks get is a few bytes for each 5-gram, and the texts are scored once: disk and time go with these."""
    sent, passes = [], []
    context, frame = type(spark.sparkContext), type(spark.range(0))
    broadcast, mapped = context.broadcast, frame.mapInArrow
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or broadcast(self, value))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: passes.append(f.__name__) or mapped(self, f, *a, **k))
    docs = [(i, " ".join("".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)), "en") for i in range(500)]
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i, *_ in docs], "doc_id long, quality int, toxic int"), common.Scratch(spark, "t")).collect()
    assert len(got) == len(docs)
    grams = len(np.unique(np.concatenate([kneser_ney.keys(t) for _, t, _ in docs])))
    assert grams > 100_000 and sum(sent) < 20 * grams
    assert passes.count("score") == 1


def test_kneser_ney_of_several_selections():
    texts = ["abracadabra " * 3, "the quick brown fox \u4e2d " * 5, "zebra crossing", ""]
    found = [(kneser_ney.keys(t), np.zeros(len(t), np.int64) if (h := kneser_ney.highs(t)) is None else h) for t in texts]

    def model(some):
        low, high = (np.concatenate(x) for x in zip(*[found[i] for i in some], strict=True))
        _, one, n = np.unique(kneser_ney.fold(low, high), return_index=True, return_counts=True)
        return kneser_ney.Model(low[one], n, high[one]), dict(zip(zip(low[one].tolist(), high[one].tolist(), strict=True), n.tolist(), strict=True))

    picks = [[0, 1, 2], [0, 2], [1], [3]]
    grams = list(model(picks[0])[1])
    counts = np.array([[model(p)[1].get(g, 0) for g in grams] for p in picks])
    both = kneser_ney.Model(np.array([g[0] for g in grams]), counts, np.array([g[1] for g in grams]))
    for low, high in [*found, (found[0][0] + 1, found[0][1])]:
        for got, p in zip(both.log_probabilities(low, high, list(range(4))), picks, strict=True):
            assert np.allclose(got, model(p)[0].log_probability(low, high), rtol=1e-12)
        each = np.arange(len(low)) % 4
        assert (both.log_probabilities(low, high, [each])[0] == np.choose(each, both.log_probabilities(low, high, [0, 1, 2, 3]))).all()


def test_quality(spark):
    good = [(i, " ".join(words(R.randint(30, 200))), R.choice(["en", "de"])) for i in range(400)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(60)), "en") for i in range(30)]
    labels = [(i, 1, 0) for i, *_ in good if i % 2] + [(i, 0, 0) for i, *_ in bad if i % 2]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), common.Scratch(spark, "t")).collect()}
    assert not any(got[i] for i, *_ in bad)
    assert sum(got[i] for i, *_ in good) >= 0.96 * len(good)


def test_html_held_out():
    exact = 0
    for seed in range(50_000, 50_100):
        source = html.make_page(seed)
        page = html.parse(source)
        _, home, judged = html.features(page)
        marks = iter(int(m) for m in re.findall(r"data-k=(\d)", source))
        marked = {i: next(marks) for i, n in enumerate(page.nodes) if n.tag in html.GROUP_OF and n.tag != "#root"} | {0: 1}
        want = html.text_of(page, home, {i for i in judged if marked.get(i, 0)})
        exact += html.extract([source], html.model())[0] == want
    assert exact >= 90


def test_html_rules():
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now this thing.</div><article><h1>A  title</h1><p>One &amp; two<br>three.<p>Four <b>five</b>\n six.<script>var x="</p>";</script></article><footer>&copy; someone.</footer></body></html>'
    assert html.extract([page], html.model()) == ["A title\n\nOne & two three.\n\nFour five six."]
    # A kept node has kept ancestors.
    p = html.parse(page)
    x, home, judged = html.features(p)
    kept = html.decode(p, home, judged, html.model().logits(x))
    assert all(i == 0 or int(home[p.nodes[i].parent]) in kept for i in kept)


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version of it, on what the stage before it kept."""
    import corpus_pipeline

    langs = {"xx": "aeiou bcd", "yy": "oeu stk", "zz": "ny lr"}
    say = lambda name, n: " ".join("".join(R.choice(langs[name].replace(" ", "")) for _ in range(R.randint(2, 8))) for _ in range(n))
    docs = []
    for i in range(260):
        name = R.choice(list(langs))
        docs.append((i, "\n".join(say(name, R.randint(4, 30)) for _ in range(R.randint(1, 6))), name, R.choice("abc")))
    passage = "\n".join(say("xx", 14) for _ in range(5))
    docs += [(300 + i, f"{say('xx', 30)}\n{passage}\n{say('xx', 30)}", "xx", "a") for i in range(8)]
    base = say("yy", 200).split()
    docs += [(320 + i, " ".join(say("yy", 1) if R.random() < 0.01 else w for w in base), "yy", "b") for i in range(12)]
    docs += [(340, "12 34 !!", "xx", "a"), (341, None, "xx", "c"), (342, docs[5][1], "xx", "c")]
    table = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    at = table
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, at, "").write.parquet(path)
        at = spark.read.parquet(path)
        kept[name] = at.collect()
    said = {r["doc_id"]: r["text"] for r in kept["language_id"]}
    assert 340 not in said and 341 not in said and len(said) >= len(docs) - 12
    assert all(said[i] == t for i, t, *_ in docs if i in said)
    gone = plain_lines(sorted(said.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in said.items()}
    want = {i: t for i, t in want.items() if not gone[i] or t.split()}
    got = {r["doc_id"]: r for r in kept["line_dedup"]}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    _, group = plain_groups(sorted(want.items()))
    assert sorted(r["doc_id"] for r in kept["minhash_dedup"]) == sorted(i for i in want if group[i] == i)
    assert sum(320 <= r["doc_id"] < 332 for r in kept["minhash_dedup"]) == 1
    left = spark.read.parquet(str(tmp_path / "minhash_dedup"))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(left).collect()}
    times = Counter(r["doc_id"] for r in kept["mix_sources"])
    assert all(abs(times[i] - t / n) <= 0.5 for i, (t, n) in taken.items() if n)
    tok = Tokenizer.from_file(tokenizer_path())
    length = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept["mix_sources"]}
    packed, room = Counter(), Counter()
    for r in kept["pack"]:
        packed[r["doc_id"]] += r["length"]
        room[r["sequence_id"]] += r["length"]
    assert packed == Counter({i: length[i] * n for i, n in times.items()}) and max(room.values()) <= 2048
