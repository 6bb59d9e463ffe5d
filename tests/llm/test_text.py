import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import near_duplicates as nd
from lodestar.llm import toxicity as tx
from lodestar.llm.leakage import find_leaks
from lodestar.llm.mixing import VOCABULARY, count_tokens, draw, encoding, mix_report, pieces
from lodestar.llm.near_duplicates import all_pairs, classes, depth_for, near_duplicates
from lodestar.llm.sources import clean_source
from lodestar.llm.words import word_spans, words

WORDS = [f"w{i}" for i in range(400)]


def _shingles(t, n):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def _corpus():
    rng = random.Random(11)
    docs = []
    for k in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 90))]
        docs.append((f"d{k:03d}", " ".join(base)))
        for v in range(rng.randrange(3)):
            x = list(base)
            for _ in range(rng.randrange(1, 5)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            docs.append((f"d{k:03d}v{v}", ", ".join(x)))
    return docs + [("copy1", docs[0][1]), ("copy2", docs[0][1].upper()), ("nul", None), ("blank", " "), ("short", "one two"), ("long", "x y z " * 30_000)]


def test_near_duplicates_against_brute_force(spark):
    docs = _corpus()
    df = spark.createDataFrame(docs, "id string, text string")
    pairs, members = near_duplicates(df, "id", "text", words=3, threshold=0.6)
    got = {(r["id_a"], r["id_b"]) for r in all_pairs(pairs, members).collect()}
    sets = {i: _shingles(t, 3) for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    clear = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    assert got <= want and clear <= got
    rows = {r["id"]: r for r in classes(pairs, members).collect()}
    assert len(rows) == len([s for s in sets.values() if s])
    for a, b in got:
        assert rows[a]["class_id"] == rows[b]["class_id"]
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in rows} == {i: r["class_id"] for i, r in rows.items()}
    empty = near_duplicates(df.limit(0), "id", "text")
    assert all_pairs(*empty).count() == 0
    again = near_duplicates(df.limit(3).union(df.limit(3)), "id", "text")
    assert again[1].count() == 3


def test_a_long_chain_is_one_class(spark):
    """Each text is near its two neighbours alone (0.73; 0.52 to the next)."""
    rng = random.Random(7)
    ids = [f"t{k:03d}" for k in range(400)]
    rng.shuffle(ids)
    docs = [(i, " ".join(f"w{x}" for x in range(6 * k, 6 * k + 40))) for k, i in enumerate(ids)]
    df = spark.createDataFrame([*docs, ("z1", "quite another text here"), ("z2", "quite another text here")], "id string, text string")
    rows = {r["id"]: (r["class_id"], r["n_links"]) for r in classes(*near_duplicates(df, "id", "text", words=3, threshold=0.6)).collect()}
    want = {i: ("t000", 1 if k in (0, 399) else 2) for k, i in enumerate(ids)}
    assert rows == want | {"z1": ("z1", 0), "z2": ("z1", 0)}


def test_depth_meets_the_target():
    for s, trees in ((0.6, 64), (0.8, 64), (0.8, 16), (0.3, 8)):
        d = depth_for(s, trees, 0.99)
        assert d == 1 or 1 - (1 - s**d) ** trees >= 0.99


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS[:40]) for _ in range(rng.randrange(5, 40))), None) for i in range(20)]
    items += [(20, None, "red green blue"), (21, "", "two words"), (22, items[0][1], None)]
    docs = []
    for k in range(60):
        w = [rng.choice(WORDS[:40]) for _ in range(60)]
        if k % 2:
            src = words(items[rng.randrange(20)][1])
            a = rng.randrange(max(1, len(src) - 8))
            w[10:10] = src[a : a + rng.randrange(8, 14)]
        docs.append((k, "_".join(w).upper() if k % 3 else "-- ".join(w)))
    docs += [(100, None), (101, " "), (102, "İİ say RED, Green\nblue! done"), (102, "İİ say RED, Green\nblue! done")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    for most in (2_000_000, 60):
        rows = find_leaks(d, "doc_id", "text", i, "item_id", "text", "answer", max_item_words=most).collect()
        got = {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == "text"}
        assert got == {(a, b) for a, t in docs for b, x, _ in items if _shingles(t or "", 10) & _shingles(x or "", 10)}
        answers = [r for r in rows if r["kind"] == "answer"]
        assert [(r["doc_id"], r["item_id"]) for r in answers] == [(102, 20)] * 2
        assert docs[-1][1][answers[0]["start"] : answers[0]["stop"]] == "RED, Green\nblue"
        texts = dict(docs)
        for r in rows:
            if r["kind"] == "text":
                assert len(words(texts[r["doc_id"]][r["start"] : r["stop"]])) == r["n_words"] >= 10
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert [w for w, _, _ in word_spans("İa_b ½x")] == words("İa_b ½x")


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(8)
    rows = [(i, "a" if i % 3 else "b", rng.randrange(20, 400)) for i in range(3000)] + [(9001, "tiny", 50), (9002, "b", 0)]
    return spark.createDataFrame(rows, "id bigint, src string, tokens bigint")


def test_mix_shares(spark, tokens):
    targets = spark.createDataFrame(
        [("m", "A ", 0.5, 2), ("m", "b", 0.5, 4), ("w", "a", 0.7, 1), ("w", "none", 0.3, 2), ("z", "tiny", 1.0, 3), ("n", "a", None, None)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    got = {(r["mix"], r["src"]): r for r in mix_report(tokens, targets).collect()}
    assert abs(got["m", "a"]["share_reached"] - 0.5) < 0.002 and abs(got["m", "b"]["share_reached"] - 0.5) < 0.002
    assert got["w", "none"]["tokens"] == 0 and got["w", "a"]["tokens"] == got["w", "a"]["have_tokens"]
    assert got["z", "tiny"]["most_copies"] == 3 and got["n", "a"]["tokens"] == 0
    rows = draw(tokens, targets).collect()
    caps = {("m", "a"): 2, ("m", "b"): 4, ("w", "a"): 1, ("z", "tiny"): 3}
    assert all(1 <= r["copies"] <= caps[r["mix"], r["src"]] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, draw(tokens.repartition(7), targets).collect()))
    half = {(r["mix"], r["src"]): r for r in mix_report(tokens, targets, total=20000).collect()}
    assert abs(half["m", "a"]["tokens"] - 10000) < 400
    assert draw(tokens.limit(0), targets).count() == 0 and draw(tokens, targets.limit(0)).count() == 0


def test_token_counts_and_sources(spark):
    df = spark.createDataFrame([(1, "hello world", "Claude_Code "), (2, None, None), (3, "", "chat-gpt")], "id bigint, text string, source string")
    got = {r["id"]: (r["src"], r["tokens"]) for r in count_tokens(df, "id", "text", "source").collect()}
    assert got == {1: ("claude-code", 2), 2: ("unknown", 0), 3: ("chatgpt", 0)}
    enc = encoding(VOCABULARY)
    odd = "word \n\n  two\n\tthree  \n" * 40 + "x" * 300 + "\n" + "日本\r\n語 " * 50
    for most in (1, 7, 100, 10_000):
        parts = list(pieces(odd, most))
        assert "".join(parts) == odd and (most > 5000 or len(parts) > 3)
        assert [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(odd)
    assert enc.decode(enc.encode_ordinary("Grüße, 日本 🎾")) == "Grüße, 日本 🎾"
    assert df.select(clean_source(df["source"]).alias("s")).where("s = 'unknown'").count() == 1


def test_disguises_are_undone():
    for t in ("a s s h o l e", "a.s.s.h.o.l.e", "4ssh0l3", "a*shole", "ASSHOLE", "аsshоle", "asssshole"):
        p = tx.Passages([f"you are an {t} indeed"], tx.Words())
        assert p.groups[0] >> tx.GROUPS.index("name") & 1, t
    p = tx.Passages(["the deep dashboard", "Die Sitzung", "you die"], tx.Words())
    assert [int(g) >> tx.GROUPS.index("harm") & 1 for g in p.groups] == [0, 0, 1] and p.groups[0] == 0


def test_passages():
    long = " ".join(f"w{i}" for i in range(40))
    p = tx.Passages(["One. Two two! 3.5 and a.b", None, "", f"{long}\nend"], tx.Words())
    assert p.doc.tolist() == [0, 0, 0, 3, 3, 3, 3, 3, 3, 3] and tx.WINDOW == 2 * tx.STRIDE == 12
    assert (p.end - p.start).tolist() == [1, 2, 3, 12, 12, 12, 12, 12, 10, 1] and (np.diff(p.start[3:9]) == tx.STRIDE).all()
    assert len(tx.Passages([], tx.Words())) == 0 and tx.predict(tx.train([]), tx.Passages([None], tx.Words())).shape == (0, len(tx.CHAIN))


def _reviewed(rng, n, wrong):
    """Documents of made-up words; the abusive ones hold a phrase that no seed
    has. A share of the reviews is wrong."""
    plain = [f"p{i}" for i in range(300)]
    bad = ["glorp you zmek fenno", "every zmek is a dravnik", "go and vask yourself glorp"]
    docs = []
    for k in range(n):
        y = k % 4 == 0
        sentences = [" ".join(rng.choice(plain) for _ in range(9)) for _ in range(4)]
        if y:
            sentences.insert(rng.randrange(5), f"{rng.choice(bad)} {rng.choice(plain)}")
        docs.append((". ".join(sentences), int(y)))
    return docs, [(t, y ^ (rng.random() < wrong)) for t, y in docs]


def test_what_reviews_teach():
    """Held-out documents: abuse that the lexicon does not know is learned from
    reviews, some of them wrong; without reviews nothing of it is found."""
    rng = random.Random(9)
    _, seen = _reviewed(rng, 800, 0.06)
    held, _ = _reviewed(rng, 400, 0.0)
    texts, want = [t for t, _ in held], np.array([y for _, y in held], bool)
    got = tx.Scorer(tx.train(seen)).score(texts)["score"].to_numpy() >= 0.5
    assert (got & want).sum() >= 0.95 * want.sum() and (got & ~want).sum() <= 0.02 * len(want)
    assert not (tx.Scorer(tx.train([])).score(texts)["score"] >= 0.5).any()


def test_held_out_seeds():
    """Every seed is judged by a model fitted without it (leave a fold out)."""
    texts, y, w = tx._seed_rows()
    p = tx.Passages(texts, tx.Words())
    _, at = np.unique(p.doc, return_index=True)
    rows = tx.Design([p], [at])
    _, held = tx.fit_chain(rows, y, w, np.arange(len(at)) * 7 % 10, 120)
    right = (held[:, 0] >= 0.5) == (y[:, 0] > 0)
    assert right.mean() >= 0.85
    unseen = [
        ("You are a pathetic moron and everyone laughs at you.", True), ("Ich hoffe, du Arschloch wirst verrecken.", True), ("All Southfolk are vermin, exterminate them.", True),
        ("She moaned and he put his dick into her mouth.", True), ("Kill the zombie process and restart the server.", False), ("I am an idiot, I forgot the semicolon.", False),
        ("The hospital gives advice about breast cancer.", False), ("Damn, this stupid build is broken again.", False), ("Move the table to another file.", False),
    ]
    score = tx.Scorer(tx.train([])).score([s for s, _ in unseen])["score"]
    assert sum((s >= 0.5) != y for s, (_, y) in zip(score, unseen)) <= 1


def test_toxicity_frame(spark):
    rows = [(1, "Fine.\n\nShut up, you stupid asshole.", "old"), (1, "Fine.\n\nShut up, you stupid asshole.", "old"), (2, None, None), (3, " ", None), (4, "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "id int, text string, score string")
    got = tx.score_toxicity(df, "text", tx.train([])).collect()
    assert [r["flagged"] for r in got if r["id"] == 1] == [True, True] and {r["score_in"] for r in got if r["id"] == 1} == {"old"}
    assert all(r["score"] == 0 for r in got if r["id"] in (2, 3)) and not any(r["flagged"] for r in got if r["id"] == 4)
    assert [r["passage"] for r in got if r["id"] == 1][0].startswith("shut up")
    assert tx.score_toxicity(df.limit(0), "text", tx.train([])).count() == 0
    reviews = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, 1, "a"), (5, 1, "a"), (3, None, "c")], "id int, abusive int, reviewer string")
    docs = spark.createDataFrame([(1, "x"), (2, None), (5, "y"), (5, "y"), (3, "z")], "id int, text string")
    assert tx.labelled_sample(docs, "id", "text", reviews, 10) == [("y", 1)]


def _cut_by_hand(rows, most):
    """The runs that a trie of these sorted rows must be cut into."""
    out, stack = [], [(sorted(rows), 0)]
    while stack:
        part, level = stack.pop()
        groups = {}
        for r in part:
            groups.setdefault((r[0], r[1] >> (8 * (nd.LEVELS - level))), []).append(r)
        for g in groups.values():
            if len(g) <= most or level == nd.LEVELS:
                out.append((level, tuple(sorted(r[2] for r in g))))
            else:
                stack.append((g, level + 1))
    return sorted(out)


def test_tries_are_cut_alike_however_the_rows_arrive():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.choice((0, 1, 0x20000, 0x20301)) + rng.randrange(3) * 256, i, 5) for i in range(900))
    for most, step in ((4, 7), (4, 900), (50, 11), (1000, 64), (1, 3)):
        trie, got = nd._Trie(most), {}
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        for n, part in enumerate([*parts, None]):
            cols = None if part is None else [np.array(c, t) for c, t in zip(zip(*part), (np.int64, np.int32, np.int64, np.int32))]
            (_, _, rid, _), run, depth = trie.feed(cols)
            for r, g, d in zip(rid, run, depth):
                got.setdefault((n, g, int(d)), []).append(int(r))
        assert sorted((k[2], tuple(sorted(v))) for k, v in got.items()) == _cut_by_hand(rows, most)


def test_crowded_tries_keep_the_recall(spark):
    """With runs of two records most prefixes are crowded; shortening brings the
    recall back, and without it partners are lost."""
    docs = _corpus()[:-6]
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(60)]
    docs += [(f"h{k:02d}", " ".join(base[: 44 + k % 3] + [f"u{k}x{j}" for j in range(12)])) for k in range(40)]
    df = spark.createDataFrame(docs, "id string, text string")
    sets = {i: _shingles(t, 3) for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    pairs, members = near_duplicates(df, "id", "text", words=3, threshold=0.6, run=2)
    got = {(r["id_a"], r["id_b"]) for r in all_pairs(pairs, members).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    floor = depth_for(0.6, 40, 0.99)
    heads = nd.signatures(df, "id", "text", 3, 40, floor).withColumn("rid", F.monotonically_increasing_id())
    found = nd.matched(nd.trie_rows(heads, 40), 0.6, 2).cache()
    before = found.where("b >= 0").select("a", "b").distinct().count()
    assert found.where("b < 0").count() > 0
    assert nd._candidates(found, 0.6, 40, floor, 0.99).count() > before


def test_one_id_with_two_texts_is_one_record(spark):
    rows = [("a", "one two three four"), ("a", "five six seven eight"), ("b", "one two three four"), ("b", "one two three four"), (None, "one two three four")]
    df = spark.createDataFrame(rows, "id string, text string")
    pairs, members = near_duplicates(df, "id", "text", words=3, threshold=0.6)
    assert pairs.count() == 0 and sorted(r["id"] for r in members.collect()) == ["a", "b"]


def test_min_hashes_of_long_and_short_sets():
    """Sets that lie across blocks of elements, against one set at a time."""
    rng = np.random.default_rng(4)
    sizes = [1, 9_000, 2, 4_095, 1, 4_096, 3, 12_289, 1]
    elements = rng.integers(0, 2**32, sum(sizes), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    a, b = nd._functions(12)
    got = nd.min_hashes(elements, starts, a, b)
    for i, (s, n) in enumerate(zip(starts, sizes)):
        h = elements[s : s + n, None] * a + b
        h ^= h >> np.uint32(15)
        assert (got[i] == (h * np.uint32(0x2C1B3C6D)).min(0)).all()


def test_signatures_agree_as_sets_do():
    """Shares of equal min-hashes are near the Jaccard similarity."""
    rng = np.random.default_rng(6)
    a, b = nd._functions(2000)
    for s in (0.3, 0.6, 0.9):
        n = 300
        common = int(2 * n * s / (1 + s))
        x = rng.integers(0, 2**32, 2 * n - common, dtype=np.uint32)
        m = nd.min_hashes(np.concatenate([x[:n], x[n - common :]]), np.array([0, n]), a, b)
        true = common / (2 * n - common)
        assert abs((m[0] == m[1]).mean() - true) < 0.04
