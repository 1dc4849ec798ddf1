"""Ranking, terms, copies, leaks and mixing."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tessera.llm import hashing as H
from tessera.llm.distinctive import distinctive_terms, log_gamma, log_upper_tail
from tessera.llm.handwritten import copied_files, not_handwritten
from tessera.llm.leaks import leaked_passages, words
from tessera.llm.mixing import mixture
from tessera.llm.rankwalk import DAMPING, ROUNDS, lists_of, rank_walk


def test_token_hashes():
    data = b"Abc abc  ABC x_1 \xc3\xa9 abcd"
    starts, ends, h = H.tokens(np.frombuffer(data, np.uint8), H.byte_table(H.WORD))
    assert [data[s:e] for s, e in zip(starts, ends)] == [b"Abc", b"abc", b"ABC", b"x_1", b"abcd"]
    assert h[0] == h[1] == h[2] and len({int(x) for x in h}) == 3
    again = H.tokens(np.frombuffer(b"....." + data, np.uint8), H.byte_table(H.WORD))[2]
    assert (again == h).all()  # wherever a token stands


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=20, max_size=60), st.lists(st.integers(0, 5), min_size=0, max_size=30), st.integers(0, 20))
def test_winnowing_keeps_every_shared_span(a, b, at):
    k, w = 3, 4
    shared = a[:6]  # k + w - 1
    b = b[:at] + shared + b[at:]
    h = lambda x: H.mix(np.array(x, np.uint64))
    prints = []
    for x in (a, b):
        g = H.kgrams(h(x), np.zeros(len(x), np.int64), k)
        prints.append({int(v) for v in g[H.winnow(g, w)]})
    assert prints[0] & prints[1]


def test_string_buffers():
    data, at = H.string_buffers(pa.array(["ab", None, "", "é"]).slice(1))
    assert bytes(data[at[0] : at[-1]]).decode() == "é" and list(np.diff(at)) == [0, 0, 2]


def test_log_gamma_and_tail():
    x = np.array([1, 2, 3.5, 10, 1e3, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    for k, n, K, N in ((2, 5, 4, 20), (0, 5, 4, 20), (4, 5, 4, 20), (5, 5, 4, 20), (3, 9, 9, 12), (1, 12, 1, 12)):
        want = sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, min(n, K) + 1) if N - K >= n - i) / math.comb(N, n)
        got = math.exp(log_upper_tail(np.array([k]), np.array([n]), np.array([K]), np.array([N]))[0])
        assert abs(got - want) < 1e-12


def test_terms(spark):
    docs = [(1, "Common common_x Zebras zebras ZEBRAS common", 0), (2, "common zebras other", 0), (3, "common 1common éothers", 0), (4, None, 0), (5, "", 0), (None, "common", 0), (2, "common zebras other", 0)]
    df = spark.createDataFrame(docs, "chunk_id bigint, text string, h int").repartition(3)
    got = distinctive_terms(df)
    table = {}
    for r in got.collect():
        table.setdefault((r["chunk_id"], r["term"]), []).append(r)
    assert table[1, "zebras"][0]["tf"] == 3 and table[1, "zebras"][0]["df"] == 3 and table[1, "zebras"][0]["cf"] == 5
    assert len(table[2, "common"]) == 2 and table[2, "common"][0]["df"] == 5 and (3, "others") in table and (3, "1common") not in table
    n, total = 6, 13  # terms of the record, of all records
    tail = lambda k, K: sum(math.comb(K, i) * math.comb(total - K, n - i) for i in range(k, min(n, K) + 1) if total - K >= n - i) / math.comb(total, n)
    assert abs(table[1, "zebras"][0]["p_value"] - tail(3, 5)) < 1e-9
    assert table[1, "zebras"][0]["score"] > table[1, "common"][0]["score"] >= 0
    assert rows(distinctive_terms(df, min_count=3, min_df=2, max_df=3), "chunk_id", "term") == [(1, "zebras")]
    assert distinctive_terms(df.where("false")).collect() == []


def test_heavy_terms_score_as_light_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, "frequent " * (i % 3 + 1) + f"single{i} rareword{i % 5}") for i in range(60)], "chunk_id int, text string")
    want = {(r["chunk_id"], r["term"]): (r["df"], round(r["score"], 9)) for r in distinctive_terms(df).collect()}
    monkeypatch.setattr("tessera.llm.distinctive.HEAVY", 1)
    assert want == {(r["chunk_id"], r["term"]): (r["df"], round(r["score"], 9)) for r in distinctive_terms(df).collect()}


def test_not_handwritten(spark):
    hand = "def f(x):\n    return x + 1\n"
    minified = "".join(f"function a{i}(b){{return c{i}.d(b)||{i}}}" for i in range(20))
    table = "T = [\n" + "\n".join(", ".join(hex(i * j % 256) for j in range(12)) + "," for i in range(20)) + "\n]"
    words_ = ["alpha", "beta", "gamma", "delta", "sigma", "kappa", "omega"]
    rnd = random.Random(3)
    copied = "\n".join(f"{rnd.choice(words_)}{rnd.randrange(99)} = {rnd.choice(words_)}({rnd.randrange(999)})" for _ in range(200))
    data = [
        ("r1/vendor/x/a.py", hand), ("r1/a_pb2.py", hand), ("r1/web/a.min.js", hand), ("r1/vendor_portal/a.py", hand), ("r1/generated_report.py", hand), ("r1/minify_x.py", hand),
        ("r1/g1.py", "# Code generated by x. DO NOT EDIT.\n" + hand), ("r1/g2.ts", "/*\n * This\u00a0file was automatically generated from x; changes will be lost.\n */"), ("r1/g3.rs", "// Diese Datei wurde automatisch erzeugt."),
        ("r1/h1.py", '# writes the line "Code generated by x. DO NOT EDIT." into each output file\n' + hand), ("r1/h2.py", "# Hand-maintained; the files it writes are generated.\n" + hand), ("r1/v1.go", "// Vendored from x v1; see upstream for history."),
        ("r1/m.js", minified), ("r1/d.rs", table), ("r1/small.rs", "P = [2, 3, 5]  // primes\n"), ("r1/pattern.py", 'P = "(' + "|".join(f"some-word-{i}" for i in range(60)) + ')"'), ("r1/b64.py", 'X = "' + "Ab9x" * 60 + '"'),
        ("r1/doc.md", "# Code generated by nobody is what this text is about"), ("r1/null.py", None), (None, minified), ("r1/empty.py", ""),
        ("r1/c.py", copied), ("r2/lib/c2.py", "[r2/lib/c2.py] " + copied.replace("\n", "\n  ")), ("r3/z/c3.py", copied), ("r1/own.py", copied.replace("alpha", "own").replace("1", "7").replace("beta", "mine").replace("sigma", "our")),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(data)], "fp int, file_path string, text string")
    got = {r["file_path"]: r["kinds"] for r in not_handwritten(df.unionByName(df)).collect()}
    assert {p: k[0] for p, k in got.items()} == {
        "r1/vendor/x/a.py": "vendored", "r1/a_pb2.py": "generated", "r1/web/a.min.js": "minified", "r1/g1.py": "generated", "r1/g2.ts": "generated", "r1/g3.rs": "generated", "r1/v1.go": "vendored", "r1/m.js": "minified", "r1/d.rs": "data",
        "r1/b64.py": "data", "r1/c.py": "copied", "r2/lib/c2.py": "copied", "r3/z/c3.py": "copied",
    }
    assert copied_files(df, min_repos=4).collect() == [] and not_handwritten(df.where("false")).collect() == []


def test_terms_of_any_length_and_script(spark):
    df = spark.createDataFrame([(1, "Ab x1 _y 7z Привет, мир_2 हिन्दी。日本語「語」 ab\u00a0Straße ４x"), (2, "ab other"), (3, None)], "chunk_id int, text string")
    got = rows(distinctive_terms(df, min_length=1, unicode=True), "chunk_id", "term", "tf")
    assert got == sorted([(1, t, 2 if t == "ab" else 1) for t in "ab x1 привет мир_2 हिन्दी 日本語 語 straße".split()] + [(2, "ab", 1), (2, "other", 1)], key=repr)
    assert rows(distinctive_terms(df, unicode=True), "term") == sorted([("привет",), ("हिन्दी",), ("straße",)], key=repr)


def test_bulk_data_wherever_it_begins(spark):
    hand, run = "def f(x):\n    return x + 1\n", "Ab9x" * 60
    data = {
        "r/url.css": f"a {{ src: url(data:font/woff2;base64,{run}) }}", "r/block.yaml": f"key: |\n    {run}\n", "r/assign.properties": f"blob={run}",
        "r/words.py": "W = [" + ", ".join(f'"word{chr(97 + i % 26)}{chr(97 + i // 26)}"' for i in range(90)) + "]", "r/hex.c": "t[] = {" + ", ".join(f"0x{i % 16:X}F" for i in range(90)) + "};", "r/floats.c": "t[] = {" + ", ".join(f"{i}.5f" for i in range(90)) + "};",
    }
    plain = {"r/hand.py": hand * 40, "r/ruler.py": "    # " + "=" * 200 + "\n" + hand, "r/few.py": 'W = ["a", "b", "c"]\n' + hand}
    df = spark.createDataFrame([*data.items(), *plain.items()], "file_path string, text string")
    assert rows(not_handwritten(df), "file_path", "kinds") == sorted((p, ["data"]) for p in data)


S, D = "query_id bigint, scorer string, chunk_id bigint, score double, rank int", "query_id bigint, engine string, chunk_id bigint, score float, extra int"


def _brute(lists):
    """lists: name -> {chunk: score}, of one query."""
    items = sorted({c for x in lists.values() for c in x})
    p = np.zeros((len(items), len(items)))
    for i, c in enumerate(items):
        for x in lists.values():
            up = [d for d in x if c not in x or x[d] >= x[c]]
            for d in up:
                p[i, items.index(d)] += 1 / (len(lists) * len(up))
    v = np.full(len(items), 1 / len(items))
    for _ in range(ROUNDS):
        v = (1 - DAMPING) / len(items) + DAMPING * v @ p
    return dict(zip(items, v))


def _random_lists(spark, n_queries=6, seed=0):
    rnd = random.Random(seed)
    s, d, brute = [], [], {}
    for q in range(n_queries):
        for name in ("a", "b", None):
            scale = 10 ** rnd.randint(-3, 6)
            for c in rnd.sample(range(30), rnd.randint(1, 15)):
                v = rnd.choice([rnd.random(), 0.5]) * scale
                s += [(q, name, c, v, None), (q, name, c, v / 2, 0)]
                brute.setdefault(q, {}).setdefault(("s", name), {})[c] = v
            s.append((q, name, 99, float("nan"), None))
            s.append((q, name, 98, None, None))
        for c in rnd.sample(range(30), 4):
            d.append((q, "a", c, 0.25 * c, 1))
            brute[q].setdefault(("d", "a"), {})[c] = 0.25 * c
    s.append((50, "a", 1, float("nan"), 0))
    return lists_of(spark.createDataFrame(s, S), spark.createDataFrame(d, D)), brute


def test_rank_walk(spark):
    lists, brute = _random_lists(spark)
    got = {(r["query_id"], r["chunk_id"]): r for r in rank_walk(lists).collect()}
    assert set(got) == {(q, c) for q, x in brute.items() for y in x.values() for c in y}
    for q, x in brute.items():
        want = _brute(x)
        order = sorted({round(v, 10) for v in want.values()}, reverse=True)
        for c, v in want.items():
            r = got[q, c]
            assert abs(r["stationarity"] - v) < 1e-9 and r["query_lists"] == len(x)
            assert r["n_lists"] == sum(c in y for y in x.values())
            assert r["worst_higher"] == max(sum(o > y[c] for o in y.values()) for y in x.values() if c in y)
            assert r["position"] == 1 + sum(round(o, 10) > round(v, 10) for o in want.values()) and order
    assert rank_walk(lists.where("false")).collect() == []


def test_large_queries_are_ranked_alike(spark):
    lists, _ = _random_lists(spark, 2, 7)
    key = ("query_id", "chunk_id", "position", "n_lists", "query_lists", "worst_higher")
    want = rank_walk(lists, rounds=4)
    got = rank_walk(lists, rounds=4, max_group=30, batch=5)
    assert rows(got, *key) == rows(want, *key)


def test_scale_does_not_matter(spark):
    lists, _ = _random_lists(spark, 3, 9)
    other = lists.selectExpr("query_id", "list", "chunk_id", "case when list like 'search:a' then score * 1e6 + 5 else score end as score")
    assert rows(rank_walk(lists), "query_id", "chunk_id", "position") == rows(rank_walk(other), "query_id", "chunk_id", "position")


def _longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_leaks(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40)))) for i in range(12)] + [(100, None), (101, ""), (3, "w1 w2")]
    docs = []
    for i in range(60):
        t = [rnd.choice(vocab) for _ in range(30)]
        j = rnd.randrange(12)
        part = items[j][1].split()
        n = rnd.randint(8, 20)
        t[5:5] = part[:n]
        docs.append((i, rnd.choice([" ", ", ", "_", "\n"]).join(t).upper(), 1))
    docs += [(200, None, 1), (201, "", 1), (0, docs[0][1], 1)]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string, fp int"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for d, t, _ in docs:
        for i, p in items:
            n = _longest(words(t), words(p)) if t and p else 0
            if n >= 13:
                want[d, i] = max(n, want.get((d, i), 0))
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leaked_passages(df, ev).collect()}
    assert got == want and want
    assert leaked_passages(df.where("false"), ev).collect() == [] == leaked_passages(df, ev.where("false")).collect()


def test_words():
    assert words("Ab_c-9é İx ²") == ["ab", "c", "9é", *"i̇x".split(), "²"] and words(None) == []


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("lorem ipsum dolor sit amet".split()) for _ in range(rnd.randint(5, 60))) + f" {i}", s) for i, s in enumerate(rnd.choice(["big", "Big ", "mid", "small-one", "SMALL_ONE", None, "odd"]) for _ in range(300))]
    docs += [(1000, docs[0][1], "mid"), (1001, None, "big"), (1002, " \n", "big")]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small_one", 0.2, 4), ("absent", 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture(spark, mixed):
    docs, targets = mixed
    draws, shares = mixture(docs, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"big", "mid", "small_one", "absent", None, "odd"} and s[None]["tokens"] == s["odd"]["tokens"] == s["absent"]["tokens"] == 0
    for name, share in (("big", 0.5), ("mid", 0.3), ("small_one", 0.2)):
        assert abs(s[name]["actual_share"] - share) < 0.02, (name, s[name])
    uses = [(r["doc_id"], r["repeat"], r["source"]) for r in draws.collect()]
    assert len(uses) == len(set(uses)) and all(n < {"big": 1, "mid": 2, "small_one": 4}[src] for _, n, src in uses)
    assert 1000 not in {u[0] for u in uses}  # a copy of document 0
    again, _ = mixture(docs.repartition(7), targets, bucket_rows=10)
    assert sorted(uses) == sorted((r["doc_id"], r["repeat"], r["source"]) for r in again.collect())
    other, _ = mixture(docs, targets, seed=1)
    assert sorted(uses) != sorted((r["doc_id"], r["repeat"], r["source"]) for r in other.collect())


def test_budgets(spark, mixed):
    docs, targets = mixed
    _, shares = mixture(docs, targets, budget=500)
    assert 0 < sum(r["tokens"] for r in shares.collect()) <= 500
    draws, shares = mixture(docs, targets, budget=10**9)  # every source runs dry
    s = {r["source"]: r for r in shares.collect()}
    assert all(s[n]["tokens"] == s[n]["available_tokens"] * r for n, r in (("big", 1), ("mid", 2), ("small_one", 4)))
    assert mixture(docs.where("false"), targets)[0].collect() == [] == mixture(docs, targets.where("false"))[0].collect()


def test_leaks_count_words_of_all_runs(spark, monkeypatch):
    from tessera.llm import leaks

    run = lambda a, n: [f"t{a}x{i}" for i in range(n)]
    one, two = run(1, 20), run(2, 13)
    items = spark.createDataFrame([(1, " ".join([*one, "and", *two])), (2, "same " * 40), (3, " ".join(run(3, 30)))], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [
            (1, " ".join(["a", "b", *one, "other", *two, "c"])),  # two runs of one item
            (2, " ".join([*two[:12], "no"])),  # too short
            (3, "same " * 5000),  # hits in proportion to the text
            (4, " ".join([*one, *one])),
            (4, " ".join(two)),  # another text under the same id has fewer
        ],
        "doc_id bigint, text string",
    )
    want = [(1, 1, 33, 2), (3, 2, 5000, 0), (4, 1, 40, 0)]
    assert rows(leaked_passages(docs, items), "doc_id", "item_id", "n_words", "first_word") == want
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)  # the item side is shuffled
    monkeypatch.setattr(leaks, "FILTER_BITS", 10)  # and the filter lets much through
    assert rows(leaked_passages(docs, items), "doc_id", "item_id", "n_words", "first_word") == want


def test_texts_of_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "x " * 50)], "doc_id bigint, text string")
    plan = leaked_passages(docs, docs.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Join" not in below[below.rindex("MapInArrow") :]


@pytest.mark.parametrize("heavy", [1, 3, 10**6])
def test_frequent_terms_are_as_rare_ones(spark, monkeypatch, heavy):
    from tessera.llm import distinctive

    rnd = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()[: 2 + i % 6]) for _ in range(12))) for i in range(30)], "chunk_id bigint, text string")
    columns = ("chunk_id", "term", "tf", "df", "cf")
    monkeypatch.setattr(distinctive, "HEAVY", 10)
    want = {tuple(r[c] for c in columns): r["score"] for r in distinctive_terms(df, min_length=1).collect()}
    few = rows(distinctive_terms(df, min_length=1, min_df=2, max_df=20, min_count=2), *columns)
    monkeypatch.setattr(distinctive, "HEAVY", heavy)
    got = {tuple(r[c] for c in columns): r["score"] for r in distinctive_terms(df, min_length=1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert rows(distinctive_terms(df, min_length=1, min_df=2, max_df=20, min_count=2), *columns) == few and few


@pytest.mark.parametrize("heavy", [1, 10**6])
def test_copies_by_few_fingerprints(spark, monkeypatch, heavy):
    from tessera.llm import handwritten

    monkeypatch.setattr(handwritten, "HEAVY", heavy)
    small = "a = b + c; d = e(f, g); h = i; j = k; l = m; n = o; p = q; r = s"
    local = " ".join(f"own{i} = {i}" for i in range(30))  # often, but in one repository
    data = [*((f"r{i}/s.py", small) for i in range(3)), *((f"r1/l{i}.py", local) for i in range(9)), ("r2/x.py", "a = 1")]
    df = spark.createDataFrame(data, "file_path string, text string")
    want = {r["file_path"] for r in not_handwritten(df).collect()}
    assert want == {f"r{i}/s.py" for i in range(3)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=14), min_size=1, max_size=5), st.integers(2, 3), st.integers(1, 6))
def test_winnowing_knows_no_neighbours(texts, k, w):
    h = lambda x: H.mix(np.array(x, np.uint64))
    rows_ = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    g = H.kgrams(h([x for t in texts for x in t]), rows_, k)
    first = np.cumsum([0, *map(len, texts)])
    want = []
    for i, t in enumerate(texts):
        one = H.kgrams(h(t), np.zeros(len(t), np.int64), k).tolist()
        spans = [(0, len(one))] if 0 < len(one) < w else [(a, a + w) for a in range(len(one) - w + 1)]
        want += sorted({int(first[i]) + min(range(a, b), key=lambda j: (one[j], j)) for a, b in spans})
    assert H.winnow(g, w).tolist() == want
