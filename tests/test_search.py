import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.functions import vectors as V
from tessera.operators import discovery, embed, files, fusion, lexical, vector
from tessera.plans.search import SearchEngine
from tessera.sources import results
from tessera.spec import SearchSpec


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "Retry. the retry_x loop"), (2, "retry retry here"), (3, "nothing"), (4, None), (5, "É é")], "chunk_id int, text string")
    got = {r["chunk_id"]: r["bm25"] for r in lexical.bm25_scores(docs, ["retry", "retry"]).collect()}
    idf, avg = math.log((4 - 2 + 0.5) / 2.5 + 1), (4 + 3 + 1 + 2) / 4
    want = {i: 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for i, tf, dl in ((1, 1, 4), (2, 2, 3))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert rows(lexical.bm25_scores(docs, ["é"]), "chunk_id") == [(5,)]
    assert lexical.bm25_scores(docs.where("false"), ["retry"]).collect() == []


def test_candidates(spark):
    chunks = spark.createDataFrame([(i, f"src/{'cache' if i % 7 == 0 else 'x'}/{i}", "cache me" if i % 5 == 0 else "other") for i in range(100)], "chunk_id bigint, file_path string, text string")
    got = [r["chunk_id"] for r in lexical.candidates(chunks, ["cache"], ["cache"], 10).collect()]
    assert sorted(got) == sorted([*range(0, 50, 5), 7, 14, 21, 28, 42])
    assert lexical.candidates(chunks, ["absent"], ["absent"], 10).count() == 100
    assert lexical.candidates(chunks, ["cache"], ["cache"], 100).count() == 100


def test_keyword_score(spark):
    df = spark.createDataFrame([("b.md", "Cache LIMIT cache", 17), ("a.md", "precached", 9), ("c.lock", "cache", 5), ("d.md", "", 0), ("e.md", "ÇACHE", 6), ("f", "cache", 2_000_001)], "path string, content string, length int")
    assert rows(files.score_files(df, ["cache", "limit", "cache"]), "path", "score", "file_rank") == [("a.md", 2, 1), ("b.md", 3, 0), ("c.lock", 2, 2), ("f", 2, 3)]
    assert rows(files.size_filter(files.extension_filter(df)), "path") == [("a.md",), ("b.md",), ("e.md",)]
    binary = spark.createDataFrame([("a", bytearray(b"\xff\xfe")), ("b", bytearray("é".encode()))], "path string, content binary")
    assert rows(files.utf8_filter(binary), "path", "content") == [("b", "é")]


def test_vectors(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.577, 0.577, 0.577]), (3, None)], "chunk_id int, embedding array<float>")
    assert [(r[0], round(r[1], 4)) for r in vector.cosine_topk(corpus, [0.577] * 3, 2).select("chunk_id", "score").collect()] == [(2, 0.9988), (0, 0.577)]
    assert vector.cosine_topk(corpus, [1.0, 0.0, 0.0], 10, 0.9).count() == 1
    signs = spark.createDataFrame([(0, [1.0, 1.0, -1.0, -1.0]), (1, [-1.0, -1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0, -1.0])], "chunk_id int, embedding array<float>")
    assert [tuple(r) for r in vector.hamming_topk(signs, [1, 1, -1, -1], 3).select("chunk_id", "score").collect()] == [(0, 1.0), (2, 0.96875), (1, 0.875)]
    words = spark.createDataFrame([([1.0, -1.0, 0.5, -0.5, 0.0, 1.0],), ([1.0] * 65,), ([],)], "e array<float>").select(V.sign_words(F.col("e"))).collect()
    assert [r[0] for r in words] == [[37], [-1, 1], []]
    assert spark.createDataFrame([([0.0, 0.0],)], "e array<float>").select(V.normalise(F.col("e"))).first()[0] == [0.0, 0.0]


def test_embeddings(spark):
    v = embed.hashed(["cache limit", "cache limit", "", None])
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[2].any() and not v[3].any()
    got = embed.embed(spark.createDataFrame([(1, "cache limit"), (2, None)], "id int, text string")).collect()
    assert len(got[0]["embedding"]) == 384 and np.allclose(got[0]["embedding"], v[0])
    hidden, mask = np.array([[[3.0, 0], [1, 0], [9, 9]]]), np.array([[1, 1, 0]])
    assert np.allclose(embed.pooled(hidden, mask), [[1, 0]]) and not embed.pooled(hidden, mask * 0).any()


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "chunk_id int, rank int")
    b = spark.createDataFrame([(2, 0), (1, 1), (3, 2)], "chunk_id int, rank int")
    got = fusion.reciprocal_rank_fusion(a, b, 10)
    assert [r["chunk_id"] for r in got.collect()] == [1, 2, 3]  # equal scores: the better lexical rank first
    assert abs(got.where("chunk_id = 3").first()["rrf"] - (1 / 65 + 1 / 62)) < 1e-12
    assert [r["chunk_id"] for r in fusion.reciprocal_rank_fusion(a.where("false"), b, 2).collect()] == [2, 1]


def _greedy(rows_):
    kept = {}
    out = []
    for rank, path, line, n in sorted(rows_):
        mine = kept.setdefault(path, [])
        if len(mine) < 2 and all(not (line < e and line + n > s) for s, e in mine):
            mine.append((line, line + n))
            out.append(rank)
    return out


def test_overlaps_are_dropped_greedily(spark):
    rnd = random.Random(1)
    for _ in range(4):
        data = [(i, rnd.choice("ab"), rnd.randint(1, 9), rnd.randint(1, 4)) for i in range(25)]
        df = spark.createDataFrame([(r, p, ln, "x\n" * n) for r, p, ln, n in data], "rank int, file_path string, line_number int, text string")
        assert sorted(r["rank"] for r in fusion.drop_overlaps(df).collect()) == _greedy(data)


def test_discovery(spark):
    df = spark.createDataFrame(
        [("a", "using X.Yard;\nusing (q = z);\nuse a::{Bcde};\r\nfrom pkg.mod import Thing as t\nimport {Abcd} from x\nimport java.util.List;\nuse nothing")], "path string, content string"
    )
    assert sorted(r["name"] for r in discovery.imports(df).collect()) == ["Bcde", "List;", "Thing", "Yard"]
    assert rows(discovery.type_names(spark.createDataFrame([("a", "FooBar fooBar FOOBAR Éclair Foo_Bar FooBar")], "path string, content string")), "name") == [("FooBar",), ("Foo_Bar",), ("Éclair",)]
    assert discovery.query_synonyms("race condition") == ["lock", "mutex", "semaphore", "atomic", "synchronize"]
    assert "lock" not in discovery.query_synonyms("race on a lock")
    commits = spark.createDataFrame([("1", "./a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "c"), ("2", "c"), ("3", "c")], "commit string, path string")
    assert rows(discovery.cochanges(commits, spark.createDataFrame([("a",)], "path string")), "path", "n") == [("b", 2)]


def test_whole_search(spark):
    docs = [(f"docs/{i}.md", f"# Note {i}\n\nThe cache has a limit of {i} entries and the window moves on.\n") for i in range(8)]
    docs += [("src/other.py", "def f():\n    return 'nothing to see here at all'\n"), ("src/memory_pool.py", "def grow(pool, amount):\n    return pool + amount\n"), ("x.png", "cache"), ("n.md", None)]
    df = spark.createDataFrame(docs, "path string, content string")
    for fast in (False, True):
        got = SearchEngine(spark).search(df, SearchSpec("cache limit", top=3, fast=fast)).orderBy("rank").collect()
        assert len(got) == 3 and all(r["file_path"].startswith("docs/") for r in got)
    found = SearchEngine(spark).search(df, SearchSpec("cache limit", top=20))
    assert "src/memory_pool.py" in {r["file_path"] for r in found.collect()}  # a synonym of cache in its name
    assert '"score"' in results.as_json(found).first()["json"]
    assert results.as_text(found, 0).count("docs/") == 8
    none = SearchEngine(spark).search(df, SearchSpec("zzzzzz"))
    assert none.collect() == [] and results.as_json(none).collect() == []
    assert SearchEngine(spark).search(df.where("false"), SearchSpec("cache")).collect() == []


@pytest.mark.parametrize("signs", [False, True])
def test_query_set(spark, signs, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 70)).round(1)
    v[7] = v[3]  # a tie
    df = spark.createDataFrame([*((i, [float(x) for x in row], "other") for i, row in enumerate(v)), (60, None, "x"), (None, [0.5] * 70, "y")], "chunk_id bigint, embedding array<float>, query string")
    v = v.astype(np.float32).astype(np.float64)

    def nearest(q):
        s = 1 - 2 * ((v > 0) != (v[q] > 0)).sum(1) / 128 if signs else np.round(v @ v[q], 12)
        return sorted(range(60), key=lambda i: (-s[i], i))[:4]

    asked = df.where("chunk_id % 10 = 3")
    want = sorted((q, i, r) for q in range(3, 60, 10) for r, i in enumerate(nearest(q)))
    assert rows(vector.query_set_topk(df, asked, 4, signs), "query", "key", "rank") == sorted(want, key=repr)
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 2000)  # more than one block
    assert rows(vector.query_set_topk(df, asked, 4, signs), "query", "key", "rank") == sorted(want, key=repr)
    assert vector.query_set_topk(df, df.where("false"), 4, signs).collect() == [] and vector.query_set_topk(df.where("false"), asked, 4, signs).collect() == []


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(tag, value):
    """A field of a protocol buffer: a number, or bytes or text by length."""
    if isinstance(value, int):
        return _varint(tag << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(tag << 3 | 2) + _varint(len(value)) + value


def _lookup_model(table):
    """The bytes of an ONNX model that looks input_ids up in a table: last_hidden_state (batch, tokens, dimension)."""
    named = lambda name, kind, dims: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, d)) for d in dims))))
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "last_hidden_state") + _field(4, "Gather")
    tensor = b"".join(_field(1, d) for d in table.shape) + _field(2, 1) + _field(8, "table") + _field(9, table.astype("<f4").tobytes())
    graph = _field(1, node) + _field(2, "g") + _field(5, tensor) + _field(11, named("input_ids", 7, ("b", "t"))) + _field(12, named("last_hidden_state", 1, ("b", "t", "d")))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_model_of_a_folder(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["[PAD]", "[UNK]", "red", "blue", "green"]
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, "[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    table = np.array([[9, 9, 9], [0, 0, 1], [1, 0, 0], [0, 2, 0], [3, 4, 0]], np.float32)
    (tmp_path / "model.onnx").write_bytes(_lookup_model(table))
    df = spark.createDataFrame([(1, "red"), (2, "red blue"), (3, "green what"), (4, None), (5, "")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, model_dir=str(tmp_path)).collect()}
    unit = lambda v: [float(x) for x in np.array(v) / np.linalg.norm(v)]
    assert np.allclose(got[1], unit([1, 0, 0])) and np.allclose(got[2], unit([1, 2, 0])) and np.allclose(got[3], unit([3, 4, 1]), atol=1e-6)
    assert got[4] == got[5] == [0.0, 0.0, 0.0]
    assert np.allclose(embed.embed_query("red blue", str(tmp_path)), got[2])
