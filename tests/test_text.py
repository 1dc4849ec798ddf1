import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import sync
from tessera.sources import git
from tessera.spec import SearchSpec, candidate_budget, query_terms, valid_query

import pytest


def one(spark, expr, **values):
    return spark.range(1).select(expr(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first()["x"]


def test_budget():
    assert [candidate_budget(*a) for a in ((2, 10), (4, 10), (5, 10), (5, 100), (1, 1))] == [30, 50, 80, 150, 30]


def test_query():
    assert query_terms("Retry, retry é a été", ("Foo Bar", "retry")) == ["retry", "retry", "é", "été", "foo bar"]
    assert not valid_query("a b") and not valid_query("") and valid_query("é")
    with pytest.raises(ValueError):
        SearchSpec("a b")
    with pytest.raises(ValueError):
        SearchSpec("abc", literals=("",))


def test_slug_and_yaml(spark):
    assert one(spark, lambda t: T.slugify(t), t="Fix login timeout!") == "fix-login-timeout"
    assert one(spark, lambda t: T.slugify(t), t="é ü") == ""
    assert len(one(spark, lambda t: T.slugify(t), t="a" * 60)) == 50
    assert one(spark, lambda t: T.escape_yaml(t), t='a "b" \\c') == 'a \\"b\\" \\\\c'


def test_shorten_path(spark):
    f = lambda p: one(spark, lambda t: T.shorten_path(t), t=p)
    assert f("C:\\u\\sources\\github\\o\\r\\issues\\42-fix.md") == "github:o/r#42-fix"
    assert f("/x/sources/github/o/r/prs/7-a.md") == "github:o/r PR#7-a"
    assert f("/x/sources/github/o/r") == "/x/sources/github/o/r"


def test_preview(spark):
    text = "x" * 121 + "\nb\nc\nd\n"
    assert one(spark, lambda t: T.preview(t, 0), t=text) == "x" * 117 + "...\nb\nc\n... (1 more lines)"
    assert one(spark, lambda t: T.preview(t, 2), t="a\nb") == "a\nb"


def test_remotes(spark):
    for url, want in (("git@github.com:o/r.git", ("o", "r")), ("https://github.com/o/r", ("o", "r")), ("ssh://git@github.com/o/r.git", ("o", "r")), ("https://forge.example/o/r", None), ("https://github.com/o/r.git/", ("o", "r.git"))):
        got = one(spark, lambda t: T.remote_repo(t), t=url)
        assert (tuple(got) if got else None) == want == git.owner_and_repo(url)
    assert git.repo_argument("a/b/c") == ("a", "b/c")
    assert git.remote_of("up\thttps://github.com/x/y (fetch)\norigin\tgit@github.com:o/r.git (fetch)") == ("o", "r")


def test_stem_and_extension(spark):
    f = lambda p: (one(spark, lambda t: T.file_stem(t), t=p), one(spark, lambda t: T.extension(t), t=p))
    assert f("a/b.c/d.min.js") == ("d.min", "js") and f("a/.bashrc") == (".bashrc", "") and f("a/Makefile") == ("Makefile", "")


def test_line_of_offset(spark):
    assert one(spark, lambda t: T.line_of_offset(t, F.lit(5)), t="é\nb\nc\n") == 3


def _bytes_model(text, term):
    data, t, word = text.encode(), term.encode(), re.compile(rb"[A-Za-z0-9_]")
    low, n = data.lower(), 0
    for i in range(len(data) - len(t) + 1):
        if low[i : i + len(t)] == t and not (i and word.match(data[i - 1 : i])) and not word.match(data[i + len(t) : i + len(t) + 1] or b" "):
            n += 1
    return n


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abé_ .AB1", max_size=30), min_size=5, max_size=20), st.sampled_from(["a", "ab", "b_", "é", "aé"]))
def test_term_frequency_is_the_byte_scan(spark, texts, term):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.term_frequency(F.col("t"), term).alias("n"))
    assert all(r["n"] == _bytes_model(r["t"], term) for r in df.collect())


def test_words_keep_two_bytes(spark):
    assert one(spark, lambda t: T.words(t), t="Ä b cd_1 टिप्पणी") == ["ä", "cd_1", "टिप", "पणी"]


def test_effective_since():
    assert sync.effective_since("w") == "w" == sync.effective_since("w", "last")
    assert sync.effective_since("w", "2024") == "2024" and sync.effective_since("w", "2024", True) is None
