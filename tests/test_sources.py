import json
import os

import pytest

from tests.conftest import rows
from tessera import cli
from tessera.operators import sync
from tessera.sources import files, git, issues


def make(root, **texts):
    for name, text in texts.items():
        at = os.path.join(root, name.replace("__", "/").replace("_d_", "."))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_ignore_rules(tmp_path):
    root = str(tmp_path)
    make(root, **{".gitignore": "*.log\n/build\nout/\n!keep.log\n# note\n", "a.py": "x", "b.log": "x", "keep.log": "x", "build/x": "x", "sub/build/y": "x", "sub/out/z": "x", ".h": "x", ".searchignore": "secret*\n", "secret.txt": "x", "sub/.gitignore": "a.*\n", "sub/a.c": "x"})
    names = lambda **k: [os.path.relpath(p, root) for p in files.list_files(root, **k)]
    assert names() == ["a.py", "keep.log", "sub/build/y"]
    assert names(gitignore=False) == ["a.py", "b.log", "build/x", "keep.log", "sub/a.c", "sub/build/y", "sub/out/z"]
    assert ".h" in names(hidden=True)
    with pytest.raises(FileNotFoundError):
        files.list_files(root + "/none")


def test_read_files(spark, tmp_path):
    root = str(tmp_path)
    make(root, **{"a.py": "hello", "b.bin": b"\xff\xfe\x00", "c.png": "x", "empty.md": "", "d/e.md": "é"})
    got = files.read_files(spark, [root, root + "/d"])
    assert rows(got, "path", "content") == [(f"{root}/a.py", "hello"), (f"{root}/d/e.md", "é")]
    assert rows(files.read_files(spark, [root], glob="*.md"), "content") == [("é",)]
    assert rows(files.read_tree(spark, root), "content") == [("hello",), ("é",)]


def test_log():
    h1, h2 = "a" * 40, "b" * 40
    log = f"{h1}\n\nx.py\ny.py\n{h2}\n\nx.py\n"
    assert git.parse_log(log) == [(h1, "x.py"), (h1, "y.py"), (h2, "x.py")]
    assert git.parse_log(log, strict=True) == [(h1, "x.py"), (h1, "y.py")]


ITEMS = [
    {"number": 42, "title": 'Fix "login" timeout!', "body": " It hangs. ", "state": "open", "user": {"login": "alice"}, "assignees": [], "labels": [{"name": "bug"}, {"name": "auth"}], "created_at": "2026-04-10T01:22:33Z", "updated_at": "2026-04-12T04:10:20Z", "html_url": "https://x/42"},
    {"number": 7, "title": "A change", "body": None, "state": "closed", "user": {"login": "bob"}, "created_at": "2026-04-01T00:00:00Z", "updated_at": "2026-04-02T00:00:00Z", "html_url": "https://x/7", "pull_request": {"html_url": "https://x/7"}},
]
COMMENTS = [{"number": 42, "user": {"login": "bob"}, "body": "Can confirm in staging.", "created_at": "2026-04-10T03:15:00Z"}, {"number": 7, "user": {"login": "x"}, "body": "unseen", "created_at": "2026-04-10T03:15:00Z"}]
WANT = """---
type: issue
number: 42
title: "Fix \\"login\\" timeout!"
state: open
author: alice
labels: [bug, auth]
created: 2026-04-10T01:22:33Z
updated: 2026-04-12T04:10:20Z
url: https://x/42
---

# Issue #42: Fix "login" timeout!

It hangs.

---

## Comments

### @bob (2026-04-10T03:15:00Z)

Can confirm in staging.

"""


def test_sync(spark, tmp_path):
    dump, out = str(tmp_path / "dump"), str(tmp_path / "out")
    os.makedirs(dump)
    for name, data in (("issues", ITEMS), ("comments", COMMENTS)):
        with open(f"{dump}/{name}.json", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in data)
    read = issues.read_issues(spark, f"{dump}/issues.json")
    assert rows(sync.label_filter(read, ["bug", "auth"]), "number") == [(42,)] and rows(sync.kind_filter(read, "prs"), "number") == [(7,)]
    assert rows(sync.since_filter(read, "2026-04-12T04:10:20Z"), "number") == [(42,)]
    with pytest.raises(ValueError):
        sync.kinds_of("wiki")
    made = sync.rendered(read, issues.read_comments(spark, f"{dump}/comments.json"), ["number"])
    by = {r["number"]: r for r in made.collect()}
    assert by[42]["markdown"] == WANT and by[42]["path"] == "issues/42-fix-login-timeout.md" and "Comments" not in by[7]["markdown"] and "# PR #7: A change" in by[7]["markdown"]
    assert cli.main(["sync", dump, out, "--repo", "o/r", "--state", "all"]) == 0
    with open(f"{out}/issues/42-fix-login-timeout.md") as f:
        assert f.read() == WANT
    assert issues.read_state(out) == {"last_sync": "2026-04-12T04:10:20Z", "repo": "o/r", "include": ["issues", "prs"], "item_count": 2}
    with open(f"{out}/manifest.json") as f:
        assert [e["number"] for e in json.load(f)["files"]] == [7, 42]
    assert cli.main(["sync", dump, out, "--repo", "o/r"]) == 0  # from the watermark on, inclusive
    assert issues.read_state(out)["item_count"] == 1
    with open(f"{out}/.meta/sync-state.json", "w") as f:
        f.write("broken")
    assert issues.read_state(out) is None


def test_search_command(spark, tmp_path, capsys, monkeypatch):
    root = str(tmp_path)
    make(root, **{"a.md": "The cache limit is reached when the window moves on.", "b.py": "def f():\n    return 'nothing of interest in here'\n", "c.min": "cache"})
    monkeypatch.chdir(root)
    assert cli.main(["cache limit", root, "-k", "3"]) == 0
    out = capsys.readouterr().out
    assert "a.md:1" in out and "c.min" not in out
    assert cli.main(["cache limit", root, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["file_path"].endswith("a.md")
    assert cli.main(["x", root]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["cache", root + "/none"]) == 1


def test_synced_files_are_included(spark):
    mine, synced = spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("/d/sources/github/o/r/issues/1-x.md",), ("/d/sources/github/o/r/issues/sub/2.md",)], "path string")
    assert rows(files.with_synced(mine, synced, ["."]), "path") == [("/d/sources/github/o/r/issues/1-x.md",), ("a",)]
    assert files.with_synced(mine, synced, ["."], glob="*.md").count() == 1 == files.with_synced(mine, synced, ["/d/sources/github/o/r"]).count()


def test_rules_from_above(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("*.tmp\n")
    repo = tmp_path / "outer" / "repo"
    (repo / ".git").mkdir(parents=True)
    (repo / "src" / "deep").mkdir(parents=True)
    (tmp_path / "outer" / ".gitignore").write_text("*.py\n")  # above the repository: not its rules
    (tmp_path / "outer" / ".ignore").write_text("*.bak\n")
    (repo / ".gitignore").write_text("/src/gone.txt\n")
    for n in ("a.py", "b.tmp", "c.bak", "gone.txt", "deep/gone.txt"):
        (repo / "src" / n).write_text("x")
    names = lambda **k: [os.path.relpath(p, repo / "src") for p in files.list_files(str(repo / "src"), **k)]
    assert names() == ["a.py", "deep/gone.txt"]
    assert names(gitignore=False) == ["a.py", "b.tmp", "deep/gone.txt", "gone.txt"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tessera import cli

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# Cache\n\nThe cache holds a limit of many entries.\n")
    item = tmp_path / "data" / "sources" / "github" / "o" / "r" / "issues"
    item.mkdir(parents=True)
    (item / "7-cache.md").write_text("# Issue #7: cache\n\nThe cache is too small for this, and the limit is hit.\n")
    (item / "note.txt").write_text("cache cache cache")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    monkeypatch.setattr(cli.git, "repository", lambda _: ("o", "r"))
    run = lambda *a: (cli.main([*a, "--data-dir", str(tmp_path / "data")]), *capsys.readouterr())
    code, out, err = run("cache limit", str(src))
    assert code == 0 and "a.md:1" in out and "github:o/r#7-cache" in out and "note.txt" not in out
    assert "github:" not in run("cache limit", str(src), "-g", "*.md")[1]
    assert run("x", str(src))[1] == "" and run("zzzzzz", str(src), "--json")[1] == ""
    (tmp_path / "none").mkdir()
    code, out, err = run("cache", str(tmp_path / "none"), "-g", "*.rs")
    assert code == 0 and out == "" and "no files found" in err
    assert run("cache", str(tmp_path / "missing"))[0] == 1
    with pytest.raises(FileNotFoundError):
        run("cache", str(src), "--model", "other")


def test_model_folder(tmp_path, monkeypatch):
    from tessera.operators.embed import resolve_model

    monkeypatch.chdir(tmp_path)
    assert resolve_model(None, None, "data") is None and resolve_model(None, "d", "data") == "d"
    at = tmp_path / "data" / "models" / "m"
    at.mkdir(parents=True)
    (at / "tokenizer.json").write_text("{}")
    assert resolve_model("m", None, "data") == os.path.join("data", "models", "m")
    (tmp_path / "models" / "m").mkdir(parents=True)
    (tmp_path / "models" / "m" / "tokenizer.json").write_text("{}")
    assert resolve_model("m", None, "data") == os.path.join("models", "m")
